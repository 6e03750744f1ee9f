"""The required cases of the math check, reading rules, and derivatives and normal forms against values."""

import numpy as np
import pytest

from lectern.functions import algebra
from lectern.operators import mathcheck

ZERO_AT_POINTS = "2x cos(x^2)+" + "*".join(f"(x{'+' if p < 0 else '-'}{abs(p)})" for p in algebra.POINTS)

CASES = [
    ("derivative", "sin(x²)", "2x cos(x²)", "correct", "symbolic"), ("derivative", "sin(x²)", r"$2x\cos(x^2)$", "correct", "symbolic"),
    ("derivative", "sin(x²)", "d/dx sin(x^2) = 2x·cos(x²)", "correct", "symbolic"), ("derivative", "sin(x²)", "cos(x²)", "incorrect", "numeric_rejection"),
    ("derivative", "sin(x²)", "cos(2x)", "incorrect", "numeric_rejection"), ("derivative", "sin(x²)", "-2x cos(x²)", "incorrect", "numeric_rejection"),
    ("derivative", "e^(3x²)", "6x e^(3x²)", "correct", "symbolic"), ("derivative", "x²/2", "|x|", "incorrect", "numeric_rejection"),
    ("antiderivative", "x cos x", "x sin x + cos x + C", "correct", "symbolic"), ("antiderivative", "x cos x", "x sin x - cos x + C", "incorrect", "numeric_rejection"),
    ("value", "e − 1", "e-1", "correct", "symbolic"), ("value", "e − 1", "1.72", "correct", "rounded"), ("value", "e − 1", "1.718", "correct", "rounded"),
    ("value", "e − 1", "e", "incorrect", "numeric_rejection"), ("value", "e − 1", "2e-2", "incorrect", "numeric_rejection"), ("value", "e − 1", "1.75", "incorrect", "numeric_rejection"),
    ("value", "e − 1", "1.7", "unknown", "low_precision"), ("derivative", "sin(x²)", ZERO_AT_POINTS, "incorrect", "numeric_rejection"),
    ("derivative", "-cos(2x)/2", "sin(2x)", "correct", "symbolic"), ("value", "6", "does not exist", "unknown", "non_math_text"), ("value", "6", "0/0", "unknown", "parse_failed"),
    ("value", "2", "3x²-3", "incorrect", "numeric_rejection"), ("value", "6", "1/2x", "unknown", "ambiguous"), ("value", "6", "__import__('os').getpid()", "unknown", "parse_failed"),
    ("value", "6", "9**9**9**9", "unknown", "too_long"), ("value", "6", "1" * 300, "unknown", "too_long"), ("value", "6", "(" * 50 + "1" + ")" * 50, "unknown", "too_long"),
    ("value", "6", None, "absent", None), ("none", "6", "6", "unknown", "no_answer_check"), ("value", None, "6", "unknown", "no_answer_check"), ("value", "6", "12/2", "correct", "symbolic"),
    ("value", "1/3", r"\frac{1}{3}", "correct", "symbolic"), ("value", "6", "6.0", "correct", "rounded"), (None, None, None, "unknown", "no_answer_check"),
]


def test_required_cases(spark):
    rows = [(i, *c[:3]) for i, c in enumerate(CASES)]
    rows += [(100 + i, *c[:3]) for i, c in enumerate(CASES)]  # repeated answers
    got = {r.i: r for r in mathcheck.checked(spark.createDataFrame(rows, "i int, kind string, target string, answer string")).collect()}
    assert len(got) == len(rows)
    wrong = [(CASES[i % 100], r.status, r.reason) for i, r in sorted(got.items()) if (r.status, r.reason) != CASES[i % 100][3:]]
    assert wrong == []


def test_missing_constant_and_small_differences():
    assert mathcheck.judged("antiderivative", "x cos x", "x sin x + cos x") == ("correct", "symbolic", True)
    assert mathcheck.judged("antiderivative", "x cos x", "x sin x + cos x + C") == ("correct", "symbolic", False)
    assert mathcheck.judged("derivative", "sin(x^2)", "2x cos(x^2) + .000001*.000001 sin(x)")[:2] == ("incorrect", "symbolic")
    assert algebra.compared(algebra.read("sqrt(1+sin(2x))"), algebra.read("|sin x + cos x|"), 1) == ("unknown", "equivalence_unproven")
    assert algebra.compared(algebra.read("sin(2x)"), algebra.read("2 sin x cos x"), 1) == ("correct", "symbolic")


@pytest.mark.parametrize("a, b", [
    ("tan(x)^2+1", "sec(x)^2"), ("csc(x)^2", "1+cot(x)^2"), ("x/sqrt(x)", "sqrt(x)"), ("(x^2-1)/(x-1)", "x+1"), ("exp(x)exp(2x)", "e^(3x)"), ("ln(e^(2x))", "2x"), ("cos(3x)", "4cos(x)^3-3cos(x)"),
    ("sin(-x)", "-sin x"), ("(x+1)^5", "x^5+5x^4+10x^3+10x^2+5x+1"), ("1/(x+1)-1/(x+2)", "1/((x+1)(x+2))"), ("e^(ln x)", "sqrt(x)^2"), ("sin(pi)", "0"), ("sqrt(4)", "2"), ("|-x|", "|x|"), ("sin^2 x + cos^2 x", "1"),
])
def test_identities_are_proved(a, b):
    assert algebra.compared(algebra.read(a), algebra.read(b), 3) == ("correct", "symbolic")


def test_reading():
    at = np.array([0.5, 2.0])
    for text, want in (("sin x^2", np.sin(at**2)), ("2x cos(x)", 2 * at * np.cos(at)), ("sin 2x cos x", np.sin(2 * at) * np.cos(at)), ("-x^2", -(at**2)), ("2^3^2", at * 0 + 512), ("|x-1||x|", abs(at - 1) * at), ("2|x|", 2 * at)):
        assert np.allclose(algebra.values(algebra.read(text), at), want), text
    for text in ("", "x+", "(x", "x)", "sin", "y", "2..3", "x=="):
        with pytest.raises(algebra.Unread):
            algebra.read(text)


def test_slopes_against_differences():
    at, h = np.array([0.3, 0.6, 0.9]), 1e-6
    for name in [n for n in algebra.NAMES if n != "log"]:
        tree = algebra.read(f"{name}(x^2/2)+x^x")
        near = (algebra.values(tree, at + h) - algebra.values(tree, at - h)) / (2 * h)
        assert np.allclose(algebra.values(algebra.slope(tree), at), near, rtol=1e-4), name


def test_leaks(spark):
    replies = [(1, "so $y = 2 x$ it is"), (2, "try $x = 2$ and $[-2, 2]$"), (3, "you had $x + x$ yourself"), (4, "maybe $\\sqrt{1 + \\sin(2x)}$"), (5, "no math"), (6, "$3x$ or $x^2$"), (7, None)]
    withheld = [(i, "final_answer", "derivative", "x^2") for i in (1, 2, 3, 5, 6, 7)] + [(4, "key_expression", "expression", "|sin x + cos x|"), (6, "key_expression", "expression", "x*x")]
    written = [(3, "2x"), (1, "x"), (6, None)]
    got = mathcheck.leaks(spark.createDataFrame(replies, "reply_id int, reply string"), spark.createDataFrame(withheld, "reply_id int, check string, kind string, target string"), spark.createDataFrame(written, "reply_id int, said string"))
    assert sorted(map(tuple, got.collect())) == [(1, "final_answer"), (4, "key_expression"), (6, "key_expression")]
