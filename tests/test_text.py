from pyspark.sql import functions as F

from lectern.functions import ports, text


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr.alias("y")).first()["y"]


def test_lines_collapse_and_drop(spark):
    assert one(spark, text.lines(F.col("x")), "a  b\r\n\r\n\t\r c ") == ["a b", "c"]
    assert one(spark, text.lines(F.col("x")), "") == []


def test_stem_order(spark):
    words = ["integrations", "applying", "studies", "bed", "boxes", "series", "limits"]
    assert one(spark, F.transform("x", text.stem), words, "array<string>") == ["integr", "apply", "study", "bed", "boxe", "seri", "limit"]


def test_section_is_case_sensitive(spark):
    from lectern.functions import fixed

    rows = spark.createDataFrame([("4.5 Title",), ("section 4.5 Title",), ("Section 4.5 Title",), ("CHAPTER 3: X",)], "x string")
    got = [tuple(r) for r in rows.select(F.col("x").rlike(fixed.SECTION), F.col("x").rlike(fixed.CHAPTER)).collect()]
    assert got == [(True, False), (True, False), (False, False), (False, True)]


def test_block_types(spark):
    rows = spark.createDataFrame([("Definition: x",), ("Example",), ("Corollary. y",), ("Note: z",), ("plain",)], "x string")
    assert [r[0] for r in rows.select(text.block_type(F.col("x"))).collect()] == ["definition", None, "theorem", "remark", None]


def test_strip_labels(spark):
    out = one(spark, text.without_labels(F.col("x"), F.array(F.lit("P9"))), "It holds [P1, P9], as in [P9] (see [P9]) .")
    assert out == "It holds [P1], as in."


def test_math_candidates(spark):
    got = one(spark, text.math_candidates(F.col("x")), "so y = x^2/2 + C\nand xsin(x)+cos(x)")
    assert "x**2/2" in got and any("sin(x)" in g for g in got)


def test_turn_types(spark):
    rows = spark.createDataFrame([("help", False), ("ok", True), ("it works because of symmetry here", True), ("I get x = 3 now", True), ("what is a vector field then", True), ("the last one we did", True), ("the last one we did", False)], "x string, h boolean")
    assert [r[0] for r in rows.select(text.turn_type(F.col("x"), F.col("h"))).collect()] == ["HELP", "VAGUE", "REASONING", "ATTEMPT", "NEW_QUESTION", "ATTEMPT", "VAGUE"]


def test_json_objects():
    assert ports.first_object('<think>{"a":1}</think> ```json\n{"b": "x}y"}\n```') == '{"b": "x}y"}'
    assert ports.first_object("none") is None and ports.first_object(None) is None


def test_adhoc_ids_ignore_white_space(spark):
    rows = spark.createDataFrame([("a b\tc",), ("abc",), ("\\int x\\cos(x) dx",), (None,)], "x string").coalesce(1)
    got = [r[0] for r in rows.select(ports.adhoc_suffix("x")).collect()]
    assert got[0] == got[1] and got[2] == "d7df1b60" and got[3] is None


def test_token_cost(spark):
    row = spark.range(1).select(text.token_cost(F.lit(40), F.lit(12), F.lit(0.5), F.lit(1.5)), text.token_cost(F.lit(40), F.lit(None).cast("int"), F.lit(0.5), F.lit(1.5))).first()
    assert row[0] == 0.000038 and row[1] is None
