"""Porter's stemmer as columns, and the same rules as DuckDB SQL.

A word is first marked: a y that counts as a consonant (at the start or behind a vowel) is written Y. With that, the measure of a stem (its number of
vowel-consonant sequences) and the other conditions are regular expressions over letters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SOME = "^[^aeiouy]*[aeiouy]+[^aeiouy]"  # measure above 0
_MORE = "^[^aeiouy]*[aeiouy]+[^aeiouy]+[aeiouy]+[^aeiouy]"  # measure above 1
_VOWEL = "[aeiouy]"
_SHORT = "[^aeiouy][aeiouy][^aeiouywxY]$"  # consonant, vowel, consonant other than w, x, y
_DOUBLE = "(bb|cc|dd|ff|gg|hh|jj|kk|mm|nn|pp|qq|rr|tt|vv|ww|xx)$"

#: Suffixes of the published algorithm, with its author's later changes (bli, logi), in its order.
PLURALS = [("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")]
SECOND = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"),
    ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"),
    ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log"),
]
THIRD = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
FOURTH = [
    ("al", ""), ("ance", ""), ("ence", ""), ("er", ""), ("ic", ""), ("able", ""), ("ible", ""), ("ant", ""), ("ement", ""), ("ment", ""), ("ent", ""),
    ("sion", "s"), ("tion", "t"), ("ou", ""), ("ism", ""), ("ate", ""), ("iti", ""), ("ous", ""), ("ive", ""), ("ize", ""),
]


def _longest(rules: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Longest suffixes first: the one that fits decides, whether or not its condition holds."""
    return sorted(rules, key=lambda r: -len(r[0]))


class _Sql:
    """Expressions over a word as DuckDB SQL."""

    def __init__(self, word: str):
        self.word = word

    def ends(self, suffix: str) -> str:
        return f"suffix({self.word}, '{suffix}')"

    def stem(self, n: int, added: str = "") -> str:
        return f"(left({self.word}, length({self.word}) - {n}) || '{added}')"

    def has(self, of: str, pattern: str) -> str:
        return f"regexp_matches({of}, '{pattern}')"

    def case(self, rules: list[tuple[str, str]], other: str) -> str:
        return f"CASE {' '.join(f'WHEN {t} THEN {v}' for t, v in rules)} ELSE {other} END" if rules else other

    def replaced(self, pattern: str, by: str, n: int) -> str:
        return f"regexp_replace({self.word}, '{pattern}', '{by}', 'g')"

    def both(self, *tests: str) -> str:
        return "(" + " AND ".join(tests) + ")"

    def neither(self, test: str) -> str:
        return f"(NOT {test})"


class _Spark(_Sql):
    """The same as Spark columns."""

    def __init__(self, word: Column):
        self.word = word

    def ends(self, suffix: str) -> Column:
        return self.word.endswith(suffix)

    def stem(self, n: int, added: str = "") -> Column:
        return F.concat(F.left(self.word, F.char_length(self.word) - n), F.lit(added))

    def has(self, of: Column, pattern: str) -> Column:
        return of.rlike(pattern)

    def case(self, rules: list[tuple[Column, Column]], other: Column) -> Column:
        for test, value in reversed(rules):
            other = F.when(test, value).otherwise(other)
        return other

    def replaced(self, pattern: str, by: str, n: int) -> Column:
        return F.regexp_replace(self.word, pattern, by.replace("\\", "$"))

    def both(self, *tests: Column) -> Column:
        out = tests[0]
        for t in tests[1:]:
            out = out & t
        return out

    def neither(self, test: Column) -> Column:
        return ~test


def _table(x: _Sql, rules: list[tuple[str, str]], condition: str | None):
    """One step: the longest suffix that fits is replaced where the condition holds for what stands before it."""
    chosen = []
    for suffix, by in _longest(rules):
        # of sion and tion only ion goes: what stands before it includes the s or t
        before = x.stem(len(suffix), by) if suffix in ("sion", "tion") else x.stem(len(suffix))
        new = x.stem(len(suffix), by)
        chosen.append((x.ends(suffix), new if condition is None else x.case([(x.has(before, condition), new)], x.word)))
    return x.case(chosen, x.word)


def _marked(x: _Sql):
    return x.replaced("(^|[aeiou])y", r"\1Y", 1)


def _paired(x: _Sql):
    return x.replaced("yy", "yY", 0)


def _past(x: _Sql):
    """eed, ed, ing; a # marks a stem that has lost ed or ing."""
    gone = [(x.ends(s), x.case([(x.has(x.stem(len(s)), _VOWEL), x.stem(len(s), "#"))], x.word)) for s in ("ing", "ed")]
    return x.case([(x.ends("eed"), x.case([(x.has(x.stem(3), _SOME), x.stem(1))], x.word)), *gone], x.word)


def _mended(x: _Sql):
    """What such a stem needs: an e put back, or a doubled consonant undone."""
    bare = x.stem(1)
    short = x.both(x.has(bare, _SHORT), x.has(bare, _SOME), x.neither(x.has(bare, _MORE)))
    cases = [(x.has(bare, "(at|bl|iz)$"), x.stem(1, "e")), (x.has(bare, _DOUBLE), x.stem(2)), (short, x.stem(1, "e"))]
    return x.case([(x.ends("#"), x.case(cases, bare))], x.word)


def _last_y(x: _Sql):
    return x.case([(x.both(x.has(x.word, "[yY]$"), x.has(x.stem(1), _VOWEL)), x.stem(1, "i"))], x.word)


def _last_e(x: _Sql):
    one = x.both(x.has(x.stem(1), _SOME), x.neither(x.has(x.stem(1), _SHORT)))
    return x.case([(x.both(x.ends("e"), x.has(x.stem(1), _MORE)), x.stem(1)), (x.both(x.ends("e"), one), x.stem(1))], x.word)


def _last_l(x: _Sql):
    return x.case([(x.both(x.ends("ll"), x.has(x.stem(1), _MORE)), x.stem(1))], x.word)


_STEPS = [
    _marked, _paired, lambda x: _table(x, PLURALS, None), _past, _mended, _last_y, lambda x: _table(x, SECOND, _SOME), lambda x: _table(x, THIRD, _SOME),
    lambda x: _table(x, FOURTH, _MORE), _last_e, _last_l,
]


def with_stem(df: DataFrame, word: str, name: str) -> DataFrame:
    """df with the stem of the lower-case word in `word` as `name`; words of one or two letters, and those with other letters than a-z, stay as they are.

    Each step is a column of its own over the one before, so that every rule stands in the plan once. Write the result down before it is filtered or joined by
    its stems: an optimizer that moves such a test below the steps writes them into one another.
    """
    out = df.withColumn(name, F.col(word))
    for step in _STEPS:
        out = out.withColumn(name, step(_Spark(F.col(name))))
    return out.withColumn(name, F.when(F.col(word).rlike("^[a-z]{3,}$"), F.translate(name, "Y", "y")).otherwise(F.col(word)))


def stems_sql(words: str, name: str) -> str:
    """CTEs of DuckDB SQL: `name`(word, stem) from the query `words`, which gives distinct lower-case words."""
    ctes = [f"{name}0 AS (SELECT word, word AS s FROM ({words}))"]
    for i, step in enumerate(_STEPS):
        ctes.append(f"{name}{i + 1} AS (SELECT word, {step(_Sql('s'))} AS s FROM {name}{i})")
    ctes.append(f"{name} AS (SELECT word, CASE WHEN regexp_matches(word, '^[a-z]{{3,}}$') THEN translate(s, 'Y', 'y') ELSE word END AS stem FROM {name}{len(_STEPS)})")
    return ", ".join(ctes)
