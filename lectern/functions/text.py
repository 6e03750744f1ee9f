"""Scalar text functions, Column to Column, all inside the JVM."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

SPACE = r"(?U)\s+"


def among(x: Column, words: tuple[str, ...]) -> Column:
    return x.isin(list(words))


def collapsed(x: Column) -> Column:
    """White space, Unicode's too, as single blanks; none at the ends."""
    return F.trim(F.regexp_replace(x, SPACE, " "))


def lines(x: Column) -> Column:
    """Non-empty lines with collapsed white space; CRLF and CR end lines too."""
    return F.filter(F.transform(F.split(F.regexp_replace(x, "\r\n?", "\n"), "\n"), collapsed), lambda s: s != "")


def intake(x: Column) -> Column:
    """Lines without trailing blanks, at most one empty line in a row."""
    stripped = F.array_join(F.transform(F.split(F.regexp_replace(x, "\r\n?", "\n"), "\n"), lambda s: F.regexp_replace(s, r"(?U)\s+$", "")), "\n")
    return F.trim(F.regexp_replace(stripped, "\n{3,}", "\n\n"), F.lit("\n"))


def slug(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-"), F.lit("-"))


def lexical_terms(x: Column) -> Column:
    """Distinct runs of a-z and digits of three or more characters, without stop words."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(x), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: (F.length(t) > 2) & ~among(t, fixed.LEXICAL_STOP)))


def stem(t: Column) -> Column:
    """Cuts the first suffix that leaves more than three letters."""
    out = t
    for s in reversed(fixed.SUFFIXES):
        cut = F.substring(t, F.lit(1), F.length(t) - len(s))
        out = F.when(F.endswith(t, F.lit(s)) & (F.length(t) > len(s) + 3), F.concat(cut, F.lit("y")) if s == "ies" else cut).otherwise(out)
    return out


def evidence_terms(x: Column) -> Column:
    """Stemmed terms in order, repeats kept; command names of formulas are dropped."""
    words = F.regexp_extract_all(F.lower(F.regexp_replace(x, r"\\[a-zA-Z]+", " ")), F.lit(r"[a-z][a-z0-9]*|\d+"), F.lit(0))
    return F.transform(F.filter(words, lambda t: ~among(t, fixed.EVIDENCE_STOP) & (F.length(t) >= 2)), stem)


def link_terms(x: Column) -> Column:
    return F.array_distinct(F.filter(evidence_terms(x), lambda t: ~t.rlike("^[0-9]+$") & (F.length(t) >= 3) & ~among(t, fixed.LINK_STOP)))


def content_terms(x: Column) -> Column:
    """Distinct evidence terms that aren't generic."""
    return F.array_distinct(F.filter(evidence_terms(x), lambda t: ~among(t, fixed.GENERIC_WORDS)))


def head(x: Column) -> Column:
    """The name part of a key definition."""
    return F.trim(F.split(F.split(x, ":")[0], r"\s\(|\sas\s|\s=\s")[0])


def full_text_terms(x: Column) -> Column:
    words = F.regexp_extract_all(F.lower(x), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda t: ~among(t, fixed.FULL_TEXT_STOP) & (t != "or")))


def full_text_mode(x: Column) -> Column:
    return F.when(x.rlike(r"\s+OR\s+"), F.lit("OR")).otherwise(F.lit("AND"))


def plain_math(x: Column) -> Column:
    """Mathematical notation in ASCII, without commands, braces, dollars and white space."""
    out = F.translate(x, "".join(fixed.MATH_ONE), "".join(fixed.MATH_ONE.values()))
    for a, b in fixed.MATH_MANY.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    out = F.regexp_replace(out, r"\\(left|right|displaystyle|,|;|!|quad)", "")
    out = F.regexp_replace(out, r"\\([a-zA-Z]+)", "$1")
    return F.replace(F.regexp_replace(F.lower(out), r"(?U)[\s{}$]", ""), F.lit("\\"), F.lit(""))


def is_formula(x: Column) -> Column:
    return x.rlike(fixed.FORMULA)


def course_number(x: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(x, fixed.COURSE_NUMBER, 0)), F.lit(""))


def term_name(x: Column) -> Column:
    return F.nullif(F.regexp_extract(x, fixed.TERM, 0), F.lit(""))


def canonical_number(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), "[^a-z0-9]", "")


def identity_tokens(x: Column) -> Column:
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(x), F.lit("[a-z][a-z0-9]+"), F.lit(0)), lambda t: ~among(t, fixed.IDENTITY_STOP)))


def document_type(name: Column, body: Column, pages: Column) -> Column:
    """textbook, syllabus, lecture_notes or other; body is the first pages' text, lower-cased."""
    hits = lambda words: reduce(lambda a, b: a + b, [F.contains(body, F.lit(w)).cast("int") for w in words])
    named = lambda words: reduce(lambda a, b: a | b, [F.contains(F.lower(name), F.lit(w)) for w in words])
    return (
        F.when(pages > 300, "textbook")
        .when(named(fixed.SYLLABUS_NAMES) | (hits(fixed.SYLLABUS_WORDS) >= 2), "syllabus")
        .when(named(fixed.NOTES_NAMES) | (hits(fixed.NOTES_WORDS) > 0), "lecture_notes")
        .otherwise("other")
    )


def file_type(name: Column) -> Column:
    """The type by the file's name alone."""
    low = F.lower(name)
    return F.when(F.contains(low, F.lit("syllabus")), "syllabus").when(low.rlike("note|lecture|chapter"), "lecture_notes").when(low.rlike("textbook|book"), "textbook").otherwise("other")


def block_type(x: Column) -> Column:
    """The type that a line opens, or null."""
    return F.coalesce(*[F.when(x.rlike(p), F.lit(kind)) for p, kind in fixed.BLOCK_OPENINGS])


def label(heading: Column, kind: Column) -> Column:
    return F.when(F.nullif(heading, F.lit("")).isNotNull() & kind.isin(list(fixed.LABELLED)), F.trim(heading))


def structural(kind: Column, heading: Column, body: Column) -> Column:
    """True for a block that is a chapter's or section's heading."""
    short = F.size(F.split(F.trim(body), "\n")) <= 2
    return F.coalesce((kind == "explanation") & (heading.rlike(fixed.CHAPTER) | (heading.rlike(fixed.SECTION) & short)), F.lit(False))


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x worked out once; named inside a lambda as it stands, it would be worked out for each element."""
    return F.element_at(F.transform(F.array(x), f), 1)


def copies_text(query: Column, message: Column, n: int = 6) -> Column:
    """True if n consecutive words of the message stand in the query."""
    held = F.struct(F.split(F.lower(collapsed(message)), " ").alias("words"), F.lower(collapsed(query)).alias("low"))

    def copied(s: Column) -> Column:
        places = F.when(F.size(s["words"]) >= n, F.sequence(F.lit(1), F.size(s["words"]) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.exists(places, lambda i: F.contains(s["low"], F.array_join(F.slice(s["words"], i, n), " ")))

    return let(held, copied)


def citation_labels(x: Column) -> Column:
    """Labels such as P1 of [P1, P2], in the order of their first use."""
    groups = F.regexp_extract_all(x, F.lit(r"\[(P\d+(?:\s*,\s*P\d+)*)\]"), F.lit(1))
    return F.array_distinct(F.flatten(F.transform(groups, lambda g: F.split(g, r"\s*,\s*"))))


def without_labels(x: Column, labels: Column) -> Column:
    """The text without the given citation labels and the punctuation that they leave."""
    def drop(text: Column, name: Column) -> Column:
        text = F.regexp_replace(text, F.concat(F.lit(r"\["), name, F.lit(r"\]")), F.lit(""))
        return F.regexp_replace(text, F.concat(F.lit(r"(?<=[\[,])\s*"), name, F.lit(r"\s*,?|,\s*"), name, F.lit(r"(?=\s*\])")), F.lit(""))

    out = F.aggregate(labels, x, drop)
    for pattern, by in fixed.LABEL_REMAINS:
        out = F.regexp_replace(out, pattern, by)
    return F.trim(out)


def bounded(x: Column, most: int = fixed.ACTIVITY_CHARS) -> Column:
    return F.when(F.length(x) > most, F.concat(F.rtrim(F.substring(x, 1, most - 1)), F.lit("…"))).otherwise(x)


def concept_label(x: Column) -> Column:
    """The last part of a dotted id, with blanks for hyphens."""
    return F.regexp_replace(F.element_at(F.split(x, r"\."), -1), "[-_]+", " ")


def has_cjk(x: Column) -> Column:
    return x.rlike(fixed.CJK)


def token_cost(tokens_in: Column, tokens_out: Column, rate_in: Column, rate_out: Column) -> Column:
    """Price in units of a million tokens, eight decimals; null if any part is."""
    return F.round((tokens_in * rate_in + tokens_out * rate_out) / 1_000_000, 8)


def passage_id(doc: Column, version: Column, page: Column, first: Column, last: Column) -> Column:
    parts = F.concat_ws("|", doc.cast("string"), version.cast("string"), F.coalesce(page.cast("string"), F.lit("None")), first.cast("string"), last.cast("string"))
    return F.concat(F.lit("psg_"), F.substring(F.sha2(parts, 256), 1, 16))


def highlight_url(base: Column, doc: Column, page: Column, first: Column, last: Column) -> Column:
    return F.concat(base, F.lit("/"), doc.cast("string"), F.lit("?page="), page.cast("string"), F.lit("&lines="), first.cast("string"), F.lit("-"), last.cast("string"))


def turn_type(x: Column, history: Column) -> Column:
    """HELP, VAGUE, REASONING, ATTEMPT or NEW_QUESTION: substring tests in this order."""
    low = F.lower(F.trim(x))
    any_of = lambda words: reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words])
    math = x.rlike(r"[=+\-*/^∫∂∑∏]|\d")
    words = F.size(F.filter(F.split(low, SPACE), lambda w: w != ""))
    opens = reduce(lambda a, b: a | b, [F.startswith(low, F.lit(w)) for w in fixed.QUESTION_OPENINGS])
    return (
        F.when(any_of(fixed.HELP_MARKERS), "HELP")
        .when((words < 4) & ~math, "VAGUE")
        .when(any_of(fixed.REASON_MARKERS), "REASONING")
        .when(math | any_of(fixed.MATH_WORDS), "ATTEMPT")
        .when(opens, "NEW_QUESTION")
        .when(history, "ATTEMPT")
        .otherwise("VAGUE")
    )


def math_candidates(x: Column) -> Column:
    """Distinct expressions that a text may offer as its answer, in operators and calls: the sides of equations first, then what matches an offer."""
    sides = F.split(x, "=")
    offers = [F.transform(F.slice(sides, 2, F.greatest(F.size(sides), F.lit(1))), lambda side: F.split_part(F.regexp_replace(side, fixed.OFFER_ENDS, "\n"), F.lit("\n"), F.lit(1)))]
    offers += [F.regexp_extract_all(x, F.lit(pattern), F.lit(group)) for pattern, group in fixed.OFFERED]
    return F.array_distinct(F.filter(F.transform(F.concat(*offers), symbolic), lambda s: s != ""))


def symbolic(x: Column) -> Column:
    """Student and LaTeX notation as operators and calls."""
    return F.trim(reduce(lambda out, rule: F.regexp_replace(out, *rule), fixed.NOTATION, F.trim(x)))
