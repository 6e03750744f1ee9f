"""License scans against a plain search for phrases; copies with edits; odd rows."""

import random
import re

from lectern.llm import licenses

SCHEMA = "doc_id long, text string, label string, PLACES string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def base(text):
    found = words(text)
    hits = [(i, label) for label, phrase in licenses.PHRASES for i in range(len(found)) if found[i : i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in hits]
    return len(found), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))


def scan(spark, texts):
    rows = [(i, t, "x", "y") for i, t in enumerate(texts)]
    return {r.doc_id: r for r in licenses.scanned(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_phrases_against_plain_search(spark):
    r = random.Random(3)
    pool = ["under", "the", "MIT", "license", "Apache", "version", "2", "cc", "by", "nc", "über", "x-y", "CC-BY-NC", "under the MIT License,", "Apache License, Version 2.0"]
    texts = [" ".join(r.choice(pool) for _ in range(r.randrange(0, 60))) for _ in range(150)]
    texts += [None, "", "\n\n", "cc by", "cc\x00by\x7fnc", "CC·BY NC", "cc by nc " * 5000, "by " * 30000 + "cc-by-nc"]
    got = scan(spark, texts)
    for i, t in enumerate(texts):
        x = got[i]
        assert (x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels) == base(t), t
        assert set(filter(None, x.base_labels.split(","))) <= set(filter(None, x.labels.split(","))) and 0 <= x.score <= 1


def test_edited_copies_and_clean_texts(spark):
    notice = dict((x[:40], (label, x)) for label, x in licenses.NOTICES)
    texts, want = [], []
    for label, text in notice.values():
        w = text.split()
        texts.append("Intro words. " + text.upper() + " and so on")
        want.append(label)
        if len(w) > 14:
            texts.append(" ".join([*w[:6], "quite", *w[6:11], *w[12:]]))  # one word put in, one left out
            want.append(label)
    texts.append("the software is free of charge and the license of this file was granted to any person who may use the source and binary forms")
    texts.append(" ".join(reversed(licenses.NOTICES[0][1].split())))
    got = scan(spark, texts)
    for i, label in enumerate(want):
        assert label in got[i].labels.split(","), texts[i]
    for i in range(len(want), len(texts)):
        assert got[i].labels == "" and got[i].score < 0.5


def test_spans_lie_where_the_notice_is(spark):
    text = "a b c " + licenses.NOTICES[4][1] + " d e f"
    found = licenses.spans(spark.createDataFrame([(1, text, "x", "y")], SCHEMA)).collect()
    assert [(r.label, r["first"], r["last"], r.share) for r in found] == [("bsd", 3, 3 + len(licenses.NOTICES[4][1].split()) - 1, 1.0)]


def test_repeated_rows_nulls_and_empty(spark):
    rows = [(1, "under the MIT license", None, None)] * 3 + [(1, "other text here", None, None), (None, "cc by nc", None, None), (None, None, None, None)]
    out = sorted((r.doc_id or -1, r.n_base, r.labels) for r in licenses.scanned(spark.createDataFrame(rows, SCHEMA)).collect())
    assert out == [(-1, 0, ""), (-1, 1, "cc-by-nc"), (1, 0, ""), (1, 1, "mit"), (1, 1, "mit"), (1, 1, "mit")]
    assert licenses.scanned(spark.createDataFrame([], SCHEMA)).count() == 0


def test_plan_is_native(spark):
    df = licenses.scanned(spark.createDataFrame([(1, "x", "x", "y")], SCHEMA))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian", plan)
