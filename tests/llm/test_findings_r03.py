"""Small cases of the findings of round 3 on training-data operators."""

import random

from lectern.llm import suffixes


def test_suffix_rows_do_not_grow_with_parts(spark, monkeypatch):
    r = random.Random(3)
    text = "".join(r.choices("abcdefghij ", k=20_000))
    docs = spark.createDataFrame([(i, text[i * 10 :]) for i in range(6)], "doc_id long, text string")
    seen = {}
    plain = suffixes.staged
    monkeypatch.setattr(suffixes, "staged", lambda df, tag: seen.setdefault(tag, plain(df, tag)))
    monkeypatch.setattr(suffixes, "PART", 4_000)
    gone = {x.doc_id: suffixes.united(x.gone, len(text)).tolist() for x in suffixes.repeated_spans(docs).collect()}
    assert gone == {i: [[0, len(text) - i * 10]] for i in range(1, 6)}
    assert seen["named"].count() == seen["named"].select("doc_id").distinct().count() == 6
