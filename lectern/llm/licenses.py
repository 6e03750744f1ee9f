"""License scans by diagonal voting: word k-grams of texts vote for the offsets at which a template lies in them.

All rolling k-grams of a text's words are joined on their hash (and, exactly, on their words) to the places they have in the templates. A vote's diagonal
is its place in the text less its place in the template: an unchanged copy votes for one diagonal, one with words put in or left out for a few neighbouring
ones. Votes are collected by diagonal, each diagonal is merged with those up to `DRIFT` words further on, and a span is verified by the
share of the template's words that its k-grams cover. A phrase (`exact`) counts where one diagonal alone has all of its k-grams.

Everything is DataFrame functions. The templates are a fixed list of a few hundred places, which is broadcast; texts are read once and never
shuffled; only votes are, keyed by (id, digest of the text), so rows equal in both share their votes and are counted and given back as often as they occur.
A passage that very many documents have is one small key for each of them. Bounds: the k-grams of one text, the places of the templates.

Words: A-Z lower-cased, runs of ASCII letters and digits and of characters beyond ASCII. Nulls and edge cases: a null text is empty, has no words and no labels; a
text with fewer words than k has no votes; a null id is kept; repeated rows are given back each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

K = 3
#: Words by which a copy may shift against its template, and the share of the template's words that a span has to cover.
DRIFT, SHARE = 4, 0.8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases that count wherever all their words stand consecutively.
PHRASES = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]

#: Openings and notices of well-known licenses.
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "released under the mit license"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(_WORD), 0)


def grams(words: Column, k: int = K) -> Column:
    """The k-grams of a list of words, in order."""
    last = F.size(words) - k
    at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.concat_ws(" ", *[F.get(words, i + j) for j in range(k)]))


def templates(spark: SparkSession, phrases: list[tuple[str, str]] = PHRASES, notices: list[tuple[str, str]] = NOTICES, k: int = K) -> DataFrame:
    """(template, label, exact, size, place, hash, gram): a row for each k-gram of each template."""
    listed = [(label, text, True) for label, text in phrases] + [(label, text, False) for label, text in notices]
    fixed = F.array(*[F.struct(F.lit(i).alias("template"), F.lit(x).alias("label"), F.lit(t).alias("text"), F.lit(e).alias("exact")) for i, (x, t, e) in enumerate(listed)])
    rows = spark.range(1).select(F.explode(fixed).alias("t")).select("t.template", "t.label", "t.exact", words(F.col("t.text")).alias("words"))
    rows = rows.select("template", "label", "exact", F.size("words").alias("size"), F.posexplode(grams(F.col("words"), k)).alias("place", "gram"))
    return rows.withColumn("hash", F.xxhash64("gram"))


def votes(docs: DataFrame, known: DataFrame, k: int = K) -> DataFrame:
    """(doc_id, digest, n_words, copies, template, label, exact, size, diagonal, places): the votes by diagonal; a row without template has the rows' count as copies."""
    text = docs.select("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"), words(F.col("text")).alias("words"))
    # place 0 stands for the row itself, k-grams follow
    marked = text.select("doc_id", "digest", F.size("words").cast("long").alias("n_words"), F.posexplode(F.concat(F.array(F.lit("")), grams(F.col("words"), k))).alias("at", "found"))
    marked = marked.withColumn("hash", F.xxhash64("found"))
    met = marked.join(F.broadcast(known), (marked["hash"] == known["hash"]) & (F.col("found") == F.col("gram")), "left").where("at = 0 OR template IS NOT NULL")
    diagonal = (F.col("at") - 1 - F.col("place")).cast("long")
    return met.groupBy("doc_id", "digest", "n_words", "template", "label", "exact", "size", diagonal.alias("diagonal")).agg(F.count(F.lit(1)).alias("copies"), F.collect_set("place").alias("places"))


def _covered(places: Column, k: int) -> Column:
    """How many of a template's words the k-grams at these places cover."""
    return F.size(F.array_distinct(F.flatten(F.transform(places, lambda p: F.sequence(p, p + k - 1)))))


def verified(voted: DataFrame, k: int = K, drift: int = DRIFT) -> DataFrame:
    """The votes with share, first and last: of each diagonal, merged with those just beyond it, the share of the template's words and the span's first
    and last word in the text. Rows without template pass through."""
    near = Window.partitionBy("doc_id", "digest", "template").orderBy("diagonal").rangeBetween(0, drift)
    own = voted.withColumn("found", F.transform("places", lambda p: F.col("diagonal") + p))
    merged = lambda c: F.when(F.col("exact"), F.col(c)).otherwise(F.array_distinct(F.flatten(F.collect_list(c).over(near))))
    own = own.withColumn("all_places", merged("places")).withColumn("all_found", merged("found"))
    share = F.when(F.col("template").isNotNull(), _covered(F.col("all_places"), k) / F.col("size"))
    kept = [c for c in voted.columns if c not in ("places", "size")]
    return own.select(*kept, share.alias("share"), F.array_min("all_found").alias("first"), (F.array_max("all_found") + k - 1).alias("last"))


def spans(docs: DataFrame, known: DataFrame | None = None, share: float = SHARE) -> DataFrame:
    """(doc_id, digest, label, exact, first, last, share): the licenses found in each text, words from 0, both ends included."""
    found = verified(votes(docs, templates(docs.sparkSession) if known is None else known).where("template IS NOT NULL"))
    near = Window.partitionBy("doc_id", "digest", "template").orderBy("diagonal").rangeBetween(-DRIFT, DRIFT)
    best = found.withColumn("_best", F.max(F.struct("share", -F.col("diagonal"))).over(near)).where(F.col("exact") & (F.col("share") == 1) | ~F.col("exact") & (F.col("share") >= share))
    best = best.where(F.col("exact") | (F.col("_best") == F.struct("share", -F.col("diagonal"))))
    return best.select("doc_id", "digest", "label", "exact", "first", "last", "share")


def scanned(docs: DataFrame, known: DataFrame | None = None, share: float = SHARE) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row of docs."""
    found = verified(votes(docs, templates(docs.sparkSession) if known is None else known))
    base = F.col("exact") & (F.col("share") == 1)
    named = lambda on: F.array_join(F.array_sort(F.collect_set(F.when(on, F.col("label")))), ",")
    out = found.groupBy("doc_id", "digest", "n_words").agg(
        F.max(F.when(F.col("template").isNull(), F.col("copies"))).alias("copies"), F.count(F.when(base, 1)).alias("n_base"), F.min(F.when(base, F.col("diagonal"))).alias("first_word"),
        F.max(F.when(base, F.col("diagonal"))).alias("last_word"), named(base).alias("base_labels"), named(base | ~F.col("exact") & (F.col("share") >= share)).alias("labels"),
        F.coalesce(F.max("share"), F.lit(0.0)).alias("score"),
    )
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("_copy")).drop("_copy")


def _sql() -> str:
    rows = [f"({i}, '{label}', '{text}', {exact})" for i, (label, text, exact) in enumerate([(a, b, "true") for a, b in PHRASES] + [(a, b, "false") for a, b in NOTICES])]
    gram = " || ' ' || ".join(f"w[i + {j}]" for j in range(K))
    cover = lambda p: f"len(list_distinct(flatten(list_transform({p}, lambda x: range(x, x + {K})))))"
    return f"""
WITH tt(template, label, text, exact) AS (VALUES {", ".join(rows)}),
tw AS (SELECT template, label, exact, string_split(text, ' ') AS w FROM tt),
tg AS (SELECT template, label, exact, len(w) AS size, i - 1 AS place, {gram} AS gram FROM (SELECT *, unnest(range(1, len(w) - {K - 2})) AS i FROM tw)),
d AS (SELECT doc_id, row_number() OVER () AS r,
        regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
g AS (SELECT r, i - 1 AS pos, {gram} AS gram FROM (SELECT r, w, unnest(range(1, len(w) - {K - 2})) AS i FROM d)),
v AS (SELECT r, template, label, exact, size, pos - place AS diagonal, list(place) AS places FROM g JOIN tg USING (gram) GROUP BY ALL),
m AS (SELECT r, label, exact, diagonal, CASE WHEN exact THEN {cover("places")} ELSE {cover("flatten(near)")} END / size AS share FROM (
        SELECT *, list(places) OVER (PARTITION BY r, template ORDER BY diagonal RANGE BETWEEN CURRENT ROW AND {DRIFT} FOLLOWING) AS near FROM v)),
f AS (SELECT *, exact AND share = 1 AS base, (exact AND share = 1) OR (NOT exact AND share >= {SHARE}) AS counts FROM m)
SELECT d.doc_id, CAST(len(any_value(d.w)) AS BIGINT) AS n_words, count(*) FILTER (base) AS n_base, min(diagonal) FILTER (base) AS first_word,
  max(diagonal) FILTER (base) AS last_word, coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (base)), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (counts)), ','), '') AS labels, coalesce(max(share), 0.0) AS score
FROM d LEFT JOIN f USING (r) GROUP BY d.r, d.doc_id
"""


SQL = _sql()
