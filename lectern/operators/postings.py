"""Full-text search with phrases, AND and OR over positional postings.

Stems are made once for each distinct word, of the queries and then of the passages; the few words whose stem a query has are what the texts' postings
meet, so no other posting leaves the scan.

A query is a list of phrases: what stands in double quotes, and each word besides. It asks for all of them, or for any if it says OR. Words are stemmed. A
phrase lies where its words follow one another; its frequency in a passage is the number of such places, and BM25 treats every phrase as a term.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed, porter
from ..staging import staged
from .retrieve import best_sums

#: Latin letters with marks and the letters they are read as.
MARKED, PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"
WORD = r"[\p{L}\p{N}]+"


def words(x: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.lower(x), MARKED, PLAIN), F.lit(WORD), F.lit(0))


def stems(df: DataFrame) -> DataFrame:
    """(word, token): the stem of each distinct `word` of df."""
    return staged(porter.with_stem(df.select("word").distinct(), "word", "token"), "stems")


def parsed(queries: DataFrame) -> DataFrame:
    """(query_id, wants, phrase, size, place, token) from (query_id, query): `wants` is how many of the query's distinct phrases have to be found."""
    any_ = F.col("query").rlike(r"\sOR\s")
    bare = F.regexp_replace(F.regexp_replace("query", r"\sOR(?=\s)", " "), '"[^"]*"', " ")
    quoted = F.transform(F.regexp_extract_all("query", F.lit('"([^"]*)"'), F.lit(1)), words)
    single = F.transform(words(bare), lambda w: F.array(w))
    phrases = F.filter(F.concat(quoted, single), lambda p: F.size(p) > 0)
    listed = queries.select("query_id", any_.alias("any"), F.posexplode(phrases).alias("phrase", "ws"))
    placed = listed.select("query_id", "any", "phrase", F.size("ws").alias("size"), F.posexplode("ws").alias("place", "word"))
    stemmed = placed.join(stems(placed), "word")
    # phrases that are the same once stemmed count once
    same = stemmed.groupBy("query_id", "any", "phrase", "size").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "token"))), lambda x: x["token"]).alias("tokens"))
    same = same.groupBy("query_id", "any", "size", "tokens").agg(F.min("phrase").alias("phrase"))
    wants = F.when(F.col("any"), F.lit(1)).otherwise(F.count(F.lit(1)).over(Window.partitionBy("query_id")))
    asked = same.withColumn("wants", wants)
    return asked.select("query_id", "wants", "phrase", "size", F.posexplode("tokens").alias("place", "token"))


def places(passages: DataFrame, phrases: DataFrame, known: DataFrame) -> DataFrame:
    """(passage_id, dl, number, hits): in how many places of a passage each phrase (number, tokens, size) stands; `known` tells words' stems; dl is the passage's number of words.

    A place whose word begins a phrase stays, with the words behind it; these are held against the phrase one by one.
    """
    longest = phrases.agg(F.max("size")).first()[0] or 1  # one number
    split = passages.select("passage_id", words(F.col("body")).alias("ws"))
    rest = ["ws"] if longest > 1 else []
    # outer: a plain explode would have its size tested first, which cuts every text up again
    held = split.select("passage_id", F.size("ws").alias("dl"), *rest, F.posexplode_outer("ws").alias("pos", "word")).where("word IS NOT NULL")
    met = held.join(known, "word").drop("word").join(phrases.withColumn("token", F.get("tokens", F.lit(0))), "token").drop("token")
    for j in range(1, longest):
        said = known.select(F.col("word").alias("_word"), F.col("token").alias("_token"))
        met = met.join(said, (F.get("ws", F.col("pos") + j) == F.col("_word")) & (F.get("tokens", F.lit(j)) == F.col("_token")), "left").where((F.col("size") <= j) | F.col("_token").isNotNull()).drop("_word", "_token")
    return met.groupBy("passage_id", "dl", "number").agg(F.count(F.lit(1)).alias("hits"))


def search(queries: DataFrame, passages: DataFrame, k: int = fixed.CANDIDATES, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, passage_id, score, n_phrases, rank): the passages that have what the query asks for, by BM25 over its phrases.

    A phrase found in more than half of all passages weighs a millionth. Nulls have no words; a query without words finds nothing. A phrase is looked for once, however
    many queries ask for it; queries and passages then meet in blocks, and a task sends k rows a query on, so pairs of a query and a passage are written nowhere.
    """
    asked = staged(parsed(queries), "asked")
    tokens = F.transform(F.array_sort(F.collect_list(F.struct("place", "token"))), lambda x: x["token"])
    wanted = asked.groupBy("query_id", "wants", "phrase", "size").agg(tokens.alias("tokens"))
    phrases = staged(wanted.select("tokens", "size").distinct().withColumn("number", F.monotonically_increasing_id()), "phrases")
    split = passages.select(F.explode(words(F.col("body"))).alias("word"))
    known = staged(stems(split).join(asked.select("token").distinct(), "token"), "words")
    found = staged(places(passages, phrases, known), "hits")
    stats = passages.agg(F.count(F.lit(1)).alias("n"), F.avg(F.coalesce(F.size(words(F.coalesce("body", F.lit("")))), F.lit(0))).alias("avgdl"))
    df = found.groupBy("number").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = staged(df.crossJoin(F.broadcast(stats)).select("number", F.when(idf > 0, idf).otherwise(1e-6).alias("weight"), "avgdl"), "weights")
    part = F.col("weight") * F.col("hits") * (k1 + 1) / (F.col("hits") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    parts = found.join(weighed, "number").select("passage_id", "number", part.alias("part"))
    sides = wanted.join(phrases, ["tokens", "size"]).select("query_id", "wants", "number")
    return best_sums(sides, parts, k)
