"""Segmentation of documents into lines, typed blocks, sections and topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed, text
from ..staging import staged


def lines(docs: DataFrame) -> DataFrame:
    """(document_id, page_number, line_no, text) of (document_id, page_number, body): normalised, non-empty, numbered from 1 by page."""
    return docs.select("document_id", "page_number", F.posexplode(text.lines(F.col("body"))).alias("i", "text")).select("document_id", "page_number", (F.col("i") + 1).alias("line_no"), "text")


def classified(rows: DataFrame) -> DataFrame:
    """Adds chapter, section and kind of each line, and whether it opens a block."""
    chapter = F.nullif(F.regexp_extract("text", fixed.CHAPTER, 1), F.lit(""))
    section = F.when(chapter.isNull(), F.nullif(F.regexp_extract("text", fixed.SECTION, 1), F.lit("")))
    return rows.withColumn("chapter_here", chapter).withColumn("section_here", section).withColumn("kind", text.block_type(F.col("text"))).withColumn("opens", F.coalesce("chapter_here", "section_here", "kind").isNotNull())


def tracked(rows: DataFrame) -> DataFrame:
    """Adds the chapter and section in force (a chapter clears the section) and the number of headings so far."""
    order = Window.partitionBy("document_id").orderBy("page_number", "line_no")
    out = rows.withColumn("chapter", F.last("chapter_here", ignorenulls=True).over(order)).withColumn("_chapters", F.count("chapter_here").over(order))
    inside = Window.partitionBy("document_id", "_chapters").orderBy("page_number", "line_no")
    out = out.withColumn("section", F.last("section_here", ignorenulls=True).over(inside)).withColumn("epoch", F.count(F.coalesce("chapter_here", "section_here")).over(order))
    zero = F.when(F.col("chapter") == "0", F.lit(None)).otherwise(F.col("chapter"))
    return out.withColumn("chapter", zero).drop("_chapters")


def size_flushes(lengths: Column, most: int = fixed.BLOCK_CHARS) -> Column:
    """For the lengths of a run of lines, the number of the part of each: a line starts a new part if those before it hold more than `most` characters."""
    state = F.struct(F.lit(0).cast("long").alias("held"), F.lit(0).alias("part"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, n: Column) -> Column:
        full = s["held"] > most
        part = s["part"] + full.cast("int")
        return F.struct((F.when(full, F.lit(0)).otherwise(s["held"]) + n).cast("long").alias("held"), part.alias("part"), F.concat(s["out"], F.array(part)).alias("out"))

    return F.aggregate(lengths, state, step)["out"]


def blocks(rows: DataFrame, most: int = fixed.BLOCK_CHARS) -> DataFrame:
    """Blocks of tracked lines: a heading or keyword starts one, a page ends one, and so does size.

    A page's lines are one bounded group; its parts are found by a fold inside the group.
    """
    page = Window.partitionBy("document_id", "page_number").orderBy("line_no")
    runs = rows.withColumn("run", F.sum(F.col("opens").cast("int")).over(page))
    keys = ["document_id", "page_number", "run"]
    items = F.array_sort(F.collect_list(F.struct("line_no", "text", "chapter", "section", "kind", "opens", "epoch")))
    folded = runs.groupBy(*keys).agg(items.alias("items")).withColumn("part", size_flushes(F.transform("items", lambda x: F.length(x["text"]))))
    parts = folded.select(*keys, F.explode(F.arrays_zip("items", "part")).alias("x")).select(*keys, "x.items.*", F.col("x.part").alias("part"))
    first = F.min(F.struct("line_no", "chapter", "section", "kind", "opens", "epoch", "text"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n")
    out = parts.groupBy(*keys, "part").agg(first.alias("f"), F.max("line_no").alias("line_end"), joined.alias("text"))
    opened = F.col("f.opens") & (F.col("part") == 0)
    out = out.select("document_id", "page_number", F.col("f.line_no").alias("line_start"), "line_end", F.col("f.chapter").alias("chapter_id"), F.col("f.section").alias("section_id"), F.coalesce(F.when(opened, F.col("f.kind")), F.lit("explanation")).alias("block_type"), F.when(opened, F.col("f.text")).alias("heading"), F.col("f.epoch").alias("epoch"), "text")
    number = Window.partitionBy("document_id", "epoch").orderBy("page_number", "line_start")
    ordinal = Window.partitionBy("document_id").orderBy("page_number", "line_start")
    out = out.withColumn("block_no", F.row_number().over(number)).withColumn("block_ordinal", F.row_number().over(ordinal))
    return out.withColumn("label", text.label(F.col("heading"), F.col("block_type"))).drop("epoch")


def block_ids(rows: DataFrame, document_type: Column) -> DataFrame:
    """Adds the printed block id; unique only together with block_ordinal."""
    stem = F.substring(F.concat(F.substring(document_type, 1, 2), F.lit("-"), F.col("document_id").cast("string")), 1, 40)
    number = F.format_string(".b%02d", F.col("block_no"))
    place = F.when(F.col("section_id").isNotNull() & F.col("chapter_id").isNotNull(), F.concat(F.lit(".ch"), "chapter_id", F.lit(".s"), "section_id")).when(F.col("chapter_id").isNotNull(), F.concat(F.lit(".ch"), "chapter_id", F.lit(".pg"), F.col("page_number").cast("string"))).otherwise(F.concat(F.lit(".pg"), F.col("page_number").cast("string")))
    return rows.withColumn("block_id", F.concat(stem, place, number))


def sections(rows: DataFrame) -> DataFrame:
    """First and last place of every chapter and section, with their concepts in order."""
    span = [F.min(F.struct("page_number", "line_start")).alias("s"), F.max(F.struct("page_number", "line_end")).alias("e"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("concept_ids")))).alias("concept_ids")]
    known = rows.where(F.coalesce("chapter_id", "section_id").isNotNull())
    out = known.groupBy("document_id", "chapter_id").agg(*span).withColumn("section_id", F.lit(None).cast("string")).unionByName(known.where("section_id IS NOT NULL").groupBy("document_id", "chapter_id", "section_id").agg(*span))
    return out.select("document_id", "chapter_id", "section_id", F.col("s.page_number").alias("page_start"), F.col("s.line_start").alias("line_start"), F.col("e.page_number").alias("page_end"), F.col("e.line_end").alias("line_end"), "concept_ids")


def topics(rows: DataFrame, by: str, words: int = 15) -> DataFrame:
    """The most frequent longer words of every course, ties in the order of first use."""
    cut = F.regexp_extract_all(F.lower("body"), F.lit("[a-z][a-z-]{4,}"), F.lit(0)).alias("w")
    # outer: a plain explode would have its size tested first, which cuts every text up twice
    tokens = rows.select(by, "passage_id", cut).select(by, "passage_id", F.explode_outer("w").alias("word")).where(~F.col("word").isin(list(fixed.TOPIC_STOP)))
    # counts and least passages are numbers, which a hash table holds for each word; a struct with the place would have every token sorted
    first = F.when(F.count(F.lit(1)) == F.count("passage_id"), F.min("passage_id"))
    counts = tokens.groupBy(by, "word").agg(F.count(F.lit(1)).alias("n"), first.alias("at"))
    near = counts.withColumn("rank", F.rank().over(Window.partitionBy(by).orderBy(F.desc("n"), "at"))).where(F.col("rank") <= words)
    near = staged(near.select(F.col(by).alias("_by"), "word", "n", "at"), "topics")
    # only words of one count and one first passage are told apart by their places in it
    there = near.select("_by", "at").distinct()
    places = rows.join(there, F.col(by).eqNullSafe(F.col("_by")) & F.col("passage_id").eqNullSafe(F.col("at"))).select("_by", "at", cut).select("_by", "at", F.posexplode_outer("w").alias("pos", "word"))
    held = near.alias("a").join(places.alias("b"), F.expr("a._by <=> b._by AND a.at <=> b.at AND a.word = b.word")).groupBy("a._by", "a.word", "n", "a.at").agg(F.min("pos").alias("pos"))
    order = Window.partitionBy("_by").orderBy(F.desc("n"), "at", "pos")
    return held.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= words).select(F.col("_by").alias(by), "word", "n", "rank")


def tagged(rows: DataFrame, concepts: list[tuple[str, str]]) -> DataFrame:
    """Adds concept_ids: the concepts whose name stands in heading or text, in the vocabulary's order.

    A course's vocabulary is a bounded list of its own; it goes into the plan as literals, so rows aren't multiplied.
    """
    body = F.concat_ws(" ", F.col("heading"), F.col("text"))
    tests = [F.when(body.rlike(r"(?i)\b" + name.replace(" ", r"[\s\-]+") + r"\b"), F.lit(cid)) for cid, name in concepts]
    return rows.withColumn("concept_ids", F.array_compact(F.array(*tests)))


def _even(x: Column) -> Column:
    """Small letters, white space and hyphens as one blank."""
    return F.regexp_replace(F.lower(x), r"[\s\-]+", " ")


def _pieces(x: Column) -> Column:
    """Words and the single signs between them."""
    return F.regexp_extract_all(_even(x), F.lit(r"\w+|\W"), F.lit(0))


def _run(n: int, blank: bool) -> str:
    """A pattern that takes a piece at a time and has the n pieces from there as its group 1, which is empty near the end and, unless `blank`, for runs with a blank at an end."""
    if blank:
        return r"(?:(?=((?:\w++|\W){%d}))|)(?:\w++|\W)" % n
    return r"(?:(?! )(?=((?:\w++|\W){%d})(?<! ))|)(?:\w++|\W) ?+" % n


def tagged_by(rows: DataFrame, concepts: DataFrame, key: list[str]) -> DataFrame:
    """As `tagged`, with a vocabulary (concept_id, name, ordinal) of any size; `key` are the columns that tell rows apart.

    Text and names are cut into pieces. A row's distinct runs of pieces, as long as any name is, meet the names in one equi-join; what meets is held against the name as it is written,
    as a hyphen in a name is no blank. Rows are multiplied by their own runs only (those that begin or end in a blank only if a name does), and Spark broadcasts the names if they are few.
    The names are written down, so what gives them is worked out once. Names without a word, and null names, name nothing; a row without text has no concepts.
    """
    body = F.concat_ws(" ", F.col("heading"), F.col("text"))
    named = staged(concepts.select("concept_id", "ordinal", "name", _pieces(F.trim("name")).alias("_pieces")), "names").where(F.col("name").rlike(r"\w"))
    blank = (F.element_at("_pieces", 1) == " ") | (F.element_at("_pieces", -1) == " ")
    said = named.select(F.size("_pieces").alias("n"), blank.alias("blank"), F.contains("name", F.lit("-")).alias("hyphen")).distinct().collect()  # four rows at most for each number of pieces
    lengths = sorted({r.n for r in said})
    if not lengths:
        return rows.withColumn("concept_ids", F.array().cast("array<string>"))
    quoted = F.transform(F.split(F.trim("name"), " +"), lambda w: F.concat(F.lit("\\Q"), w, F.lit("\\E")))
    as_written = F.concat(F.lit(r"(?i)\b"), F.array_join(quoted, r"[\s\-]+"), F.lit(r"\b"))
    names = named.select("concept_id", "ordinal", F.array_join("_pieces", "").alias("_run"), F.when(F.contains("name", F.lit("-")), as_written).alias("_as"))
    cut = rows.select(*key, _even(body).alias("_even"))
    runs = [F.regexp_extract_all("_even", F.lit(_run(n, any(r.blank for r in said))), F.lit(1)) for n in lengths]
    # outer: a plain explode would have its size tested first, which works the runs out twice, with the text written into them
    met = cut.select(*key, F.explode_outer(F.array_distinct(F.concat(*runs))).alias("_run")).join(names, "_run")
    sure = met.where("_as IS NULL")
    if any(r.hyphen for r in said):
        held = met.where("_as IS NOT NULL").join(rows.select(*key, body.alias("_body")), key).where(F.expr("regexp_like(_body, _as)"))
        sure = sure.unionByName(held.drop("_body"))
    found = sure.groupBy(*key).agg(F.transform(F.array_sort(F.collect_set(F.struct("ordinal", "concept_id"))), lambda c: c["concept_id"]).alias("concept_ids"))
    return rows.join(found, key, "left").withColumn("concept_ids", F.coalesce("concept_ids", F.array().cast("array<string>")))


def propagated(rows: DataFrame) -> DataFrame:
    """Blocks without a concept take those of their chapter and section (nulls are a place, too), sorted."""
    place = Window.partitionBy("document_id", "chapter_id", "section_id")
    near = F.array_sort(F.array_distinct(F.flatten(F.collect_set("concept_ids").over(place))))
    return rows.withColumn("concept_ids", F.when(F.size("concept_ids") > 0, F.col("concept_ids")).otherwise(near))
