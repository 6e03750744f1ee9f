"""Sources: uploads, catalogs, embeddings, question schemas, traces, replays, caches.

Files are read by Spark's own readers, so any store that Spark reaches will do. A document that can't be read
becomes a row with status `failed`, not an exception.
"""

from __future__ import annotations

import functools
import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import text

PAGES = "document_id string, filename string, content_version string, page_number int, body string, status string, reason string"
TEXT_SUFFIXES = ("", "txt", "md", "tex")
PREVIEW_PAGES, PREVIEW_PARAGRAPHS, PREVIEW_LINES = 5, 80, 120
#: Folders of a day's events.
SHELVES = 8


def docx_paragraphs(data: bytes) -> list[str]:
    """Text of a Word file's paragraphs."""
    space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    return ["".join(t.text or "" for t in p.iter(f"{space}t")) for p in root.iter(f"{space}p")]


def pdf_pages(data: bytes) -> list[str]:
    """Text of a PDF's pages, where the optional reader is installed."""
    from pypdf import PdfReader

    return [page.extract_text() or "" for page in PdfReader(io.BytesIO(data)).pages]


def _decoded(name: str, data: bytes, preview: bool) -> tuple[list[str], str | None]:
    suffix = name.rpartition(".")[2].lower() if "." in name else ""
    try:
        if suffix == "pdf":
            pages = pdf_pages(data)
            return pages[:PREVIEW_PAGES] if preview else pages, None
        if suffix == "docx":
            parts = docx_paragraphs(data)
            return ["\n".join(parts[:PREVIEW_PARAGRAPHS] if preview else parts)], None
        if suffix in TEXT_SUFFIXES:
            body = data.decode("utf-8", errors="replace")
            return ["\n".join(body.split("\n")[:PREVIEW_LINES]) if preview else body], None
    except Exception as e:  # the file's fault: it becomes a row
        return [], f"unreadable: {type(e).__name__}"
    return [], f"unsupported file type: .{suffix}"


def uploads(spark: SparkSession, path: str, preview: bool = False) -> DataFrame:
    """Pages of all files below path (PDF, Word, text)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    rows = files.select(text.slug(F.regexp_replace(name, r"\.[^.]*$", "")).alias("document_id"), name.alias("filename"), F.substring(F.sha2("content", 256), 1, 16).alias("content_version"), "content")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                pages, reason = _decoded(r.filename, bytes(r.content), preview)
                out += [(r.document_id, r.filename, r.content_version, i, p, "ok", None) for i, p in enumerate(pages, 1)] if reason is None else [(r.document_id, r.filename, r.content_version, None, None, "failed", reason)]
            yield pd.DataFrame(out, columns=["document_id", "filename", "content_version", "page_number", "body", "status", "reason"]).astype({"page_number": "Int32"})

    return rows.mapInPandas(read, PAGES)


def texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files, inside the JVM."""
    return spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("filename"), F.lit(1).alias("page_number"), F.col("value").alias("body"))


def last_by_key(rows: DataFrame, key: str, ordinal: str) -> DataFrame:
    """The last of the rows with one key."""
    rest = [c for c in rows.columns if c not in (key, ordinal)]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), ordinal).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in rest])


def catalog(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """JSON lines with a given schema; blank lines are skipped, a broken line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of one JSON object of strings."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m"))
    return whole.select(F.explode("m").alias("key", "value"))


def embeddings(records: DataFrame, vectors: DataFrame) -> DataFrame:
    """Vectors with the fields of their records, numbered in the records' order (`ordinal`); a record without a vector keeps its place with none."""
    return records.join(vectors, "record_id", "left").select(*records.columns, *[c for c in vectors.columns if c != "record_id"])


def questions(spark: SparkSession, path: str, concepts: DataFrame, schema: str) -> DataFrame:
    """Question schemas with their concept's name; a concept that the course doesn't have keeps its id as its name."""
    read = spark.read.schema(schema).json(path)
    return read.join(concepts.select("concept_id", F.col("name").alias("_name")), "concept_id", "left").withColumn("concept_name", F.coalesce("_name", F.col("concept_id").cast("string"))).drop("_name")


def shelf(session_id: Column) -> Column:
    """The folder inside a day's folder that holds a session's events."""
    return F.pmod(F.hash(session_id.cast("string")), F.lit(SHELVES))


def traces(spark: SparkSession, root: str, schema: str, session_id: str | None = None) -> DataFrame:
    """Trace events below root/day=.../shelf=...; broken files are skipped, folders pruned."""
    out = spark.read.schema(f"{schema}, shelf int").option("mode", "DROPMALFORMED").option("basePath", root).json(root)
    if session_id is not None:
        out = out.where((F.col("shelf") == shelf(F.lit(session_id))) & (F.col("session_id") == session_id))
    return out.drop("shelf")


def replayed(queries: DataFrame, reports: DataFrame) -> DataFrame:
    """Saved reports for questions, by the question with its white space collapsed."""
    return queries.withColumn("_k", text.collapsed(F.col("query"))).join(reports.withColumn("_k", text.collapsed(F.col("question"))), "_k", "left").drop("_k")


def table_of(spark: SparkSession, url: str, name: str, **options: str) -> DataFrame:
    """A table of a relational database (its driver must be on the class path)."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()


def cached(requests: DataFrame, cache: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of requests against a cache of answers; the last answer to a key counts."""
    by = Window.partitionBy(key).orderBy(F.desc("ordinal"))
    last = cache.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n", "ordinal")
    return requests.join(last, key), requests.join(last, key, "left_anti")


def cache_key(fields: dict[str, Column]) -> Column:
    """SHA-256 of a compact JSON object with sorted keys."""
    return F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)])), 256)


def page_text(html: Column) -> Column:
    """The text of a web page: scripts, styles and tags dropped, common entities read."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"(?i)<(br|/p|/div|/li|/h[1-6]|/tr)\b[^>]*>", "\n"), r"(?s)<[^>]+>", " ")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.array_join(text.lines(out), "\n")


def safe_name(name: Column) -> Column:
    return F.regexp_replace(name, r"[^A-Za-z0-9._-]+", "_")


def layered(*layers: dict[str, str]) -> dict[str, str]:
    """Settings from the weakest layer to the strongest: defaults, file, environment, command line. A null or absent value leaves the weaker one."""
    out: dict[str, str] = {}
    for layer in layers:
        out |= {k: v for k, v in layer.items() if v is not None}
    return out


def layered_columns(*layers: Column) -> Column:
    """The same for columns of string maps: later maps win, null values don't."""
    known = [F.map_filter(F.coalesce(m, F.create_map().cast("map<string,string>")), lambda k, v: v.isNotNull()) for m in layers]

    def over(weak: Column, strong: Column) -> Column:
        return F.map_concat(F.map_filter(weak, lambda k, v: ~F.map_contains_key(strong, k)), strong)

    return functools.reduce(over, known)
