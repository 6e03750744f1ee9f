"""Course graphs: validation rules as queries that return findings, cycles and paths by recursion, worklists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed
from ..staging import staged


def finding(df: DataFrame, rule: str, where: Column, message: Column | str) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), where.cast("string").alias("where"), (F.lit(message) if isinstance(message, str) else message).alias("message"))


def duplicate_ids(entities: DataFrame) -> DataFrame:
    return finding(entities.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "V-04", F.col("id"), "duplicate id")


def misplaced_ids(entities: DataFrame) -> DataFrame:
    """Ids that don't begin with their parent's."""
    return finding(entities.where(~F.startswith(F.col("id"), F.concat("parent_id", F.lit(".")))), "V-04", F.col("id"), "id does not begin with its parent's")


def dangling(links: DataFrame, entities: DataFrame) -> DataFrame:
    """Links (src, dst) to an id that no entity has."""
    return finding(links.join(entities.select(F.col("id").alias("dst")), "dst", "left_anti"), "V-05", F.col("src"), F.concat(F.lit("unknown "), F.col("dst").cast("string")))


def unlisted(children: DataFrame, declared: DataFrame) -> DataFrame:
    """Children (parent_id, id) that their parent's list does not name."""
    return finding(children.join(declared, ["parent_id", "id"], "left_anti"), "V-06", F.col("id"), F.concat(F.lit("not listed by "), F.col("parent_id").cast("string")))


def prerequisite_order(edges: DataFrame, order: DataFrame) -> DataFrame:
    """Prerequisites (src needs dst) of a concept itself or from a later module; order is (id, place)."""
    o = edges.join(order.select(F.col("id").alias("src"), F.col("place").alias("at")), "src").join(order.select(F.col("id").alias("dst"), F.col("place").alias("of")), "dst")
    kind = F.when(F.col("src") == F.col("dst"), "self prerequisite").when(F.col("of") > F.col("at"), "prerequisite from a later module")
    return finding(o.withColumn("kind", kind).where("kind IS NOT NULL"), "V-07", F.col("src"), F.concat("kind", F.lit(" "), F.col("dst").cast("string")))


def on_cycles(edges: DataFrame) -> DataFrame:
    """Ids that reach themselves over (src, dst).

    Ids without a prerequisite or without a dependant, which no cycle has, are peeled off; what is left is closed by
    joins that double the reach.
    """
    loops = edges.where("src = dst").select(F.col("src").alias("id"))
    left = staged(edges.where("src <> dst").select("src", "dst").distinct(), "edges")
    n = left.count()
    while n:
        inner = left.join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        left = staged(inner.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").select("src", "dst"), "edges")
        m = left.count()
        if m == n:
            break
        n = m
    reach, n = left, left.count()
    while n:
        step = reach.select("src", F.col("dst").alias("via")).join(reach.select(F.col("src").alias("via"), "dst"), "via").select("src", "dst")
        reach = staged(reach.union(step).distinct(), "reach")
        m = reach.count()
        if m == n:
            break
        n = m
    return reach.where("src = dst").select(F.col("src").alias("id")).union(loops).distinct()


def paths(nodes: DataFrame) -> DataFrame:
    """(id, path): the titles from the root, for (id, parent_id, title).

    Pointer jumping: every node holds the titles up to some ancestor and takes that ancestor's own on; a round doubles their number, so a tree of depth d
    takes log d rounds, each written to the shared folder. Nodes below a missing parent have no path. When a round brings no further node to its root, what
    is left lies on or below a cycle and has none either.
    """
    now = nodes.select("id", F.col("parent_id").alias("up"), F.col("title").alias("path"))
    done, left, before = now.where("up IS NULL"), staged(now.where("up IS NOT NULL"), "paths"), -1
    above = now
    while (n := left.count()) and n != before:
        # paths repeat their titles and lie packed on disk: a join that goes by the size of the files would broadcast what is many times as large
        own = above.select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("path").alias("_path")).hint("merge")
        step = staged(left.join(own, "up").select("id", F.col("_up").alias("up"), F.concat("_path", F.lit(" > "), "path").alias("path")), "paths")
        done = done.unionByName(step.where("up IS NULL"))
        left, above, before = step.where("up IS NOT NULL"), step.where("up IS NOT NULL").unionByName(done), n
    return done.select("id", "path")


def placed(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds `name`, each row's place from 1 in the order of the whole table: sorted by range, numbered inside each range, the ranges' counts added."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranged = staged(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "ranged")
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_low"))  # a row for each range
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_part", (before - F.col("_low")).alias("_by"))
    return ranged.join(F.broadcast(offsets), "_part").withColumn(name, (F.col("_at") + F.col("_by") + 1).cast("int")).drop("_part", "_at", "_by")


def worklist(assumptions: DataFrame) -> DataFrame:
    """Assumptions a person should look at: those of the fields that matter, without the sure ones, one row for each field."""
    matter = ((F.col("entity") == "Concept") & (F.col("field") == "difficulty_notes")) | ((F.col("entity") == "Course") & (F.col("field") == "assumed_background"))
    rows = assumptions.where(matter & ~F.endswith("id", F.lit(".*")) & ~F.coalesce(F.col("confidence") == "high", F.lit(False)))
    by = rows.groupBy("entity", "id", "field").agg(F.min_by("confidence", "ordinal").alias("confidence"), F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "reason"))), lambda x: x["reason"])), "; ").alias("reasons"))
    rank = F.when(F.col("confidence") == "low", 0).when(F.col("confidence") == "medium", 1).otherwise(2)
    return placed(by.withColumn("_rank", rank), ["_rank", "id", "field"], "place").drop("_rank")


def span_findings(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """Integrity of blocks (document_id, ordinal, page_number, line_start, line_end) and pages (document_id, page_number, n_lines)."""
    b = blocks.join(pages, ["document_id", "page_number"], "left")
    where = F.concat_ws("#", F.col("document_id").cast("string"), F.col("ordinal").cast("string"))
    valid = (F.col("line_start") >= 1) & (F.col("line_end") >= F.col("line_start")) & (F.col("line_end") <= F.col("n_lines"))
    bad = finding(b.where(~F.coalesce(valid, F.lit(False))), "span", where, "span outside its page")
    before = Window.partitionBy("document_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(valid, F.struct("page_number", F.col("line_end").alias("line"))), ignorenulls=True).over(before)
    over = b.withColumn("last", last).where(valid & (F.struct("page_number", F.col("line_start").alias("line")) <= F.col("last")))
    return bad.unionByName(finding(over, "overlap", where, "overlaps the block before it"))


def consistency(header_number: Column, header_tokens: Column, number: Column, tokens: Column) -> Column:
    """verified, conflict or uncertain for one document: numbers decide, else title tokens."""
    both = number.isNotNull() & header_number.isNotNull()
    return (
        F.when(both, F.when(number == header_number, "verified").otherwise("conflict"))
        .when((F.size(tokens) > 0) & (F.size(header_tokens) > 0), F.when(F.arrays_overlap(tokens, header_tokens), "verified").otherwise("conflict"))
        .otherwise("uncertain")
    )


def course_status(rows: DataFrame, override: bool = False) -> DataFrame:
    """The course's status from its documents' states."""
    by = rows.groupBy("course_id").agg(F.count_if(F.col("state") == "conflict").alias("conflicts"), F.count_if(F.col("state") == "uncertain").alias("uncertain"))
    status = F.when(F.col("conflicts") > 0, "override_confirmed" if override else "rejected").when(F.col("uncertain") > 0, "partially_verified").otherwise("verified")
    return by.select("course_id", "conflicts", "uncertain", status.alias("status"))


def confidence_rank(x: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in fixed.CONFIDENCE_RANK.items() for v in kv]), x), F.lit(2))
