"""A Merkle manifest of a dataset: a tree for each source, a tree over the sources, and a proof for every row.

Leaves are digests of rows, numbered inside their source; every `ARITY` consecutive nodes become one until one node remains (the subroot),
and the subroots in order of source likewise become the root.

Up: children are events of `combineByKey`, keyed by the subtree of ARITY ** STEP leaves they belong to. A combiner holds partial parents, each the digests
of its children by index. A parent's arity follows from the number of nodes of its level; the child that completes it makes it emit its digest,
which is an event of the parent's own parent at once, and its children are forgotten. Rows come sorted, so nearly all subtrees are complete before the
shuffle and only the open frontier at the edges of partitions travels. What a subtree emits is an event of the next STEP levels.

Down: every subtree meets the path of its top node (the siblings of all its ancestors, one row a subtree), works out its own inner nodes again from at most
ARITY ** STEP digests and gives each leaf its path: reverse links from parents to children, from the root to the rows.

Order: by id, nulls first, then by the leaf's digest; repeated rows are leaves each, and those alike in everything are interchangeable. Sources by
UTF-8 bytes, null first. Nulls and edge cases: a null field is `-`, an empty one `0:`; a source of one row has that leaf as its subroot, one source
alone has its subroot as the root; an empty table has no rows and no root; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, staged

ARITY, STEP = 16, 3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(children: list[bytes]) -> bytes:
    """H of digests given as hex text."""
    return hashlib.sha256("".join(c.hex() for c in children).encode()).digest()


def sizes(n: int) -> list[int]:
    """Nodes of each level of a tree over n leaves, the leaves first."""
    out = [n]
    while out[-1] > 1:
        out.append(-(-out[-1] // ARITY))
    return out


class Subtree:
    """Partial parents of one subtree. Its leaves are nodes of `level` in a tree of n leaves; the top is `step` levels above, or the tree's root."""

    def __init__(self, n: int, level: int, step: int = STEP):
        self.n, self.level, self.open, self.top = n, level, {}, None
        self.sizes = sizes(n)
        self.goal = min(level + step, len(self.sizes) - 1)

    def add(self, level: int, index: int, value: bytes) -> Subtree:
        """A child's event; completed parents are events in turn."""
        while level < self.goal:
            parent = index // ARITY
            held = self.open.setdefault((level, parent), {})
            held[index] = value
            if len(held) < min(ARITY, self.sizes[level] - parent * ARITY):
                return self
            del self.open[level, parent]
            level, index, value = level + 1, parent, digest([held[i] for i in sorted(held)])
        self.top = index, value
        return self

    def merge(self, other: Subtree) -> Subtree:
        for (level, _), held in other.open.items():
            for index, value in held.items():
                self.add(level, index, value)
        if other.top:
            self.add(self.goal, *other.top)
        return self


def emitted(nodes: DataFrame, level: int, step: int = STEP) -> DataFrame:
    """(tree, n, i, digest) of the nodes that the subtrees over (tree, n, i, digest), nodes of `level`, emit."""
    spark = nodes.sparkSession
    parts, span = int(spark.conf.get("spark.sql.shuffle.partitions")), ARITY**step
    events = nodes.select("tree", "n", "i", "digest").rdd.map(lambda r: ((r[0], r[1], r[2] // span), (r[1], r[2], bytes(r[3]))))
    made = events.combineByKey(lambda e: Subtree(e[0], level, step).add(level, e[1], e[2]), lambda t, e: t.add(level, e[1], e[2]), Subtree.merge, parts)
    tops = made.map(lambda x: (x[0][0], x[0][1], *x[1].top))
    return spark.createDataFrame(tops, "tree string, n long, i long, digest binary", verifySchema=False)


def grown(nodes: DataFrame, step: int = STEP) -> tuple[list[DataFrame], DataFrame]:
    """The nodes (tree, n, i, digest) of every `step`-th level, and (tree, n, digest) of the trees' roots."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    levels, roots, wide = [nodes], None, ARITY**step
    while True:
        tops = staged(emitted(levels[-1], step * (len(levels) - 1), step), "manifest-nodes")
        ended = tops.where(F.col("n") <= wide).select("tree", "n", "digest")
        roots = ended if roots is None else roots.unionByName(ended)
        if most <= wide:
            return levels, roots
        levels.append(tops.where(F.col("n") > wide))
        wide *= ARITY**step


def segments(n: int, level: int, nodes: list[bytes], step: int = STEP) -> list[list[bytes]]:
    """For each node of a subtree, level by level up to its top: (place among its parent's children, children, digests of the siblings)."""
    goal = min(level + step, len(sizes(n)) - 1)
    out: list[list[bytes]] = [[] for _ in nodes]
    width = 1
    while level < goal:
        parents = []
        for p in range(0, len(nodes), ARITY):
            run = nodes[p : p + ARITY]
            for j in range(len(run)):
                told = bytes((j, len(run))) + b"".join(run[:j] + run[j + 1 :])
                for leaf in range((p + j) * width, min((p + j + 1) * width, len(out))):
                    out[leaf].append(told)
            parents.append(digest(run))
        nodes, level, width = parents, level + 1, width * ARITY
    return out


def steps(path: bytes) -> Iterator[tuple[int, list[bytes]]]:
    """(place, siblings) of each level of a path, from the leaf upwards."""
    at = 0
    while at < len(path):
        place, n = path[at], path[at + 1]
        end = at + 2 + 32 * (n - 1)
        yield place, [path[k : k + 32] for k in range(at + 2, end, 32)]
        at = end


def proof(path: bytes) -> str:
    return hashlib.sha256("".join(x.hex() for _, siblings in steps(path) for x in siblings).encode()).hexdigest()


def folded(leaf: bytes, path: bytes) -> bytes:
    """The root that a leaf and its path give."""
    for place, siblings in steps(path):
        leaf = digest([*siblings[:place], leaf, *siblings[place:]])
    return leaf


_PATHS = "tree string, block long, path binary"
_PROVEN = "tree string, id long, leaf binary, proof_sha256 string, folded binary"


def _descended(nodes: DataFrame, above: DataFrame, level: int, leaves: bool, step: int) -> DataFrame:
    """Paths of the nodes of a level from the paths (tree, block, path) of their subtrees' tops; of leaves, what the paths prove."""

    def run(key: tuple, here: pa.Table, up: pa.Table) -> pa.Table:
        if not here.num_rows:
            return pa.table({c: pa.array([], t) for c, t in (proven if leaves else paths)})
        here = here.sort_by("i")
        digests, top = here["digest"].to_pylist(), up["path"][0].as_py()
        own = [b"".join(s) + top for s in segments(here["n"][0].as_py(), level, digests, step)]
        trees = pa.array([key[0].as_py()] * len(own), pa.string())
        if not leaves:
            return pa.table({"tree": trees, "block": here["i"], "path": pa.array(own, pa.binary())})
        changed = here["changed"].to_pylist()
        ends = [folded(c or d, p) for c, d, p in zip(changed, digests, own, strict=True)]
        return pa.table({"tree": trees, "id": here["id"], "leaf": here["digest"], "proof_sha256": pa.array(map(proof, own), pa.string()), "folded": pa.array(ends, pa.binary())})

    paths = [("tree", pa.string()), ("block", pa.int64()), ("path", pa.binary())]
    proven = [("tree", pa.string()), ("id", pa.int64()), ("leaf", pa.binary()), ("proof_sha256", pa.string()), ("folded", pa.binary())]
    both = nodes.withColumn("block", F.expr(f"i div {ARITY**step}")).groupBy("tree", "block").cogroup(above.groupBy("tree", "block"))
    return both.applyInArrow(run, _PROVEN if leaves else _PATHS)


def descended(levels: list[DataFrame], tops: DataFrame, leaves: bool, step: int = STEP) -> DataFrame:
    """Paths (tree, block, path) of the lowest level's nodes, `block` their place, or what they prove; `tops` (tree, n, path) are the paths of the trees' roots."""
    found = None
    for k in range(len(levels) - 1, -1, -1):
        low, high = ARITY ** (step * k), ARITY ** (step * (k + 1))
        own = tops.where((F.col("n") <= high) & (F.col("n") > (low if k else 0)))
        above = own.select("tree", F.lit(0).cast("long").alias("block"), "path")
        found = _descended(levels[k], above if found is None else above.unionByName(found), step * k, leaves and k == 0, step)
    return found


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _leaf(columns: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[field(c) for c in columns]).cast("binary"), 256))


def proven(docs: DataFrame, id: str = "doc_id", source: str = "source", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), text: str = "text", checked: int = 5, step: int = STEP) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row of docs.

    The rows whose id has a crc32 divisible by `checked` are folded from a leaf with the letters A-Z of `text` in lower case.
    """
    tree = F.coalesce(F.concat(F.lit("1"), F.col(source)), F.lit("0"))
    lowered = [F.translate(c, _UPPER, _LOWER) if c == text else F.col(c) for c in fields]
    tried = F.crc32(F.col(id).cast("string").cast("binary")) % checked == 0
    rows = docs.select(tree.alias("tree"), F.col(id).cast("long").alias("id"), _leaf([F.col(c) for c in fields]).alias("digest"), F.when(tried, _leaf(lowered)).alias("changed"))
    leaves = staged(numbered(staged(rows, "manifest-leaves"), ["id", "digest", "changed"]), "manifest-numbered")
    levels, subroots = grown(leaves, step)
    sources = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("of"), F.col("n").alias("leaves"), "digest")
    sources = staged(numbered(sources, ["of"]), "manifest-sources")
    upper, roots = grown(sources, step)
    paths = descended(upper, roots.select("tree", "n", F.lit(b"").alias("path")), False, step)
    tops = sources.join(paths.select(F.col("block").alias("i"), "path"), "i").select(F.col("of").alias("tree"), F.col("leaves").alias("n"), "path", F.col("digest").alias("subroot"))
    tops = staged(tops, "manifest-tops")
    out = descended(levels, tops.drop("subroot"), True, step)
    root = roots.select(F.col("digest").alias("root"))  # one row
    out = out.join(tops.select("tree", "subroot"), "tree").crossJoin(F.broadcast(root))
    text_of = lambda c: F.lower(F.hex(c))
    return out.select(
        F.col("id").alias(id), text_of("leaf").alias("leaf"), text_of("subroot").alias("subroot"), text_of("root").alias("root"), "proof_sha256",
        text_of("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"),
    )


def manifest(docs: DataFrame, id: str = "doc_id", source: str = "source", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text")) -> DataFrame:
    """(source, rows, subroot) of each source: what a dataset is published with. The root follows from the subroots."""
    tree = F.coalesce(F.concat(F.lit("1"), F.col(source)), F.lit("0"))
    rows = docs.select(tree.alias("tree"), F.col(id).cast("long").alias("id"), _leaf([F.col(c) for c in fields]).alias("digest"))
    _, roots = grown(staged(numbered(rows, ["id", "digest"]), "manifest-numbered"))
    name = F.when(F.col("tree") != "0", F.substring("tree", 2, 1 << 30))
    return roots.select(name.alias("source"), F.col("n").alias("rows"), F.lower(F.hex("digest")).alias("subroot"))


def _sql(levels: int = 6) -> str:
    """The same in DuckDB, with as many levels written out as 16 ** levels rows a source need."""
    from .asof import _crc_sql

    part = lambda c: f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    leaf = lambda t: f"sha256({' || '.join(part(c) for c in ('doc_id', 'source', 'lang', 'n_chars', t))})"
    key = "coalesce('1' || source, '0')"
    ctes = [
        f"d AS (SELECT doc_id, {key} AS s, {leaf('text')} AS leaf, CASE WHEN {_crc_sql('doc_id')} % 5 = 0 THEN {leaf(lowered)} ELSE {leaf('text')} END AS tried FROM documents)",
        "a0 AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, leaf, tried) - 1 AS i, count(*) OVER (PARTITION BY s) AS n FROM d)",
        "l0 AS (SELECT s, i, n, leaf AS h FROM a0)",
    ]
    up = "SELECT {s}, i // 16 AS i, (max(n) + 15) // 16 AS n, CASE WHEN max(n) = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM {of} GROUP BY {s}, i // 16"
    run = "SELECT {s}, i // 16 AS p, max(n) AS n, string_agg(h, '' ORDER BY i) AS run FROM {of} GROUP BY {s}, i // 16"
    for k in range(levels):
        ctes += [f"l{k + 1} AS ({up.format(s='s', of=f'l{k}')})", f"r{k} AS ({run.format(s='s', of=f'l{k}')})"]
    ctes.append(f"m0 AS (SELECT 0 AS s, s AS src, row_number() OVER (ORDER BY s) - 1 AS i, count(*) OVER () AS n, h FROM l{levels})")
    for k in range(levels):
        ctes += [f"m{k + 1} AS ({up.format(s='s', of=f'm{k}')})", f"q{k} AS ({run.format(s='s', of=f'm{k}')})"]
    ctes.append("f0 AS (SELECT a0.*, m0.i AS j, m0.h AS subroot, tried AS cur, '' AS sib FROM a0 JOIN m0 ON a0.s = m0.src)")
    for k in range(2 * levels):
        tree, at, on = (f"r{k}", f"(i // {16**k})", "r.s = f.s") if k < levels else (f"q{k - levels}", f"(j // {16 ** (k - levels)})", "true")
        before, after = f"substr(r.run, 1, 64 * ({at} % 16))", f"substr(r.run, 64 * ({at} % 16) + 65)"
        ctes.append(
            f"f{k + 1} AS (SELECT f.* REPLACE (CASE WHEN r.n = 1 THEN cur ELSE sha256({before} || cur || {after}) END AS cur, "
            f"CASE WHEN r.n = 1 THEN sib ELSE sib || {before} || {after} END AS sib) FROM f{k} f JOIN {tree} r ON {on} AND r.p = {at} // 16)"
        )
    return f"WITH {', '.join(ctes)} SELECT doc_id, leaf, subroot, m.h AS root, sha256(sib) AS proof_sha256, cur AS folded_root, cur = m.h AS verified FROM f{2 * levels}, m{levels} m"


SQL = _sql()
