"""Near-duplicate documents by HyperMinHash.

A document's shingles are hashed once; the hash's leading part picks a bucket and the least rest of each bucket is kept in 16
bits: its count of leading zeros and the bits that follow the first one (the mantissa). Empty buckets borrow the register of
another one along a fixed random path, so that two documents agree in a bucket with the probability of their Jaccard
similarity, whatever their lengths. Bands of registers give candidates; the share of equal registers, less the
collisions expected of compressed registers, estimates the similarity; pairs that may reach the threshold are verified on the
full sets of shingles, read again from the texts.

Equal sets are one class from the start. A band's members are first paired with its least class only, and each class is
verified against the one it shares most bands with; components follow; then, for some rounds, members of a band meet one member
drawn from it if their components differ, and each class is verified against the likeliest. What is still apart after
that is paired across components. So copies are never expanded into all pairs, yet no pair of different texts that
share a band is left undecided: it is verified, below the threshold by its registers, or already linked. With 32 bands of 5 registers a
pair at similarity 0.8 shares none with probability 3e-6, and the estimate's margin is five standard deviations.

Nulls and edge cases: a text without words (or null) has no shingles and links with nothing; a text of fewer words than a
shingle is one shingle; rows with one doc_id count as one document; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HashedWords, dropped, merged, mix64, octets, released, staged

BANDS, ROWS, MANTISSA = 32, 5, 10
REGISTERS = BANDS * ROWS
#: Rounds in which the members of a band meet one of them, before all that is still apart is compared.
ROUNDS = 2
#: Least hashes of a set that are compared before the whole sets are; members of a block.
LOWEST, BLOCK = 512, 256
#: Tries along the path of an empty bucket before its next filled neighbour is taken.
PATH = 48
_MULT = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64(0xFFFFFFFF)


def shingles(text: bytes | None, k: int, hashed: HashedWords) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of A-Z-lower-cased text."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = hashed.of(words)
    n = max(1, len(h) - k + 1)
    g = h[:n].copy() if len(h) >= k else np.full(1, len(h), np.uint64)
    for j in range(1 if len(h) >= k else 0, min(k, len(h))):
        g = g * _MULT + h[j : j + n]
    return np.unique(mix64(g))


def _paths() -> np.ndarray:
    return (mix64(np.arange(REGISTERS * PATH, dtype=np.uint64) + np.uint64(1) << np.uint64(20)) % np.uint64(REGISTERS)).astype(np.int64).reshape(REGISTERS, PATH)


_PATHS = _paths()


def registers(sets: np.ndarray) -> np.ndarray:
    """The HyperMinHash registers of sorted distinct hashes."""
    high = (sets >> np.uint64(32)) * np.uint64(REGISTERS)
    bucket = (high >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))  # sorted hashes: each bucket's least rest comes first
    rest = ((high[first] & _LOW) << np.uint64(32)) | (sets[first] & _LOW)
    zeros = (63 - np.frexp(np.maximum(rest, 1).astype(np.float64))[1] + 1).clip(0, 63).astype(np.uint64)
    mantissa = ((rest << zeros) >> np.uint64(63 - MANTISSA)) & np.uint64((1 << MANTISSA) - 1)
    out = np.zeros(REGISTERS, np.uint16)
    filled = np.zeros(REGISTERS, bool)
    out[bucket[first]] = (zeros << np.uint64(MANTISSA) | mantissa).astype(np.uint16)
    filled[bucket[first]] = True
    empty = np.flatnonzero(~filled)
    if len(empty):
        tried = filled[_PATHS[empty]]
        donor = _PATHS[empty, tried.argmax(1)]
        lost = ~tried.any(1)
        if lost.any():
            there = bucket[first]
            donor[lost] = there[np.searchsorted(there, empty[lost]) % len(there)]
        out[empty] = out[donor]
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band: its number and registers."""
    r = regs.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(ROWS):
        key = mix64(key * _MULT + r[:, j])
    return key.view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Jaccard estimates of rows of registers, corrected for collisions of registers that only look equal."""
    share = (a == b).mean(1)
    ratio = na / np.maximum(nb, 1)
    chance = 0.16992 * 2.0**-MANTISSA * 4 * ratio / (1 + ratio) ** 2
    return (share - chance) / (1 - chance)


def sketched(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n_shingles, digest, regs): digest is 128 bits of the set; both are null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = HashedWords(1)
        for batch in batches:
            n, digest, regs = [], [], []
            for text in octets(batch.column(1)):
                s = shingles(text, k, hashed)
                n.append(len(s))
                digest.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                regs.append(registers(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(regs, pa.binary())], ["doc_id", "n_shingles", "digest", "regs"])

    return docs.select("doc_id", "text").mapInArrow(released(run), "doc_id long, n_shingles long, digest binary, regs binary")


def banded(classes: DataFrame) -> DataFrame:
    """(band, id) of every class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = np.concatenate([band_keys(np.frombuffer(r, np.uint16)) for r in batch.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(batch.column(0).to_numpy(), BANDS))], ["band", "id"])

    return classes.select("id", "regs").mapInArrow(released(run), "band long, id long")


def likely(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """(a, b, share): those of pairs (a, b) whose registers allow a similarity of `least` within five standard deviations."""
    floor = least - 5 * (least * (1 - least) / REGISTERS) ** 0.5
    left = classes.select(F.col("id").alias("a"), F.col("regs").alias("ra"), F.col("n").alias("na"))
    right = classes.select(F.col("id").alias("b"), F.col("regs").alias("rb"), F.col("n").alias("nb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ra, rb = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, REGISTERS) for i in (2, 3))
                na, nb = (batch.column(i).to_numpy() for i in (4, 5))
                sizes = np.minimum(na, nb) >= (least - 1e-9) * np.maximum(na, nb)
                share = estimate(ra, rb, na, nb)
                keep = sizes & (share >= floor)
                yield pa.RecordBatch.from_arrays([*(pa.array(batch.column(i).to_numpy()[keep]) for i in (0, 1)), pa.array(share[keep])], ["a", "b", "share"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "ra", "rb", "na", "nb").mapInArrow(released(run), "a long, b long, share double")


def verified(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of pairs (a, b) with 100 * intersection >= percent * union on their full sets; again for other texts that have their ids."""
    texts = docs.select("doc_id", "text").where("doc_id IS NOT NULL")
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = HashedWords(1)
        last_id, last = None, None
        for batch in batches:
            keep = []
            ids = batch.column(1).to_pylist()
            for b, ta, tb in zip(ids, octets(batch.column(2)), octets(batch.column(3)), strict=True):
                if last_id != (b, tb):
                    last_id, last = (b, tb), shingles(tb, k, hashed)
                s = shingles(ta, k, hashed)
                both = np.intersect1d(s, last, assume_unique=True).size
                keep.append(both > 0 and 100 * both >= percent * (len(s) + len(last) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(mask) for i in (0, 1)], ["a", "b"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(released(run), "a long, b long")


def mixed_members(shared: DataFrame, by: DataFrame) -> DataFrame:
    """(band, id, c): members and components of the bands that hold more than one component."""
    named = shared.join(by, "id", "left").select("band", "id", F.coalesce("component", "id").alias("c"))
    mixed = named.groupBy("band").agg(F.min("c").alias("least"), F.max("c").alias("most")).where("least < most").select("band")
    return named.join(mixed, "band")


def lowest(texts: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(id, low): the LOWEST least hashes of each set, 32 bits each; the whole set where it has no more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = HashedWords(1)
        for batch in batches:
            low = [np.unique((shingles(t, k, hashed) >> np.uint64(32)).astype(np.uint32))[:LOWEST].tobytes() for t in octets(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(low, pa.binary())], ["id", "low"])

    found = texts.join(ids.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi").select("doc_id", "text").mapInArrow(released(run), "id long, low binary")
    return found.groupBy("id").agg(F.min("low").alias("low"))


def _alike(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard estimate from the least hashes of two sets; exact where both are whole."""
    both = np.intersect1d(a, b, assume_unique=True)
    if len(a) < LOWEST and len(b) < LOWEST:
        return len(both) / (len(a) + len(b) - len(both))
    top = min(x[-1] for x in (a, b) if len(x) == LOWEST)
    n = int(np.searchsorted(a, top, "right") + np.searchsorted(b, top, "right"))
    shared = int(np.searchsorted(both, top, "right"))
    return shared / max(1, n - shared)


def _hopeful(band: int, low_block: int, high_block: int, ids: np.ndarray, comps: np.ndarray, blocks: np.ndarray, sizes: np.ndarray, regs: np.ndarray, low: list[bytes], least: float) -> list[tuple[int, int]]:
    """Pairs of one pair of blocks of one band: different components, no earlier common band, alike by registers and by least hashes."""
    out: list[tuple[int, int]] = []
    if (comps == comps[0]).all():
        return out
    number = int(np.argmax(band_keys(regs[0]) == band))
    rows, cols = np.flatnonzero(blocks == low_block), np.flatnonzero(blocks == high_block)
    floor = least - 5 * (least * (1 - least) / REGISTERS) ** 0.5
    for i in rows:
        j = cols[(comps[cols] != comps[i]) & ((ids[cols] > ids[i]) if low_block == high_block else True)]
        j = j[np.minimum(sizes[j], sizes[i]) >= (least - 1e-9) * np.maximum(sizes[j], sizes[i])]
        if not len(j):
            continue
        same = regs[j] == regs[i]
        j, same = j[same.mean(1) >= floor], same[same.mean(1) >= floor]
        j = j[~same[:, : number * ROWS].reshape(len(j), number, ROWS).all(2).any(1)] if number else j
        a = np.frombuffer(low[i], np.uint32) if len(j) else None
        for x in j:
            b = np.frombuffer(low[x], np.uint32)
            whole = len(a) < LOWEST and len(b) < LOWEST
            if _alike(a, b) >= (least - 0.005 if whole else least - 5 * (least * (1 - least) / LOWEST) ** 0.5):
                out.append((min(int(ids[i]), int(ids[x])), max(int(ids[i]), int(ids[x]))))
    return out


def _by_blocks(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """_hopeful of every pair of blocks, in rows (band, from, to, id, c, block, n, regs, low) sorted by the first three."""

    def found(t: pa.Table, last: bool) -> tuple[list[tuple[int, int]], pa.Table]:
        keys = [t.column(i).to_numpy() for i in range(3)]
        new = np.concatenate([[0], np.flatnonzero((keys[0][1:] != keys[0][:-1]) | (keys[1][1:] != keys[1][:-1]) | (keys[2][1:] != keys[2][:-1])) + 1, [t.num_rows]])
        ends = new if last else new[:-1]
        done = int(ends[-1])
        ids, comps, blocks, sizes = (t.column(i).to_numpy()[:done] for i in range(3, 7))
        regs = np.frombuffer(b"".join(t.column(7).slice(0, done).to_pylist()), np.uint16).reshape(done, REGISTERS)
        low, out = t.column(8).slice(0, done).to_pylist(), []
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            if b - a > 1:
                out += _hopeful(int(keys[0][a]), int(keys[1][a]), int(keys[2][a]), ids[a:b], comps[a:b], blocks[a:b], sizes[a:b], regs[a:b], low[a:b], least)
        return out, t.slice(done)

    held = None
    for batch in batches:
        for i in range(0, batch.num_rows, 4 * BLOCK):
            part = pa.Table.from_batches([batch.slice(i, 4 * BLOCK)])
            pairs, held = found(pa.concat_tables([held, part]) if held is not None else part, False)
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*pairs, strict=True)], ["a", "b"])
    if held is not None and held.num_rows:
        pairs, _ = found(held, True)
        if pairs:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*pairs, strict=True)], ["a", "b"])


def across(members: DataFrame, classes: DataFrame, low: DataFrame, least: float) -> DataFrame:
    """(a, b) across components that the sketches leave possible. A band's members are compared in blocks inside the tasks; only these pairs leave them.

    The band's largest component needs no comparison with itself, so its members meet the others' blocks alone: with s others among m members, a
    band makes about m * s / BLOCK rows besides one for each member, not m * m / BLOCK. A band of one block is compared as it is.
    """
    sizes = members.groupBy("band", "c").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.groupBy("band").agg(F.max_by("c", F.struct("n", "c")).alias("major"), F.max("n").alias("most"), F.sum("n").alias("all"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    small = F.col("all") <= BLOCK
    bands = largest.select("band", "major", F.when(small, 1).otherwise(blocks(F.col("all") - F.col("most"))).alias("minors"), F.when(small, 0).otherwise(blocks(F.col("most"))).alias("majors"))
    m = members.join(bands, "band").withColumn("is_major", (F.col("c") == F.col("major")) & (F.col("majors") > 0))
    at = F.when(F.col("is_major"), F.col("minors") + F.pmod(F.xxhash64("id", "band"), F.col("majors"))).otherwise(F.pmod(F.xxhash64("id", "band"), F.col("minors"))).cast("int")
    meets = F.when(F.col("is_major"), F.sequence(F.lit(0), F.col("minors") - 1)).otherwise(F.sequence(F.lit(0), F.col("minors") + F.col("majors") - 1))
    m = m.withColumn("block", at).withColumn("with", F.explode(meets))
    m = m.select("band", "id", "c", "block", F.least("block", "with").alias("from"), F.greatest("block", "with").alias("to"))
    full = m.join(classes.select("id", "n", "regs"), "id").join(low, "id")
    keys = ["band", "from", "to"]
    dealt = full.select(*keys, "id", "c", "block", "n", "regs", "low").repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(lambda batches: _by_blocks(batches, least), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs."""
    sketches = staged(sketched(docs, k), "sketches")
    classes = staged(sketches.where("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("id"), F.min("regs").alias("regs"), F.max("n_shingles").alias("n")), "classes")
    bands = banded(classes)
    firsts = bands.groupBy("band").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most")
    shared = staged(bands.join(firsts.select("band", "least"), "band"), "shared")
    texts = staged(docs.select("doc_id", "text").join(shared.select(F.col("id").alias("doc_id")).distinct().hint("merge"), "doc_id", "left_semi"), "texts")
    # each class against the one with which it shares most bands as their least member
    starts = shared.where("id <> least").groupBy("id", "least").agg(F.count(F.lit(1)).alias("n"))
    starts = starts.groupBy("id").agg(F.max(F.struct(F.col("n"), (-F.col("least")).alias("b"))).alias("m")).select(F.col("id").alias("a"), (-F.col("m.b")).alias("b"))
    tested = staged(starts, "tested")
    by = merged(staged(verified(likely(tested, classes, percent / 100), texts, k, percent), "links"))
    # bands of one component stay so: each round reads only what the one before it left
    open_ = staged(mixed_members(shared, by), "open")
    dropped(shared)
    # rounds: members of a band against one of its members, drawn anew, where their components differ
    for turn in range(ROUNDS):
        drawn = open_.groupBy("band").agg(F.min_by(F.struct(F.col("id").alias("b"), F.col("c").alias("cb")), F.xxhash64("id", F.lit(turn))).alias("d"))
        pairs = open_.join(drawn, "band").where("c <> d.cb").select(F.col("id").alias("a"), F.col("d.b").alias("b")).distinct()
        ends = [F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")]
        pairs = pairs.select("a", "b", *ends).join(tested.select(*ends), ["low", "high"], "left_anti").select("a", "b")
        hopes = likely(pairs, classes, percent / 100).groupBy("a").agg(F.max(F.struct("share", "b")).alias("m")).select("a", F.col("m.b").alias("b"))
        hopes = staged(hopes, "tested")
        if not hopes.limit(1).count():
            break
        by = merged(staged(verified(hopes, texts, k, percent), "links"), by)
        tested, last = tested.unionByName(hopes), open_
        open_ = staged(mixed_members(last.select("band", "id"), by), "open")
        dropped(last)
    # what is left is compared whole: members of one band in different components
    hopes = staged(across(open_, classes, lowest(texts, open_.select("id").distinct(), k), percent / 100), "tested")
    by = merged(staged(verified(hopes, texts, k, percent), "links"), by)
    dropped(open_, texts)
    of_class = classes.select("digest", F.col("id").alias("_id")).join(by, F.col("_id") == by.id, "left").select("digest", F.coalesce("component", "_id").alias("component_id"))
    out = sketches.drop("regs").join(of_class, "digest", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def deduplicated(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs without the documents that a component keeps another one for; of rows with one doc_id that are kept, all stay."""
    kept = near_duplicates(docs, k, percent).where("kept").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").select(docs.columns).unionByName(docs.where("doc_id IS NULL"))
