"""Removal of byte strings that occur earlier, by sorting strings at the positions of a difference cover.

A classical difference cover modulo 3 sorts two thirds of all suffixes again at every level. Only one question is asked of the
order here, which suffixes share their first `LENGTH` bytes, so the cover is chosen by content instead (a synchronising
set): of every `LENGTH` bytes, the place of the least 16-byte hash. Equal strings choose equal places at the same shift,
which is what a difference cover is for, and one place in about 43 is sampled instead of two in three.

1. Sample: each place stands for the run of strings that choose it. Its name is (hash of its 16 bytes, hash of the bytes of
   all these strings).
2. Sort by name. Equal names: the earliest place stays, the strings of the others occur earlier. A place whose
   16 bytes are unique is done; so is one whose neighbours in the order all bear its own name.
3. Recurse: the other places, once for each name, are sent on with their bytes, cut into their single strings, sorted and
   compared with their neighbours, by 128-bit hashes.
4. Merge: what is found is united by document.

Names that one batch of texts holds often are reduced to the earliest before the shuffle; places with many names (the
edges of a passage that very many documents quote) are dealt out string by string, so no task gathers them.

Nulls and edge cases: a null text is empty; texts shorter than LENGTH lose nothing. Rows equal in doc_id and text are one document and get the same
result, so they don't remove one another; rows with one doc_id and different texts are documents of their own, in the order of a hash of their texts;
rows without doc_id stand behind all others, in that order, too. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed, mix64, octets, staged

LENGTH, GRAM = 100, 16
SPAN = LENGTH - GRAM + 1
#: Bytes that are hashed at once (a power of two); places that are named together; names of one place above which it is dealt out.
CHUNK, FLUSH, HOT = 1 << 18, 150_000, 16
#: Bytes of text for each part that places are dealt to.
PART = 32 << 20
#: Places whose bytes are sent on together; places that are cut into strings together.
SHIPPED, SLICE = 20_000, 4_000
_C = mix64(np.arange(1, 65, dtype=np.uint64) << np.uint64(7)) | np.uint64(1)
_POS = np.uint64(CHUNK - 1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    step = np.uint64(base)
    while len(out) < n:
        out = np.concatenate([out, out * step])
        step = step * step
    return out[:n]


_BASE = int(_C[60])
with np.errstate(over="ignore"):
    _UP, _DOWN = _powers(_BASE, CHUNK + 1), _powers(pow(_BASE, -1, 1 << 64), CHUNK + 1)


def words8(raw: bytes) -> np.ndarray:
    """The mixed 8-byte word at every byte."""
    return mix64(np.array(np.ndarray((len(raw),), "<u8", raw + b"\0" * 8, strides=(1,))))


def strings(x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit hashes of the LENGTH-byte strings that start at `at`."""
    shifts = [*range(0, LENGTH - 7, 8), LENGTH - 8]
    one, two = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
    for j, shift in enumerate(shifts):
        w = x[at + shift]
        one += w * _C[j]
        two += w * _C[20 + j]
    return mix64(one), mix64(two)


def sampled(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """place, first string, last string, 16-byte hash and name of every chosen place of the texts [start, end) in raw (CHUNK bytes at most)."""
    n = len(raw)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    x = words8(raw)
    m = n - GRAM + 1
    g = mix64(x[:m] * _C[50] + x[8 : 8 + m])
    least = (g & ~_POS) | np.arange(m, dtype=np.uint64)
    size = 1
    while size * 2 <= SPAN:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    least = np.minimum(least[: m - SPAN + 1], least[SPAN - size :])
    place = (least & _POS).astype(np.int64)  # by string start, 0 .. n - LENGTH
    edge = np.zeros(n + 1, np.int32)
    whole = ends - starts >= LENGTH
    np.add.at(edge, starts[whole], 1)
    np.add.at(edge, ends[whole] - LENGTH + 1, -1)
    valid = np.cumsum(edge[: len(place)]) > 0
    here = np.flatnonzero(valid)
    if not len(here):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    p = place[here]
    new = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (here[1:] != here[:-1] + 1)]))
    first, last, p = here[new], here[np.append(new[1:], len(here)) - 1], p[new]
    total = np.concatenate([[np.uint64(0)], np.cumsum(x * _UP[:n])])
    name = (total[last + LENGTH - 7] - total[first]) * _DOWN[first]
    # least hashes are small numbers: mixed again, they spread over all parts
    return p, first, last, mix64(g[p] ^ _C[52]), mix64(name ^ ((p - first).astype(np.uint64) * _C[51]))


def chunks(docs: list[int], texts: list[bytes]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts joined to at most CHUNK bytes: raw, starts, ends, doc and the place of the start in its text. Longer texts are cut with an overlap that no string misses."""
    parts, at = [], 0
    step = CHUNK - LENGTH + 1
    for doc, text in zip(docs, texts, strict=True):
        for begin in range(0, max(1, len(text) - LENGTH + 1), step):
            part = text[begin : begin + CHUNK] if len(text) > CHUNK else text
            if at + len(part) > CHUNK:
                yield _joined(parts)
                parts, at = [], 0
            parts.append((part, doc, begin))
            at += len(part)
    if parts:
        yield _joined(parts)


def _joined(parts: list[tuple[bytes, int, int]]) -> tuple:
    ends = np.cumsum([len(p) for p, _, _ in parts])
    return b"".join(p for p, _, _ in parts), ends - [len(p) for p, _, _ in parts], ends, np.array([d for _, d, _ in parts], np.int64), np.array([b for _, _, b in parts], np.int64)


def _groups(*keys: np.ndarray) -> np.ndarray:
    """True where sorted keys begin a new group."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def _ranges(key: np.ndarray) -> list[tuple[int, int]]:
    """The [start, end) of every group of a sorted key."""
    at = np.flatnonzero(_groups(key)).tolist()
    return list(zip(at, [*at[1:], len(key)], strict=True)) if at else []


#: part: where the row is dealt; kind: 0 places, 1 places of a dealt-out group, 2 spans already found.
_PLACES = pa.schema([("part", pa.int32()), ("kind", pa.int8()), ("gram", pa.binary()), ("name", pa.binary()), ("doc", pa.binary()), ("pos", pa.binary()), ("near", pa.binary())])
_HOME = pa.schema([("part", pa.int32()), ("kind", pa.int8()), ("doc", pa.binary()), ("what", pa.binary())])
_FOUND = pa.schema([("doc_id", pa.int64()), ("gone", pa.binary()), ("asks", pa.binary())])
_ASK = np.dtype([("pos", "<u4"), ("before", "u1"), ("after", "u1"), ("hot", "u1"), ("gram", "<u8")])
_SPANS = np.dtype([("start", "<u4"), ("end", "<u4")])


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Fewer rows at a time: what Python makes of a batch takes several times its bytes."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)


def _dealt(part: np.ndarray, kind: int, *cols: np.ndarray) -> list[tuple]:
    order = np.argsort(part, kind="stable")
    part, cols = part[order], [c[order] for c in cols]
    return [(int(part[i]), kind, *(c[i:j].tobytes() for c in cols)) for i, j in _ranges(part)]


def places(docs: DataFrame, parts: int) -> DataFrame:
    """The sampled places, in rows of many, dealt by the hash of their 16 bytes."""

    def named(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        gram, name, doc, pos, near = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.lexsort((pos, doc, name, gram))
        gram, name, doc, pos, near = (c[order] for c in (gram, name, doc, pos, near))
        first = _groups(gram, name)
        which = np.cumsum(first) - 1
        lead = np.flatnonzero(first)[which]
        later = (doc > doc[lead]) | (pos > pos[lead])  # sorted: never before their leader
        kept = ~later & (first | ((doc == doc[lead]) & (pos == pos[lead])))
        new_gram = _groups(gram)
        names = np.add.reduceat(first, np.flatnonzero(new_gram))[np.cumsum(new_gram) - 1]
        hot = kept & (names > HOT)
        to = ((gram >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)
        spread = (mix64(doc.view(np.uint64) + pos) % np.uint64(parts)).astype(np.int32)
        marks = hot & new_gram  # one of a dealt-out group tells the others
        rows = []
        for pick, kind, part in ((kept & ~hot, 0, to), (marks, 3, to), (hot, 1, spread), (later, 2, spread)):
            if pick.any():
                rows += _dealt(part[pick], kind, gram[pick], name[pick], doc[pick], pos[pick], near[pick])
        return _batch(rows, _PLACES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in _slices(batches):
            ids = batch.column(0).to_pylist()
            for raw, starts, ends, doc, begin in chunks(ids, [t or b"" for t in octets(batch.column(1))]):
                p, first, last, gram, name = sampled(raw, starts, ends)
                if len(p):
                    of = np.searchsorted(ends, first, side="right")
                    near = np.stack([p - first, p - last], 1).astype(np.uint8).view(np.uint16).ravel()
                    held.append((gram, name, doc[of], (p - starts[of] + begin[of]).astype(np.uint32), near))
                    n += len(p)
                if n >= FLUSH:
                    yield named(held)
                    held, n = [], 0
        if held:
            yield named(held)

    return docs.select("doc_id", "text").mapInArrow(run, "part int, kind byte, gram binary, name binary, doc binary, pos binary, near binary")


def _by_document(doc: np.ndarray, spans: np.ndarray, asked: np.ndarray, asks: np.ndarray) -> pa.RecordBatch:
    """A row for each document with its spans and asks."""
    rows: dict[int, list[bytes]] = {}
    for slot, (d, what) in enumerate(((doc, spans), (asked, asks))):
        order = np.argsort(d, kind="stable")
        d, what = d[order], what[order]
        for i, j in _ranges(d):
            rows.setdefault(int(d[i]), [b"", b""])[slot] = what[i:j].tobytes()
    return _batch([(d, *v) for d, v in rows.items()], _FOUND)


def _sent_home(parts: int, doc: np.ndarray, spans: np.ndarray, asked: np.ndarray, asks: np.ndarray) -> pa.RecordBatch:
    """Spans (kind 0) and asks (kind 1) in rows of many, dealt by document: a part of places gives `parts` rows of each at most, however many documents it has."""
    home = lambda d: (mix64(d.view(np.uint64)) % np.uint64(parts)).astype(np.int32)
    return _batch(_dealt(home(doc), 0, doc, spans) + _dealt(home(asked), 1, asked, asks), _HOME)


def at_home(dealt: DataFrame, parts: int) -> DataFrame:
    """(doc_id, gone, asks): a row for each document of what was dealt by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[list[bytes]]] = {0: [[], []], 1: [[], []]}
        for batch in batches:
            for _, kind, doc, what in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                held[kind][0].append(doc)
                held[kind][1].append(what)
        if held[0][0] or held[1][0]:
            read = lambda kind, i, t: np.frombuffer(b"".join(held[kind][i]), t)
            yield _by_document(read(0, 0, "<i8"), read(0, 1, _SPANS), read(1, 0, "<i8"), read(1, 1, _ASK))

    return dealt.repartition(parts, "part").mapInArrow(run, "doc_id long, gone binary, asks binary")


def _spans(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = np.empty(len(start), _SPANS)
    out["start"], out["end"] = start, end
    return out


def _joined_spans(doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans of the LENGTH-byte strings at (doc, start), those that touch joined."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order].astype(np.int64)
    if not len(doc):
        return doc, _spans(start, start)
    at = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + LENGTH)]))
    return doc[at], _spans(start[at], start[np.append(at[1:], len(start)) - 1] + LENGTH)


def _arrays(batches: Iterator[pa.RecordBatch], types: list[str]) -> dict[int, list[np.ndarray]]:
    """Columns of rows of many, by kind."""
    held: dict[int, list[list[bytes]]] = {}
    for batch in batches:
        cols = [c.to_pylist() for c in batch.columns]
        for kind, *blobs in zip(*cols[1:], strict=True):
            held.setdefault(kind, []).append(blobs)
    return {k: [np.frombuffer(b"".join(b), t) for b, t in zip(zip(*rows, strict=True), types, strict=True)] for k, rows in held.items()}


def named_once(dealt: DataFrame, parts: int) -> DataFrame:
    """(doc_id, gone, asks): the spans of places that repeat an earlier name, and the places to compare string by string. A row for each document."""
    types = ["<u8", "<u8", "<i8", "<u4", "<u2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _arrays(batches, types)
        none = [np.zeros(0, t) for t in types]
        gram, name, doc, pos, near = (np.concatenate([a, b]) for a, b in zip(got.get(0, none), got.get(3, none), strict=True))
        mark = np.arange(len(gram)) >= len(got.get(0, none)[0])
        order = np.lexsort((pos, doc, name, gram))
        gram, name, doc, pos, near, mark = (c[order] for c in (gram, name, doc, pos, near, mark))
        first = _groups(gram, name)
        lead = np.flatnonzero(first)[np.cumsum(first) - 1] if len(gram) else np.zeros(0, np.int64)
        later = (doc > doc[lead]) | (pos > pos[lead])
        new_gram = _groups(gram)
        at, of = np.flatnonzero(new_gram), np.cumsum(new_gram) - 1
        names = np.add.reduceat(first.astype(np.int64), at)[of] if len(gram) else np.zeros(0, np.int64)
        hot = np.maximum.reduceat(mark, at)[of] if len(gram) else np.zeros(0, bool)
        # a marked place is also dealt out with its group, where it is compared
        gone, ask = later & ~mark, ~later & ~mark & ((names > 1) | hot)
        g2, _, d2, p2, n2 = got.get(2, none)
        g1, _, d1, p1, n1 = got.get(1, none)
        gd, gp, gn = (np.concatenate(c) for c in ((doc[gone], d2), (pos[gone], p2), (near[gone], n2)))
        ad, ap, an, ag = (np.concatenate(c) for c in ((doc[ask], d1), (pos[ask], p1), (near[ask], n1), (gram[ask], g1)))
        before, after = gn & 255, gn >> 8
        asks = np.empty(len(ad), _ASK)
        asks["pos"], asks["before"], asks["after"], asks["gram"], asks["hot"] = ap, an & 255, an >> 8, ag, np.concatenate([hot[ask], np.ones(len(d1), bool)])
        yield _sent_home(parts, gd, _spans(gp - before, gp - after + np.uint32(LENGTH)), ad, asks)

    return at_home(dealt.mapInArrow(run, "part int, kind byte, doc binary, what binary"), parts)


def compared(asking: DataFrame, parts: int) -> DataFrame:
    """(doc_id, gone, asks = none) from (doc_id, text, asks): strings of the places that occur earlier."""
    types = ["<u8", "S1", "<i8", "<u4", "<u2"]

    def sent_on(cold: list[tuple], warm: list[tuple]) -> pa.RecordBatch:
        rows: list[tuple] = []
        if cold:
            gram, raw, doc, pos, near = zip(*cold, strict=True)
            gram = np.array(gram, np.uint64)
            to = ((gram >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            for i, j in _ranges(to[order]):
                pick = order[i:j]
                rows.append((int(to[pick[0]]), 0, gram[pick].tobytes(), b"".join(raw[q] for q in pick), np.array([doc[q] for q in pick], np.int64).tobytes(), np.array([pos[q] for q in pick], np.uint32).tobytes(), np.array([near[q] for q in pick], np.uint16).tobytes()))
        if warm:
            one, two, doc, start = (np.concatenate(c) for c in zip(*warm, strict=True))
            order = np.lexsort((start, doc, two, one))
            one, two, doc, start = (c[order] for c in (one, two, doc, start))
            lead = np.flatnonzero(first := _groups(one, two))[np.cumsum(first) - 1]
            later = (doc > doc[lead]) | (start > start[lead])
            to = ((one >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)
            spread = (mix64(doc.view(np.uint64)) % np.uint64(parts)).astype(np.int32)
            for pick, kind, part in ((~later, 1, to), (later, 2, spread)):
                if pick.any():
                    rows += _dealt(part[pick], kind, one[pick], two[pick], doc[pick], start[pick], np.zeros(pick.sum(), np.uint16))
        return _batch(rows, _PLACES)

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cold: list[tuple] = []
        warm: list[tuple] = []
        strings_ = 0
        for batch in _slices(batches):
            for doc, text, blobs in zip(batch.column(0).to_pylist(), octets(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                text = text or b""
                asks = np.frombuffer(b"".join(blobs), _ASK)
                asks = asks[(asks["pos"].astype(np.int64) - asks["after"] + LENGTH) <= len(text)]
                for gram, p, before, after, hot in zip(*(asks[c].tolist() for c in ("gram", "pos", "before", "after", "hot")), strict=True):
                    part = text[p - before : p - after + LENGTH]
                    if hot:
                        n = before - after + 1
                        warm.append((*strings(words8(part), np.arange(n)), np.full(n, doc, np.int64), np.arange(p - before, p - after + 1, dtype=np.uint32)))
                        strings_ += n
                    else:
                        cold.append((gram, part, doc, p, before | after << 8))
                    if len(cold) >= SHIPPED or strings_ >= 10 * SHIPPED:
                        yield sent_on(cold, warm)
                        cold, warm, strings_ = [], [], 0
        if cold or warm:
            yield sent_on(cold, warm)

    def repeats(one: np.ndarray, two: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Document and spans of the strings that occur earlier, neighbouring strings joined."""
        order = np.lexsort((start, doc, two, one))
        one, two, doc, start = (c[order] for c in (one, two, doc, start))
        lead = np.flatnonzero(first := _groups(one, two))[np.cumsum(first) - 1]
        later = (doc > doc[lead]) | (start > start[lead])
        return _joined_spans(doc[later], start[later])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _arrays(batches, types)
        found = []
        if 0 in got:
            gram, raw, doc, pos, near = got.pop(0)
            before, after = (near & 255).astype(np.int64), (near >> 8).astype(np.int64)
            count = before - after + 1
            size = count + LENGTH - 1
            begin = np.cumsum(size) - size
            order = np.argsort(gram, kind="stable")
            slices, last = [], 0
            for i, j in _ranges(gram[order]):  # whole groups, some thousands of places at a time
                if j - last >= SLICE:
                    slices.append((last, j))
                    last = j
            for i, j in [*slices, *([(last, len(order))] if last < len(order) else [])]:
                pick = order[i:j]
                part = b"".join(raw[a : a + n].tobytes() for a, n in zip(begin[pick].tolist(), size[pick].tolist(), strict=True))
                n = count[pick]
                shift = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                one, two = strings(words8(part), np.repeat(np.cumsum(size[pick]) - size[pick], n) + shift)
                found.append(repeats(one, two, np.repeat(doc[pick], n), (np.repeat(pos[pick].astype(np.int64) - before[pick], n) + shift).astype(np.uint32)))
        if 1 in got:
            one, two, doc, start, _ = got.pop(1)
            found.append(repeats(one, np.frombuffer(two.tobytes(), "<u8"), doc, start))
        if 2 in got:
            found.append(_joined_spans(got[2][2], got[2][3]))
        if found:
            doc, spans = (np.concatenate(c) for c in zip(*found, strict=True))
            yield _by_document(doc, spans, np.zeros(0, np.int64), np.zeros(0, _ASK))

    sent = asking.mapInArrow(ship, "part int, kind byte, gram binary, name binary, doc binary, pos binary, near binary")
    return sent.repartition(parts, "part").mapInArrow(settle, "doc_id long, gone binary, asks binary")


def united(blobs: list[bytes], size: int) -> np.ndarray:
    """Maximal runs [start, end) of spans, clipped to size."""
    s = np.sort(np.frombuffer(b"".join(blobs), _SPANS), order=["start", "end"])
    start, end = s["start"].astype(np.int64), np.maximum.accumulate(np.minimum(s["end"].astype(np.int64), size)) if len(s) else np.zeros(0, np.int64)
    if not len(s):
        return np.zeros((0, 2), np.int64)
    new = np.flatnonzero(np.concatenate([[True], start[1:] > end[:-1]]))
    out = np.stack([start[new], end[np.append(new[1:], len(end)) - 1]], 1)
    return out[out[:, 0] < out[:, 1]]


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, gone) for docs (doc_id, text), no doc_id twice: lists of spans of bytes to remove, for documents that have any; united() reads them."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(8, -(-size // PART))
    once = staged(named_once(places(docs, parts).repartition(parts, "part"), parts), "named")
    asks = once.where(F.octet_length("asks") > 0).select("doc_id", F.array("asks").alias("asks"))
    more = compared(docs.join(asks.hint("merge"), "doc_id").select("doc_id", "text", "asks"), parts)
    spans = staged(once.where(F.octet_length("gone") > 0).select("doc_id", "gone").unionByName(more.select("doc_id", "gone")), "spans")
    return spans.groupBy("doc_id").agg(F.collect_list("gone").alias("gone"))


def removed(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the kept bytes' spans for every row of docs."""
    rows, places = keyed(docs.select("doc_id", "text"), "_key")
    spans = repeated_spans(places)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
        for batch in _slices(batches):
            rows = []
            for doc, text, blobs in zip(batch.column(0).to_pylist(), octets(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                text = text or b""
                runs = united(blobs or [], len(text))
                h, at = hashlib.sha256(), 0
                for s, e in runs.tolist():
                    h.update(text[at:s])
                    at = e
                h.update(text[at:])
                rows.append((doc, len(text), int((runs[:, 1] - runs[:, 0]).sum()), len(runs), h.hexdigest()))
            yield _batch(rows, schema)

    joined = rows.join(spans.withColumnRenamed("doc_id", "_key").hint("merge"), "_key", "left").select("doc_id", "text", "gone")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
