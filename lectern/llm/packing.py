"""Harmonic packing of tokenised documents into sequences of fixed capacity.

Each document's ids (and the end id) are cut into pieces: whole sequences first, then halves of the capacity down
to `min_cut`, then a tail shorter than `min_cut`. A piece of n ids belongs to the class k = capacity // n, and a bin
of class k takes exactly k pieces of that class, so bins are filled by counting alone, and every worker fills its own.
Halved pieces fill their bins to the last id; only tails leave padding, less than 1/(k+1) of a bin with k >= capacity // min_cut.
Tails under capacity / MOST share the class MOST. What does not make up a whole bin, under k pieces of each class of a
worker, goes first-fit into that worker's last bins.

Nulls and edge cases: a null text is empty; an empty text is its end id alone; repeated rows are packed each; an
empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import itertools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import released, staged

#: Pieces of a bin, at most.
MOST = 128
#: Pieces that one worker's share of a class is to hold, about.
SHARE = 1 << 18
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def cuts(n: int, capacity: int, min_cut: int) -> list[int]:
    """Lengths of the pieces of a document of n ids."""
    out = [capacity] * (n // capacity)
    n %= capacity
    half = capacity // 2
    while half >= min_cut and n:
        if n >= half:
            out.append(half)
            n -= half
        half //= 2
    return [*out, n] if n else out


#: Punctuation that, at the end of a word behind a letter or digit, is a token run of its own for a word-wise tokenizer.
_TAIL = ".,;:!?*$%&#\")("
#: Bytes of text that are encoded together, or one text; bytes that a cache of words and ids holds, about, beyond what one such stretch adds.
CHUNK, CACHE = 4 << 20, 80 << 20
#: What a word-wise tokenizer does before its model: it makes white space one space, lower-cases, and splits runs of letters, single digits and
#: runs of other signs, so no id depends on what lies beyond white space.
_WORD_RUNS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def word_wise(config: dict) -> bool:
    """True if the tokenizer's ids of a text are those of its words between white space, one after another, and case doesn't matter."""
    steps = lambda part, key: (part.get(key, []) if part.get("type") == "Sequence" else [part]) if part else []
    normal = [(x["type"], (x.get("pattern") or {}).get("Regex"), x.get("content")) for x in steps(config.get("normalizer"), "normalizers")]
    split = steps(config.get("pre_tokenizer"), "pretokenizers")
    added = config.get("added_tokens", [])
    return (
        set(normal) <= {("NFC", None, None), ("Replace", r"\s+", " "), ("Lowercase", None, None)}
        and normal[-1:] == [("Lowercase", None, None)]
        and [x["type"] for x in split] == ["Split", "ByteLevel"]
        and split[0]["pattern"] == {"Regex": _WORD_RUNS} and split[0]["invert"] and split[0]["behavior"] == "Removed"
        and not split[1]["use_regex"] and not split[1]["add_prefix_space"]
        and not any(a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"] or any(c.isspace() for c in a["content"]) for a in added)
    )


class _Grown:
    """An array that grows at its end."""

    def __init__(self, kind: type, n: int):
        self.held, self.n = np.zeros(1 << 16, kind), n

    def add(self, more: np.ndarray) -> None:
        need = self.n + len(more)
        if need > len(self.held):
            self.held = np.concatenate([self.held, np.zeros(max(need, 2 * len(self.held)) - len(self.held), self.held.dtype)])
        self.held[self.n : need] = more
        self.n = need

    def all(self) -> np.ndarray:
        return self.held[: self.n]


#: A letter or digit at the end that stays one when it is composed and lower-cased (U+0130 doesn't), so that what follows starts a new run.
_ENDS_ALONE = "[0-9A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]$"

#: Words that are lower-cased at once: ASCII, or letters of Latin-1, which composing leaves as they are. Words of such letters in lower case alone.
_CASED = "^(?:[\x00-\x7f]+|[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+[.,;:!?]*)$"
_LETTERS = "^[a-z\u00df-\u00f6\u00f8-\u00ff]{1,64}$"


def _byte_signs() -> dict[int, str]:
    """How byte-level models write a byte: printable ones of Latin-1 as themselves, the others as the signs from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(others)}


class WordIds:
    """The ids of words, kept one after another; the cache is emptied when it holds CACHE bytes. Slot 0 has no ids.

    Words without marks are lower-cased where they are ASCII or all letters, and kept apart from the punctuation at their end. Words of Latin letters
    alone go to the tokenizer's model at once, as what comes before it leaves them whole.
    """

    def __init__(self, tok, marks: list[str]):
        self.tok, self.marks, self.signs = tok, marks, _byte_signs()
        self._empty()

    def _empty(self) -> None:
        self.slot: dict[str, int] = {"": 0}
        self.ends, self.ids, self.held = _Grown(np.int32, 2), _Grown(np.uint32, 0), 0

    def _lists(self) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(self.ends.all()), pa.array(self.ids.all()))

    def _slots(self, words: pa.Array) -> np.ndarray:
        """The slots of words that are encoded as they stand."""
        coded = words.dictionary_encode()
        keys = coded.dictionary.to_pylist()
        new = [w for w in keys if w not in self.slot]
        if new:
            letters = np.asarray(pc.match_substring_regex(pa.array(new, pa.large_string()), _LETTERS)).tolist()
            model, signs, rest = self.tok.model.tokenize, self.signs, [w for w, x in zip(new, letters, strict=True) if not x]
            others = iter(self.tok.encode_batch_fast(rest, add_special_tokens=False))
            got = [[t.id for t in model(w if w.isascii() else w.encode().decode("latin-1").translate(signs))] if x else next(others).ids for w, x in zip(new, letters, strict=True)]
            count, base = np.fromiter(map(len, got), np.int64, len(got)), self.ends.n - 1
            self.ends.add(self.ids.n + np.cumsum(count))
            self.ids.add(np.fromiter(itertools.chain.from_iterable(got), np.uint32, int(count.sum())))
            self.slot.update(zip(new, range(base, base + len(new)), strict=True))
            self.held += 4 * int(count.sum()) + sum(map(len, new)) + 200 * len(new)
        return np.fromiter(map(self.slot.__getitem__, keys), np.int32, len(keys))[np.asarray(coded.indices)]

    def __call__(self, raw: pa.Array, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of raw[at[0]], raw[at[1]], ... and the count of each."""
        if self.held >= CACHE:
            self._empty()
        low = pc.if_else(pc.match_substring_regex(raw, _CASED), pc.utf8_lower(raw), raw)
        core = pc.utf8_rtrim(low, characters=_TAIL)
        core = pc.if_else(pc.match_substring_regex(core, _ENDS_ALONE), core, low)
        for m in self.marks:
            marked = pc.match_substring(raw, m, ignore_case=True)
            if pc.any(marked).as_py():
                core, low = pc.if_else(marked, raw, core), pc.if_else(marked, raw, low)
        slots, tails = self._slots(core), np.asarray(pc.subtract(pc.binary_length(low), pc.binary_length(core)))
        both = np.zeros((len(raw), 2), np.int32)
        both[:, 0] = slots
        if len(with_tail := np.flatnonzero(tails)):
            ends = zip(low.take(pa.array(with_tail)).to_pylist(), tails[with_tail].tolist(), strict=True)
            both[with_tail, 1] = self._slots(pa.array([w[-n:] for w, n in ends], pa.large_string()))
        whole = self._lists().take(pa.array(both.ravel()))
        words = pa.ListArray.from_arrays(whole.offsets.take(pa.array(np.arange(0, 2 * len(raw) + 1, 2))), whole.flatten())
        out = words.take(pa.array(at))
        return np.asarray(out.flatten()), np.diff(np.asarray(out.offsets))


def encoder(path: str):
    """texts (a string array) -> (all ids, each text's count). Its cache lives as long as the task that makes it."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    config = json.loads(tok.to_str())
    if not word_wise(config):

        def whole(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
            got = [e.ids for e in tok.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return np.fromiter(itertools.chain.from_iterable(got), np.uint32), np.fromiter(map(len, got), np.int64, len(got))

        return whole
    words = WordIds(tok, list({x for a in config["added_tokens"] for x in (a["content"], a["content"].lower())}))

    def by_word(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        ids, count = words(coded.dictionary, np.asarray(coded.indices))
        ends = np.asarray(split.offsets)
        return ids, np.diff(np.concatenate([[0], np.cumsum(count)])[ends - ends[0]])

    return by_word


def _chunks(sizes: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of rows with at most CHUNK bytes, or of one row."""
    out, begin, total = [], 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > begin and total + n > CHUNK:
            out.append((begin, i))
            begin, total = i, 0
        total += n
    return [*out, (begin, len(sizes))] if len(sizes) else out


def pieces(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2, capacity: int = 4096, min_cut: int = 256) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens. A tokenizer that isn't word-wise is given whole texts."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoded = encoder(path)
        for batch in batches:
            texts = pc.fill_null(batch.column(1).cast(pa.large_string()), "")
            docs_ = batch.column(0).to_pylist()
            for begin, end in _chunks(np.asarray(pc.binary_length(texts))):
                out: list[tuple] = []
                ids, counts = encoded(texts.slice(begin, end - begin))
                low = 0
                for doc, n in zip(docs_[begin:end], counts.tolist(), strict=True):
                    b = np.append(ids[low : low + n], np.uint32(end_id)).astype("<u4").tobytes()
                    low += n
                    at = 0
                    for m in cuts(n + 1, capacity, min_cut):
                        out.append((doc, at, m, zlib.crc32(b[4 * at : 4 * (at + m)]), n + 1))
                        at += m
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select("doc_id", "text").mapInArrow(released(run), _PIECES)


def _last_bins(pdf: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """First fit, longest first, of the few pieces that a worker has left."""
    pdf = pdf.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True])
    room = np.zeros(len(pdf), np.int64) + capacity
    bins, offsets = [], []
    for n in pdf["length"]:
        j = int(np.argmax(room >= n))
        bins.append(j)
        offsets.append(capacity - int(room[j]))
        room[j] -= n
    pdf["sequence_id"] = (np.asarray(pdf["_worker"], np.int64) << 40) | np.asarray(bins, np.int64)
    pdf["offset"] = offsets
    return pdf.drop(columns="_worker")


def packed(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2, capacity: int = 4096, min_cut: int = 256) -> DataFrame:
    """pieces() with sequence_id and offset."""
    cut = staged(pieces(docs, tokenizer, end_id, capacity, min_cut), "pieces")
    workers = max(1, cut.count() // SHARE)
    k = F.least(F.lit(MOST), F.expr(f"{capacity} div length")).cast("long")
    by = cut.withColumn("_class", k).withColumn("_worker", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(workers)))
    order = [F.col("doc_id"), F.col("start"), F.col("ids_crc32"), F.col("length")]
    share = Window.partitionBy("_worker", "_class")
    by = by.withColumn("_i", F.row_number().over(share.orderBy(*order)) - 1).withColumn("_n", F.count(F.lit(1)).over(share)).withColumn("_bin", F.expr("_i div _class"))
    inside = Window.partitionBy("_worker", "_class", "_bin").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    full = by.where("(_bin + 1) * _class <= _n").select(*columns, (F.expr("(_worker << 40) | (_class << 32)") + F.col("_bin")).cast("long").alias("sequence_id"), F.coalesce(F.sum("length").over(inside), F.lit(0)).cast("long").alias("offset"))
    rest = by.where("(_bin + 1) * _class > _n").select("_worker", *columns)
    return full.unionByName(rest.groupBy("_worker").applyInPandas(lambda pdf: _last_bins(pdf, capacity), f"{_PIECES}, sequence_id long, offset long"))
