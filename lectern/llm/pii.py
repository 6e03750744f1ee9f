"""Personal data and secrets by base patterns and a skip-chain conditional random field.

Base patterns find e-mail addresses, IP numbers, payment cards and telephone numbers. A conditional random field then
labels every mention of every document, with or without a base span: the base spans, whose labels are fixed, and candidates that no pattern took: text
around an @, chains of seven digits or more, and runs of twelve or more letters and digits mixed. A mention's shape has learnt potentials; neighbours in reading
order have a weak one; distant mentions are joined through variables that each agrees with by the skip potential: one for equal entities (an
address in any case, the last ten digits, the same key) and, weaker, one for similar ones (one domain, one area code, one beginning and
length). Loopy belief propagation, linear in the mentions, gives the marginals; a candidate becomes a span of the kind that it has with probability SURE. Besides
the patterns' kinds there is `secret`: keys, tokens, passwords.

Potentials come from a multinomial regression in numpy on the mentions of all documents, counted by label and shape. Its labels are not what its
features say: a base span is known by what the features leave out (plus sign, checksum, sizes of the parts); a secret by its place, as the
value in an assignment to a password, token, key or secret, while its features are its own characters; none are runs of letters
or digits alone, and chains whose check failed. All other candidates have no label and are left to the field.

Nulls and edge cases: a null text is empty; an empty text has no spans (digest of the empty string); repeated rows are read
each, null ids too; an empty table gives an empty result; other columns are ignored. Time is linear in the text, also for long runs of one character.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: What the field tells apart: the patterns' kinds, secrets, and what is none of them.
LABELS = (*KINDS, "secret")
SECRET, O = len(KINDS), len(LABELS)  # noqa: E741
#: Skip potentials of equal and of similar mentions, chain potential, rounds and damping of message passing, probability from which a span is added.
SKIP, SIMILAR, CHAIN, ROUNDS, DAMP, SURE = 6.0, 1.0, 0.3, 12, 0.3, 0.9

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_CHAIN = re.compile(r"(?<!\w)[0-9](?:[\x20().-]{0,2}[0-9]){6,}(?!\w)")
_NUMBER = re.compile(r"[0-9][0-9().-]*")
_TOKEN = re.compile(r"(?<!\w)[A-Za-z0-9+/_-]{12,}+(?!\w)")
_ASSIGNED = re.compile(r"(?i:pass|pwd|token|key|secret)\w*[\"']?\s?[=:]\s?[\"']?$")
_STOPS = frozenset(" \t\n\r\v\f,;<>()@")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns, by kind and start."""
    out, taken, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > taken and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            taken = m.end()
            out.append((0, start, taken))
        at = text.find("@", max(at + 1, taken))
    if not _DIGIT.search(text):
        return out
    if "." in text:
        out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(q := p.lstrip("0")) <= 3 and int(q or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


@dataclass
class Mention:
    start: int
    end: int
    label: int  # fixed by a base pattern, or -1
    entity: str
    like: str
    features: tuple[int, ...]


def _features(s: str) -> tuple[int, ...]:
    """The shape of a mention; not what the labels come from (the plus sign, the checksum, the parts' sizes, the place in an assignment)."""
    digits = len(_DIGIT.findall(s))
    letters = sum(map(str.isalpha, s))
    return (
        1, int("@" in s), int("." in s), int("(" in s), int("-" in s), int(" " in s), int(s.count(".") == 3),
        int(7 <= digits <= 8), int(9 <= digits <= 12), int(13 <= digits <= 19), int(digits * 2 > len(s)),
        int(letters == 0), int(letters > 0 and digits > 0), int(_WORD.search(s) is not None),
    )


_WORD = re.compile(r"[a-z]{7}")
_LETTERS = re.compile(r"[A-Za-z]+")


def _entities(s: str) -> tuple[str, str]:
    """Names that equal mentions share, and that similar ones do."""
    if "@" in s:
        low = s.lower().strip(".%+-_!?'\"")
        return low, low.rpartition("@")[2]
    if s.count(".") == 3:
        return s, s.rpartition(".")[0]
    if any(map(str.isalpha, s)):
        return s, f"{s[:4]}{len(s)}"
    digits = "".join(c for c in s if c.isdigit())[-10:]
    return digits, f"{digits[:3]}{len(digits)}"


def _around_at(text: str) -> list[tuple[int, int]]:
    """Runs without white space or brackets round every @."""
    out, taken, at = [], 0, text.find("@")
    while at >= 0:
        start, end = at, at + 1
        while start > taken and text[start - 1] not in _STOPS:
            start -= 1
        while end < len(text) and text[end] not in _STOPS:
            end += 1
        if end > at + 1:
            out.append((start, end))
        taken = end
        at = text.find("@", max(at + 1, taken - 1))
    return out


def mentions(text: str, base: list[tuple[int, int, int]], teach: bool = False) -> list[Mention]:
    """Base spans and the candidates that overlap none, by start. With `teach`, candidates with their labels, as far as they have any."""
    out = [Mention(s, e, k, *_entities(text[s:e]), _features(text[s:e])) for k, s, e in base]
    found = [(s, e, -1) for s, e in _around_at(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _CHAIN.finditer(text):
            if len(_DIGIT.findall(m[0])) <= 19:
                found.append((*m.span(), O))
            else:  # numbers that stand side by side
                found += [(m.start() + x.start(), m.start() + x.end(), O) for x in _NUMBER.finditer(m[0]) if len(_DIGIT.findall(x[0])) >= 7]
    for m in _TOKEN.finditer(text):
        s = m[0]
        if _DIGIT.search(s) and _LETTERS.search(s):
            found.append((*m.span(), SECRET if teach and _ASSIGNED.search(text[max(0, m.start() - 24) : m.start()]) else -1))
        elif teach:
            found.append((*m.span(), O))
    taken = sorted((s, e) for _, s, e in base)
    i, last = 0, 0
    for s, e, label in sorted(found, key=lambda f: (f[0], -f[1])):
        while i < len(taken) and taken[i][1] <= s:
            i += 1
        if i < len(taken) and taken[i][0] < e or s < last:
            continue
        while e > s and text[e - 1] in ".,;:!?'\"":
            e -= 1
        if e > s:
            if label == O and not _LETTERS.search(text, s, e):  # a chain: none if a check refuses it
                label = O if _refused(text[s:e]) else -1
            out.append(Mention(s, e, label, *_entities(text[s:e]), _features(text[s:e])))
            last = e
    return sorted(out, key=lambda m: (m.start, m.end))


def _refused(s: str) -> bool:
    """It has the digits of a card or the parts of an address, but its checksum or a part's size is wrong."""
    digits = "".join(_DIGIT.findall(s))
    return 13 <= len(digits) <= 19 and not luhn(digits) or s.count(".") == 3 and any(int(p[:4] or 0) > 255 for p in s.split(".") if p.isdigit())


def marginals(ms: list[Mention], weights: np.ndarray) -> np.ndarray:
    """P(label) of every mention by loopy belief propagation over chain neighbours, equal and similar entities."""
    n, k = len(ms), O + 1
    unary = np.asarray([m.features for m in ms], float) @ weights
    for i, m in enumerate(ms):
        if m.label >= 0:
            unary[i] = -50.0
            unary[i, m.label] = 50.0
    unary -= np.logaddexp.reduce(unary, axis=1, keepdims=True)
    names: dict[tuple, int] = {}
    of = np.tile(np.arange(n), 2)
    hub = np.array([names.setdefault((0, m.entity), len(names)) for m in ms] + [names.setdefault((1, m.like), len(names)) for m in ms])
    skip = np.repeat([SKIP, SIMILAR], n)[:, None]
    through = lambda x, potential: np.logaddexp(x + np.log(np.expm1(potential)), np.logaddexp.reduce(x, axis=1, keepdims=True)) if len(x) else x
    norm = lambda x: x - np.logaddexp.reduce(x, axis=1, keepdims=True) if len(x) else x
    left, right, down = np.zeros((n, k)), np.zeros((n, k)), np.zeros((2 * n, k))
    for _ in range(ROUNDS):
        total = unary + left + right + down[:n] + down[n:]
        up = norm(through(norm(total[of] - down), skip))
        held = np.zeros((len(names), k))
        np.add.at(held, hub, up)
        new_down = norm(through(norm(held[hub] - up), skip))
        new_left, new_right = np.zeros((n, k)), np.zeros((n, k))
        new_left[1:] = norm(through(norm(total - right)[:-1], CHAIN))
        new_right[:-1] = norm(through(norm(total - left)[1:], CHAIN))
        moved = max(np.abs(new_down - down).max(), np.abs(new_left - left).max(), np.abs(new_right - right).max())
        left, right, down = ((1 - DAMP) * new + DAMP * old for new, old in ((new_left, left), (new_right, right), (new_down, down)))
        if moved < 1e-4:
            break
    return np.exp(norm(unary + left + right + down[:n] + down[n:]))


def spans(text: str, weights: np.ndarray) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans with those that the field adds."""
    base = base_spans(text)
    ms = mentions(text, base)
    if len(ms) == len(base):
        return base, base
    p = marginals(ms, weights)
    added = [(int(k), m.start, m.end) for m, k, q in zip(ms, p.argmax(1), p, strict=True) if m.label < 0 and k != O and q[k] >= SURE]
    return base, sorted(base + added)


def _fitted(x: np.ndarray, y: np.ndarray, times: np.ndarray, steps: int = 400) -> np.ndarray:
    """Multinomial regression by gradient descent with momentum; row i stands for times[i] mentions, and every label weighs alike."""
    k = O + 1
    w, v = np.zeros((x.shape[1], k)), np.zeros((x.shape[1], k))
    hot = np.eye(k)[y]
    totals = np.bincount(y, times, k)
    share = (times / totals[y] / max(1, (totals > 0).sum()))[:, None]
    for _ in range(steps):
        z = x @ w
        p = np.exp(z - np.logaddexp.reduce(z, axis=1, keepdims=True))
        v = 0.9 * v - 0.5 * (x.T @ ((p - hot) * share) + 1e-3 * w)
        w = w + v
    return w


def trained(docs: DataFrame) -> np.ndarray:
    """Potentials of features by labels, from all mentions that have a label. Counts of (label, shape) are combined before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[tuple, int] = {}
            for text in batch.column(0).to_pylist():
                for m in mentions(text or "", base_spans(text or ""), teach=True):
                    if m.label >= 0:
                        key = (m.label, *m.features)
                        seen[key] = seen.get(key, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([list(k) for k in seen], pa.list_(pa.int32())), pa.array(list(seen.values()), pa.int64())], ["x", "n"])

    rows = docs.select("text").mapInArrow(run, "x array<int>, n long").groupBy("x").agg(F.sum("n").alias("n")).orderBy("x").collect()  # shapes: 2^15 for each of 6 labels at most
    if not rows:
        return np.zeros((len(_features("")), O + 1))
    x = np.array([r["x"] for r in rows])
    return _fitted(x[:, 1:].astype(float), x[:, 0], np.array([r["n"] for r in rows], float))


def found(docs: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """doc_id, counts of base spans, base_sha256, spans, n_secret, n_added and n_spans for every row of docs."""
    weights = trained(docs) if weights is None else weights
    shown = lambda xs: ",".join(f"{LABELS[k]}:{s}:{e}" for k, s, e in xs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                base, every = spans(text or "", weights)
                counts = [0] * len(KINDS)
                for k, _, _ in base:
                    counts[k] += 1
                rows.append((*counts, hashlib.sha256(shown(base).encode()).hexdigest(), shown(every), sum(k == SECRET for k, _, _ in every), len(every) - len(base), len(every)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 9
            types = [*[pa.int64()] * 4, pa.string(), pa.string(), *[pa.int64()] * 3]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_secret", "n_added", "n_spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_secret long, n_added long, n_spans long")
