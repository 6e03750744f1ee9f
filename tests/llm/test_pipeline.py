"""The pipeline's stages on a small folder of tables: each against a plain version of it on the rows that the stage before it left, and run() against all."""

import collections
import itertools
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from lectern.llm import lines, packing, quality
from lectern.llm.registry import QUERIES

from .test_operators import SCHEMA, corpus, least_reachable


def words(text):
    return (text or "").encode().split()


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """(folder, tables): the documents and what each stage made of the table before it."""
    top = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame(corpus(3, 120), SCHEMA).drop("rank").write.parquet(str(top / "documents.parquet"))
    tables = [spark.read.parquet(str(top / "documents.parquet"))]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, tables[-1], str(top)).write.parquet(str(top / f"after {name}"))
        tables.append(spark.read.parquet(str(top / f"after {name}")))
    return str(top), tables


def counted(table):
    return collections.Counter(map(tuple, table.collect()))


def test_columns(made):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "minhash near-dedup", "source mix", "packing"]
    assert all(t.columns == made[1][0].columns for t in made[1][1:-1])


def test_quality_rules(made):
    """Base limits by counting; distances from the estimates, which tests of their own cover, in numpy."""
    before, after = made[1][:2]
    all_, fit = quality.fitted(quality.counted(before))
    estimate = {r.g: (np.array(r["mean"]), np.array(r["inverse"]).reshape(len(r["mean"]), -1)) for r in fit.collect()}
    near = set()
    for r in all_.collect():
        mean, inverse = estimate[r.g]
        x = np.array([r[c] for c in quality.STATS]) - mean
        if x @ inverse @ x <= quality.LIMIT**2:
            near.add(r.doc_id)
    want = collections.Counter()
    for r in before.collect():
        w = words(r.text)
        wins = collections.Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
        repeated = {p for j in range(len(w) - 4) if wins[tuple(w[j : j + 5])] > 1 for p in range(j, j + 5)}
        if len(w) >= 10 and 100 * len(repeated) <= 20 * len(w) and r.doc_id in near:
            want[tuple(r)] += 1
    assert counted(after) == want and 0 < sum(want.values()) < before.count()


def test_line_dedup(made):
    """Every run of every length up to MIN_LINES that was seen at an earlier place."""
    before, after = made[1][1:3]
    rows = before.collect()
    once, seen, gone = {r.doc_id: r.text for r in rows}, set(), set()
    for i in sorted(once):
        ls = once[i].split("\n")
        for p, n in itertools.product(range(len(ls)), range(1, lines.MIN_LINES + 1)):
            run = tuple(ls[p : p + n])
            if len(run) == n:
                if run in seen and (n == lines.MIN_LINES or sum(len(words(x)) for x in run) >= lines.MIN_WORDS):
                    gone |= {(i, p + j) for j in range(n)}
                seen.add(run)
    want = collections.Counter()
    for r in rows:
        left = "\n".join(x for p, x in enumerate(r.text.split("\n")) if (r.doc_id, p) not in gone)
        if left == r.text or words(left):
            want[tuple((r.asDict() | {"text": left, "n_chars": len(left)}).values())] += 1
    assert counted(after) == want and gone


def test_near_dedup(made):
    """All pairs of sets of five-word shingles."""
    before, after = made[1][2:4]
    rows = before.collect()
    sets = {}
    for r in rows:
        w = (r.text or "").encode().lower().split()
        sets[r.doc_id] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    pairs = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    least = least_reachable(sets, pairs)
    assert counted(after) == collections.Counter(tuple(r) for r in rows if least[r.doc_id] == r.doc_id) and pairs


def test_source_mix(made):
    """Whole rows, at most three times each, and each source's words near the target that water-filling in a loop gives."""
    before, after = (counted(t) for t in made[1][3:5])
    assert all(n <= 3 * before[r] for r, n in after.items())
    source, text = (made[1][3].columns.index(c) for c in ("source", "text"))
    sizes, taken, longest = collections.Counter(), collections.Counter(), collections.Counter()
    for r, n in before.items():
        sizes[r[source]] += n * len(words(r[text]))
        taken[r[source]] += after[r] * len(words(r[text]))
        longest[r[source]] = max(longest[r[source]], len(words(r[text])))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s)))}
    capped = set()
    while True:
        level = (sum(sizes.values()) - sum(3 * sizes[s] for s in capped)) / sum(weight[s] for s in sizes if s not in capped)
        over = {s for s in sizes if s not in capped and weight[s] * level > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    for s in sizes:
        assert abs(taken[s] - (3 * sizes[s] if s in capped else weight[s] * level)) <= 0.5 * longest[s] + 10


def test_packing(made):
    """Each copy's ids lie in its pieces once, by the tokenizer on whole texts; sequences are gapless and hold 4096 at most."""
    before, after = made[1][4], made[1][5].toPandas()
    tok, copies = Tokenizer.from_file(packing.default_tokenizer()), collections.Counter((r.doc_id, r.text) for r in before.collect())
    want = collections.Counter()
    for (i, text), n in copies.items():
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for m in packing.cuts(len(ids), 4096, 256):
            want[i, at, m, zlib.crc32(ids[at : at + m].tobytes()), len(ids)] += n
            at += m
        assert at == len(ids)
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert collections.Counter(after[columns].itertuples(index=False, name=None)) == want
    for _, g in after.sort_values("offset").groupby("sequence_id"):
        assert g.length.sum() <= 4096 and (g.offset == g.length.cumsum() - g.length).all()


def test_run_is_the_stages_one_after_another(spark, made):
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert counted(corpus_pipeline.run(spark, made[0]).select(*columns)) == counted(made[1][-1].select(*columns))


def test_every_operator_has_a_query():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))
