"""Porter's stems, and phrase, AND and OR search against a plain search."""

import math
import random
import re

from lectern.functions import porter
from lectern.operators import postings

# examples of the published algorithm, with each word's final stem
STEMS = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl
sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc
digitizer digit conformabli conform radicalli radic differentli differ vileli vile analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal
decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr
electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit
replacement replac adjustment adjust dependent depend adoption adopt communism commun activate activ angulariti angular homologous homolog effective effect bowdlerize bowdler probate
probat rate rate cease ceas controll control roll roll derivatives deriv derivative deriv integration integr integrals integr yes ye yellow yellow toy toi toys toi syzygy syzygi as as
by by über über x2s x2s""".split()


def test_stems_of_the_published_examples(spark):
    pairs = list(zip(STEMS[::2], STEMS[1::2], strict=True))
    got = porter.with_stem(spark.createDataFrame(pairs, "word string, want string"), "word", "stem").collect()
    assert [(r.word, r.stem) for r in got if r.stem != r.want] == []


def plain(stem, queries, texts, k=40):
    """Hits of quoted phrases and words, all of them or any, by BM25 over phrases."""
    tokens = lambda t: [stem[w] for w in re.findall(r"\w+", t.lower())]
    docs = {i: tokens(t or "") for i, t in texts}
    avg = sum(map(len, docs.values())) / len(docs)
    out = {}
    for qid, q in queries:
        any_ = " OR " in q
        q = q.replace(" OR ", " ")
        ps = [tuple(tokens(p)) for p in re.findall(r'"([^"]*)"', q)] + [(t,) for t in tokens(re.sub(r'"[^"]*"', " ", q))]
        ps = list(dict.fromkeys(p for p in ps if p))
        hits = {p: {i: n for i, d in docs.items() if (n := sum(tuple(d[s : s + len(p)]) == p for s in range(len(d))))} for p in ps}
        found = []
        for i, d in docs.items():
            have = [p for p in ps if i in hits[p]]
            if have and (any_ or len(have) == len(ps)):
                score = 0.0
                for p in have:
                    idf = math.log((len(docs) - len(hits[p]) + 0.5) / (len(hits[p]) + 0.5))
                    f = hits[p][i]
                    score += max(idf, 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(d) / avg))
                found.append((-round(score, 6), i, len(have)))
        out[qid] = [(i, n) for _, i, n in sorted(found)[:k]]
    return out


def test_search_against_plain_search(spark):
    r = random.Random(4)
    vocabulary = "rate rates rated integral integrals integration hop hopping the a of limit limits".split()
    texts = [(i, " ".join(r.choices(vocabulary, k=r.randint(0, 30)))) for i in range(80)] + [(98, None), (99, "")]
    queries = [
        (1, '"rate of"'), (2, "integrals hopping"), (3, "limit OR hop"), (4, '"the limits" rates'), (5, '"a the of"  OR  "rate integral"'), (6, '"integrals integral" integration'),
        (7, ""), (8, None), (9, '""'), (10, "missing"), (11, "the the THE"),
    ]
    stem = {x.word: x.stem for x in porter.with_stem(spark.createDataFrame([(w,) for w in [*vocabulary, "missing"]], "word string"), "word", "stem").collect()}
    got = postings.search(spark.createDataFrame(queries, "query_id int, query string"), spark.createDataFrame(texts, "passage_id int, body string")).collect()
    want = plain(stem, [(i, q) for i, q in queries if q], texts)
    for qid, _ in queries:
        assert [(x.passage_id, x.n_phrases) for x in sorted(got, key=lambda x: x["rank"]) if x.query_id == qid] == want.get(qid, []), qid
