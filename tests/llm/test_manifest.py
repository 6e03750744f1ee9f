"""The Merkle manifest against a plain tree, partial parents, odd rows."""

import hashlib
import zlib

from lectern.llm import manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, TREE string"


def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, lower=False):
    doc, text, lang, source, n, _ = row
    if lower and text is not None:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    told = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return h([told(v) for v in (doc, source, lang, n, text)])


def plain_tree(leaves):
    """Levels of a tree, and for each leaf its siblings level by level with its places."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([h(now[i : i + 16]) for i in range(0, len(now), 16)])
    links = []
    for i in range(len(leaves)):
        steps = []
        for nodes in levels[:-1]:
            run = nodes[i // 16 * 16 : i // 16 * 16 + 16]
            steps.append((i % 16, run))
            i //= 16
        links.append(steps)
    return levels[-1][0], links


def plain(rows):
    by_source = {}
    for r in rows:
        by_source.setdefault(r[3], []).append(r)
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        members = sorted(by_source[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[s] = members, *plain_tree([leaf_of(r) for r in members])
    root, upper = plain_tree([trees[s][1] for s in order])
    out = []
    for k, s in enumerate(order):
        members, subroot, links = trees[s]
        for r, steps in zip(members, links, strict=True):
            steps = steps + upper[k]
            proof = h([x for at, run in steps for j, x in enumerate(run) if j != at])
            tried = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            now = leaf_of(r, tried)
            for at, run in steps:
                now = h([*run[:at], now, *run[at + 1 :]])
            out.append((r[0], leaf_of(r), subroot, root, proof, now, now == root))
    return out


def got(spark, rows, step=manifest.STEP):
    return [tuple(r) for r in manifest.proven(spark.createDataFrame(rows, SCHEMA), step=step).collect()]


def test_against_plain_tree(spark):
    rows = [(i * 7 % 1000 - 20, f"Text {i} ÄbC", "en", "a", i, "x") for i in range(600)]
    rows += [(i, f"t{i}", None, f"s{i:02d}", i, None) for i in range(2000, 2040)]  # 40 sources of one row
    rows += [(i, "B" * i, "de", "b", None, None) for i in range(3000, 3017)]  # a last run of one
    rows += [(None, "X", "en", None, 1, None), (None, None, None, None, None, None), (5, "", "en", "", 0, None)]
    rows += [(77, "Same", "en", "a", 4, None)] * 3 + [(78, "one", "en", "a", 3, None), (78, "Two", "en", "a", 3, None)]
    assert sorted(map(repr, got(spark, rows))) == sorted(map(repr, plain(rows)))
    # more rounds of the frontier
    assert sorted(map(repr, got(spark, rows, step=1))) == sorted(map(repr, plain(rows)))


def test_small_and_empty(spark):
    assert got(spark, []) == []
    one = [(1, "A", "en", "s", 1, None)]
    assert got(spark, one) == plain(one)
    assert got(spark, one)[0][4] == hashlib.sha256(b"").hexdigest()
    # nothing to lower-case: tampering is no change
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 0]
    same = {r[0]: r[6] for r in got(spark, [(i, None if i % 2 else "abc", "en", "s", 1, None) for i in ids])}
    assert set(same.values()) == {True}
    loud = {r[0]: r[6] for r in got(spark, [(i, "aBc", "en", "s", 1, None) for i in ids])}
    assert set(loud.values()) == {False}


def test_partial_parents_in_any_order():
    leaves = [bytes([i % 256, i // 256]) * 16 for i in range(1000)]
    want, _ = plain_tree([x.hex() for x in leaves])
    whole = manifest.Subtree(1000, 0)
    for i in sorted(range(1000), key=lambda i: i * 7919 % 1000):
        whole.add(0, i, leaves[i])
    assert whole.top == (0, bytes.fromhex(want)) and not whole.open
    thirds = [manifest.Subtree(1000, 0) for _ in range(3)]
    for i in range(1000):
        thirds[i // 334].add(0, i, leaves[i])
    held = sum(len(x.open) for x in thirds)
    assert held < 20  # complete parents have gone
    assert thirds[1].merge(thirds[2]).merge(thirds[0]).top == whole.top


def test_manifest_of_sources(spark):
    rows = [(i, f"t{i}", "en", None if i % 3 else "s", i, None) for i in range(50)]
    listed = {r.source: (r.rows, r.subroot) for r in manifest.manifest(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = {("s" if r[0] % 3 == 0 else None): r[2] for r in plain(rows)}
    assert {s: x[1] for s, x in listed.items()} == want and listed["s"][0] == 17
