import random
from collections import defaultdict

import numpy as np
import pytest

from tessera.llm import minhash
from tessera.llm.graph import components


def brute(rows, width, percent):
    sets = {}
    for i, t in rows:
        w = "".join(c.lower() if c.isascii() else c for c in t or "").split(" ")
        w = [x for x in w if x]
        sets.setdefault(i, []).append({tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if any(s and u and 100 * len(s & u) >= percent * len(s | u) for s in sets[a] for u in sets[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}, sets


def family(rng, base, n, edits):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("width", "small"), [(2, 8), (5, 8), (2, 2)])
def test_components_equal_brute_force(spark, width, small):
    rng = random.Random(width)
    texts = [" ".join(f"w{rng.randrange(300)}" for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    texts += family(rng, [f"a{k}" for k in range(120)], 90, 22) + family(rng, [f"b{k}" for k in range(40)], 30, 8) + ["x y z"] * 20 + ["X Y z", "x", "x ", "", " ", None]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want, sets = brute(rows, width, 80)
    got = {r.doc_id: r for r in minhash.near_duplicates(docs, width, 80, small=small).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.n_shingles == len(sets[i][0]) and r.kept == (r.component_id == i) for i, r in got.items())


def test_repeated_and_null_ids_and_extra_columns(spark):
    t = " ".join(f"q{k}" for k in range(30))
    rows = [(1, t, 5), (1, t, 5), (2, t + " more", 6), (None, t, 7), (None, None, 8), (3, None, 9), (4, "other words here", 1), (4, "quite different text", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rep long")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(docs, 2, 80).collect()), key=str)
    assert got == sorted([(1, 1, True), (1, 1, True), (2, 1, False), (None, None, True), (None, None, True), (3, 3, True), (4, 4, True), (4, 4, True)], key=str)
    kept = minhash.deduplicate(docs, 2, 80)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 0, 1, 3, 4]
    assert minhash.near_duplicates(docs.limit(0), 2, 80).count() == 0


def test_null_ids_beside_large_ones(spark):
    docs = spark.createDataFrame([((1 << 60) + 1, "a b c"), (None, "c d e f"), ((1 << 60) + 3, "d")], "doc_id long, text string").coalesce(1)
    assert sorted((r.doc_id or 0) for r in minhash.near_duplicates(docs, 2).collect()) == [0, (1 << 60) + 1, (1 << 60) + 3]


def test_block_comparison_connects_what_pairs_connect():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 100).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[k : k + 70], rng.integers(0, 2**63, 5).astype(np.uint64)])) for k in range(30)]
    links = minhash._joined_in_block(list(range(30)), list(range(30)), [k % 2 for k in range(30)], sets, 80)
    near = {(a, b) for a in range(30) for b in range(30) if a % 2 < b % 2 and minhash._alike(sets[a], sets[b], 80)}

    def groups(pairs):
        root = list(range(30))
        for a, b in pairs:
            p, q = a, b
            while root[p] != p:
                p = root[p]
            while root[q] != q:
                q = root[q]
            root[max(p, q)] = min(p, q)
        out = defaultdict(set)
        for x in range(30):
            y = x
            while root[y] != y:
                y = root[y]
            out[y].add(x)
        return sorted(map(sorted, out.values()))

    assert groups(links) == groups(near) and set(links) <= near


def test_star_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (None, 3), (300, 200), (200, 250)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(1, 41)}, **{k: 100 for k in range(101, 160)}, 250: 200, 300: 200}
