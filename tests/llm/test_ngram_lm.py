import random
import zlib
from collections import Counter
from math import log10

import pytest

from tessera.llm import ngram_lm as lm


def brute(rows):
    toks = [["".join(c.lower() if c.isascii() else c for c in t or "").split() + [None] for _, t in rows], [zlib.crc32(str("" if i is None else i).encode()) % 7 == 2 for i, _ in rows]]
    one, two, three, texts = Counter(), Counter(), Counter(), 0
    for ws, out in zip(*toks, strict=True):
        if not out:
            texts += 1
            one.update(ws)
            p = ["<s>", *ws]
            two.update(zip(p, p[1:]))
            three.update(zip(p, p[1:], p[2:]))
    n, v = sum(one.values()), len(one)
    result = []
    for ws, out in zip(*toks, strict=True):
        base = full = 0.0
        for k, w in enumerate(ws):
            q = (one[w] + 1) / (n + v + 1)
            base += log10(q)
            prev = ws[k - 1] if k else "<s>"
            c = texts if not k else one[prev]
            q = (two[prev, w] + lm.MU2 * q) / (c + lm.MU2)
            if k:
                before = ws[k - 2] if k > 1 else "<s>"
                c = two[before, prev]
                q = (three[before, prev, w] + lm.MU3 * q) / (c + lm.MU3)
            full += log10(q)
        result.append((out, len(ws), sum(one[w] > 0 for w in ws), n, base, full))
    return result


def test_scores_equal_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["the", "of", "And", "é", "x%d" % rng.randrange(60)]) for _ in range(rng.randrange(0, 80)))) for i in range(400)] + [(400, None), (401, ""), (402, " \t\n"), (9, "the of"), (None, "the of and"), ((1 << 60) + 1, "of the"), ((1 << 60) + 3, "the")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, held_out string").repartition(3)
    got = sorted(((r.doc_id is None, r.doc_id, r.n_tokens, r.held_out, r.n_known, r.train_tokens, r.base_score, r.score) for r in lm.train_and_score(docs).collect()), key=str)
    want = sorted(((i is None, i, n, out, known, total, base, full) for (i, _), (out, n, known, total, base, full) in zip(rows, brute(rows), strict=True)), key=str)
    assert [g[:6] for g in got] == [w[:6] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[6] == pytest.approx(w[6], abs=1e-9) and g[7] == pytest.approx(w[7], abs=2e-4 * w[2] + 1e-9)


def test_probabilities_sum_to_one_and_pointers(spark, tmp_path):
    texts = ["a b c a b d", "a b c", "b c a b"]
    folder = lm.build(spark.createDataFrame([(t,) for t in texts], "text string"), 3)
    trie = lm.Trie(folder)
    import numpy as np

    v = trie.vocabulary
    word = {w: lm.Vocabulary(folder).look(np.array([lm.xxhash.xxh3_64_intdigest(w.encode())], np.uint64))[0][0] for w in "abcd"}
    a, b, c, d = (word[w] for w in "abcd")
    assert sorted(trie.successors(a, b).tolist()) == sorted(x for x in {c, d, v.look(np.array([lm.END], np.uint64))[0][0]})
    every = np.arange(v.size + 1)
    total = 0.0
    for w in every:
        ids = np.array([a, b, w])
        counts = np.array([sum(t.split().count("a") for t in texts), sum(t.split().count("b") for t in texts), 0])
        hashes = np.sort(np.concatenate([lm._mapped(f"{folder}/words-{r}")["hash"] for r in range(v.shards) if v.starts[r] < v.starts[r + 1]]))
        counts[2] = v.look(hashes)[1][w] if w < v.size else 0
        total += trie.probabilities(ids, counts, np.zeros(3, int))[2]
    assert total == pytest.approx(1, abs=1e-3)


def test_scoring_walks_the_pointers_of_both_levels(spark, monkeypatch):
    folder = lm.build(spark.createDataFrame([("a b c a b d",), ("a b c",), ("b c a b",)], "text string"), 3)
    trie, asked = lm.Trie(folder), []
    plain = lm.EliasFano.bounds
    monkeypatch.setattr(lm.EliasFano, "bounds", lambda self, k: asked.append(len(k)) or plain(self, k))
    ids, counts = trie.vocabulary.look(lm.np.sort(lm.np.array([lm.xxhash.xxh3_64_intdigest(w) for w in (b"a", b"b", b"c")], lm.np.uint64)))
    p = trie.probabilities(ids, counts, lm.np.zeros(3, int))
    assert len(asked) >= 2 and (p > 0).all()
    blind = lm.Trie(folder)
    monkeypatch.setattr(lm.EliasFano, "bounds", lambda self, k: (lm.np.zeros(len(k), lm.np.int64), lm.np.zeros(len(k), lm.np.int64)))
    assert (blind.probabilities(ids, counts, lm.np.zeros(3, int)) < p).any()


def test_frequent_words_are_dealt_over_shards(spark):
    texts = [" ".join(f"the w{(7 * i + k) % 900}" for k in range(60)) for i in range(200)]
    folder = lm.build(spark.createDataFrame([(t,) for t in texts], "text string"), 40_000)  # ten shards
    v = lm.Vocabulary(folder)
    the = int(v.look(lm.np.array([lm.xxhash.xxh3_64_intdigest(b"the")], lm.np.uint64))[0][0])
    assert the in v.often.tolist() and v.size + 1 == v.often[-1] and len(v.often) <= 4 * v.shards + 1
    keys = lm.np.array(sorted(the << 32 | w for w in range(v.size)), lm.np.uint64)
    assert len(set(v.contexts(keys)[0].tolist())) == v.shards


def test_empty_table(spark):
    assert lm.train_and_score(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_chunks_split_as_bytes_do():
    """Every ASCII byte, other blanks, capitals beyond A-Z, nulls, blank and empty texts; chunks of several and of single texts."""
    texts = ["".join(map(chr, range(128))), "AÄİ b c\u0085d \x1cE\x1f", None, "", " \t\n\x0b\x0c\r ", "  a  B a\r\n", "x", "word " * 3000 + "End"]
    lower = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
    hashed = lambda t: [*map(lm.xxhash.xxh3_64_intdigest, (t or "").encode().translate(lower).split()), lm.END]
    batch = lm.pa.RecordBatch.from_pydict({"k": list(range(len(texts))), "text": lm.pa.array(texts, lm.pa.string())})
    for size in (1, 6, 10**6):
        got = {}
        for rows, numbers, text, words in lm._chunks(iter([batch, batch.slice(0, 0)]), size):
            for i, (k,) in enumerate(rows):
                got[k] = words.hashes[numbers[text == i]].tolist()
            assert len(set(words.hashes.tolist())) == len(words.hashes)
        assert got == dict(enumerate(map(hashed, texts)))
    assert [len(r[0]) for r in lm._chunks(iter([batch.select(["text"])]))] == [len(texts)]
