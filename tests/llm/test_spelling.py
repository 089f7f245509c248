import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from tessera.llm import spelling


def brute_words(docs):
    n = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def near(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute(vocab):
    out = {}
    for w, k in vocab.items():
        others = sorted((-vocab[x], x) for x in vocab if x != w and near(w, x))
        out[w] = (others[0][1], -others[0][0]) if others and -others[0][0] >= 5 * k else (None, None), len(others)
    rows = []
    for w, ((form, form_n), n_near) in out.items():
        root = w
        while out[root][0][0]:
            root = out[root][0][0]
        rows.append((w, form, root, vocab[w], n_near, form_n))
    return sorted(rows, key=str)


def rows_of(spark, vocab):
    frame = spark.createDataFrame(list(vocab.items()), "word string, n long").repartition(3)
    return sorted((tuple(r) for r in spelling.rooted(spelling.forms(frame)).select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_forms_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    vocab = {}
    for _ in range(40):
        w = "".join(rng.choice("abéÿ÷z"[: rng.choice((2, 6))]) for _ in range(rng.randrange(6, 10)))
        vocab[w] = rng.choice((5, 5, 25, 7, 400, 10**6))
        for _ in range(rng.randrange(9)):
            i = rng.randrange(len(w))
            v = rng.choice((w[:i] + w[i + 1 :], w[:i] + "b" + w[i:], w[:i] + rng.choice("abéz") + w[i + 1 :]))
            if len(v) >= 6:
                vocab[v] = rng.choice((5, 5, 6, 30, 150, 150, 9000))
    assert rows_of(spark, vocab) == brute(vocab)


def test_long_chains_ties_and_repeated_letters(spark):
    chain = {"aaaaaa" + "b" * i: 5 * 5**i for i in range(11)}
    ties = {"tiesxx": 5, "tiesxa": 500, "tiesxé": 500, "tiesx": 500, "tiesxxx": 500}
    assert rows_of(spark, chain | ties) == brute(chain | ties)
    assert dict((r[0], r[2]) for r in rows_of(spark, chain))["aaaaaa"] == "aaaaaa" + "b" * 10


def test_vocabulary_of_documents(spark):
    rng = random.Random(5)
    stems = ["".join(rng.choice("abcdefÀéÿ×÷ÉZ") for _ in range(rng.randrange(5, 10))) for _ in range(60)]
    docs = [(i, " ".join(rng.choice(stems) + rng.choice(("", ".", "ā", "9", "-", "’")) for _ in range(80))) for i in range(300)]
    docs += [(None, docs[0][1]), (7, docs[1][1]), (7, docs[1][1]), (8, None), (9, ""), (10, "longest" * 30_000), (11, "plenty " * 40_000)]
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, word string, n int").repartition(3)
    want = brute_words(docs)
    for held in (1 << 18, 10):
        assert {r.word: r.n for r in spelling.vocabulary(frame, held=held).collect()} == want
    # a run of five letters is no word, one of six that loses a letter is none either
    assert all(len(w) >= 6 for w in want) and any(len(w) == 6 for w in want)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.vocabulary(empty).count() == 0
    assert rows_of(spark, {"single": 9}) == [("single", None, "single", 9, 0, None)]
    assert spelling.rooted(spelling.forms(spelling.vocabulary(empty))).count() == 0


def test_query_equals_brute_force(spark):
    dir_ = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{dir_}/documents.parquet").collect()]
    got = spelling.op12_spelling_forms(spark, dir_)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = brute(brute_words(docs))
    assert sorted(map(tuple, got.collect()), key=str) == want
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{dir_}/documents.parquet'")
    assert sorted(con.execute(spelling.FORMS_SQL).fetchall(), key=str) == want
