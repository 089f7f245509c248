"""The pipeline on a small corpus against plain loops, stage by stage and as a whole."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from test_minhash import brute as near_brute
from test_native_ops import ledger_brute, water
from test_packing import _reference

import corpus_pipeline
from tessera.llm import pii, tagger

W = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(8)
    word = lambda: rng.choice("ae") + rng.choice("bcd") + rng.choice("oiu") + rng.choice("lmn") + str(rng.randrange(9))
    texts = [" ".join(word() for _ in range(rng.randrange(5, 120))) for _ in range(90)]
    for k in range(25):  # near and exact copies
        w = texts[k].split()
        if k % 2 and len(w) > 60:
            w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += ["### |".join(word() for _ in range(40)), "same line here\n" * 30, " ".join(word() for _ in range(30)) + " mail me@host.org or +1 (275) 555-5927 ok", "", None, " ".join(word() for _ in range(2500))]
    rows = [(i, t, "en", rng.choice(["a", "b", "c", None]), len(t) if t is not None else None) for i, t in enumerate(texts)]
    rows.append(rows[3])
    return rows


def quality(rows):
    out = []
    for r in rows:
        n, chars, symbols, lines, dup, rep = ledger_brute(r[1])
        if not (n < 20 or 100 * rep > 30 * n or 2 * symbols > n or (lines >= 4 and 2 * dup > lines) or (n and not 2 * n <= chars <= 20 * n)):
            out.append(r)
    return out


def dedup(rows):
    comp, _ = near_brute([(r[0], r[1]) for r in rows], 5, 80)
    kept = {}
    for r in rows:
        if comp[r[0]] == r[0]:
            kept.setdefault(r[0], r)
    return list(kept.values())


def private(rows):
    out = []
    for r in rows:
        ((_, spans),) = pii.find_spans([r[1]], tagger.trained())
        t = pii.masked(r[1], spans)
        out.append((r[0], t, r[2], r[3], len(t)))
    return out


def mixed(rows):
    size = {r[0]: len(W.findall(r[1])) for r in rows}
    per = Counter()
    for r in rows:
        per[r[3]] += size[r[0]]
    order = sorted((s for s in per if s is not None)) + ([None] if None in per else [])
    target = water(per, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, 1.5 * sum(per.values()))
    out = []
    for s in order:
        u = int(hashlib.md5(("mix-1:" + ("n" if s is None else "s" + s)).encode()).hexdigest()[:8], 16) / 2**32
        e = target[s] / per[s]

        def rank(r):
            k = max(len(bin(size[r[0]])) - 2 - 7, 0)
            return k * 128 + (size[r[0]] >> k), hashlib.md5(f"{r[0]}:{size[r[0]]}:{hashlib.md5(r[1].encode()).hexdigest()}".encode()).hexdigest()

        for k, r in enumerate(sorted((r for r in rows if r[3] == s), key=rank), 1):
            out += [r] * (math.floor(e * k + u) - math.floor(e * (k - 1) + u))
    return out


def test_each_stage_and_the_whole(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns
    plain = rows
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "minhash_near_dedup", "pii", "mix_sources", "best_fit_packing"]
    for k, ((name, stage), loop) in enumerate(zip(corpus_pipeline.STAGES, (quality, dedup, private, mixed), strict=False)):
        got, plain = stage(spark, docs, str(tmp_path)), loop(plain)
        assert got.columns == columns
        got.write.parquet(str(tmp_path / f"stage{k}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{k}"))
        assert Counter(map(tuple, docs.collect())) == Counter(plain), name
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = Counter()
    for r in plain:
        ids = _reference(r[1])
        for p, s in enumerate(range(0, len(ids), 4096)):
            want[r[0], p, s, len(ids[s : s + 4096]), zlib.crc32(np.array(ids[s : s + 4096], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in whole) == want
    seqs = {}
    for r in whole:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 4096


def test_stages_take_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0


def test_registered():
    entry = pytest.importorskip("__spark_entry__")
    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
