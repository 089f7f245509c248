import math
import random
import zlib

import numpy as np
import pytest

from tessera.llm import pu_quality as pu


def _texts(n, seed):
    rng = random.Random(seed)
    good = [" ".join(rng.choice(["the", "of", "river", "stone", "walked", "under", "and", "evening."]) + str(rng.randrange(40)) * (rng.random() < 0.1) for _ in range(rng.randrange(20, 200))) for _ in range(n)]
    bad = [" ".join(rng.choice(["the", "of", "stone"]) + rng.choice(["###", "|", "$$$", "!!"]) for _ in range(rng.randrange(20, 200))) for _ in range(n // 4)]
    return good, bad


def test_prior_and_held_out_accuracy_without_negative_labels():
    good, bad = _texts(1200, 1)
    pos = np.array([pu.features(t) for t in good[:500]])
    unl = np.array([pu.features(t) for t in good[500:900] + bad[:200]])
    model, prior = pu.train(pos, unl)
    assert prior == pytest.approx(400 / 600, abs=0.12)
    assert (model.logit(np.array([pu.features(t) for t in good[900:]])) > -0.8).mean() > 0.97
    assert (model.logit(np.array([pu.features(t) for t in bad[200:]])) > -0.8).mean() < 0.1


def test_non_negative_risk_reverses_overfitting():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 18))
    model = pu._fresh(x).fit(x[:20], x[20:], 0.5)
    p, u = model.logit(x[:20]), model.logit(x[20:])
    minus = (1 / (1 + np.exp(-u))).mean() - 0.5 * (1 / (1 + np.exp(-p))).mean()
    assert minus > -0.1


def plain_risk(model, p, u, prior):
    """The risk of a batch by plain loops: what the step follows, and the part that stands for negatives."""
    sig = lambda x: 1 / (1 + math.exp(-x))
    a, b, c, d = model.params

    def logit(row):
        hidden = [math.tanh(sum(row[i] * a[i][j] for i in range(len(row))) + b[j]) for j in range(len(b))]
        return sum(h * w for h, w in zip(hidden, c, strict=True)) + float(d)

    sp, su = [logit(r) for r in p], [logit(r) for r in u]
    decay = 0.5e-3 * (sum(x * x for row in a for x in row) + sum(x * x for x in c))
    if prior is None:
        return sum(math.log1p(math.exp(-s)) for s in sp) / len(sp) + sum(math.log1p(math.exp(s)) for s in su) / len(su) + decay, None
    plus = prior * sum(1 - sig(s) for s in sp) / len(sp)
    minus = sum(sig(s) for s in su) / len(su) - prior * sum(sig(s) for s in sp) / len(sp)
    return (plus + minus if minus >= 0 else -minus) + decay, minus


@pytest.mark.parametrize("prior, sign", [(None, 0), (0.3, 1), (0.95, -1)])
def test_gradients_are_those_of_the_plain_risk(prior, sign):
    rng = np.random.default_rng(4)
    p, u = rng.normal(0.5 * (sign < 0), 1, (5, 4)), rng.normal(-1.0 * (sign < 0), 1, (7, 4))
    model = pu._fresh(np.concatenate([p, u]))
    model.params = [rng.normal(0, 0.7, np.shape(q)) + (sign < 0) * 0.1 for q in model.params]
    if sign < 0:  # unlabelled rows that all look negative
        model.params[3] = np.float64(-3.0)
        p = -p
        model.params[2] = np.abs(model.params[2]) * 0 + model.params[0].T @ p.mean(axis=0)
    minus = plain_risk(model, p, u, prior)[1]
    assert sign == 0 or np.sign(minus) == sign
    grads = model._gradients(p, u, prior)
    for k, q in enumerate(model.params):
        for at in np.ndindex(np.shape(q)):
            risks = []
            for step in (1e-6, -1e-6):
                model.params[k] = np.array(q, float)
                model.params[k][at] += step
                risks.append(plain_risk(model, p, u, prior)[0])
            model.params[k] = q
            assert grads[k][at] == pytest.approx((risks[0] - risks[1]) / 2e-6, abs=1e-6) if np.shape(q) else float(grads[k]) == pytest.approx((risks[0] - risks[1]) / 2e-6, abs=1e-6)


def test_rows(spark):
    good, bad = _texts(120, 2)
    rows = [(i, t, "label") for i, t in enumerate(good + bad)] + [(None, "null id", "x"), (900, None, "x"), (901, "", "x"), (5, good[5], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality string")
    labels = spark.createDataFrame([(i, 1) for i in range(100)] + [(3, 0), (None, 1), (125, 0)], "doc_id long, quality int")
    out = pu.score_quality(docs, labels).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    none = pu.score_quality(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert pu.score_quality(docs.limit(0), labels).count() == 0


def test_null_ids_beside_large_ones(spark):
    ids = [(1 << 60) + 1, None, (1 << 60) + 3]
    docs = spark.createDataFrame([(i, "a b c") for i in ids], "doc_id long, text string").coalesce(1)
    rows = pu.score_quality(docs, spark.createDataFrame([(ids[0], 1)], "doc_id long, quality int")).collect()
    assert {r.doc_id: r.held_out for r in rows} == {i: i is not None and zlib.crc32(str(i).encode()) % 5 == 0 for i in ids}


def test_a_bounded_sample_ranks_texts(spark):
    good, bad = _texts(300, 4)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)], "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, 1) for i in range(250)], "doc_id long, quality int")
    rows = pu.score_quality(docs, labels, sample=80).collect()  # too few rows for the prior, enough for the order
    fine, poor = (np.array([r.score for r in rows if (r.doc_id < 300) == f]) for f in (True, False))
    assert len(rows) == 375 and (fine[:, None] > poor[None]).mean() > 0.9
    same = spark.createDataFrame([(7, t) for t in good[:40]], "doc_id long, text string")  # one id: all below the bound or none
    assert pu.score_quality(same, labels, sample=5).count() == 40


def test_unlearned_columns_do_not_matter(spark):
    good, bad = _texts(60, 3)
    rows = [(i, t) for i, t in enumerate(good + bad)]
    labels = spark.createDataFrame([(i, 1) for i in range(60)], "doc_id long, quality int")
    a = {r.doc_id: r.score for r in pu.score_quality(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()}
    flipped = labels.unionByName(spark.createDataFrame([(i, 1) for i in a if zlib.crc32(str(i).encode()) % 5 == 0], "doc_id long, quality int"))
    b = {r.doc_id: r.score for r in pu.score_quality(spark.createDataFrame(rows, "doc_id long, text string"), flipped).collect()}
    assert a == b
