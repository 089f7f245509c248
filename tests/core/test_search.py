import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import geometry, masks, search


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    bank = [(k, rng.randrange(7), k % 5, [rng.gauss(0, 1) for _ in range(5)]) for k in range(160)]
    bank += [(200 + k, 7 + k % 2, 0, bank[k][3]) for k in range(4)]  # equal vectors in different classes
    cells = [(c, i, r, k, [rng.gauss(0, 1) for _ in range(5)]) for i in range(3) for r in range(3) for k in range(3) for c in [None]]
    cells.append((None, 9, 0, 0, bank[0][3]))
    asked = [(c, i, r, k, e) for _, i, r, k, e in cells for c in ((1, 5, 8) if i != 2 else (0, 99))]  # class 99 has no bank
    return bank, asked


def cos(a, b):
    return float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))


@pytest.mark.parametrize("block", (4096, 13))
def test_other_similarity_equals_all_classes(spark, rows, monkeypatch, block):
    bank, asked = rows
    inner = search.block_join
    monkeypatch.setattr(search, "block_join", lambda *a: inner(*a, block=block))
    b = spark.createDataFrame(bank, "vec_id long, class_id int, image_id long, embedding array<double>")
    q = spark.createDataFrame(asked, "class_id int, image_id long, row int, col int, embedding array<double>")
    found = search.other_similarity(q, b, 0.1)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    got = {(r.class_id, r.image_id, r.row, r.col): (round(r.sim, 9), round(r.conf, 9)) for r in found.collect()}
    want = {}
    for c, i, r, k, e in asked:
        best = {d: max(cos(e, v) for _, x, _, v in bank if x == d) for d in {x for _, x, _, _ in bank}}
        if c in best:
            want[c, i, r, k] = (round(best[c], 9), round(best[c] - max(s for d, s in best.items() if d != c) - 0.1, 9))
    assert got == want


@pytest.mark.parametrize("block", (4096, 3))
def test_self_similarity_equals_all_pairs(spark, rows, monkeypatch, block):
    bank, _ = rows
    inner = search.block_join
    monkeypatch.setattr(search, "block_join", lambda *a: inner(*a, block=block))
    b = spark.createDataFrame(bank, "vec_id long, class_id int, image_id long, embedding array<double>")
    got = {r.vec_id: None if r.sim is None else round(r.sim, 9) for r in search.self_similarity(b).collect()}
    want = {}
    for v, c, i, e in bank:
        others = [cos(e, x) for w, d, j, x in bank if (d, j) == (c, i) and w != v]
        want[v] = round(max(others), 9) if others else None
    assert got == want and None in want.values()


def test_groups_keep_whole_numbers_beside_nulls(spark):
    big = 1152921504606846977
    cells = spark.createDataFrame([(big, 1, 0, 0), (big, 1, 0, 1), (None, 1, 0, 0), (None, 1, 0, 1), (5, 1, None, 2)], "image_id long, class_id int, row int, col int")
    got = [(r.image_id, r.col, r.component) for r in geometry.components(cells).collect()]
    assert sorted(got, key=str) == sorted([(big, 0, 1), (big, 1, 1), (None, 0, 1), (None, 1, 1)], key=str)
    points = spark.createDataFrame([(big, 1, 0, 0, 0.5), (big, 1, 0, 1, None), (None, 1, 3, 3, 0.2)], "image_id long, class_id int, row int, col int, sim double")
    assert {(r.image_id, r.sim) for r in geometry.nms_points(points, 2).collect()} == {(big, 0.5), (None, 0.2)}
    instances = spark.createDataFrame([(big, 1, big, 0.9, [1, 2]), (None, 1, 4, 0.8, [1]), (None, 1, 5, None, [1])], "image_id long, class_id int, inst long, score double, pixels array<long>")
    assert {(r.image_id, r.inst) for r in masks.nms_masks(instances).collect()} == {(big, big), (None, 4)}
    side = lambda s: spark.createDataFrame([(big, 1, 0, 0, s), (None, 1, 0, 0, s)], "image_id long, class_id int, row int, col int, score double")
    merged = masks.merged_confidence(side(0.4), side(0.6).where(F.col("image_id").isNotNull()))
    assert {(r.image_id, r.side) for r in merged.collect()} == {(big, "point"), (None, "text")}


def test_votes_by_sql_deal_a_class_in_parts(spark):
    rng = random.Random(3)
    rows = [(k, 1 + k % 11 // 10, k // 25, k % 25, [rng.gauss(0, 1) for _ in range(4)], k % 2 == 0) for k in range(600)]
    p = spark.createDataFrame(rows, "vec_id long, class_id int, image_id long, patch_no int, embedding array<float>, inside boolean")
    bank, targets = p.drop("inside"), p.where("image_id < 9").select("class_id", "image_id", "patch_no", "inside", "embedding")
    got = search.votes_sql(bank, targets, 0.1, part=50)
    kept = lambda d: sorted((r.vec_id, r.class_id, r.tp, r.fp) for r in d.where("tp + fp > 0").collect())
    assert kept(got) == kept(search.votes(bank, targets, 0.1)) and len(kept(got)) > 500
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "_p" in plan


@pytest.mark.parametrize("block", ((1 << 17, 1 << 16), (40, 30)))
def test_votes_equal_plain_loops_at_ties_zeros_and_broken_vectors(spark, monkeypatch, block):
    """Equal patches in and out of the class, vectors of zeros, NaN, similarities at the floor, images of different sizes, ids
    next to each other past 2^53, and vectors without an image. A vote goes to the first of equals, in doubles."""
    inner = search.block_join
    monkeypatch.setattr(search, "block_join", lambda *a, **k: inner(*a, **(k | {"block": block})))
    rng, big = np.random.default_rng(5), 1 << 60
    pool = rng.integers(-2, 3, (9, 3)).astype(float)
    pool[0], pool[1] = 0.0, [np.nan, 1.0, 1.0]
    rows = []
    for image in range(23):
        size = 1 + image % 7
        for no in rng.permutation(size).tolist():
            v = pool[rng.integers(9)] if image != 3 else pool[1]
            rows.append((len(rows), big + image, no, int(rng.integers(1, 3)), (v * (1 + rng.integers(3)) + (image % 5 == 0) * 1e-9 * rng.normal(size=3)).tolist()))
    rows += [(len(rows) + k, None, k, 1, pool[2 + k].tolist()) for k in range(3)]
    p = spark.createDataFrame(rows, "vec_id long, image_id long, patch_no int, class_id int, embedding array<double>")
    images = p.where("image_id is not null").select("class_id", "image_id").distinct()
    targets = p.withColumnRenamed("class_id", "_c").join(images, "image_id").select("class_id", "image_id", "patch_no", (F.col("_c") == F.col("class_id")).alias("inside"), "embedding")
    own = {(c, i) for _, i, _, c, _ in rows if i is not None}
    unit = lambda e: np.array(e) / max(np.linalg.norm(e), search.EPS)
    for floor in (0.0, -1.0, 0.5):
        want = {}
        for v, i, _, c, e in rows:
            tp = fp = 0
            for image in sorted(j for d, j in own if d == c and j != i):
                there = sorted((no, d, x) for _, j, no, d, x in rows if j == image)
                sims = np.round([float(unit(e) @ unit(x)) for _, _, x in there], 12)
                best = int(sims.argmax())
                if sims[best] >= floor:
                    tp, fp = (tp + 1, fp) if there[best][1] == c else (tp, fp + 1)
            want[v] = (tp, fp)
        got = {r.vec_id: (r.tp, r.fp) for r in search.votes(p, targets, floor).collect()}
        assert {v: t for v, t in got.items() if t != want[v]} == {} and len(got) == len(want)
