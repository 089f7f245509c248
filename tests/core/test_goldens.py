"""Hand-made cases with answers worked out by hand, on the operators themselves."""

import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import names
from tessera.functions.vectors import adaptive_threshold, cell_centre
from tessera.operators import bank, geometry, masks, metrics, protocol, search
from tessera.plans.engine import Config, Engine


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_average_precision(spark):
    r = spark.createDataFrame([("a", 0.9, 1, 1), ("a", 0.8, 0, 2), ("a", 0.7, 1, 3)], "class_id string, score double, is_tp int, rec_id int")
    gt = spark.createDataFrame([("a", 2), ("b", 3), ("c", 0)], "class_id string, gt_count long")
    got = {x.class_id: x.ap for x in metrics.average_precision(r, gt).collect()}
    assert got["a"] == pytest.approx(0.5 + 0.5 * 2 / 3) and got["b"] == 0 and got["c"] == 0


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 1)), min_size=1, max_size=60))
def test_average_precision_equals_plain_loop(spark, records):
    rows = [("a", s / 5, t, i) for i, (s, t) in enumerate(records)]
    gt = sum(t for _, t in records) + 1
    got = metrics.average_precision(spark.createDataFrame(rows, "class_id string, score double, is_tp int, rec_id int"), spark.createDataFrame([("a", gt)], "class_id string, gt_count long")).first().ap
    order = sorted(rows, key=lambda r: (-r[1], r[3]))
    tp = np.cumsum([r[2] for r in order])
    prec = tp / np.arange(1, len(order) + 1)
    env = np.maximum.accumulate(prec[::-1])[::-1]
    assert got == pytest.approx(sum(e for e, r in zip(env, order, strict=True) if r[2]) / gt)


def test_iou_of_sets(spark):
    px = lambda s: spark.createDataFrame([(1, 1, p) for p in s], "image_id long, class_id int, pixel long")
    row = metrics.with_ratios(metrics.pixel_counts(px([1, 2, 3]), px([2, 3, 4]))).first()
    assert (row.tp, row.fp, row.fn, row.iou) == (2, 1, 1, 0.5)


def test_thresholds(spark):
    q = spark.createDataFrame([(x,) for x in (0.6, 0.7, 0.8, 1.0)], "s double").agg(F.percentile("s", F.lit(0.75)).alias("q"))
    assert q.select(F.round(adaptive_threshold(F.col("q")), 6)).first()[0] == 0.765
    assert one(spark, adaptive_threshold(F.lit(0.6)).alias("a"), adaptive_threshold(F.lit(1.0)).alias("b")) == (0.65, 0.82)
    assert names.thresholds(0.1, 0.3, 0.1) == [0.1, 0.2, 0.3]
    assert [bank.cluster_count(n) for n in (199, 200, 1000, 100000)] == [1, 2, 2, 8]


def _bank(spark, scores, tp=3):
    return spark.createDataFrame([(i, 1, i, f"{i}_1.pt", 0, s, tp, 0) for i, s in enumerate(scores)], "vec_id long, class_id int, image_id long, file_key string, patch_no int, score double, tp long, fp long")


def test_floor_and_cap(spark):
    kept = bank.keep_floor(_bank(spark, [0.1, 0.2, None, None]), 0.9, 0.30)
    assert sorted(r.vec_id for r in kept.where("keep").collect()) == [2, 3]
    low = bank.keep_floor(_bank(spark, [0.1, 0.2, 0.3, 0.4]), 0.9, 0.5)
    assert sorted(r.vec_id for r in low.where("keep").collect()) == [2, 3]
    assert [r.vec_id for r in bank.cap_references(low, 1).where("keep").collect()] == [3]


def test_early_accept(spark):
    rows = bank.early_accept(_bank(spark, [0.9, 0.1, 0.9, 0.9, 0.9]), 0.6, 2).orderBy("vec_id").collect()
    assert [r.accepted for r in rows] == [True, False, True, False, False]
    assert [(r.score, r.tp, r.fp) for r in rows[3:]] == [(0.0, 0, 3)] * 2


def test_one_shot(spark):
    e = [[1.0, 0.0], [1.0, 0.0], [0.0, 1.0]]
    b = spark.createDataFrame([(i, 1, 7, v) for i, v in enumerate(e)], "vec_id long, class_id int, image_id long, embedding array<float>")
    got = sorted((r.vec_id, r.score, r.tp) for r in bank.one_shot(b, 3).collect())
    assert got == [(0, 1.0, 3), (1, 1.0, 3), (2, 0.0, 3)]


def test_min_matches_leaves_unscored(spark):
    rng = np.random.default_rng(0)
    rows = [(i, i // 2, 1, i % 2, f"{i // 2}_1.pt", rng.normal(size=4).tolist()) for i in range(6)]
    p = spark.createDataFrame(rows, "vec_id long, image_id long, class_id int, patch_no int, file_key string, embedding array<float>")
    got = bank.scored(p, p, -1.0, 3, 100).collect()
    assert all(r.score is None and r.tp == 2 for r in got)
    assert all(r.score == 1.0 for r in bank.scored(p, p, -1.0, 2, 100).collect())


def test_votes_twins_agree(spark):
    rng = np.random.default_rng(1)
    rows = [(i, i // 8, int(rng.integers(0, 3)), i % 8, rng.normal(size=6).tolist()) for i in range(120)]
    p = spark.createDataFrame(rows, "vec_id long, image_id long, class_id int, patch_no int, embedding array<float>")
    t = bank.targets(p, bank.target_images(p, 10))
    report = bank.equivalence(search.votes(p, t), search.votes_sql(p, t)).collect()
    assert len(report) == 3 and all(r.tp_equal and r.fp_equal and r.keep_equal and r.max_score_gap == 0 for r in report)
    small = search.block_join
    try:  # several blocks a class give the same votes
        search.block_join = lambda *a, **k: small(*a, **(k | {"block": 7}))
        again = bank.equivalence(search.votes(p, t), search.votes_sql(p, t)).collect()
    finally:
        search.block_join = small
    assert all(r.tp_equal and r.fp_equal for r in again)


def test_components_and_suppression(spark):
    assert geometry.label_cells([0, 1, 2], [0, 1, 2], 8) == [1, 1, 1]
    assert geometry.label_cells([0, 1, 2], [0, 1, 2], 4) == [1, 2, 3]
    assert geometry.label_cells([2, 0, 2, 1], [0, 0, 2, 0], 4) == [1, 1, 2, 1]
    assert geometry.suppress([(0, 0), (0, 2), (0, 3)], 3) == [0, 2]
    cells = spark.createDataFrame([(1, 1, 0, c, s) for c, s in enumerate((0.9, 0.8, 0.7))], "image_id long, class_id int, row int, col int, sim double")
    assert [r.col for r in geometry.nms_points(cells, 2.0).collect()] == [0, 2]


def test_prompt_geometry(spark):
    assert one(spark, cell_centre(F.lit(1), 2, 200.0).alias("x"), cell_centre(F.lit(0), 2, 100).alias("y")) == (150.0, 25.0)
    assert one(spark, metrics.rounded_pixel(F.lit(2.5), F.lit(10)).alias("x"), metrics.rounded_pixel(F.lit(3.5), F.lit(10)).alias("y")) == (2, 4)
    m = np.arange(9).reshape(3, 3)
    assert geometry.resized(m, 6, 6)[::2, ::2].tolist() == m.tolist() and geometry.resized(m, 2, 2, centre=False).tolist() == [[0, 1], [3, 4]]


def test_mask_nms_is_strict(spark):
    i = spark.createDataFrame([(1, 1, 0, 0.9, [1, 2, 3]), (1, 1, 1, 0.8, [2, 3, 4]), (1, 1, 2, 0.7, [1, 2, 3, 4]), (1, 1, 3, 0.6, [])], "image_id long, class_id int, inst int, score double, pixels array<long>")
    assert sorted(r.inst for r in masks.nms_masks(i, 0.5).collect()) == [0, 1]


def test_merges(spark):
    s = "image_id long, class_id int, pixel long, score double"
    a, b = spark.createDataFrame([(1, 1, 5, 0.9), (2, 1, 5, 0.9)], s), spark.createDataFrame([(1, 1, 5, 0.4), (1, 1, 6, 0.4), (2, 1, 9, 0.4), (3, 1, 1, 0.3)], s)
    assert [(r.image_id, r.pixel, r.score) for r in masks.merged_intersection(a, b).collect()] == [(1, 5, 0.4)]
    u = sorted((r.image_id, r.pixel, r.score) for r in masks.merged_union(a, b).collect())
    assert u == [(1, 5, 0.9), (1, 6, 0.9), (2, 5, 0.9), (2, 9, 0.9), (3, 1, 0.3)]
    g = "image_id long, class_id int, row int, col int, score double"
    t, p = spark.createDataFrame([(1, 1, 0, 0, 0.5)], g), spark.createDataFrame([(1, 1, 0, 1, 0.5), (1, 1, 3, 3, 0.2)], g)
    got = sorted((r.row, r.col, r.side, r.score) for r in masks.merged_confidence(t, p).collect())
    assert got == [(0, 0, "text", 0.5), (3, 3, "point", 0.5)]


def test_greedy_match(spark):
    preds = spark.createDataFrame([(1, 1, 0, 0.5), (1, 1, 1, 0.8), (1, 1, 2, 0.9)], "image_id long, class_id int, inst_a int, score double")
    pairs = spark.createDataFrame([(1, 1, 0, 9, 0.9), (1, 1, 1, 9, 0.6)], "image_id long, class_id int, inst_a int, inst_b int, iou double")
    assert {r.inst_a: r.is_tp for r in metrics.greedy_match(preds, pairs).collect()} == {0: 0, 1: 1, 2: 0}


def test_mapping_tie_and_purity(spark):
    c = spark.createDataFrame([(1, 3, 5), (1, 7, 5), (2, 4, 20)], "raw int, ref int, n long")
    got = {r.raw: (r.target, r.purity, r.low_confidence, r.top_targets) for r in protocol.label_mapping(c).collect()}
    assert got == {1: (3, 0.5, True, "3,7"), 2: (4, 1.0, False, "4")}


def test_names(spark):
    got = one(spark, names.prompt_text(F.lit("apple")), names.prompt_text(F.lit("bean_leaf")), names.prompt_text(F.lit("")), names.sanitized(F.lit(" a/b\\c ")), names.sanitized(F.lit("  ")), names.slug(F.lit("..//ä!")), names.cache_key(F.lit(".\\../a/b")), names.optional_number(F.lit(" None ")), names.optional_number(F.lit("2.5")), names.stem(F.lit("x/y.tar.gz")), names.normal_text(F.lit("  "), F.lit(" a  b ")), names.split_name(F.lit("/d/instances_val2017.json")), names.category_name(F.lit(None).cast("string"), F.lit(4)))
    assert tuple(got) == ("an apple", "a bean leaf", "an ", "a or b c", "unknown", "cache", "a/b", None, 2.5, "y.tar", "a b", "val", "cat_4")
    v = names.vocabulary(spark.createDataFrame([("a/b",), ("a or b",), ("c",), (None,), ("c",)], "name string")).orderBy("category_id").collect()
    assert [(r.category_id, r.name, r.original_name) for r in v] == [(1, "a or b", "a or b"), (2, "a or b (2)", "a/b"), (3, "c", "c")]


def test_medians(spark):
    d = spark.createDataFrame([(1, 1, "f", s, 3, 0) for s in (0.1, 0.4, 0.6, 0.9)], "class_id int, image_id long, file_key string, score double, tp long, fp long")
    assert bank.image_quality(d).first().median_score == 0.5
    assert bank.candidate_metrics(d, 0.0).first().median_passing == 0.4
    assert bank.report(d, F.lit(True)).first().median_score == 0.4


def test_bank_order_and_quota(spark):
    b = spark.createDataFrame([(1, 1, "2_1.pt", 0), (2, 1, "10_1.pt", 0)], "vec_id long, class_id int, file_key string, patch_no int")
    assert [r.vec_id for r in bank.first_n(b, 1).collect()] == [2]
    a = spark.createDataFrame([(1, 1, 1, 3), (1, 1, 2, 3), (1, 2, 3, 0), (1, 3, 4, 3)], "class_id int, image_id long, ann_id long, n_patches long")
    assert sorted(r.ann_id for r in bank.quota(a, max_images=1).collect()) == [1, 2]
    assert sorted(r.ann_id for r in bank.quota(a, max_features=4).collect()) == [1, 2]
    assert sorted(r.ann_id for r in bank.quota(a, 1, 1).collect()) == [1]  # both at once: the shorter part
    with pytest.raises(ValueError, match="no quota"):
        bank.quota(a)


def test_dense_ids(spark):
    rows = spark.createDataFrame([(x,) for x in np.random.default_rng(3).permutation(500).tolist()], "v long").repartition(6)
    assert all(r.id == r.v + 1 for r in protocol.numbered(rows, "v").collect())


def test_holdout():
    derive, held = protocol.holdout_split([f"s{i}" for i in range(11)])
    assert len(held) == 2 and not set(held) & set(derive) and protocol.holdout_split(["a"])[1] == ["a"]


def test_k_shots_are_nested(spark):
    s = spark.createDataFrame([(1, i) for i in range(7)] + [(2, i) for i in range(2)], "class_id int, image_id long")
    q = spark.createDataFrame([(1, 3, 0.9, 0.8, 0.8, 2), (1, 5, 0.9, 0.9, 0.8, 2)], "class_id int, image_id long, max_score double, mean_score double, median_score double, file_count long")
    ordered = protocol.support_order(s, q)
    assert [r.image_id for r in ordered.where("class_id = 1").orderBy("rank_within_class").collect()] == [5, 3, 0, 1, 2, 4, 6]
    shots = protocol.k_shots(ordered, (1, 5)).collect()
    one_, five = ({(r.class_id, r.image_id) for r in shots if r.shot == k} for k in (1, 5))
    assert one_ == {(1, 5), (2, 0)} and len(five) == 5 and (1, 5) in five
    assert {r.shot: (r.valid_classes, r.missing_classes) for r in protocol.shot_validity(ordered, (1, 5)).collect()} == {1: (2, 0), 5: (1, 1)}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 1), min_size=0, max_size=120), st.integers(1, 7))
def test_run_length_round_trip(bits, height):
    width = len(bits) // height
    mask = np.array(bits[: height * width], np.uint8).reshape(height, width)
    counts = masks.encode_runs(mask)
    assert (masks.decode_runs(counts, height, width) == mask).all()
    assert masks.text_to_counts(masks.counts_to_text(counts)) == counts
    assert (masks.decode(json.dumps(masks.encode(mask)), height, width) == mask).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 10**6), min_size=1, max_size=40))
def test_count_text_round_trip(counts):
    assert masks.text_to_counts(masks.counts_to_text(counts)) == counts


def test_decode_policies():
    square = masks.decode("[[1, 1, 4, 1, 4, 3, 1, 3]]", 5, 6)
    assert square.sum() == 6 and square[1:3, 1:4].all()
    assert masks.decode('{"size": [2, 2], "counts": [1, 2, 1]}', 2, 2).tolist() == [[0, 1], [1, 0]]
    assert masks.decode("{", 2, 2) is None and masks.decode(None, 2, 2) is None


def test_kmeans_centres_come_from_all_rows(spark):
    rng = np.random.default_rng(4)
    far = np.array([[0.0, 0.0], [4.0, 0.0], [0.0, 4.0]])
    m = np.vstack([far[k % 3] + rng.normal(size=2) for k in range(900)])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, 1 + i // 600, v.tolist()) for i, v in enumerate(m)], "vec_id long, class_id int, embedding array<float>")
    got = {r.vec_id: r.cluster for r in bank.with_clusters(rows).collect()}
    assert len(got) == 900
    for c in (range(600), range(600, 900)):
        own, near = m[list(c)], np.array([got[i] for i in c])
        assert set(near) == set(range(bank.cluster_count(len(own))))
        centres = np.array([own[near == k].mean(axis=0) for k in sorted(set(near))])
        again = ((own[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
        assert (again != near).mean() < 0.01  # each row is nearest to the mean of its own cluster


def test_coverage_of_bank_and_target_patches(spark):
    rows = [(1, 1, 0, 1, 0.95), (2, 1, 1, 1, 0.90), (3, 1, 1, 2, 0.10), (4, 2, 0, 1, 0.51), (5, 2, 1, 1, 0.50), (6, 2, 1, 2, 0.50), (7, 3, 0, 1, 1.0), (8, 3, 1, 2, 0.91)]
    patches = spark.createDataFrame([(*r, [1.0, float(r[0])]) for r in rows], "vec_id long, image_id long, patch_no int, class_id int, coverage double, embedding array<float>")
    assert {r.vec_id for r in Engine(Config(images_per_class=2)).build(patches).collect()} == {1, 7, 8}
    got = {(r.image_id, r.patch_no): r.inside for r in bank.targets(patches, spark.createDataFrame([(1, i) for i in (1, 2, 3)], "class_id int, image_id long")).collect()}
    assert got == {(1, 0): True, (1, 1): True, (2, 0): True, (2, 1): False, (3, 0): True, (3, 1): False}


def test_greedy_match_below_threshold_and_ties(spark):
    """The best free instance counts if it reaches the threshold; equal overlaps go to the lesser instance; all in the JVM."""
    preds = spark.createDataFrame([(1, 1, 0, 0.9), (1, 1, 1, 0.9), (1, 1, 2, 0.5), (1, 1, 3, 0.4), (None, 1, 0, 0.1)], "image_id long, class_id int, inst_a int, score double")
    pairs = spark.createDataFrame([(1, 1, 0, 7, 0.6), (1, 1, 0, 5, 0.6), (1, 1, 1, 5, 0.9), (1, 1, 1, 6, 0.4), (1, 1, 2, 7, 0.5), (1, 1, 3, 7, 0.8)], "image_id long, class_id int, inst_a int, inst_b int, iou double")
    got = metrics.greedy_match(preds, pairs)
    assert "MapInArrow" not in got._jdf.queryExecution().executedPlan().toString()
    assert {(r.image_id, r.inst_a, r.score, r.is_tp) for r in got.collect()} == {(1, 0, 0.9, 1), (1, 1, 0.9, 0), (1, 2, 0.5, 1), (1, 3, 0.4, 0), (None, 0, 0.1, 0)}
