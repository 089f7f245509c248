import random

import numpy as np
import pytest

from tessera.operators import masks, runs

H, W = 9, 7


def relation(spark, drawn, score=False):
    rows = []
    for (image, cls), (mask, s) in drawn.items():
        lengths = masks.encode_runs(mask)
        ends = np.cumsum(lengths)
        rows += [(image, cls, int(ends[k] - lengths[k]), int(lengths[k]), s, H) for k in range(1, len(lengths), 2)]
    return spark.createDataFrame(rows, "image_id long, class_id int, start long, len long, score double, height int").select("image_id", "class_id", "start", "len", *(("score", "height") if score else ("height",)))


def drawn_back(found):
    out = {}
    for r in found:
        m = out.setdefault((r.image_id, r.class_id), np.zeros(H * W, int))
        m[r.start : r.start + r.len] += 1
    return {k: m.reshape((H, W), order="F") for k, m in out.items()}


@pytest.fixture(scope="module")
def sides(spark):
    rng = random.Random(6)
    made = lambda seed: {(i, c): (np.array([[rng.random() < rng.choice((0.2, 0.6, 0.95)) for _ in range(W)] for _ in range(H)]), rng.choice((0.2, 0.5, 0.9))) for i in range(6) for c in range(2) if (i + c + seed) % 5}
    return made(0), made(1)


def test_algebra_equals_pixels(spark, sides):
    a, b = sides
    ra, rb = relation(spark, a), relation(spark, b)
    none = np.zeros((H, W), bool)
    for op, fn in ((runs.union, np.logical_or), (runs.intersection, np.logical_and), (runs.difference, lambda x, y: x & ~y)):
        rows = op(ra, rb).collect()
        want = {k: fn(a.get(k, (none,))[0], b.get(k, (none,))[0]) for k in {*a, *b}}
        got = drawn_back(rows)
        assert {k: v.tolist() for k, v in got.items()} == {k: m.astype(int).tolist() for k, m in want.items() if m.any()}
        ends = sorted((r.image_id, r.class_id, r.start, r.len) for r in rows)  # maximal: no two runs touch
        assert all(x[:2] != y[:2] or x[2] + x[3] < y[2] for x, y in zip(ends, ends[1:], strict=False))
    box = {(r.image_id, r.class_id): (r.area, r.bbox_x, r.bbox_y, r.bbox_w, r.bbox_h) for r in runs.area_bbox(ra).collect()}
    for k, (m, _) in a.items():
        y, x = np.nonzero(m)
        assert box[k] == (len(x), x.min(), y.min(), x.max() - x.min() + 1, y.max() - y.min() + 1)
    c = {r.class_id: (r.tp, r.fp, r.fn) for r in runs.counts(ra, rb).collect()}
    for cls in (0, 1):
        pair = [(a.get((i, cls), (none,))[0], b.get((i, cls), (none,))[0]) for i in range(6)]
        assert c[cls] == tuple(sum(int(f(x, y).sum()) for x, y in pair) for f in (lambda x, y: x & y, lambda x, y: x & ~y, lambda x, y: y & ~x))
    got = {(r.image_id, r.inst_a, r.inst_b): r.iou for r in runs.pair_iou(ra.withColumnRenamed("class_id", "inst"), rb.withColumnRenamed("class_id", "inst"), ("image_id",)).collect()}
    assert got == pytest.approx({(i, p, q): (a[i, p][0] & b[i, q][0]).sum() / (a[i, p][0] | b[i, q][0]).sum() for i in range(6) for p in (0, 1) for q in (0, 1) if (i, p) in a and (i, q) in b and (a[i, p][0] & b[i, q][0]).any()})


def test_merges_equal_those_of_pixels(spark, sides):
    a, b = sides
    ra, rb = relation(spark, a, True), relation(spark, b, True)
    cells = lambda d: spark.createDataFrame([(i, c, int(x) * H + int(y), int(y), int(x), s) for (i, c), (m, s) in d.items() for y, x in zip(*np.nonzero(m), strict=True)], "image_id long, class_id int, pixel long, row int, col int, score double")
    ca, cb = cells(a), cells(b)
    spread = lambda rows: {(r.image_id, r.class_id, p, r.score) for r in rows for p in range(r.start, r.start + r.len)}
    for mine, theirs in ((runs.merged_union, masks.merged_union), (runs.merged_intersection, masks.merged_intersection)):
        assert spread(mine(ra, rb).collect()) == {(r.image_id, r.class_id, r.pixel, r.score) for r in theirs(ca, cb).collect()}
    got = {(r.image_id, r.class_id, p): (r.side, r.score) for r in runs.merged_confidence(ra, rb).collect() for p in range(r.start, r.start + r.len)}
    assert got == {(r.image_id, r.class_id, r.col * H + r.row): (r.side, r.score) for r in masks.merged_confidence(ca, cb).collect()}


def test_no_pixel_is_made(spark, sides):
    wide = spark.createDataFrame([(1, 1, 3, 10**15, 10**6)], "image_id long, class_id int, start long, len long, height long")
    other = spark.createDataFrame([(1, 1, 10**14, 10**15, 10**6)], "image_id long, class_id int, start long, len long, height long")
    assert [(r.start, r.len) for r in runs.intersection(wide, other).collect()] == [(10**14, 10**15 + 3 - 10**14)]
    assert runs.area_bbox(wide).first().area == 10**15
    assert masks.label_instances(wide.withColumnRenamed("class_id", "label")).first().bbox_h == 10**6


def toggled(flat, h, w):
    """The COCO rule step by step, as plain loops over counts of alternating runs."""
    k, pts = len(flat) // 2, [int(5 * c + 0.5) for c in flat]
    x, y = pts[0::2] + [pts[0]], pts[1::2] + [pts[1]]
    u, v = [], []
    for j in range(k):
        xs, xe, ys, ye = x[j], x[j + 1], y[j], y[j + 1]
        dx, dy = abs(xe - xs), abs(ys - ye)
        flip = (dx >= dy and xs > xe) or (dx < dy and ys > ye)
        if flip:
            xs, xe, ys, ye = xe, xs, ye, ys
        for d in range(max(dx, dy) + 1):
            t = max(dx, dy) - d if flip else d
            s = ((ye - ys) / dx if dx >= dy else (xe - xs) / dy) if max(dx, dy) else 0
            u.append(t + xs if dx >= dy else int(xs + s * t + 0.5))
            v.append(int(ys + s * t + 0.5) if dx >= dy else t + ys)
    marks = []
    for j in range(1, len(u)):
        if u[j] != u[j - 1]:
            xd = ((u[j] if u[j] < u[j - 1] else u[j] - 1) + 0.5) / 5 - 0.5
            if xd == int(xd) and 0 <= xd <= w - 1:
                yd = min(max((min(v[j], v[j - 1]) + 0.5) / 5 - 0.5, 0), h)
                marks.append(int(xd) * h + int(np.ceil(yd)))
    flips = [marks.count(p) for p in range(h * w)]
    return (np.cumsum(flips) % 2).reshape((h, w), order="F").tolist()


def test_polygons_follow_the_rule():
    rng = random.Random(3)
    assert masks.fill_polygon([2, 2, 6, 2, 6, 5, 2, 5], 8, 9).nonzero()[0].tolist() == sorted([2, 3, 4] * 4)
    assert masks.fill_polygon([], 3, 4).sum() == 0 and masks.fill_polygon([1, 1, 1, 1], 3, 4).sum() == 0
    for _ in range(300):
        h, w = rng.randrange(1, 14), rng.randrange(1, 14)
        flat = [rng.choice((rng.randrange(0, 15), round(rng.uniform(0, 15), 2))) for _ in range(2 * rng.randrange(1, 7))]
        assert masks.fill_polygon(flat, h, w).tolist() == toggled(flat, h, w)


def test_table_function_in_a_lateral_join(spark):
    runs.register(spark)
    spark.createDataFrame([(1, '{"size": [2, 3], "counts": [1, 2, 3]}'), (2, "?"), (3, None)], "id int, s string").createOrReplaceTempView("raw_masks")
    got = spark.sql("SELECT id, start, len FROM raw_masks, LATERAL mask_runs(s, 2, 3)").collect()
    assert [tuple(r) for r in got] == [(1, 1, 2)]


def test_runs_of_pixels_take_one_shuffle(spark):
    rows = [(1, 1, p) for p in (4, 5, 5, 6, 9, 9, 1)] + [(1, 2, 5), (2, 1, None), (2, 1, 0), (2, 1, 1)]
    got = masks.to_runs(spark.createDataFrame(rows, "image_id long, class_id int, pixel long"))
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert {tuple(r) for r in got.collect()} == {(1, 1, 1, 1), (1, 1, 4, 3), (1, 1, 9, 1), (1, 2, 5, 1), (2, 1, None, 1), (2, 1, 0, 2)}


def test_all_operations_by_one_sweep(spark):
    rng = random.Random(8)
    side = lambda: spark.createDataFrame([(rng.randrange(3), rng.randrange(2), rng.randrange(40), rng.randrange(6)) for _ in range(60)], "image_id long, class_id int, start long, len long")
    a, b = side(), side()
    got = {tuple(r) for r in runs.algebra(a, b).select("op", "image_id", "class_id", "start", "len").collect()}
    each = (("union", runs.union), ("both", runs.intersection), ("less", runs.difference))
    assert got == {(n, *r) for n, f in each for r in f(a, b).select("image_id", "class_id", "start", "len").collect()} and len(got) > 20


def test_pair_iou_takes_a_shuffle_per_side_and_two_more(spark):
    shape = "image_id long, class_id int, start long, len long"
    one = [(1, 1, 0, 4), (1, 1, 2, 3), (1, 1, 5, 1), (1, 1, 9, 0), (1, 1, 4090, 10), (1, None, 0, 9), (None, 1, 0, 9), (1, 1, None, 3)]
    two = [(1, 2, 3, 2), (1, 2, 3, 2), (1, 2, 4098, 5), (1, 3, 6, 2), (1, None, 1, 1), (None, 2, 0, 9)]
    a, b = (runs.normal(spark.createDataFrame(r, shape)).withColumnRenamed("class_id", "inst") for r in (one, two))
    got = runs.pair_iou(a, b, ("image_id",))
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange") == 5
    assert [tuple(r) for r in got.collect()] == [(1, 1, 2, 4 / 19)]  # 16 and 7 pixels, of which 3, 4, 4098 and 4099 are in both


def test_a_sweep_takes_one_shuffle_and_gives_no_empty_stretch(spark):
    d = spark.createDataFrame([(1, 1, 2, 3), (1, 1, 2, 3), (1, 1, 5, 1), (1, 1, None, 2), (1, 1, 7, 0)], "image_id long, class_id int, start long, len long")
    got = runs.covered(("image_id", "class_id"), s=d)
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert sorted((r.start, r.len, r.s) for r in got.collect()) == [(2, 3, 2), (5, 1, 1)]


def test_pixel_pair_iou_takes_a_shuffle_per_side_and_two_more(spark):
    shape = "image_id long, class_id int, inst int, pixel long"
    a = spark.createDataFrame([(1, 1, 1, 1), (1, 1, 1, 2), (1, 1, 1, 3), (1, 1, None, 3), (None, 1, 1, 3), (1, 1, 1, None)], shape)
    b = spark.createDataFrame([(1, 1, 5, 2), (1, 1, 5, 3), (1, 1, 6, 9), (1, 1, None, 1), (None, 1, 5, 3)], shape)
    got = masks.pair_iou(a, b)
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange") == 5
    assert [tuple(r) for r in got.collect()] == [(1, 1, 1, 5, 2 / 4)]
