"""Sinks, sources and plans that the catalogue's file queries do not show."""

import json
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import names
from tessera.operators import bank as banks
from tessera.operators import geometry, metrics, protocol
from tessera.sources import exports, png, readers


def test_png_round_trips():
    g = np.random.default_rng(1)
    for shape in ((1, 1), (5, 7), (33, 2), (4, 6, 3)):
        image = g.integers(0, 256, shape).astype(np.uint8)
        assert (png.decode(png.encode(image)) == image).all()
    assert png.decode(png.encode(np.full((2, 2), 9, np.uint8)), colours=True).shape == (2, 2, 3)
    for bad in (b"", b"not a png", png.SIGNATURE + b"\0" * 20, png.encode(np.zeros((3, 3), np.uint8))[:40]):
        with pytest.raises((ValueError, struct.error)):
            png.decode(bad)


def filtered(image, kind):
    """An image with every row under one filter, by the format's definition."""
    height, width, step = image.shape
    flat, raw = image.reshape(height, -1).astype(int), b""
    for y in range(height):
        row = []
        for i in range(width * step):
            a, b, c = (flat[y, i - step] if i >= step else 0), (flat[y - 1, i] if y else 0), (flat[y - 1, i - step] if y and i >= step else 0)
            p = a + b - c
            guess = [0, a, b, (a + b) // 2, a if abs(p - a) <= min(abs(p - b), abs(p - c)) else b if abs(p - b) <= abs(p - c) else c][kind]
            row.append((flat[y, i] - guess) & 255)
        raw += bytes([kind, *row])
    chunk = lambda k, body: struct.pack(">I", len(body)) + k + body + struct.pack(">I", zlib.crc32(k + body))
    return png.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2 if step == 3 else 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("kind", range(5))
def test_png_filters(kind):
    image = np.random.default_rng(kind).integers(0, 256, (6, 5, 3)).astype(np.uint8)
    assert (png.decode(filtered(image, kind)) == image).all()


def test_damaged_images_give_no_rows(spark, tmp_path):
    (tmp_path / "1.png").write_bytes(png.encode(np.eye(4, dtype=np.uint8)))
    (tmp_path / "2.png").write_bytes(b"nothing")
    files = readers.image_files(spark, str(tmp_path))
    assert {r.path.rsplit("/", 1)[-1] for r in readers.label_masks(files).collect()} == {"1.png"}
    assert {(r.path.rsplit("/", 1)[-1], r.pixels.height) for r in readers.decoded(files).collect()} == {("1.png", 4), ("2.png", None)}


def test_first_rows_of_a_class_with_a_third_of_all(spark):
    rng = random.Random(3)
    rows = [(0 if k % 3 == 0 else rng.randrange(1, 40), f"f{rng.randrange(9999)}", k, rng.random()) for k in range(6000)]
    bank = spark.createDataFrame(rows, "class_id int, file_key string, patch_no int, score double")
    got = {}
    for r in banks.top_k(bank, None, 50).collect():
        got.setdefault(r.class_id, []).append(r.patch_no)
    for c in range(40):
        want = sorted((r for r in rows if r[0] == c), key=lambda r: (-r[3], r[1], r[2]))[:50]
        assert sorted(got[c]) == sorted(r[2] for r in want)


def test_both_quotas_equal_a_walk(spark):
    rng = random.Random(5)
    rows = [(c, i, i * 100 + c * 10 + k, rng.randrange(0, 4)) for i in range(30) for c in range(4) for k in range(rng.randrange(0, 3))]
    table = spark.createDataFrame(rows, "class_id int, image_id long, ann_id long, n_patches int")
    for most_images, most_features in ((5, 9), (3, 40), (30, 12)):
        got = {(r.class_id, r.ann_id) for r in banks.quota(table, most_images, most_features).collect()}
        images, features, want = {}, {}, set()
        for c, i, a, n in sorted(rows, key=lambda r: (r[1], r[2])):
            own = images.setdefault(c, set())
            if n and features.get(c, 0) < most_features and (i in own or len(own) < most_images):
                want.add((c, a))
                own.add(i)
                features[c] = features.get(c, 0) + n
        assert got == want


def test_window_maxima_equal_a_plain_search():
    rng = random.Random(7)
    at = {(rng.randrange(20), rng.randrange(20)): rng.choice([0.1, 0.5, 0.9, rng.random()]) for _ in range(150)}
    for d in (1, 3, 10):
        plain = {(r, c) for (r, c), s in at.items() if s >= max(v for (a, b), v in at.items() if abs(a - r) <= d and abs(b - c) <= d)}
        assert set(geometry.window_maxima(at, d)) == plain


def test_filling_goes_on_from_its_state(spark):
    available = spark.createDataFrame([(1, 0), (2, 3), (3, 0), (4, 0)], "class_id int, n long")
    pool = spark.createDataFrame([(1, k) for k in range(20)] + [(2, k) for k in range(4)] + [(3, 9)], "class_id int, image_id long")
    judge = lambda asked: asked.withColumn("accepted", F.col("image_id") % 2 == 0)
    taken, state = protocol.fill_to_shots(available, pool, judge, 4, batch=3, rounds=1)
    assert {(r.class_id, r.image_id) for r in taken.collect()} == {(1, 0), (1, 2), (2, 0)}
    assert {r.class_id: r.state for r in state.collect()} == {1: "running", 2: "done", 3: "insufficient_targets", 4: "insufficient_targets"}
    more, end = protocol.fill_to_shots(available, pool, judge, 4, batch=3, state=state)
    assert {(r.class_id, r.image_id) for r in more.collect()} == {(1, 4), (1, 6)}
    assert {r.class_id: (r.state, r.n) for r in end.collect()}[1] == ("done", 4)
    old = state.withColumn("version", F.lit(0))
    assert {(r.class_id, r.image_id) for r in protocol.fill_to_shots(available, pool, judge, 4, batch=3, state=old)[0].collect()} >= {(1, 0), (1, 2)}


def test_a_restored_state_gives_the_same_precision(spark):
    rng = random.Random(11)
    rows = [(c, round(rng.random(), 6), rng.randrange(2), c * 1000 + k) for c in range(3) for k in range(200)]
    records = spark.createDataFrame(rows, "class_id long, score double, is_tp int, rec_id long")
    truth = records.groupBy("class_id").agg((F.sum("is_tp") + 5).alias("gt_count"))
    counts = spark.createDataFrame([(0, 1, 2, 3)], "class_id long, tp long, fp long, fn long")
    _, again, gts = metrics.restored(metrics.state(counts, records, truth))
    aps = lambda r, g: {x.class_id: x.ap for x in metrics.average_precision(r, g).collect()}
    assert aps(again, gts) == pytest.approx(aps(records, truth))


def test_metadata_and_names(spark, tmp_path):
    rows = spark.createDataFrame([("a.jpg", 1, 0.5)], "file_name string, class_id int, score double")
    exports.merged_prompts(rows, str(tmp_path), "hybrid", "f0", {"loose": 0.8})
    exports.merged_prompts(rows, str(tmp_path), "hybrid", "f0", {"loose": 0.9})
    assert json.loads((tmp_path / "method=hybrid/fingerprint=f0/metadata.json").read_text()) == {"loose": 0.8}
    assert exports.prompt_lookup(rows.select("file_name", "class_id"), str(tmp_path), "hybrid", "f0").count() == 1
    row = spark.range(1).select(names.cluster_number(F.lit("auto")).alias("a"), names.cluster_number(F.lit(" 4 ")).alias("b")).first()
    assert row.a is None and row.b == 4
    with pytest.raises(ValueError):
        exports.local("hdfs://host/x")
