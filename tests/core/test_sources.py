import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import bank as banks
from tessera.operators import masks, protocol
from tessera.plans import models
from tessera.plans.engine import Config, Engine
from tessera.sources import exports, png, readers, writers
from tessera.streaming import resume


@pytest.fixture
def coco(tmp_path):
    doc = {
        "images": [{"id": 1, "width": 6, "height": 5, "file_name": "a.jpg", "not_exhaustive_category_ids": [2]}, {"id": 2, "width": 6, "height": 5, "coco_url": "http://x/y/b.jpg"}, {"id": 3, "width": 1, "height": 1}],
        "annotations": [{"id": 10, "image_id": 1, "category_id": 1, "segmentation": [[1, 1, 4, 1, 4, 3, 1, 3]], "bbox": [1, 1, 3, 2], "area": 6, "iscrowd": 0}, {"id": 11, "image_id": 1, "category_id": 2, "segmentation": {"size": [5, 6], "counts": [0, 30]}}, {"id": 12, "image_id": 2, "category_id": 9, "segmentation": "broken"}],
        "categories": [{"id": 1, "name": "leaf"}, {"id": 2, "name": "leaf"}],
    }
    path = tmp_path / "train.json"
    path.write_text(json.dumps(doc))
    return str(path)


def test_coco_scan(spark, coco):
    images, annotations, categories = readers.coco(spark, coco)
    assert {r.id: r.file_name for r in images.collect()} == {1: "a.jpg", 2: "b.jpg"}
    rec = {r.image_id: r.valid_cats for r in readers.records(images, annotations).collect()}
    assert rec == {1: [1], 2: [9]}
    named = {r.id: r.class_name for r in protocol.annotated(annotations, images, categories).collect()}
    assert named == {10: "leaf", 11: "leaf", 12: "cat_9"}
    assert protocol.first_category(categories).first().category_id == 1
    assert readers.grouped_annotations(annotations).count() == 3
    rows = annotations.select("image_id", F.col("category_id").alias("class_id"), F.col("id").alias("ann_id"), "segmentation", F.lit(5).alias("height"), F.lit(6).alias("width"))
    area = {r.ann_id: r.n for r in masks.to_pixels(masks.runs_of(rows)).groupBy("ann_id").agg(F.count("*").alias("n")).collect()}
    assert area == {10: 6, 11: 30}


def test_text_and_json_sources(spark, tmp_path):
    (tmp_path / "labels.txt").write_text("1: cat\n2 - dog house\n\nnonsense\n")
    assert [(r.label, r.name) for r in readers.label_list(spark, str(tmp_path / "labels.txt")).collect()] == [(1, "cat"), (2, "dog house")]
    (tmp_path / "tabs.txt").write_text("x\tWall\n\ny\tz\tSKY\n")
    assert [(r.label, r.name) for r in readers.tab_list(spark, str(tmp_path / "tabs.txt")).collect()] == [(1, "wall"), (2, "sky")]
    (tmp_path / "ids.txt").write_text(" a1 \n\nb2\n")
    assert [r.stem for r in readers.split_ids(spark, str(tmp_path / "ids.txt")).collect()] == ["a1", "b2"]
    (tmp_path / "p.jsonl").write_text('{"image_id": 1, "category_id": 2, "score": 0.5}\n\n{"image_id": 2}\n')
    assert readers.json_lines(spark, str(tmp_path / "p.jsonl")).count() == 2
    (tmp_path / "m.json").write_text('{"items": [{"image_id": 3, "ann_ids": [1]}]}')
    (tmp_path / "n.json").write_text('[{"image_id": 4, "ann_ids": [2]}]')
    for name, want in (("m", 3), ("n", 4)):
        assert [r.image_id for r in readers.manifest(spark, str(tmp_path / f"{name}.json"), "image_id:bigint,ann_ids:array<bigint>").collect()] == [want]
    names = spark.createDataFrame([("12_3.pt",), ("bad.pt",), ("12_4.pt",)], "file_name string")
    assert [r.image_id for r in readers.image_ids(names).collect()] == [12]


def test_bank_round_trip_prunes_partitions(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, 1, 0, [1.0], 0.5, 1, 1), ("b", 1, 2, 0, [2.0], None, 0, 0)], readers.BANK)
    writers.bank(rows, str(tmp_path / "bank"))
    writers.bank(rows.where("class_name = 'a'").withColumn("score", F.lit(0.9).cast("float")), str(tmp_path / "bank"))
    back = readers.bank(spark, str(tmp_path / "bank"))
    assert back.count() == 2 and readers.bank(spark, str(tmp_path / "bank"), ["a"], scored=True).first().score == pytest.approx(0.9)
    plan = readers.bank(spark, str(tmp_path / "bank"), ["a"])._jdf.queryExecution().executedPlan().toString()
    assert "class_name" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert [r.class_name for r in readers.bank_classes(back).collect()] == ["a", "b"]


def test_layout_and_shards(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        readers.layout(spark, str(tmp_path))
    (tmp_path / "train.json").write_text("{}")
    (tmp_path / "test.json").write_text("{}")
    assert readers.layout(spark, str(tmp_path)) == "coco"
    with pytest.raises(FileNotFoundError):
        readers.shards(spark, str(tmp_path))
    assert readers.first_existing(spark, [str(tmp_path / "x"), str(tmp_path / "train.json")]).endswith("train.json")


def test_arrow_stream_source(spark, tmp_path):
    import pyarrow as pa

    for k in range(2):
        t = pa.table({"filename": [f"f{k}", "g"], "n": [k, 5]})
        with pa.OSFile(str(tmp_path / f"{k}.arrow"), "wb") as f, pa.ipc.new_stream(f, t.schema) as w:
            w.write_table(t)
    rows = readers.arrow_streams(spark, [str(tmp_path / "0.arrow"), str(tmp_path / "1.arrow")])
    assert sorted((r.filename, r.n) for r in rows.collect()) == [("f0", 0), ("f1", 1), ("g", 5), ("g", 5)]


def test_writers(spark, coco, tmp_path):
    images, annotations, categories = readers.coco(spark, coco)
    writers.coco_single_file(images, annotations, categories.drop("ord"), str(tmp_path / "out.json"))
    again = readers.coco(spark, str(tmp_path / "out.json"))
    assert [d.count() for d in again] == [2, 3, 2]
    writers.json_atomic(str(tmp_path / "r.json"), {"b": 1, "a": 2})
    assert (tmp_path / "r.json").read_text().index('"a"') < (tmp_path / "r.json").read_text().index('"b"')
    assert writers.summary_line({"iou": 0.5, "AP50": 0.25}).endswith("mAP50=0.2500")
    files = spark.createDataFrame([("x/a.jpg", bytearray(b"1")), ("x/b.jpg", None)], "path string, content binary")
    assert sorted(r.status for r in writers.copied_images(files, str(tmp_path)).collect()) == ["copied", "missing"]
    assert (tmp_path / "a.jpg").read_bytes() == b"1"


def test_resume_counts_each_file_once(spark, tmp_path):
    src, out, chk = (str(tmp_path / n) for n in ("src", "out", "chk"))
    spark.range(10).write.parquet(src)
    args = (spark, src, "id long", lambda d: d.withColumn("twice", F.col("id") * 2), out, chk)
    resume.run_available(*args)
    spark.range(10, 15).write.mode("append").parquet(src)
    resume.run_available(*args)
    resume.run_available(*args)
    assert sorted(r.twice for r in spark.read.parquet(out).collect()) == [2 * i for i in range(15)]


def test_upsert_keeps_the_latest(spark, tmp_path):
    src, out, chk = (str(tmp_path / n) for n in ("src", "out", "chk"))
    for v in (1, 2):
        spark.createDataFrame([(7, v)], "k long, v long").write.mode("append").parquet(src)
        resume.upsert_available(spark, src, "k long, v long", ("k",), out, chk)
    assert [(r.k, r.v) for r in resume.latest(spark, out, ("k",)).collect()] == [(7, 2)]


def test_model_boundary(spark):
    images = spark.createDataFrame([(1, bytearray(b"ok")), (2, bytearray(b"bad"))], "image_id long, content binary")

    def load():
        def encoder(batch):
            if any(b == b"bad" for b in batch):
                raise ValueError("bad")
            return [np.full((2, 2, 3), 2.0) for _ in batch]

        return encoder

    rows = models.encode_images(images, load).collect()
    assert len(rows) == 4 and {r.image_id for r in rows} == {1} and sum(x * x for x in rows[0].embedding) == pytest.approx(1)

    def masks_():
        def model(content, prompt, points):
            if points:
                raise RuntimeError("no points")
            return [(np.array([[1, 0], [0, 0]]), 0.5), (np.zeros((2, 2)), 0.9)]

        return model

    ask = spark.createDataFrame([(1, 1, bytearray(b"x"), "a leaf", [(1.0, 1.0)]), (2, 1, bytearray(b"x"), "a leaf", None)], "image_id long, class_id int, content binary, prompt string, points array<struct<x:double,y:double>>")
    got = {r.image_id: r for r in models.predict_masks(ask, masks_).collect()}
    assert len(got) == 2 and all(r.used_text_only_fallback for r in got.values())
    assert got[1].combined_prediction_error == "no points" and got[2].combined_prediction_error is None


def test_engine_end_to_end(spark, tmp_path):
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(3, 8))
    rows = []
    for i in range(12 * 16):
        c = int(rng.integers(0, 3)) if i // 16 != 11 else 0
        rows.append((i, i // 16, c, i % 16, (i % 16) // 4, i % 4, f"{i // 16}_{c}.pt", (centre[c] + 0.2 * rng.normal(size=8)).tolist()))
    p = spark.createDataFrame(rows, "vec_id long, image_id long, class_id int, patch_no int, row int, col int, file_key string, embedding array<float>")
    refs, ask = p.where("image_id < 8"), p.where("image_id >= 8")
    queries = ask.drop("class_id").join(ask.select("image_id", "class_id").distinct(), "image_id")
    inst = ask.selectExpr("image_id", "class_id", "class_id inst", "col * 10 + 5 px", "row * 10 + 5 py")
    for method in ("absolute", "relative", "hybrid"):
        for kind in ("fixed", "adaptive", "clustered"):
            config = Config(method=method, filter=kind, grid=(4, 4), size=(40.0, 40.0), min_component=1, peak_distance=1, min_cluster_size=2, num_points=3)
            if kind != "adaptive" and method != "absolute":
                continue
            out = Engine(config, str(tmp_path)).run(refs, queries, inst)
            m = out["metrics"].collect()
            assert m and all(0 <= r.precision <= 1 for r in m)
            assert max(r.precision for r in m) > 0.8
    assert Config().fingerprint == Config().fingerprint != Config(method="absolute").fingerprint
    with pytest.raises(ValueError, match="not one of"):
        Config(method="other")


def test_image_root_and_label_masks(spark, tmp_path):
    import io

    (tmp_path / "deep" / "val").mkdir(parents=True)
    for k in range(4):
        (tmp_path / "deep" / "val" / f"{k}.jpg").write_bytes(b"x")
    names = [f"{k}.jpg" for k in range(4)]
    assert readers.image_root(spark, str(tmp_path), [str(tmp_path), str(tmp_path / "deep" / "val")], names).endswith("deep/val")
    assert readers.image_root(spark, str(tmp_path), [], names).endswith("deep/val")
    buf = io.BytesIO()
    np.save(buf, np.array([[1, 1, 0], [1, 255, 2]]))
    runs = readers.label_masks(spark.createDataFrame([("a.npy", bytearray(buf.getvalue())), ("b.npy", bytearray(b"?"))], "path string, content binary"))
    assert sorted((r.label, r.start, r.len) for r in runs.collect()) == [(0, 4, 1), (1, 0, 3), (2, 5, 1), (255, 3, 1)]
    inst = masks.label_instances(runs.withColumn("image_id", F.lit(1)).withColumn("height", F.lit(2)))
    assert {r.label: (r.area, r.bbox_x, r.bbox_y, r.bbox_w, r.bbox_h) for r in inst.collect()} == {1: (3, 0, 0, 2, 2), 2: (1, 2, 1, 1, 1)}
    assert masks.normal_mask(np.array([[[0.2, -1.0]]]), 2, 2).tolist() == [[1, 0], [1, 0]]


def test_scene_labels_paint_in_depth_order_over_the_shorter_list(spark):
    png_of = lambda *rows: {"bytes": bytearray(png.encode(np.array(rows, np.uint8)))}
    obj = lambda name, raw, rank: {"name": name, "raw_name": raw, "depth_ordering_rank": rank}
    left, right, full = png_of([255, 0], [255, 0]), png_of([0, 9], [0, 9]), png_of([1, 1], [1, 1])
    shape = "filename string, width int, height int, objects array<struct<name:string,raw_name:string,depth_ordering_rank:int>>, instances array<struct<bytes:binary>>"
    rows = [
        ("a", 2, 2, [obj("wall", None, None), obj(" ", " big  tree ", 1)], [left, full]),  # an unknown rank comes last
        ("b", 2, 2, [obj("wall", None, 1), obj("wall", None, 2), obj("x", None, 3)], [right, {"bytes": bytearray(b"no")}]),
        ("c", 2, 2, None, [full]),
    ]
    scenes = spark.createDataFrame(rows, shape)
    categories = spark.createDataFrame([(3, "wall"), (7, "big tree")], "category_id int, name string")
    got = {}
    for r in exports.scene_labels(scenes, categories).collect():
        got.setdefault((r.filename, bool(r.mismatched)), []).append((r.start, r.len, r.label))
    assert {k: sorted(v) for k, v in got.items()} == {("a", False): [(0, 2, 3), (2, 2, 7)], ("b", True): [(0, 2, 0), (2, 2, 3)], ("c", False): [(0, 4, 0)]}


def test_prototypes_stand_in_for_a_class_or_come_last(spark, tmp_path):
    bank = spark.createDataFrame([(1, 1, "5_1.pt", 0, [1.0, 0.0]), (2, 2, "5_2.pt", 0, [0.0, 1.0])], "vec_id long, class_id int, file_key string, patch_no int, embedding array<float>")
    protos = spark.createDataFrame([(1, 0, [0.5, 0.5]), (1, 1, [0.5, 0.4]), (3, 0, [0.1, 0.9]), (2, 0, None)], "class_id int, place int, embedding array<float>")
    rows = banks.with_prototypes(bank, protos).collect()
    assert sorted((r.class_id, r.file_key, r.patch_no) for r in rows) == [(1, "prototypes.pt", 0), (1, "prototypes.pt", 1), (2, "5_2.pt", 0), (3, "prototypes.pt", 0)]
    assert len({r.vec_id for r in rows}) == 4
    both = banks.first_n(banks.with_prototypes(bank, protos, instead=False), 2).collect()
    assert sorted((r.class_id, r.file_key) for r in both) == [(1, "5_1.pt"), (1, "prototypes.pt"), (2, "5_2.pt"), (3, "prototypes.pt")]
    assert readers.prototypes(spark, str(tmp_path)).count() == 0


def test_support_masks_stay_unless_overwritten(spark, tmp_path):
    manifest = spark.createDataFrame([(1, "leaf", 7, "val/a.b.jpg", 2, 3, [4]), (1, "leaf", 8, "c.jpg", 2, 3, [5])], "class_id int, class_name string, image_id long, file_name string, height int, width int, ann_ids array<long>")
    refs = spark.createDataFrame([(7, "val/a.jpg")], "image_id long, relative_output_path string")
    runs = lambda *r: spark.createDataFrame([(7, 1, a, n) for a, n in r], "image_id long, class_id int, start long, len long")
    write = lambda r, **k: exports.support_masks(manifest, r, refs, str(tmp_path), "d", **k).collect()
    (item,) = write(runs((1, 2), (2, 2)))
    assert (item.image_path, item.mask_path, item.ann_ids) == ("reference_imgs/val/a.jpg", "reference_masks/leaf/val__a.b.png", [4])
    held = lambda: png.decode((tmp_path / item.mask_path).read_bytes()).ravel(order="F").tolist()
    assert held() == [0, 255, 255, 255, 0, 0]
    write(runs((0, 1)))
    assert held() == [0, 255, 255, 255, 0, 0]
    write(runs((0, 1)), overwrite=True)
    assert held() == [255, 0, 0, 0, 0, 0]
    categories = spark.createDataFrame([(2, "stem"), (1, "leaf")], "class_id int, class_name string")
    exports.support_protocol(spark.createDataFrame([item]), categories, str(tmp_path / "support_protocol.json"), {"dataset": "d"})
    found = json.loads((tmp_path / "support_protocol.json").read_text())
    assert found["class_vocabulary"] == [{"class_id": 1, "class_name": "leaf", "support_count": 1}, {"class_id": 2, "class_name": "stem", "support_count": 0}]
