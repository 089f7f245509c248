import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.sources import exports, json_documents, readers, writers
from tessera.sources.json_documents import elements, written


def made(seed, n):
    rng = random.Random(seed)
    odd = ['a "quoted" } text', "back\\slash", "\\\\}", "{[", "]}", "é ", "", "}" * 5, '"', "\\\""]
    item = lambda i: {"id": i, "name": rng.choice(odd), "poly": [[rng.random() for _ in range(rng.randrange(6))], []], "sub": {"x": {"y": rng.choice(odd)}, "e": {}}, "none": None}
    return {"info": {"year": 1, "by": {"who": "}"}}, "note": "images: [{", "images": [item(i) for i in range(n)], "empty": [], "numbers": [1, [2, {"no": 1}], 3], "annotations": [item(i) for i in range(2 * n)], "last": "}"}


@pytest.fixture
def small_blocks(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    yield lambda n: [spark.conf.set(k, v) for k, v in (("spark.sql.files.maxPartitionBytes", str(n)), ("spark.sql.files.openCostInBytes", "1"))]
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("block", (10**9, 700, 210))
def test_elements_of_a_document_cut_anywhere(spark, tmp_path, small_blocks, block):
    docs = [made(1, 12), made(2, 3)]
    for k, d in enumerate(docs):
        (tmp_path / f"{k}.json").write_text(json.dumps(d, indent=k or None, ensure_ascii=bool(k)) + "\n" * k, encoding="utf-8")
    small_blocks(block)
    for k, d in enumerate(docs):
        found = elements(spark, str(tmp_path / f"{k}.json"))
        got = {}
        for r in found.orderBy("block", "seq").collect():
            got.setdefault(r.key, []).append(json.loads(r.element))
        want = {key: [x for x in v if isinstance(x, dict)] for key, v in d.items() if isinstance(v, list)}
        assert got == {key: v for key, v in want.items() if v}
        if block < 1000 and not k:
            assert found.select("block").distinct().count() > 5


@pytest.mark.parametrize("block", (10**9, 150))
def test_top_level_arrays_and_broken_documents(spark, tmp_path, small_blocks, block):
    rows = [{"a": i, "t": "}]" * (i % 3)} for i in range(50)]
    cases = {"rows": json.dumps(rows), "spaced": "  [ ]\n", "none": "{}", "one": json.dumps(rows[:1]) + "\n"}
    small_blocks(block)
    for name, text in cases.items():
        (tmp_path / name).write_text(text)
        got = [json.loads(r.element) for r in elements(spark, str(tmp_path / name)).orderBy("block", "seq").collect()]
        assert got == (json.loads(text) or [])
    for name, text in {"cut": json.dumps(rows)[:-40], "string": '{"a": [{"b": "x}]}', "more": '[{"a": 1}]]}'}.items():
        (tmp_path / name).write_text(text)
        with pytest.raises(ValueError, match="no whole JSON document"):
            elements(spark, str(tmp_path / name))


def test_documents_are_written_in_parallel(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(type(spark.range(1)), "toLocalIterator", None)  # nothing passes through the driver
    many = spark.range(500).repartition(7).withColumn("t", F.concat(F.lit('é"}'), F.col("id").cast("string")))
    path = str(tmp_path / "out.json")
    written(path, [('{"a":[', many, "]"), (',"b":[', many.where("false"), "]"), (',"c":[', many.where("id < 3").coalesce(1), "]}")])
    got = json.loads((tmp_path / "out.json").read_text())
    assert sorted(x["id"] for x in got["a"]) == list(range(500)) and got["b"] == [] and len(got["c"]) == 3 and got["a"][0]["t"].startswith('é"}')
    rows = spark.createDataFrame([(2, "b.jpg", 1, 0.5), (1, "a.jpg", 1, 0.1), (1, "a.jpg", 1, 0.9)], "image_id long, file_name string, category_id int, score double")
    writers.predictions(rows, str(tmp_path / "lines"))
    exports.finalised(spark, str(tmp_path / "lines"), str(tmp_path / "p.json"))
    assert [(x["image_id"], x["score"]) for x in json.loads((tmp_path / "p.json").read_text())] == [(1, 0.9), (1, 0.1), (2, 0.5)]
    assert sorted((r.image_id, r.score) for r in readers.predictions(spark, str(tmp_path / "p.json")).collect()) == [(1, 0.1), (1, 0.9), (2, 0.5)]


def test_a_block_is_given_out_in_pieces(spark, tmp_path):
    (tmp_path / "many.json").write_text("[" + ", ".join(f'{{"a": {k}}}' for k in range(10_000)) + "]")
    segments = json_documents._blocks(spark, str(tmp_path / "many.json"))
    starts = json_documents._starts(segments)
    batches = list(json_documents._cut(iter([pa.RecordBatch.from_pandas(segments.toPandas())]), starts))
    assert len(batches) > 2 and max(b.num_rows for b in batches) <= json_documents.ROWS + 2
    assert [s for b in batches for s in b["seq"].to_pylist()] == list(range(10_001))
    got = json_documents.elements(spark, str(tmp_path / "many.json")).orderBy("block", "seq").collect()
    assert [r.element for r in got] == [f'{{"a": {k}}}' for k in range(10_000)]
