import random
from dataclasses import replace

import pytest

from tessera.plans.engine import Config, Engine


@pytest.fixture(scope="module")
def patches(spark):
    rng = random.Random(4)
    rows = [(i * 16 + k, i, (i + k) % 6, k, k // 4, k % 4, f"{i}_{(i + k) % 6}.pt", [rng.gauss(0, 1) + 2 * ((i + k) % 6 == d) for d in range(6)]) for i in range(12) for k in range(16)]
    rows += [(900, 90, 7, 0, 0, 0, "90_7.pt", [1.0] * 6), (901, 90, 7, 1, 0, 1, "90_7.pt", [1.0, 0.9, 1.0, 1.0, 1.0, 1.0])]  # a class of one image
    return spark.createDataFrame(rows, "vec_id long, image_id long, class_id int, patch_no int, row int, col int, file_key string, embedding array<double>").cache()


CONFIG = Config(method="absolute", filter="fixed", keep_threshold=0.1, sim_threshold=None, num_points=3, end_stage=3, grid=(4, 4), size=(4.0, 4.0))


def halves(patches):
    return patches.where("image_id % 2 = 0"), patches.where("image_id % 2 = 1").select("class_id", "image_id", "row", "col", "embedding")


def rows_of(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


class Dead(Exception):
    pass


def test_a_run_goes_on_class_by_class(spark, patches, tmp_path, monkeypatch):
    refs, queries = halves(patches)
    want = {k: rows_of(v) for k, v in Engine(CONFIG, str(tmp_path / "whole")).run(refs, queries).items()}
    engine, asked = Engine(CONFIG, str(tmp_path / "parts"), batches=2), []
    score, match = Engine.score, Engine.match

    def dying(self, bank, p):
        asked.append({r.class_id for r in bank.select("class_id").distinct().collect()})
        if len(asked) == 2:
            raise Dead
        return score(self, bank, p)

    monkeypatch.setattr(Engine, "score", dying)
    with pytest.raises(Dead):
        engine.run(refs, queries)
    done = {r.stage: r.classes for r in engine.progress(spark).collect()}
    assert done == {"bank": len(asked[0])}
    got = engine.run(refs, queries, resume=True)
    assert all(not a & asked[0] for a in asked[1:]) and set().union(*asked) == {0, 1, 2, 3, 4, 5, 7}
    assert {k: rows_of(v) for k, v in got.items()} == want
    total = {r.stage: (r.classes, r.rows) for r in engine.progress(spark).collect()}
    assert total["bank"] == (7, len(want["bank"])) and total["filtered"][1] == len(want["filtered"])

    # nothing is made again, and a run from a later stage makes nothing before it
    for name in ("score", "filter", "match"):
        monkeypatch.setattr(Engine, name, lambda *a: (_ for _ in ()).throw(Dead))
    assert {k: rows_of(v) for k, v in engine.run(refs, queries, resume=True).items()} == want
    late = Engine(replace(CONFIG, start_stage=4, end_stage=4), str(tmp_path / "parts"))
    inst = spark.createDataFrame([(1, 0, 5), (3, 2, 6)], "image_id long, class_id int, pixel int").selectExpr("image_id", "class_id", "0 inst", "pixel")
    monkeypatch.setattr(Engine, "evaluate", lambda self, prompts, *a: prompts.groupBy().count())
    assert set(out := late.run(refs, queries, inst)) == {"metrics"} and out["metrics"].first()[0] == len(want["prompts"])
    with pytest.raises(LookupError, match="prompts"):
        Engine(replace(CONFIG, start_stage=4, end_stage=4), str(tmp_path / "none")).run(refs, queries, inst)

    # without resume a run from stage 3 makes that stage anew and keeps those before
    monkeypatch.setattr(Engine, "match", match)
    third = Engine(replace(CONFIG, start_stage=3, end_stage=3), str(tmp_path / "parts")).run(refs, queries)
    assert {k: rows_of(v) for k, v in third.items()} == {"prompts": want["prompts"]}


def test_classes_asked_for_and_weights(spark, patches, tmp_path):
    refs, queries = halves(patches)
    engine = Engine(replace(CONFIG, filter="reweight", end_stage=2), str(tmp_path))
    some = engine.run(refs, queries, classes=spark.createDataFrame([(1,), (7,)], "class_id int"))
    assert {r.class_id for r in some["bank"].select("class_id").distinct().collect()} == {1, 7}
    assert all(0 <= r.weight <= 1 for r in some["weights"].collect())
    every = engine.run(refs, queries, resume=True)
    assert every["weights"].count() == every["bank"].count() > some["bank"].count()
    with pytest.raises(ValueError, match="early_accept"):
        Config(early_accept=True)
