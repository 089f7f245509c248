import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import refill
from tessera.sources.versions import Taken, Versions

POLICY = refill.Policy(target=5, every=2, gate=0.6, top_k=None, block=6)


def walked(base, available, candidates, targets, vectors, p):
    """One candidate after another, as plain loops over (image, score) lists."""

    def left(rows):
        scores = sorted(s for _, s in rows if s is not None)
        if not scores:
            return 0
        at = 0.75 * (len(scores) - 1)
        q = scores[int(at)] + (at - int(at)) * (scores[min(int(at) + 1, len(scores) - 1)] - scores[int(at)])
        return len({i for i, s in rows if s is not None and s >= min(p.high, max(p.low, p.factor * q))})

    out = {}
    for c, n in available.items():
        if n >= p.target:
            out[c] = ("done", n, 0, 0)
            continue
        if targets.get(c, 0) < p.least_targets:
            out[c] = ("insufficient_targets", n, 0, 0)
            continue
        rows, waiting, accepted, refilters = list(base.get(c, [])), 0, 0, 0
        for image in sorted(candidates.get(c, [])):
            if n >= p.target:
                break
            good = [(image, s) for s in vectors[c, image] if s is not None and s >= p.gate]
            if good:
                rows += good
                accepted, waiting = accepted + 1, waiting + 1
                if waiting >= p.every or n + waiting >= p.target:
                    n, waiting, refilters = left(rows), 0, refilters + 1
        if waiting:
            n, refilters = left(rows), refilters + 1
        out[c] = ("done" if n >= p.target else "exhausted", n, accepted, refilters)
    return out


@pytest.fixture(scope="module")
def case(spark):
    rng = random.Random(8)
    score = lambda: None if rng.random() < 0.1 else round(rng.random() ** rng.choice((0.3, 1, 2)), 4)
    base = {c: [(i, score()) for i in range(rng.randrange(4)) for _ in range(3)] for c in range(12)}
    candidates = {c: rng.sample(range(100, 160), rng.choice((0, 3, 11))) for c in range(11)}
    vectors = {(c, i): [score() for _ in range(rng.randrange(4))] for c, x in candidates.items() for i in x}
    available = {c: rng.choice((0, 1, 2, 5)) for c in range(12)}
    targets = {c: rng.choice((1, 2, 9, 9)) for c in range(11)}
    schema = "class_id int, image_id long, file_key string, patch_no int, vec_id long, tp long, fp long, score double"
    rows = lambda x: spark.createDataFrame([(c, i, f"{i}.pt", k, c * 10**6 + i * 1000 + k, 3, 0, s) for (c, i, k, s) in x], schema)
    scored = rows([(c, i, k, s) for (c, i), x in vectors.items() for k, s in enumerate(x)])
    frames = (
        rows([(c, i, k, s) for c, x in base.items() for k, (i, s) in enumerate(x)]), spark.createDataFrame(list(available.items()), "class_id int, n long"),
        spark.createDataFrame([(c, i) for c, x in candidates.items() for i in x], "class_id int, image_id long"), spark.createDataFrame(list(targets.items()), "class_id int, n long"),
    )
    return frames, lambda asked: scored.join(asked.select("class_id", "image_id"), ["class_id", "image_id"]), walked(base, available, candidates, targets, vectors, POLICY)


def found(run, entry):
    return {r.class_id: (r.state, r.n, r.accepted, r.refilters) for r in run.state(entry).collect()}


def test_equals_a_walk_and_refilters_change_acceptances(spark, case, tmp_path):
    frames, score, want = case
    run = refill.Refill(str(tmp_path), *frames, score, POLICY)
    entry = run.run()
    assert found(run, entry) == want
    assert {s for s, *_ in want.values()} == {"done", "exhausted", "insufficient_targets"}
    # some class refilters more than once and takes more than the target lacked at first
    assert any(r > 1 and a > 5 for _, _, a, r in want.values())
    left = {r.class_id: r.n for r in run.overlay(entry).groupBy("class_id").agg(F.countDistinct("image_id").alias("n")).collect()}
    assert all(left.get(c, 0) == n for c, (_, n, _, r) in want.items() if r)
    assert run.accepted(entry).groupBy("class_id").count().count() == sum(a > 0 for _, _, a, _ in want.values())
    low = {r.class_id: r.floor for r in run.floors(entry, frames[0].where("false"), frames[3].select("class_id", F.lit(0.7).alias("threshold"))).collect()}
    assert len(low) == 12 and all(low[c] in (0.65, 0.7) for c, (_, _, _, r) in want.items() if not r)


def test_goes_on_after_every_kind_of_death(spark, case, tmp_path, monkeypatch):
    frames, score, want = case
    steps = 0

    class Dead(Exception):
        pass

    def dying(asked):
        nonlocal steps
        steps += 1
        if steps % 2:
            raise Dead
        return score(asked)

    commit = Versions.commit

    def late(self, number, entry):  # the data are written, the entry is not
        nonlocal steps
        steps += 1
        if steps % 3 == 0:
            raise Dead
        commit(self, number, entry)

    monkeypatch.setattr(Versions, "commit", late)
    deaths = 0
    while True:
        run = refill.Refill(str(tmp_path), *frames, dying, POLICY)
        try:
            entry = run.run()
            break
        except Dead:
            deaths += 1
    assert deaths >= 3 and found(run, entry) == want
    monkeypatch.setattr(Versions, "commit", commit)
    assert run.versions.prune() > 0 and found(run, run.versions.latest()[1]) == want
    with pytest.raises(Taken):
        run.versions.commit(run.versions.latest()[0], {})


def test_a_state_of_another_rule_begins_anew(spark, case, tmp_path):
    frames, score, want = case
    run = refill.Refill(str(tmp_path), *frames, score, POLICY)
    run.run(rounds=1)
    assert "running" in {r.state for r in run.state(run.versions.latest()[1]).collect()}
    number, entry = run.versions.latest()
    run.versions.commit(number + 1, entry | {"rule": 1})
    assert run.run(rounds=0)["round"] == 0
    assert {r.state for r in run.state(run.versions.latest()[1]).collect()} == {"preparing_targets", "done", "insufficient_targets"}
