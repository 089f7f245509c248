"""K-means of the bank's classes against a plain one."""

import numpy as np

from tessera.operators import bank, clusters
from tessera.plans import queries


def plain_inertia(m, k, tries=40, seed=0):
    rng, best = np.random.default_rng(seed), np.inf
    for _ in range(tries):
        c = m[[int(rng.integers(len(m)))]]
        while len(c) < k:
            d = ((m[:, None] - c) ** 2).sum(axis=2).min(axis=1)
            c = np.vstack([c, m[int(rng.choice(len(m), p=d / d.sum()))]])
        for _ in range(60):
            near = ((m[:, None] - c) ** 2).sum(axis=2).argmin(axis=1)
            c = np.array([m[near == i].mean(axis=0) if (near == i).any() else c[i] for i in range(k)])
        best = min(best, ((m[:, None] - c) ** 2).sum(axis=2).min(axis=1).sum())
    return best


def unit(m):
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def frame(spark, classes):
    rows, i = [], 0
    for c, m in classes.items():
        for v in m:
            rows.append((i, c, v.tolist()))
            i += 1
    return spark.createDataFrame(rows, "vec_id long, class_id int, embedding array<double>")


def test_inertia_is_within_two_percent_of_the_best_of_many_plain_fits(spark):
    rng = np.random.default_rng(7)
    far = np.eye(6)
    # sizes so uneven that most random starts take two rows of the first group and none of the last ones
    uneven = np.concatenate([np.repeat(0, 1500), np.repeat([1, 2, 3, 4], 12)])
    classes = {3: unit(far[uneven] + 0.03 * rng.normal(size=(len(uneven), 6))), 9: unit(rng.normal(size=(260, 6))), 11: unit(rng.normal(size=(60, 6)))}
    blocks, centres = clusters.fitted(frame(spark, classes))
    got = {r.class_id: (r.rows, r.inertia) for r in clusters.inertia(blocks, centres).collect()}
    for c, m in classes.items():
        assert got[c][0] == len(m)
        assert got[c][1] <= 1.02 * plain_inertia(m, clusters.cluster_count(len(m))) + 1e-9


def test_labels_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(1)
    rows = frame(spark, {1: unit(rng.normal(size=(700, 4)))})
    labels = lambda d: {r.vec_id: r.cluster for r in bank.with_clusters(d, rounds=1).collect()}
    assert labels(rows.repartition(7)) == labels(rows.coalesce(1))


def test_equal_rows_nulls_and_no_rows(spark):
    same = frame(spark, {1: np.tile([[1.0, 0.0]], (300, 1))})
    odd = spark.createDataFrame([(900, 1, None), (901, None, [1.0, 0.0])], same.schema)
    got = {r.vec_id: r.cluster for r in bank.with_clusters(same.unionByName(odd)).collect()}
    assert len(got) == 302 and got.pop(900) is None and got.pop(901) is None and set(got.values()) == {0}
    assert bank.with_clusters(same.where("false")).count() == 0


def test_column_and_plain_count_agree(spark):
    n = [1, 24, 199, 200, 562, 563, 1562, 1563, 10_000, 16_000, 10**9]
    rows = spark.createDataFrame([(x,) for x in n], "n long").select("n", clusters._count(clusters.F.col("n")).alias("k")).collect()
    assert {r.n: r.k for r in rows} == {x: clusters.cluster_count(x) for x in n}


def test_a_block_meets_its_own_class_only(spark):
    plan = clusters.sums(spark.createDataFrame([], "class_id int, k int, ids array<long>, vectors binary"), spark.createDataFrame([], clusters.CENTRES))
    assert "CartesianProduct" not in plan._jdf.queryExecution().executedPlan().toString()


def cells(centres):
    return {r.class_id: (r.k, np.array(r.centres)) for r in centres.collect()}


def test_a_bounded_class_takes_no_job_per_round(spark):
    rows = frame(spark, {c: unit(np.random.default_rng(c).normal(size=(400, 8))) for c in (1, 2)})
    jobs = []
    for rounds in (1, 300):
        spark.sparkContext.setJobGroup(f"rounds-{rounds}", "")
        clusters.fitted(rows, rounds=rounds)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"rounds-{rounds}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < jobs[0] == jobs[1] < 30


def test_classes_above_and_below_the_bound_have_the_same_centres(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = frame(spark, {1: unit(rng.normal(size=(900, 5))), 2: unit(rng.normal(size=(300, 5))), 3: unit(rng.normal(size=(30, 5)))})
    monkeypatch.setattr(clusters, "SLICE", 100)
    every = cells(clusters.fitted(rows, rounds=6)[1])
    assert set(every) == {1, 2, 3}
    for bound in (500 * clusters.LEAST_WIDTH, 0):  # the largest class by rounds, then all of them
        monkeypatch.setattr(clusters, "WHOLE", bound)
        got = cells(clusters.fitted(rows, rounds=6)[1])
        assert set(got) == set(every)
        for c, (k, at) in every.items():
            assert got[c][0] == k and np.allclose(got[c][1], at, atol=1e-9)


def test_kmeans_query_votes_in_every_target_image(spark, tmp_path):
    """130 images a class, past the 100 of the capped queries: each row's score is that of a plain loop over all of them."""
    rng = np.random.default_rng(11)
    n, label = 260 * 25, np.arange(260 * 25) // 50 % 2 + 1
    label[::25] = 3 - label[::25]  # both classes in every image
    m = unit(rng.normal(size=(n, 4)) + np.where(np.arange(n) < n // 2, 2.0, -2.0)[:, None] * np.eye(4)[label]).astype("<f4")
    spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(m, label, strict=True))], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    even = np.arange(n) // 25 % 2 == 0
    x, own = unit(m[even].astype(float)), (np.arange(n) // 25)[even]
    own_class, images = label[even], np.unique(own)
    tp, total = np.zeros(len(x)), np.zeros(len(x))
    for i in images:
        at = np.flatnonzero(own == i)
        best = np.round(x @ x[at].T, 12)
        near, fine = best.argmax(axis=1), (best.max(axis=1) >= 0) & (own != i)
        tp += fine & (own_class[at][near] == own_class)
        total += fine
    score = {int(v): t / k for v, t, k in zip(np.arange(n)[even], tp, total, strict=True) if k >= 3}
    got = {r.vec_id: r.score for r in queries.QUERIES["filter_clustered_kmeans"](spark, str(tmp_path)).collect()}
    assert len(images) == 130 and got
    assert all(abs(s - score[v]) < 1e-6 for v, s in got.items())
    sure = {v for v, s in score.items() if s >= queries.HIGH}
    assert len(sure - set(got)) <= 2 * 8 * 4  # only clusters below five rows go
