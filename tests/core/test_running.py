import random

from pyspark.sql import functions as F

from tessera.operators.running import Ranged, numbered, ranked


def test_scans_equal_a_walk_whatever_the_ranges(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, 1, 1, 1, 1, 2, 3]), rng.choice([None, 0.5, rng.random()]), k, rng.randrange(-5, 6)) for k in range(900)]
    table = spark.createDataFrame(rows, "g int, s double, k int, v long").repartition(5)
    ranged = Ranged(table, ("g",), (("s", True), ("k", False)), parts=7)
    assert ranged.rows.select("_part").distinct().count() > 1  # the large group is cut
    forward = ranged.scan(ranged.rows, total=("sum", F.col("v")), top=("max", F.col("v")))
    both = ranged.scan(ranged.scan(forward, backward=True, later=("max", F.col("v")), least=("min", F.col("v"))), own=False, before=("sum", F.col("v")))
    got = {r.k: (r.total, r.top, r.later, r.least, r.before) for r in both.collect()}
    want = {}
    for g in (None, 1, 2, 3):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is None, -(r[1] or 0), r[2]))
        v = [r[3] for r in own]
        for i, r in enumerate(own):
            want[r[2]] = (sum(v[: i + 1]), max(v[: i + 1]), max(v[i:]), min(v[i:]), sum(v[:i]))
    assert got == want


def test_places_and_dense_ids(spark):
    rows = spark.createDataFrame([(k % 2, -k % 50, k) for k in range(200)], "g int, s int, k int")
    got = {(r.g, r.rank) for r in ranked(rows, ("g",), (("s", False),)).collect()}
    assert got == {(g, i) for g in (0, 1) for i in range(1, 101)}  # equal rows get different places
    assert [r.id for r in numbered(rows, "s", "k").orderBy("s", "k").collect()] == list(range(1, 201))
    assert ranked(rows.where("false"), ("g",), (("s", False),)).count() == 0
