"""K-means per class over packed blocks: oversampled starts, then Lloyd rounds, all over every row of a class.

Rows are packed once into blocks (class_id, ids, vectors as bytes) of at most BLOCK rows. A class of at most WHOLE numbers is
fitted in one task, all rounds in memory. For larger classes each round is a job that joins the blocks with the centres of their
own class, so that a class with a third of all rows is only more blocks. Both ways draw the same rows and follow the same rule of
convergence. Nothing but counts comes to the driver; the centres sent to all tasks are those of larger classes only, of which
there are few by their size."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.stored import stored
from .search import matrix

BLOCK = 256
#: Numbers (rows times their width, counted as LEAST_WIDTH at least) of a class that one task fits: 32 MB as doubles.
WHOLE, LEAST_WIDTH = 1 << 22, 64
#: Rows of a class whose distances a task holds at a time.
SLICE = 4096
#: Parts in which a class's partial sums are added up first.
SALTS = 32
CENTRES = "class_id int, k int, centres array<array<double>>"


def cluster_count(n: int) -> int:
    """round(sqrt(n / 250)) between 2 and 8 and at most n / 25; 1 below 200."""
    return 1 if n < 200 else max(1, min(max(2, min(8, round((n / 250) ** 0.5))), max(1, n // 25)))


def _count(n: Column) -> Column:
    """cluster_count of a column."""
    some = F.greatest(F.lit(2), F.least(F.lit(8), F.round(F.sqrt(n / 250)).cast("int")))
    return F.when(n < 200, 1).otherwise(F.greatest(F.lit(1), F.least(some, F.floor(n / 25).cast("int")))).cast("int")


def packed(rows: DataFrame) -> DataFrame:
    """(class_id, k, ids, vectors): unit rows in blocks; k: the clusters that the class's size asks for. rows: (class_id int,
    vec_id, embedding); rows without an embedding are left out."""
    held = rows.where("embedding is not null and class_id is not null").select("class_id", F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    sizes = held.groupBy("class_id").agg(F.count("*").alias("_n"))
    dealt = held.join(sizes.select("class_id", _count(F.col("_n")).alias("k"), F.ceil(F.col("_n") / BLOCK).alias("_b")), "class_id")
    dealt = dealt.withColumn("_block", F.pmod(F.xxhash64("vec_id"), F.col("_b")))

    def pack(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("vec_id")
        return pd.DataFrame({"class_id": x["class_id"].iloc[:1], "k": x["k"].iloc[0], "ids": [x["vec_id"].tolist()], "vectors": [matrix(x["embedding"]).astype("<f4").tobytes()]})

    return dealt.groupBy("class_id", "_block").applyInPandas(pack, "class_id int, k int, ids array<long>, vectors binary")


def _rows(vectors: bytes, n: int) -> np.ndarray:
    return np.frombuffer(vectors, "<f4").reshape(n, -1).astype(np.float64)


def _distances(m: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centres."""
    return np.maximum((m**2).sum(axis=1)[:, None] - 2 * m @ c.T + (c**2).sum(axis=1), 0.0)


def _centres(cell) -> np.ndarray:
    return np.array([np.asarray(v, float) for v in cell])


def _tally(m: np.ndarray, c: np.ndarray) -> tuple:
    """(n, total, squares, cost) of rows, as in sums."""
    d = _distances(m, c)
    hot = np.eye(len(c))[d.argmin(axis=1)]
    return hot.sum(axis=0), (hot.T @ m).ravel(), (m**2).sum(), d.min(axis=1).sum()


def _added(tallies) -> tuple:
    return tuple(sum(x[1:], x[0]) for x in zip(*tallies, strict=True))


def _stepped(old: np.ndarray, n: np.ndarray, total: np.ndarray, squares: float, tolerance: float) -> tuple[np.ndarray, bool]:
    """The centres after a Lloyd round, and whether they moved. A centre without rows stays."""
    total = total.reshape(old.shape)
    mean = total.sum(axis=0) / n.sum()
    new = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], old)
    variance = (float(squares) / n.sum() - float(mean @ mean)) / old.shape[1]
    return new, bool(((new - old) ** 2).sum() > tolerance * max(variance, 0.0) + 1e-15)


def _summed(partial: DataFrame) -> DataFrame:
    """(class_id, n, total, squares, cost) added up per class: first in salted parts, so that no task adds more than a part."""

    def add(x: pd.DataFrame) -> pd.DataFrame:
        over = lambda c: np.sum(np.array([np.asarray(v, float) for v in x[c]]), axis=0).tolist()
        return pd.DataFrame({"class_id": x["class_id"].iloc[:1], "n": [over("n")], "total": [over("total")], "squares": x["squares"].sum(), "cost": x["cost"].sum()})

    shape = "class_id int, n array<double>, total array<double>, squares double, cost double"
    part = partial.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(SALTS))).groupBy("class_id", "_salt").applyInPandas(add, shape)
    return part.groupBy("class_id").applyInPandas(add, shape)


_TALLY = "n array<double>, total array<double>, squares double, cost double"


def _partial(blocks: DataFrame, centres: DataFrame) -> DataFrame:
    """sums per task and class, with the class's k and centres."""

    def run(batches):
        held, own = {}, {}
        for x in batches:
            for cls, k, ids, vectors, cell in zip(x["class_id"], x["k"], x["ids"], x["vectors"], x["centres"], strict=True):
                if cls not in own:
                    own[cls] = int(k), _centres(cell)
                new = _tally(_rows(vectors, len(ids)), own[cls][1])
                held[cls] = _added((held[cls], new)) if cls in held else new
        rows = [(int(c), own[c][0], own[c][1].tolist(), n.tolist(), t.tolist(), float(q), float(e)) for c, (n, t, q, e) in held.items()]
        yield pd.DataFrame(rows, columns=["class_id", "k", "centres", "n", "total", "squares", "cost"])

    met = blocks.select("class_id", "ids", "vectors").join(centres.select("class_id", "k", "centres"), "class_id")
    return met.select("class_id", "k", "ids", "vectors", "centres").mapInPandas(run, f"{CENTRES}, {_TALLY}")


def sums(blocks: DataFrame, centres: DataFrame) -> DataFrame:
    """(class_id, n, total, squares, cost) over all rows of the classes in centres: rows and their sum (flat) per nearest centre,
    sum of squares, and the sum of squared distances to the nearest centre."""
    return _summed(_partial(blocks, centres).drop("k", "centres"))


def _uniform(ids: np.ndarray, salt: int) -> np.ndarray:
    """A number in [0, 1) of each id: a fixed mix of its bits (splitmix64), so that reruns and lost tasks draw the same."""
    with np.errstate(over="ignore"):
        z = ids.astype(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) % 2**64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)


def _hits(m: np.ndarray, ids: np.ndarray, c: np.ndarray, k: int, cost: float, salt: int, over: float) -> np.ndarray:
    """Which rows a round of k-means|| takes."""
    d = _distances(m, c).min(axis=1)
    d[d < 1e-12] = 0.0
    return _uniform(ids, salt) * cost < over * k * d


def _one_per_class(blocks: DataFrame, seed: int) -> DataFrame:
    """centres of one row per class: that of the least draw."""

    def least(batches):
        held: dict = {}
        for x in batches:
            for cls, k, ids, vectors in zip(x["class_id"], x["k"], x["ids"], x["vectors"], strict=True):
                u = _uniform(np.asarray(ids), seed)
                i = int(u.argmin())
                found = float(u[i]), int(ids[i]), int(k), _rows(vectors, len(ids))[i].tolist()
                held[int(cls)] = min(held.get(int(cls), found), found)
        yield pd.DataFrame([(c, *v) for c, v in held.items()], columns=["class_id", "u", "vec_id", "k", "v"])

    got = blocks.mapInPandas(least, "class_id int, u double, vec_id long, k int, v array<double>")
    return got.groupBy("class_id").agg(F.min(F.struct("u", "vec_id", "k", "v")).alias("f")).select("class_id", "f.k", F.array("f.v").alias("centres"))


def starts(blocks: DataFrame, seed: int = 42, rounds: int = 5, over: float = 2.0) -> DataFrame:
    """CENTRES by k-means||: beginning with one row, each round takes every row with a chance of over * k times its share of the
    squared distances to the rows taken so far; the rows taken, weighted by how many rows are nearest to them, are then
    clustered per class (about 1 + rounds * over * k rows). A class with fewer distinct rows than k has as many centres."""
    taken = stored(_one_per_class(blocks, seed), "starts")
    for r in range(rounds):
        spread = stored(sums(blocks.where("k > 1"), taken).select("class_id", "cost"), "cost")

        def draw(batches, salt=seed + 1 + r):
            for x in batches:
                out = []
                for cls, k, ids, vectors, cell, cost in zip(x["class_id"], x["k"], x["ids"], x["vectors"], x["centres"], x["cost"], strict=True):
                    m, ids = _rows(vectors, len(ids)), np.asarray(ids)
                    hit = _hits(m, ids, _centres(cell), k, cost, salt, over)
                    out += [(int(cls), int(i), v.tolist()) for i, v in zip(ids[hit], m[hit], strict=True)]
                yield pd.DataFrame(out, columns=["class_id", "vec_id", "v"])

        met = blocks.where("k > 1").join(taken.select("class_id", "centres"), "class_id").join(spread, "class_id")
        drawn = met.select("class_id", "k", "ids", "vectors", "centres", "cost").mapInPandas(draw, "class_id int, vec_id long, v array<double>")
        more = drawn.groupBy("class_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "v"))), lambda s: s.v).alias("more"))
        taken = stored(taken.join(more, "class_id", "left").select("class_id", "k", F.concat("centres", F.coalesce("more", F.array().cast("array<array<double>>"))).alias("centres")), "starts")
    weighed = taken.where("k > 1").join(sums(blocks.where("k > 1"), taken).select("class_id", "n"), "class_id")

    def reduce(x: pd.DataFrame) -> pd.DataFrame:
        c, w, k = _centres(x["centres"].iloc[0]), np.asarray(x["n"].iloc[0], float), int(x["k"].iloc[0])
        return pd.DataFrame({"class_id": x["class_id"].iloc[:1], "k": k, "centres": [weighted(c, w, k, seed).tolist()]})

    return taken.where("k = 1").unionByName(weighed.groupBy("class_id").applyInPandas(reduce, CENTRES))


def weighted(c: np.ndarray, w: np.ndarray, k: int, seed: int, tries: int = 8, rounds: int = 50) -> np.ndarray:
    """At most k centres of few weighted rows: the best of several k-means++ starts with Lloyd rounds."""
    c, w = c[w > 0], w[w > 0]
    rng, best = np.random.default_rng(seed), (np.inf, c[:k])
    for _ in range(tries):
        own = [int(rng.choice(len(c), p=w / w.sum()))]
        while len(own) < k:
            chance = w * _distances(c, c[own]).min(axis=1)
            chance[own] = 0.0
            if chance.sum() <= 1e-12 * w.sum():
                break
            own.append(int(rng.choice(len(c), p=chance / chance.sum())))
        at = c[own].copy()
        for _ in range(rounds):
            near = _distances(c, at).argmin(axis=1)
            new = np.array([np.average(c[near == i], axis=0, weights=w[near == i]) if (near == i).any() else at[i] for i in range(len(at))])
            if np.allclose(new, at):
                break
            at = new
        cost = float((w * _distances(c, at).min(axis=1)).sum())
        if cost < best[0]:
            best = cost, at
    return best[1]


def lloyd(blocks: DataFrame, first: DataFrame, rounds: int = 300, tolerance: float = 1e-4) -> DataFrame:
    """CENTRES after Lloyd rounds over all rows of a class until its centres move, squared, by less than tolerance times the mean
    variance per dimension. A centre without rows stays. Settled classes are not read again. A round is one job: the sums of a
    task's rows, one row per class, and one shuffle of these."""

    def step(x: pd.DataFrame) -> pd.DataFrame:
        tallies = [(np.asarray(n, float), np.asarray(t, float), q) for n, t, q in zip(x["n"], x["total"], x["squares"], strict=True)]
        new, moved = _stepped(_centres(x["centres"].iloc[0]), *_added(tallies), tolerance)
        return pd.DataFrame({"class_id": x["class_id"].iloc[:1], "k": int(x["k"].iloc[0]), "centres": [new.tolist()], "moved": moved})

    now = stored(first.withColumn("moved", F.lit(True)), "centres")
    for _ in range(rounds):
        moving = now.where("moved")
        if moving.isEmpty():
            break
        new = _partial(blocks, F.broadcast(moving)).drop("cost").groupBy("class_id").applyInPandas(step, CENTRES + ", moved boolean")
        now = stored(now.where("not moved").unionByName(new), "centres")
    return now.drop("moved")


def fit(ids: np.ndarray, m: np.ndarray, k: int, seed: int, rounds: int, tolerance: float, draws: int = 5, over: float = 2.0) -> np.ndarray:
    """starts and lloyd of one class in memory: the same draws and the same rounds."""
    order = np.argsort(ids, kind="stable")
    ids, m = ids[order], m[order]
    parts = [slice(i, i + SLICE) for i in range(0, len(m), SLICE)]
    tally = lambda c: _added(_tally(m[p], c) for p in parts)
    u = _uniform(ids, seed)
    at = np.array([min(m[u == u.min()].tolist())])
    if k > 1:
        for r in range(draws):
            cost = tally(at)[3]
            hit = np.concatenate([_hits(m[p], ids[p], at, k, cost, seed + 1 + r, over) for p in parts])
            drawn = sorted(zip(ids[hit].tolist(), m[hit].tolist(), strict=True))
            at = np.array(at.tolist() + [v for _, v in drawn])
        at = weighted(at, tally(at)[0], k, seed)
    for _ in range(rounds):
        n, total, squares, _cost = tally(at)
        at, moved = _stepped(at, n, total, squares, tolerance)
        if not moved:
            break
    return at


def whole(blocks: DataFrame, seed: int = 42, rounds: int = 300, tolerance: float = 1e-4) -> DataFrame:
    """CENTRES of classes of at most WHOLE numbers, a class at a time in a task."""

    def run(x: pd.DataFrame) -> pd.DataFrame:
        ids = np.concatenate([np.asarray(i, np.int64) for i in x["ids"]])
        m = np.concatenate([_rows(v, len(i)) for i, v in zip(x["ids"], x["vectors"], strict=True)])
        k = int(x["k"].iloc[0])
        return pd.DataFrame({"class_id": x["class_id"].iloc[:1], "k": k, "centres": [fit(ids, m, k, seed, rounds, tolerance).tolist()]})

    # A given number of partitions is not merged: a merged one would fit its classes one after another.
    parts = max(64, -(-blocks.count() // 256))
    return blocks.repartition(parts, "class_id").groupBy("class_id").applyInPandas(run, CENTRES)


def assigned(blocks: DataFrame, centres: DataFrame) -> DataFrame:
    """(class_id, vec_id, cluster): the nearest centre of the row's class, the first of equals."""

    def run(batches):
        for x in batches:
            parts = [pd.DataFrame({"class_id": np.int32(cls), "vec_id": np.asarray(ids), "cluster": _distances(_rows(v, len(ids)), _centres(c)).argmin(axis=1).astype("int32")}) for cls, ids, v, c in zip(x["class_id"], x["ids"], x["vectors"], x["centres"], strict=True)]
            if parts:
                yield pd.concat(parts)

    met = blocks.join(centres.select("class_id", "centres"), "class_id").select("class_id", "ids", "vectors", "centres")
    return met.mapInPandas(run, "class_id int, vec_id long, cluster int")


def inertia(blocks: DataFrame, centres: DataFrame) -> DataFrame:
    """(class_id, rows, inertia): sum of squared distances to the nearest centre."""
    return sums(blocks, centres).select("class_id", F.aggregate("n", F.lit(0.0), lambda a, b: a + b).cast("long").alias("rows"), F.col("cost").alias("inertia"))


def fitted(rows: DataFrame, seed: int = 42, rounds: int = 300, tolerance: float = 1e-4) -> tuple[DataFrame, DataFrame]:
    """(blocks, centres) of the k-means of each class of rows (class_id, vec_id, embedding)."""
    blocks = stored(packed(rows), "blocks")
    width = F.greatest(F.length("vectors") / 4, F.size("ids") * LEAST_WIDTH)
    large = stored(blocks.groupBy("class_id").agg(F.sum(width).alias("_numbers")).where(F.col("_numbers") > WHOLE).select("class_id"), "large")
    if large.isEmpty():
        return blocks, stored(whole(blocks, seed, rounds, tolerance), "centres")
    few, many = (blocks.join(F.broadcast(large), "class_id", how) for how in ("left_anti", "left_semi"))
    return blocks, stored(whole(few, seed, rounds, tolerance).unionByName(lloyd(many, starts(many, seed), rounds, tolerance)), "centres")


def with_clusters(bank: DataFrame, seed: int = 42, rounds: int = 300, tolerance: float = 1e-4) -> DataFrame:
    """bank with a column cluster: the k-means cluster of the row in its class, null without class or embedding. A row is known
    by (class_id, vec_id); of rows that share both, all get one row's cluster. Labels are not comparable with those of other
    libraries; the rule of convergence and the greatest number of rounds are the reference's."""
    typed: Callable[[DataFrame], DataFrame] = lambda d: d.withColumn("class_id", F.col("class_id").cast("int"))
    bank = stored(typed(bank), "bank")
    own = assigned(*fitted(bank, seed, rounds, tolerance)).groupBy("class_id", "vec_id").agg(F.min("cluster").alias("cluster"))
    own = own.withColumn("vec_id", F.col("vec_id").cast(bank.schema["vec_id"].dataType))
    return bank.drop("cluster").join(own, ["class_id", "vec_id"], "left").select(*[c for c in bank.columns if c != "cluster"], "cluster")
