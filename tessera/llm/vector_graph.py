"""Near-duplicate vectors by a robust-pruned flat graph.

Cluster centres are fitted on a bounded sample; every vector goes to the shards of its nearest centres (overlap). In each
shard candidates are pruned by the robust rule (an edge goes if a kept neighbour is, by the factor alpha, nearer to its
end than the vector is), adjacency lists of overlapping shards are united per vector, and every vector is then searched
from the shard's medoid and from itself: greedily until the beam is settled, then expanding every vector in range over all
edges, those that point to a vector as well as its own. Hits are verified by the cosine in double precision. A pair that shares
several shards is counted in the first of them, but one joined by an edge (an edge is the same in all shards, and such pairs are
as many as edges) is gathered from each that finds it and counted once. Beside these a shard gives out a count per vector and the
spanning links of its components: rows grow with vectors, not with pairs, and a task works on a bounded number of pairs at a time.

Recall is audited in every run: the links of up to AUDIT vectors, chosen by a hash, are counted by brute force against all
rows in blocks and compared with what was found. Below RECALL the search is repeated with twice the overlap, beam and slack.

Equal vectors are one class with a multiplicity. A shard above SHARD_ROWS classes is cut into blocks, and each pair of blocks
is a task: nothing is capped, and no task holds more than two blocks. Vectors of another length are in shards of their own.
Above CENTRES * SHARD_TARGET vectors a second codebook, of residuals, refines the shards; both codebooks have fixed bounds and
are the only data sent to all tasks.

Vectors are brought to a largest component between 1/2 and 1 by a power of two, which leaves cosines as they are and keeps
very small and very large ones from losing their norm.

Defined results: vectors that are null, zero, or that hold null or non-finite components link with nothing and are their
own component; vectors of different lengths do not link; rows that repeat a vec_id are separate vectors; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, table
from .graph import components

SAMPLE, CENTRES, SHARD_TARGET, SHARD_ROWS, OVERLAP = 20_000, 1024, 1000, 4000, 3
DEGREE, NEAREST, ALPHA, BEAM, SLACK = 24, 48, 1.2, 32, 0.04
AUDIT, RECALL, TRIES = 200, 0.9, 3
#: Queries searched at a time, and numbers gathered at a time (32 MB).
QUERIES_AT_ONCE, NUMBERS = 128, 1 << 22
_log = logging.getLogger(__name__)


def _centres(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Spherical k-means."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = np.concatenate([(x[i : i + 4096] @ c.T).argmax(axis=1) for i in range(0, len(x), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(size > 0, total / np.maximum(size, 1e-12), c)
    return c


def _shards(x: np.ndarray, first: np.ndarray, second: np.ndarray | None, overlap: int) -> np.ndarray:
    """Ids of the shards of each row, ascending."""
    if len(x) > 1024:
        return np.concatenate([_shards(x[i : i + 1024], first, second, overlap) for i in range(0, len(x), 1024)])
    a = np.argsort(-(x @ first.T), axis=1)[:, :overlap]
    if second is None:
        return np.sort(a, axis=1)
    out = []
    for k in range(a.shape[1]):
        rest = x - first[a[:, k]]
        d = (second**2).sum(axis=1)[None] - 2 * rest @ second.T
        out.append(a[:, k : k + 1].astype(np.int64) * len(second) + np.argsort(d, axis=1)[:, :2])
    return np.sort(np.concatenate(out, axis=1), axis=1)


def _pruned(x: np.ndarray) -> np.ndarray:
    """Adjacency (n, DEGREE), -1 padded, of unit rows: nearest candidates under the robust rule."""
    n = len(x)
    k = min(NEAREST, n - 1)
    out = np.full((n, DEGREE), -1, np.int32)
    if k < 1:
        return out
    for i in range(0, n, 512):
        sims = x[i : i + 512] @ x.T
        rows = np.arange(len(sims))
        sims[rows, i + rows] = -2
        near = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        near = np.take_along_axis(near, np.argsort(-np.take_along_axis(sims, near, 1), axis=1), 1)
        far = 2 - 2 * np.take_along_axis(sims, near, 1)  # squared distances, ascending
        inner = 2 - 2 * np.einsum("qad,qbd->qab", x[near], x[near])
        open_, taken = np.ones_like(far, bool), np.zeros(len(sims), int)
        for c in range(k):
            use = open_[:, c] & (taken < DEGREE)
            out[i + rows[use], taken[use]] = near[use, c]
            taken += use
            open_[use] &= ALPHA**2 * inner[use, c] > far[use]
    return out


def _dots(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows a and b, gathered in pieces."""
    step = max(1, NUMBERS // max(1, x.shape[1]))
    return np.concatenate([(x[a[i : i + step]] * x[b[i : i + step]]).sum(axis=1) for i in range(0, max(1, len(a)), step)])


def _ranged(x: np.ndarray, adjacency: np.ndarray, edges: tuple[np.ndarray, np.ndarray], start: int, queries: np.ndarray, at_least: float, wider: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) with inner product >= at_least that the search meets. The greedy phase follows adjacency (n, degree; -1
    padded), the expansion all edges: those of row i are edges[1][edges[0][i] : edges[0][i + 1]]."""
    q, n, rows, beam, slack = len(queries), len(x), np.arange(len(queries)), BEAM * wider, SLACK * wider
    first, ends = edges
    seen = np.zeros((q, n), bool)
    seen[:, start] = True
    ids = np.full((q, beam), -1, np.int32)
    sims = np.full((q, beam), -3.0)
    done = np.ones((q, beam), bool)
    ids[:, 0], sims[:, 0], done[:, 0] = start, x[queries] @ x[start], False
    hits = []

    def met(of: np.ndarray, row: np.ndarray, s: np.ndarray) -> None:
        near = s >= at_least - slack
        hits.append((of[near], row[near], s[near]))

    met(rows, np.full(q, start), sims[:, 0])
    while True:
        pick = np.where(done, -9.0, sims).argmax(axis=1)
        live = rows[~done[rows, pick]]
        if not len(live):
            break
        done[live, pick[live]] = True
        near = adjacency[ids[live, pick[live]]]
        fresh = (near >= 0) & ~seen[live[:, None], near]
        got = np.where(fresh, np.einsum("qrd,qd->qr", x[near], x[queries[live]]), -3.0)
        qq, rr = np.nonzero(fresh)
        seen[live[qq], near[qq, rr]] = True
        met(live[qq], near[qq, rr], got[qq, rr])
        all_s, all_i = np.concatenate([sims[live], got], 1), np.concatenate([ids[live], near], 1)
        all_d = np.concatenate([done[live], ~fresh], 1)
        top = np.argpartition(-all_s, beam - 1, axis=1)[:, :beam]
        sims[live], ids[live], done[live] = np.take_along_axis(all_s, top, 1), np.take_along_axis(all_i, top, 1), np.take_along_axis(all_d, top, 1)
    itself = rows[~seen[rows, queries]]
    seen[itself, queries[itself]] = True
    met(itself, queries[itself], np.ones(len(itself)))
    edge_q, edge_x, s = (np.concatenate(c) for c in zip(*hits, strict=True))
    found = [(edge_q[s >= at_least], edge_x[s >= at_least])]
    flat, slot = seen.reshape(-1), np.zeros(q * n, np.int32)
    while len(edge_q):  # every vector in range (or nearly) is expanded
        many = first[edge_x + 1] - first[edge_x]
        part, upcoming = np.cumsum(many) // (NUMBERS // 8), []
        for lo, hi in zip(*(lambda c: (c[:-1], c[1:]))(np.r_[0, np.flatnonzero(np.diff(part)) + 1, len(part)]), strict=True):
            from_, m = edge_x[lo:hi], many[lo:hi]
            near = ends[np.repeat(first[from_] - (np.cumsum(m) - m), m) + np.arange(m.sum())]
            key = np.repeat(edge_q[lo:hi], m).astype(np.int64) * n + near
            key = key[~flat[key]]
            slot[key] = np.arange(len(key))  # one of equal keys
            key = key[slot[key] == np.arange(len(key))]
            flat[key] = True
            qq, near = key // n, key % n
            s = _dots(x, near, queries[qq])
            found.append((qq[s >= at_least], near[s >= at_least]))
            upcoming.append((qq[s >= at_least - slack], near[s >= at_least - slack]))
        edge_q, edge_x = (np.concatenate(c) for c in zip(*upcoming, strict=True))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _scaled(rows: pd.Series) -> np.ndarray:
    """Rows brought to a largest component in [1/2, 1) by a power of two; rows are finite and not zero."""
    x = np.array(rows.tolist(), np.float64)
    x = x.reshape(len(rows), x.shape[1] if x.ndim > 1 else 0)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0))[1][:, None])


def _unit(rows: pd.Series) -> np.ndarray:
    x = _scaled(rows)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _linked_in_task(g: pd.DataFrame, percent: float, wider: int = 1) -> pd.DataFrame:
    """Partial link counts, pairs along edges that share further shards, and spanning links of one shard or pair of blocks."""
    shard, side = int(g["shard"].iloc[0]), g["side"].to_numpy()
    raw = _scaled(g["embedding"])
    norm = np.sqrt((raw**2).sum(axis=1))
    x = raw / norm[:, None]
    ids, mult, n = g["node"].to_numpy(), g["mult"].to_numpy(), len(g)
    shards = np.full((n, max(map(len, g["shards"]))), shard, np.int64)
    for i, a in enumerate(g["shards"]):
        shards[i, : len(a)] = a
    place = {v: i for i, v in enumerate(ids.tolist())}
    adjacency = [[place[v] for v in a if v in place] for a in g["near"].tolist()]
    local = np.full((n, max(1, *map(len, adjacency))), -1, np.int32)
    for i, a in enumerate(adjacency):
        local[i, : len(a)] = a
    middle = int((x @ x.mean(axis=0)).argmax())
    # links of the united lists run one way; the search may use them either way
    source, target = np.repeat(np.arange(n), [len(a) for a in adjacency]), np.array([j for a in adjacency for j in a], np.int64)
    key = np.unique(np.concatenate([source * n + target, target * n + source]))
    first, ends = np.searchsorted(key, np.arange(n + 1) * n), key % n
    back: dict[int, list[int]] = {}
    for i, j in zip(source.tolist(), target.tolist(), strict=True):
        back.setdefault(j, []).append(i)
    extra = np.full((n, DEGREE), -1, np.int32)  # a fixed degree for the greedy phase; the expansion has all
    for j, a in back.items():
        extra[j, : len(a[:DEGREE])] = a[:DEGREE]
    graph = np.concatenate([local, extra], axis=1)
    found = np.zeros((n, n), bool)  # a pair once, at the lesser row
    step = max(1, min(QUERIES_AT_ONCE, NUMBERS // (graph.shape[1] * max(1, x.shape[1]))))
    for i in range(0, n, step):
        queries = np.arange(i, min(n, i + step))
        q, r = _ranged(x, graph, (first, ends), middle, queries, percent - 1e-9, wider)
        found[np.minimum(queries[q], r), np.maximum(queries[q], r)] = True
    links, group, spans, shared = np.zeros(n, np.int64), np.arange(n), [], []
    for row in range(n):
        b = np.flatnonzero(found[row, row + 1 :]) + row + 1
        if side.min() != side.max():
            b = b[side[b] != side[row]]
        b = b[_dots(raw, np.full(len(b), row), b) / (norm[row] * norm[b]) >= percent]
        both = np.isin(shards[b], shards[row])
        near = np.isin(b, ends[first[row] : first[row + 1]]) & (both & (shards[b] != shard)).any(axis=1)
        mine = ~near & ~(both & (shards[b] < shard)).any(axis=1)
        links[row] += mult[b[mine]].sum()
        links[b[mine]] += mult[row]
        shared.append((np.full(near.sum(), row), b[near]))
        b = b[near | mine]
        other, at = np.unique(group[b], return_index=True)
        at, other = at[other != group[row]], other[other != group[row]]
        spans += [(row, int(k)) for k in b[at]]
        if len(other):
            group[np.isin(group, other)] = group[row]
    i, j = (np.concatenate(c) for c in zip(*shared, strict=True))
    i, j = np.where(ids[i] < ids[j], i, j), np.where(ids[i] < ids[j], j, i)
    some, (k, m) = np.flatnonzero(links), np.array(spans, np.int64).reshape(-1, 2).T
    # a count; rows of two nodes are links; of shared pairs n is what the link counts for node, m what it counts for other
    out = [(ids[some], ids[some], links[some], 0), (ids[k], ids[m], 0, 0), (ids[i], ids[j], mult[j], mult[i])]
    return pd.concat([pd.DataFrame(dict(zip(("node", "other", "n", "m"), c, strict=True)), dtype="int64") for c in out], ignore_index=True)


def _counted(linked: DataFrame) -> DataFrame:
    """(node, n): links of each node, a pair once whichever tasks found it."""
    pairs = linked.where("m > 0").dropDuplicates(["node", "other"])
    ends = pairs.select(F.explode(F.array(F.struct("node", "n"), F.struct(F.col("other").alias("node"), F.col("m").alias("n")))).alias("x")).select("x.*")
    return linked.where("node = other").select("node", "n").unionByName(ends).groupBy("node").agg(F.sum("n").alias("n"))


class RecallTooLow(RuntimeError):
    """The widest search missed too many of the audited links."""


def near_vectors(vectors: DataFrame, at_least: float = 0.9, vec_id: str = "vec_id", embedding: str = "embedding", audit: int = AUDIT, least: float = RECALL) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row. The audit's figures are logged; RecallTooLow is raised if the widest search
    stays below the least recall."""
    e = F.col("embedding")
    base = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"))
    fine = e.isNotNull() & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(e, lambda v: v != 0)
    rows = durable(base.withColumn("node", F.when(F.coalesce(fine, F.lit(False)), F.xxhash64("embedding"))), "vg-rows")
    classes = rows.where("node is not null").groupBy("node").agg(F.count("*").alias("mult"), F.min("vec_id").alias("rep"), F.first("embedding").alias("embedding"))
    classes = durable(classes.withColumn("dim", F.size("embedding")), "vg-classes")
    n = classes.count()
    for k in range(TRIES):
        found = durable(_searched(classes, n, at_least, 1 << k), "vg-found")
        if not audit or n < 2:
            break
        asked = classes.where(_chosen(n, audit)).select(F.col("node").alias("q"), F.col("embedding").alias("v"))
        every = classes.select(F.col("node").alias("r"), F.col("embedding").alias("v"), "mult")
        true = _counted_by_force(asked, every, n, 1, at_least).join(found.select(F.col("node").alias("q"), "n_links", "mult"), "q")
        seen = _recall(true.select("n", (F.col("n_links") - F.col("mult") + 1).alias("n_links"))).first()
        _log.info("recall audited on up to %d vectors: %s of %s links", 2 * audit, seen["found_links"], seen["true_links"])
        if not seen["true_links"] or seen["recall"] >= least:  # nothing to find, or enough found
            break
    else:
        raise RecallTooLow(f"{seen['found_links']} of {seen['true_links']} audited links after {TRIES} searches, below {least}: no result is given")
    alone = [F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")]
    linked = rows.where("node is not null").select("vec_id", "node").join(found, "node").select("vec_id", "n_links", F.col("low").alias("component_id"))
    out = linked.unionByName(rows.where("node is null").select("vec_id", *alone))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _chosen(n: int, audit: int) -> Column:
    """About audit of n classes, by a hash."""
    return F.xxhash64("node", F.lit(11)) < F.lit(min(2**63 - 1, int((2 * audit / max(1, n) - 1) * 2**63)))


def _codebooks(classes: DataFrame, n: int) -> dict[int, tuple[np.ndarray, np.ndarray | None]]:
    """Centres of shards and residuals per length of vectors, fitted on a sample below a hash bound. Lengths that the sample
    does not hold have one shard."""
    order = F.xxhash64("node", F.lit(3))
    near = classes if n <= 2 * SAMPLE else classes.where(order < F.lit(int((2.0 * (2 * SAMPLE / n) - 1) * 2**63)))
    taken = near.orderBy(order).limit(SAMPLE).select("dim", "embedding").toPandas()
    books = {}
    for dim, part in taken.groupby("dim"):
        sample, own = _unit(part["embedding"]), n * len(part) // len(taken)
        first, second = _centres(sample, max(1, min(CENTRES, own // SHARD_TARGET, len(sample)))), None
        if own > 4 * CENTRES * SHARD_TARGET:
            rest = sample - first[(sample @ first.T).argmax(axis=1)]
            pick = np.random.default_rng(5).choice(len(rest), min(len(rest), CENTRES, own // (CENTRES * SHARD_TARGET)), replace=False)
            second = rest[pick]
        books[int(dim)] = first, second
    return books


def _searched(classes: DataFrame, n: int, at_least: float, wider: int) -> DataFrame:
    """One search: (node, mult, n_links, low: least id of the component) per class."""
    own = classes.select("node", "mult", "rep")
    if n < 2:
        return own.select("node", "mult", (F.col("mult") - 1).alias("n_links"), F.col("rep").alias("low"))
    books = _codebooks(classes, n)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, x in batch.groupby("dim"):
                first, second = books.get(int(dim), (np.zeros((1, int(dim))), None))
                own = _shards(_unit(x["embedding"]), first, second, OVERLAP * wider) + (int(dim) << 32)
                yield pd.DataFrame({"node": x["node"], "mult": x["mult"], "embedding": x["embedding"], "shards": list(own)})

    dealt = classes.select("node", "mult", "embedding", "dim").mapInPandas(assign, "node long, mult long, embedding array<double>, shards array<long>")
    dealt = durable(dealt, "vg-shards")
    members = dealt.select("node", F.explode("shards").alias("shard"))
    counts = members.groupBy("shard").agg(F.count("*").alias("rows"))
    counts = counts.withColumn("blocks", F.ceil(F.col("rows") / SHARD_ROWS).cast("int"))
    block = F.pmod(F.xxhash64("node", "shard"), F.col("blocks")).cast("int")
    spread = dealt.withColumn("shard", F.explode("shards")).join(counts.select("shard", "blocks"), "shard").withColumn("block", block)

    def build(g: pd.DataFrame) -> pd.DataFrame:
        near = _pruned(_unit(g["embedding"]))
        ids = g["node"].to_numpy()
        return pd.DataFrame({"node": ids, "near": [ids[a[a >= 0]] for a in near]})

    built = spread.select("shard", "block", "node", "embedding").groupBy("shard", "block").applyInPandas(build, "node long, near array<long>")
    united = durable(built.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "vg-graph")  # OVERLAP lists a vector
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    pairs = spread.join(united, "node").withColumn("_o", other)
    tasks = pairs.select("shard", F.least("block", "_o").alias("i"), F.greatest("block", "_o").alias("j"), F.when(F.col("block") == F.col("_o"), 0).otherwise(F.when(F.col("block") < F.col("_o"), 1).otherwise(2)).alias("side"), "node", "mult", "embedding", "shards", "near")
    linked = durable(tasks.groupBy("shard", "i", "j").applyInPandas(lambda g: _linked_in_task(g, at_least, wider), "node long, other long, n long, m long"), "vg-links")
    links = _counted(linked)
    spans = components(linked.where("other <> node and m = 0").select("node", "other"), "node", "other").withColumnRenamed("node", "_n")
    grouped = own.join(spans, F.col("node") == F.col("_n"), "left").withColumn("root", F.coalesce("component", "node"))
    lowest = durable(grouped.groupBy("root").agg(F.min("rep").alias("low")), "vg-lowest")
    n_links = (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).cast("long")
    return grouped.join(lowest, "root").join(links, "node", "left").select("node", "mult", n_links.alias("n_links"), "low")


def _counted_by_force(asked: DataFrame, every: DataFrame, n: int, groups: int, at_least: float) -> DataFrame:
    """(q, n): the rows of every (r, v, mult; about n of them) in range of each of asked (q, v), in blocks; those with r = q
    are left out."""
    blocks = max(1, -(-n // 20_000))
    to = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    asked = asked.withColumn("_a", F.pmod(F.xxhash64("q"), F.lit(groups)).cast("int")).withColumn("_b", to(blocks))
    every = every.withColumn("_b", F.pmod(F.xxhash64("r"), F.lit(blocks)).cast("int")).withColumn("_a", to(groups))

    def whole(x: pd.DataFrame) -> pd.DataFrame:
        ok = [a is not None and len(a) > 0 and bool(np.isfinite(np.array(a, np.float64)).all() and np.any(a)) for a in x["v"]]
        return x[np.array(ok, bool)].reset_index(drop=True)

    def count(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        q, r = whole(q), whole(r)
        hits = np.zeros(len(q), np.int64)
        for dim in sorted(set(q["v"].map(len))):
            a, b = np.flatnonzero(q["v"].map(len) == dim), np.flatnonzero(r["v"].map(len) == dim)
            if len(b):
                other = q["q"].to_numpy()[a][:, None] != r["r"].to_numpy()[b][None]
                near = _unit(q["v"].iloc[a]) @ _unit(r["v"].iloc[b]).T >= at_least
                hits[a] += (near & other) @ r["mult"].to_numpy()[b]
        return pd.DataFrame({"q": q["q"], "n": hits})

    counted = asked.groupBy("_a", "_b").cogroup(every.groupBy("_a", "_b")).applyInPandas(count, "q long, n long")
    return counted.groupBy("q").agg(F.sum("n").alias("n"))


def _recall(both: DataFrame) -> DataFrame:
    """(true_links, found_links, recall) from (n, n_links) per query."""
    sums = both.agg(F.sum("n").alias("true_links"), F.sum(F.least("n_links", "n")).alias("found_links"))
    return sums.withColumn("recall", F.col("found_links") / F.greatest(F.col("true_links"), F.lit(1)))


def audit_recall(vectors: DataFrame, result: DataFrame, at_least: float = 0.9, every: int = 50, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(true_links, found_links, recall) over the stated query set vec_id % every = 0, brute-forced in blocks against all rows."""
    v, n = F.col(embedding).cast("array<double>").alias("v"), vectors.count()
    asked = vectors.where(F.col(vec_id) % every == 0).select(F.col(vec_id).alias("q"), v)
    rows = vectors.where(F.col(vec_id).isNotNull()).select(F.col(vec_id).alias("r"), v, F.lit(1).alias("mult"))
    true = _counted_by_force(asked, rows, n, max(1, n // (20_000 * every)), at_least)
    return _recall(true.join(result.select(F.col("vec_id").alias("q"), "n_links"), "q"))


def op8_vector_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


SQL = {
    "op8_vector_graph": """
with recursive v as (select vec_id, embedding::double[] e from embeddings),
f as (select vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) m from v where e is not null and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0),
l as (select a.vec_id a, b.vec_id b from f a join f b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) where a.m > 0 and b.m > 0 and list_inner_product(a.e, b.e) / (a.m * b.m) >= 0.9),
r as (select vec_id, vec_id c from v union select l.b, r.c from r join l on l.a = r.vec_id),
k as (select vec_id, min(c) component_id from r group by vec_id)
select v.vec_id, coalesce(n, 0)::bigint n_links, component_id, v.vec_id = component_id kept from v join k using (vec_id) left join (select a, count(*) n from l group by a) x on x.a = v.vec_id
"""
}
QUERIES = {"op8_vector_graph": op8_vector_graph}
