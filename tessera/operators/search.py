"""Dense similarity joins. Rows are dealt in blocks per group, each pair of blocks is one task with a matrix product, and
partial results are aggregated: no task holds more than two blocks, whatever the size of a group."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import EPS, dot, norm

BLOCK = 4096
#: Rows of WIDTH numbers in a block of votes, bank and targets: a row is sent once per block of the other side.
VOTERS, TARGETS, WIDTH = 1 << 17, 1 << 16, 64
#: Rows of a product that votes holds at a time, and its columns.
TALL, WIDE = 1024, 512


def unit(x: np.ndarray) -> np.ndarray:
    """Unit rows as doubles."""
    x = np.asarray(x, np.float64)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), EPS)


def matrix(rows: pd.Series) -> np.ndarray:
    """Unit rows as doubles."""
    return unit(np.array(rows.tolist(), np.float64))


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    """A list column as a matrix."""
    c = column.combine_chunks()
    sizes = pc.unique(pc.list_value_length(c))
    if c.null_count or len(sizes) != 1:
        raise ValueError("embeddings that are null or of different lengths")
    return c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1)


def _single(x: np.ndarray) -> np.ndarray:
    """Unit rows as floats."""
    out = np.empty(x.shape, np.float32)
    for i in range(0, len(x), BLOCK):
        out[i : i + BLOCK] = unit(x[i : i + BLOCK])
    return out


def block_join(left: DataFrame, right: DataFrame, group: str | None, right_unit: str, kernel: Callable, schema: str, block: int | tuple[int, int] = BLOCK, arrow: bool = False) -> DataFrame:
    """kernel(left block, right block) for all pairs of blocks of each group, or of all rows if group is None. Rows of one
    right_unit stay together (a unit is an image: of bounded size). A kernel takes and gives pandas frames or, with arrow, Arrow
    tables; block is then in rows of WIDTH numbers."""
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    bl, br = block if isinstance(block, tuple) else (block, block)
    if group is None:
        nl, nr = (F.lit(max(1, -(-x.count() // n))) for x, n in ((left, bl), (right, br)))
        keys, a, b = ["_i", "_j"], left, right
    else:
        rows = F.sum(F.greatest(F.lit(1.0), F.size("embedding") / WIDTH)) if arrow else F.count("*")
        nl = left.groupBy(group).agg(F.ceil(rows / bl).cast("int").alias("_nl"))
        sizes = nl.join(right.groupBy(group).agg(F.ceil(rows / br).cast("int").alias("_nr")), group)
        keys, a, b, nl, nr = [group, "_i", "_j"], left.join(sizes, group), right.join(sizes, group), F.col("_nl"), F.col("_nr")
    a = a.withColumn("_i", F.pmod(F.xxhash64(*left.columns[:1]), nl).cast("int")).withColumn("_j", each(nr)).drop("_nl", "_nr")
    b = b.withColumn("_j", F.pmod(F.xxhash64(right_unit), nr).cast("int")).withColumn("_i", each(nl)).drop("_nl", "_nr")
    b = b.select(*[F.col(c).alias(c) for c in b.columns])  # both sides may come from one table
    names = [x.split()[0] for x in schema.split(",")]

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({n: [] for n in names})
        return kernel(x, y)[names]

    met = a.groupBy(*keys).cogroup(b.groupBy(*keys))
    return met.applyInArrow(kernel, schema) if arrow else met.applyInPandas(run, schema)


def _exact(x: np.ndarray, y: np.ndarray, inside: np.ndarray, sim_floor: float) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of x: whether it votes at its most similar row of y (the first of equals), and whether that is inside."""
    sims = np.round(unit(x) @ unit(y).T, 12)
    best = sims.argmax(axis=1)
    return sims[np.arange(len(x)), best] >= sim_floor, inside[best]


def _voted(x: np.ndarray, own: np.ndarray, y: np.ndarray, image: np.ndarray, inside: np.ndarray, sim_floor: float) -> tuple[np.ndarray, np.ndarray]:
    """(tp, fp) of each row of x. y: patches in order of image and patch.

    A vote is a hit if the largest similarity inside the class exceeds that outside. Products are of floats; where two
    numbers to be compared differ by less than these can be wrong by, the pair of vector and image is looked at in doubles."""
    starts = np.flatnonzero(np.r_[True, image[1:] != image[:-1]])
    sizes = np.diff(np.r_[starts, len(image)])
    within = np.add.reduceat(inside.astype(np.int64), starts)
    tp, fp = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    xt, flat = np.ascontiguousarray(_single(x).T), _single(y)
    unsure_by = 2 * (x.shape[1] + 8) * 2.0**-24
    for size, first in np.unique(np.stack([sizes, within], axis=1), axis=0).tolist():
        alike = np.flatnonzero((sizes == size) & (within == first))
        step, wide = max(1, TALL // size), max(64, min(WIDE, TALL * WIDE // size))
        for at in (alike[i : i + step] for i in range(0, len(alike), step)):
            rows = starts[at][:, None] + np.arange(size)
            rows = np.take_along_axis(rows, np.argsort(~inside[rows], axis=1, kind="stable"), axis=1)  # those inside first
            patches, ids, unsure = flat[rows.ravel()], image[starts[at]][:, None], []
            for c in range(0, len(x), wide):
                sims = (patches @ xt[:, c : c + wide]).reshape(len(at), size, -1)
                none = np.full((len(at), sims.shape[2]), -np.inf, np.float32)
                hit = sims[:, :first].max(axis=1) if first else none
                miss = sims[:, first:].max(axis=1) if first < size else none
                gap, top, other = hit - miss, np.maximum(hit, miss), own[c : c + wide] != ids
                sure = (np.abs(gap) > unsure_by) & (top > sim_floor + unsure_by) & other
                hits = np.count_nonzero(sure & (gap > 0), axis=0)
                tp[c : c + wide] += hits
                fp[c : c + wide] += np.count_nonzero(sure, axis=0) - hits
                i, k = np.nonzero(other & ~sure & ~(top < sim_floor - unsure_by))
                unsure.append((i, k + c))
            i, k = (np.concatenate(u) for u in zip(*unsure, strict=True))
            for one in np.unique(i):
                s, own_rows = starts[at[one]], k[i == one]
                for part in (own_rows[p : p + BLOCK] for p in range(0, len(own_rows), BLOCK)):
                    valid, good = _exact(x[part], y[s : s + size], inside[s : s + size], sim_floor)
                    tp[part] += valid & good
                    fp[part] += valid & ~good
    return tp, fp


def votes(bank: DataFrame, targets: DataFrame, sim_floor: float = 0.0) -> DataFrame:
    """(vec_id, class_id, tp, fp). bank: (vec_id, class_id, image_id, embedding); targets: (class_id, image_id, patch_no,
    inside, embedding). In every target image but its own a vector votes at its most similar patch (the first of equals):
    a hit if that patch lies inside the class, a miss if not, none below sim_floor."""

    def kernel(v: pa.Table, t: pa.Table) -> pa.Table:
        tp = fp = np.zeros(0, np.int64)
        if v.num_rows and t.num_rows:
            # Images by number: a vector's image may be null, and then is no target image.
            named = pa.chunked_array([*v["image_id"].chunks, *t["image_id"].chunks]).combine_chunks().dictionary_encode()
            number = pc.fill_null(named.indices, -1).to_numpy(zero_copy_only=False)
            own, t = number[: v.num_rows], t.append_column("_image", pa.array(number[v.num_rows :]))
            t = t.take(pc.sort_indices(t.drop_columns(["embedding"]), [("_image", "ascending"), ("patch_no", "ascending")]))
            inside = pc.fill_null(t["inside"], False).to_numpy()
            tp, fp = _voted(_vectors(v["embedding"]), own, _vectors(t["embedding"]), t["_image"].to_numpy(), inside, sim_floor)
        return pa.table({"vec_id": v["vec_id"].slice(0, len(tp)), "class_id": v["class_id"].slice(0, len(tp)), "tp": tp, "fp": fp})

    bank = bank.select(F.col("vec_id").cast("long"), F.col("class_id").cast("int"), "image_id", "embedding")
    targets = targets.select(F.col("class_id").cast("int"), F.col("image_id").cast(bank.schema["image_id"].dataType), "patch_no", "inside", "embedding")
    part = block_join(bank, targets, "class_id", "image_id", kernel, "vec_id long, class_id int, tp long, fp long", block=(VOTERS, TARGETS), arrow=True)
    return part.groupBy("vec_id", "class_id").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"))


def votes_sql(bank: DataFrame, targets: DataFrame, sim_floor: float = 0.0, part: int = 512) -> DataFrame:
    """The same votes as one declarative join: the twin that the block form is tested against. A class's bank is dealt in parts of
    about part rows, and vectors bring their doubles and norms, so that a pair costs one inner product."""
    parts = bank.groupBy("class_id").agg(F.ceil(F.count("*") / part).cast("int").alias("_n"))
    many = max(1, -(-bank.count() // part))
    doubles = lambda c: F.col(c).cast("array<double>")
    length = lambda c: F.greatest(norm(F.col(c)), F.lit(EPS))
    v = bank.select("vec_id", "class_id", F.col("image_id").alias("_own"), doubles("embedding").alias("_v")).withColumn("_a", length("_v"))
    v = v.join(parts, "class_id").withColumn("_p", F.pmod(F.xxhash64("vec_id"), F.col("_n")).cast("int")).drop("_n")
    t = targets.select("class_id", "image_id", "patch_no", "inside", doubles("embedding").alias("_e")).withColumn("_b", length("_e"))
    t = t.join(parts, "class_id").withColumn("_p", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n")
    v, t = (d.repartition(max(many, 4), "class_id", "_p") for d in (v, t))
    sims = v.join(t, ["class_id", "_p"]).where("image_id <> _own").withColumn("sim", dot(F.col("_v"), F.col("_e")) / (F.col("_a") * F.col("_b")))
    best = sims.groupBy("vec_id", "class_id", "image_id").agg(F.max(F.struct(F.round("sim", 12).alias("s"), -F.col("patch_no"))).alias("k"), F.max_by("inside", F.struct(F.round("sim", 12), -F.col("patch_no"))).alias("inside"))
    valid = F.col("k.s") >= sim_floor
    return best.groupBy("vec_id", "class_id").agg(F.sum(F.when(valid & F.col("inside"), 1).otherwise(0)).alias("tp"), F.sum(F.when(valid & ~F.col("inside"), 1).otherwise(0)).alias("fp"))


def best_similarity(queries: DataFrame, bank: DataFrame) -> DataFrame:
    """(class_id, image_id, row, col, sim): the largest cosine of each query cell to the bank of the class it is asked for.
    queries: (class_id, image_id, row, col, embedding); bank: (vec_id, class_id, embedding)."""

    def kernel(v: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        x, y = matrix(v["embedding"]), matrix(q["embedding"])
        best = np.concatenate([(y[i : i + 1024] @ x.T).max(axis=1) for i in range(0, len(y), 1024)])
        return q[["class_id", "image_id", "row", "col"]].assign(sim=best)

    part = block_join(bank.select("vec_id", "class_id", "embedding"), queries.select("class_id", "image_id", "row", "col", "embedding"), "class_id", "image_id", kernel, "class_id int, image_id long, row int, col int, sim double")
    return part.groupBy("class_id", "image_id", "row", "col").agg(F.max("sim").alias("sim"))


def other_similarity(queries: DataFrame, bank: DataFrame, margin: float = 0.0) -> DataFrame:
    """best_similarity less the largest cosine to the banks of all other classes and a margin (column conf).

    Blocks of the bank mix classes; the product with a block of cells is reduced per class, and of each cell only its two best
    classes in the block and the classes that it is asked for are given out. The two best classes over all blocks are among
    those: where a class reaches its maximum, at most one class of the two best exceeds it. Rows grow with cells and blocks of
    the bank, not with classes."""
    cells = queries.select("image_id", "row", "col", "class_id", "embedding").groupBy("image_id", "row", "col").agg(F.collect_set("class_id").alias("asked"), F.first("embedding").alias("embedding"))

    def kernel(v: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        v = v.sort_values("class_id", kind="stable")
        classes, starts = np.unique(v["class_id"].to_numpy(), return_index=True)
        x, y = matrix(v["embedding"]), matrix(q["embedding"])
        top = np.concatenate([np.maximum.reduceat(y[i : i + 1024] @ x.T, starts, axis=1) for i in range(0, len(y), 1024)])
        best = np.argsort(-top, axis=1, kind="stable")[:, :2]  # the lesser class of equal ones first
        place = {int(c): k for k, c in enumerate(classes)}
        picks = [sorted({*b, *(place[c] for c in own if c in place)}) for b, own in zip(best.tolist(), (map(int, o) for o in q["asked"]), strict=True)]
        at = np.repeat(np.arange(len(q)), [len(p) for p in picks])
        col = np.fromiter((k for p in picks for k in p), np.int64, len(at))
        return q[["image_id", "row", "col"]].iloc[at].assign(class_id=classes[col], sim=top[at, col])

    part = block_join(bank.select("vec_id", "class_id", "embedding"), cells.select("image_id", "row", "col", "asked", "embedding"), None, "image_id", kernel, "image_id long, row int, col int, class_id int, sim double")
    per = part.groupBy("image_id", "row", "col", "class_id").agg(F.max("sim").alias("sim"))
    found = per.groupBy("image_id", "row", "col").agg(F.max(F.struct("sim", (-F.col("class_id")).alias("c"))).alias("_one"), F.collect_list(F.struct("class_id", "sim")).alias("_all"))
    # A cell's list has its asked classes and two per block of the bank.
    second = F.array_max(F.transform(F.filter("_all", lambda a: a["class_id"] != -F.col("_one.c")), lambda a: a["sim"]))
    tops = found.select("image_id", "row", "col", F.col("_one.sim").alias("s1"), (-F.col("_one.c")).alias("c1"), F.coalesce(second, F.lit(0.0)).alias("s2"), F.explode("_all").alias("_a"))
    own = queries.select("class_id", "image_id", "row", "col")
    scored = tops.select("image_id", "row", "col", "s1", "c1", "s2", F.col("_a.class_id").alias("class_id"), F.col("_a.sim").alias("sim"))
    other = F.when(F.col("class_id") == F.col("c1"), F.col("s2")).otherwise(F.col("s1"))
    return own.join(scored, ["class_id", "image_id", "row", "col"]).select("class_id", "image_id", "row", "col", "sim", (F.col("sim") - other - F.lit(float(margin))).alias("conf"))


def self_similarity(bank: DataFrame) -> DataFrame:
    """(vec_id, class_id, image_id, sim): the largest cosine to any other vector of the same class and image, null without one.
    Blocks of an image's vectors are multiplied, a vector's product with itself is masked, and maxima are all that leaves."""
    keys = bank.select(F.concat_ws(":", F.col("class_id").cast("string"), F.col("image_id").cast("string")).alias("_g"), "vec_id", "class_id", "image_id", "embedding")

    def kernel(v: pd.DataFrame, o: pd.DataFrame) -> pd.DataFrame:
        x, y, mine, theirs = matrix(v["embedding"]), matrix(o["embedding"]), v["vec_id"].to_numpy(), o["vec_id"].to_numpy()
        best = np.concatenate([np.where(mine[i : i + 1024, None] == theirs, -np.inf, x[i : i + 1024] @ y.T).max(axis=1) for i in range(0, len(x), 1024)])
        return v[["vec_id", "class_id", "image_id"]].assign(sim=best)

    part = block_join(keys.select("vec_id", "class_id", "image_id", "embedding", "_g"), keys.select("vec_id", "embedding", "_g"), "_g", "vec_id", kernel, "vec_id long, class_id int, image_id long, sim double")
    found = F.when(F.col("sim") > float("-inf"), F.col("sim"))
    return part.groupBy("vec_id", "class_id", "image_id").agg(F.max(found).alias("sim"))
