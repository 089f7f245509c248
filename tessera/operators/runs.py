"""Mask algebra on runs: masks are relations (by..., start, len) of runs of column-major pixels, and set operations, areas, boxes
and overlaps are computed from run ends alone. A mask of a million pixels is as many rows as it has runs, never one per pixel.

A sweep over the sorted ends of all runs of a mask tells between any two ends which sides cover them. by are the columns that
name a mask (an image and a class, say); a mask lies in one image, so the ends of one are of bounded number.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from .geometry import by_group
from .masks import decode, encode_runs, union_runs

#: Pixels of a stretch in which runs of two relations meet.
STRETCH = 4096


def covered(by: tuple[str, ...], **sides: DataFrame) -> DataFrame:
    """(by..., start, len, and a count per side): the stretches between neighbouring ends that some side covers, each with how
    many of the side's runs lie over it. Equal ends have no stretch between them, so that one shuffle and one sort do."""
    ends = None
    for name in sides:
        at = lambda c, step: F.struct(c.cast("long").alias("start"), F.lit(step).cast("long").alias("step"))
        both = F.explode(F.array(at(F.col("start"), 1), at(F.col("start") + F.col("len"), -1)))
        one = sides[name].where("len > 0").select(*by, both.alias("_e"))
        one = one.select(*by, "_e.start", *[(F.col("_e.step") if n == name else F.lit(0).cast("long")).alias(n) for n in sides])
        ends = one if ends is None else ends.unionByName(one)
    order = Window.partitionBy(*by).orderBy("start")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    out = ends.select(*by, "start", (F.lead("start").over(order) - F.col("start")).alias("len"), *[F.sum(n).over(upto).alias(n) for n in sides])
    return out.where("len > 0").where(" or ".join(f"{n} > 0" for n in sides))


def merged(stretches: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """(by..., start, len): stretches that touch, as one. They do not overlap."""
    order = Window.partitionBy(*by).orderBy("start")
    new = F.coalesce((F.lag(F.col("start") + F.col("len")).over(order) != F.col("start")).cast("int"), F.lit(1))
    return stretches.withColumn("_new", new).withColumn("_g", F.sum("_new").over(order)).groupBy(*by, "_g").agg(F.min("start").alias("start"), F.sum("len").alias("len")).drop("_g")


def normal(runs: DataFrame, by: tuple[str, ...] = ("image_id", "class_id")) -> DataFrame:
    """Maximal disjoint runs (by..., start, len) of one relation's runs, which may overlap."""
    return union_runs(runs.where("len > 0"), by)


def union(a: DataFrame, b: DataFrame, by: tuple[str, ...] = ("image_id", "class_id")) -> DataFrame:
    return merged(covered(by, a=a, b=b), by)


def intersection(a: DataFrame, b: DataFrame, by: tuple[str, ...] = ("image_id", "class_id")) -> DataFrame:
    return merged(covered(by, a=a, b=b).where("a > 0 and b > 0"), by)


def difference(a: DataFrame, b: DataFrame, by: tuple[str, ...] = ("image_id", "class_id")) -> DataFrame:
    return merged(covered(by, a=a, b=b).where("a > 0 and b = 0"), by)


def algebra(a: DataFrame, b: DataFrame, by: tuple[str, ...] = ("image_id", "class_id")) -> DataFrame:
    """(op, by..., start, len): union, intersection (both) and difference (less) of two relations by one sweep."""
    ops = F.array(F.lit("union"), F.when(F.expr("a > 0 and b > 0"), "both"), F.when(F.expr("a > 0 and b = 0"), "less"))
    named = covered(by, a=a, b=b).select(F.explode(F.array_compact(ops)).alias("op"), *by, "start", "len")
    return merged(named, ("op", *by))


def counts(pred: DataFrame, truth: DataFrame, by: tuple[str, ...] = ("class_id",), on: tuple[str, ...] = ("image_id", "class_id")) -> DataFrame:
    """(by..., tp, fp, fn) pixels of two relations, each a union mask per on."""
    both = covered(on, p=pred, g=truth)
    part = lambda c: F.sum(F.when(F.expr(c), F.col("len")).otherwise(0))
    return both.groupBy(*by).agg(part("p > 0 and g > 0").alias("tp"), part("g = 0").alias("fp"), part("p = 0").alias("fn"))


def box(height: Column) -> dict[str, Column]:
    """Aggregates of a mask's disjoint runs: area and bounding box. A run within one column has its own rows, one over several
    columns touches the first and the last row."""
    first, last = F.floor(F.col("start") / height), F.floor((F.col("start") + F.col("len") - 1) / height)
    one = first == last
    top, low = F.when(one, F.col("start") % height).otherwise(0), F.when(one, (F.col("start") + F.col("len") - 1) % height).otherwise(height - 1)
    x, y = F.min(first), F.min(top)
    return {"area": F.sum("len"), "bbox_x": x, "bbox_y": y, "bbox_w": F.max(last) - x + 1, "bbox_h": F.max(low) - y + 1}


def area_bbox(runs: DataFrame, by: tuple[str, ...] = ("image_id", "class_id"), height: str = "height") -> DataFrame:
    """(by..., area, bbox_x, bbox_y, bbox_w, bbox_h) of disjoint runs."""
    return runs.groupBy(*by).agg(*[c.cast("long").alias(n) for n, c in box(F.col(height)).items()])


def _cut(runs: DataFrame, width: Column) -> DataFrame:
    """runs cut at multiples of width, with piece: the number of the stretch."""
    whole = F.sequence(F.floor(F.col("start") / width), F.floor((F.col("start") + F.col("len") - 1) / width))
    out = runs.where("len > 0").withColumn("piece", F.explode(whole)).withColumn("_s", F.greatest(F.col("start"), F.col("piece") * width))
    return out.withColumn("len", F.least(F.col("start") + F.col("len"), (F.col("piece") + 1) * width) - F.col("_s")).withColumn("start", F.col("_s")).drop("_s")


def pair_iou(a: DataFrame, b: DataFrame, by: tuple[str, ...] = ("image_id", "class_id")) -> DataFrame:
    """(by..., inst_a, inst_b, iou) of overlapping instances (by..., inst, start, len), the runs of each disjoint. Runs meet in
    the stretches that both reach and bring the sizes of their instances along."""
    keys, width, size = list(by), F.lit(STRETCH), F.sum("len").over(Window.partitionBy(*by, "inst"))
    side = lambda d, n: _cut(d.where("inst is not null").select(*keys, "inst", "start", "len", size.alias(f"n{n}")), width).select(*keys, "piece", F.col("inst").alias(f"inst_{n}"), f"n{n}", F.col("start").alias(f"s{n}"), (F.col("start") + F.col("len")).alias(f"e{n}"))
    met = side(a, "a").join(side(b, "b"), [*keys, "piece"]).where("sa < eb and sb < ea")
    inter = met.groupBy(*keys, "inst_a", "inst_b").agg(F.sum(F.least("ea", "eb") - F.greatest("sa", "sb")).alias("i"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    return inter.select(*keys, "inst_a", "inst_b", (F.col("i") / (F.col("na") + F.col("nb") - F.col("i"))).alias("iou"))


def merged_union(text: DataFrame, point: DataFrame, by: tuple[str, ...] = ("image_id", "class_id")) -> DataFrame:
    """(by..., start, len, score): both sides' pixels; the score of a mask is the greater of the two. Sides: (by..., start, len,
    score)."""
    best = text.unionByName(point).groupBy(*by).agg(F.max("score").alias("score"))
    return union(text, point, by).join(best, list(by))


def merged_intersection(text: DataFrame, point: DataFrame, by: tuple[str, ...] = ("image_id", "class_id")) -> DataFrame:
    """Pixels of both sides; the score is the lesser of the two sides' best."""
    best = text.groupBy(*by).agg(F.max("score").alias("_a")).join(point.groupBy(*by).agg(F.max("score").alias("_b")), list(by))
    return intersection(text, point, by).join(best.select(*by, F.least("_a", "_b").alias("score")), list(by))


def joined_columns(pieces: list[tuple[int, int, int]]) -> list[int]:
    """Numbers from 1, in order of first pieces, of the 4-connected components of pieces (column, first row, row after the last)."""
    order = sorted(range(len(pieces)), key=lambda i: pieces[i])
    root = list(range(len(pieces)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    columns: dict[int, list[int]] = {}
    for i in order:
        columns.setdefault(pieces[i][0], []).append(i)
    for c, own in columns.items():
        for i, j in zip(own, own[1:], strict=False):  # in one column: touching pieces
            if pieces[i][2] >= pieces[j][1]:
                root[find(j)] = find(i)
        left, k = columns.get(c - 1, []), 0
        for i in own:
            while k < len(left) and pieces[left[k]][2] <= pieces[i][1]:
                k += 1
            j = k
            while j < len(left) and pieces[left[j]][1] < pieces[i][2]:
                root[find(i)] = find(left[j])
                j += 1
    number: dict[int, int] = {}
    for i in order:
        number.setdefault(find(i), len(number) + 1)
    return [number[find(i)] for i in range(len(pieces))]


def merged_confidence(text: DataFrame, point: DataFrame, by: tuple[str, ...] = ("image_id", "class_id"), height: str = "height") -> DataFrame:
    """(by..., start, len, component, side, score): per 4-connected component of the union the side with the greater best score
    (text on a tie) keeps its pixels there. Sides: (by..., start, len, score, height). The score of a mask is the greatest of its
    components'."""
    kinds = {f.name: f.dataType.simpleString() for f in text.schema.fields}
    cut = lambda d: _cut(d.select(*by, "start", "len", "score", F.col(height).cast("long").alias("_h")), F.col("_h"))
    rows = covered((*by, "_h"), t=text.select(*by, "start", "len", F.col(height).cast("long").alias("_h")), p=point.select(*by, "start", "len", F.col(height).cast("long").alias("_h")))
    rows = _cut(rows, F.col("_h")).select(*by, F.col("_h").alias("h"), "piece", "start", "len", (F.col("t") > 0).alias("t"), (F.col("p") > 0).alias("p"), F.lit(None).cast("double").alias("score"))
    scored = lambda d, t: cut(d).select(*by, F.col("_h").alias("h"), "piece", "start", "len", F.lit(t).alias("t"), F.lit(not t).alias("p"), F.col("score").cast("double").alias("score"))
    rows = rows.unionByName(scored(text, True)).unionByName(scored(point, False))

    def choose(found: list[tuple]) -> list[tuple]:
        own, given = [r for r in found if r[6] is None], [r for r in found if r[6] is not None]
        spans = [(c, s - c * h, s - c * h + n) for h, c, s, n, *_ in own]
        number = joined_columns(spans)
        at = sorted((c, lo, hi, k) for (c, lo, hi), k in zip(spans, number, strict=True))
        places = [(c, lo) for c, lo, _, _ in at]
        best: dict[int, list[float]] = {}
        for h, c, s, _, t, _, score in given:  # a scored run lies in one component: the one of the stretch that it begins in
            k = at[int(np.searchsorted(np.array([x * h + lo for x, lo in places]), s, side="right")) - 1][3]
            b = best.setdefault(k, [0.0, 0.0])
            b[0 if t else 1] = max(b[0 if t else 1], score)
        top = max((max(b) for b in best.values()), default=0.0)
        out = []
        for (_, _, s, n, t, p, _), k in zip(own, number, strict=True):
            side = "point" if best.get(k, [0.0, 0.0])[1] > best.get(k, [0.0, 0.0])[0] else "text"
            if t if side == "text" else p:
                out.append((s, n, k, side, top))
        return out

    keys = ", ".join(f"{c} {kinds[c]}" for c in by)
    return by_group(rows, by, ("h", "piece", "start", "len", "t", "p", "score"), choose, f"{keys}, start long, len long, component int, side string, score double")


@udtf(returnType="start: bigint, len: bigint")
class MaskRuns:
    """Table function (segmentation, height, width) -> runs of a mask given as polygons or a run-length object in JSON; none where
    it cannot be read. For LATERAL joins: register(spark), then FROM annotations a, LATERAL mask_runs(a.segmentation, ...)."""

    def eval(self, segmentation: str, height: int, width: int):
        mask = decode(segmentation, height, width) if height and width else None
        if mask is not None:
            lengths = encode_runs(mask)
            ends = np.cumsum(lengths)
            for k in range(1, len(lengths), 2):
                yield int(ends[k] - lengths[k]), int(lengths[k])


def register(spark) -> None:
    spark.udtf.register("mask_runs", MaskRuns)
