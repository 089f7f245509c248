"""Mask algebra on pixel and run relations, run-length codecs, merging of predictions."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .geometry import by_group, label_cells

#: ---- codecs -------------------------------------------------------------------------------------------------


def encode_runs(mask: np.ndarray) -> list[int]:
    """Counts of alternating zeros and ones, zeros first, of the mask in column-major order."""
    flat = mask.astype(bool).ravel(order="F")
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flat]))) if len(flat) else np.empty(0, int)
    return np.diff(np.concatenate([[0], edges, [len(flat)]])).astype(int).tolist()


def decode_runs(counts: list[int], height: int, width: int) -> np.ndarray:
    bits = np.repeat(np.arange(len(counts)) % 2, counts).astype(np.uint8)
    out = np.zeros(height * width, np.uint8)
    out[: len(bits)] = bits[: len(out)]
    return out.reshape((height, width), order="F")


def counts_to_text(counts: list[int]) -> str:
    """The compressed text form: from the fourth count on the difference to the count two before; groups of five bits, low
    first, a continuation bit, offset 48."""
    out = []
    for i, c in enumerate(counts):
        x = c - counts[i - 2] if i > 2 else c
        while True:
            group, x = x & 31, x >> 5
            more = not ((x == 0 and not group & 16) or (x == -1 and group & 16))
            out.append(chr(48 + (group | (32 if more else 0))))
            if not more:
                break
    return "".join(out)


def text_to_counts(text: str) -> list[int]:
    out: list[int] = []
    value = shift = 0
    for ch in text:
        c = ord(ch) - 48
        value |= (c & 31) << shift
        shift += 5
        if not c & 32:
            if c & 16:
                value -= 1 << shift
            out.append(value + (out[-2] if len(out) > 2 else 0))
            value = shift = 0
    return out


#: Steps per pixel at which a polygon's edges are walked: a fixed value of the COCO masks.
POLYGON_STEPS = 5


def _walked(x0: int, y0: int, x1: int, y1: int) -> tuple[np.ndarray, np.ndarray]:
    """Grid points of an edge, both ends included, one per step along its longer side; the other coordinate is rounded from the
    end at which the longer one is least."""
    dx, dy = abs(x1 - x0), abs(y1 - y0)
    t = np.arange(max(dx, dy) + 1)
    wide = dx >= dy
    flipped = x0 > x1 if wide else y0 > y1
    a, b = ((x1, y1), (x0, y0)) if flipped else ((x0, y0), (x1, y1))
    slope = ((b[1] - a[1]) / dx if wide else (b[0] - a[0]) / dy) if max(dx, dy) else 0.0
    long = a[0 if wide else 1] + t
    short = np.trunc(a[1 if wide else 0] + slope * t + 0.5).astype(int)
    xs, ys = (long, short) if wide else (short, long)
    return (xs[::-1], ys[::-1]) if flipped else (xs, ys)


def fill_polygon(flat: list[float], height: int, width: int) -> np.ndarray:
    """The polygon's mask by the COCO rule: edges are walked on a grid of POLYGON_STEPS per pixel; wherever the walk crosses the
    middle of a pixel column, membership changes from the pixel below the crossing on, column-major to the mask's end."""
    points = np.trunc(POLYGON_STEPS * np.array(flat, float)[: len(flat) // 2 * 2].reshape(-1, 2) + 0.5).astype(int)
    if not len(points):
        return np.zeros((height, width), np.uint8)
    edges = [_walked(*p, *q) for p, q in zip(points.tolist(), np.roll(points, -1, axis=0).tolist(), strict=True)]
    u, v = (np.concatenate([e[k] for e in edges]) for k in (0, 1))
    moved = np.flatnonzero(u[1:] != u[:-1]) + 1
    back = u[moved] < u[moved - 1]
    column = (np.where(back, u[moved], u[moved] - 1) + 0.5) / POLYGON_STEPS - 0.5
    row = (np.minimum(v[moved], v[moved - 1]) + 0.5) / POLYGON_STEPS - 0.5
    middle = (column == np.floor(column)) & (column >= 0) & (column <= width - 1)
    start = column[middle].astype(int) * height + np.ceil(np.clip(row[middle], 0, height)).astype(int)
    changes = np.bincount(start, minlength=height * width + 1)[: height * width]
    return (np.cumsum(changes) % 2).astype(np.uint8).reshape((height, width), order="F")


def decode(segmentation: str | None, height: int, width: int) -> np.ndarray | None:
    """Mask of raw JSON: polygons, or a run-length object with counts as list or text; None where it cannot be read."""
    try:
        s = json.loads(segmentation)
        if isinstance(s, dict):
            h, w = s.get("size", (height, width))
            counts = s["counts"]
            return decode_runs(counts if isinstance(counts, list) else text_to_counts(counts), h, w)
        out = np.zeros((height, width), np.uint8)
        for p in s:
            out |= fill_polygon(p, height, width)
        return out
    except (TypeError, ValueError, KeyError, IndexError):
        return None


def encode(mask: np.ndarray) -> dict:
    return {"size": list(mask.shape), "counts": counts_to_text(encode_runs(mask))}


def runs_of(annotations: DataFrame) -> DataFrame:
    """(image_id, class_id, ann_id, start, len) in column-major order, from annotations with raw segmentation, height, width.
    Rows that cannot be read give none."""

    def run(batches):
        for x in batches:
            out = []
            for image, cls, ann, seg, h, w in zip(x["image_id"], x["class_id"], x["ann_id"], x["segmentation"], x["height"], x["width"], strict=True):
                mask = decode(seg, int(h), int(w))
                if mask is not None:
                    counts = encode_runs(mask)
                    ends = np.cumsum(counts)
                    out += [(image, cls, ann, int(ends[k] - counts[k]), int(counts[k])) for k in range(1, len(counts), 2)]
            yield pd.DataFrame(out, columns=["image_id", "class_id", "ann_id", "start", "len"])

    return annotations.select("image_id", "class_id", "ann_id", "segmentation", "height", "width").mapInPandas(run, "image_id long, class_id int, ann_id long, start long, len long")


#: ---- relations ----------------------------------------------------------------------------------------------


def to_runs(pixels: DataFrame, by: tuple[str, ...] = ("image_id", "class_id"), pixel: str = "pixel") -> DataFrame:
    """Maximal runs of consecutive pixels. Equal pixels have one rank, so that one shuffle and one sort do."""
    island = F.col(pixel) - F.dense_rank().over(Window.partitionBy(*by).orderBy(pixel))
    length = F.coalesce(F.max(pixel) - F.min(pixel) + 1, F.lit(1)).cast("long")
    return pixels.select(*by, pixel).withColumn("_g", island).groupBy(*by, "_g").agg(F.min(pixel).alias("start"), length.alias("len")).drop("_g")


def to_pixels(runs: DataFrame) -> DataFrame:
    others = [c for c in runs.columns if c not in ("start", "len")]
    return runs.select(*others, F.explode(F.sequence(F.col("start"), F.col("start") + F.col("len") - 1)).alias("pixel"))


def union_runs(runs: DataFrame, by: tuple[str, ...] = ("image_id", "class_id")) -> DataFrame:
    """Union of overlapping or touching runs."""
    order = Window.partitionBy(*by).orderBy("start", "len")
    end = F.max(F.col("start") + F.col("len")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    out = runs.withColumn("_new", F.when(F.col("start") <= end, 0).otherwise(1)).withColumn("_g", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return out.groupBy(*by, "_g").agg(F.min("start").alias("start"), (F.max(F.col("start") + F.col("len")) - F.min("start")).alias("len")).drop("_g")


def merged_union(text: DataFrame, point: DataFrame, by: tuple[str, ...] = ("image_id", "class_id")) -> DataFrame:
    """(by..., pixel, score): union of both sides' pixels; the score of a mask is the greater of the two."""
    best = text.unionByName(point).groupBy(*by).agg(F.max("score").alias("score"))
    return text.select(*by, "pixel").union(point.select(*by, "pixel")).distinct().join(best, list(by))


def merged_intersection(text: DataFrame, point: DataFrame, by: tuple[str, ...] = ("image_id", "class_id")) -> DataFrame:
    """Pixels of both sides; the score is the lesser of the two sides' best. Nothing where a side is missing."""
    keys = list(by)
    best = text.groupBy(*by).agg(F.max("score").alias("_a")).join(point.groupBy(*by).agg(F.max("score").alias("_b")), keys)
    both = text.select(*keys, "pixel").distinct().join(point.select(*keys, "pixel").distinct(), [*keys, "pixel"])
    return both.join(best.select(*keys, F.least("_a", "_b").alias("score")), keys)


def merged_confidence(text: DataFrame, point: DataFrame, by: tuple[str, ...] = ("image_id", "class_id")) -> DataFrame:
    """Per 4-connected component of the union the side with the greater best score (text on a tie) keeps its pixels there.
    Sides: (by..., row, col, score). The score of a mask is the greatest of its components'."""
    keys = list(by)
    side = lambda d, n: d.groupBy(*keys, "row", "col").agg(F.max("score").alias(n))
    cells = side(text, "_t").join(side(point, "_p"), [*keys, "row", "col"], "full").where("row is not null and col is not null")

    def choose(rows: list[tuple]) -> list[tuple]:
        best: dict[int, list[float]] = {}
        comps = label_cells([x[0] for x in rows], [x[1] for x in rows], 4)
        known = [(t is not None, p is not None) for _, _, t, p in rows]
        for (_, _, t, p), (has_t, has_p), k in zip(rows, known, comps, strict=True):
            b = best.setdefault(k, [0.0, 0.0])
            b[0], b[1] = max(b[0], t if has_t else 0.0), max(b[1], p if has_p else 0.0)
        score = max(max(b) for b in best.values())
        out = []
        for (r, c, _, _), has, k in zip(rows, known, comps, strict=True):
            point = best[k][1] > best[k][0]
            if has[1 if point else 0]:
                out.append((r, c, k, "point" if point else "text", score))
        return out

    kinds = {f.name: f.dataType.simpleString() for f in cells.schema.fields}
    return by_group(cells, by, ("row", "col", "_t", "_p"), choose, ", ".join(f"{c} {kinds[c]}" for c in keys) + ", row int, col int, component int, side string, score double")


def pair_iou(a: DataFrame, b: DataFrame, by: tuple[str, ...] = ("image_id", "class_id")) -> DataFrame:
    """(by..., inst_a, inst_b, iou) of overlapping instances. a, b: (by..., inst, pixel). Pixels bring the sizes of their
    instances along."""
    keys, size = list(by), F.count("*").over(Window.partitionBy(*by, "inst"))
    side = lambda d, n: d.where("inst is not null").select(*keys, "pixel", F.col("inst").alias(f"inst_{n}"), size.alias(f"n{n}"))
    inter = side(a, "a").join(side(b, "b"), [*keys, "pixel"]).groupBy(*keys, "inst_a", "inst_b").agg(F.count("*").alias("inter"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    return inter.select(*keys, "inst_a", "inst_b", (F.col("inter") / (F.col("na") + F.col("nb") - F.col("inter"))).alias("iou"))


def nms_masks(instances: DataFrame, threshold: float = 0.5, by: tuple[str, ...] = ("image_id", "class_id")) -> DataFrame:
    """(by..., inst, score) kept greedily by score: one goes if its IoU with a kept one exceeds threshold (strictly).
    instances: (by..., inst, score, pixels array<long>); empty ones and those without a score are skipped."""
    instances = instances.where("score is not null and inst is not null and pixels is not null")
    kinds = {f.name: f.dataType.simpleString() for f in instances.schema.fields}

    def thin(rows: list[tuple]) -> list[tuple]:
        kept, sets = [], []
        for inst, score, pixels in sorted(rows, key=lambda x: (-x[1], x[0])):
            s = set(pixels)
            if s and all(len(s & k) <= threshold * len(s | k) for k in sets):
                kept.append((inst, score))
                sets.append(s)
        return kept

    return by_group(instances, by, ("inst", "score", "pixels"), thin, ", ".join(f"{c} {kinds[c]}" for c in (*by, "inst", "score")))


def area_bbox(pixels: DataFrame, by: tuple[str, ...] = ("image_id", "class_id")) -> DataFrame:
    """Area and [x, y, width, height] of pixels (by..., x, y)."""
    return pixels.groupBy(*by).agg(F.count("*").alias("area"), F.min("x").alias("bbox_x"), F.min("y").alias("bbox_y"), (F.max("x") - F.min("x") + 1).alias("bbox_w"), (F.max("y") - F.min("y") + 1).alias("bbox_h"))


def painted(objects: DataFrame, by: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """(by..., pixel, class_id): of the objects on a pixel the last painted (by depth rank, missing as 9999, then position)."""
    return objects.groupBy(*by, "pixel").agg(F.max_by("class_id", F.struct(F.coalesce("depth_rank", F.lit(9999)), F.col("pos"))).alias("class_id"))


def remapped(labels: DataFrame, mapping: DataFrame) -> DataFrame:
    """labels (..., label) with mapped: mapping (label, target), 0 where there is none."""
    return labels.join(mapping.select("label", F.col("target").alias("_t")), "label", "left").withColumn("mapped", F.coalesce("_t", F.lit(0))).drop("_t")


def normal_mask(mask: np.ndarray, height: int, width: int) -> np.ndarray:
    """A model's mask as 0/1 of the image's size: extra axes dropped, above 0 is 1, nearest-neighbour resize."""
    from .geometry import resized

    flat = (mask.reshape(mask.shape[-2:]) > 0).astype(np.uint8)
    return flat if flat.shape == (height, width) else resized(flat, height, width)


def label_instances(runs: DataFrame, allowed: tuple[int, int] = (1, 255), ignored: tuple[int, ...] = (255,), height: str = "height") -> DataFrame:
    """One annotation per (image_id, label) present: area and bounding box from column-major runs (image_id, label, start,
    len, height); ids are to be numbered by protocol.numbered."""
    from .runs import area_bbox as of_runs

    kept = runs.where(F.col("label").between(*allowed) & ~F.col("label").isin(*ignored))
    return of_runs(kept, ("image_id", "label"), height)
