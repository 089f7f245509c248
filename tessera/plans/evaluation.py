"""From prompts to evaluated masks: what is asked of a mask model, its answers as runs, and their evaluation.

An image travels once, with all that is asked about it; masks stay runs from the model's answer to the metrics."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import masks, matching, metrics, runs
from ..operators.running import numbered
from .models import MaskModel

MODES = ("text", "point", "text_point")
PAIR = ("image_id", "class_id")
ANSWERS = (
    "image_id long, class_id int, cached boolean, points int, used_text_only_fallback boolean, combined_prediction_error boolean, "
    "masks array<struct<inst:int,score:double,runs:array<struct<start:long,len:long>>>>"
)


def requests(images: DataFrame, asked: DataFrame, prompts: DataFrame | None = None, cached: DataFrame | None = None, max_points: int | None = None) -> DataFrame:
    """(image_id, content, height, width, asked): a row per image with what is asked about it, by class.

    images: (image_id, content, height, width), those without content are left out; asked: (image_id, class_id, prompt), the
    classes to find in an image; prompts: (image_id, class_id, rank, x, y, score), of which the first max_points are used;
    cached: (image_id, class_id) of which prompts are known, be they none (by default the pairs in prompts)."""
    pairs = asked.select(*PAIR, "prompt")
    if prompts is None:
        pairs = pairs.withColumns({"cached": F.lit(False), "points": F.lit(None).cast("array<struct<rank:int,x:double,y:double,score:double>>")})
    else:
        used = prompts if max_points is None else matching.truncated(prompts, max_points)
        point = F.struct(F.col("rank").cast("int").alias("rank"), *[F.col(c).cast("double").alias(c) for c in ("x", "y", "score")])
        points = used.groupBy(*PAIR).agg(F.array_sort(F.collect_list(point)).alias("points"))
        known = (prompts if cached is None else cached).select(*PAIR).distinct().withColumn("cached", F.lit(True))
        pairs = pairs.join(known, list(PAIR), "left").join(points, list(PAIR), "left").withColumn("cached", F.coalesce("cached", F.lit(False)))
        pairs = pairs.withColumn("points", F.when(F.col("cached"), F.col("points")))
    each = pairs.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("class_id", "prompt", "cached", "points"))).alias("asked"))
    return images.where("content is not null").select("image_id", "content", "height", "width").join(each, "image_id")


def _answer(model: MaskModel, mode: str, content: bytes, prompt: str, points: list, height: int, width: int) -> tuple[list, bool, bool]:
    """(masks with scores, text alone was asked in place of points, the model failed on the points). Masks are in the size of the
    image; empty ones drop out."""

    def called(text: str, where: list) -> list:
        return [(masks.normal_mask(np.asarray(m), height, width), float(s)) for m, s in model(content, text, where)]

    def safe(text: str, where: list) -> list:
        try:
            return called(text, where)
        except Exception:
            return []

    at, there = [(p["x"], p["y"]) for p in points], lambda found: [(m, s) for m, s in found if m.any()]
    if mode == "text":
        found = safe(prompt, [])
        return there([(np.bitwise_or.reduce([m for m, _ in found]), max(s for _, s in found))] if found else []), False, False
    if mode == "point":
        own = [p["score"] for p in points]  # a mask takes the score of the point at its place among the masks that are left
        found = there(safe("", at) if at else [])
        return [(m, own[i] * s if i < len(own) and own[i] is not None else 0.0) for i, (m, s) in enumerate(found)], False, False
    if not at:
        return there(safe(prompt, [])), True, False
    try:
        return there(called(prompt, at)), False, False
    except Exception:
        return there(safe(prompt, [])), True, True


def predicted(asked: DataFrame, load: Callable[[], MaskModel], mode: str) -> DataFrame:
    """ANSWERS: a row per image and class of requests(), with the masks found. load() makes the model once per task.

    text: one mask, the union of those found for the prompt, with the model's best score. point: a mask per point, its score times the
    point's; pairs without known prompts are not asked. text_point: both together; the text alone where no points are known or
    the model fails on them. A model that fails otherwise finds nothing."""
    if mode not in MODES:
        raise ValueError(f"{mode!r} is not one of {MODES}")

    def spans(m: np.ndarray) -> list[dict]:
        counts = masks.encode_runs(m)
        ends = np.cumsum(counts)
        return [{"start": int(ends[k] - counts[k]), "len": int(counts[k])} for k in range(1, len(counts), 2)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for x in batches:
            for image, content, height, width, classes in zip(x["image_id"], x["content"], x["height"], x["width"], x["asked"], strict=True):
                out = []
                for a in classes:
                    points = list(a["points"]) if a["points"] is not None else []
                    found, fallback, error = ([], False, False) if mode == "point" and not a["cached"] else _answer(model, mode, content, a["prompt"], points, int(height), int(width))
                    out.append((image, a["class_id"], a["cached"], len(points), fallback, error, [{"inst": i, "score": s, "runs": spans(m)} for i, (m, s) in enumerate(found)]))
                yield pd.DataFrame(out, columns=[c.split()[0] for c in ANSWERS.split(", ")])

    return asked.mapInPandas(run, ANSWERS)


def mask_runs(answers: DataFrame) -> DataFrame:
    """(image_id, class_id, inst, score, start, len) of the masks found."""
    each = answers.select(*PAIR, F.explode("masks").alias("m")).select(*PAIR, "m.inst", "m.score", F.explode("m.runs").alias("r"))
    return each.select(*PAIR, "inst", "score", "r.start", "r.len")


def evaluated(answers: DataFrame, truth: DataFrame, mode: str, threshold: float = 0.5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(counts, records, gt_counts) as metrics.state takes them. truth: (image_id, class_id, inst, start, len), its runs disjoint.
    Pairs that were not asked (point mode without known prompts) are not evaluated; those asked without an answer miss all."""
    done = (answers.where("cached") if mode == "point" else answers).select(*PAIR).distinct()
    own = truth.join(done, list(PAIR), "left_semi")
    found = mask_runs(answers)
    counts = runs.counts(found, own)
    scores = answers.select(*PAIR, F.explode("masks").alias("m")).select(*PAIR, F.col("m.inst").alias("inst_a"), "m.score")
    hits = metrics.greedy_match(scores, runs.pair_iou(found, own), threshold)
    records = numbered(hits, *PAIR, "inst_a", name="rec_id").select("class_id", "score", "is_tp", "rec_id")
    instances = own.select(*PAIR, "inst").distinct().groupBy("class_id").agg(F.count("*").alias("gt_count"))
    return counts, records, instances


def counters(answers: DataFrame, mode: str) -> DataFrame:
    """One row: pairs, missing_prompts (pairs of which no prompts are known; 0 for text), text_only_fallbacks,
    combined_prediction_errors, skipped_prediction_errors (pairs with points that gave no mask in point mode)."""
    n = lambda c: F.coalesce(F.sum(F.expr(c).cast("long")), F.lit(0)).alias
    return answers.agg(
        F.count("*").alias("pairs"), n("not cached" if mode != "text" else "false")("missing_prompts"), n("used_text_only_fallback")("text_only_fallbacks"),
        n("combined_prediction_error")("combined_prediction_errors"), n("cached and points > 0 and size(masks) = 0" if mode == "point" else "false")("skipped_prediction_errors"),
    )


def missing_prompts(answers: DataFrame) -> DataFrame:
    """(class_id, missing): how often no prompts of a class were known."""
    return answers.where("not cached").groupBy("class_id").agg(F.count("*").alias("missing"))


def class_results(counts: DataFrame, records: DataFrame, gt_counts: DataFrame) -> DataFrame:
    """Per class with ground truth: pixel counts and ratios, instances, average precision."""
    aps = metrics.average_precision(records, gt_counts)
    return metrics.with_ratios(counts).join(aps, "class_id").where("gt_count > 0")


def saved(answers: DataFrame, images: DataFrame, names: DataFrame, mode: str) -> DataFrame:
    """Prediction lines (image_id, file_name, category_id, category, score, method, segmentation) of the masks found. images:
    (image_id, file_name, height, width); names: (class_id, class_name)."""

    @F.pandas_udf("string")
    def text(starts: pd.Series, lengths: pd.Series, height: pd.Series, width: pd.Series) -> pd.Series:
        def one(s, n, size):
            counts, at = [], 0
            for a, k in zip(s, n, strict=True):
                counts += [int(a) - at, int(k)]
                at = int(a) + int(k)
            return masks.counts_to_text(counts + ([size - at] if at < size else []))

        return pd.Series([one(s, n, int(h) * int(w)) for s, n, h, w in zip(starts, lengths, height, width, strict=True)])

    rows = answers.select(*PAIR, F.explode("masks").alias("m")).join(images, "image_id").join(names, "class_id")
    segmentation = F.struct(F.array("height", "width").cast("array<int>").alias("size"), text("m.runs.start", "m.runs.len", "height", "width").alias("counts"))
    return rows.select("image_id", "file_name", F.col("class_id").alias("category_id"), F.col("class_name").alias("category"), "m.score", F.lit(mode).alias("method"), segmentation.alias("segmentation"))
