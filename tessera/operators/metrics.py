"""Evaluation: pixel metrics, average precision, point metrics, greedy matching. States are grouped tables and merge by union."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import ratio
from .running import Ranged


def pixel_counts(pred: DataFrame, gt: DataFrame, by: tuple[str, ...] = ("class_id",), on: tuple[str, ...] = ("image_id", "class_id", "pixel")) -> DataFrame:
    """(by..., tp, fp, fn) of two pixel relations (each a union mask; repeats count once)."""
    p = pred.select(*on).distinct().withColumn("_p", F.lit(1))
    g = gt.select(*on).distinct().withColumn("_g", F.lit(1))
    both = p.join(g, list(on), "full")
    hit, only_p, only_g = F.col("_p").isNotNull() & F.col("_g").isNotNull(), F.col("_g").isNull(), F.col("_p").isNull()
    return both.groupBy(*by).agg(*[F.sum(F.when(c, 1).otherwise(0)).alias(n) for c, n in ((hit, "tp"), (only_p, "fp"), (only_g, "fn"))])


def with_ratios(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1 and IoU, 0 where undefined."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumn("iou", ratio(tp, tp + fp + fn)).withColumn("precision", ratio(tp, tp + fp)).withColumn("recall", ratio(tp, tp + fn)).withColumn("f1", ratio(2 * tp, 2 * tp + fp + fn))


def global_metrics(counts: DataFrame) -> DataFrame:
    """Micro ratios over all classes; macro IoU over the classes with ground truth."""
    has = (F.col("tp") + F.col("fn")) > 0
    macro = F.coalesce(F.avg(F.when(has, ratio(F.col("tp"), F.col("tp") + F.col("fp") + F.col("fn")))), F.lit(0.0))
    total = counts.agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), macro.alias("miou"))
    return with_ratios(total)


def average_precision(records: DataFrame, gt_counts: DataFrame, by: str = "class_id", tie: str = "rec_id") -> DataFrame:
    """(by, gt_count, ap). records: (by, score, is_tp, tie); gt_counts: (by, gt_count). The precision envelope from the right
    times the steps of recall; 0 without records or ground truth.

    Running counts and the envelope are carried over ranges of a class's records (Ranged), so no task holds a whole class."""
    ranged = Ranged(records, (by,), (("score", True), (tie, False)))
    rows = ranged.scan(ranged.rows, _tp=("sum", F.col("is_tp")), _n=("sum", F.lit(1)))
    rows = ranged.scan(rows.withColumn("_p", F.col("_tp") / F.col("_n")), backward=True, _env=("max", F.col("_p")))
    area = rows.groupBy(by).agg(F.sum(F.when(F.col("is_tp") == 1, F.col("_env")).otherwise(F.lit(0.0))).alias("_a"))
    return gt_counts.join(area, by, "left").select(by, "gt_count", F.when(F.col("gt_count") > 0, F.coalesce("_a", F.lit(0.0)) / F.col("gt_count")).otherwise(F.lit(0.0)).alias("ap"))


def mean_ap(aps: DataFrame) -> DataFrame:
    return aps.agg(F.coalesce(F.avg(F.when(F.col("gt_count") > 0, F.col("ap"))), F.lit(0.0)).alias("map50"))


def dense_confusion(cells: DataFrame, predicted: Column, actual: Column) -> DataFrame:
    """TP, FP, TN, FN and ratios per class and over all (class_id null)."""
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    out = cells.rollup("class_id").agg(count(predicted & actual).alias("tp"), count(predicted & ~actual).alias("fp"), count(~predicted & ~actual).alias("tn"), count(~predicted & actual).alias("fn"))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return out.withColumn("precision", ratio(tp, tp + fp)).withColumn("recall", ratio(tp, tp + fn)).withColumn("f1", ratio(2 * tp, 2 * tp + fp + fn)).withColumn("accuracy", ratio(tp + tn, tp + fp + tn + fn))


def rounded_pixel(value: Column, size: Column) -> Column:
    """Half-even rounding, kept inside the image."""
    return F.least(F.greatest(F.bround(value, 0).cast("int"), F.lit(0)), size - 1)


def point_metrics(points: DataFrame, instances: DataFrame) -> DataFrame:
    """Per class: prompts, tp (points that hit an instance), fp, found and missed instances, ratios.
    points: (image_id, class_id, point_id, x, y, width, height); instances: (image_id, class_id, inst, px, py)."""
    placed = points.select("image_id", "class_id", "point_id", rounded_pixel(F.col("x"), F.col("width")).alias("px"), rounded_pixel(F.col("y"), F.col("height")).alias("py"))
    hits = placed.join(instances, ["image_id", "class_id", "px", "py"])
    tp = hits.select("image_id", "class_id", "point_id").distinct().groupBy("class_id").agg(F.count("*").alias("tp"))
    found = hits.select("image_id", "class_id", "inst").distinct().groupBy("class_id").agg(F.count("*").alias("found"))
    every = instances.select("image_id", "class_id", "inst").distinct().groupBy("class_id").agg(F.count("*").alias("gt"))
    n = points.groupBy("class_id").agg(F.count("*").alias("prompts"))
    out = every.join(n, "class_id", "full").join(tp, "class_id", "left").join(found, "class_id", "left").fillna(0)
    out = out.withColumn("fp", F.col("prompts") - F.col("tp")).withColumn("missed", F.col("gt") - F.col("found"))
    out = out.withColumn("precision", ratio(F.col("tp"), F.col("prompts"))).withColumn("recall", ratio(F.col("found"), F.col("gt")))
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).drop("gt")


def greedy_match(predictions: DataFrame, pairs: DataFrame, threshold: float = 0.5, by: tuple[str, ...] = ("image_id", "class_id")) -> DataFrame:
    """predictions (by..., inst_a, score) with is_tp: by score each takes the unmatched instance of greatest IoU, a hit from
    threshold on. pairs: (by..., inst_a, inst_b, iou) of overlapping ones; those below the threshold change nothing."""
    rows = predictions.join(pairs.where(F.col("iou") >= threshold), [*by, "inst_a"], "left")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    row = F.struct((-F.col("score")).alias("s"), "inst_a", (-F.col("iou")).alias("u"), "inst_b", "score")
    own = lambda x: F.struct(x["s"].alias("s"), x["inst_a"].alias("inst_a"))
    none = F.struct(F.array().cast(f"array<{kinds['inst_b']}>").alias("taken"), F.array().cast(f"array<struct<s:{rows.select(row['s']).dtypes[0][1]},inst_a:{kinds['inst_a']}>>").alias("hit"))

    def match(m: Column, x: Column) -> Column:
        free = ~F.array_contains(m["taken"], x["inst_b"]) & ~F.array_contains(m["hit"], own(x))
        return F.when(free, F.struct(F.array_append(m["taken"], x["inst_b"]).alias("taken"), F.array_append(m["hit"], own(x)).alias("hit"))).otherwise(m)

    groups = rows.groupBy(*by).agg(F.array_sort(F.collect_list(row)).alias("_r"))
    groups = groups.withColumn("_hit", F.aggregate(F.filter("_r", lambda x: x["inst_b"].isNotNull()), none, match, lambda m: m["hit"]))
    each = groups.select(*by, "_hit", F.explode(F.array_distinct(F.transform("_r", lambda x: F.struct(x["s"].alias("s"), x["inst_a"].alias("inst_a"), x["score"].alias("score"))))).alias("_p"))
    return each.select(*by, "_p.inst_a", "_p.score", F.array_contains("_hit", own(F.col("_p"))).cast("int").alias("is_tp"))


def merged_state(*states: DataFrame) -> DataFrame:
    """Counters of several evaluator states (class_id, tp, fp, fn) added up."""
    out = states[0]
    for s in states[1:]:
        out = out.unionByName(s)
    return out.groupBy("class_id").agg(*[F.sum(c).alias(c) for c in states[0].columns if c != "class_id"])


def class_table(counts: DataFrame, instances: DataFrame) -> DataFrame:
    """Classes with ground truth by number of instances, most first (then by class), with their ratios. counts: (class_id, tp,
    fp, fn); instances: (class_id, gt_instances)."""
    rows = with_ratios(counts).join(instances.where("gt_instances > 0"), "class_id")
    return rows.orderBy(F.desc("gt_instances"), "class_id")


def state(counts: DataFrame, records: DataFrame, gt_counts: DataFrame) -> DataFrame:
    """An evaluator's state as lines (kind, class_id, payload): pixel counters, scored records and ground-truth counts."""
    line = lambda rows, kind: rows.select(F.lit(kind).alias("kind"), "class_id", F.to_json(F.struct(*[c for c in rows.columns if c != "class_id"])).alias("payload"))
    return line(counts, "counts").unionByName(line(records, "records")).unionByName(line(gt_counts, "truth"))


def restored(states: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(counts, records, gt_counts) of the lines of one or more states: counters add up, records are put together and numbered
    anew by payload, so that a run may go on from any number of checkpoints."""
    part = lambda kind, shape: states.where(F.col("kind") == kind).select("class_id", F.from_json("payload", shape).alias("p")).select("class_id", "p.*")
    counts = part("counts", "tp long, fp long, fn long").groupBy("class_id").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    truth = part("truth", "gt_count long").groupBy("class_id").agg(F.sum("gt_count").alias("gt_count"))
    return counts, part("records", "score double, is_tp int, rec_id long"), truth
