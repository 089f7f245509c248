"""Manifests, k-shot lists, label mapping, resume sets, pairing."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import category_name, split_name, stem
from ..functions.vectors import ratio
from ..sources.stored import stored
from .running import numbered, ranked  # noqa: F401 (numbered is part of this module)

SHOTS = (1, 5, 20, 50, 100)


def annotated(annotations: DataFrame, images: DataFrame, categories: DataFrame) -> DataFrame:
    """annotations with their image and category name (cat_<id> where the category is unknown)."""
    im = images.withColumnRenamed("id", "image_id")
    cats = categories.select(F.col("id").alias("category_id"), F.col("name").alias("_n"))
    return annotations.join(im, "image_id").join(cats, "category_id", "left").withColumn("class_name", category_name(F.col("_n"), F.col("category_id"))).drop("_n")


def first_category(categories: DataFrame) -> DataFrame:
    """(name, category_id): the first category of each name in the table's order (column ord)."""
    return categories.groupBy("name").agg(F.min_by("id", "ord").alias("category_id"))


def valid_categories(annotations: DataFrame, not_exhaustive: DataFrame) -> DataFrame:
    """(image_id, category_id) without the image's not-exhaustive categories; images with none left drop out."""
    return annotations.select("image_id", "category_id").distinct().join(not_exhaustive.select("image_id", "category_id"), ["image_id", "category_id"], "left_anti")


def query_manifest(annotations: DataFrame, images: DataFrame) -> DataFrame:
    """One row per (class, image): file, split and sorted annotation ids."""
    rows = annotations.join(images, "image_id").groupBy("class_id", "image_id", "file_name").agg(F.array_sort(F.collect_list("ann_id")).alias("ann_ids"))
    return rows.withColumn("split", split_name(F.col("file_name")))


def counts_with_zero(categories: DataFrame, rows: DataFrame, key: str = "class_id", name: str = "n") -> DataFrame:
    return categories.select(key).join(rows.groupBy(key).agg(F.count("*").alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def support_manifest(annotations: DataFrame, images: DataFrame, categories: DataFrame, references: DataFrame) -> DataFrame:
    """Query manifest rows whose class is known and whose image is in the reference manifest."""
    return query_manifest(annotations.join(categories.select("class_id"), "class_id", "left_semi").join(references.select("class_id", "image_id").distinct(), ["class_id", "image_id"], "left_semi"), images)


def support_order(supports: DataFrame, quality: DataFrame) -> DataFrame:
    """supports (class_id, image_id) ranked within class: with scores first, then max, mean, median, file count, id."""
    q = quality.select("class_id", "image_id", "max_score", "mean_score", "median_score", "file_count", F.lit(True).alias("_q"))
    out = supports.join(q, ["class_id", "image_id"], "left").withColumn("has_scores", F.coalesce(F.col("max_score").isNotNull(), F.lit(False)))
    out = out.withColumn("selection_source", F.when(F.col("_q"), "filtered_bank").otherwise("prefilter_fallback")).drop("_q")
    order = tuple((c, True) for c in ("has_scores", "max_score", "mean_score", "median_score", "file_count"))
    return ranked(out, ("class_id",), (*order, ("image_id", False)), "rank_within_class")


def k_shots(ordered: DataFrame, shots: tuple[int, ...] = SHOTS) -> DataFrame:
    """Nested prefixes: for each shot and class with enough supports the first shot rows."""
    total = ordered.groupBy("class_id").agg(F.count("*").alias("total_available"))
    each = ordered.join(total, "class_id").withColumn("shot", F.explode(F.array(*[F.lit(s) for s in shots])))
    return each.where((F.col("total_available") >= F.col("shot")) & (F.col("rank_within_class") <= F.col("shot")))


def shot_validity(ordered: DataFrame, shots: tuple[int, ...] = SHOTS) -> DataFrame:
    """(shot, valid_classes, missing_classes)."""
    total = ordered.groupBy("class_id").agg(F.count("*").alias("n")).withColumn("shot", F.explode(F.array(*[F.lit(s) for s in shots])))
    return total.groupBy("shot").agg(F.sum(F.when(F.col("n") >= F.col("shot"), 1).otherwise(0)).alias("valid_classes"), F.sum(F.when(F.col("n") < F.col("shot"), 1).otherwise(0)).alias("missing_classes"))


def fill_candidates(training: DataFrame, pool: DataFrame, metrics: DataFrame, available: DataFrame, target: int) -> DataFrame:
    """Accepted candidate images, not yet in the pool, of the classes short of target."""
    short = available.where(F.col("n") < target).select("class_id")
    return training.join(short, "class_id", "left_semi").join(pool, ["class_id", "image_id"], "left_anti").join(metrics.where("accepted"), ["class_id", "image_id"])


def fill(available: DataFrame, candidates: DataFrame, target: int, refilter_every: int = 5) -> DataFrame:
    """(class_id, image_id, batch): candidates in id order up to the class's deficit, in refilter batches."""
    order = Window.partitionBy("class_id").orderBy("image_id")
    ranked = candidates.withColumn("_k", F.row_number().over(order)).join(available, "class_id")
    return ranked.where(F.col("_k") <= F.lit(target) - F.col("n")).select("class_id", "image_id", F.floor((F.col("_k") - 1) / refilter_every).cast("int").alias("batch"))


#: States of a class that is being filled, and the version of their records.
PENDING, RUNNING, DONE, EXHAUSTED, SHORT = "pending", "running", "done", "exhausted", "insufficient_targets"
STATE_VERSION = 1


def fill_to_shots(available: DataFrame, candidates: DataFrame, judge, target: int, batch: int = 5, least_targets: int = 2, state: DataFrame | None = None, rounds: int = 1000):
    """(taken, state): supports added until a class has target of them or no candidate is left.

    Each round takes the next batch candidates of every open class in id order, judges them
    (judge(rows) -> rows with a column accepted), and adds the accepted ones; with refiltering in between, see operators.refill.
    available:
    (class_id, n); candidates: (class_id, image_id). state: (class_id, state, n, seen, version) of an earlier run: classes go on
    after the candidates that were seen; records of another version begin anew. A class with fewer than least_targets
    candidates and supports together cannot be scored. The loop's data stay in tables; the driver sees counts."""
    order = Window.partitionBy("class_id").orderBy("image_id")
    placed = stored(ranked(candidates, ("class_id",), (("image_id", False),), "_k"))
    total = placed.groupBy("class_id").agg(F.max("_k").alias("total"))
    now = available.select("class_id", "n").join(total, "class_id", "left").fillna(0, ["total"]).withColumn("seen", F.lit(0))
    if state is not None:
        old = state.where(F.col("version") == STATE_VERSION).select("class_id", F.col("n").alias("_n"), F.col("seen").alias("_seen"))
        now = now.join(old, "class_id", "left").select("class_id", F.coalesce("_n", "n").alias("n"), "total", F.coalesce("_seen", "seen").alias("seen"))
    now, taken = stored(now), candidates.select("class_id", "image_id").limit(0)
    for _ in range(rounds):
        open_ = now.where((F.col("n") < target) & (F.col("seen") < F.col("total")) & (F.col("n") + F.col("total") >= least_targets))
        asked = placed.join(open_.select("class_id", "seen"), "class_id").where((F.col("_k") > F.col("seen")) & (F.col("_k") <= F.col("seen") + batch)).select("class_id", "image_id")
        if asked.isEmpty():
            break
        good = judge(asked).where("accepted").select("class_id", "image_id")
        room = now.select("class_id", (F.lit(target) - F.col("n")).alias("_room"))
        good = stored(good.withColumn("_g", F.row_number().over(order)).join(room, "class_id").where("_g <= _room").select("class_id", "image_id"))
        taken = taken.unionByName(good)
        more = good.groupBy("class_id").agg(F.count("*").alias("_more"))
        step = open_.select("class_id", F.lit(batch).alias("_step"))
        moved = [(F.col("n") + F.coalesce("_more", F.lit(0))).alias("n"), "total", F.least(F.col("seen") + F.coalesce("_step", F.lit(0)), F.col("total")).alias("seen")]
        now = stored(now.join(more, "class_id", "left").join(step, "class_id", "left").select("class_id", *moved))
    word = F.when(F.col("n") >= target, DONE).when(F.col("n") + F.col("total") < least_targets, SHORT).when(F.col("seen") >= F.col("total"), EXHAUSTED).when(F.col("seen") > 0, RUNNING).otherwise(PENDING)
    return taken, now.select("class_id", word.alias("state"), "n", "seen", F.lit(STATE_VERSION).alias("version"))


def confusion(rows: DataFrame, raw: str, ref: str) -> DataFrame:
    return rows.groupBy(F.col(raw).alias("raw"), F.col(ref).alias("ref")).agg(F.count("*").alias("n"))


def label_mapping(counts: DataFrame, low_purity: float = 0.95, top: int = 5) -> DataFrame:
    """Per raw label the most frequent reference (least on a tie), purity and the top targets."""
    order = Window.partitionBy("raw").orderBy(F.desc("n"), "ref")
    ranked = counts.withColumn("_k", F.row_number().over(order)).withColumn("_all", F.sum("n").over(Window.partitionBy("raw")))
    out = ranked.where(F.col("_k") <= top).groupBy("raw").agg(F.max(F.when(F.col("_k") == 1, F.col("ref"))).alias("target"), F.max("_all").alias("total"), F.max(F.when(F.col("_k") == 1, F.col("n"))).alias("_n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", "ref"))), lambda x: x["ref"].cast("string")), ",").alias("top_targets"))
    out = out.withColumn("purity", F.col("_n") / F.col("total")).drop("_n")
    return out.withColumn("low_confidence", F.col("purity") < low_purity)


def low_confidence(mapping: DataFrame) -> DataFrame:
    """The mapping's uncertain labels, least pure first, with their rank."""
    order = Window.orderBy("purity", "raw")  # as many rows as there are labels
    return mapping.where("low_confidence").withColumn("rank", F.row_number().over(order))


def mismatches(rows: DataFrame, mapping: DataFrame, raw: str, ref: str, order: list[str], n: int = 50) -> DataFrame:
    """The first n rows (a report's examples) whose mapped label differs from the reference."""
    m = mapping.select(F.col("raw").alias(raw), F.col("target").alias("mapped"))
    joined = rows.join(m, raw, "left").withColumn("mapped", F.coalesce("mapped", F.lit(0)))
    return joined.where(F.col("mapped") != F.col(ref)).orderBy(*order).limit(n)


def mapping_validation(rows: DataFrame, mapping: DataFrame, raw: str, ref: str, by: str) -> DataFrame:
    """Pixel accuracy, exact-match share over groups, mean IoU of the references seen, and unseen raw labels."""
    m = mapping.select(F.col("raw").alias(raw), F.col("target").alias("_m"))
    joined = rows.join(m, raw, "left").withColumn("_ok", F.coalesce(F.col("_m") == F.col(ref), F.lit(False)))
    per = joined.groupBy(by).agg(F.bool_and("_ok").alias("exact"), F.count("*").alias("n"), F.sum(F.col("_ok").cast("long")).alias("ok"))
    total = per.agg(F.sum("n").alias("pixels"), (F.sum("ok") / F.sum("n")).alias("pixel_accuracy"), F.avg(F.col("exact").cast("double")).alias("exact_match_rate"))
    inter = joined.where("_ok").groupBy(F.col(ref).alias("c")).agg(F.count("*").alias("i"))
    a, b = joined.groupBy(F.col(ref).alias("c")).agg(F.count("*").alias("a")), joined.where("_m is not null").groupBy(F.col("_m").alias("c")).agg(F.count("*").alias("b"))
    iou = a.join(inter, "c", "left").join(b, "c", "left").fillna(0).select((F.col("i") / (F.col("a") + F.col("b") - F.col("i"))).alias("iou")).agg(F.avg("iou").alias("mean_iou"))
    unseen = rows.select(raw).distinct().join(m, raw, "left_anti").agg(F.count("*").alias("unseen_labels"))
    return total.crossJoin(iou).crossJoin(unseen)  # one row each


def holdout_split(stems: list[str], ratio_: float = 0.2, seed: int = 20260324) -> tuple[list[str], list[str]]:
    """(derive, holdout): a seeded shuffle on the driver; max(1, round(n * ratio)) are held out."""
    order = sorted(stems)
    random.Random(seed).shuffle(order)
    n = max(1, round(len(order) * ratio_))
    return sorted(order[n:]), sorted(order[:n])


def paired(images: DataFrame, masks: DataFrame) -> DataFrame:
    """(stem, image_path, mask_path) by stem, full outer: a missing side is null."""
    return images.select(stem(F.col("path")).alias("stem"), F.col("path").alias("image_path")).join(masks.select(stem(F.col("path")).alias("stem"), F.col("path").alias("mask_path")), "stem", "full")


def zipped(objects: Column, instances: Column) -> Column:
    """Positional pairs of two arrays, as long as the shorter."""
    n = F.least(F.size(objects), F.size(instances))
    return F.arrays_zip(F.slice(objects, F.lit(1), n).alias("object"), F.slice(instances, F.lit(1), n).alias("instance"))


def merged_resume(checkpoint: DataFrame, scanned: DataFrame) -> DataFrame:
    """Element-wise greatest count of (class_id, n)."""
    return checkpoint.unionByName(scanned).groupBy("class_id").agg(F.max("n").alias("n"))


def unprocessed(rows: DataFrame, processed: DataFrame, key: str) -> DataFrame:
    return rows.join(processed.select(key).distinct(), key, "left_anti")


def missing_counts(wanted: DataFrame, present: DataFrame, key: tuple[str, ...], by: str) -> DataFrame:
    """Per class how many wanted entries have no cached one, incl. zero."""
    flags = wanted.join(present.select(*key).distinct().withColumn("_h", F.lit(1)), list(key), "left")
    return flags.groupBy(by).agg(F.sum(F.when(F.col("_h").isNull(), 1).otherwise(0)).alias("missing"), F.count("*").alias("wanted"))


def majority_root(files: DataFrame, root: Column) -> DataFrame:
    """The root with most files, the least on a tie."""
    return files.groupBy(root.alias("root")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "root").limit(1)


def combined_score(point_score: Column, model_score: Column) -> Column:
    return F.coalesce(point_score * model_score, F.lit(0.0))


def share(part: Column, whole: Column) -> Column:
    return ratio(part, whole)
