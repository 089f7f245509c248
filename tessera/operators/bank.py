"""Scoring and filtering policies of the vector bank. A bank is one table; score is null where unscored (-1 in reports)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import adaptive_threshold, ratio
from . import search
from .clusters import cluster_count, with_clusters  # noqa: F401  (part of the bank's policies)
from .running import Ranged, numbered, ranked

#: Order of a bank: file key as text, then patch.
ORDER = ("file_key", "patch_no")
#: A patch is of a class that covers more than this share of it: in the bank, in target images.
BANK_COVERAGE, TARGET_COVERAGE = 0.90, 0.50


def file_key(image_id: Column, ann_id: Column) -> Column:
    return F.concat(image_id.cast("string"), F.lit("_"), ann_id.cast("string"), F.lit(".pt"))


def first_rows(rows: DataFrame, by: tuple[str, ...], order: list[Column], n: int, salts: int = 64) -> DataFrame:
    """The first n rows of each group in the given order. Rows are first cut to n inside salted parts of a group, so that a
    group with a third of all rows is sorted by many tasks, and the last one sees at most n rows of each."""
    salt = F.pmod(F.xxhash64(*[c for c, t in rows.dtypes if not t.startswith(("map", "variant"))]), F.lit(salts))
    inside = F.row_number().over(Window.partitionBy(*by, "_salt").orderBy(*order))
    part = rows.withColumn("_salt", salt).withColumn("_first", inside).where(F.col("_first") <= n).drop("_salt", "_first")
    return part.withColumn("_first", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_first") <= n).drop("_first")


def target_images(bank: DataFrame, limit: int | None = 100) -> DataFrame:
    """(class_id, image_id): the first limit image ids of each class."""
    own = bank.select("class_id", "image_id").distinct()
    if limit is None:
        return own
    return first_rows(own, ("class_id",), [F.col("image_id")], limit)


def targets(patches: DataFrame, images: DataFrame) -> DataFrame:
    """All patches of each class's target images, with inside: the patch is of the class. Patches with a coverage have a row per
    class in them and are of those that cover more than TARGET_COVERAGE."""
    if "coverage" in patches.columns:
        whole = patches.groupBy("image_id", "patch_no").agg(F.first("embedding").alias("embedding"), F.collect_set(F.when(F.col("coverage") > TARGET_COVERAGE, F.col("class_id"))).alias("_cs"))
        return whole.join(images, "image_id").select("class_id", "image_id", "patch_no", F.expr("array_contains(_cs, class_id)").alias("inside"), "embedding")
    return patches.select("image_id", "patch_no", "embedding", F.col("class_id").alias("_c")).join(images, "image_id").select("class_id", "image_id", "patch_no", (F.col("_c") == F.col("class_id")).alias("inside"), "embedding")


def class_gate(bank: DataFrame, targets: DataFrame) -> DataFrame:
    """(class_id, targets) of the classes that can be scored: with two target images or more, or with a single source image."""
    n = targets.groupBy("class_id").agg(F.countDistinct("image_id").alias("targets"))
    sources = bank.groupBy("class_id").agg(F.countDistinct("image_id").alias("_src"))
    return n.join(sources, "class_id", "left").where("targets >= 2 or _src = 1").drop("_src")


def scored(bank: DataFrame, patches: DataFrame, sim_floor: float = 0.0, min_matches: int = 3, limit: int | None = 100) -> DataFrame:
    """bank with tp, fp and score = tp / (tp + fp), null below min_matches votes. A class is scored if it has two target
    images or more; a class of one image takes one_shot()."""
    got = search.votes(bank, targets(patches, target_images(bank, limit)), sim_floor)
    out = bank.join(got, ["vec_id", "class_id"], "left").withColumn("tp", F.coalesce("tp", F.lit(0))).withColumn("fp", F.coalesce("fp", F.lit(0)))
    total = F.col("tp") + F.col("fp")
    return out.withColumn("score", F.when(total >= min_matches, F.col("tp") / total))


def one_shot(bank: DataFrame, min_matches: int = 3) -> DataFrame:
    """Score by the largest similarity inside the image, if not negative; tp is then synthetic."""
    got = search.self_similarity(bank)
    fine = F.col("sim") >= 0
    return got.select("vec_id", "class_id", "image_id", F.when(fine, F.col("sim")).alias("score"), F.when(fine, max(1, min_matches)).otherwise(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"), F.lit(True).alias("match_counts_are_synthetic"))


def top_k(bank: DataFrame, threshold: float | None, k: int | None) -> DataFrame:
    """Rows with score >= threshold, the k best of each class."""
    out = bank.where("score is not null")
    out = out if threshold is None else out.where(F.col("score") >= threshold)
    return out if k is None else first_rows(out, ("class_id",), [F.desc("score"), *[F.col(c) for c in ORDER]], k)


def adaptive(bank: DataFrame, low: float = 0.65, high: float = 0.82, factor: float = 0.90, k: int | None = None) -> DataFrame:
    """Threshold per class from the upper quartile of its scores (column threshold)."""
    q = bank.where("score is not null").groupBy("class_id").agg(F.percentile("score", F.lit(0.75)).alias("_q"))
    out = bank.join(q.select("class_id", adaptive_threshold(F.col("_q"), low, high, factor).alias("threshold")), "class_id")
    return top_k(out.where("score >= threshold"), None, k)


def clustered(bank: DataFrame, low: float = 0.65, high: float = 0.82, factor: float = 0.90, smallest: int = 5, k: int | None = None) -> DataFrame:
    """adaptive() per (class, cluster); clusters below smallest go; the k best of each class stay."""
    ok = bank.where("score is not null")
    q = ok.groupBy("class_id", "cluster").agg(F.percentile("score", F.lit(0.75)).alias("_q"), F.count("*").alias("cluster_size")).where(F.col("cluster_size") >= smallest)
    out = ok.join(q.select("class_id", "cluster", "cluster_size", adaptive_threshold(F.col("_q"), low, high, factor).alias("threshold")), ["class_id", "cluster"])
    return top_k(out.where("score >= threshold"), None, k)


def keep_floor(bank: DataFrame, threshold: float, min_ratio: float = 0.30) -> DataFrame:
    """bank with keep: unscored or score >= threshold; if fewer than max(1, int(ratio * n)) of a class survive, its best so
    many are kept instead, unscored ranked as 0.5. Only classes that fall short are ranked."""
    passes = F.col("score").isNull() | (F.col("score") >= threshold)
    counts = bank.groupBy("class_id").agg(F.count("*").alias("_n"), F.sum(passes.cast("int")).alias("_s"))
    need = F.greatest(F.lit(1), F.floor(F.col("_n") * min_ratio).cast("long"))
    out = bank.join(counts.select("class_id", need.alias("_need"), (F.col("_s") >= need).alias("_enough")), "class_id")
    full = out.where("_enough").withColumn("keep", passes)
    short = out.where("not _enough").withColumn("_as", F.coalesce("score", F.lit(0.5)))
    short = ranked(short, ("class_id",), (("_as", True), *[(c, False) for c in ORDER]), "_rank").withColumn("keep", F.col("_rank") <= F.col("_need"))
    return full.unionByName(short.drop("_as", "_rank")).drop("_need", "_enough")


def cap_references(bank: DataFrame, n: int) -> DataFrame:
    """keep cut to the n best kept rows of each class, unscored ranked as 0.5."""
    order = [F.desc(F.coalesce("score", F.lit(0.5))), *[F.col(c) for c in ORDER]]
    best = first_rows(bank.where("keep").select("class_id", "score", *ORDER), ("class_id",), order, n)
    kept = best.select("class_id", *ORDER, F.lit(True).alias("_in"))
    return bank.join(kept, ["class_id", *ORDER], "left").withColumn("keep", F.col("keep") & F.coalesce("_in", F.lit(False))).drop("_in")


def reweighted(bank: DataFrame) -> DataFrame:
    """All rows, with weight: the score between 0 and 1, 0.5 for unscored."""
    return bank.withColumn("weight", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.col("score").cast("double"), F.lit(0.5)))))


def early_accept(bank: DataFrame, threshold: float, n: int, min_matches: int = 3) -> DataFrame:
    """In bank order rows with score >= threshold are accepted until n are; rows after that are not looked at (score 0, tp 0,
    fp min_matches). The n-th accepted row of a class ends the look; no class is walked through."""
    place, passes = F.struct(*ORDER), F.coalesce(F.col("score") >= threshold, F.lit(False))
    good = first_rows(bank.where(passes).select("class_id", *ORDER), ("class_id",), [F.col(c) for c in ORDER], n)
    last = good.groupBy("class_id").agg(F.count("*").alias("_n"), F.max(place).alias("_end")).where(F.col("_n") >= n)
    out = bank.join(last.select("class_id", "_end"), "class_id", "left")
    out = out.withColumn("looked", F.col("_end").isNull() | (place <= F.col("_end"))).drop("_end")
    out = out.withColumn("accepted", F.col("looked") & passes)
    swap = lambda c, other: F.when(F.col("accepted"), F.col(c)).otherwise(F.lit(other)).alias(c)
    return out.withColumns({"score": swap("score", 0.0), "tp": swap("tp", 0), "fp": swap("fp", min_matches)})


def first_n(bank: DataFrame, n: int) -> DataFrame:
    """The first n rows of each class in bank order."""
    return first_rows(bank, ("class_id",), [F.col(c) for c in ORDER], n)


def with_prototypes(bank: DataFrame, prototypes: DataFrame, instead: bool = True) -> DataFrame:
    """bank (vec_id, class_id, file_key, patch_no, embedding) with the prototypes (class_id, place, embedding) of its classes:
    instead of a class's vectors, or as its last file. A class may have prototypes only. Prototypes have negative vec_ids."""
    own = numbered(prototypes.where("embedding is not null"), "class_id", "place", name="_n")
    kinds = {f.name: f.dataType for f in bank.schema.fields}
    columns = {"vec_id": -F.col("_n"), "class_id": F.col("class_id"), "file_key": F.lit("prototypes.pt"), "patch_no": F.col("place"), "embedding": F.col("embedding")}
    rows = own.select(*[e.cast(kinds[c]).alias(c) for c, e in columns.items()])
    held = bank.select(*columns)
    return (held.join(rows.select("class_id").distinct(), "class_id", "left_anti").select(*columns) if instead else held).unionByName(rows)


def quota(annotations: DataFrame, max_images: int | None = None, max_features: int | None = None) -> DataFrame:
    """Annotations (class_id, image_id, ann_id, n_patches) that a sequential build under one quota or both would take.

    max_images: those of a class's first images with a patch; max_features: those before which the class had fewer. Each keeps
    a first part of a class's annotations in order of image and annotation, so both together keep the shorter."""
    if max_images is None and max_features is None:
        raise ValueError("no quota")
    out = annotations.where("n_patches > 0")
    if max_images is not None:
        first = first_rows(out.select("class_id", "image_id").distinct(), ("class_id",), [F.col("image_id")], max_images)
        out = out.join(first, ["class_id", "image_id"], "left_semi")
    if max_features is not None:
        ranged = Ranged(out, ("class_id",), (("image_id", False), ("ann_id", False)))
        out = ranged.scan(ranged.rows, own=False, _before=("sum", F.col("n_patches"))).where(F.col("_before") < max_features).drop("_before", "_part")
    return out


def cluster_report(bank: DataFrame, low: float = 0.65, high: float = 0.82, factor: float = 0.90, smallest: int = 5) -> DataFrame:
    """Per class: the kept and the discarded (too small) clusters, and least, mean and greatest threshold of the kept ones."""
    q = bank.where("score is not null").groupBy("class_id", "cluster").agg(F.percentile("score", F.lit(0.75)).alias("_q"), F.count("*").alias("_n"))
    t = F.when(F.col("_n") >= smallest, adaptive_threshold(F.col("_q"), low, high, factor))
    listed = lambda c: F.array_join(F.array_sort(F.collect_list(F.when(c, F.col("cluster")))).cast("array<string>"), ",")
    return q.withColumn("_t", t).groupBy("class_id").agg(
        F.count("_t").alias("kept_clusters"), listed(F.col("_t").isNotNull()).alias("kept"), listed(F.col("_t").isNull()).alias("discarded"),
        F.min("_t").alias("min_threshold"), F.avg("_t").alias("mean_threshold"), F.max("_t").alias("max_threshold"),
    )


def bank_counts(bank: DataFrame) -> DataFrame:
    """Per class: vectors, files and source images in the bank."""
    return bank.groupBy("class_id").agg(F.count("*").alias("features"), F.countDistinct("file_key").alias("files"), F.countDistinct("image_id").alias("images"))


def report(bank: DataFrame, keep: Column) -> DataFrame:
    """One row per class: counts, removal, precision, and the summary of scores (lower median, population deviation)."""
    s = F.col("score")
    return bank.groupBy("class_id").agg(
        F.count("*").alias("total"), F.sum(F.when(keep, 1).otherwise(0)).alias("kept"), F.count("score").alias("n_scored"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp"),
        F.round(F.avg(s), 4).alias("mean_score"), F.round(F.percentile_disc(0.5, s) if hasattr(F, "percentile_disc") else F.expr("percentile_disc(0.5) within group (order by score)"), 4).alias("median_score"),
        F.round(F.stddev_pop(s), 4).alias("std_score"), F.round(F.min(s), 4).alias("min_score"), F.round(F.max(s), 4).alias("max_score"),
    ).withColumn("removed_pct", F.round(100.0 * (F.col("total") - F.col("kept")) / F.col("total"), 1)).withColumn("precision", F.round(ratio(F.col("tp"), F.col("tp") + F.col("fp")), 4))


def report_total(bank: DataFrame, keep: Column) -> DataFrame:
    return bank.agg(F.count("*").alias("total"), F.sum(F.when(keep, 1).otherwise(0)).alias("kept"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp")).select(
        "total", "kept", "tp", "fp", F.round(ratio(F.col("tp"), F.col("tp") + F.col("fp")), 4).alias("precision"), F.round(100.0 * (F.col("total") - F.col("kept")) / F.col("total"), 2).alias("removed_pct")
    )


def image_quality(bank: DataFrame) -> DataFrame:
    """Per (class, image): max, mean, averaging median of scores; file_count counts files, not vectors."""
    return bank.groupBy("class_id", "image_id").agg(F.max("score").alias("max_score"), F.avg("score").alias("mean_score"), F.median("score").alias("median_score"), F.countDistinct("file_key").alias("file_count"))


def candidate_metrics(bank: DataFrame, gate: float = 0.6, min_matches: int = 3) -> DataFrame:
    """Per (class, image): scored and passing counts, summary of passing scores (lower median), accepted if any passes."""
    votes = F.col("tp") + F.col("fp")
    ok = (votes >= min_matches) & (F.col("score") >= gate)
    hit = F.when(ok, F.col("score"))
    return bank.groupBy("class_id", "image_id").agg(F.sum(F.when(votes >= min_matches, 1).otherwise(0)).alias("n_scored"), F.count(hit).alias("n_passing"), F.max(hit).alias("max_passing"), F.round(F.avg(hit), 6).alias("mean_passing"), F.expr(f"percentile_disc(0.5) within group (order by case when tp + fp >= {min_matches} and score >= {gate} then score end)").alias("median_passing"), F.coalesce(F.bool_or(ok), F.lit(False)).alias("accepted"))


def class_floor(overlay: DataFrame, base: DataFrame, classes: DataFrame, thresholds: DataFrame, default: float = 0.65) -> DataFrame:
    """(class_id, floor): least kept score of the overlay, else of the base, else the report's threshold, else default."""
    low = lambda d, n: d.groupBy("class_id").agg(F.min("score").alias(n))
    return classes.join(low(overlay, "_o"), "class_id", "left").join(low(base, "_b"), "class_id", "left").join(thresholds.select("class_id", F.col("threshold").alias("_t")), "class_id", "left").select("class_id", F.coalesce("_o", "_b", "_t", F.lit(default)).alias("floor"))


def overlay_first(*layers: DataFrame, key: tuple[str, ...] = ("class_id", "file_key")) -> DataFrame:
    """All rows of each file from the first layer that has it."""
    out = None
    for k, layer in enumerate(layers):
        one = layer.withColumn("_layer", F.lit(k))
        out = one if out is None else out.unionByName(one)
    first = out.groupBy(*key).agg(F.min("_layer").alias("_layer"))
    return out.join(first, [*key, "_layer"]).drop("_layer")


def equivalence(a: DataFrame, b: DataFrame, threshold: float = 0.6, tolerance: float = 1e-6) -> DataFrame:
    """One row per class: whether two scorings agree on votes, scores and kept rows."""
    y = b.select("vec_id", "class_id", F.col("tp").alias("_tp"), F.col("fp").alias("_fp"))
    j = a.select("vec_id", "class_id", "tp", "fp").join(y, ["vec_id", "class_id"], "full")
    s, t = (F.when(F.col(x) + F.col(z) > 0, F.col(x) / (F.col(x) + F.col(z))) for x, z in (("tp", "fp"), ("_tp", "_fp")))
    gap = F.abs(s - t)
    return j.groupBy("class_id").agg(
        F.count("*").alias("vectors"), F.bool_and(F.col("tp").eqNullSafe(F.col("_tp"))).alias("tp_equal"), F.bool_and(F.col("fp").eqNullSafe(F.col("_fp"))).alias("fp_equal"),
        F.coalesce(F.max(gap), F.lit(0.0)).alias("max_score_gap"), F.bool_and(F.coalesce(gap <= tolerance, F.lit(True))).alias("scores_close"), F.bool_and(F.coalesce(s >= threshold, F.lit(False)) == F.coalesce(t >= threshold, F.lit(False))).alias("keep_equal"),
    )
