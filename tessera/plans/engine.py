"""The pipeline: bank -> scores -> filter -> prompts -> metrics -> merged masks -> shot lists.

Every stage's table is kept in a workspace that all executors share (spark.checkpoint.dir, or a local folder where that is
unset), under the configuration's fingerprint. A manifest in versions (sources.versions) says which classes of a stage are
finished: a run that goes on makes only the others, later stages read earlier ones from the workspace, and totals are over all
classes whichever run made them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import fingerprint
from ..operators import bank as banks
from ..operators import masks, matching, metrics, protocol
from ..sources.stored import stored
from ..sources.stored import workspace as shared
from ..sources.versions import Versions
from . import evaluation
from .models import MaskModel

METHODS = ("absolute", "relative", "hybrid")
FILTERS = ("fixed", "adaptive", "clustered", "floor", "reweight")
SEGMENTATION = ("text", "point", "text_point")
#: The stage of each table.
STAGES = {"bank": 1, "filtered": 2, "weights": 2, "prompts": 3, "metrics": 4, "merged": 5, "mask_metrics": 5, "mask_totals": 5, "shots": 6}


@dataclass(frozen=True)
class Config:
    """Defaults of the operators; one object, so that cached and evaluated prompts have the same fingerprint."""

    method: str = "hybrid"
    filter: str = "adaptive"
    segmentation: str = "text_point"
    images_per_class: int = 30
    target_image_limit: int | None = 100
    sim_floor: float = 0.0
    min_matches: int = 3
    keep_threshold: float | None = 0.6
    top_k: int | None = 10_000
    adaptive_low: float = 0.65
    adaptive_high: float = 0.82
    adaptive_factor: float = 0.90
    min_cluster_size: int = 5
    min_keep_ratio: float = 0.30
    target_references: int | None = None
    early_accept: bool = False
    num_points: int = 10
    sim_threshold: float | None = 0.8
    peak_threshold: float = 0.2
    peak_distance: int = 10
    margin: float = 0.0
    loose_threshold: float = 0.8
    min_component: int = 4
    hybrid_threshold: float | None = 0.8
    max_references: int | None = 10_000
    max_points: int | None = None
    grid: tuple[int, int] = (96, 96)
    size: tuple[float, float] = (1536.0, 1536.0)
    start_stage: int = 1
    end_stage: int = 6
    shots: tuple[int, ...] = protocol.SHOTS

    def __post_init__(self) -> None:
        for value, known in ((self.method, METHODS), (self.filter, FILTERS), (self.segmentation, SEGMENTATION)):
            if value not in known:
                raise ValueError(f"{value!r} is not one of {known}")
        if self.early_accept and (self.target_references is None or self.keep_threshold is None):
            raise ValueError("early_accept needs target_references and keep_threshold")

    @property
    def fingerprint(self) -> str:
        """Of all that changes a table: which stages run does not."""
        return fingerprint({k: v for k, v in asdict(self).items() if k not in ("start_stage", "end_stage")})


class Engine:
    """Stages over a patch table (vec_id, image_id, class_id, patch_no, row, col, file_key, embedding, and coverage if known)."""

    def __init__(self, config: Config, workspace: str | None = None, batches: int = 1) -> None:
        """batches: in how many parts a stage's classes are made and noted as finished."""
        self.config, self.workspace, self.batches = config, workspace, batches

    def versions(self, spark: SparkSession) -> Versions:
        return Versions(spark, f"{self.workspace or shared(spark)}/tessera-{self.config.fingerprint}")

    def build(self, patches: DataFrame) -> DataFrame:
        """The first images_per_class images of each class in id order, of the patches that the class covers far enough. Without
        a column coverage every patch counts as covered."""
        if "coverage" in patches.columns:
            patches = patches.where(F.col("coverage") > banks.BANK_COVERAGE)
        own = banks.target_images(patches, self.config.images_per_class)
        return patches.join(own, ["class_id", "image_id"], "left_semi")

    def score(self, bank: DataFrame, patches: DataFrame) -> DataFrame:
        """Classes of several images by votes, of one image by its own similarities; others do not pass the gate."""
        c = self.config
        gate = banks.class_gate(bank, banks.target_images(bank, c.target_image_limit))
        several, single = bank.join(gate.where("targets >= 2"), "class_id", "left_semi"), bank.join(gate.where("targets < 2"), "class_id", "left_semi")
        voted = banks.scored(several, patches, c.sim_floor, c.min_matches, c.target_image_limit).withColumn("match_counts_are_synthetic", F.lit(False))
        once = single.join(banks.one_shot(single, c.min_matches), ["vec_id", "class_id", "image_id"])
        return voted.unionByName(once.select(*voted.columns))

    def filter(self, scored: DataFrame) -> DataFrame:
        """fixed, adaptive, clustered: rows above a threshold; floor: above keep_threshold but at least min_keep_ratio of a class,
        at most target_references, or with early_accept the first ones that pass; reweight: all rows, with a column weight."""
        c = self.config
        if c.filter == "reweight":
            return banks.reweighted(scored)
        if c.early_accept:
            scored = banks.early_accept(scored, c.keep_threshold, c.target_references, c.min_matches).where("accepted").drop("looked", "accepted")
        if c.filter == "floor":
            held = scored.withColumn("keep", F.lit(True)) if c.keep_threshold is None else banks.keep_floor(scored, c.keep_threshold, c.min_keep_ratio)
            return (held if c.target_references is None else banks.cap_references(held, c.target_references)).where("keep").drop("keep")
        kept = scored if c.keep_threshold is None else scored.where(F.col("score") >= c.keep_threshold)
        if c.filter == "fixed":
            return banks.top_k(kept, None, c.top_k)
        if c.filter == "adaptive":
            return banks.adaptive(kept, c.adaptive_low, c.adaptive_high, c.adaptive_factor, c.top_k)
        return banks.clustered(banks.with_clusters(kept), c.adaptive_low, c.adaptive_high, c.adaptive_factor, c.min_cluster_size, c.top_k)

    def match(self, queries: DataFrame, bank: DataFrame, prototypes: DataFrame | None = None) -> DataFrame:
        """Prompts with score. queries: (class_id, image_id, row, col, embedding), a class per image it is asked for. prototypes
        (class_id, place, embedding) stand in for the vectors of their classes; the absolute matcher takes them as one file more."""
        c = self.config
        if prototypes is not None:
            bank = banks.with_prototypes(bank, prototypes, c.method != "absolute")
        used = bank if c.max_references is None else banks.first_n(bank, c.max_references)
        if c.method == "absolute":
            return matching.absolute(queries, used, c.num_points, c.sim_threshold, c.grid, c.size).withColumnRenamed("sim", "score")
        if c.method == "relative":
            return matching.relative(queries, used, c.peak_threshold, c.peak_distance, c.margin, c.grid, c.size).withColumnRenamed("conf", "score")
        return matching.validated(matching.hybrid(queries, used, c.loose_threshold, c.min_component, c.peak_distance, c.grid, c.size), c.hybrid_threshold)

    def evaluate(self, prompts: DataFrame, instances: DataFrame, width: int, height: int) -> DataFrame:
        points = prompts.select("image_id", "class_id", F.monotonically_increasing_id().alias("point_id"), "x", "y", F.lit(width).alias("width"), F.lit(height).alias("height"))
        return metrics.point_metrics(points, instances)

    def predict(self, images: DataFrame, asked: DataFrame, load: Callable[[], MaskModel], prompts: DataFrame | None = None, cached: DataFrame | None = None) -> DataFrame:
        """A mask model's answers (evaluation.ANSWERS) for the classes asked of each image, by text, by the points of prompts, or
        by both, as the segmentation asks for. Prompts as the hybrid matcher gives them are cut at its threshold first; a pair
        that loses all of them still counts as one of which prompts are known."""
        c = self.config
        if prompts is None or c.segmentation == "text":
            return evaluation.predicted(evaluation.requests(images, asked), load, c.segmentation)
        known = prompts if cached is None else cached
        used = matching.validated(prompts, c.hybrid_threshold) if c.method == "hybrid" else prompts
        return evaluation.predicted(evaluation.requests(images, asked, used, known, c.max_points), load, c.segmentation)

    def merge(self, text: DataFrame, point: DataFrame) -> DataFrame:
        """The masks that the segmentation asks for: one side's pixels or the union of both. Sides: (image_id, class_id, pixel,
        score)."""
        if self.config.segmentation == "text_point":
            return masks.merged_union(text, point)
        return text if self.config.segmentation == "text" else point

    def evaluate_masks(self, merged: DataFrame, truth: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(per class, over all) of pixel metrics. truth: (image_id, class_id, inst, pixel)."""
        counts = metrics.pixel_counts(merged, truth)
        instances = truth.select("image_id", "class_id", "inst").distinct().groupBy("class_id").agg(F.count("*").alias("gt_instances"))
        return metrics.class_table(counts, instances), metrics.global_metrics(counts)

    def shot_lists(self, supports: DataFrame, filtered: DataFrame) -> DataFrame:
        """Supports in order of the quality of their filtered vectors, as nested k-shot lists."""
        return protocol.k_shots(protocol.support_order(supports, banks.image_quality(filtered)), self.config.shots)

    def _part(self, versions: Versions, name: str, classes: DataFrame, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """A stage's table over all classes; those that the manifest has not are made, batch by batch."""
        for b in range(self.batches):
            number, entry = versions.latest()
            parts = entry["stages"].get(name, [])
            todo = classes.where(F.pmod(F.xxhash64("class_id"), F.lit(self.batches)) == b)
            if parts:
                todo = todo.join(versions.read(*[p["classes"] for p in parts]), "class_id", "left_anti")
            if todo.isEmpty():
                continue
            asked = versions.write(todo.select("class_id"))
            rows = versions.write(make(versions.read(asked)))
            versions.commit(number + 1, entry | {"stages": entry["stages"] | {name: [*parts, {"classes": asked, "rows": rows}]}})
        return self._read(versions, name) if versions.latest()[1]["stages"].get(name) else make(classes.where("false"))

    def _whole(self, versions: Versions, name: str, inputs: list[str], make: Callable[[], DataFrame]) -> DataFrame:
        """A table over all of its input stages; made again only when they have changed."""
        number, entry = versions.latest()
        of = [p["rows"] for i in inputs for p in entry["stages"].get(i, [])]
        if (old := entry["whole"].get(name)) is None or old["of"] != of:
            versions.commit(number + 1, entry | {"whole": entry["whole"] | {name: {"rows": versions.write(make()), "of": of}}})
        return self._read(versions, name)

    def _read(self, versions: Versions, name: str) -> DataFrame:
        entry = versions.latest()[1]
        if name in entry.get("whole", {}):
            return versions.read(entry["whole"][name]["rows"])
        if not entry.get("stages", {}).get(name):
            raise LookupError(f"no table of {name!r} in {versions.root}: run its stage first")
        return versions.read(*[p["rows"] for p in entry["stages"][name]])

    def progress(self, spark: SparkSession) -> DataFrame:
        """(stage, classes, rows) over all runs so far."""
        versions = self.versions(spark)
        out = spark.createDataFrame([], "stage string, classes long, rows long")
        for name, parts in versions.latest()[1].get("stages", {}).items():
            classes = versions.read(*[p["classes"] for p in parts]).agg(F.count("*").alias("classes"))
            rows = versions.read(*[p["rows"] for p in parts]).agg(F.count("*").alias("rows"))
            out = out.unionByName(classes.crossJoin(rows).withColumn("stage", F.lit(name)))  # one row each
        return out

    def run(self, references: DataFrame, queries: DataFrame, instances: DataFrame | None = None, sides: tuple[DataFrame, DataFrame] | None = None, truth: DataFrame | None = None, supports: DataFrame | None = None, classes: DataFrame | None = None, resume: bool = False) -> dict[str, DataFrame]:
        """Tables of the stages from start_stage to end_stage: 1 bank, 2 filter (with reweight also weights), 3 prompts, 4 point
        metrics (with instances), 5 merged masks and their metrics (with both sides and truth), 6 k-shot lists (with supports).

        Stages before start_stage are read from the workspace and never made. classes (class_id): only these. resume: classes
        that the workspace has finished are not made again; without it a run from stage 1 begins anew. The caller gives the same
        inputs to all runs of one configuration and workspace."""
        c, out, spark = self.config, {}, references.sparkSession
        versions = self.versions(spark)
        number, entry = versions.latest()
        if not entry or (not resume and c.start_stage == 1):
            versions.commit(number + 1, {"stages": {}, "whole": {}})
        elif not resume:  # stages from start_stage on are made anew
            keep = {n: p for n, p in entry["stages"].items() if STAGES[n] < c.start_stage}
            versions.commit(number + 1, {"stages": keep, "whole": {n: w for n, w in entry["whole"].items() if STAGES[n] < c.start_stage}})

        def own(rows: DataFrame) -> DataFrame:
            every = rows.select("class_id").distinct()
            return every if classes is None else every.join(classes.select("class_id").distinct(), "class_id", "left_semi")

        def part(name: str, of: DataFrame, make: Callable[[DataFrame], DataFrame]) -> None:
            if c.start_stage <= STAGES[name] <= c.end_stage:
                out[name] = self._part(versions, name, own(of), make)

        def whole(name: str, inputs: list[str], make: Callable[[], DataFrame]) -> None:
            if c.start_stage <= STAGES[name] <= c.end_stage:
                out[name] = self._whole(versions, name, inputs, make)

        of = lambda rows, some: rows.join(some, "class_id", "left_semi")
        part("bank", references, lambda some: self.score(stored(self.build(of(references, some))), references))
        part("filtered", references, lambda some: self.filter(of(self._read(versions, "bank"), some)))
        if c.filter == "reweight":
            whole("weights", ["filtered"], lambda: self._read(versions, "filtered").select("class_id", *banks.ORDER, "weight"))
        part("prompts", queries, lambda some: self.match(of(queries, some), self._read(versions, "filtered")))
        if instances is not None:
            whole("metrics", ["prompts"], lambda: self.evaluate(self._read(versions, "prompts"), instances, int(c.size[1]), int(c.size[0])))
        if sides is not None and truth is not None:
            part("merged", sides[0].select("class_id").unionByName(sides[1].select("class_id")), lambda some: self.merge(of(sides[0], some), of(sides[1], some)))
            merged = lambda: self._read(versions, "merged")
            whole("mask_metrics", ["merged"], lambda: self.evaluate_masks(merged(), truth)[0])
            whole("mask_totals", ["merged"], lambda: self.evaluate_masks(merged(), truth)[1])
        if supports is not None:
            whole("shots", ["filtered"], lambda: self.shot_lists(supports, self._read(versions, "filtered")))
        return out
