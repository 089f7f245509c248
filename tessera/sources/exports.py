"""Exporters: shards, Arrow streams, masks as PNG, splits as annotation tables, caches that are merged, results and summaries."""

from __future__ import annotations

import json
import os
import uuid
from urllib.parse import urlparse

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import feature_cache_name, normal_text
from ..operators import geometry, masks, protocol
from . import png, readers, writers
from .json_documents import written
from .keyed import Keyed


def local(path: str) -> str:
    """A path that every executor reaches as a file; sinks that write single files need one."""
    where = urlparse(path)
    if where.scheme not in ("", "file"):
        raise ValueError(f"single files are written to a mounted folder, not to {path}")
    return where.path


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def removed(spark: SparkSession, path: str) -> None:
    fs, at = _fs(spark, path)
    fs.delete(at, True)


def named_shards(rows: DataFrame, root: str, split: str) -> None:
    """rows as <root>/<split>-<number>.parquet: Spark's part files under names that readers.shards() looks for."""
    spark = rows.sparkSession
    aside = f"{root}/.{split}-{uuid.uuid4().hex}"
    rows.write.parquet(aside)
    fs, at = _fs(spark, aside)
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    parts = sorted(s.getPath().getName() for s in fs.listStatus(at) if s.getPath().getName().startswith("part-"))
    for k, name in enumerate(parts):
        fs.rename(make(f"{aside}/{name}"), make(f"{root}/{split}-{k:05d}-of-{len(parts):05d}.parquet"))
    fs.delete(at, True)


def arrow_streams(rows: DataFrame, folder: str) -> list[str]:
    """rows as Arrow IPC streams, one file a partition; the paths in order of partitions."""
    target = local(folder)
    os.makedirs(target, exist_ok=True)

    def run(batches):
        import pyarrow as pa

        path, sink = f"{target}/{uuid.uuid4().hex}.arrow", None
        for b in batches:
            if sink is None:
                sink = pa.ipc.new_stream(path + ".tmp", b.schema)
            sink.write_batch(b)
        if sink is not None:
            sink.close()
            os.replace(path + ".tmp", path)
            yield pa.RecordBatch.from_pydict({"path": [path]})

    return sorted(r.path for r in rows.mapInArrow(run, "path string").collect())  # one row a partition


def mask_files(pixels: DataFrame, folder: str, by: tuple[str, ...], height: int, width: int, value: str = "value") -> DataFrame:
    """(by..., path): one grey PNG per group, written aside and renamed. pixels: (by..., row, col, value); the rest is 0."""
    target = local(folder)
    os.makedirs(target, exist_ok=True)

    def write(key, x):
        import pandas as pd

        image = np.zeros((height, width), np.uint8)
        image[x["row"].to_numpy(), x["col"].to_numpy()] = x[value].to_numpy()
        path = f"{target}/{'_'.join(map(str, key))}.png"
        with open(f"{path}.{uuid.uuid4().hex}", "wb") as f:
            f.write(png.encode(image))
        os.replace(f.name, path)
        return pd.DataFrame([(*key, path)], columns=[*by, "path"])

    kinds = {f.name: f.dataType.simpleString() for f in pixels.schema.fields}
    schema = ", ".join(f"{c} {kinds[c]}" for c in by) + ", path string"
    return pixels.select(*by, "row", "col", value).groupBy(*by).applyInPandas(write, schema)


def label_split(runs: DataFrame, allowed: tuple[int, int] = (1, 255), ignored: tuple[int, ...] = (255,)) -> DataFrame:
    """A label-map split as annotations: one per class present in an image, numbered from 1 in order of image and class."""
    return protocol.numbered(masks.label_instances(runs, allowed, ignored), "image_id", "label")


def object_split(scenes: DataFrame, categories: DataFrame) -> DataFrame:
    """A scene split as annotations, one per object with a known name and a valid polygon: (image_id, filename, pos,
    category_id, area of the bounding box), numbered from 1 in order of file and place. categories: (category_id, name)."""
    rows = scenes.select("filename", "width", "height", F.posexplode("objects").alias("pos", "o"))
    named = rows.select("filename", "pos", normal_text(F.col("o.name"), F.col("o.raw_name")).alias("name"), "width", "height", F.col("o.polygon.x").alias("px"), F.col("o.polygon.y").alias("py"))
    known = named.join(categories.select("category_id", "name"), "name")
    valid = (F.size("px") == F.size("py")) & (F.size("px") >= 3)
    clamp = lambda c, n: F.transform(c, lambda v: F.greatest(F.lit(0), F.least(v, F.col(n) - 1)))
    held = known.where(valid).withColumn("px", clamp("px", "width")).withColumn("py", clamp("py", "height"))
    side = lambda c: F.array_max(c) - F.array_min(c) + 1
    out = held.select("filename", "pos", "category_id", F.array_min("px").alias("bbox_x"), F.array_min("py").alias("bbox_y"), side("px").alias("bbox_w"), side("py").alias("bbox_h"))
    return protocol.numbered(out, "filename", "pos")


def scene_labels(scenes: DataFrame, categories: DataFrame) -> DataFrame:
    """(filename, mismatched, label, start, len): column-major runs of the label map of each scene, from its objects paired by
    place with the masks of its instances, the shorter list's length; mismatched: the lists differ in length. Painted by rising
    depth rank (9999 where unknown), later over earlier; names that are not known and masks that cannot be read paint nothing.

    scenes: (filename, width, height, objects, instances) with a PNG per instance, above 0 inside; categories: (category_id,
    name), which every task gets as a map: as many entries as there are classes."""
    known = categories.agg(F.map_from_entries(F.collect_list(F.struct("name", F.col("category_id").cast("int")))).alias("_ids"))
    pairs = F.transform(
        protocol.zipped(F.col("objects"), F.col("instances")),
        lambda v, i: F.struct(F.coalesce(v["object"]["depth_ordering_rank"], F.lit(9999)).alias("rank"), i.alias("at"), normal_text(v["object"]["name"], v["object"]["raw_name"]).alias("name"), v["instance"]["bytes"].alias("mask")),
    )
    mismatched = (F.size("objects") != F.size("instances")) & (F.size("objects") > 0) & (F.size("instances") > 0)
    rows = scenes.select("filename", "width", "height", F.array_sort(pairs).alias("pairs"), mismatched.alias("mismatched")).withColumn("_ids", known.scalar())
    named = rows.select("filename", "mismatched", "width", "height", F.transform("pairs", lambda v: F.struct(F.element_at("_ids", v["name"]).alias("label"), v["mask"].alias("mask"))).alias("pairs"))

    def paint(batches):
        import pandas as pd

        for x in batches:
            out = []
            for name, odd, w, h, own in zip(x["filename"], x["mismatched"], x["width"], x["height"], x["pairs"], strict=True):
                flat = np.zeros((int(h), int(w)), np.int32)
                for v in own if own is not None else ():
                    if v["label"] is None or v["mask"] is None:
                        continue
                    try:
                        mask = png.decode(bytes(v["mask"]))
                    except (ValueError, KeyError, OSError):
                        continue
                    flat[masks.normal_mask(mask.reshape(mask.shape[0], mask.shape[1], -1)[:, :, 0], int(h), int(w)) > 0] = v["label"]
                line = flat.ravel(order="F")
                edges = np.flatnonzero(np.diff(line)) + 1
                starts, ends = np.r_[0, edges], np.r_[edges, line.size]
                out += [(name, odd, int(line[a]), int(a), int(b - a)) for a, b in zip(starts, ends, strict=True)]
            yield pd.DataFrame(out, columns=["filename", "mismatched", "label", "start", "len"])

    return named.mapInPandas(paint, "filename string, mismatched boolean, label int, start long, len long")


def finalised(spark: SparkSession, lines: str, target: str) -> None:
    """Prediction lines as one JSON array in order of (image, category, score), each task writing its rows at their place."""
    rows = readers.json_lines(spark, lines).repartitionByRange("image_id", "category_id", F.desc("score")).sortWithinPartitions("image_id", "category_id", F.desc("score"))
    written(local(target), [("[", rows, "]")])


def results(spark: SparkSession, path: str, payload: dict, checkpoint: str) -> None:
    """Writes the results and only then removes the run's checkpoint."""
    writers.json_atomic(local(path), payload)
    removed(spark, checkpoint)


def summary(root: str, payload: dict) -> None:
    writers.json_atomic(f"{local(root)}/export_summary.json", payload)


def reusable(spark: SparkSession, root: str, files: tuple[str, ...] = ("export_summary.json", "train.json", "val.json")) -> dict | None:
    """The summary of an export that can be used again: all its files are there. Else None."""
    if not all(readers.exists(spark, f"{root}/{f}") for f in files):
        return None
    with open(f"{local(root)}/{files[0]}", encoding="utf-8") as f:
        return json.load(f)


def _prompts(spark: SparkSession, path: str, method: str, fingerprint: str) -> Keyed:
    return Keyed(spark, f"{path}/method={method}/fingerprint={fingerprint}", ("file_name", "class_id"), one=False)


def merged_prompts(rows: DataFrame, path: str, method: str, fingerprint: str, configuration: dict | None = None) -> None:
    """Prompt cache: rows (file_name, class_id, ...) replace those of the same file and class, all others stay. The first write
    also leaves the configuration beside them."""
    cache = _prompts(rows.sparkSession, path, method, fingerprint)
    cache.put(rows)
    here = cache.versions.root
    if configuration is not None and not readers.exists(rows.sparkSession, f"{here}/metadata.json"):
        writers.json_atomic(f"{local(here)}/metadata.json", configuration)


def prompt_lookup(wanted: DataFrame, path: str, method: str, fingerprint: str) -> DataFrame:
    """wanted (file_name, class_id, ...) with the cached rows; a miss has nulls."""
    return wanted.join(_prompts(wanted.sparkSession, path, method, fingerprint).rows(), ["file_name", "class_id"], "left")


def feature_cache(rows: DataFrame, path: str) -> None:
    """Features by image key, under their cache names; a repeated write of a name replaces it."""
    Keyed(rows.sparkSession, path, ("cache_name",)).put(rows.withColumn("cache_name", feature_cache_name(F.col("image_key"))))


def cached_features(wanted: DataFrame, path: str) -> DataFrame:
    """wanted (image_key, ...) with their cached features, by cache name; a miss has nulls."""
    cached = Keyed(wanted.sparkSession, path, ("cache_name",)).rows().drop("image_key")
    return wanted.withColumn("cache_name", feature_cache_name(F.col("image_key"))).join(cached, "cache_name", "left")


def resized_masks(files: DataFrame, height: int, width: int) -> DataFrame:
    """(path, label, pixels) of label images (path, content) after a nearest-neighbour resize; unreadable ones give no rows."""

    def run(batches):
        import pandas as pd

        for x in batches:
            out = []
            for path, data in zip(x["path"], x["content"], strict=True):
                try:
                    image = geometry.resized(png.decode(data), height, width)
                except ValueError:
                    continue
                labels, counts = np.unique(image, return_counts=True)
                out += [(path, int(v), int(n)) for v, n in zip(labels, counts, strict=True)]
            yield pd.DataFrame(out, columns=["path", "label", "pixels"])

    return files.select("path", "content").mapInPandas(run, "path string, label int, pixels long")


def support_masks(manifest: DataFrame, runs: DataFrame, references: DataFrame, folder: str, dataset: str, overwrite: bool = False) -> DataFrame:
    """The support manifest's items, and per item one mask of 0 and 255, the union of the class's annotations in the image, at
    <folder>/reference_masks/<class>/<file stem>.png. Masks that are there stay, unless overwrite.

    manifest: (class_id, class_name, image_id, file_name, height, width, ann_ids); runs: (image_id, class_id, start, len), which
    may overlap; references: (image_id, relative_output_path), images without one are left out. Items without runs get an empty
    mask. A task writes each mask aside and renames it, so that a lost task leaves no broken file."""
    target = local(folder)
    spans = runs.where("len > 0").groupBy("image_id", "class_id").agg(F.array_sort(F.collect_set(F.struct("start", "len"))).alias("runs"))
    stem = F.regexp_replace(F.replace("file_name", F.lit("/"), F.lit("__")), r"(?<=[^.])\.[^.]*$", "")
    rows = manifest.join(references.select("image_id", "relative_output_path").dropDuplicates(["image_id"]), "image_id").join(spans, ["image_id", "class_id"], "left")
    items = rows.select(
        F.lit(dataset).alias("dataset"), F.lit("train").alias("split"), "class_id", "class_name", "image_id", F.concat(F.lit("reference_imgs/"), "relative_output_path").alias("image_path"),
        F.concat(F.lit("reference_masks/"), "class_name", F.lit("/"), stem, F.lit(".png")).alias("mask_path"), "ann_ids", F.lit("semantic_union_binary").alias("mask_type"),
        F.col("file_name").alias("source_image_name"), "height", "width", "runs",
    )
    kept = items.drop("height", "width", "runs")

    def write(batches):
        for x in batches:
            for rel, h, w, own in zip(x["mask_path"], x["height"], x["width"], x["runs"], strict=True):
                path = os.path.join(target, rel)
                if os.path.exists(path) and not overwrite:
                    continue
                flat = np.zeros(int(h) * int(w), np.uint8)
                for r in own if own is not None else ():
                    flat[r["start"] : r["start"] + r["len"]] = 255
                os.makedirs(os.path.dirname(path), exist_ok=True)
                with open(f"{path}.{uuid.uuid4().hex}", "wb") as f:
                    f.write(png.encode(flat.reshape(int(w), int(h)).T))
                os.replace(f.name, path)
            yield x.drop(columns=["height", "width", "runs"])

    return items.mapInPandas(write, kept.schema)


def manifest_document(items: DataFrame, path: str, order: tuple[str, ...] = ("class_name", "image_id")) -> None:
    """A manifest as one JSON document {"items": [...]} in the given order, every task writing its rows at their place."""
    written(local(path), [('{"items":[', items.repartitionByRange(*order).sortWithinPartitions(*order), "]}")])


def support_protocol(items: DataFrame, categories: DataFrame, path: str, about: dict) -> None:
    """The protocol beside a support manifest: the classes in order of id with their number of supports (0 where there is none),
    and about, the caller's own entries. As many rows as classes pass through the driver. categories: (class_id, class_name)."""
    n = items.groupBy("class_id").agg(F.count("*").alias("support_count"))
    rows = categories.join(n, "class_id", "left").select("class_id", "class_name", F.coalesce("support_count", F.lit(0)).alias("support_count")).orderBy("class_id")
    writers.json_atomic(local(path), {**about, "class_vocabulary": [r.asDict() for r in rows.collect()]})


def mapping_reports(mapping: DataFrame, low: DataFrame, folder: str, payload: dict) -> None:
    """A label mapping as four JSON documents: summary (payload, with the counts of mapped and doubtful labels), mapping (raw to
    reference), mapping_detailed, low_confidence_mapping. A row per label passes through the driver."""
    target = local(folder)
    os.makedirs(target, exist_ok=True)
    plain = lambda d: [r.asDict(recursive=True) for r in d.orderBy("raw").collect()]
    rows, doubtful = plain(mapping), plain(low)
    documents = {
        "summary": {**payload, "mapped_raw_ids": len(rows), "low_confidence_raw_ids": len(doubtful)}, "mapping": {"mapping": {str(r["raw"]): r["target"] for r in rows}},
        "mapping_detailed": rows, "low_confidence_mapping": doubtful,
    }
    for name, document in documents.items():
        writers.json_atomic(f"{target}/{name}.json", document)
