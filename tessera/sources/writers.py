"""Sinks. Spark's commit protocol takes the place of temporary files and renames; a repeated write replaces its target."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .json_documents import written


def bank(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Bank (raw, scored, filtered or reweighted: more columns) by class; only the classes written are replaced."""
    rows.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("class_name").parquet(path)


def prototypes(rows: DataFrame, path: str) -> None:
    """Prototypes (class_name, place, embedding) of a bank's classes, in the bank's folder under a name that scans leave out."""
    rows.select("class_name", "place", "embedding").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("class_name").parquet(f"{path.rstrip('/')}/_prototypes")


def predictions(rows: DataFrame, path: str, mode: str = "append") -> None:
    rows.write.mode(mode).json(path)


def prompts(rows: DataFrame, path: str, method: str, fingerprint: str) -> None:
    """Prompt cache: one folder per method and configuration."""
    rows.withColumn("method", F.lit(method)).withColumn("fingerprint", F.lit(fingerprint)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("method", "fingerprint").parquet(path)


def report(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def coco_document(images: DataFrame, annotations: DataFrame, categories: DataFrame, path: str) -> None:
    """The split as three tables of JSON lines under one folder: no task gathers a whole split."""
    for name, rows in (("images", images), ("annotations", annotations), ("categories", categories)):
        rows.write.mode("overwrite").json(f"{path}/{name}")


def coco_single_file(images: DataFrame, annotations: DataFrame, categories: DataFrame, path: str) -> None:
    """One compact JSON document for tools that want it; every task writes its rows at their place in the file."""
    written(path, [('{"images":[', images, "]"), (',"annotations":[', annotations, "]"), (',"categories":[', categories, "]}")])


def json_atomic(path: str, payload: dict, tries: int = 3) -> None:
    """Small driver-side JSON: sorted keys, written aside and renamed, retried after 0.1 s times the attempt."""
    for k in range(1, tries + 1):
        try:
            with open(f"{path}.tmp", "w", encoding="utf-8") as f:
                json.dump(payload, f, sort_keys=True, indent=2)
            os.replace(f"{path}.tmp", path)
            return
        except OSError:
            if k == tries:
                raise
            time.sleep(0.1 * k)


def summary_line(metrics: dict) -> str:
    """One line of the main figures; mAP50 falls back to AP50."""
    ap = metrics.get("mAP50", metrics.get("AP50", 0.0))
    return " ".join(f"{k}={v:.4f}" for k, v in (("IoU", metrics.get("iou", 0.0)), ("mIoU", metrics.get("miou", 0.0)), ("F1", metrics.get("f1", 0.0)), ("P", metrics.get("precision", 0.0)), ("R", metrics.get("recall", 0.0)), ("mAP50", ap)))


def copied_images(files: DataFrame, target: str, overwrite: bool = False, dry_run: bool = False) -> DataFrame:
    """(path, to, status) of copying files (path, content) into a folder that all executors reach."""
    import pandas as pd

    def run(batches):
        for x in batches:
            out = []
            for p, b in zip(x["path"], x["content"], strict=True):
                to = f"{target}/{p.rsplit('/', 1)[-1]}"
                there = os.path.exists(to)
                status = "missing" if b is None else "exists" if there and not overwrite else "would copy" if dry_run else "copied"
                if status == "copied":
                    with open(f"{to}.tmp", "wb") as f:
                        f.write(b)
                    os.replace(f"{to}.tmp", to)
                out.append((p, to, status))
            yield pd.DataFrame(out, columns=["path", "to", "status"])

    return files.select("path", "content").mapInPandas(run, "path string, to string, status string")
