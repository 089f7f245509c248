"""Resumable batch work: a file source read until it is exhausted, with a checkpoint in place of lists of processed ids."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.keyed import Keyed


def run_available(spark: SparkSession, source: str, schema: str, transform: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, files_per_batch: int = 64) -> int:
    """Applies transform to the files of source that no earlier run took, appends to target, and returns the batches run.
    A run that breaks off resumes where it was; each file counts once."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    query = transform(stream).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return len([p for p in query.recentProgress if p["numInputRows"] > 0])


def upsert_available(spark: SparkSession, source: str, schema: str, keys: tuple[str, ...], target: str, checkpoint: str, order: tuple[str, ...] = ()) -> None:
    """Like run_available, but a later row of a key replaces the earlier: of a batch's rows of a key the last by order (then by
    all columns). The target (sources.keyed) notes each batch with its rows, so a repeated batch changes nothing."""
    table = Keyed(spark, target, keys, order=order)

    def apply(rows: DataFrame, batch: int) -> None:
        table.put(rows, checkpoint, batch)

    query = spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def latest(spark: SparkSession, target: str, keys: tuple[str, ...]) -> DataFrame:
    """The newest row of each key of an upsert_available target."""
    return Keyed(spark, target, keys).rows()
