"""Tables kept between plans, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []
_own: list[str] = []


def workspace(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset (local runs, tests), a temporary folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="tessera-"))
    return _own[0]


def place(spark: SparkSession, name: str) -> str:
    """A new folder's path, deleted when the driver ends."""
    path = f"{workspace(spark)}/tessera-{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def stored(rows: DataFrame, name: str = "table") -> DataFrame:
    """rows as a table: cuts lineage and survives lost executors."""
    path = place(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


@atexit.register
def _sweep() -> None:
    while _made:
        spark, path = _made.pop()
        try:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the JVM may be gone; the folder's owner cleans up then
            return
