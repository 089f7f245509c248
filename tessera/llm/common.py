"""Shared helpers: table access, durable intermediate tables, word splitting, type-safe column access."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space \x09-\x0D; with the blank these separate words.
WS = "\t\n\x0b\x0c\r"
_made: list[tuple[SparkSession, str]] = []
_memos: dict[str, Callable[[], None]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset (tests)."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    fallback = spark.sparkContext.getCheckpointDir()
    if not fallback:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
        fallback = spark.sparkContext.getCheckpointDir()
    return fallback.rstrip("/")


def durable(df: DataFrame, tag: str = "step") -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    swept(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def swept(spark: SparkSession, path: str) -> str:
    """path, to be deleted at the driver's end."""
    _made.append((spark, path))
    return path


def discard(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _sweep() -> None:
    """Best effort: drop this driver's intermediate tables at its end."""
    while _made:
        spark, path = _made.pop()
        try:
            discard(spark, path)
        except Exception:  # the JVM may be gone; the folder's owner cleans up then
            return


def memo_of(name: str, clear: Callable[[], None] | None = None) -> None:
    """Called where a task of an operator begins, with what empties the operator's memo if it has one: workers are reused
    from stage to stage, and the memos of all other operators are emptied, so that they do not add up."""
    for other in [k for k in _memos if k != name]:
        _memos.pop(other)()
    if clear is not None:
        _memos[name] = clear


def words(text: Column) -> Column:
    """Array of maximal runs of characters other than \\x20 and \\x09-\\x0D; null text gives an empty array."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), WS, " " * 5), " "), "")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
