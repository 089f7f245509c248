"""A keyed table that is written by puts and survives a writer's death at any point.

A put writes only its own rows, as a layer that never changes, and makes one version (sources.versions) that lists the layers.
Of each key the rows of its newest layer count. Readers see the last finished version; what an unfinished put leaves is named by
nothing. Of two writers at once the later one puts its layer on the other's version. Many layers are merged into one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .versions import Taken, Versions

#: So many layers are merged into one.
MERGE_AT = 8


class Keyed:
    """keys: the columns of a key. one: a key has one row (of a put's rows of a key the last by order, and by all columns where
    that does not decide); else a put's rows of a key replace all that were there."""

    def __init__(self, spark: SparkSession, path: str, keys: tuple[str, ...], one: bool = True, order: tuple[str, ...] = ()) -> None:
        self.keys, self.one, self.order, self.versions = keys, one, order, Versions(spark, path)

    def _single(self, rows: DataFrame) -> DataFrame:
        own = [F.col(c) for c, t in rows.dtypes if not t.startswith(("map", "variant"))]
        last = Window.partitionBy(*self.keys).orderBy(*[F.desc(c) for c in self.order], F.xxhash64(*own))
        return rows.withColumn("_last", F.row_number().over(last)).where("_last = 1").drop("_last")

    def put(self, rows: DataFrame, stream: str | None = None, batch: int | None = None) -> None:
        """Adds rows. With a stream's name and batch number, a batch that was already put is left out: repeats do no harm."""
        v = self.versions
        seen = v.latest()[1].get("streams", {}).get(stream, -1) if stream is not None else -1
        if batch is not None and batch <= seen:
            return
        layer = v.write(self._single(rows) if self.one else rows)
        while True:
            number, entry = v.latest()
            streams = entry.get("streams", {}) | ({stream: batch} if stream is not None else {})
            try:
                v.commit(number + 1, {"layers": [*entry.get("layers", []), layer], "streams": streams})
                break
            except Taken:
                continue
        if len(entry.get("layers", [])) + 1 >= MERGE_AT:
            self.merge()

    def merge(self) -> None:
        """All layers as one; given up if another writer is faster."""
        number, entry = self.versions.latest()
        if len(entry.get("layers", [])) > 1:
            try:
                self.versions.commit(number + 1, entry | {"layers": [self.versions.write(self._of(entry["layers"]))]})
            except Taken:
                return

    def _of(self, layers: list[str]) -> DataFrame:
        if len(layers) == 1:
            return self.versions.read(layers[0])
        every = None
        for k, name in enumerate(layers):
            one = self.versions.read(name).withColumn("_layer", F.lit(k))
            every = one if every is None else every.unionByName(one, allowMissingColumns=True)
        newest = every.groupBy(*self.keys).agg(F.max("_layer").alias("_layer"))
        return every.hint("merge").join(newest.withColumnsRenamed({k: f"_k_{k}" for k in self.keys} | {"_layer": "_n"}), self._same(newest), "left_semi").drop("_layer")

    def _same(self, newest: DataFrame):
        out = F.col("_layer") == F.col("_n")
        for k in self.keys:
            out = out & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        return out

    def exists(self) -> bool:
        return bool(self.versions.latest()[1].get("layers"))

    def rows(self) -> DataFrame:
        """The newest rows of each key."""
        layers = self.versions.latest()[1].get("layers")
        if not layers:
            raise LookupError(f"nothing was put into {self.versions.root}")
        return self._of(layers)
