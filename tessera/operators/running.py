"""Running sums, maxima and places over a group's order, without one task per group.

Rows are ranged into partitions by group and order and written; what is before a partition is carried in from a small table of
partition totals. A group with a third of all rows takes part in as many tasks as it has partitions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stored import stored

#: (column, falling): nulls come first in rising order and last in falling order.
Order = tuple[tuple[str, bool], ...]
_MERGE = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "max": F.greatest, "min": F.least}
_AGG = {"sum": F.sum, "max": F.max, "min": F.min}


class Ranged:
    """rows kept in ranges of (by, order). Rows that are equal in both lie in one range, in any order among themselves.
    parts: how many ranges; by default as many as the data need."""

    def __init__(self, rows: DataFrame, by: tuple[str, ...], order: Order, parts: int | None = None) -> None:
        self.by, self.order = by, order
        ends = [F.col(c) for c in by] + self._sorted(False)
        ranged = rows.repartitionByRange(*ends) if parts is None else rows.repartitionByRange(parts, *ends)
        self.rows = stored(ranged.withColumn("_part", F.spark_partition_id()), "ranged")

    def _sorted(self, backward: bool) -> list[Column]:
        return [F.desc(c) if falling != backward else F.asc(c) for c, falling in self.order]

    def scan(self, rows: DataFrame, backward: bool = False, own: bool = True, **what: tuple[str, Column]) -> DataFrame:
        """rows (of this object, with more columns) with a column per entry of what: name = (sum, max or min; expression), over
        the group's rows up to this one in order (from this one on if backward), without the row itself if not own."""
        inside = Window.partitionBy("_part", *self.by).orderBy(*self._sorted(backward)).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
        whole = rows.groupBy("_part", *self.by).agg(*[_AGG[k](e).alias(f"_t_{n}") for n, (k, e) in what.items()])
        carried = Window.partitionBy(*self.by).orderBy(F.desc("_part") if backward else "_part").rowsBetween(Window.unboundedPreceding, -1)
        before = whole.select(F.col("_part").alias("_q"), *[F.col(c).alias(f"_b_{i}") for i, c in enumerate(self.by)], *[_AGG[k](F.col(f"_t_{n}")).over(carried).alias(f"_c_{n}") for n, (k, _) in what.items()])
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_b_{i}")) for i, c in enumerate(self.by)], F.col("_part") == F.col("_q"))
        local = rows.withColumns({f"_l_{n}": _AGG[k](e).over(inside) for n, (k, e) in what.items()})
        out = local.join(before, same, "left").drop("_q", *[f"_b_{i}" for i in range(len(self.by))])
        done = {n: _MERGE[k](F.col(f"_l_{n}"), F.col(f"_c_{n}")) for n, (k, _) in what.items()}
        return out.withColumns(done).drop(*[f"_{x}_{n}" for x in "lc" for n in what])


def ranked(rows: DataFrame, by: tuple[str, ...], order: Order, name: str = "rank") -> DataFrame:
    """rows with their place from 1 in the group's order (rows that are equal in it get different places)."""
    ranged = Ranged(rows, by, order)
    return ranged.scan(ranged.rows, **{name: ("sum", F.lit(1))}).drop("_part")


def numbered(rows: DataFrame, *order: str, name: str = "id") -> DataFrame:
    """Dense ids from 1 in the given order over all rows."""
    return ranked(rows, (), tuple((c, False) for c in order), name)
