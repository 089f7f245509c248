"""Grid geometry: components, local maxima, point suppression, prompts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..functions.vectors import cell_centre


def by_group(rows: DataFrame, by: tuple[str, ...], columns: tuple[str, ...], fn: Callable[[list[tuple]], list[tuple]], schema: str) -> DataFrame:
    """fn over the rows (tuples of columns) of each group. Groups are small and very many: partitions are sorted by key and
    streamed, without a data frame per group. Values pass as Arrow arrays: nulls are None, whole numbers stay exact beside
    them, and the rows of a null key are one group."""
    n, out_schema = len(by), StructType.fromDDL(schema)
    types = [to_arrow_type(f.dataType) for f in out_schema]
    dealt = rows.select(*by, *columns).repartition(*by).sortWithinPartitions(*by)

    def table(found: list[tuple]) -> pa.RecordBatch:
        values = zip(*found, strict=True) if found else [()] * len(types)
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], out_schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for x in batches:
            out: list[tuple] = []
            for row in zip(*[c.to_pylist() for c in x.columns], strict=True):
                if row[:n] != key:
                    if held:
                        out += [(*key, *r) for r in fn(held)]
                    key, held = row[:n], []
                held.append(row[n:])
            yield table(out)
        if held:
            yield table([(*key, *r) for r in fn(held)])

    return dealt.mapInArrow(run, out_schema)


_NEIGHBOURS = {4: ((-1, 0), (0, -1)), 8: ((-1, 0), (0, -1), (-1, -1), (-1, 1))}


def label_cells(rows: list[int], cols: list[int], connectivity: int = 8) -> list[int]:
    """Component number of each cell, numbered from 1 in row-major order of their first cells (union by least index)."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i], cols[i]))
    place, root = {}, list(range(len(rows)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    rank = {i: k for k, i in enumerate(order)}
    for i in order:
        for dr, dc in _NEIGHBOURS[connectivity]:
            j = place.get((rows[i] + dr, cols[i] + dc))
            if j is not None:
                a, b = find(i), find(j)
                if a != b:
                    low, high = (a, b) if rank[a] < rank[b] else (b, a)
                    root[high] = low
        place[rows[i], cols[i]] = i
    number: dict[int, int] = {}
    for i in order:
        number.setdefault(find(i), len(number) + 1)
    return [number[find(i)] for i in range(len(rows))]


def components(cells: DataFrame, by: tuple[str, ...] = ("image_id", "class_id"), connectivity: int = 8) -> DataFrame:
    """cells (by..., row, col, ...) with component. A group is one image's grid; cells without a row or col are left out."""
    cells = cells.where("row is not null and col is not null")
    kinds = {f.name: f.dataType.simpleString() for f in cells.schema.fields}
    others = tuple(c for c in cells.columns if c not in by)
    r, c = others.index("row"), others.index("col")

    def label(rows: list[tuple]) -> list[tuple]:
        return [(*x, k) for x, k in zip(rows, label_cells([x[r] for x in rows], [x[c] for x in rows], connectivity), strict=True)]

    return by_group(cells, by, others, label, ", ".join(f"{x} {kinds[x]}" for x in (*by, *others)) + ", component int")


def local_maxima(cells: DataFrame, distance: int, threshold: float, value: str = "sim", by: tuple[str, ...] = ("image_id", "class_id")) -> DataFrame:
    """Cells above threshold (strictly) that equal the maximum of the (2 * distance + 1)-square around them. The square
    maximum is separable: along columns within a row, then along rows."""
    across = Window.partitionBy(*by, "row").orderBy("col").rangeBetween(-distance, distance)
    down = Window.partitionBy(*by, "col").orderBy("row").rangeBetween(-distance, distance)
    out = cells.withColumn("_h", F.max(value).over(across)).withColumn("_m", F.max("_h").over(down))
    return out.where((F.col(value) == F.col("_m")) & (F.col(value) > threshold)).drop("_h", "_m")


def suppress(points: list[tuple], distance: float) -> list[int]:
    """Indexes of points (row, col) kept in the given order: one goes if nearer than distance to a kept one."""
    kept: list[int] = []
    for i, (r, c) in enumerate(points):
        if all((r - points[k][0]) ** 2 + (c - points[k][1]) ** 2 >= distance * distance for k in kept):
            kept.append(i)
    return kept


def nms_points(points: DataFrame, distance: float, value: str = "sim", by: tuple[str, ...] = ("image_id", "class_id")) -> DataFrame:
    """points in order of value, greedily suppressed within each group (ties by row, col). Points without a value or a place are
    left out."""
    points = points.where(F.col(value).isNotNull() & F.col("row").isNotNull() & F.col("col").isNotNull())
    kinds = {f.name: f.dataType.simpleString() for f in points.schema.fields}
    others = tuple(c for c in points.columns if c not in by)
    v, r, c = others.index(value), others.index("row"), others.index("col")

    def thin(rows: list[tuple]) -> list[tuple]:
        rows = sorted(rows, key=lambda x: (-x[v], x[r], x[c]))
        return [rows[i] for i in suppress([(x[r], x[c]) for x in rows], distance)]

    return by_group(points, by, others, thin, ", ".join(f"{x} {kinds[x]}" for x in (*by, *others)))


def window_maxima(at: dict[tuple[int, int], float], distance: int) -> list[tuple[int, int]]:
    """Cells that no cell within distance rows and columns exceeds, by sliding maxima over the cells' bounding box."""
    rows, cols = np.array([r for r, _ in at]), np.array([c for _, c in at])
    r, c, values = rows - rows.min() + distance, cols - cols.min() + distance, np.array(list(at.values()), float)
    box = np.full((r.max() + distance + 1, c.max() + distance + 1), -np.inf)
    box[r, c] = values
    high = np.lib.stride_tricks.sliding_window_view(box, 2 * distance + 1, axis=0).max(axis=-1)
    high = np.lib.stride_tricks.sliding_window_view(high, 2 * distance + 1, axis=1).max(axis=-1)
    top = values >= high[r - distance, c - distance]
    return list(zip(rows[top].tolist(), cols[top].tolist(), strict=True))


def component_prompts(cells: DataFrame, loose: float = 0.8, smallest: int = 4, distance: int = 10, grid: tuple[int, int] = (96, 96), size: tuple[float, float] = (1536.0, 1536.0)) -> DataFrame:
    """Prompts of a similarity map: cells with sim >= loose, 8-connected, components of at least smallest cells, their local
    maxima suppressed (the largest cell where none is left), in order of score, component, peak.

    cells: (image_id, class_id, row, col, sim); result with component, row, col, x, y, score, rank."""

    def prompts(rows: list[tuple]) -> list[tuple]:
        rows = sorted(rows)
        parts: dict[int, dict] = {}
        for (r, c, s), comp in zip(rows, label_cells([x[0] for x in rows], [x[1] for x in rows], 8), strict=True):
            parts.setdefault(comp, {})[r, c] = s
        out = []
        for comp, at in parts.items():
            if len(at) < smallest:
                continue
            peaks = window_maxima(at, distance)
            peaks.sort(key=lambda p: (-at[p], p))
            peaks = [peaks[i] for i in suppress(peaks, distance)] or [max(at, key=lambda p: (at[p], -p[0], -p[1]))]
            out += [(comp, k, r, c, at[r, c]) for k, (r, c) in enumerate(peaks)]
        out.sort(key=lambda p: (-p[4], p[0], p[1]))
        return [(comp, r, c, s, k + 1) for k, (comp, _, r, c, s) in enumerate(out)]

    found = by_group(cells.where(F.col("sim") >= loose), ("image_id", "class_id"), ("row", "col", "sim"), prompts, "image_id long, class_id int, component int, row int, col int, score double, rank int")
    return found.withColumn("x", cell_centre(F.col("col"), grid[1], size[1])).withColumn("y", cell_centre(F.col("row"), grid[0], size[0]))


def grid_from_mask(pixels: DataFrame, patch: int = 16, height: str = "height", width: str = "width") -> DataFrame:
    """Share of each patch that a pixel relation (image_id, class_id, y, x) covers."""
    return pixels.groupBy("image_id", "class_id", F.floor(F.col("y") / patch).cast("int").alias("row"), F.floor(F.col("x") / patch).cast("int").alias("col")).agg((F.count("*") / float(patch * patch)).alias("coverage"))


def clamped_polygon(xs: Column, ys: Column, width: Column, height: Column) -> Column:
    """Flat x, y array of a valid polygon with its points inside the image, else null (fewer than 3 points, lengths differ)."""
    cut = lambda v, top: F.least(F.greatest(v.cast("double"), F.lit(0.0)), (top - 1).cast("double"))
    flat = F.flatten(F.zip_with(xs, ys, lambda x, y: F.array(cut(x, width), cut(y, height))))
    return F.when((F.size(xs) == F.size(ys)) & (F.size(xs) >= 3), flat)


def polygon_area(flat: Column) -> Column:
    """Shoelace area of a flat x, y array."""
    n = F.size(flat) / 2
    at = lambda i: F.element_at(flat, i.cast("int"))
    terms = F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda k: at(2 * k + 1) * at(2 * ((k + 1) % n.cast("int")) + 2) - at(2 * ((k + 1) % n.cast("int")) + 1) * at(2 * k + 2))
    return F.abs(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)) / 2


def resized(mask: np.ndarray, height: int, width: int, centre: bool = True) -> np.ndarray:
    """Nearest-neighbour resize; centre: sample in the middle of a cell, else at its start."""
    add = 0.5 if centre else 0.0
    ys = np.minimum(((np.arange(height) + add) * mask.shape[0] / height).astype(int), mask.shape[0] - 1)
    xs = np.minimum(((np.arange(width) + add) * mask.shape[1] / width).astype(int), mask.shape[1] - 1)
    return mask[ys][:, xs]
