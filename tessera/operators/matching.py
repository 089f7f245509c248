"""Matchers: from query cells and a bank to point prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cell_centre
from . import geometry, search


def absolute(queries: DataFrame, bank: DataFrame, n: int = 10, threshold: float | None = 0.8, grid: tuple[int, int] = (96, 96), size: tuple[float, float] = (1536.0, 1536.0)) -> DataFrame:
    """Per (image, class) the n most similar cells above threshold (strictly; None: all)."""
    sims = search.best_similarity(queries, bank)
    sims = sims if threshold is None else sims.where(F.col("sim") > threshold)
    best = Window.partitionBy("image_id", "class_id").orderBy(F.desc("sim"), "row", "col")
    out = sims.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)
    return out.withColumn("x", cell_centre(F.col("col"), grid[1], size[1])).withColumn("y", cell_centre(F.col("row"), grid[0], size[0]))


def relative(queries: DataFrame, bank: DataFrame, peak: float = 0.05, distance: int = 3, margin: float = 0.0, grid: tuple[int, int] = (96, 96), size: tuple[float, float] = (1536.0, 1536.0)) -> DataFrame:
    """Local maxima above peak of the similarity less that to the other classes' banks."""
    conf = search.other_similarity(queries, bank, margin)
    out = geometry.local_maxima(conf, distance, peak, "conf")
    order = Window.partitionBy("image_id", "class_id").orderBy(F.desc("conf"), "row", "col")
    return out.withColumn("rank", F.row_number().over(order)).withColumn("x", cell_centre(F.col("col"), grid[1], size[1])).withColumn("y", cell_centre(F.col("row"), grid[0], size[0]))


def hybrid(queries: DataFrame, bank: DataFrame, loose: float = 0.8, smallest: int = 4, distance: int = 10, grid: tuple[int, int] = (96, 96), size: tuple[float, float] = (1536.0, 1536.0)) -> DataFrame:
    """Loose threshold, components, peaks."""
    return geometry.component_prompts(search.best_similarity(queries, bank), loose, smallest, distance, grid, size)


def validated(prompts: DataFrame, threshold: float | None = 0.8) -> DataFrame:
    return prompts if threshold is None else prompts.where(F.col("score") >= threshold)


def truncated(points: DataFrame, n: int) -> DataFrame:
    """The first n points of each (image, class) by rank."""
    return points.where(F.col("rank") <= n)
