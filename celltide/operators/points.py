"""Operators on points: bounds, binning, counting, raw values per cell."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import Bounds, Extents, Grid


def within(points: DataFrame, bounds: Bounds, collar: float = 0.0) -> DataFrame:
    """Points of a half-open box.

    With a collar the plain range of the grown box comes first, for sources that prune by it; the exact box follows.
    """
    x, y = F.col("X"), F.col("Y")
    if collar:
        points = points.where(bounds.grown(collar).holds_closed(x, y))
    return points.where(bounds.holds(x, y))


def binned(points: DataFrame, grid: Grid, attributes: list[str] | None = None) -> DataFrame:
    """Add the cell indexes ``xi`` and ``yi``; keep only the attributes asked for, if any are named."""
    x, y = F.col("X").cast("double"), F.col("Y").cast("double")
    kept = [F.col(f"`{a}`") for a in attributes] if attributes is not None else ["*"]
    return points.select(*kept, grid.xi(x).alias("xi"), grid.yi(y).alias("yi"))


def cell_counts(points: DataFrame, grid: Grid, bounds: Bounds | None = None) -> DataFrame:
    """(xi, yi, n) of the cells with points: the pre-aggregate that scans and tilings roll up."""
    return binned(within(points, bounds or grid.root), grid, []).groupBy("xi", "yi").agg(F.count("*").alias("n"))


def raw_values(cells: DataFrame, attributes: list[str]) -> DataFrame:
    """Per cell the values of each attribute in order, and the number of points."""
    return cells.groupBy("xi", "yi").agg(*[F.sort_array(F.collect_list(a)).alias(a) for a in attributes], F.count("*").alias("count"))


def count_closed(points: DataFrame, bounds: Bounds) -> int:
    """Points of a box with all its edges, as point readers count them."""
    return points.where(bounds.holds_closed(F.col("X"), F.col("Y"))).count()


def source_bounds(points: DataFrame) -> DataFrame:
    return points.agg(F.min("X").alias("minx"), F.min("Y").alias("miny"), F.max("X").alias("maxx"), F.max("Y").alias("maxy"))


def keep_points(points: DataFrame, test: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A user's filter on whole frames of points."""
    return points.transform(test)


def in_leaves(cells: DataFrame, extents: Extents, tile_size: int) -> DataFrame:
    """Add the position (tx, ty) of the leaf tile that holds each cell."""
    k = max(1, int(tile_size**0.5))
    tx, ty = F.floor((F.col("xi") - extents.x1) / k).cast("int"), F.floor((F.col("yi") - extents.y1) / k).cast("int")
    return cells.where(extents.holds(F.col("xi"), F.col("yi"))).withColumns({"tx": tx, "ty": ty})


def dense_cells(df: DataFrame, extents: Extents) -> DataFrame:
    """All (X, Y) of a box, from ``df``'s session: a sequence per row, exploded by the executors."""
    rows = df.sparkSession.range(extents.y1, extents.y2).select(F.col("id").cast("int").alias("Y"))
    return rows.select(F.explode(F.sequence(F.lit(extents.x1), F.lit(extents.x2 - 1))).alias("X"), "Y") if extents.x2 > extents.x1 else rows.select(F.lit(0).alias("X"), "Y").limit(0)


def densified(cells: DataFrame, extents: Extents) -> DataFrame:
    """One row per cell of the box, with nulls where there is none."""
    return dense_cells(cells, extents).join(cells, ["X", "Y"], "left")


def pivoted(cells: DataFrame, value: str, extents: Extents) -> DataFrame:
    """A raster as rows: (Y, values), values by ascending X with nulls for empty cells."""
    full = densified(cells.select("X", "Y", F.col(f"`{value}`").alias("v")), extents)
    row = F.transform(F.array_sort(F.collect_list(F.struct("X", "v"))), lambda c: c["v"])
    return full.groupBy("Y").agg(row.alias("values"))
