"""Adaptive tilings and scans from a histogram of cells.

The quadtree asks for point counts of boxes.  All of them are sums over one histogram of cells, which is worked out once
by the cluster and rolled up to at most MAX_BLOCKS square blocks before it comes to the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import Bounds, Extents, Grid
from .points import cell_counts

#: Counts that come to the driver at most.
MAX_BLOCKS = 1 << 20


@dataclass
class Histogram:
    """Summed counts of blocks of ``side`` x ``side`` cells."""

    side: int
    x1: int
    y1: int
    sums: np.ndarray  # (ny + 1, nx + 1), cumulative

    def count(self, e: Extents) -> int:
        """Points of a box; a block that it only covers in part counts in full, so this is an upper estimate for blocks over one cell."""
        at = lambda v, low, n: min(max(v, 0), n) if low else min(max(v, 0), n)
        ny, nx = self.sums.shape[0] - 1, self.sums.shape[1] - 1
        x1, y1 = at((e.x1 - self.x1) // self.side, True, nx), at((e.y1 - self.y1) // self.side, True, ny)
        x2, y2 = at(-((self.x1 - e.x2) // self.side), False, nx), at(-((self.y1 - e.y2) // self.side), False, ny)
        if x2 <= x1 or y2 <= y1:
            return 0
        s = self.sums
        return int(s[y2, x2] - s[y1, x2] - s[y2, x1] + s[y1, x1])


def histogram(points: DataFrame, extents: Extents) -> Histogram:
    width, height = max(1, extents.x2 - extents.x1), max(1, extents.y2 - extents.y1)
    side = max(1, math.ceil(math.sqrt(width * height / MAX_BLOCKS)))
    nx, ny = -(-width // side), -(-height // side)
    cells = cell_counts(points, extents.grid, extents.bounds)
    blocks = cells.groupBy(F.floor((F.col("xi") - extents.x1) / side).cast("int").alias("bx"), F.floor((F.col("yi") - extents.y1) / side).cast("int").alias("by")).agg(F.sum("n").alias("n"))
    grid = np.zeros((ny + 1, nx + 1), np.int64)
    for r in blocks.collect():
        if 0 <= r["bx"] < nx and 0 <= r["by"] < ny:
            grid[r["by"] + 1, r["bx"] + 1] = r["n"]
    return Histogram(side, extents.x1, extents.y1, grid.cumsum(0).cumsum(1))


def quadtree(points: DataFrame, extents: Extents, threshold: int = 600_000) -> list[Extents]:
    """Tiles with ``threshold`` points at most, or too small to split; without empty ones."""
    counts = histogram(points, extents)
    out, level = [], [(extents, 0)]
    while level:
        below = []
        for e, before in level:
            n = counts.count(e)
            if not n:
                continue
            b = e.bounds
            smallest = min(b.maxx - b.minx, b.maxy - b.miny) / 2 < extents.grid.res
            if smallest or n <= threshold or n == before:
                out.append(e)
            else:
                below += [(child, n) for child in e.split()]
        level = below
    return out


def scan_tiles(points: DataFrame, extents: Extents, point_count: int = 600_000, resolution: float = 100, depth: int = 6) -> list[int]:
    """Cells per tile of a quadtree that stops at a point count, a tile size or a depth."""
    counts = histogram(points, extents)
    res, out, todo = extents.grid.res, [], [(extents, 0)]
    while todo:
        e, level = todo.pop(0)
        n = counts.count(e)
        if not n:
            continue
        b = e.bounds
        w, h = b.maxx - b.minx, b.maxy - b.miny
        if min(w, h) / 2 < res or n < point_count:
            out.append(e.cell_count)
        elif w * h < resolution**2 or level >= depth:
            per_tile = math.ceil(point_count / (n / (w * h / res**2)))
            whole, rest = divmod(e.cell_count, per_tile)
            out += [per_tile] * whole + [rest]
        else:
            todo += [(child, level + 1) for child in e.split()]
    return out


def scan(points: DataFrame, grid: Grid, bounds: Bounds | None = None, point_count: int = 600_000, resolution: float = 100, depth: int = 6) -> dict:
    """A summary of tile sizes; the median without outliers is recommended."""
    box = grid.root if bounds is None else bounds.shared(grid.root)
    if box is None:
        return {"pc_info": {"storage_bounds": grid.root.to_list(), "data_bounds": bounds.to_list(), "count": 0}, "tile_info": {"num_cells": 0, "num_tiles": 0, "mean": None, "std_dev": None, "median": None, "recommended": None}}
    extents = grid.extents(box)
    tiles = np.array(scan_tiles(points, extents, point_count, resolution, depth), np.float64)
    kept = tiles
    if len(tiles) > 1:
        q1, q3 = np.percentile(tiles, [25, 75])
        near = tiles[(tiles > q1 - 1.5 * (q3 - q1)) & (tiles < q3 + 1.5 * (q3 - q1))]
        kept = near if len(near) else tiles  # without any spread the strict limits would drop all
    stat = lambda f: float(f(kept)) if len(kept) else None
    info = {"num_cells": int(tiles.sum()), "num_tiles": len(tiles), "mean": stat(np.mean), "std_dev": stat(np.std), "median": stat(np.median), "recommended": stat(np.median)}
    total = points.where(extents.bounds.holds(F.col("X"), F.col("Y"))).count()
    return {"pc_info": {"storage_bounds": grid.root.to_list(), "data_bounds": box.to_list(), "count": total}, "tile_info": info}
