"""Boxes and grids, as frozen values that emit DataFrame expressions.

A grid's origin is the top-left corner of its root box.  Cell (xi, yi) holds the points with
minx + xi*res <= X < minx + (xi+1)*res and maxy - (yi+1)*res <= Y < maxy - yi*res.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

CORNER, CENTER = "AlignToCorner", "AlignToCenter"
_ALIGNMENTS = {"aligntocorner": CORNER, "pixelisarea": CORNER, "aligntocenter": CENTER, "pixelispoint": CENTER}


def alignment_name(name: str) -> str:
    if name.lower() not in _ALIGNMENTS:
        raise ValueError(f"Invalid pixel alignment: {name}")
    return _ALIGNMENTS[name.lower()]


@dataclass(frozen=True)
class Bounds:
    minx: float
    miny: float
    maxx: float
    maxy: float

    def __post_init__(self):
        for f in ("minx", "miny", "maxx", "maxy"):
            object.__setattr__(self, f, float(getattr(self, f)))

    @classmethod
    def parse(cls, text: str | list | dict | Bounds) -> Bounds:
        """A JSON object, a list of 4 or 6 numbers, or ``([minx,maxx],[miny,maxy][,[minz,maxz]])``."""
        if isinstance(text, Bounds):
            return text
        value = text
        if isinstance(text, str):
            s = text.strip()
            if s.startswith("("):
                s = "[" + s.strip("()") + "]"
            try:
                value = json.loads(s)
            except ValueError as e:
                raise ValueError(f"Unable to load bounds from {text!r}") from e
        if isinstance(value, dict):
            try:
                return cls(value["minx"], value["miny"], value["maxx"], value["maxy"])
            except KeyError as e:
                raise ValueError(f"bounds lack {e}") from e
        if isinstance(value, (list, tuple)):
            if len(value) in (2, 3) and all(isinstance(v, (list, tuple)) and len(v) == 2 for v in value):
                (x0, x1), (y0, y1) = value[0], value[1]
                return cls(x0, y0, x1, y1)
            if len(value) == 4:
                return cls(*value)
            if len(value) == 6:
                return cls(value[0], value[1], value[3], value[4])
        raise ValueError(f"Unable to load bounds from {text!r}")

    def to_list(self) -> list[float]:
        return [self.minx, self.miny, self.maxx, self.maxy]

    def __str__(self) -> str:
        return f"([{self.minx:.2f},{self.maxx:.2f}],[{self.miny:.2f},{self.maxy:.2f}])"

    def bisect(self) -> list[Bounds]:
        """Lower left, lower right, top left and top right quarters."""
        cx, cy = self.minx + (self.maxx - self.minx) / 2, self.miny + (self.maxy - self.miny) / 2
        return [Bounds(x0, y0, x1, y1) for y0, y1 in ((self.miny, cy), (cy, self.maxy)) for x0, x1 in ((self.minx, cx), (cx, self.maxx))]

    def disjoint(self, other: Bounds) -> bool:
        """Boxes that only touch are disjoint, as no box holds the points on its upper edges."""
        return other.minx >= self.maxx or other.maxx <= self.minx or other.miny >= self.maxy or other.maxy <= self.miny

    def shared(self, other: Bounds) -> Bounds | None:
        if self.disjoint(other):
            return None
        return Bounds(max(self.minx, other.minx), max(self.miny, other.miny), min(self.maxx, other.maxx), min(self.maxy, other.maxy))

    def grown(self, by: float) -> Bounds:
        return Bounds(self.minx - by, self.miny - by, self.maxx + by, self.maxy + by)

    def aligned(self, res: float, alignment: str) -> Bounds:
        """Grown to cell corners (multiples of res) or to cell centres' corners (odd multiples of res/2)."""
        off = 0.0 if alignment_name(alignment) == CORNER else res / 2.0
        down = lambda v: v if (v - off) % res == 0 else v - (v - off) % res
        up = lambda v: v if (v - off) % res == 0 else v + (res - (v - off) % res)
        return Bounds(down(self.minx), down(self.miny), up(self.maxx), up(self.maxy))

    def holds(self, x: Column, y: Column) -> Column:
        """Half-open: points on the upper edges belong to the next box."""
        return (x >= self.minx) & (x < self.maxx) & (y >= self.miny) & (y < self.maxy)

    def holds_closed(self, x: Column, y: Column) -> Column:
        return (x >= self.minx) & (x <= self.maxx) & (y >= self.miny) & (y <= self.maxy)


@dataclass(frozen=True)
class Grid:
    """A root box cut into square cells."""

    root: Bounds
    res: float
    alignment: str = CENTER

    def __post_init__(self):
        object.__setattr__(self, "alignment", alignment_name(self.alignment))
        object.__setattr__(self, "res", float(self.res))
        object.__setattr__(self, "root", self.root.aligned(self.res, self.alignment))

    def xi(self, x: Column) -> Column:
        return F.floor((x - self.root.minx) / self.res).cast("int")

    def yi(self, y: Column) -> Column:
        return F.ceil((self.root.maxy - y) / self.res - 1).cast("int")

    def extents(self, bounds: Bounds | None = None) -> Extents:
        return Extents.of(self, bounds or self.root)

    @property
    def shape(self) -> tuple[int, int]:
        """Columns and rows of the dense domain: indexes go from 0 to floor(width/res) inclusive."""
        return math.floor((self.root.maxx - self.root.minx) / self.res) + 1, math.floor((self.root.maxy - self.root.miny) / self.res) + 1


@dataclass(frozen=True)
class Extents:
    """A box of a grid with its index ranges [x1, x2) and [y1, y2)."""

    grid: Grid
    bounds: Bounds
    x1: int
    x2: int
    y1: int
    y2: int

    @classmethod
    def of(cls, grid: Grid, bounds: Bounds) -> Extents:
        b, r, root = bounds.aligned(grid.res, grid.alignment), grid.res, grid.root
        return cls(grid, b, math.floor((b.minx - root.minx) / r), math.ceil((b.maxx - root.minx) / r), math.ceil((root.maxy - b.maxy) / r), math.ceil((root.maxy - b.miny) / r))

    @property
    def cell_count(self) -> int:
        b = self.bounds
        return int((b.maxx - b.minx) * (b.maxy - b.miny) / self.grid.res**2)

    def holds(self, xi: Column, yi: Column) -> Column:
        return (xi >= self.x1) & (xi < self.x2) & (yi >= self.y1) & (yi < self.y2)

    def indices(self) -> Iterator[tuple[int, int]]:
        return ((x, y) for x in range(self.x1, self.x2) for y in range(self.y1, self.y2))

    def disjoint(self, rect: tuple[int, int, int, int]) -> bool:
        """Whether an index rectangle (x1, x2, y1, y2), upper ends exclusive, shares no cell with this one."""
        x1, x2, y1, y2 = rect
        return x1 >= self.x2 or x2 <= self.x1 or y1 >= self.y2 or y2 <= self.y1

    def overlap(self, other: Extents) -> Extents | None:
        shared = self.bounds.shared(other.bounds)
        return None if shared is None else Extents.of(self.grid, shared)

    def split(self) -> list[Extents]:
        """Four quarters along cell lines: columns rounded down, rows rounded up from the top."""
        b, r = self.bounds, self.grid.res
        midx = b.minx + math.floor((b.maxx - b.minx) / 2 / r) * r
        midy = b.maxy - math.ceil((b.maxy - b.miny) / 2 / r) * r
        parts = [Bounds(x0, y0, x1, y1) for y0, y1 in ((b.miny, midy), (midy, b.maxy)) for x0, x1 in ((b.minx, midx), (midx, b.maxx))]
        return [Extents.of(self.grid, p) for p in parts]

    def leaves(self, tile_size: int) -> list[Extents]:
        """Square tiles of floor(sqrt(tile_size)) cells a side, clipped to this box."""
        k, r, root = max(1, math.isqrt(int(tile_size))), self.grid.res, self.grid.root
        out = []
        for x in range(self.x1, self.x2, k):
            for y in range(self.y1, self.y2, k):
                x2, y2 = min(x + k, self.x2), min(y + k, self.y2)
                out.append(replace(self, bounds=Bounds(root.minx + r * x, root.maxy - r * y2, root.minx + r * x2, root.maxy - r * y), x1=x, x2=x2, y1=y, y2=y2))
        return out
