"""The verbs: initialize, shatter, extract, info, delete, restart, resume."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import Bounds, Extents
from ..plans.planner import Plan
from ..sinks import raster
from ..store import CellStore, Ingest, StoreConfig, date_pair, overlaps
from . import tiling
from .points import binned, densified, within


def initialize(spark: SparkSession, path: str, config: StoreConfig, extra=None) -> CellStore:
    return CellStore.create(spark, path, config, extra)


@dataclass
class ShatterConfig:
    """One ingest.

    ``bounds`` is the data's own box if none is given.  With ``batches`` over one, strips of storage tiles are
    ingested one after the other, each from a scan of its own that reads its box only; progress is saved after each, so that an
    interrupted ingest is resumed behind the last strip.
    """

    dates: tuple = ()
    bounds: Bounds | None = None
    name: str = field(default_factory=lambda: str(uuid.uuid4()))
    tile_size: int | None = None
    parity: bool = False
    batches: int = 1


def cells_of(store: CellStore, points: DataFrame, box: Bounds, parity: bool = False) -> DataFrame:
    """One row per cell of a box: raw values, count and metrics, in one aggregation.

    With ``parity`` cells without a value of the first metric lose all metrics, as they do where
    all results are joined to the first one's.
    """
    names = list(store.config.attributes)
    near = within(points, box, store.grid.res)
    rows = binned(near, store.grid, names)
    extra = [F.sort_array(F.collect_list(F.col(f"`{a}`").cast(t))).alias(a) for a, t in store.config.attributes.items()]
    cells = Plan(store.metrics, names).run(rows, extra=[*extra, F.count("*").alias("count")], keep=(*names, "count"))
    if parity:
        made = [c for c in cells.columns if c.startswith("m_")]
        first = F.col(f"`{made[0]}`").isNotNull()
        cells = cells.withColumns({c: F.when(first, F.col(f"`{c}`")) for c in made})
    return cells.withColumns({c: F.col(f"`{c}`").cast("float") for c, m in store.metric_columns().items() if m.dtype == "float32"})


def shatter(store: CellStore, points: DataFrame, config: ShatterConfig) -> Ingest:
    """Aggregate points to cells and write them as a new slot."""
    first, last = date_pair(config.dates)
    box = _box(store, points, config.bounds)
    entry = Ingest(config.name, store.reserve_slot(), (box or store.grid.root).to_list(), first, last, config.tile_size, written_from=int(time.time() * 1000))
    store.save(entry)
    return _ingest(store, points, entry, box, config.parity, config.batches)


def _box(store: CellStore, points: DataFrame, bounds: Bounds | None) -> Bounds | None:
    """The part of the root that the data's box, aligned to cells, covers; None without any."""
    if bounds is None:
        r = points.agg(F.min("X"), F.min("Y"), F.max("X"), F.max("Y")).first()
        if r[0] is None:
            return None
        # the upper edges belong to the next cell: points on them want one cell more
        step = store.grid.res
        bounds = Bounds(*r).aligned(step, store.grid.alignment)
        bounds = Bounds(bounds.minx, bounds.miny, bounds.maxx + (step if r[2] >= bounds.maxx else 0), bounds.maxy + (step if r[3] >= bounds.maxy else 0))
    return bounds.aligned(store.grid.res, store.grid.alignment).shared(store.grid.root)


def strips(store: CellStore, box: Bounds, n: int) -> list[Bounds]:
    """A box in up to n strips of whole columns of storage tiles."""
    x, res, e = store.config.xsize, store.grid.res, store.grid.extents(box)
    first, last = e.x1 // x, (e.x2 - 1) // x + 1
    n = max(1, min(n, last - first))
    edges = [box.minx, *[store.grid.root.minx + res * x * (first + (last - first) * k // n) for k in range(1, n)], box.maxx]
    return [Bounds(a, box.miny, b, box.maxy) for a, b in zip(edges, edges[1:])]


def _batch(store: CellStore, cells: DataFrame, entry: Ingest, batch: int) -> None:
    """Write a batch and save that it is done, with its rectangles and points."""
    written = store.write_cells(cells, entry, batch)
    stats = written.groupBy("tile_x", "tile_y").agg(F.min("X").alias("x1"), F.max("X").alias("x2"), F.min("Y").alias("y1"), F.max("Y").alias("y2"), F.sum("count").alias("n")).collect()
    entry.mbr = sorted([*map(list, entry.mbr), *([r["x1"], r["x2"] + 1, r["y1"], r["y2"] + 1] for r in stats)])
    entry.point_count += sum(r["n"] for r in stats)
    entry.done = sorted({*entry.done, batch})
    entry.written_to = int(time.time() * 1000)
    store.save(entry)


def _ingest(store: CellStore, points: DataFrame, entry: Ingest, box: Bounds | None, parity: bool = False, batches: int = 1) -> Ingest:
    for k, part in enumerate(strips(store, box, batches) if box is not None else []):
        _batch(store, cells_of(store, points, part, parity), entry, k)
    entry.written_to = int(time.time() * 1000)
    entry.finished = True
    store.save(entry)
    return entry


def restart(store: CellStore, points: DataFrame, name: str, batches: int = 1) -> Ingest:
    """Run an ingest again in its own slot; what it held is forgotten first."""
    entry = store.entry(name)
    entry.finished, entry.deleted, entry.mbr, entry.point_count, entry.done = False, False, [], 0, []
    store.save(entry)
    store.clear_slot(entry.time_slot)
    return _ingest(store, points, entry, _box(store, points, Bounds.parse(entry.bounds)), batches=batches)


def not_done(leaves: list[Extents], done: list[list[int]]) -> list[Extents]:
    """Leaf tiles that share no cell with a finished rectangle (x1, x2, y1, y2; upper ends exclusive)."""
    return [e for e in leaves if all(e.disjoint(tuple(r)) for r in done)]


def resume(store: CellStore, points: DataFrame, name: str) -> Ingest:
    """Go on with an ingest: cells in its saved rectangles are left as they are; returns the points of the others."""
    entry = store.entry(name)
    box = _box(store, points, Bounds.parse(entry.bounds))
    if box is None:
        return entry
    # one rectangle per storage tile: their number is that of the slot's folders, which bounds the broadcast
    done = F.broadcast(store.spark.createDataFrame([list(r) for r in entry.mbr], "x1 int, x2 int, y1 int, y2 int"))
    inside = lambda x, y: (F.col(x) >= F.col("x1")) & (F.col(x) < F.col("x2")) & (F.col(y) >= F.col("y1")) & (F.col(y) < F.col("y2"))
    cells = cells_of(store, points, box).join(done, inside("xi", "yi"), "left_anti")
    # a batch of its own: an attempt that was not saved is not seen, and is overwritten here
    entry.point_count = 0
    _batch(store, cells, entry, max(entry.done, default=-1) + 1)
    entry.finished = True
    store.save(entry)
    return entry


def delete(store: CellStore, name: str) -> Ingest:
    """Mark an ingest as deleted: its cells hold nothing any more, and older ones don't come back."""
    entry = store.entry(name)
    entry.deleted, entry.finished, entry.mbr, entry.point_count = True, False, [], 0
    store.save(entry)
    return entry


def info(store: CellStore, dates=None, bounds: Bounds | None = None, name: str | None = None, concise: bool = False) -> dict:
    entries = store.history(dates, bounds, name)
    short = ("name", "time_slot", "bounds", "start", "end", "point_count", "finished")
    return {
        "attributes": [{"name": a, "dtype": t} for a, t in store.config.attributes.items()],
        "metadata": store.config.to_json(),
        "metrics": [{"name": m.name, "dtype": m.dtype, "attributes": list(m.attributes), "filter": m.filter.condition, "nan_policy": m.nan_policy} for m in store.metrics],
        "history": [{k: v for k, v in vars(e).items() if not concise or k in short} for e in entries],
    }


def history_table(store: CellStore) -> DataFrame:
    rows = [(e.name, e.time_slot, *e.bounds, e.start, e.end, e.point_count, e.finished, e.deleted) for e in store.history()]
    return store.spark.createDataFrame(rows, "name string, time_slot int, minx double, miny double, maxx double, maxy double, start string, end string, point_count long, finished boolean, deleted boolean")


def extract(store: CellStore, out: str | None = None, columns: list[str] | None = None, bounds: Bounds | None = None, dates=None, as_of_ms: int | None = None, form: str = "tif") -> DataFrame:
    """The cells of a box between two days, dense, with nodata values; rasters are written to ``out`` if given."""
    known = store.metric_columns()
    columns = list(known) if columns is None else columns
    for c in columns:
        if c not in known:
            raise ValueError(f"no column {c}")
    box = store.grid.root if bounds is None else bounds.aligned(store.grid.res, store.grid.alignment).shared(store.grid.root)
    if box is None:
        raise ValueError(f"{bounds} shares no cell with the database's root {store.grid.root}")
    extents = store.grid.extents(box)
    cells = store.read(extents, dates, as_of_ms, columns=columns)
    if cells is None:
        kinds = ", ".join(f"`{c}` double" for c in columns)
        cells = store.spark.createDataFrame([], f"X int, Y int, {kinds}")
    full = densified(cells.select("X", "Y", *[F.col(f"`{c}`") for c in columns]), extents)
    full = full.select("X", "Y", *[F.coalesce(F.col(f"`{c}`"), F.lit(known[c].nodata)).alias(c) for c in columns])
    if out is not None:
        raster.write_all(full, extents, {c: known[c].dtype for c in columns}, {c: known[c].nodata for c in columns}, out, store.config.crs, form)
    return full


def scan(store: CellStore, points: DataFrame, bounds: Bounds | None = None, point_count: int = 600_000, resolution: float = 100, depth: int = 6) -> dict:
    return tiling.scan(points, store.grid, bounds, point_count, resolution, depth)


def between(cells: DataFrame, dates) -> DataFrame:
    """Cells whose days overlap a pair of days."""
    return cells.where(overlaps("start_date", "end_date", *date_pair(dates)))
