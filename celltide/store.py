"""A versioned store of cells: Parquet by time slot and tile, with a JSON configuration and history beside.

``root/_config.json``            what the database was made with
``root/history/slot=N.json``     one document per ingest; its creation reserves the slot
``root/cells/time_slot=N/batch=K/...``   the cells that batch K of ingest N wrote, by tile, sorted by cell
``root/cells/base=ID/...``       the cells that a compaction wrote, with the slots they came from
``root/_manifest.json``          which base is valid, and which batches it has taken in

Later slots win per cell.  A deleted slot still hides older ones where it had cells, as if it held nothing there.  Only batches
that the history names as done are read, and only the base that the manifest names: what a crash left is
never seen, and is overwritten by the next attempt or removed by :meth:`CellStore.vacuum`.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, dataclass, field
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.geometry import Bounds, Extents, Grid
from .operators.metrics import Metric, Registry

DEFAULT_ATTRIBUTES = {"Z": "double", "NumberOfReturns": "short", "ReturnNumber": "short", "Intensity": "int"}
DATE = "%Y-%m-%dT%H:%M:%SZ"


class Files:
    """Small files through Hadoop's file systems, so that a store can lie in any of them."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def fs(self, name: str = ""):
        return self.path(name or ".").getFileSystem(self.conf)

    def exists(self, name: str) -> bool:
        return self.fs(name).exists(self.path(name))

    def create(self, name: str, data: dict) -> bool:
        """Write a file that must not be there yet; False if it is."""
        try:
            out = self.fs(name).create(self.path(name), False)
        except Exception as e:
            if "FileAlreadyExists" in str(e) or "already exists" in str(e):
                return False
            raise
        self._fill(out, data)
        return True

    def replace(self, name: str, data: dict) -> None:
        """Readers see the old or the new file, whenever the writer stops.

        File systems with renames replace the file by one rename; object stores publish a file as a whole when it is closed.
        """
        hadoop, path = self.jvm.org.apache.hadoop.fs, self.path(name)
        if self.fs(name).getScheme() not in ("file", "hdfs", "viewfs"):
            self._fill(self.fs(name).create(path, True), data)
            return
        beside = self.path(f"{name}.{uuid.uuid4().hex}.new")
        self._fill(self.fs(name).create(beside, True), data)
        rename = getattr(self.jvm, "org.apache.hadoop.fs.Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        hadoop.FileContext.getFileContext(self.fs(name).makeQualified(path).toUri(), self.conf).rename(self.fs(name).makeQualified(beside), self.fs(name).makeQualified(path), how)

    @staticmethod
    def _fill(out, data: dict) -> None:
        try:
            out.write(bytearray(json.dumps(data, indent=1).encode()))
        finally:
            out.close()

    def read(self, name: str) -> dict:
        stream = self.fs(name).open(self.path(name))
        try:
            return json.loads(bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def names(self, folder: str) -> list[str]:
        if not self.exists(folder):
            return []
        return sorted(s.getPath().getName() for s in self.fs(folder).listStatus(self.path(folder)))

    def delete(self, name: str) -> None:
        self.fs(name).delete(self.path(name), True)


@dataclass
class StoreConfig:
    """What a database is made with.  Metrics are kept by the names that the registry resolves."""

    root: Bounds
    resolution: float = 30.0
    crs: str = ""
    alignment: str = "AlignToCenter"
    attributes: dict[str, str] = field(default_factory=lambda: dict(DEFAULT_ATTRIBUTES))
    metrics: list[str] = field(default_factory=lambda: ["grid_metrics"])
    xsize: int = 1000
    ysize: int = 1000
    projected: bool = True

    def to_json(self) -> dict:
        return asdict(self) | {"root": self.root.to_list()}

    @classmethod
    def from_json(cls, data: dict) -> StoreConfig:
        return cls(**(data | {"root": Bounds.parse(data["root"])}))


@dataclass
class Ingest:
    """The history entry of one ingest."""

    name: str
    time_slot: int
    bounds: list[float]
    start: str
    end: str
    tile_size: int | None = None
    point_count: int = 0
    finished: bool = False
    deleted: bool = False
    mbr: list[list[int]] = field(default_factory=list)
    #: The batches whose cells are written and counted.
    done: list[int] = field(default_factory=list)
    written_from: int = 0
    written_to: int = 0

    def overlaps_dates(self, first: str | None, last: str | None) -> bool:
        return (first is None or self.end >= first) and (last is None or self.start <= last)


def as_date(value: str | date | datetime) -> str:
    """A day as YYYY-MM-DD."""
    if isinstance(value, datetime):
        return value.date().isoformat()
    if isinstance(value, date):
        return value.isoformat()
    for form in (DATE, "%Y-%m-%d"):
        try:
            return datetime.strptime(value, form).date().isoformat()
        except ValueError:
            continue
    raise ValueError(f"not a date: {value!r}")


def date_pair(dates) -> tuple[str, str]:
    """One or two dates as a pair of days."""
    if isinstance(dates, (str, date)):
        dates = (dates,)
    days = sorted(as_date(d) for d in dates)
    if len(days) not in (1, 2):
        raise ValueError("one or two dates are wanted")
    return days[0], days[-1]


class CellStore:
    """An open database."""

    def __init__(self, spark: SparkSession, path: str, config: StoreConfig, extra: dict[str, Metric] | None = None):
        self.spark, self.path, self.config = spark, path.rstrip("/"), config
        self.files = Files(spark, self.path)
        self.grid = Grid(config.root, config.resolution, config.alignment)
        self.metrics = Registry(extra or {}).resolve(config.metrics)

    @classmethod
    def create(cls, spark: SparkSession, path: str, config: StoreConfig, extra: dict[str, Metric] | None = None) -> CellStore:
        if not config.projected:
            raise ValueError("a projected coordinate system is wanted")
        grid = Grid(config.root, config.resolution, config.alignment)
        columns, rows = grid.shape
        config.xsize, config.ysize = min(int(config.xsize), columns), min(int(config.ysize), rows)
        store = cls(spark, path, config, extra)
        for m in store.metrics:
            for a in m.attributes:
                if a not in config.attributes:
                    raise ValueError(f"Missing required dependency, {a}.")
        if not store.files.create("_config.json", config.to_json()):
            raise FileExistsError(f"there is a database at {path}")
        return store

    @classmethod
    def open(cls, spark: SparkSession, path: str, extra: dict[str, Metric] | None = None) -> CellStore:
        files = Files(spark, path)
        if not files.exists("_config.json"):
            raise FileNotFoundError(f"no database at {path}")
        return cls(spark, path, StoreConfig.from_json(files.read("_config.json")), extra)

    def metric_columns(self) -> dict[str, Metric]:
        return {m.column_name(a): m for m in self.metrics if not m.hidden for a in (m.attributes or self.config.attributes)}

    # -------------------------------------------------------- slots and history

    def reserve_slot(self) -> int:
        """The next free slot; creating its file is the lock."""
        taken = [int(n[5:-5]) for n in self.files.names("history") if n.startswith("slot=") and n.endswith(".json")]
        slot = max(taken, default=0) + 1
        while not self.files.create(f"history/slot={slot}.json", {"time_slot": slot, "reserved": True}):
            slot += 1
        return slot

    def save(self, entry: Ingest) -> None:
        self.files.replace(f"history/slot={entry.time_slot}.json", asdict(entry))

    def history(self, dates=None, bounds: Bounds | None = None, name: str | None = None) -> list[Ingest]:
        """Ingests that overlap a box (not only touch it) and days, with a name."""
        first, last = date_pair(dates) if dates else (None, None)
        out = []
        for n in self.files.names("history"):
            if not n.endswith(".json"):
                continue
            data = self.files.read(f"history/{n}")
            if data.get("reserved"):
                continue
            e = Ingest(**data)
            if name is not None and e.name != str(name):
                continue
            if bounds is not None and Bounds.parse(e.bounds).disjoint(bounds):
                continue
            if e.overlaps_dates(first, last):
                out.append(e)
        return sorted(out, key=lambda e: e.time_slot)

    def entry(self, name: str) -> Ingest:
        found = self.history(name=name)
        if not found:
            raise KeyError(f"no ingest named {name}")
        return found[-1]

    # -------------------------------------------------------- cells

    def manifest(self) -> dict:
        """The valid base, by slot the batches that it has taken in, and slots that were written anew since."""
        return self.files.read("_manifest.json") if self.files.exists("_manifest.json") else {"base": "", "slots": {}, "replaced": []}

    def _has_cells(self, folder: str) -> bool:
        return any(t.startswith("tile_x=") for t in self.files.names(folder))

    def clear_slot(self, slot: int) -> None:
        """Forget what a slot held, in the base too; its entry must be saved without batches before."""
        m = self.manifest()
        if str(slot) in m["slots"]:
            m["slots"].pop(str(slot))
            self.files.replace("_manifest.json", m | {"replaced": sorted({*m["replaced"], slot})})
        if self.files.exists(f"cells/time_slot={slot}"):
            self.files.delete(f"cells/time_slot={slot}")

    def slot_path(self, slot: int) -> str:
        return f"{self.path}/cells/time_slot={slot}"

    def write_cells(self, cells: DataFrame, entry: Ingest, batch: int = 0) -> DataFrame:
        """Write cells keyed by xi and yi, stamped with the ingest's slot, days and time, over what an earlier attempt left.

        They are seen when the batch is saved as done.
        """
        out = self._stamped(cells, entry)
        path = f"{self.slot_path(entry.time_slot)}/batch={batch}"
        self._write(out, path)
        return self.spark.read.schema(out.schema).parquet(path)

    @staticmethod
    def _write(cells: DataFrame, path: str) -> None:
        # cells of a tile that many tasks hold are brought together first, so that a tile is few files; rebalancing splits large
        # tiles.  Sorted cells let readers skip row groups by X and Y
        tiles = cells.hint("rebalance", F.col("tile_x"), F.col("tile_y")).sortWithinPartitions("tile_x", "tile_y", "X", "Y")
        tiles.write.mode("overwrite").option("compression", "zstd").partitionBy("tile_x", "tile_y").parquet(path)

    def _stamped(self, cells: DataFrame, entry: Ingest) -> DataFrame:
        c = self.config
        return cells.withColumnsRenamed({"xi": "X", "yi": "Y"}).select(
            "*",
            F.lit(entry.time_slot).alias("shatter_process_num"),
            F.lit(entry.start).cast("date").alias("start_date"),
            F.lit(entry.end).cast("date").alias("end_date"),
            F.lit(int(time.time() * 1000)).alias("write_ms"),
            F.floor(F.col("X") / c.xsize).cast("int").alias("tile_x"),
            F.floor(F.col("Y") / c.ysize).cast("int").alias("tile_y"),
        )

    def all_cells(self, extents: Extents | None = None, before_ms: int | None = None, since_ms: int | None = None, columns: list[str] | None = None) -> DataFrame | None:
        """Every version of the cells in a box, pruned by slot, tile and index; None if nothing was written."""
        manifest, parts = self.manifest(), []
        if manifest["base"] and self._has_cells(manifest["base"]):
            base = self.spark.read.parquet(f"{self.path}/{manifest['base']}")
            parts.append(base.where(~F.col("time_slot").isin(manifest["replaced"])) if manifest["replaced"] else base)
        found = [f"cells/time_slot={e.time_slot}/batch={k}" for e in self.history() for k in e.done if k not in manifest["slots"].get(str(e.time_slot), [])]
        if found := [f for f in found if self._has_cells(f)]:
            rows = self.spark.read.option("basePath", f"{self.path}/cells").option("mergeSchema", "false").parquet(*[f"{self.path}/{f}" for f in found])
            parts.append(rows.drop("batch"))
        if not parts:
            return None
        df = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        if extents is not None:
            c = self.config
            tile = lambda name, low, high, size: (F.col(name) >= low // size) & (F.col(name) <= (high - 1) // size)
            df = df.where(tile("tile_x", extents.x1, extents.x2, c.xsize) & tile("tile_y", extents.y1, extents.y2, c.ysize) & extents.holds(F.col("X"), F.col("Y")))
        if before_ms is not None:
            df = df.where(F.col("write_ms") <= before_ms)
        if since_ms is not None:
            df = df.where(F.col("write_ms") >= since_ms)
        if columns is not None:
            df = df.select("X", "Y", "time_slot", "start_date", "end_date", *columns)
        return df

    def read(self, extents: Extents | None = None, dates=None, as_of_ms: int | None = None, since_ms: int | None = None, columns: list[str] | None = None) -> DataFrame | None:
        """The cells to be seen: the latest version of each that overlaps the days, unless its slot was deleted."""
        df = self.all_cells(extents, as_of_ms, since_ms, columns)
        if df is None:
            return None
        if dates is not None:
            first, last = date_pair(dates)
            df = df.where(overlaps("start_date", "end_date", first, last))
        latest = latest_wins(df, ["X", "Y"], "time_slot")
        gone = [e.time_slot for e in self.history() if e.deleted]
        return latest.where(~F.col("time_slot").isin(gone)) if gone else latest

    def compact(self) -> None:
        """Write the latest version of every cell to a new base, publish it by the manifest, then remove what it replaced.

        Cells keep the slot they came from, so that a later delete finds them.  Time travel ends at a compaction, as it does
        in the reference.  A crash before the manifest is replaced changes nothing, one after it leaves folders for vacuum.
        """
        slots = {str(e.time_slot): e.done for e in self.history()}
        df = self.read()
        if df is None:
            return
        base = f"cells/base={uuid.uuid4().hex}"
        self._write(df, f"{self.path}/{base}")
        self.files.replace("_manifest.json", {"base": base, "slots": slots, "replaced": []})
        self.vacuum()

    def vacuum(self) -> list[str]:
        """Remove folders of cells that no reader looks at: old bases, batches in the base, what crashes left."""
        m = self.manifest()
        keep = {m["base"]} | {f"cells/time_slot={e.time_slot}/batch={k}" for e in self.history() for k in e.done if k not in m["slots"].get(str(e.time_slot), [])}
        running = {f"cells/time_slot={e.time_slot}" for e in self.history() if not e.finished and not e.deleted}
        gone = []
        for n in self.files.names("cells"):
            below = [f"cells/{n}/{k}" for k in self.files.names(f"cells/{n}")] if n.startswith("time_slot=") else [f"cells/{n}"]
            gone += [f for f in below if f not in keep and f"cells/{n}" not in running]
        for f in gone:
            self.files.delete(f)
        return gone

    def fragments(self, since_ms: int | None = None, before_ms: int | None = None, bounds: Bounds | None = None, inside: bool = False) -> list[dict]:
        """The written pieces of the database with their slot, batch, time, files and bytes.

        ``since_ms`` and ``before_ms`` ask for pieces whose time of writing overlaps that window, or lies ``inside`` it.
        """
        out, m = [], self.manifest()
        for e in self.history(bounds=bounds):
            first, last = e.written_from, e.written_to or e.written_from
            low, high = (first, last) if inside else (last, first)
            if (since_ms is not None and low < since_ms) or (before_ms is not None and high > before_ms):
                continue
            for k in e.done:
                folder = f"cells/time_slot={e.time_slot}/batch={k}"
                merged = k in m["slots"].get(str(e.time_slot), [])
                size = None if merged or not self.files.exists(folder) else self.files.fs(folder).getContentSummary(self.files.path(folder))
                out.append({"name": e.name, "time_slot": e.time_slot, "batch": k, "bounds": e.bounds, "written_from": first, "written_to": last, "in_base": merged, "files": size.getFileCount() if size else 0, "bytes": size.getLength() if size else 0})
        return out


def overlaps(start: str, end: str, first, last) -> Column:
    """Closed intervals of days overlap."""
    return (F.col(end) >= F.lit(first).cast("date")) & (F.col(start) <= F.lit(last).cast("date"))


def latest_wins(df: DataFrame, keys: list[str], version: str) -> DataFrame:
    """One row per key: that with the greatest version.  Partial maxima are taken before the shuffle."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(F.max_by(row, F.col(version)).alias("_r")).select("_r.*")

