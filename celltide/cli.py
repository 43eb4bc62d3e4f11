"""Command line: info, scan, initialize, shatter, extract, delete, restart, resume."""

from __future__ import annotations

import argparse
import importlib.util
import json
import logging
import sys

from pyspark.sql import SparkSession

from .functions.geometry import Bounds
from .operators import verbs
from .operators.metrics import Metric
from .sources.points import load
from .store import DEFAULT_ATTRIBUTES, CellStore, StoreConfig


def load_metrics(path: str) -> list[Metric]:
    """Metrics of a Python file that has ``metrics()`` returning a list of them.  It is run: trust the file."""
    spec = importlib.util.spec_from_file_location("user_metrics", path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    if not hasattr(module, "metrics"):
        raise ValueError(f"{path} has no metrics()")
    made = module.metrics()
    if not isinstance(made, list) or not all(isinstance(m, Metric) for m in made):
        raise ValueError(f"{path}: metrics() returns a list of Metric")
    return made


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="celltide", description=__doc__)
    p.add_argument("--database", "-d", required=True)
    p.add_argument("--master", help="Spark master; the session's own if left out")
    p.add_argument("--debug", action="store_true")
    p.add_argument("--log-dir")
    p.add_argument("--user-metrics", action="append", default=[], help="Python files with metrics()")
    sub = p.add_subparsers(dest="verb", required=True)

    i = sub.add_parser("info")
    i.add_argument("--bounds", type=Bounds.parse)
    i.add_argument("--dates", nargs="+")
    i.add_argument("--name")
    i.add_argument("--concise", action="store_true")
    i.add_argument("--history", action="store_true")
    i.add_argument("--metadata", action="store_true")
    i.add_argument("--attributes", action="store_true")

    s = sub.add_parser("scan")
    s.add_argument("pointcloud")
    s.add_argument("--resolution", type=float, default=100)
    s.add_argument("--point_count", type=int, default=600_000)
    s.add_argument("--depth", type=int, default=6)
    s.add_argument("--bounds", type=Bounds.parse)

    n = sub.add_parser("initialize")
    n.add_argument("--bounds", type=Bounds.parse, required=True)
    n.add_argument("--crs", required=True)
    n.add_argument("--attributes", "-a", type=lambda v: v.split(","), default=[])
    n.add_argument("--metrics", "-m", type=lambda v: v.split(","), default=["grid_metrics"])
    n.add_argument("--resolution", type=float, default=30.0)
    n.add_argument("--xsize", type=int, default=1000)
    n.add_argument("--ysize", type=int, default=1000)
    n.add_argument("--alignment", default="AlignToCenter")

    h = sub.add_parser("shatter")
    h.add_argument("pointcloud")
    h.add_argument("--bounds", type=Bounds.parse)
    h.add_argument("--tilesize", type=int)
    h.add_argument("--date", "--dates", nargs="+", required=True, dest="dates")
    h.add_argument("--name")

    x = sub.add_parser("extract")
    x.add_argument("--outdir", "-o", required=True)
    x.add_argument("--attributes", "-a", type=lambda v: v.split(","))
    x.add_argument("--metrics", "-m", type=lambda v: v.split(","))
    x.add_argument("--bounds", type=Bounds.parse)
    x.add_argument("--dates", nargs="+")
    x.add_argument("--timestamp", type=int, help="as of this time, in milliseconds")
    x.add_argument("--form", choices=["tif", "asc", "csv", "parquet"], default="tif")

    d = sub.add_parser("delete")
    d.add_argument("--id", required=True)
    for verb in ("restart", "resume"):
        r = sub.add_parser(verb)
        r.add_argument("--id", required=True)
        r.add_argument("pointcloud")
    return p


def run(argv: list[str], spark: SparkSession | None = None):
    """Run one command; what it prints is returned too."""
    a = parser().parse_args(argv)
    logging.basicConfig(level=logging.DEBUG if a.debug else logging.INFO, filename=f"{a.log_dir}/celltide.log" if a.log_dir else None)
    if spark is None:
        builder = SparkSession.builder.appName("celltide")
        spark = (builder.master(a.master) if a.master else builder).getOrCreate()
    extra = {m.name: m for f in a.user_metrics for m in load_metrics(f)}
    if a.verb == "initialize":
        attributes = {n: DEFAULT_ATTRIBUTES.get(n, "float") for n in a.attributes} or dict(DEFAULT_ATTRIBUTES)
        config = StoreConfig(a.bounds, a.resolution, a.crs, a.alignment, attributes, a.metrics, a.xsize, a.ysize)
        return verbs.initialize(spark, a.database, config, extra).config.to_json()
    store = CellStore.open(spark, a.database, extra)
    if a.verb == "info":
        out = verbs.info(store, a.dates, a.bounds, a.name, a.concise)
        wanted = [k for k in ("history", "metadata", "attributes") if getattr(a, k)]
        return {k: out[k] for k in wanted} if wanted else out
    if a.verb == "scan":
        return verbs.scan(store, load(spark, a.pointcloud), a.bounds, a.point_count, a.resolution, a.depth)
    if a.verb == "shatter":
        name = {"name": a.name} if a.name else {}
        return vars(verbs.shatter(store, load(spark, a.pointcloud), verbs.ShatterConfig(tuple(a.dates), a.bounds, tile_size=a.tilesize, **name)))
    if a.verb == "extract":
        known = store.metric_columns()
        columns = [c for c, m in known.items() if (not a.metrics or m.name in a.metrics) and (not a.attributes or any(c == m.column_name(x) for x in a.attributes))]
        verbs.extract(store, a.outdir, columns, a.bounds, a.dates, a.timestamp, a.form)
        return {"columns": columns}
    if a.verb == "delete":
        return vars(verbs.delete(store, a.id))
    return vars((verbs.restart if a.verb == "restart" else verbs.resume)(store, load(spark, a.pointcloud), a.id))


def main() -> None:
    print(json.dumps(run(sys.argv[1:]), indent=1, default=str))


if __name__ == "__main__":
    main()
