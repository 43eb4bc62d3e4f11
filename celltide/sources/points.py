"""Tabular point sources, and pipeline specs: a reader with steps on what it reads."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import Bounds
from . import las

READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "parquet": lambda s, p: s.read.parquet(p),
    "csv": lambda s, p: s.read.option("header", True).option("inferSchema", True).csv(p),
    "json": lambda s, p: s.read.json(p),
    "las": las.read,
}


def kind_of(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    if name.endswith((".laz", "ept.json")):
        raise ValueError(f"{path}: compressed clouds need a decompressor that is not installed; convert them to LAS or Parquet")
    for kind in ("parquet", "csv", "json", "las"):
        if name.endswith("." + kind):
            return kind
    return "parquet"


def is_pipeline(path: str) -> bool:
    """A JSON file is a pipeline spec, unless it is the index of a tiled cloud."""
    return path.endswith(".json") and not path.endswith("ept.json")


def _range_step(df: DataFrame, step: dict) -> DataFrame:
    """Conditions as ``Name[low:high]``, either end left out at will, comma-joined."""
    for limit in step["limits"].split(","):
        name, _, rest = limit.strip().partition("[")
        low, _, high = rest.rstrip("]").partition(":")
        if low:
            df = df.where(F.col(name) >= float(low))
        if high:
            df = df.where(F.col(name) <= float(high))
    return df


STEPS: dict[str, Callable[[DataFrame, dict], DataFrame]] = {
    "filters.range": _range_step,
    "filters.expression": lambda df, s: df.where(s["expression"]),
    "filters.crop": lambda df, s: df.where(Bounds.parse(s["bounds"]).holds_closed(F.col("X"), F.col("Y"))),
    "filters.assign": lambda df, s: df.withColumns({k.strip(): F.expr(v) for k, _, v in (x.partition("=") for x in ([s["value"]] if isinstance(s["value"], str) else s["value"]))}),
    "filters.sort": lambda df, s: df,
    "filters.stats": lambda df, s: df,
}


def validated(spec: dict | list) -> tuple[dict, list[dict]]:
    """The one reader and the steps of a pipeline; writers are dropped."""
    stages = spec["pipeline"] if isinstance(spec, dict) else spec
    stages = [{"type": f"readers.{kind_of(s)}", "filename": s} if isinstance(s, str) else dict(s) for s in stages]
    for s in stages:
        if "type" not in s:
            s["type"] = f"readers.{kind_of(s['filename'])}"
    readers = [s for s in stages if s["type"].startswith("readers.")]
    if len(readers) != 1:
        raise ValueError(f"a pipeline has one reader, not {len(readers)}")
    kind = readers[0]["type"].split(".", 1)[1]
    if kind not in READERS:
        raise ValueError(f"no reader for {kind}; there are {', '.join(READERS)}")
    steps = [s for s in stages if not s["type"].startswith(("readers.", "writers."))]
    for s in steps:
        if s["type"] not in STEPS:
            raise ValueError(f"no step {s['type']}; there are {', '.join(STEPS)}")
    return readers[0], steps


def run_pipeline(spark: SparkSession, spec: dict | list) -> DataFrame:
    reader, steps = validated(spec)
    df = READERS[reader["type"].split(".", 1)[1]](spark, reader["filename"])
    for s in steps:
        df = STEPS[s["type"]](df, s)
    return df


def load(spark: SparkSession, path: str, columns: dict[str, str] | None = None, bounds: Bounds | None = None, collar: float = 0.0) -> DataFrame:
    """Points of a file, folder or pipeline spec, lazily; ``columns`` renames, as name in the points: expression in the source."""
    if is_pipeline(path):
        text = "".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
        try:
            spec = json.loads(text)
        except ValueError:
            spec = None
        df = run_pipeline(spark, spec) if isinstance(spec, (dict, list)) and (isinstance(spec, list) or "pipeline" in spec) else READERS["json"](spark, path)
    else:
        df = READERS[kind_of(path)](spark, path)
    if columns:
        df = df.select(*[F.expr(e).alias(n) for n, e in columns.items()])
    if bounds is not None:
        df = df.where(bounds.grown(collar).holds_closed(F.col("X"), F.col("Y")))
    return df


def estimated_count(spark: SparkSession, path: str) -> int:
    """How many points a file or folder holds, without reading points where its headers say it.

    LAS headers and Parquet footers hold the number; other sources, and pipelines with steps, are counted.
    """
    if not is_pipeline(path) and kind_of(path) == "las":
        return las.header_count(path)
    return load(spark, path).count()
