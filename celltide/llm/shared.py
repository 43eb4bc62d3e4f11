"""What the corpus operators share: column picking, the shared scratch folder, joins on hot keys, models in Python workers."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows that go to a Python worker at once, where the session asks for no number of its own.  Spark's 10,000 rows of
#: long texts, with what is made of them, would take hundreds of megabytes a worker.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"

#: Rows of a few numbers that go through a Python function at once.
LARGE_ROWS = 1 << 16

#: Most keys that may count as hot, and so the most rows that a broadcast of hot keys can hold.
MAX_HOT_KEYS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Select columns by name under new names, whatever other columns are called.

    An exact match wins over one that differs in case, and the first over later ones, so that tables
    with clashing names (``text`` beside ``Text``, or two columns ``text``) are read without ambiguity.  All operators
    read their input here, so the session's batches are made small here too.
    """
    conf = df.sparkSession.conf
    if conf.get(_BATCH) == "10000":
        conf.set(_BATCH, str(BATCH_ROWS))
    names = df.columns
    flat = df.toDF(*[f"c{i}" for i in range(len(names))])
    out = []
    for new, old in columns.items():
        at = next((i for i, n in enumerate(names) if n == old), None)
        if at is None:
            at = next((i for i, n in enumerate(names) if n.lower() == old.lower()), None)
        if at is None:
            raise ValueError(f"no column {old!r} among {names}")
        out.append(F.col(f"c{at}").alias(new))
    return flat.select(*out)


def scratch_root(spark: SparkSession) -> str:
    """A new folder that driver and executors share.

    It lies in the folder named by ``spark.checkpoint.dir``.  Where that is unset, a local temporary folder takes its place
    if Spark runs on one machine, as in tests; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.celltide.scratch.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="celltide-")
        spark.conf.set("spark.celltide.scratch.dir", base)
    root = f"{base.rstrip('/')}/celltide/{uuid.uuid4().hex}"
    atexit.register(_forget, spark, root)
    return root


def _forget(spark: SparkSession, root: str) -> None:
    try:
        remove(spark, root)
    except Exception:  # the session may have ended before; its shared folder is then cleared by its owner
        return


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder, on whatever file system it is."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame, name: str = "t", root: str | None = None) -> DataFrame:
    """Write a table to the shared folder and read it again: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = f"{root or scratch_root(spark)}/{name}"
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def map_large(df: DataFrame, function, schema: str, rows: int = LARGE_ROWS) -> DataFrame:
    """``mapInPandas`` over narrow rows, in batches of ``rows`` whatever the session's batches are: less is spent on each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def frames() -> Iterator[pd.DataFrame]:
            held, n = [], 0
            for b in batches:
                held.append(b)
                n += b.num_rows
                if n >= rows:
                    yield pa.Table.from_batches(held).to_pandas()
                    held, n = [], 0
            if n:
                yield pa.Table.from_batches(held).to_pandas()

        for out in function(frames()):
            yield from pa.Table.from_pandas(out, schema=kind, preserve_index=False).to_batches()
        give_back()

    kind = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)
    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Return freed memory to the system: a worker waits for its next task with what its largest batch took otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


#: What is compiled in this process, and the task that asked for it last.
_READY: dict[Hashable, tuple[object, int | None]] = {}


def ready(key: Hashable, make: Callable[[], object]):
    """A compiled model, made once per Python worker.

    Spark hands a worker from operator to operator, in which their models would add up: what no one asked for in this task goes
    before another one is made.
    """
    context = TaskContext.get()
    task = context.taskAttemptId() if context else None
    if key not in _READY:
        for other in [k for k, (_, at) in _READY.items() if at is None or at != task]:
            del _READY[other]
        give_back()
        _READY[key] = make(), task
        give_back()
    elif _READY[key][1] != task:
        _READY[key] = _READY[key][0], task
    return _READY[key][0]


def join_by_key(df: DataFrame, key: str, groups: DataFrame, values: list[str], size: str, total: int, spread: str) -> DataFrame:
    """Left join ``groups`` (one row per key, ``size`` rows of ``df`` each) to ``df``, whatever the skew.

    A key with over ``total / MAX_HOT_KEYS`` rows is hot; there are fewer than MAX_HOT_KEYS of them, which
    bounds the broadcast.  Their rows get their values from it and are dealt out by a salted key, so that no task
    receives a hot group (``spread`` names a column that tells its rows apart).  All other groups are joined by an
    ordinary shuffled join.
    """
    hot_at = max(1, total // MAX_HOT_KEYS)
    hot = groups.where(F.col(size) > hot_at).select(F.col(key).alias("_hk"), *[F.col(v).alias(f"_h_{v}") for v in values], F.lit(True).alias("_is_hot"))
    cold = groups.where(F.col(size) <= hot_at).select(F.col(key).alias("_ck"), *[F.col(v).alias(f"_c_{v}") for v in values])
    marked = df.join(F.broadcast(hot), F.col(key) == F.col("_hk"), "left")
    salted = marked.withColumn("_salt", F.when(F.col("_is_hot"), F.xxhash64(spread).bitwiseAND(F.lit(2**62 - 1))).otherwise(F.lit(-1)))
    cold = cold.withColumn("_none", F.lit(-1).cast("long"))
    joined = salted.join(cold.hint("merge"), (F.col(key) == F.col("_ck")) & (F.col("_salt") == F.col("_none")), "left")
    return joined.select(*[F.col(c) for c in df.columns], *[F.coalesce(F.col(f"_h_{v}"), F.col(f"_c_{v}")).alias(v) for v in values])


def is_learning(doc_id: Column, parts: int, held: int) -> Column:
    """Rows to learn from: the remainder of crc32 of the id's text is not ``held``."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts)) != held
