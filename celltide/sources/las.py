"""A reader of uncompressed LAS 1.0-1.4 clouds, point formats 0-10, as a Python data source.

Files are read in slices of records, each by one range read, so that a cloud of any size is dealt out to many tasks.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "X double, Y double, Z double, Intensity int, ReturnNumber short, NumberOfReturns short, Classification short, GpsTime double"
SLICE = 1 << 20


def _fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + path)


def header(data: bytes) -> dict:
    """What of a LAS header the reader needs."""
    if data[:4] != b"LASF":
        raise ValueError("not a LAS file")
    minor = data[25]
    offset, = struct.unpack_from("<I", data, 96)
    form, length, count = struct.unpack_from("<BHI", data, 104)
    if form & 0xC0:
        raise ValueError("compressed LAS (LAZ) needs a decompressor that is not installed")
    if minor >= 4 and len(data) >= 255:
        count = struct.unpack_from("<Q", data, 247)[0] or count
    sx, sy, sz, ox, oy, oz = struct.unpack_from("<6d", data, 131)
    maxx, minx, maxy, miny = struct.unpack_from("<4d", data, 179)
    return {"offset": offset, "format": form, "length": length, "count": count, "scale": (sx, sy, sz), "shift": (ox, oy, oz), "bounds": (minx, miny, maxx, maxy)}


class Slice(InputPartition):
    def __init__(self, path: str, first: int, n: int, head: dict):
        self.path, self.first, self.n, self.head = path, first, n, head


def records(data: bytes, head: dict) -> pa.RecordBatch:
    """Points of raw records."""
    n, length, form = len(data) // head["length"], head["length"], head["format"]
    raw = np.frombuffer(data, np.uint8, n * length).reshape(n, length)
    field = lambda at, kind: np.ascontiguousarray(raw[:, at : at + np.dtype(kind).itemsize]).view(kind).ravel()
    xyz = [field(4 * k, "<i4") * head["scale"][k] + head["shift"][k] for k in range(3)]
    flags = raw[:, 14]
    if form >= 6:
        number, total, kind, gps = flags & 15, flags >> 4, raw[:, 16], field(22, "<f8")
    else:
        number, total, kind = flags & 7, flags >> 3 & 7, raw[:, 15] & 31
        gps = field(20, "<f8") if form in (1, 3, 4, 5) else np.full(n, np.nan)
    columns = [*xyz, field(12, "<u2").astype("i4"), number.astype("i2"), total.astype("i2"), kind.astype("i2"), gps]
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)


def headers(path: str) -> Iterator[tuple[str, dict]]:
    """The files of a path with their headers."""
    files, name = _fs(path)
    found = files.get_file_info(pafs.FileSelector(name, recursive=True)) if files.get_file_info(name).type == pafs.FileType.Directory else [files.get_file_info(name)]
    for f in found:
        if f.type == pafs.FileType.File and f.path.lower().endswith(".las"):
            with files.open_input_file(f.path) as data:
                yield f.path if path.startswith("/") else path.split("://")[0] + "://" + f.path, header(data.read_at(375, 0))


def header_count(path: str) -> int:
    return sum(head["count"] for _, head in headers(path))


class LasReader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self) -> list[Slice]:
        out = []
        for path in self.paths:
            for uri, head in headers(path):
                out += [Slice(uri, k, min(SLICE, head["count"] - k), head) for k in range(0, head["count"], SLICE)]
        return out

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        files, name = _fs(partition.path)
        h = partition.head
        with files.open_input_file(name) as f:
            for k in range(0, partition.n, 65_536):
                n = min(65_536, partition.n - k)
                yield records(f.read_at(n * h["length"], h["offset"] + (partition.first + k) * h["length"]), h)


class LasDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "las"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LasReader:
        return LasReader(self.options["path"].split(","))


def read(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(LasDataSource)
    return spark.read.format("las").load(path)


def write(path: str, x, y, z, intensity, number, total, scale: float = 0.01, form: int = 0) -> None:
    """A small LAS 1.2 file, for tests and exchange."""
    lengths = {0: 20, 1: 28}
    n, length = len(x), lengths[form]
    raw = np.zeros((n, length), np.uint8)
    put = lambda at, a: raw.__setitem__((slice(None), slice(at, at + a.dtype.itemsize)), np.ascontiguousarray(a).view(np.uint8).reshape(n, -1))
    for k, v in enumerate((x, y, z)):
        put(4 * k, np.round(np.asarray(v, float) / scale).astype("<i4"))
    put(12, np.asarray(intensity).astype("<u2"))
    raw[:, 14] = np.asarray(number) | (np.asarray(total) << 3)
    head = bytearray(227)
    head[:4], head[24], head[25] = b"LASF", 1, 2
    struct.pack_into("<HI", head, 94, 227, 227)
    struct.pack_into("<BHI", head, 104, form, length, n)
    struct.pack_into("<6d", head, 131, scale, scale, scale, 0, 0, 0)
    box = [f(np.asarray(v, float)) for v in (x, y, z) for f in (np.max, np.min)] if n else [0.0] * 6
    struct.pack_into("<6d", head, 179, *box)
    files, name = _fs(path)
    with files.open_output_stream(name) as f:
        f.write(bytes(head) + raw.tobytes())
