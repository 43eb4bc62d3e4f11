"""Raster files of dense cells: GeoTIFF (uncompressed, one band), ESRI ASCII grids, CSV and Parquet.

A raster is written in row strips.  A task encodes the strips of its rows, and the strips are put one after the other by the
sink, so that no task or driver holds a whole raster.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import Bounds, Extents

#: dtype -> (numpy type, TIFF sample format: 1 unsigned, 2 signed, 3 IEEE float)
SAMPLES = {"uint8": ("<u1", 1), "uint16": ("<u2", 1), "uint32": ("<u4", 1), "int32": ("<i4", 2), "int16": ("<i2", 2), "float32": ("<f4", 3), "float64": ("<f8", 3)}


def _fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + path)


def tiff_header(width: int, height: int, dtype: str, res: float, bounds: Bounds, nodata, crs: str) -> bytes:
    """Header, directory and tag values of a north-up one-band TIFF whose strips (one row each) follow at its end."""
    kind, sample = SAMPLES[dtype]
    size = np.dtype(kind).itemsize
    text = lambda s: s.encode() + b"\0"
    citation = text((crs or "unknown") + "|")
    keys = [1, 1, 0, 3, 1024, 0, 1, 1, 1025, 0, 1, 1, 1026, 34737, len(citation) - 1, 0]
    tags: list[tuple[int, int, int, bytes]] = [
        (256, 4, 1, struct.pack("<I", width)),
        (257, 4, 1, struct.pack("<I", height)),
        (258, 3, 1, struct.pack("<H", 8 * size)),
        (259, 3, 1, struct.pack("<H", 1)),
        (262, 3, 1, struct.pack("<H", 1)),
        (273, 4, height, b""),
        (277, 3, 1, struct.pack("<H", 1)),
        (278, 4, 1, struct.pack("<I", 1)),
        (279, 4, height, struct.pack(f"<{height}I", *[width * size] * height)),
        (339, 3, 1, struct.pack("<H", sample)),
        (33550, 12, 3, struct.pack("<3d", res, res, 0.0)),
        (33922, 12, 6, struct.pack("<6d", 0, 0, 0, bounds.minx, bounds.maxy, 0)),
        (34735, 3, len(keys), struct.pack(f"<{len(keys)}H", *keys)),
        (34737, 2, len(citation), citation),
        (42113, 2, len(str(nodata)) + 1, text(str(nodata))),
    ]
    at = 8 + 2 + 12 * len(tags) + 4
    extra = sum(n + n % 2 for n in [4 * height if t == 273 else len(v) for t, _, _, v in tags] if n > 4)
    first = at + extra
    strips = struct.pack(f"<{height}I", *[first + r * width * size for r in range(height)])
    out, tail = [struct.pack("<2sHI", b"II", 42, 8), struct.pack("<H", len(tags))], b""
    for tag, kind_of, n, value in tags:
        value = strips if tag == 273 else value
        if len(value) <= 4:
            out.append(struct.pack("<HHI", tag, kind_of, n) + value.ljust(4, b"\0"))
        else:
            out.append(struct.pack("<HHII", tag, kind_of, n, at + len(tail)))
            tail += value + b"\0" * (len(value) % 2)
    return b"".join([*out, struct.pack("<I", 0), tail])


def _ascii_header(width: int, height: int, res: float, bounds: Bounds, nodata) -> bytes:
    return f"ncols {width}\nnrows {height}\nxllcorner {bounds.minx}\nyllcorner {bounds.miny}\ncellsize {res}\nNODATA_value {nodata}\n".encode()


def rows_of(full: DataFrame, column: str, kind: str, form: str) -> DataFrame:
    """(Y, strip): each raster row in bytes, by ascending X."""
    row = F.transform(F.array_sort(F.collect_list(F.struct("X", F.col(f"`{column}`").cast("double").alias("v")))), lambda c: c["v"])
    lines = full.groupBy("Y").agg(row.alias("v"))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if form == "tif":
                strips = [np.asarray(v, np.float64).astype(kind).tobytes() for v in b["v"]]
            else:
                strips = [(" ".join(f"{x:.10g}" for x in v) + "\n").encode() for v in b["v"]]
            yield pd.DataFrame({"Y": b["Y"], "strip": strips})

    return lines.mapInPandas(encode, "Y int, strip binary")


def write(full: DataFrame, extents: Extents, column: str, dtype: str, nodata, path: str, crs: str = "", form: str = "tif") -> str:
    """Write one raster of a box's dense cells to ``path``/``column``.tif or .asc."""
    width, height = extents.x2 - extents.x1, extents.y2 - extents.y1
    kind = SAMPLES[dtype][0]
    head = tiff_header(width, height, dtype, extents.grid.res, extents.bounds, nodata, crs) if form == "tif" else _ascii_header(width, height, extents.grid.res, extents.bounds, nodata)
    files, base = _fs(path)
    files.create_dir(base, recursive=True)
    name = f"{base}/{column}.{'tif' if form == 'tif' else 'asc'}"
    ordered = rows_of(full, column, kind, form).orderBy("Y")
    with files.open_output_stream(name) as out:
        out.write(head)
        # one partition of encoded rows is at the driver at a time
        for r in ordered.toLocalIterator():
            out.write(bytes(r["strip"]))
    return name


def write_all(full: DataFrame, extents: Extents, dtypes: dict[str, str], nodata: dict, path: str, crs: str = "", form: str = "tif") -> None:
    """All columns as rasters, or as one table (form "parquet" or "csv")."""
    if form in ("parquet", "csv"):
        writer = full.write.mode("overwrite")
        writer.parquet(path) if form == "parquet" else writer.option("header", True).csv(path)
        return
    full = full.persist()
    try:
        for column, dtype in dtypes.items():
            write(full, extents, column, dtype, nodata[column], path, crs, form)
    finally:
        full.unpersist()


def read_tiff(path: str) -> tuple[np.ndarray, dict]:
    """A raster that :func:`write` made, and its tags; for checks."""
    files, name = _fs(path)
    with files.open_input_stream(name) as f:
        data = f.read()
    at = struct.unpack_from("<I", data, 4)[0]
    sizes = {2: 1, 3: 2, 4: 4, 12: 8}
    tags = {}
    for k in range(struct.unpack_from("<H", data, at)[0]):
        tag, kind, n = struct.unpack_from("<HHI", data, at + 2 + 12 * k)
        place = at + 2 + 12 * k + 8
        if n * sizes[kind] > 4:
            place = struct.unpack_from("<I", data, place)[0]
        tags[tag] = data[place : place + n].decode() if kind == 2 else struct.unpack_from(f"<{n}{ {3: 'H', 4: 'I', 12: 'd'}[kind] }", data, place)
    width, height = tags[256][0], tags[257][0]
    size = tags[258][0] // 8
    kind = next(k for k, s in SAMPLES.values() if s == tags[339][0] and np.dtype(k).itemsize == size)
    return np.stack([np.frombuffer(data, kind, width, o) for o in tags[273]]), tags
