"""WARC archives with a two-level capture index.

Records are gzip members of WARC/1.1 files, written by the executors.  The index holds a line per record, sorted by
reversed-host URL key, in shards of compressed blocks.  Beside the shards lies a sparse directory: the first
key of each block, and where it lies.  A look-up picks the shard by its first key, finds the block by
binary search in the shard's directory, reads only that range, and reads each record by its own range.

Of records with equal payloads of at least ``min_bytes`` the one with the largest page id is the response, and the others are
revisit records that refer to it and carry no payload.

Defined cases: a null html is an empty payload; a null url has an empty key and no target; rows that share a group's
largest page id are all responses; a null page id is never the largest (a group of only such rows is all
responses); repeated rows are records of their own; an empty table gives an empty archive and result.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, urlsplit

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import join_by_key, pick, remove, scratch_root, written

#: Index lines in a compressed block, and in a shard (about).
BLOCK_LINES = 512
SHARD_LINES = 1 << 20
#: Shards at most, so that their first keys are few enough to be sent to every task.
MAX_SHARDS = 20_000
#: Capture date of records whose source gives none.
DATE = "1970-01-01T00:00:00Z"
LEVEL = 4
OPEN_FILES = 32
INDEX = "urlkey string, page_id long, file string, offset long, length long"
SHARD = "first_key string, first_id long, shard string, directory string, lines long, blocks long"
CAPTURE = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def url_key(url: str | None) -> str:
    """The key of a URL: host labels reversed, then path and query, without scheme, port, "www" and fragment."""
    if not url:
        return ""
    try:
        parts = urlsplit(url)
        host = parts.hostname or ""
    except ValueError:
        return url
    if not host:
        return url.split("#", 1)[0]
    labels = host.lower().split(".")
    if labels[0] == "www":
        labels = labels[1:]
    return ",".join(reversed(labels)) + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


# ---------------------------------------------------------------- records


def record(page_id: int | None, url: str | None, payload: bytes, sha1_hex: str, size: int, refers_to: int | None) -> bytes:
    """One record, compressed as a gzip member."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="!#$&'()*+,/:;=?@[]~%"))
    head.append(f"WARC-Payload-Digest: sha1:{base32(sha1_hex)}")
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def _page(urn: str | None) -> int | None:
    number = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def parse(raw: bytes) -> dict:
    """The capture in one gzip member; a response's payload is checked against its digest."""
    head, _, rest = zlib.decompress(raw, 31).partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    response = fields["WARC-Type"] == "response"
    if response and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise OSError(f"record {fields['WARC-Record-ID']} doesn't match its digest")
    return {
        "page_id": _page(fields["WARC-Record-ID"]),
        "url": fields.get("WARC-Target-URI"),
        "record_type": fields["WARC-Type"],
        "payload_bytes": size,
        "payload_digest": digest,
        "refers_to": _page(fields.get("WARC-Refers-To")),
        "payload": payload if response else None,
    }


# ---------------------------------------------------------------- writing


@dataclass(frozen=True)
class Archive:
    """Where an archive lies, and the first keys of its index shards."""

    root: str
    shards: tuple[tuple[str, int, str, str], ...]  # first key, first id, shard, directory
    records: int


def _fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + path)


def _create(path: str, what: str, suffix: str):
    """A new file of its own for each attempt of a task: what a lost attempt left is never indexed."""
    files, base = _fs(path)
    files.create_dir(f"{base}/{what}", recursive=True)
    name = f"{what}/{uuid.uuid4().hex}{suffix}"
    return name, files.open_output_stream(f"{base}/{name}", compression=None)


def with_duplicates(pages: DataFrame, min_bytes: int, root: str) -> DataFrame:
    """Add sha1, size and refers_to (the response's id for revisits, else null)."""
    rows = pages.withColumn("sha1", F.sha1("payload")).withColumn("size", F.octet_length("payload").cast("long"))
    marked = rows.withColumn("group", F.when(F.col("size") >= min_bytes, F.col("sha1")))
    groups = marked.where("group is not null").groupBy("group").agg(F.max("page_id").alias("kept"), F.count("*").alias("n"))
    groups = written(groups.where("n > 1"), "groups", root)
    total = pages.select(F.count("*")).first()[0]
    joined = join_by_key(marked, "group", groups, ["kept"], "n", total, "page_id")
    same = F.col("page_id").eqNullSafe(F.col("kept"))
    return joined.select(
        "page_id", "url", "sha1", "size",
        F.when(~same, F.col("kept")).alias("refers_to"),
        F.when(same | F.col("kept").isNull(), F.col("payload")).alias("payload"),
    )


def write(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0, block_lines: int = BLOCK_LINES, shard_lines: int = SHARD_LINES) -> Archive:
    """Write all rows to a new archive in the shared folder, and index it."""
    spark = pages.sparkSession
    root = scratch_root(spark)
    rows = pick(pages, page_id=page_id, url=url, payload=html).select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("payload").cast("binary"), F.lit(b"")).alias("payload"))

    def archive(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, name, at = None, None, 0
        for b in batches:
            lines = []
            for p, u, sha1, size, ref, payload in zip(*(b[c] for c in ("page_id", "url", "sha1", "size", "refers_to", "payload"))):
                if out is None:
                    name, out = _create(root, "warc", ".warc.gz")
                p = None if pd.isna(p) else int(p)
                raw = record(p, u, payload, sha1, size, None if pd.isna(ref) else int(ref))
                out.write(raw)
                lines.append((url_key(u), p, name, at, len(raw)))
                at += len(raw)
            if lines:
                yield pd.DataFrame(lines, columns=["urlkey", "page_id", "file", "offset", "length"]).astype({"page_id": "Int64"})
        if out is not None:
            out.close()

    index = written(with_duplicates(rows, min_bytes, root).mapInPandas(archive, INDEX), "lines", root)
    records = index.count()
    parts = min(MAX_SHARDS, max(spark.sparkContext.defaultParallelism, -(-records // shard_lines)))

    def shard(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blocks: list[tuple[str, int | None, int, int]] = []
        out, name, at, held, n = None, None, 0, [], 0

        def flush():
            nonlocal out, name, at, held
            if out is None:
                name, out = _create(root, "index", ".idx.gz")
            packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
            raw = packer.compress("".join(json.dumps(x, ensure_ascii=False) + "\n" for x in held).encode("utf-8", "surrogatepass")) + packer.flush()
            out.write(raw)
            blocks.append((held[0][0], held[0][1], at, len(raw)))
            at += len(raw)
            held = []

        for b in batches:
            for line in zip(b["urlkey"].tolist(), [None if pd.isna(x) else int(x) for x in b["page_id"]], b["file"].tolist(), b["offset"].tolist(), b["length"].tolist()):
                held.append(line)
                n += 1
                if len(held) == block_lines:
                    flush()
        if held:
            flush()
        if out is not None:
            out.close()
            directory, d = _create(root, "index", ".dir")
            d.write("".join(json.dumps(x, ensure_ascii=False) + "\n" for x in blocks).encode("utf-8", "surrogatepass"))
            d.close()
            yield pd.DataFrame([(blocks[0][0], blocks[0][1], name, directory, n, len(blocks))], columns=["first_key", "first_id", "shard", "directory", "lines", "blocks"]).astype({"first_id": "Int64"})

    made = index.repartitionByRange(parts, "urlkey", "page_id").sortWithinPartitions("urlkey", "page_id").mapInPandas(shard, SHARD)
    shards = written(made, "shards", root)
    found = [(r["first_key"], r["first_id"], r["shard"], r["directory"]) for r in shards.collect()]
    for name in ("groups", "lines", "shards"):
        remove(spark, f"{root}/{name}")
    return Archive(root, tuple(sorted(found, key=lambda x: _order(x[0], x[1]))), records)


# ---------------------------------------------------------------- reading


def _order(key: str, page_id: int | None) -> tuple[str, bool, int]:
    """Order of index lines: as Spark sorts them, null ids first."""
    return key, page_id is not None, page_id or 0


class Reader:
    """Look-ups in an archive by range reads; holds one shard's directory, a block and a few open files."""

    def __init__(self, archive: Archive):
        self.files, self.base = _fs(archive.root)
        self.shards = archive.shards
        self.firsts = [_order(k, i) for k, i, _, _ in archive.shards]
        self.open: OrderedDict[str, object] = OrderedDict()
        self.directory: tuple[int, list] = (-1, [])
        self.block: tuple[tuple[int, int] | None, list] = (None, [])

    def read(self, name: str, offset: int, length: int) -> bytes:
        if name not in self.open:
            if len(self.open) >= OPEN_FILES:
                self.open.popitem(last=False)[1].close()
            self.open[name] = self.files.open_input_file(f"{self.base}/{name}")
        self.open.move_to_end(name)
        return self.open[name].read_at(length, offset)

    def close(self) -> None:
        while self.open:
            self.open.popitem()[1].close()

    def blocks_of(self, shard: int) -> list:
        if self.directory[0] != shard:
            with self.files.open_input_stream(f"{self.base}/{self.shards[shard][3]}") as f:
                rows = [json.loads(x) for x in f.read().decode("utf-8", "surrogatepass").splitlines()]
            self.directory = (shard, [(_order(k, i), at, n) for k, i, at, n in rows])
        return self.directory[1]

    def lines_of(self, shard: int, block: int) -> list:
        if self.block[0] != (shard, block):
            _, at, n = self.blocks_of(shard)[block]
            text = zlib.decompress(self.read(self.shards[shard][2], at, n), 31).decode("utf-8", "surrogatepass")
            rows = [json.loads(x) for x in text.split("\n")[:-1]]
            self.block = ((shard, block), [(_order(r[0], r[1]), r) for r in rows])
        return self.block[1]

    def captures(self, low: tuple, high: tuple) -> Iterator[tuple[str, int, int]]:
        """(file, offset, length) of the index lines from low to high, both included."""
        # equal lines can begin at the end of the block, or shard, before the one that starts with them
        shard = max(0, _before(self.firsts, low))
        while shard < len(self.shards) and self.firsts[shard] <= high:
            blocks = self.blocks_of(shard)
            block = max(0, _before(_Firsts(blocks), low))
            while block < len(blocks) and blocks[block][0] <= high:
                lines = self.lines_of(shard, block)
                at = _before(_Firsts(lines), low) + 1
                while at < len(lines) and lines[at][0] <= high:
                    if lines[at][0] >= low:
                        yield tuple(lines[at][1][2:5])
                    at += 1
                block += 1
            shard += 1


class _Firsts:
    """The first fields of a list of tuples, as a sequence for binary search."""

    def __init__(self, rows: list):
        self.rows = rows

    def __len__(self) -> int:
        return len(self.rows)

    def __getitem__(self, i: int):
        return self.rows[i][0]


def _before(firsts, low) -> int:
    """The last position whose value is less than ``low``, or -1."""
    lo, hi = 0, len(firsts)
    while lo < hi:
        mid = (lo + hi) // 2
        if firsts[mid] < low:
            lo = mid + 1
        else:
            hi = mid
    return lo - 1


def look_up(archive: Archive, wanted: DataFrame, url: str = "url", page_id: str | None = "page_id") -> DataFrame:
    """The captures of the URLs (with ``page_id``: of these records only) in ``wanted``, each once.

    Wanted keys are sorted, so that a task reads the blocks of one stretch of the index one after another.
    """
    exact = page_id is not None
    rows = pick(wanted, url=url, page_id=page_id or url)

    @F.pandas_udf("string")
    def key(urls: pd.Series) -> pd.Series:
        return urls.map(url_key)

    rows = rows.select(key("url").alias("urlkey"), F.col("page_id").cast("long").alias("page_id") if exact else F.lit(None).cast("long").alias("page_id"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader, last = Reader(archive), None
        try:
            for b in batches:
                out = []
                for k, i in zip(b["urlkey"], b["page_id"]):
                    i = None if pd.isna(i) else int(i)
                    if (k, i) == last:
                        continue
                    last = (k, i)
                    low = _order(k, i)
                    for file, offset, length in reader.captures(low, low if exact else (k, True, 1 << 63)):
                        out.append(parse(reader.read(file, offset, length)))
                        if len(out) == 256:
                            yield _captures(out)
                            out = []
                if out:
                    yield _captures(out)
        finally:
            reader.close()

    parts = max(1, len(archive.shards))
    return rows.repartitionByRange(parts, "urlkey", "page_id").sortWithinPartitions("urlkey", "page_id").mapInPandas(read, CAPTURE)


def _captures(rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame(rows).astype({"page_id": "Int64", "refers_to": "Int64"})


def forget(spark: SparkSession, archive: Archive) -> None:
    remove(spark, archive.root)
