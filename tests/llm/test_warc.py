import base64
import gzip
import hashlib
from urllib.parse import urlsplit

import pytest

from celltide.llm import warc

SCHEMA = "page_id long, url string, html string"


def expected(rows, min_bytes=0):
    largest = {}
    for i, _, h in rows:
        if i is not None:
            largest[h or ""] = max(largest.get(h or "", i), i)
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        kept = largest.get(h or "") if len(data) >= min_bytes else None
        ref = kept if kept is not None and kept != i else None
        out.append((-1 if i is None else i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if ref is not None else "response", ref))
    return sorted(out, key=repr)


def actual(df):
    return sorted(((-1 if r.page_id is None else r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=repr)


ROWS = [
    (1, "https://www.example.com/a?x=1#f", "<p>é</p>"),
    (2, "http://example.com/a", "<p>é</p>"),
    (3, "http://example.com/a", None),
    (4, "http://example.com/a", ""),
    (5, None, "x" * 300_000),
    (6, "http://[bad", "line\r\n\r\nline \x00 ퟿"),
    (6, "http://[bad", "line\r\n\r\nline \x00 ퟿"),
    (None, "http://b.org/é\r\nX: 1", "only one"),
    (9, "HTTP://User@Example.COM:8080", "z"),
    *[(100 + i, "http://hot.example.com/", "copy") for i in range(40)],
]


@pytest.mark.parametrize("min_bytes", [0, 5])
def test_round_trip(spark, min_bytes):
    """Blocks of three lines: look-ups go over block and shard borders."""
    df = spark.createDataFrame(ROWS, SCHEMA)
    archive = warc.write(df, min_bytes=min_bytes, block_lines=3, shard_lines=10)
    assert archive.records == len(ROWS) and len(archive.shards) > 1
    found = warc.look_up(archive, df)
    assert actual(found) == expected(ROWS, min_bytes)
    texts = {r.page_id: r.payload for r in found.collect() if r.record_type == "response"}
    assert texts[5] == b"x" * 300_000 and texts[6].decode() == ROWS[5][2]


def test_look_up_by_url_alone(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    archive = warc.write(df, block_lines=3, shard_lines=10)
    found = warc.look_up(archive, spark.createDataFrame([("http://hot.example.com/",), ("http://none.example.com/",)], "url string"), page_id=None)
    assert sorted(r.page_id for r in found.collect()) == list(range(100, 140))


def test_archive_files_are_gzip_members(spark):
    archive = warc.write(spark.createDataFrame(ROWS, SCHEMA))
    files, base = warc._fs(archive.root)
    texts = []
    from pyarrow import fs as pafs

    for info in files.get_file_info(pafs.FileSelector(f"{base}/warc")):
        with files.open_input_stream(info.path, compression=None) as f:
            texts.append(gzip.decompress(f.read()))
    assert sum(t.count(b"WARC/1.1\r\nWARC-Type: ") for t in texts) == len(ROWS)


def test_empty_and_extra_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert warc.look_up(warc.write(empty), empty).collect() == []
    df = spark.createDataFrame([(1, "u", "h", b"z", "s")], "page_id long, url string, html string, payload binary, sha1 string")
    assert actual(warc.look_up(warc.write(df), df)) == expected([(1, "u", "h")])


def test_keys():
    assert warc.url_key("https://www.Example.com:80/a/b?q=1#x") == "com,example)/a/b?q=1"
    assert warc.url_key(None) == "" and warc.url_key("no host#f") == "no host"
    assert urlsplit("http://a.b/").hostname == "a.b"


def test_tables(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = [tuple(r) for r in pages.select("page_id", "url", "html").collect()]
    assert actual(warc.look_up(warc.write(pages), pages)) == expected(rows)
