import random

import numpy as np
import pytest
import xxhash

from celltide.llm import simhash

SCHEMA = "doc_id long, text string"


def plain_fingerprint(text):
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows, limit=4):
    fps = [plain_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= limit:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d is None, d or 0, f"{fps[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows))


def run(spark, rows, **kw):
    out = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), **kw).collect()
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, f"{r['fp'] & (1 << 64) - 1:016x}", r["component_id"]) for r in out)


def corpus(n, seed=3):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    base = [[rng.choice(vocab) for _ in range(rng.choice([2, 30, 200, 600]))] for _ in range(n // 4)]
    rows = []
    for i in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2])):
            words[rng.randrange(len(words))] = rng.choice(vocab).upper()
        rows.append((i * 3, " ".join(words)))
    return rows + [(None, rows[0][1]), (7, None), (8, ""), (10, " \n\t"), (11, "é É ß"), (0, rows[0][1])]


def test_fingerprint_of_long_and_chunked_texts(monkeypatch):
    text = " ".join(f"x{i % 97} Y{i % 31}" for i in range(900))
    monkeypatch.setattr(simhash, "CHUNK", 100)
    assert simhash.fingerprint(text) & (1 << 64) - 1 == plain_fingerprint(text)


@pytest.mark.parametrize("bucket", [256, 2])
def test_components_equal_brute_force(spark, bucket):
    """With buckets of two members at most, nearly all links come from the way for dense buckets."""
    rows = corpus(160)
    assert run(spark, rows, bucket=bucket) == brute(rows)


def test_documents_of_the_smallest_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert run(spark, rows) == brute(rows)


def test_empty_and_clashing(spark):
    assert run(spark, []) == []
    df = spark.createDataFrame([(1, "a b", "x", 5)], "doc_id long, text string, TEXT string, fp int")
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        assert simhash.near_duplicates(df).first()["component_id"] == 1
    finally:
        spark.conf.unset("spark.sql.caseSensitive")


def test_thresholds_cover_the_limit():
    rng = np.random.default_rng(1)
    bits = rng.random((500, 64)) < 0.5
    together = bits.T.astype(float) @ bits.astype(float)
    for n in (10, 10**4, 10**7, 10**10):
        partitions = simhash.plan(n, together / 500 * n)
        assert sum(t + 1 for _, t in partitions) == simhash.LIMIT + 1
        assert len({b for g, _ in partitions for b in g}) == sum(len(g) for g, _ in partitions)
    near = np.array([3, 3 ^ 5 ^ (1 << 63), 3 ^ 1 ^ 2], np.uint64).view(np.int64)
    partitions = simhash.plan(1000, together)
    key, fp, c = simhash._probes(near, partitions)
    assert len(key) == len(fp) == len(c)
