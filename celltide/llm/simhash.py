"""SimHash near-duplicate groups by the generalised pigeonhole principle.

A fingerprint has 64 bits.  Correlated bits are grouped into partitions, and each partition i gets a threshold t_i
such that the sum of (t_i + 1) is the distance limit + 1: two fingerprints within the limit then differ in
t_i bits or fewer in some partition i.  A dynamic program over estimated candidate counts chooses the thresholds,
and the number of partitions with them.

Probing: two values of one partition that differ in d bits are met at their bitwise AND, if one clears some of its set bits
and the other the rest.  So each fingerprint sends every value with up to t_i set bits cleared, and two
that meet with t_i cleared bits or fewer between them are candidates, each pair once per partition.  Candidates
are verified on all 64 bits; of the links in a bucket a spanning forest is kept.

Buckets over BUCKET members are never paired: their members meet at every 64-bit value within half the limit of them (two
fingerprints lie within the limit exactly if such values coincide), where each is linked to the least member.  That
is linear in the members, and loses no link.

Defined cases: null, empty and blank texts have fingerprint zero and link like any other; a text of fewer than four words
is one shingle; repeated rows share a fingerprint; rows whose doc_id is null get a component too, the
smallest doc_id in it (null if it has none); an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import join_by_key, map_large, pick, remove, scratch_root, written

BITS = 64
SHINGLE = 4
LIMIT = 4
SEED = 42
#: Members of a bucket that are paired with each other; larger buckets take the exact linear way.
BUCKET = 256
#: Shingles whose bits are counted at a time.
CHUNK = 1 << 15


def fingerprint(text: str | None, k: int = SHINGLE) -> int:
    """The fingerprint as a signed 64-bit integer."""
    words = text.encode("utf-8", "replace").lower().split() if text else []
    n = max(1, len(words) - k + 1) if words else 0
    digest = xxhash.xxh64_intdigest
    return majority(np.fromiter((digest(b" ".join(words[i : i + k]), SEED) for i in range(n)), np.dtype("<u8"), n))


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes, as a signed 64-bit integer."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at : at + CHUNK]
        counts += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) for every row."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")

    return pick(docs, doc_id=doc_id, text=text).select("doc_id", of("text").alias("fp"))


# ---------------------------------------------------------------- plan


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints and the 64 x 64 counts of bits set together, over all of them."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros((BITS, BITS)), 0
        for b in batches:
            for at in range(0, len(b), CHUNK):
                bits = _bits(b["fp"].to_numpy()[at : at + CHUNK]).astype(np.float32)
                total += bits.T @ bits
                n += len(bits)
        if n:
            i, j = np.triu_indices(BITS)
            yield pd.DataFrame({"i": np.append(i, -1), "j": np.append(j, -1), "c": np.append(total[i, j], n)})

    together = np.zeros((BITS, BITS))
    n = 0
    for r in fps.select("fp").mapInPandas(count, "i int, j int, c double").groupBy("i", "j").agg(F.sum("c").alias("c")).collect():
        if r["i"] < 0:
            n = int(r["c"])
        else:
            together[r["i"], r["j"]] = together[r["j"], r["i"]] = r["c"]
    return n, together


def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(fps.astype("<i8")).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def group_bits(n: int, together: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in partitions of near-equal width, each grown by the bit that correlates most with those in it."""
    p = np.diag(together) / max(1, n)
    cov = together / max(1, n) - np.outer(p, p)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    corr = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    left, out = set(range(BITS)), []
    for k in range(parts):
        width = (BITS - sum(map(len, out))) // (parts - k)
        first = max(left, key=lambda b: (max((corr[b, c] for c in left if c != b), default=0), -b))
        mine = [first]
        left.discard(first)
        while len(mine) < width:
            best = max(left, key=lambda b: (corr[b, mine].mean(), -b))
            mine.append(best)
            left.discard(best)
        out.append(sorted(mine))
    return out


def allocate(n: int, differs: np.ndarray, groups: list[list[int]], limit: int) -> tuple[float, list[int]]:
    """Thresholds by dynamic programming; -1 leaves a partition out.

    The cost of a threshold is the rows sent plus the candidates expected, from the chance that each bit
    of the partition differs between two fingerprints.
    """
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for g in groups:
        dist = np.array([1.0])
        for b in g:
            dist = np.convolve(dist, [1 - differs[b], differs[b]])
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t in range(-1, limit - used + 1):
                sent = sum(math.comb(len(g) // 2, k) for k in range(t + 1))
                more = n * sent + n * (n - 1) / 2 * float(dist[: t + 1].sum())
                if used + t + 1 <= limit + 1 and (used + t + 1 not in step or cost + more < step[used + t + 1][0]):
                    step[used + t + 1] = (cost + more, [*chosen, t])
        best = step
    return best[limit + 1]


def plan(n: int, together: np.ndarray, limit: int = LIMIT) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition, at the least estimated cost."""
    p = np.diag(together) / max(1, n)
    differs = np.clip(2 * p * (1 - p), 1e-6, 0.5)
    options = []
    for parts in range(2, limit + 2):
        groups = group_bits(n, together, parts)
        cost, thresholds = allocate(n, differs, groups, limit)
        options.append((cost, parts, [(g, t) for g, t in zip(groups, thresholds) if t >= 0]))
    return min(options)[2]


# ---------------------------------------------------------------- probe and verify


def _probes(fps: np.ndarray, partitions) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, fingerprint, cleared bits) of every value sent."""
    keys, owners, cleared = [], [], []
    u = fps.view(np.uint64)
    for i, (bits, t) in enumerate(partitions):
        mask = np.uint64(sum(1 << b for b in bits))
        own = u & mask
        for k in range(t + 1):
            for some in combinations(bits, k):
                off = np.uint64(sum(1 << b for b in some))
                at = np.flatnonzero((own & off) == off) if k else np.arange(len(u))
                keys.append(own[at] & ~off)
                owners.append(fps[at])
                cleared.append(np.full(len(at), i * 16 + k, np.int16))
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int16)
    return np.concatenate(keys).view(np.int64), np.concatenate(owners), np.concatenate(cleared)


def _runs(part: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Borders of runs of equal (part, key) in sorted arrays."""
    if not len(key):
        return np.zeros(1, np.int64)
    return np.concatenate(([0], np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1])) + 1, [len(key)]))


def _forest(fp: np.ndarray, cleared: np.ndarray, t: int, limit: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the verified pairs of one bucket."""
    i, j = np.triu_indices(len(fp), 1)
    ok = (cleared[i] + cleared[j] <= t) & (fp[i] != fp[j])
    i, j = i[ok], j[ok]
    near = np.bitwise_count(fp.view(np.uint64)[i] ^ fp.view(np.uint64)[j]) <= limit
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            root[x] = root.get(root[x], root[x])
            x = root[x]
        return x

    out = []
    for a, b in zip(fp[i[near]].tolist(), fp[j[near]].tolist()):
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((min(a, b), max(a, b)))
    return out


DENSE = -1  # in the field of cleared bits: this bucket is over the limit somewhere


def links(fps: DataFrame, partitions, limit: int = LIMIT, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links of a graph with the components of "within the limit", among distinct fingerprints ``fp``.

    Rows with b null are members of buckets over ``bucket``; :func:`dense_links` links them.
    """
    thresholds = [t for _, t in partitions]

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:  # of LARGE_ROWS fingerprints: a key that 0.4 % of them share is found to be hot before the shuffle
            key, fp, c = _probes(np.ascontiguousarray(b["fp"].to_numpy(np.int64)), partitions)
            part = (c >> 4).astype(np.int16)
            order = np.lexsort((key, part))
            key, fp, c, part = key[order], fp[order], c[order], part[order]
            at = _runs(part, key)
            size = np.diff(at)
            large = np.repeat(size > bucket, size)
            if large.any():  # of a hot bucket only a mark goes through the shuffle; its members go the other way
                heads = at[:-1][size > bucket]
                yield pd.DataFrame({"part": part[heads], "key": key[heads], "fp": 0, "c": np.int16(DENSE)})
                yield pd.DataFrame({"part": np.int16(-1), "key": fp[large], "fp": fp[large], "c": np.int16(0)})
                key, fp, c, part = key[~large], fp[~large], c[~large], part[~large]
            yield pd.DataFrame({"part": part, "key": key, "fp": fp, "c": (c & 15).astype(np.int16)})

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # one run may go over several batches: hold it until it ends or is over the limit
        held: list[tuple[int, int]] = []
        at, dense = None, False
        for b in batches:
            part, key, fp, c = (b[x].to_numpy() for x in ("part", "key", "fp", "c"))
            border = _runs(part, key)
            size = np.diff(border)
            interior = np.zeros(len(size), bool)
            if len(size) > 2:
                interior[1:-1] = (size[1:-1] == 1) & (part[border[1:-2]] != -1)
            out: list[tuple[int, int | None]] = []
            for r in np.flatnonzero(~interior):
                s, e = border[r], border[r + 1]
                if (part[s], key[s]) != at:
                    out += _ended(held, dense, at, thresholds, limit, bucket)
                    held, at, dense = [], (part[s], key[s]), False
                if part[s] == -1:
                    out += [(int(key[s]), None)]
                    continue
                if not dense and (len(held) + e - s > bucket or c[s] == DENSE):
                    out += [(x, None) for x, y in held if y != DENSE]
                    held, dense = [], True
                if dense:
                    out += [(int(x), None) for x, y in zip(fp[s:e], c[s:e]) if y != DENSE]
                else:
                    held += list(zip(fp[s:e].tolist(), c[s:e].tolist()))
            if out:
                yield pd.DataFrame({"a": pd.Series([x for x, _ in out], dtype="int64"), "b": pd.array([y for _, y in out], dtype="Int64")})
        out = _ended(held, dense, at, thresholds, limit, bucket)
        if out:
            yield pd.DataFrame({"a": pd.Series([x for x, _ in out], dtype="int64"), "b": pd.array([y for _, y in out], dtype="Int64")})

    sent = map_large(fps.select("fp"), send, "part short, key long, fp long, c short")
    return map_large(sent.repartition("part", "key").sortWithinPartitions("part", "key", "c"), meet, "a long, b long")


def _ended(held, dense, at, thresholds, limit, bucket):
    if at is None or dense or len(held) < 2:
        return []
    fp, c = (np.array(x) for x in zip(*held))
    return _forest(fp.astype(np.int64), c, thresholds[at[0]], limit)


def dense_links(fps: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(a, b) links among the distinct fingerprints ``fp``, by meeting at values within half the limit.

    The values are many times the fingerprints, which the planner can't know: the hint keeps it from broadcasting them.
    """
    half = limit // 2
    odd = limit % 2

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            u = np.ascontiguousarray(b["fp"].to_numpy(np.int64)).view(np.uint64)
            for at in range(0, len(u), 512):
                part = u[at : at + 512]
                for k in range(half + odd + 1):
                    z = [part ^ np.uint64(sum(1 << x for x in some)) for some in combinations(range(BITS), k)]
                    yield pd.DataFrame({"z": np.concatenate(z).view(np.int64), "fp": np.tile(part, len(z)).view(np.int64), "k": np.int8(k)})

    sent = fps.select("fp").mapInPandas(spread, "z long, fp long, k byte")
    if odd:  # of two that meet, one went half the way and the other one step more
        near = sent.where(F.col("k") <= half).groupBy("z").agg(F.min("fp").alias("hub"))
        return sent.join(near.hint("merge"), "z").where(F.col("fp") != F.col("hub")).select(F.least("fp", "hub").alias("a"), F.greatest("fp", "hub").alias("b")).distinct()
    hubs = sent.groupBy("z").agg(F.min("fp").alias("hub"), F.max("fp").alias("far")).where("hub != far").select("z", "hub")
    return sent.join(hubs.hint("merge"), "z").where("fp != hub").select(F.col("hub").alias("a"), F.col("fp").alias("b")).distinct()


# ---------------------------------------------------------------- components


def components(links: DataFrame, root: str) -> DataFrame:
    """(node, label): the least node of each node's component, by alternating large-star and small-star rounds.

    Every round is written to the shared folder.  Minima are aggregated before the shuffle and joined back
    from a written table, so that the join of a hub with many neighbours can be split.
    """
    now = written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct(), "edges0", root)
    before = None
    for k in range(1, 100):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"large{k}", root)
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a != b").distinct()
        large = written(large, f"grown{k}", root)
        # small-star: u with its lesser neighbours; edges run from lesser a to greater b
        least = written(large.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m")), f"small{k}", root)
        small = large.join(least, large["b"] == least["u"])
        small = small.select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a != b").distinct()
        after = written(small, f"edges{k}", root)
        sign = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(sign) == before:
            return after.select(F.col("b").alias("node"), F.col("a").alias("label"))
        before, now = tuple(sign), after
    raise RuntimeError("components did not converge in 100 rounds")


def edges(groups: DataFrame, root: str, limit: int = LIMIT, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links among the distinct fingerprints ``fp`` that have the components of "within the limit"."""
    n, together = bit_statistics(groups)
    found = written(links(groups, plan(n, together, limit), limit, bucket), "links", root)
    out = found.where("b is not null")
    dense = written(found.where("b is null").select(F.col("a").alias("fp")).distinct(), "dense", root)
    if dense.head(1):
        out = out.unionByName(dense_links(dense, limit))
    return out


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, limit: int = LIMIT, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fp, component_id, component_rows) for every row."""
    root = scratch_root(docs.sparkSession)
    rows = written(fingerprints(docs, doc_id, text, shingle), "rows", root)
    groups = written(rows.groupBy("fp").agg(F.min("doc_id").alias("lo"), F.count("*").alias("n")), "groups", root)
    n = groups.count()
    labels = components(edges(groups, root, limit, bucket), root)
    labelled = groups.join(labels, groups["fp"] == labels["node"], "left").select("fp", "lo", "n", F.coalesce("label", "fp").alias("label"))
    labelled = written(labelled, "labelled", root)
    whole = written(labelled.groupBy("label").agg(F.min("lo").alias("component_id"), F.sum("n").alias("component_rows"), F.count("*").alias("size")), "whole", root)
    named = join_by_key(labelled, "label", whole, ["component_id", "component_rows"], "size", n, "fp")
    named = written(named.select(F.col("fp"), "n", "component_id", "component_rows"), "named", root)
    for name in ("groups", "links", "dense", "labelled", "whole"):
        remove(docs.sparkSession, f"{root}/{name}")
    return join_by_key(rows, "fp", named, ["component_id", "component_rows"], "n", rows.count(), "doc_id")
