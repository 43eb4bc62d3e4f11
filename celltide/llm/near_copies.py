"""Near copies of operator 10's kind, without loss: components of "Jaccard of the five-word shingles is 0.8 or more".

SimHash proposes: fingerprints of the same shingles within four bits, found by the generalised pigeonhole principle, are
candidates.  That alone loses most pairs near 0.8 (64 bits of such pairs differ in ten), and a limit that keeps
them has candidates that grow with the square of the input.  So an exact way handles the rest: two sets with a Jaccard of 4/5
share one of the first n - ceil(4 n / 5) + 1 shingles of each, under any order that is the same for all sets.  Shingles that
are common in a sample come last, so that sets seldom meet at a passage that many texts quote; the order decides on
the work only, never on the result.

1. Sets that are equal are one from here on.  Each sends its first shingles; of the sets that send one shingle, that which shares
   most with others is the hub, and all others are held against it: rows in proportion to what was sent.
2. Candidates of SimHash and of hubs that may be near by a parity sketch (its bits that differ are no more than the shingles
   that differ) are verified on the whole sets.
3. Of shingles whose sets the links found so far leave in different components, pairs of such sets are verified too, if
   sizes, places and short sketches allow 4/5 with this shingle as the first that they share.  The join holds such sets of one
   shingle against each other, and lets out only pairs that pass.

All meetings are joins that adaptive execution splits where a shingle is hot, after counts and minima that are
aggregated before they are shuffled.  Sets are told apart by 64-bit digests, rows by 128 bits of their id and text.

Defined cases: null, empty and blank texts have the empty set, and are near to each other only; rows whose doc_id is null or
repeated are rows of their own; an empty table gives an empty result; long texts are taken whole; extra columns, whatever
their names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .shared import join_by_key, pick, remove, scratch_root, written

SHINGLE = 5
SEED = 42
#: Jaccard of near copies: NEAR / OF.
NEAR, OF = 4, 5
#: Bits of the parity sketch at least; it has one for each shingle or more.
SKETCH = 128
#: Longs of the short sketch that goes with a shingle.
SHORT = 8
#: Texts whose shingles are counted for the order, and the common shingles that it knows at most.
SAMPLE, COMMON = 4096, 1 << 16
#: Bits of a membership filter at most (8 MB); rows that pass it for nothing go through a shuffle and are dropped there.
FILTER = 1 << 26


def hashes(text: str | None) -> np.ndarray:
    """The hashes of the text's shingles, repeats included."""
    words = text.encode("utf-8", "replace").lower().split() if text else []
    n = max(1, len(words) - SHINGLE + 1) if words else 0
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(b" ".join(words[i : i + SHINGLE]), SEED) for i in range(n)), np.dtype("<u8"), n)


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct hashes of the text's shingles."""
    return np.unique(hashes(text).view("<i8"))


def signature(found: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), SEED)).view(np.int64))


def sketch(found: np.ndarray) -> np.ndarray:
    """The parities of the shingles by their low bits, a power of two of them."""
    size = max(SKETCH, 1 << (len(found) - 1).bit_length() if len(found) else 1)
    odd = np.bincount(found & (size - 1), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def folded(bits: np.ndarray) -> np.ndarray:
    """A sketch of SHORT longs at most."""
    return np.bitwise_xor.reduce(bits.reshape(-1, min(SHORT, len(bits))), axis=0)


def _differ(a: str, b: str) -> Column:
    """Bits in which two sketches differ; the longer one is folded to the shorter one's length."""
    at = lambda x: f"({x}[i] ^ IF(size({x}) > least(size({a}), size({b})), {x}[i + least(size({a}), size({b}))], 0L))"
    return F.expr(f"aggregate(sequence(0, least(size({a}), size({b})) - 1), 0, (n, i) -> n + bit_count({at(a)} ^ {at(b)}))")


def first_ones(found: np.ndarray, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The shingles to send, by their order; ``common`` is sorted, ``rank`` is over zero."""
    n = len(found)
    if not n:
        return found
    place = np.zeros(n, np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, found), len(common) - 1)
        place = np.where(common[at] == found, rank[at], 0)
    return found[np.lexsort((found, place))[: n - -(-NEAR * n // OF) + 1]]


def common_shingles(docs: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The most common shingles of a sample of different texts, sorted, and their counts."""

    @F.pandas_udf("array<long>")
    def sets(texts: pd.Series) -> pd.Series:
        return pd.Series([shingles(t) for t in texts])

    some = docs.where(F.pmod(F.xxhash64("text"), F.lit(max(1, n // SAMPLE))) == 0).select("text").distinct()
    some = some.repartition(max(8, docs.sparkSession.sparkContext.defaultParallelism))  # a few texts, much work on each
    counts = some.select(F.explode(sets("text")).alias("s")).groupBy("s").agg(F.count("*").alias("c")).where("c > 1")
    rows = sorted(tuple(r) for r in counts.orderBy(F.desc("c"), "s").limit(COMMON).collect())
    return np.array([s for s, _ in rows], np.int64), np.array([c for _, c in rows], np.int64)


class Members:
    """A membership filter of longs: a broadcast bitmap of bounded size, which never misses a member."""

    def __init__(self, df: DataFrame, column: str):
        spark, n = df.sparkSession, df.count()
        size = self.size = min(FILTER, max(1 << 16, 1 << (16 * n).bit_length()))

        def marks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            bits = np.zeros(size, bool)
            for b in batches:
                bits[b[column].to_numpy() & (size - 1)] = True
            yield pd.DataFrame({"bits": [np.packbits(bits).tobytes()]})

        bits = np.zeros(size // 8, np.uint8)
        if n:
            for r in df.select(column).coalesce(8).mapInPandas(marks, "bits binary").toLocalIterator():
                bits |= np.frombuffer(r["bits"], np.uint8)
        self._bits = spark.sparkContext.broadcast(bits.tobytes())

    def may_have(self, column: Column) -> Column:
        shared, size = self._bits, self.size

        @F.pandas_udf("boolean")
        def hit(x: pd.Series) -> pd.Series:
            at = x.to_numpy() & (size - 1)
            return pd.Series((np.frombuffer(shared.value, np.uint8)[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool))

        return hit(column)


def verified(docs: DataFrame, each: DataFrame, pairs: DataFrame, name: str, root: str) -> DataFrame:
    """Those of the pairs (a, b) of signatures that are near copies."""
    pairs = written(pairs, f"{name}_pairs", root)
    some = each.where(Members(pairs.select(F.explode(F.array("a", "b")).alias("sig")), "sig").may_have(F.col("sig")))
    of = lambda x: some.select(F.col("sig").alias(x), F.col("n").alias(f"n{x}"), F.col("k").alias(f"k{x}"), F.col("bits").alias(f"bits{x}"))
    both = pairs.join(of("a").hint("merge"), "a").join(of("b").hint("merge"), "b")
    # at a Jaccard of NEAR / OF, the shingles of one set only are that share of all of both
    near = (OF * F.col("na") >= NEAR * F.col("nb")) & (OF * F.col("nb") >= NEAR * F.col("na"))
    near = near & ((NEAR + OF) * _differ("bitsa", "bitsb") <= (OF - NEAR) * (F.col("na") + F.col("nb")))
    both = written(both.where(near).select("a", "b", "na", "nb", "ka", "kb"), f"{name}_may", root)
    needed = both.select(F.explode(F.array(F.struct(F.col("a").alias("sig"), F.col("ka").alias("k")), F.struct(F.col("b").alias("sig"), F.col("kb").alias("k")))).alias("x")).select("x.*").distinct()
    needed = written(needed, f"{name}_needed", root)

    @F.pandas_udf("sig long, found array<long>")
    def sets(texts: pd.Series) -> pd.DataFrame:
        found = [shingles(t) for t in texts]
        return pd.DataFrame({"sig": [signature(x) for x in found], "found": found})

    held = docs.where(Members(needed, "k").may_have(F.col("k"))).select("k", "text")
    held = held.join(needed.hint("merge"), "k", "left_semi").select(sets("text").alias("f")).select("f.*")
    held = written(held.groupBy("sig").agg(F.first("found").alias("found")), f"{name}_sets", root)
    of = lambda x: held.select(F.col("sig").alias(x), F.col("found").alias(f"found{x}"))
    both = both.drop("ka", "kb").join(of("a").hint("merge"), "a").join(of("b").hint("merge"), "b")
    common = F.size(F.array_intersect("founda", "foundb"))
    found = written(both.where((NEAR + OF) * common >= NEAR * (F.col("na") + F.col("nb"))).select("a", "b"), f"{name}_links", root)
    remove(docs.sparkSession, f"{root}/{name}_sets")
    return found


def _proposed(each: DataFrame, root: str) -> DataFrame:
    """(a, b): candidates by SimHash; sets of one fingerprint are held against the least of them."""
    heads = written(each.groupBy("fp").agg(F.min("sig").alias("head"), F.count("*").alias("n")), "heads", root)
    links = simhash.edges(heads, root)
    of = lambda x: heads.select(F.col("fp").alias(x), F.col("head").alias(f"h{x}"))
    linked = links.join(of("a").hint("merge"), "a").join(of("b").hint("merge"), "b").select(F.least("ha", "hb").alias("a"), F.greatest("ha", "hb").alias("b"))
    alike = each.select("sig", "fp").join(heads.where("n > 1").hint("merge"), "fp").where("sig != head")
    return linked.unionByName(alike.select(F.col("head").alias("a"), F.col("sig").alias("b")))


def _met(each: DataFrame, root: str) -> DataFrame:
    """(s, sig, n, i, hub, hn, hi, c) of every shingle that c > 1 sets send.

    The hub is the set that has the most in common with others: the sum of c over what it sends, against its size.  Copies that
    were changed at places of their own are near the text that they were made from, though not each other.
    """
    sent = each.select("sig", "n", F.posexplode("sent").alias("i", "s"))
    counts = written(sent.groupBy("s").agg(F.count("*").alias("c")).where("c > 1"), "counts", root)
    some = sent.where(Members(counts, "s").may_have(F.col("s")))
    shared = written(some.join(counts.hint("merge"), "s"), "shared", root)
    weights = shared.groupBy("sig").agg((F.sum("c") / F.first("n")).alias("w"))
    rows = shared.join(weights.hint("merge"), "sig")
    hubs = written(rows.groupBy("s").agg(F.max(F.struct("w", "sig", "n", "i")).alias("h")).select("s", F.col("h.sig").alias("hub"), F.col("h.n").alias("hn"), F.col("h.i").alias("hi")), "hubs", root)
    return written(shared.join(hubs.hint("merge"), "s"), "met", root)


def _first_met(n: str, i: str, m: str, j: str) -> Column:
    """Sets of n and m shingles that share the ones at places i and j, and none before, may be near copies."""
    return (NEAR + OF) * F.least(F.col(n) - F.col(i), F.col(m) - F.col(j)) >= NEAR * (F.col(n) + F.col(m))


def _across(met: DataFrame, labels: DataFrame, each: DataFrame, root: str) -> DataFrame:
    """(a, b): pairs that meet at a shingle, lie in different components, and may be near copies.

    Of such a pair the shingle stands in the first ninth of one set at least, and sizes differ by a quarter at most: that set is
    sent to its own class of sizes and both next to it.
    """
    rows = met.where("c > 2").join(labels.hint("merge"), F.col("sig") == F.col("node"), "left").select("s", "sig", "n", "i", F.coalesce("label", "sig").alias("label"))
    rows = written(rows, "labelled_rows", root)
    mixed = rows.groupBy("s").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x != y").select("s")
    rows = rows.join(mixed.hint("merge"), "s").withColumn("class", F.floor(F.log("n") / F.log(F.lit(OF / NEAR)) + 1e-9).cast("int"))
    rows = written(rows.join(each.select("sig", "mini").hint("merge"), "sig"), "mixed_rows", root)
    early = rows.where((NEAR + OF) * (F.col("n") - F.col("i")) >= 2 * NEAR * F.col("n"))
    early = early.select("s", *[F.col(c).alias(f"e_{c}") for c in ("sig", "n", "i", "label", "mini")], F.explode(F.expr("array(class - 1, class, class + 1)")).alias("class"))
    near = (F.col("e_label") != F.col("label")) & _first_met("e_n", "e_i", "n", "i") & ((NEAR + OF) * _differ("e_mini", "mini") <= (OF - NEAR) * (F.col("e_n") + F.col("n")))
    pairs = early.join(rows.hint("merge"), (early["s"] == rows["s"]) & (early["class"] == rows["class"]) & near)
    return pairs.select(F.least("e_sig", "sig").alias("a"), F.greatest("e_sig", "sig").alias("b")).distinct()


def marked(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows with 128 bits of id and text (k, t) that tell rows apart."""
    return docs.withColumns({"k": F.xxhash64(F.col(doc_id).cast("string"), F.col(text)), "t": F.xxhash64(F.lit(SEED), F.col(text), F.col(doc_id).cast("string"))})


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, k, t, component_id, first) for every row.

    ``component_id`` is the smallest doc_id of the group (null if it has none); ``first`` marks its row, of several with that id
    the one with the least (k, t), and repetitions of the same row.
    """
    root = scratch_root(docs.sparkSession)
    docs = marked(pick(docs, doc_id=doc_id, text=text))
    total = docs.count()
    common, rank = common_shingles(docs, total)
    known = docs.sparkSession.sparkContext.broadcast((common, rank))

    @F.pandas_udf("sig long, n int, fp long, bits array<long>, mini array<long>, sent array<long>")
    def of(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            every = hashes(t)
            x = np.unique(every.view("<i8"))
            bits = sketch(x)
            out.append((signature(x), len(x), simhash.majority(every), bits, folded(bits), first_ones(x, *known.value)))
        return pd.DataFrame(out, columns=["sig", "n", "fp", "bits", "mini", "sent"])

    rows = written(docs.select("doc_id", "k", "t", of("text").alias("f")).select("doc_id", "k", "t", "f.*"), "rows", root)
    # only sets that several rows have go through a shuffle
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k", "t")
    again = written(rows.groupBy("sig").agg(F.count("*").alias("c")).where("c > 1").select("sig"), "again", root)
    rows = rows.withColumn("_hit", Members(again, "sig").may_have(F.col("sig")))
    shape = F.struct("k", "n", "fp", "bits", "mini", "sent")
    alone = rows.where("not _hit").select("sig", key.alias("lo"), F.lit(1).cast("long").alias("rows"), shape.alias("f"))
    met = rows.where("_hit").groupBy("sig").agg(F.min(key).alias("lo"), F.count("*").alias("rows"), F.first(shape).alias("f"))
    each = written(alone.unionByName(met).select("sig", "lo", "rows", "f.*"), "each", root)
    met = _met(each, root)
    hubs = met.where((F.col("sig") != F.col("hub")) & _first_met("n", "i", "hn", "hi")).select(F.least("hub", "sig").alias("a"), F.greatest("hub", "sig").alias("b"))
    found = verified(docs, each, hubs.unionByName(_proposed(each, root)).distinct(), "near", root)
    labels = simhash.components(found, f"{root}/first")
    found = found.unionByName(verified(docs, each, _across(met, labels, each, root), "others", root))
    labels = simhash.components(found, f"{root}/second")
    labelled = each.join(labels.hint("merge"), F.col("sig") == F.col("node"), "left").select("sig", "lo", "rows", F.coalesce("label", "sig").alias("label"))
    labelled = written(labelled, "labelled", root)
    whole = written(labelled.groupBy("label").agg(F.min("lo").alias("least"), F.count("*").alias("size")), "whole", root)
    named = written(join_by_key(labelled, "label", whole, ["least"], "size", total, "sig").select("sig", "rows", "least"), "named", root)
    out = join_by_key(rows.select("doc_id", "k", "t", "sig"), "sig", named, ["least"], "rows", total, "t")
    out = written(out.select("doc_id", "k", "t", F.col("least.doc_id").alias("component_id"), ((F.col("least.k") == F.col("k")) & (F.col("least.t") == F.col("t"))).alias("first")), "groups", root)
    for name in ("rows", "each", "counts", "shared", "met", "hubs", "heads", "labelled", "whole", "named", "labelled_rows", "mixed_rows"):
        remove(docs.sparkSession, f"{root}/{name}")
    return out


def firsts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each group of near copies one whole row of ``docs``: the first of :func:`groups`; of equal (id, text) the least row.

    Only rows that may have to go are shuffled, with their texts.
    """
    columns = docs.columns
    judged = groups(docs, doc_id, text)
    gone = judged.where(~F.col("first")).select("k", "t", F.lit(0).alias("how"))
    again = judged.where("first").groupBy("k", "t").agg(F.count("*").alias("c")).where("c > 1").select("k", "t", F.lit(1).alias("how"))
    special = written(gone.unionByName(again).distinct(), "special")
    rows = marked(docs, doc_id, text).withColumn("_hit", Members(special, "k").may_have(F.col("k")))
    doubtful = rows.where("_hit").join(special.hint("merge"), ["k", "t"], "left")
    stay = rows.where("not _hit").select(*columns).unionByName(doubtful.where("how is null").select(*columns))
    if not special.where("how = 1").head(1):
        return stay
    once = doubtful.where("how = 1").groupBy("k", "t").agg(F.min(F.struct(*columns)).alias("r")).select("r.*")
    return stay.unionByName(once)
