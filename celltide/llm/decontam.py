"""Benchmark decontamination by Wu-Manber search over words.

Every run of eight consecutive words of a benchmark item is a test string (an item of fewer words is one).  Test strings
of one length share a block shift table: the last two words under the search window say how far the window may
move; where the move is zero, a bucket of test strings by that same suffix, split by their first word, is
compared word by word.  Words are maximal runs outside ASCII punctuation and blanks, with A-Z lower-cased.

Defined cases: null and empty texts have no words, null item ids or items without words no test strings; repeated items
count once; an empty benchmark hits nothing; an empty table gives an empty result.  Texts are searched whole.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import pick, ready, remove, scratch_root, written

WINDOW = 8
#: Test strings that one pass takes (about 700 bytes each in a Python worker); a larger benchmark is searched in several passes
#: over the rows, one after the other, and its items come to the driver a pass at a time.
PASS_WINDOWS = 250_000
MIN_ITEMS = 2

_TO_WORDS = bytes((c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32) for c in range(256))
FOUND = "n_words bigint, spans array<struct<s: int, e: int>>, items array<string>"


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_TO_WORDS).split() if text else []


class WuManber:
    """Shift and bucket tables of the test strings of one length."""

    def __init__(self, length: int, strings: dict[tuple[bytes, ...], tuple[str, ...]]):
        self.length, self.block = length, min(2, length)
        self.strings = strings
        self.shift: dict[bytes, int] = {}
        self.buckets: dict[bytes, dict[bytes, list[tuple[bytes, ...]]]] = defaultdict(lambda: defaultdict(list))
        for s in strings:
            for end in range(self.block, length + 1):
                block = b" ".join(s[end - self.block : end])
                self.shift[block] = min(self.shift.get(block, length), length - end)
            self.buckets[b" ".join(s[length - self.block :])][s[0]].append(s)

    def search(self, words: list[bytes]):
        """(start, test string) of every occurrence, overlapping ones too."""
        n, m, pair = len(words), self.length, self.block == 2
        most, shift, buckets = m - self.block + 1, self.shift, self.buckets
        at = m - 1
        while at < n:
            block = words[at - 1] + b" " + words[at] if pair else words[at]
            move = shift.get(block, most)
            if move:
                at += move
                continue
            start = at - m + 1
            for s in buckets[block].get(words[start], ()):
                if all(words[start + k] == s[k] for k in range(m)):
                    yield start, s
            at += 1


def compile_items(items: list[tuple[str, str]], window: int = WINDOW) -> list[WuManber]:
    by_length: dict[int, dict[tuple[bytes, ...], tuple[str, ...]]] = defaultdict(dict)
    known: dict[bytes, bytes] = {}  # equal words are one object
    for item, text in items:
        words = [known.setdefault(w, w) for w in words_of(text)]
        m = min(window, len(words))
        for k in range(len(words) - m + 1 if m else 0):
            strings, s = by_length[m], tuple(words[k : k + m])
            have = strings.get(s, ())
            if item not in have:
                strings[s] = (*have, item)
    return [WuManber(m, s) for m, s in sorted(by_length.items())]


def merged(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _machines(items, window: int) -> list[WuManber]:
    return ready(("decontam", window, hash(tuple(items))), lambda: compile_items(items, window))


def search_text(text: str | None, machines: list[WuManber], spans=(), items=()) -> tuple[int, list, list]:
    words = words_of(text)
    spans, names = list(spans), set(items)
    for machine in machines:
        for start, s in machine.search(words):
            spans.append((start, start + machine.length))
            names.update(machine.strings[s])
    return len(words), merged(spans) if len(spans) > 1 else spans, sorted(names)


class Benchmark:
    """The test strings of a benchmark in bounded groups of items, one group for each pass.

    A pass has about ``pass_windows`` test strings, or those of one item that has more.
    """

    def __init__(self, items: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW, pass_windows: int = PASS_WINDOWS):
        rows = pick(items, item_id=item_id, text=text).where(F.col("item_id").isNotNull() & F.col("text").isNotNull())
        rows = rows.select(F.col("item_id").cast("string").alias("item_id"), "text")
        words = F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"))
        size = rows.agg(F.sum(F.greatest(words - (window - 1), F.lit(1)))).first()[0] or 0
        self.window, self.passes = window, max(1, -(-size // pass_windows))
        self._group = lambda k: [tuple(r) for r in rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(self.passes)) == k).distinct().collect()]

    def with_hits(self, df: DataFrame, text: str, name: str) -> DataFrame:
        """Add a struct column of word count, merged hit spans and item ids; one pass over the rows per group.

        Where there are several, the rows are written after each, so that no plan holds two groups.
        """
        if self.passes == 1:
            return df.withColumn(name, self._pass(self._group(0), F.col(text), None))
        root = scratch_root(df.sparkSession)
        for k in range(self.passes):
            df = written(df.withColumn(name, self._pass(self._group(k), F.col(text), F.col(name) if k else None)), f"pass{k}", root)
            if k:
                remove(df.sparkSession, f"{root}/pass{k - 1}")
        return df

    def _pass(self, items: list[tuple[str, str]], text: Column, before: Column | None) -> Column:
        window = self.window
        items = sorted(items)

        @F.pandas_udf(FOUND)
        def first(texts: pd.Series) -> pd.DataFrame:
            machines = _machines(items, window)
            return pd.DataFrame([search_text(t, machines) for t in texts], columns=["n_words", "spans", "items"])

        @F.pandas_udf(FOUND)
        def later(texts: pd.Series, spans: pd.Series, names: pd.Series) -> pd.DataFrame:
            machines = _machines(items, window)
            found = [search_text(t, machines, [(x["s"], x["e"]) for x in s], n) for t, s, n in zip(texts, spans, names)]
            return pd.DataFrame(found, columns=["n_words", "spans", "items"])

        return first(text) if before is None else later(text, before["spans"], before["items"])


def scan(docs: DataFrame, benchmark: Benchmark, doc_id: str = "doc_id", text: str = "text", min_items: int = MIN_ITEMS) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, contaminated, spans, items) for every row; spans are word ranges."""
    rows = benchmark.with_hits(pick(docs, doc_id=doc_id, text=text), "text", "f").select("doc_id", "f.*")
    return rows.select(
        "doc_id",
        "n_words",
        F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"]).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        (F.size("items") >= min_items).alias("contaminated"),
        "spans",
        "items",
    )
