import random

import pytest

from celltide.llm import decontam


def brute(docs, items, window=8):
    tests = {}
    for item, text in items:
        if item is None:
            continue
        words = decontam.words_of(text)
        m = min(window, len(words))
        for k in range(len(words) - m + 1 if m else 0):
            tests.setdefault(tuple(words[k : k + m]), set()).add(str(item))
    out = []
    for d, text in docs:
        words = decontam.words_of(text)
        hit, names = set(), set()
        for m in {len(t) for t in tests}:
            for k in range(len(words) - m + 1):
                found = tests.get(tuple(words[k : k + m]))
                if found:
                    hit |= set(range(k, k + m))
                    names |= found
        out.append((repr(d), len(words), len(hit), len(names), sorted(names), len(names) >= 2))
    return sorted(out)


@pytest.mark.parametrize("pass_windows", [decontam.PASS_WINDOWS, 10])
def test_scan_equals_brute_force(spark, pass_windows):
    """Also with the items in many groups, one pass over the rows for each."""
    rng = random.Random(1)
    word = lambda: rng.choice(["a", "B", "c", "dé", "e1", "x-y"])
    items = [(i % 20 if i % 9 else None, " ".join(word() for _ in range(rng.choice([1, 2, 3, 8, 9, 20])))) for i in range(4, 34)] + [(50, None), (51, ""), (52, "?!")]
    docs = [(i, " ".join(word() for _ in range(rng.choice([0, 1, 7, 60, 400])))) for i in range(60)]
    docs += [(None, items[3][1].upper()), (5, None), (5, " . "), (6, (items[5][1] + " ") * 200)]
    bench = decontam.Benchmark(spark.createDataFrame(items, "item_id long, text string"), pass_windows=pass_windows)
    assert (bench.passes > 1) == (pass_windows == 10)
    got = decontam.scan(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    assert sorted((repr(r.doc_id), r.n_words, r.n_hit, r.n_items, r["items"], r.contaminated) for r in got) == brute(docs, items)


def test_shifts_skip_and_find_overlaps():
    strings = {(b"a", b"a", b"a"): {"1"}, (b"a", b"b", b"a"): {"2"}}
    machine = decontam.WuManber(3, strings)
    words = [b"a"] * 5 + [b"b", b"a", b"z", b"z", b"z"]
    assert list(machine.search(words)) == [(0, (b"a",) * 3), (1, (b"a",) * 3), (2, (b"a",) * 3), (4, (b"a", b"b", b"a"))]
    assert machine.shift.get(b"z z") is None


def test_empty_and_extra(spark):
    none = decontam.Benchmark(spark.createDataFrame([], "item_id long, text string"))
    docs = spark.createDataFrame([(1, "a b", 1, 2)], "doc_id long, text string, f int, items int")
    assert decontam.scan(docs, none).first().n_hit == 0
    assert decontam.scan(spark.createDataFrame([], "doc_id long, text string"), none).collect() == []
