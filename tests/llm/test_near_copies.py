import random

import corpus_pipeline as cp
import pytest
from celltide.llm import near_copies
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain_set(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """(doc_id, smallest doc_id of the component) by comparing all pairs."""
    sets = [plain_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, least.get(find(i))) for i, (d, _) in enumerate(rows)), key=repr)


def run(spark, rows):
    out = near_copies.groups(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "component_id").collect()
    return sorted((tuple(r) for r in out), key=repr)


def corpus(seed=5):
    """Near copies on both sides of the threshold, a chain, a large group and a passage that many texts quote."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    made = lambda n: [rng.choice(vocab) for _ in range(n)]
    passage, texts = made(40), []
    for n in (12, 60, 200, 700):
        base = made(n)
        for changes in (0, 0, *[max(1, n // k) for k in (120, 70, 50, 45, 40, 35, 25)]):
            words = list(base)
            for _ in range(changes):
                words[rng.randrange(n)] = rng.choice(vocab).upper()
            texts.append(words)
    chain = made(150)
    for _ in range(12):
        chain = chain[6:] + made(6)
        texts.append(chain)
    group = made(120)
    texts += [group[:k] + made(1) + group[k + 1 :] for k in range(0, 120, 3)]
    texts += [passage + made(rng.choice([8, 12, 60])) for _ in range(40)]
    rng.shuffle(texts)
    rows = [(i * 2, " ".join(t)) for i, t in enumerate(texts)]
    return rows + [(None, rows[0][1]), (7, None), (9, ""), (11, " \n"), (13, "one two"), (15, "One  TWO"), (0, "a second row of this id"), (None, "no id here at all")]


@pytest.mark.parametrize("common", [near_copies.COMMON, 0])
def test_components_equal_brute_force(spark, common, monkeypatch):
    """With any order of the shingles."""
    monkeypatch.setattr(near_copies, "COMMON", common)
    rows = corpus()
    assert run(spark, rows) == brute(rows)


def test_documents_equal_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert run(spark, rows) == brute(rows)


def test_the_stage_links_by_jaccard(spark):
    """Pairs over the threshold that four bits of a fingerprint do not link, and one under it."""
    rng = random.Random(1)
    base = [rng.choice([f"w{i}" for i in range(300)]) for _ in range(100)]
    changed = lambda *at: " ".join("X" if k in at else w for k, w in enumerate(base))
    texts = [changed(), changed(50), changed(30, 70), changed(10, 30, 50, 70, 90)]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    kept = sorted(r.doc_id for r in cp.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), "").collect())
    least = dict(brute([r[:2] for r in rows]))
    assert kept == sorted(k for k, v in least.items() if k == v) == [0, 3]


def test_rows_without_an_id_of_their_own_stay(spark):
    """Null and repeated ids: unrelated texts are kept, near copies go, of equal rows one stays."""
    text = lambda k: " ".join(f"t{k}w{i}" for i in range(40))
    rows = [(None, text(1)), (None, text(2)), (None, text(3)), (5, text(4)), (5, text(5)), (5, text(5)), (6, text(4) + " end"), (None, text(5)), (None, text(1))]
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], SCHEMA)
    kept = sorted(((r.doc_id, r.text[:2]) for r in cp.near_duplicates(spark, docs, "").collect()), key=repr)
    assert kept == [(5, "t4"), (5, "t5"), (None, "t1"), (None, "t2"), (None, "t3")]


def test_columns_with_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b c", 7, 0.5), (2, "A  b c", 8, 0.5), (3, None, 9, None)], "doc_id long, text string, component_id int, Text double")
    assert sorted(tuple(r) for r in near_copies.groups(docs).select("doc_id", "component_id").collect()) == [(1, 1), (2, 1), (3, 3)]


def test_sketches_bound_the_shingles_that_differ(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    rows, least = [], []
    for n, m in ((3, 4), (100, 120), (500, 520), (1000, 1030), (2000, 2100), (0, 1)):
        all_of = np.unique(rng.integers(-(2**63), 2**63 - 1, n + m))
        a, b = all_of[:n], all_of[n // 5 : n // 5 + m]
        rows.append((near_copies.sketch(a).tolist(), near_copies.sketch(b).tolist()))
        least.append(len(np.setxor1d(a, b)))
    out = spark.createDataFrame(rows, "a array<long>, b array<long>").select(near_copies._differ("a", "b").alias("d")).collect()
    assert all(0 < r.d <= x for r, x in zip(out, least)) and out[3].d > least[3] // 4


def test_members_are_never_missed(spark):
    some = spark.range(0, 3000, 7).select(F.xxhash64("id").alias("x"))
    found = near_copies.Members(some, "x")
    assert some.where(found.may_have(some["x"])).count() == some.count()
    assert some.where(near_copies.Members(some.limit(0), "x").may_have(some["x"])).count() == 0


def test_empty(spark):
    assert run(spark, []) == []
