import collections
import math
import random
import re

import pytest

from celltide.llm import quality_rules as q

SCHEMA = "doc_id long, text string"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = collections.Counter(grams)
    inside = {i + k for i, g in enumerate(grams) if many[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return [n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside), n < 50 or 100 * len(inside) > 50 * n]


TEXTS = [
    None, "", " \t\n\x0b\x0c\r ", "one", "a b", "a b c a b c", "a a a a a", "x y z " * 400, "é ü 😀 #*$%&|<>", "l\nl\n \nl\n\nm\r\nm\r\n",
    "w" * 50_000, " ".join(f"w{i % 700}" for i in range(21_000)), "tail\n", "\x1c a \x85 b", "same a b d same a b e a b same",
]


def test_base_counts(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "n u l l"), (3, "one")]
    out = q.judge(spark.createDataFrame(rows, SCHEMA)).collect()
    got = sorted((repr(r.doc_id), [r[c] for c in BASE]) for r in out)
    assert got == sorted((repr(i), plain(t)) for i, t in rows)
    assert all(0 <= r.posterior <= 1 and r.kept == (not r.base_failed and r.posterior >= 0.5) for r in out)


def test_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = {r.doc_id: plain(r.text) for r in docs.collect()}
    out = q.judge(docs).collect()
    assert {r.doc_id: [r[c] for c in BASE] for r in out} == want
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    judged = [(r.posterior >= 0.5, quality[r.doc_id]) for r in out if r.doc_id in quality and r.n_words >= 50]
    assert sum(int(a) == b for a, b in judged) >= 0.9 * len(judged)


def plain_em(patterns, n, rounds):
    """The same mixture, a document and a rule at a time."""
    kinds = range(n + 1)
    docs = [p for p, c in patterns for _ in range(c)]
    belief = []
    for p in docs:
        good = (p.count(1) + 1) / (p.count(1) + p.count(0) + 2)
        w = [(v == 0) + 1e-3 for v in p]
        belief.append([good] + [(1 - good) * x / sum(w) for x in w])
    for _ in range(rounds):
        shares = [(sum(b[k] for b in belief) + 1) / (len(docs) + n + 1) for k in kinds]
        rate = [[0.0] * n for _ in kinds]
        for k in kinds:
            for j in range(n):
                bad = 1 + sum(b[k] for b, p in zip(belief, docs) if p[j] == 0)
                fine = 1 + sum(b[k] for b, p in zip(belief, docs) if p[j] == 1)
                rate[k][j] = bad / (bad + fine)
        belief = []
        for p in docs:
            chance = [math.prod([shares[k]] + [rate[k][j] if v == 0 else 1 - rate[k][j] for j, v in enumerate(p) if v != 2]) for k in kinds]
            belief.append([c / sum(chance) for c in chance])
    return shares, rate, dict(zip(docs, (b[0] for b in belief)))


def drawn(seed, size=4000):
    """Votes of five rules: a and b see one fault, c and d another; e speaks against a tenth of all documents, for no reason."""
    rng = random.Random(seed)
    counts = collections.Counter()
    truth = {}
    for _ in range(size):
        fault = rng.choices([None, "ab", "cd"], [0.8, 0.12, 0.08])[0]
        p = tuple(2 if rng.random() < 0.1 else int(not rng.random() < (0.1 if n == "e" else 0.9 if fault and n in fault else 0.01)) for n in "abcde")
        counts[p] += 1
        truth.setdefault(p, collections.Counter())[fault is None] += 1
    return sorted(counts.items()), truth


def test_estimate_equals_plain_em():
    patterns, _ = drawn(1, 300)
    found = q.estimate(patterns, list("abcde"), rounds=7)
    shares, rate, _ = plain_em(patterns, 5, 7)
    assert found.shares == pytest.approx(shares) and [[r[0] for r in kind] for kind in found.rates] == [pytest.approx(r) for r in rate]


def test_rates_are_estimated_and_replace_all_must_pass(spark):
    """The posterior by Spark equals the plain product of chances; a needless vote against is overruled, faults are not."""
    patterns, truth = drawn(2)
    found = q.estimate(patterns, list("abcde"))
    assert abs(found.prior - 0.8) < 0.04
    assert abs(found.rates[0][4][0] - 0.1) < 0.03 and found.accuracy("a")[1] > 0.97 and found.accuracy("a")[0] > found.accuracy("e")[0] + 0.2
    df = spark.createDataFrame([p for p, _ in patterns], "v_a int, v_b int, v_c int, v_d int, v_e int")
    got = {tuple(r)[:5]: r.post for r in df.withColumn("post", found.posterior()).collect()}
    for p, _ in patterns:
        chance = [math.prod([s] + [r[j][v] for j, v in enumerate(p) if v != 2]) for s, r in zip(found.shares, found.rates)]
        assert got[p] == pytest.approx(chance[0] / sum(chance), rel=1e-9)
    assert got[(1, 1, 1, 1, 0)] > 0.9 and got[(0, 0, 1, 1, 1)] < 0.1 and got[(1, 1, 0, 0, 1)] < 0.1
    right = sum(t[got[p] >= 0.5] for p, t in truth.items())
    all_must_pass = sum(t[0 not in p] for p, t in truth.items())
    best = sum(max(t.values()) for t in truth.values())  # of any verdict by votes, with the truth known
    assert right >= 0.98 * best and right > all_must_pass + 200


def test_estimate_without_documents():
    assert 0 < q.estimate([], list("ab")).prior < 1


def test_labelled_documents(spark):
    """Junk of every kind goes and clean documents stay, though the rules see no labels."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = q.judge(docs).where("NOT base_failed").join(labels.select("doc_id", "quality"), "doc_id").collect()
    good, bad = [r.kept for r in out if r.quality == 1], [r.kept for r in out if r.quality == 0]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.05 * len(bad) and bad


def test_empty_and_extra(spark):
    assert q.judge(spark.createDataFrame([], SCHEMA)).collect() == []
    df = spark.createDataFrame([(1, "a", "b", 2)], SCHEMA + ", words string, n_words int")
    assert q.judge(df).first().n_words == 1


def test_plan_is_native(spark, sf_dir):
    plan = q.judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|ArrowEval", plan)
