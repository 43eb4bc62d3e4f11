import numpy as np
from pyspark.sql import functions as F

from celltide.llm import quality_model as q
from celltide.llm.shared import is_learning


def test_scores_equal_plain_densities():
    """Against determinants and inverses of the same shrunk covariances."""
    rng = np.random.default_rng(0)
    d = len(q.NAMES)
    x = [rng.normal(size=(200, d)) @ rng.normal(size=(d, d)), rng.normal(1, 2, size=(300, d))]
    total = np.stack([np.column_stack([np.ones(len(a)), a]).T @ np.column_stack([np.ones(len(a)), a]) for a in x])
    model = q._regularised(total, 0.2, 0.02)
    whole = sum(np.cov(a.T) * (len(a) - 1) for a in x) / 498
    logs = []
    for c, a in enumerate(x):
        cov = 0.8 * np.cov(a.T) + 0.2 * whole
        cov = 0.98 * cov + 0.02 * np.trace(cov) / d * np.eye(d)
        z = x[1][:50] - a.mean(0)
        logs.append(np.log((len(a) + 1) / 502) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", z, np.linalg.inv(cov), z))
    want = 1 / (1 + np.exp(logs[0] - logs[1]))
    assert np.allclose(model.score(x[1][:50]), want, rtol=1e-6)


def test_fit_adds_up_over_partitions(spark):
    rng = np.random.default_rng(1)
    rows = [(rng.normal(size=len(q.NAMES)).tolist(), int(i % 3 == 0)) for i in range(90)] + [([0.0] * len(q.NAMES), None), ([9.0] * len(q.NAMES), 5)]
    model = q.fit(spark.createDataFrame(rows, "stats array<double>, label int").repartition(5))
    for c in (0, 1):
        assert np.allclose(model.means[c], np.mean([s for s, y in rows if y == c], axis=0))


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = q.classify(docs, labels, is_learning(F.col("doc_id"), 4, 2))
    held = out.where(~is_learning(F.col("doc_id"), 4, 2)).join(labels, "doc_id").collect()
    assert sum(r.predicted == r.quality for r in held) >= 0.95 * len(held)


def test_odd_rows(spark):
    schema = "doc_id long, text string"
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert q.classify(spark.createDataFrame([], schema), none).collect() == []
    rows = [(1, None), (1, ""), (None, " \n"), (4, "x " * 50_000)]
    assert {r.score for r in q.classify(spark.createDataFrame(rows, schema), none).collect()} == {0.5}
    labels = spark.createDataFrame([(4, 1), (1, None)], "doc_id long, quality int")
    df = spark.createDataFrame([(1, "a", 3), (4, "b", 2)], schema + ", stats int")
    assert all(0 <= r.score <= 1 for r in q.classify(df, labels).collect())
    assert all(np.isfinite(q.statistics(t)).all() for t in (None, "", "\n", "!", "é" * 10, "a" * 100_000))
