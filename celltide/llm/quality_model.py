"""Quality classification by a regularised quadratic discriminant.

Statistics of a whole text are transformed to roughly normal scales.  Per class, mean and covariance come from sums over
all labelled rows; each covariance is shrunk towards the pooled one and then towards a multiple of the identity.  The score is
the posterior of class 1: the difference of the classes' log densities, whose Mahalanobis distances are worked
out by forward substitution with the cached Cholesky factors, and of their log priors.

Defined cases: a null text counts as empty, whose statistics are those of no words; labels other than 0 and 1 and null
labels are not learned from; labels of a repeated document count as often as it stands there; a class without rows takes the
pooled estimates and the other class's mean, so that the score falls to the prior; with no labels at all every score is
0.5; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import pick, written

#: Shares of the pooled covariance, and then of the identity at the mean variance.
POOLED, IDENTITY = 0.2, 0.02
THRESHOLD = 0.7
NAMES = ("words", "length", "symbols", "upper", "exclaims", "distinct", "stutter", "short", "stops", "commas", "digits", "lines", "other", "packed", "dup_lines", "junk_lines")

_CLASS = {name: np.array([chr(b) in chars for b in range(256)], np.float64) for name, chars in {"symbols": "#*$%&|<>", "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digits": "0123456789", "stops": ".?!"}.items()}
_CLASS["high"] = np.array([b >= 194 for b in range(256)], np.float64)


def _log(x: float) -> float:
    return math.log(x + 0.003)


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of a text, in the order of NAMES."""
    data = (text or "").encode("utf-8", "replace")
    words = data.split()
    n, size = len(words), max(1, len(data))
    w = max(1, n)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    of = {k: float(counts @ m) for k, m in _CLASS.items()}
    lines = [x for x in data.split(b"\n") if x.strip()]
    marked = sum(len(x) for x in lines if x.count(b"!!") * 30 > len(x) or sum(map(x.count, (b"*", b"$", b"%", b"&", b"#", b"|"))) * 20 > len(x))
    return [
        math.log1p(n),
        math.log1p((size - n) / w),
        _log(of["symbols"] / size),
        _log(of["upper"] / size),
        _log(float(counts[33]) / w),
        math.log((len(set(words)) + 1) / (w + 1)),
        _log(sum(a == b for a, b in zip(words, words[1:])) / w),
        sum(len(x) <= 3 for x in words) / w,
        _log(of["stops"] / w),
        _log(float(counts[44]) / w),
        _log(of["digits"] / size),
        _log(float(counts[10]) / w),
        _log(of["high"] / size),
        math.log(len(zlib.compress(data, 1)) / size) if data else 0.0,
        _log((len(lines) - len(set(lines))) / max(1, len(lines))),
        _log(marked / size),
    ]


def statistics_column(text: Column) -> Column:
    @F.pandas_udf("array<double>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([statistics(t) for t in texts], dtype=object)

    return of(text)


@dataclass(frozen=True)
class Discriminant:
    """Priors, means and Cholesky factors of the two classes."""

    log_prior: tuple[float, float]
    means: np.ndarray  # 2 x d
    factors: np.ndarray  # 2 x d x d, lower

    def score(self, x: np.ndarray) -> np.ndarray:
        """The posterior of class 1 of each row."""
        logs = []
        for c in (0, 1):
            y = _forward(self.factors[c], (x - self.means[c]).T)
            logs.append(self.log_prior[c] - np.log(np.diag(self.factors[c])).sum() - 0.5 * (y * y).sum(0))
        return 1 / (1 + np.exp(-np.clip(logs[1] - logs[0], -700, 700)))

    def column(self, stats: Column) -> Column:
        model = self

        @F.pandas_udf("double")
        def scored(rows: pd.Series) -> pd.Series:
            return pd.Series(model.score(np.stack(rows.to_list())) if len(rows) else [], dtype="float64")

        return scored(stats)


def _forward(lower: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Solve lower @ y = b for many columns."""
    y = np.empty_like(b)
    for i in range(len(lower)):
        y[i] = (b[i] - lower[i, :i] @ y[:i]) / lower[i, i]
    return y


def fit(labelled: DataFrame, pooled: float = POOLED, identity: float = IDENTITY) -> Discriminant:
    """Learn from all rows of (stats, label): sums of the statistics and of their products are added up by the executors."""
    d = len(NAMES)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, d + 1, d + 1))
        for b in batches:
            labels = b["label"].to_numpy()
            for c in (0, 1):
                own = b["stats"][labels == c]
                if len(own):
                    x = np.column_stack([np.ones(len(own)), np.stack(own.to_list())])
                    total[c] += x.T @ x
        c, i, j = np.nonzero(np.ones_like(total))
        yield pd.DataFrame({"c": c, "i": i, "j": j, "v": total.ravel()})

    total = np.zeros((2, d + 1, d + 1))
    known = labelled.where(F.col("label").isin(0, 1)).select("stats", F.col("label").cast("int").alias("label"))
    for r in known.mapInPandas(sums, "c int, i int, j int, v double").groupBy("c", "i", "j").agg(F.sum("v").alias("v")).collect():
        total[r["c"], r["i"], r["j"]] = r["v"]
    return _regularised(total, pooled, identity)


def _regularised(total: np.ndarray, pooled: float, identity: float) -> Discriminant:
    d = total.shape[1] - 1
    n = total[:, 0, 0]
    if n.sum() == 0:
        return Discriminant((0.0, 0.0), np.zeros((2, d)), np.stack([np.eye(d)] * 2))
    means = np.stack([total[c, 0, 1:] / n[c] if n[c] else total[:, 0, 1:].sum(0) / n.sum() for c in (0, 1)])
    scatter = [total[c, 1:, 1:] - n[c] * np.outer(means[c], means[c]) for c in (0, 1)]
    whole = (scatter[0] + scatter[1]) / max(1.0, n.sum() - 2)
    factors = []
    for c in (0, 1):
        own = scatter[c] / (n[c] - 1) if n[c] > 1 else whole
        cov = (1 - pooled) * own + pooled * whole
        cov = (1 - identity) * cov + identity * max(np.trace(cov) / d, 1e-6) * np.eye(d)
        factors.append(np.linalg.cholesky((cov + cov.T) / 2))
    prior = (n + 1) / (n.sum() + 2)
    return Discriminant((float(np.log(prior[0])), float(np.log(prior[1]))), means, np.stack(factors))


def classify(docs: DataFrame, labels: DataFrame, learns: Column | None = None, doc_id: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted) for every row; learned from labelled rows where ``learns`` of doc_id holds.

    Statistics are worked out once and written; fitting and scoring read them.
    """
    rows = written(pick(docs, doc_id=doc_id, text=text).select("doc_id", statistics_column(F.col("text")).alias("stats")), "statistics")
    known = pick(labels, doc_id=doc_id, label=label)
    own = rows.where(learns) if learns is not None else rows
    model = fit(own.join(known, "doc_id").select("stats", "label"))
    scored = rows.select("doc_id", model.column(F.col("stats")).alias("score"))
    return scored.select("doc_id", "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
