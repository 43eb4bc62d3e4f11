"""From a list of metrics to one aggregation and a few projections.

Stage 1 is a single ``groupBy`` with conditional aggregates and, per attribute and filter that need it, one sorted value
array.  All later stages are projections over that row, so nothing is shuffled, scanned or joined again.
Equal (metric, filter, attribute) nodes are worked out once.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.metrics import KINDS, Filter, Metric

KEYS = ("xi", "yi")


@dataclass(frozen=True)
class Node:
    metric: Metric
    attr: str

    @property
    def key(self) -> tuple:
        m = self.metric
        return m.name, m.filter.name, self.attr, tuple(Node(d, a).key for d, a in self.needs())

    def needs(self) -> list[tuple[Metric, str]]:
        named = self.metric.dep_attrs or (None,) * len(self.metric.deps)
        return [(d, a or self.attr) for d, a in zip(self.metric.deps, named)]


def _values(attr: str, f: Filter) -> Column:
    x = F.col(f"`{attr}`").cast("double")
    return x if f.condition is None else F.when(F.expr(f.condition), x)


class Plan:
    """The stages that a list of metrics needs."""

    def __init__(self, metrics: list[Metric], attributes: list[str]):
        self.first: dict[str, Column] = {}
        self.levels: list[list[tuple[str, Node, list[str]]]] = []
        self.names: dict[tuple, str] = {}
        self.level: dict[str, int] = {}
        self.arrays: dict[tuple[str, str], str] = {}
        self.outputs: list[tuple[str, str, Metric]] = []
        taken: set[str] = set()
        for m in metrics:
            for attr in m.attributes or attributes:
                name = m.column_name(attr)
                if m.hidden or name in taken:
                    continue
                taken.add(name)
                self.outputs.append((name, self._place(Node(m, attr)), m))

    def _array(self, attr: str, f: Filter) -> str:
        key = (attr, f.name)
        if key not in self.arrays:
            self.arrays[key] = f"_a{len(self.arrays)}"
            self.first[self.arrays[key]] = F.sort_array(F.collect_list(_values(attr, f)))
        return self.arrays[key]

    def _place(self, node: Node) -> str:
        """Put a node and what it needs into their stages; its working column."""
        if node.key in self.names:
            return self.names[node.key]
        m = node.metric
        deps = [self._place(Node(d, a)) for d, a in node.needs()]
        name = self.names[node.key] = f"_m{len(self.names)}"
        if m.aggregate is not None:
            self.first[name] = m.aggregate(_values(node.attr, m.filter))
            self.level[name] = 0
            return name
        args = deps if m.project is not None else [self._array(node.attr, m.filter), *deps]
        at = self.level[name] = 1 + max((self.level.get(a, 0) for a in args), default=0)
        while len(self.levels) < at:
            self.levels.append([])
        self.levels[at - 1].append((name, node, args))
        return name

    def _expression(self, node: Node, args: list[str]) -> Column:
        m, columns = node.metric, [F.col(a) for a in args]
        if m.method is not None:
            made = _python(m)(*columns)
            if m.nan_policy == "raise":
                for d in columns[1:]:
                    made = F.when(d.isNull(), F.raise_error(F.lit(f"{m.name}: a dependency has no value")).cast(KINDS[m.dtype])).otherwise(made)
            return made
        made = (m.project or m.array)(*columns)
        if m.deps and m.nan_policy == "raise":
            for d in columns[-len(m.deps) :]:
                made = F.when(d.isNull(), F.raise_error(F.lit(f"{m.name}: a dependency has no value")).cast("double")).otherwise(made)
        return made

    def run(self, points: DataFrame, keys: tuple[str, ...] = KEYS, extra: list[Column] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
        """Cells with one column per metric and attribute; ``extra`` aggregates ride along in stage 1."""
        extra = extra or []
        first = [c.alias(n) for n, c in self.first.items()] + extra or [F.count("*").alias("_n")]
        if self.arrays:
            # collected values gain nothing from partial aggregation, and the work on them follows the shuffle: a count of
            # partitions given here is kept, where small shuffled bytes would have them coalesced to few tasks
            points = points.repartition(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
        cells = points.groupBy(*keys).agg(*first)
        for level in self.levels:
            cells = cells.withColumns({name: self._expression(node, args) for name, node, args in level})
        out = [F.col(work).cast(KINDS[m.dtype]).alias(name) if m.dtype != "float32" else F.col(work).cast("double").alias(name) for name, work, m in self.outputs]
        return cells.select(*keys, *keep, *out)


def _python(m: Metric):
    """A metric's Python method over value arrays, a batch of cells at a time; a null dependency gives null."""
    method, arity = m.method, len(m.deps)

    def each(arrays: pd.Series, *deps: pd.Series) -> pd.Series:
        out = []
        for k, values in enumerate(arrays):
            own = [d.iloc[k] for d in deps]
            out.append(None if values is None or any(pd.isna(v) for v in own) else method(pd.Series(values), *own))
        return pd.Series(out, dtype="float64")

    if arity == 0:

        def run(a: pd.Series) -> pd.Series:
            return each(a)
    elif arity == 1:

        def run(a: pd.Series, b: pd.Series) -> pd.Series:
            return each(a, b)
    elif arity == 2:

        def run(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
            return each(a, b, c)
    elif arity == 3:

        def run(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
            return each(a, b, c, d)
    else:
        raise ValueError(f"{m.name}: three dependencies at most for Python methods")
    return F.pandas_udf(run, "double")


def evaluate(points: DataFrame, metrics: list[Metric], attributes: list[str], keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Metrics of a DataFrame of points that has the key columns."""
    return Plan(metrics, attributes).run(points, keys)
