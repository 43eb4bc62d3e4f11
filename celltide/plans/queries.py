"""Registered queries of the gridded engine over the driver's tables, and their SQL for DuckDB.

``lineitem`` is a cloud of points: X = l_partkey, Y = 20 * l_suppkey, Z = l_quantity, Intensity = l_extendedprice / 1000,
ReturnNumber = l_linenumber.  The grid has 20 columns over the cloud's extent.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import CENTER, CORNER, Bounds, Grid
from ..operators import metrics as m
from ..operators import points as p
from ..operators import tiling
from ..store import latest_wins, overlaps
from .planner import evaluate

ATTRS = ["Z", "Intensity", "ReturnNumber"]
DIGITS = 4
#: Added before rounding on both sides: interpolated prices often lie halfway between two rounded values.
OFF_TIES = 3.14159e-6


def cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.col("l_partkey").cast("double").alias("X"),
        (F.col("l_suppkey") * 20).cast("double").alias("Y"),
        F.col("l_quantity").alias("Z"),
        (F.col("l_extendedprice") / 1000).alias("Intensity"),
        F.col("l_linenumber").alias("ReturnNumber"),
        F.col("l_shipdate").alias("shipped"),
    )


def event_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        (F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")).cast("double").alias("X"), F.col("user_id").cast("double").alias("Y"), F.col("value").alias("Z")
    )


def grid_of(points: DataFrame, alignment: str = CORNER) -> Grid:
    x, y = points.agg(F.max("X"), F.max("Y")).first()
    if x is None:
        return Grid(Bounds(0, 0, 20, 20), 1, alignment)
    res = math.ceil((x + 1) / 20)
    return Grid(Bounds(0, 0, 20 * res, math.ceil((y + 1) / res) * res), res, alignment)


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(F.col(f"`{c}`") + OFF_TIES, DIGITS).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes])


def _family(chosen: Callable[[], list[m.Metric]]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        pts = cloud(spark, sf_dir)
        return _rounded(evaluate(p.binned(pts, grid_of(pts), ATTRS), chosen(), ATTRS))

    return query


def _of_default(names) -> Callable[[], list[m.Metric]]:
    return lambda: [x for x in m.grid_metrics().values() if x.name in names]


def _cells(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Grid]:
    """Mean height per cell and year of shipping, as versions of cells."""
    pts = cloud(spark, sf_dir)
    grid = grid_of(pts)
    rows = pts.select("Z", F.year("shipped").alias("time_slot"), F.to_date("shipped").alias("day"), grid.xi(F.col("X")).alias("X"), grid.yi(F.col("Y")).alias("Y"))
    cells = rows.groupBy("X", "Y", "time_slot").agg(F.round(F.avg("Z") + OFF_TIES, DIGITS).alias("m_Z_mean"), F.count("*").alias("count"), F.min("day").alias("start_date"), F.max("day").alias("end_date"))
    return cells, grid


def bounds_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts = cloud(spark, sf_dir)
    grid = grid_of(pts)
    return p.cell_counts(pts, grid, Bounds(5 * grid.res, 4 * grid.res, 12 * grid.res, 9 * grid.res))


def _aligned(alignment: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        pts = cloud(spark, sf_dir)
        return p.cell_counts(pts, grid_of(pts, alignment))

    return query


def closed_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts = cloud(spark, sf_dir)
    res = grid_of(pts).res
    box = Bounds(2 * res, 2 * res, 7 * res, 7 * res)
    return pts.select(box.holds(F.col("X"), F.col("Y")).alias("half_open"), box.holds_closed(F.col("X"), F.col("Y")).alias("closed")).agg(F.count_if("half_open").alias("half_open"), F.count_if("closed").alias("closed"))


def collect_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts = cloud(spark, sf_dir)
    cells = p.raw_values(p.binned(pts, grid_of(pts)), ["Z", "ReturnNumber"])
    text = lambda c: F.array_join(F.transform(c, lambda v: v.cast("int").cast("string")), ",")
    return cells.select("xi", "yi", text("Z").alias("z_values"), text("ReturnNumber").alias("rn_values"), "count")


def _days(cells: DataFrame) -> DataFrame:
    return cells.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("start_date", "end_date")})


def latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, _ = _cells(spark, sf_dir)
    return _days(latest_wins(cells, ["X", "Y"], "time_slot"))


def as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, _ = _cells(spark, sf_dir)
    return _days(latest_wins(cells.where("time_slot <= 1997"), ["X", "Y"], "time_slot"))


def date_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, _ = _cells(spark, sf_dir)
    return _days(cells.where(overlaps("start_date", "end_date", "1996-03-01", "1997-06-30")))


def densify(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, grid = _cells(spark, sf_dir)
    some = cells.where("time_slot = 1998 AND count > 2").select("X", "Y", "m_Z_mean")
    return p.densified(some, grid.extents()).select("X", "Y", F.coalesce("m_Z_mean", F.lit(-9999.0)).alias("m_Z_mean"))


def raster_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, grid = _cells(spark, sf_dir)
    rows = p.pivoted(latest_wins(cells, ["X", "Y"], "time_slot"), "count", grid.extents())
    return rows.select("Y", F.array_join(F.transform("values", lambda v: F.coalesce(v, F.lit(-9999)).cast("string")), ",").alias("row"))


def leaf_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts = cloud(spark, sf_dir)
    grid = grid_of(pts)
    tiles = p.in_leaves(p.cell_counts(pts, grid), grid.extents(), 9)
    return tiles.groupBy("tx", "ty").agg(F.count("*").alias("cells"), F.sum("n").alias("points"))


def resume_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts = cloud(spark, sf_dir)
    done = spark.sql("SELECT * FROM VALUES (0, 4, 0, 4), (10, 13, 5, 20) AS r(x1, x2, y1, y2)")
    inside = (F.col("xi") >= F.col("x1")) & (F.col("xi") < F.col("x2")) & (F.col("yi") >= F.col("y1")) & (F.col("yi") < F.col("y2"))
    return p.cell_counts(pts, grid_of(pts)).join(F.broadcast(done), inside, "left_anti")


def history_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of what each year shipped on a line number, and which overlap a box by more than an edge."""
    pts = cloud(spark, sf_dir)
    res = grid_of(pts).res
    q = Bounds(3 * res, 3 * res, 4 * res, 4 * res)
    boxes = pts.groupBy(F.year("shipped").alias("time_slot"), "ReturnNumber").agg(F.min("X").alias("minx"), F.min("Y").alias("miny"), F.max("X").alias("maxx"), F.max("Y").alias("maxy"))
    apart = (F.lit(q.minx) >= F.col("maxx")) | (F.lit(q.maxx) <= F.col("minx")) | (F.lit(q.miny) >= F.col("maxy")) | (F.lit(q.maxy) <= F.col("miny"))
    return boxes.where(~apart)


def index_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts = cloud(spark, sf_dir)
    return p.dense_cells(pts, grid_of(pts).extents())


def user_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's Python method with a dependency, a user's filter, and a user's expression."""
    over = m.Metric("above_mean", "int32", method=lambda s, mean: float((s > mean).sum()), deps=(m.mean,), attributes=("Z",))
    cheap = m.Metric("value_range", aggregate=lambda x: F.max(x) - F.min(x), filter=m.Filter("cheap", "Intensity < 30"), attributes=("Z",))
    pts = cloud(spark, sf_dir)
    return _rounded(evaluate(p.binned(pts, grid_of(pts), ATTRS), [over, cheap], ATTRS))


def quadtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts = cloud(spark, sf_dir)
    tiles = tiling.quadtree(pts, grid_of(pts).extents(), 2000)
    return spark.createDataFrame([(t.x1, t.x2, t.y1, t.y2, t.cell_count) for t in tiles], "x1 int, x2 int, y1 int, y2 int, cells int")


def scan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts = cloud(spark, sf_dir)
    s = tiling.scan(pts, grid_of(pts), None, 2000, 100, 6)
    t = s["tile_info"]
    return spark.createDataFrame([(s["pc_info"]["count"], t["num_cells"], t["num_tiles"], t["mean"], t["std_dev"], t["median"], t["recommended"])], "count long, num_cells long, num_tiles long, mean double, std_dev double, median double, recommended double")


def events_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts = event_cloud(spark, sf_dir)
    grid = Grid(Bounds(0, 0, 86_400, 86_400), 3600, CORNER)
    return _rounded(evaluate(p.binned(p.within(pts, grid.root), grid, ["Z"]), [m.mean, m.variance, m.minimum, m.maximum, m.median], ["Z"]))


_STATS = {"min", "max", "stddev", "cv", "canopy_relief_ratio", "sqmean", "cumean", "mean", "variance", "skewness", "kurtosis", "median"}
_PERCENT = set(m.percentiles) - {"profile_area"}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "cell_basic": _family(lambda: [x.on("Z") for x in (m.mean, m.minimum, m.maximum)] + [m.counts()["all_count"]]),
    "cell_moments": _family(_of_default(_STATS)),
    "cell_percentiles": _family(_of_default(_PERCENT)),
    "profile_area": _family(_of_default({"profile_area"})),
    "cell_lmoments": _family(_of_default(set(m.l_moments))),
    "cell_mode": _family(_of_default({"mode"})),
    "cell_deviations": _family(_of_default(set(m.aad))),
    "cell_counts": _family(_of_default(set(m.counts()))),
    "cell_covers": _family(_of_default({x.name for x in m.covers().values()})),
    "grid_metrics": _family(lambda: list(m.grid_metrics().values())),
    "collect_values": collect_values,
    "bounds_filter": bounds_filter,
    "align_corner": _aligned(CORNER),
    "align_center": _aligned(CENTER),
    "closed_count": closed_count,
    "source_bounds": lambda spark, sf_dir: p.source_bounds(cloud(spark, sf_dir)),
    "extract_date_overlap": date_overlap,
    "latest_wins": latest,
    "as_of": as_of,
    "densify": densify,
    "raster_pivot": raster_pivot,
    "leaf_tiles": leaf_tiles,
    "scan_histogram": lambda spark, sf_dir: p.cell_counts(pts := cloud(spark, sf_dir), grid_of(pts)),
    "resume_anti_join": resume_anti_join,
    "history_bounds": history_bounds,
    "index_cells": index_cells,
    "user_metric": user_metric,
    "quadtree": quadtree,
    "scan_summary": scan_summary,
    "events_moments": events_moments,
}

# ---------------------------------------------------------------- SQL

_PTS = """src AS (
  SELECT l_partkey::DOUBLE AS X, (l_suppkey * 20)::DOUBLE AS Y, l_quantity AS Z, l_extendedprice / 1000 AS I, l_linenumber AS R, l_shipdate AS shipped FROM lineitem
), g AS (
  SELECT ceil((max(X) + 1) / 20) AS res, 20 * ceil((max(X) + 1) / 20) AS maxx, ceil((max(Y) + 1) / ceil((max(X) + 1) / 20)) * ceil((max(X) + 1) / 20) AS maxy FROM src
), pts AS (
  SELECT src.*, res, floor(X / res)::INT AS xi, ceil((maxy - Y) / res - 1)::INT AS yi FROM src, g
)"""


def _r(expression: str, name: str) -> str:
    return f'round(({expression}) + {OFF_TIES}, {DIGITS}) AS "{name}"'


def _per_attr(make: Callable[[str, str], list[str]], attrs=(("Z", "Z"), ("Intensity", "I"))) -> str:
    return ", ".join(x for name, col in attrs for x in make(name, col))


def _moments_sql() -> str:
    means = ", ".join(f"avg({c}) FILTER (Z > 2) AS m_{c}, stddev_pop({c}) FILTER (Z > 2) AS s_{c}" for c in "ZI")

    def one(name: str, c: str) -> list[str]:
        f = "FILTER (Z > 2)"
        avg, sd, n = f"avg({c}) {f}", f"stddev_pop({c}) {f}", f"(count({c}) {f})"
        out = [
            _r(f"min({c}) {f}", f"m_{name}_min"), _r(f"max({c}) {f}", f"m_{name}_max"), _r(sd, f"m_{name}_stddev"), _r(avg, f"m_{name}_mean"),
            _r(f"{sd} / nullif({avg}, 0)", f"m_{name}_cv"), _r(f"var_samp({c}) {f}", f"m_{name}_variance"), _r(f"median({c}) {f}", f"m_{name}_median"),
            _r(f"(sum(power({c} - m_{c}, 3)) {f}) / nullif(({n} - 1) * power(any_value(s_{c}), 3), 0)", f"m_{name}_skewness"),
            _r(f"(sum(power({c} - m_{c}, 4)) {f}) / nullif(({n} - 1) * power(any_value(s_{c}), 4), 0)", f"m_{name}_kurtosis"),
        ]
        if name == "Z":
            out += [
                _r(f"({avg} - min({c}) {f}) / nullif(max({c}) {f} - min({c}) {f}, 0)", "m_Z_canopy_relief_ratio"),
                _r(f"sqrt(avg({c} * {c}) {f})", "m_Z_sqmean"), _r(f"cbrt(avg(power(abs({c}), 3)) {f})", "m_Z_cumean"),
            ]
        return out

    return f"WITH {_PTS}, mm AS (SELECT xi, yi, {means} FROM pts GROUP BY xi, yi) SELECT xi, yi, {_per_attr(one)} FROM pts JOIN mm USING (xi, yi) GROUP BY xi, yi"


def _percentiles_sql() -> str:
    def one(name: str, c: str) -> list[str]:
        q = lambda k: f"quantile_cont({c}, {k / 100}) FILTER (Z > 2)"
        out = [_r(q(k), f"m_{name}_p{k:02d}") for k in m.PERCENTS]
        return out + [_r(f"{q(a)} - {q(b)}", f"m_{name}_{label}") for label, a, b in (("90m10", 90, 10), ("95m05", 95, 5), ("iq", 75, 25))]

    return f"WITH {_PTS} SELECT xi, yi, {_per_attr(one)} FROM pts GROUP BY xi, yi"


def _profile_sql() -> str:
    shares = ", ".join(str(k / 100) for k in range(100))
    area = f"CASE WHEN q[100] > 0 THEN 0.5 * (q[1] / q[100] + list_sum(list_transform(q[2:99], lambda v: 2 * v / q[100])) + 1) ELSE -9999 END"
    return f"WITH {_PTS}, a AS (SELECT xi, yi, quantile_cont(Z, [{shares}]) AS q FROM pts GROUP BY xi, yi) SELECT xi, yi, {_r(area, 'm_Z_profile_area')} FROM a"


def _lmoments_sql() -> str:
    parts, outs = [], []
    for name, c in (("Z", "Z"), ("Intensity", "I")):
        parts.append(
            f"r{c} AS (SELECT xi, yi, {c} AS x, (row_number() OVER (PARTITION BY xi, yi ORDER BY {c}) - 1)::DOUBLE AS i, (count(*) OVER (PARTITION BY xi, yi))::DOUBLE AS n FROM pts WHERE Z > 2), "
            f"b{c} AS (SELECT xi, yi, avg(x) AS b0, sum(i * x) / nullif(any_value(n) * (any_value(n) - 1), 0) AS b1, "
            f"sum(i * (i - 1) * x) / nullif(any_value(n) * (any_value(n) - 1) * (any_value(n) - 2), 0) AS b2, "
            f"sum(i * (i - 1) * (i - 2) * x) / nullif(any_value(n) * (any_value(n) - 1) * (any_value(n) - 2) * (any_value(n) - 3), 0) AS b3 FROM r{c} GROUP BY xi, yi), "
            f"l{c} AS (SELECT xi, yi, b0 AS l1, 2 * b1 - b0 AS l2, 6 * (b2 - b1) + b0 AS l3, 20 * b3 - 30 * b2 + 12 * b1 - b0 AS l4 FROM b{c})"
        )
        outs += [_r(f"l{c}.l{k}", f"m_{name}_l{k}") for k in range(1, 5)]
        outs += [_r(f"l{c}.{a} / nullif(l{c}.{b}, 0)", f"m_{name}_{label}") for label, a, b in (("lcv", "l2", "l1"), ("lskewness", "l3", "l2"), ("lkurtosis", "l4", "l2"))]
    return f"WITH {_PTS}, {', '.join(parts)}, cells AS (SELECT DISTINCT xi, yi FROM pts) SELECT cells.xi, cells.yi, {', '.join(outs)} FROM cells LEFT JOIN lZ USING (xi, yi) LEFT JOIN lI USING (xi, yi)"


def _mode_ctes(c: str) -> str:
    return f"""e{c} AS (SELECT xi, yi, min({c}) AS lo, max({c}) AS hi, (max({c}) - min({c})) / 64 AS step FROM pts WHERE Z > 2 GROUP BY xi, yi),
k{c} AS (SELECT xi, yi, {c} AS v, lo, hi, step, least(63, floor(({c} - lo) * (64 / nullif(hi - lo, 0))))::INT AS k FROM pts JOIN e{c} USING (xi, yi) WHERE Z > 2),
f{c} AS (SELECT xi, yi, lo, hi, step, CASE WHEN v < lo + k * step THEN k - 1 WHEN v >= (CASE WHEN k = 63 THEN hi ELSE lo + (k + 1) * step END) AND k < 63 THEN k + 1 ELSE k END AS k FROM k{c}),
h{c} AS (SELECT xi, yi, lo, hi, step, k, count(*) AS n FROM f{c} GROUP BY xi, yi, lo, hi, step, k),
n{c} AS (SELECT *, row_number() OVER (PARTITION BY xi, yi ORDER BY n DESC, k) AS r FROM h{c}),
o{c} AS (SELECT xi, yi, CASE WHEN lo = hi THEN lo ELSE lo + k * step END AS mode FROM n{c} WHERE r = 1)"""


def _mode_sql() -> str:
    return f"WITH {_PTS}, {_mode_ctes('Z')}, {_mode_ctes('I')}, cells AS (SELECT DISTINCT xi, yi FROM pts) SELECT xi, yi, {_r('oZ.mode', 'm_Z_mode')}, {_r('oI.mode', 'm_Intensity_mode')} FROM cells LEFT JOIN oZ USING (xi, yi) LEFT JOIN oI USING (xi, yi)"


def _deviations_sql() -> str:
    return f"""WITH {_PTS}, {_mode_ctes('Z')}, c AS (SELECT xi, yi, avg(Z) FILTER (Z > 2) AS mz, avg(I) FILTER (Z > 2) AS mi, median(Z) FILTER (Z > 2) AS dz FROM pts GROUP BY xi, yi)
SELECT xi, yi, {_r('avg(abs(Z - mz)) FILTER (Z > 2)', 'm_Z_aad')}, {_r('avg(abs(I - mi)) FILTER (Z > 2)', 'm_Intensity_aad')}, {_r('median(abs(Z - dz)) FILTER (Z > 2)', 'm_Z_mad_median')},
{_r('median(abs(Z - mz)) FILTER (Z > 2)', 'm_Z_mad_mean')}, {_r('median(abs(Z - mode)) FILTER (Z > 2)', 'm_Z_mad_mode')} FROM pts JOIN c USING (xi, yi) LEFT JOIN oZ USING (xi, yi) GROUP BY xi, yi"""


_COUNTS_BASE = f"""WITH {_PTS}, {_mode_ctes('Z')}, c AS (SELECT xi, yi, avg(Z) FILTER (Z > 2) AS mz FROM pts GROUP BY xi, yi), j AS (SELECT * FROM pts JOIN c USING (xi, yi) LEFT JOIN (SELECT xi, yi, mode FROM oZ) USING (xi, yi))"""
_OVER = {
    "all_count_above_mean": "CASE WHEN any_value(mz) IS NOT NULL THEN count(*) FILTER (Z > mz) END",
    "all_count_above_mode": "CASE WHEN any_value(mz) IS NOT NULL THEN count(*) FILTER (Z > mz) END",
    "1st_count_above_mean": "CASE WHEN any_value(mz) IS NOT NULL THEN count(*) FILTER (R = 1 AND Z > mz) END",
    "1st_count_above_mode": "CASE WHEN any_value(mode) IS NOT NULL THEN count(*) FILTER (R = 1 AND Z > mode) END",
}
_PLAIN = {"all_count": "TRUE", "all_count_above_minht": "Z > 2", "all_count_above_htbreak": "Z > 3", "1st_count_above_htbreak": "R = 1 AND Z > 3", "1st_count": "R = 1"} | {f"r{k}_count": f"R = {k} AND Z > 2" for k in range(1, 8)}


def _counts_sql() -> str:
    plain = [f'(count(*) FILTER ({c}))::INT AS "m_ReturnNumber_{n}"' for n, c in _PLAIN.items()]
    over = [f'({e})::INT AS "m_Z_{n}"' for n, e in _OVER.items()]
    return f"{_COUNTS_BASE} SELECT xi, yi, {', '.join(plain + over)} FROM j GROUP BY xi, yi"


def _covers_sql() -> str:
    n = lambda c: f"count(*) FILTER ({c})"
    rows = [
        ("ReturnNumber", "all_cover_above_htbreak", n("Z > 3"), n("TRUE")),
        ("Z", "all_cover_above_mean", _OVER["all_count_above_mean"], n("TRUE")),
        ("Z", "all_cover_above_mode", _OVER["all_count_above_mode"], n("Z > 2")),
        ("ReturnNumber", "1st_cover_above_htbreak", n("R = 1 AND Z > 3"), n("R = 1")),
        ("Z", "1st_cover_above_mean", _OVER["1st_count_above_mean"], n("R = 1")),
        ("Z", "1st_cover_above_mode", _OVER["1st_count_above_mode"], n("R = 1")),
        ("ReturnNumber", "all_1st_cover_above_htbreak", n("Z > 3"), n("R = 1")),
        ("Z", "all_1st_cover_above_mean", _OVER["all_count_above_mean"], n("R = 1")),
        ("Z", "all_1st_cover_above_mode", _OVER["all_count_above_mode"], n("R = 1")),
    ]
    outs = [_r(f"100 * (({a})::DOUBLE / nullif({b}, 0))", f"m_{attr}_{name}") for attr, name, a, b in rows]
    return f"{_COUNTS_BASE} SELECT xi, yi, {', '.join(outs)} FROM j GROUP BY xi, yi"


_VERSIONS = f"""{_PTS}, v AS (
  SELECT xi AS X, yi AS Y, year(shipped)::INT AS time_slot, round(avg(Z) + {OFF_TIES}, {DIGITS}) AS m_Z_mean, count(*) AS count, strftime(min(shipped), '%Y-%m-%d') AS start_date, strftime(max(shipped), '%Y-%m-%d') AS end_date FROM pts GROUP BY 1, 2, 3
)"""
_LAST = "SELECT X, Y, time_slot, m_Z_mean, count, start_date, end_date FROM (SELECT *, row_number() OVER (PARTITION BY X, Y ORDER BY time_slot DESC) AS r FROM v{0}) WHERE r = 1"
_ALL = "dense AS (SELECT x.i::INT AS X, y.i::INT AS Y FROM g, LATERAL (SELECT unnest(range(0, (maxx / res)::BIGINT)) AS i) x, LATERAL (SELECT unnest(range(0, (maxy / res)::BIGINT)) AS i) y)"

ORACLE_SQL: dict[str, str] = {
    "cell_basic": f"WITH {_PTS} SELECT xi, yi, {_r('avg(Z)', 'm_Z_mean')}, {_r('min(Z)', 'm_Z_min')}, {_r('max(Z)', 'm_Z_max')}, count(*)::INT AS \"m_ReturnNumber_all_count\" FROM pts GROUP BY xi, yi",
    "cell_moments": _moments_sql(),
    "cell_percentiles": _percentiles_sql(),
    "profile_area": _profile_sql(),
    "cell_lmoments": _lmoments_sql(),
    "cell_mode": _mode_sql(),
    "cell_deviations": _deviations_sql(),
    "cell_counts": _counts_sql(),
    "cell_covers": _covers_sql(),
    "collect_values": f"WITH {_PTS} SELECT xi, yi, string_agg(Z::INT::VARCHAR, ',' ORDER BY Z) AS z_values, string_agg(R::INT::VARCHAR, ',' ORDER BY R) AS rn_values, count(*) AS count FROM pts GROUP BY xi, yi",
    "bounds_filter": f"WITH {_PTS} SELECT xi, yi, count(*) AS n FROM pts WHERE X >= 5 * res AND X < 12 * res AND Y >= 4 * res AND Y < 9 * res GROUP BY xi, yi",
    "align_corner": f"WITH {_PTS} SELECT xi, yi, count(*) AS n FROM pts GROUP BY xi, yi",
    "align_center": f"WITH {_PTS} SELECT floor((X + g.res / 2) / g.res)::INT AS xi, ceil((maxy + g.res / 2 - Y) / g.res - 1)::INT AS yi, count(*) AS n FROM src, g GROUP BY 1, 2",
    "closed_count": f"WITH {_PTS} SELECT count(*) FILTER (X >= 2 * res AND X < 7 * res AND Y >= 2 * res AND Y < 7 * res) AS half_open, count(*) FILTER (X >= 2 * res AND X <= 7 * res AND Y >= 2 * res AND Y <= 7 * res) AS closed FROM pts",
    "source_bounds": f"WITH {_PTS} SELECT min(X) AS minx, min(Y) AS miny, max(X) AS maxx, max(Y) AS maxy FROM src",
    "extract_date_overlap": f"WITH {_VERSIONS} SELECT * FROM v WHERE end_date >= '1996-03-01' AND start_date <= '1997-06-30'",
    "latest_wins": f"WITH {_VERSIONS} {_LAST.format('')}",
    "as_of": f"WITH {_VERSIONS} {_LAST.format(' WHERE time_slot <= 1997')}",
    "densify": f"WITH {_VERSIONS}, {_ALL} SELECT dense.X, dense.Y, coalesce(m_Z_mean, -9999.0) AS m_Z_mean FROM dense LEFT JOIN (SELECT * FROM v WHERE time_slot = 1998 AND count > 2) w ON w.X = dense.X AND w.Y = dense.Y",
    "raster_pivot": f"WITH {_VERSIONS}, {_ALL}, l AS ({_LAST.format('')}) SELECT dense.Y, string_agg(coalesce(count, -9999)::VARCHAR, ',' ORDER BY dense.X) AS \"row\" FROM dense LEFT JOIN l ON l.X = dense.X AND l.Y = dense.Y GROUP BY dense.Y",
    "leaf_tiles": f"WITH {_PTS}, c AS (SELECT xi, yi, count(*) AS n FROM pts GROUP BY xi, yi) SELECT (xi // 3)::INT AS tx, (yi // 3)::INT AS ty, count(*) AS cells, sum(n)::BIGINT AS points FROM c GROUP BY 1, 2",
    "scan_histogram": f"WITH {_PTS} SELECT xi, yi, count(*) AS n FROM pts GROUP BY xi, yi",
    "resume_anti_join": f"WITH {_PTS} SELECT xi, yi, count(*) AS n FROM pts WHERE NOT (xi < 4 AND yi < 4) AND NOT (xi >= 10 AND xi < 13 AND yi >= 5 AND yi < 20) GROUP BY xi, yi",
    "history_bounds": f"WITH {_PTS}, b AS (SELECT year(shipped)::INT AS time_slot, R AS ReturnNumber, min(X) AS minx, min(Y) AS miny, max(X) AS maxx, max(Y) AS maxy FROM src GROUP BY 1, 2) SELECT b.time_slot, b.ReturnNumber, b.minx, b.miny, b.maxx, b.maxy FROM b, g WHERE NOT (3 * res >= b.maxx OR 4 * res <= minx OR 3 * res >= b.maxy OR 4 * res <= miny)",
    "index_cells": f"WITH {_PTS}, {_ALL} SELECT X, Y FROM dense",
    "user_metric": f"WITH {_PTS}, c AS (SELECT xi, yi, avg(Z) AS mz FROM pts GROUP BY xi, yi) SELECT xi, yi, (count(*) FILTER (Z > mz))::INT AS \"m_Z_above_mean\", {_r('max(Z) FILTER (I < 30) - min(Z) FILTER (I < 30)', 'm_Z_value_range')} FROM pts JOIN c USING (xi, yi) GROUP BY xi, yi",
    "events_moments": f"WITH e AS (SELECT (hour(ts) * 3600 + minute(ts) * 60 + second(ts))::DOUBLE AS X, user_id::DOUBLE AS Y, value AS Z FROM events), p AS (SELECT *, floor(X / 3600)::INT AS xi, ceil((86400 - Y) / 3600 - 1)::INT AS yi FROM e WHERE X < 86400 AND Y < 86400) SELECT xi, yi, {_r('CASE WHEN max(abs(Z)) <> 0 THEN avg(Z) END', 'm_Z_mean')}, {_r('var_samp(Z)', 'm_Z_variance')}, {_r('min(Z)', 'm_Z_min')}, {_r('max(Z)', 'm_Z_max')}, {_r('median(Z)', 'm_Z_median')} FROM p GROUP BY xi, yi",
}


def _whole_set_sql() -> str:
    """The default set: its families joined on the cell."""
    parts = [k for k in ("cell_moments", "cell_percentiles", "profile_area", "cell_lmoments", "cell_mode", "cell_deviations", "cell_counts", "cell_covers")]
    return "SELECT * FROM " + " JOIN ".join(f"({ORACLE_SQL[k]}) t{i}" + (" USING (xi, yi)" if i else "") for i, k in enumerate(parts))


ORACLE_SQL["grid_metrics"] = _whole_set_sql()
#: Boxes of cells: columns halve rounded down, rows rounded up from the top; empty quarters go.
ORACLE_SQL["quadtree"] = f"""WITH RECURSIVE {_PTS}, c AS (SELECT xi, yi, count(*) AS n FROM pts GROUP BY xi, yi), t AS (
  SELECT 0 AS x1, (maxx / res)::INT AS x2, 0 AS y1, (maxy / res)::INT AS y2, (SELECT count(*) FROM pts)::BIGINT AS n, 0::BIGINT AS before FROM g
  UNION ALL
  SELECT q.x1, q.x2, q.y1, q.y2, sum(c.n)::BIGINT, q.before FROM (
    SELECT CASE WHEN h.i = 0 THEN x1 ELSE x1 + (x2 - x1) // 2 END AS x1, CASE WHEN h.i = 0 THEN x1 + (x2 - x1) // 2 ELSE x2 END AS x2,
      CASE WHEN v.i = 0 THEN y1 ELSE y1 + (y2 - y1 + 1) // 2 END AS y1, CASE WHEN v.i = 0 THEN y1 + (y2 - y1 + 1) // 2 ELSE y2 END AS y2, n AS before
    FROM t, (VALUES (0), (1)) AS h(i), (VALUES (0), (1)) AS v(i) WHERE least(x2 - x1, y2 - y1) >= 2 AND n > 2000 AND n <> before
  ) q JOIN c ON c.xi >= q.x1 AND c.xi < q.x2 AND c.yi >= q.y1 AND c.yi < q.y2 GROUP BY ALL
)
SELECT x1, x2, y1, y2, ((x2 - x1) * (y2 - y1))::INT AS cells FROM t WHERE least(x2 - x1, y2 - y1) < 2 OR n <= 2000 OR n = before"""


