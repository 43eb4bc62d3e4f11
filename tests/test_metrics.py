import numpy as np
import pytest
from pyspark.sql import functions as F

from celltide.operators import metrics as m
from celltide.plans.planner import evaluate

#: The golden cell: values, and 39 + 36 published metrics.
Z = [426.15, 436.91, 439.67, 446.13, 463.78, 492.72, 495.87, 504.49, 506.04]
INTENSITY = [256, 256, 256, 768, 768, 1280, 1280, 2304, 34816]
GOLDEN = {
    "p01": (427.0108, 256.0), "p05": (430.454, 256.0), "p10": (434.758, 256.0), "p20": (438.566, 256.0), "p25": (439.67, 256.0), "p30": (442.254, 460.8),
    "p40": (449.66, 768.0), "p50": (463.78, 768.0), "p60": (486.932, 1177.6), "p70": (494.61, 1280.0), "p75": (495.87, 1280.0), "p80": (499.318, 1689.6),
    "p90": (504.8, 8806.4), "p95": (505.42, 21811.2), "p99": (505.916, 32215.04), "90m10": (70.042, 8550.4), "95m05": (74.966, 21555.2),
    "profile_area": (91.54590445844767, None), "l1": (467.97333333333336, 4664.888888888889), "l2": (18.924722222222215, 4081.7777777777774),
    "l3": (-0.11607142857133113, 3720.126984126986), "l4": (-4.004047619047924, 3584.0), "lcv": (0.04043974490474289, 0.875),
    "lskewness": (-0.006133322709225032, 0.9113987058237935), "lkurtosis": (-0.21157761641257808, 0.8780487804878054), "mode": (426.15, 256.0),
    "median": (463.78, 768.0), "min": (426.15, 256), "max": (506.04, 34816), "stddev": (30.15345088045479, 10678.455115526824),
    "cv": (0.06443412205920876, 2.2891124247270724), "iq": (56.2, 1024.0), "canopy_relief_ratio": (0.5235114949722535, 0.12757201646090535),
    "sqmean": (468.94378267667776, None), "cumean": (469.9089746444765, None), "mean": (467.97333333333336, 4664.888888888889),
    "variance": (1022.884425, 128283079.11111109), "skewness": (0.02015072291754884, 2.765953121631933), "kurtosis": (1.4695555683267847, 7.963074785069492),
    "aad": (28.272592592592602, 6700.246913580247), "mad_median": (28.94, 512.0), "mad_mean": (28.30333333333334, 3896.888888888889), "mad_mode": (37.63, 512.0),
}


def cell(spark, **columns):
    n = len(next(iter(columns.values())))
    rows = [tuple(float(columns[c][i]) if columns[c][i] is not None else None for c in columns) + (0, 0) for i in range(n)]
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns) + ", xi int, yi int")


def test_golden_cell(spark):
    chosen = list((m.all_metrics | m.aad).values())
    row = evaluate(cell(spark, Z=Z, Intensity=INTENSITY), chosen, ["Z", "Intensity"]).first().asDict()
    for name, values in GOLDEN.items():
        for attr, want in zip(("Z", "Intensity"), values):
            if want is not None:
                assert row[f"m_{attr}_{name}"] == pytest.approx(want, rel=1e-9), (name, attr)


def random_points(rng, n=4000, cells=60):
    z = np.round(rng.gamma(2, 3, n), 2)
    z[rng.random(n) < 0.05] = 2.0
    return [(float(a), float(b), int(r), int(c), 0) for a, b, r, c in zip(z, np.round(rng.random(n) * 100, 3), rng.integers(1, 8, n), rng.integers(0, cells, n))]


def l_moments(x):
    x, n = np.sort(x), len(x)
    i = np.arange(n)
    b = [x.mean()] + [np.nan] * 3
    w, d = np.ones(n), float(n)
    for k in range(1, 4):
        w, d = w * (i - k + 1), d * (n - k)
        b[k] = (w * x).sum() / d if n > k else np.nan
    return b[0], 2 * b[1] - b[0], 6 * (b[2] - b[1]) + b[0], 20 * b[3] - 30 * b[2] + 12 * b[1] - b[0]


def hist_mode(x):
    if x.min() == x.max():
        return x.min()
    c, e = np.histogram(x, 64)
    return e[c.argmax()]


def test_default_set_on_random_cells(spark):
    """Every family against numpy, with the points that each metric and its dependencies see."""
    rng = np.random.default_rng(3)
    rows = random_points(rng) + [(1.0, 5.0, 1, 900, 0), (1.5, 6.0, 2, 900, 0), (7.0, 0.0, 1, 901, 0), (0.0, 0.0, 1, 902, 0)]
    pts = spark.createDataFrame(rows, "Z double, Intensity double, ReturnNumber int, xi int, yi int")
    out = {r["xi"]: r.asDict() for r in evaluate(pts, list(m.grid_metrics().values()), ["Z", "Intensity", "ReturnNumber"]).collect()}
    assert len(next(iter(out.values()))) == 2 + 104
    data = np.array([r[:4] for r in rows])
    for c in np.unique(data[:, 3]):
        own = data[data[:, 3] == c]
        z, intensity, rn = own[:, 0], own[:, 1], own[:, 2]
        h = z > 2
        got = out[int(c)]

        def same(name, want):
            if want is None or (isinstance(want, float) and np.isnan(want)):
                assert got[name] is None, (c, name, got[name])
            else:
                assert got[name] == pytest.approx(want, rel=1e-6, abs=1e-9), (c, name)

        for attr, x in (("Z", z[h]), ("Intensity", intensity[h])):
            some = len(x) > 0
            mean = x.mean() if some and x.any() else None
            same(f"m_{attr}_mean", mean)
            for p in m.PERCENTS:
                same(f"m_{attr}_p{p:02d}", np.percentile(x, p) if some else None)
            for k, v in enumerate(l_moments(x) if some else [None] * 4):
                same(f"m_{attr}_l{k + 1}", v)
            same(f"m_{attr}_mode", hist_mode(x) if some else None)
            same(f"m_{attr}_median", np.median(x) if some else None)
            same(f"m_{attr}_variance", x.var(ddof=1) if len(x) > 1 else None)
            same(f"m_{attr}_stddev", x.std() if some else None)
            same(f"m_{attr}_aad", np.abs(x - mean).mean() if mean is not None else None)
        x = z[h]
        mean, mode = (x.mean(), hist_mode(x)) if len(x) else (None, None)
        same("m_Z_mad_mode", np.median(np.abs(x - mode)) if len(x) else None)
        first = rn == 1
        plain = {"all_count": len(z), "all_count_above_minht": h.sum(), "all_count_above_htbreak": (z > 3).sum(), "1st_count": first.sum(), "1st_count_above_htbreak": (first & (z > 3)).sum()}
        plain |= {f"r{k}_count": ((rn == k) & h).sum() for k in range(1, 8)}
        for name, want in plain.items():
            same(f"m_ReturnNumber_{name}", int(want))
        above = (lambda limit, f: None if limit is None else int((z[f] > limit).sum()))
        every = np.ones(len(z), bool)
        same("m_Z_all_count_above_mean", above(mean, every))
        same("m_Z_all_count_above_mode", above(mean, every))
        same("m_Z_1st_count_above_mean", above(mean, first))
        same("m_Z_1st_count_above_mode", above(mode, first))
        share = lambda a, b: None if a is None or not b else 100 * a / b
        same("m_ReturnNumber_all_cover_above_htbreak", share((z > 3).sum(), len(z)))
        same("m_Z_all_cover_above_mean", share(above(mean, every), len(z)))
        same("m_Z_all_cover_above_mode", share(above(mean, every), h.sum()))
        same("m_Z_1st_cover_above_mode", share(above(mode, first), first.sum()))
        same("m_ReturnNumber_all_1st_cover_above_htbreak", share((z > 3).sum(), first.sum()))
        same("m_Z_all_1st_cover_above_mean", share(above(mean, every), first.sum()))


def test_one_shuffle_and_no_python(spark):
    pts = cell(spark, Z=Z, Intensity=INTENSITY, ReturnNumber=[1] * 9)
    plan = evaluate(pts, list(m.grid_metrics().values()), ["Z", "Intensity", "ReturnNumber"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Python" not in plan


def test_user_metrics_filters_and_policies(spark):
    pts = cell(spark, Z=Z, NumberOfReturns=[1] * 9)
    over = m.Metric("over500", "uint8", method=lambda s: float((s >= 500).sum()))
    some = m.mean.where(m.Filter("few", "NumberOfReturns >= 1"))
    crr = m.Metric("crr_alone", aggregate=lambda x: F.try_divide(F.avg(x) - F.min(x), F.max(x) - F.min(x)))
    row = evaluate(pts, [over, some, crr, m.crr], ["Z"]).first()
    assert row.m_Z_over500 == 2 and row.m_Z_mean == pytest.approx(np.mean(Z)) and row.m_Z_crr_alone == pytest.approx(row.m_Z_canopy_relief_ratio)
    none = m.mean.where(m.Filter("none", "Z < 0"))
    kept = m.Metric("kept", method=lambda s, d: 1.0, deps=(none,))
    assert evaluate(pts, [kept], ["Z"]).first().m_Z_kept is None
    strict = m.Metric("strict", project=lambda d: d + 1, deps=(none,), nan_policy="raise")
    with pytest.raises(Exception, match="a dependency has no value"):
        evaluate(pts, [strict], ["Z"]).collect()


def test_names():
    r = m.Registry()
    assert len(r.resolve("grid_metrics_Z_2_3")) == 68 and len(r.resolve("all")) == 39
    assert [x.name for x in r.resolve("mean,stats")][:2] == ["mean", "mode"]
    for bad in ("nope", "grid_metrics_Q"):
        with pytest.raises(ValueError):
            r.resolve(bad)
    with pytest.raises(ValueError):
        m.Metric("x", "datetime64", aggregate=F.min)
    assert m.mean.nodata == -9999.0 and m.counts()["all_count"].nodata == -9999 and m.Metric("u", "uint8", aggregate=F.min).nodata == 0
