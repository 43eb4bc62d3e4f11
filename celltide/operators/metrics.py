"""Per-cell metrics as values: what each reads, on which points, and its expression."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import arrays

PERCENTS = [1, 5, 10, 20, 25, 30, 40, 50, 60, 70, 75, 80, 90, 95, 99]
KINDS = {"int32": "int", "float32": "float", "float64": "double", "uint8": "short", "uint16": "int", "uint32": "long", "object": "array<double>"}
NODATA = {"i": -9999, "f": -9999.0, "u": 0, "o": []}


@dataclass(frozen=True)
class Filter:
    """Points that a metric sees: a name for sharing work, and a SQL condition (null passes no point)."""

    name: str
    condition: str | None = None

    def __and__(self, other: Filter) -> Filter:
        if self.condition is None or self == other:
            return other
        return self if other.condition is None else Filter(f"{self.name}&{other.name}", f"({self.condition}) AND ({other.condition})")


ALL = Filter("all")


def above(limit: float, key: str = "Z") -> Filter:
    return Filter(f"{key}>{limit:g}", f"`{key}` > {float(limit)!r}")


def returns(k: int) -> Filter:
    return Filter(f"rn={k}", f"ReturnNumber = {int(k)}")


@dataclass(frozen=True)
class Metric:
    """A statistic of one attribute in one cell.

    ``aggregate(x)`` is a built-in aggregate of the filtered values; ``array(a, *deps)`` works on their sorted array;
    ``project(*deps)`` only on other metrics of the same attribute; ``method(series, *deps)`` is Python, for statistics
    that no expression gives.  Dependencies come in declared order; a null one gives null ("propagate") or an error ("raise").
    """

    name: str
    dtype: str = "float32"
    aggregate: Callable[[Column], Column] | None = None
    array: Callable[..., Column] | None = None
    project: Callable[..., Column] | None = None
    method: Callable | None = None
    deps: tuple[Metric, ...] = ()
    dep_attrs: tuple[str | None, ...] = ()
    filter: Filter = ALL
    attributes: tuple[str, ...] = ()
    nan_policy: str = "propagate"

    def __post_init__(self):
        if self.dtype not in KINDS:
            raise ValueError(f"metric {self.name}: no support for dtype {self.dtype}")
        if sum(x is not None for x in (self.aggregate, self.array, self.project, self.method)) != 1:
            raise ValueError(f"metric {self.name} needs one way of working it out")
        if self.nan_policy not in ("propagate", "raise"):
            raise ValueError(f"metric {self.name}: nan_policy {self.nan_policy}")

    @property
    def nodata(self):
        return NODATA[self.dtype[0]]

    @property
    def hidden(self) -> bool:
        """Array-valued intermediates are not stored."""
        return self.dtype == "object"

    def column_name(self, attr: str) -> str:
        return f"m_{attr}_{self.name}"

    def on(self, *attributes: str) -> Metric:
        return replace(self, attributes=attributes)

    def where(self, extra: Filter) -> Metric:
        """The metric on fewer points; what it depends on keeps its own points."""
        return replace(self, filter=self.filter & extra)


# ---------------------------------------------------------------- statistics

#: The mean of only zeros is null, as the reference has it.
mean = Metric("mean", aggregate=lambda x: F.when(F.max(F.abs(x)) != 0, F.avg(x)))
variance = Metric("variance", aggregate=lambda x: F.var_samp(x))
skewness = Metric("skewness", aggregate=lambda x: F.skewness(x) * F.try_divide(F.count(x), F.count(x) - 1))
kurtosis = Metric("kurtosis", aggregate=lambda x: (F.kurtosis(x) + 3) * F.try_divide(F.count(x), F.count(x) - 1))
product_moments = {m.name: m for m in (mean, variance, skewness, kurtosis)}

mode = Metric("mode", array=arrays.histogram_mode)
median = Metric("median", array=arrays.median)
minimum = Metric("min", aggregate=F.min)
maximum = Metric("max", aggregate=F.max)
stddev = Metric("stddev", aggregate=F.stddev_pop)
cv = Metric("cv", project=lambda sd, m: F.try_divide(sd, m), deps=(stddev, mean))
crr = Metric("canopy_relief_ratio", project=lambda m, lo, hi: F.try_divide(m - lo, hi - lo), deps=(mean, minimum, maximum))
sqmean = Metric("sqmean", aggregate=lambda x: F.sqrt(F.avg(x * x)))
cumean = Metric("cumean", aggregate=lambda x: F.cbrt(F.avg(F.pow(F.abs(x), F.lit(3)))))

pct_base = Metric("pct_base", "object", array=lambda a: arrays.percentiles(a, [p / 100 for p in PERCENTS]))


def _percent(p: int) -> Metric:
    k = PERCENTS.index(p)
    return Metric(f"p{p:02d}", project=lambda b: F.get(b, F.lit(k)), deps=(pct_base,))


percent = {p: _percent(p) for p in PERCENTS}
_minus = lambda a, b: a - b
iq = Metric("iq", project=_minus, deps=(percent[75], percent[25]))
profile_area = Metric("profile_area", array=arrays.profile_area)
percentiles = {m.name: m for m in [*percent.values(), Metric("90m10", project=_minus, deps=(percent[90], percent[10])), Metric("95m05", project=_minus, deps=(percent[95], percent[5])), iq, profile_area]}
statistics = {"mode": mode, "median": median, "min": minimum, "max": maximum, "stddev": stddev, "cv": cv, "crr": crr, "sqmean": sqmean, "cumean": cumean}

lmom_base = Metric("lmombase", "object", array=arrays.l_moments)
_l = [Metric(f"l{k + 1}", project=lambda b, k=k: F.get(b, F.lit(k)), deps=(lmom_base,)) for k in range(4)]
_ratio = lambda a, b: F.try_divide(a, b)
l_moments = {m.name: m for m in [*_l, Metric("lcv", project=_ratio, deps=(_l[1], _l[0])), Metric("lskewness", project=_ratio, deps=(_l[2], _l[1])), Metric("lkurtosis", project=_ratio, deps=(_l[3], _l[1]))]}

aad = {
    "aad": Metric("aad", array=arrays.mean_deviation, deps=(mean,)),
    "mad_median": Metric("mad_median", array=arrays.median_deviation, deps=(median,)),
    "mad_mode": Metric("mad_mode", array=arrays.median_deviation, deps=(mode,)),
    "mad_mean": Metric("mad_mean", array=arrays.median_deviation, deps=(mean,)),
}
all_metrics = {**percentiles, **l_moments, **statistics, **product_moments}


def _count(name: str, points: Filter, attr: str = "ReturnNumber") -> Metric:
    return Metric(name, "int32", aggregate=F.count, filter=points, attributes=(attr,))


def counts(elev: str = "Z", min_ht: float = 2, ht_break: float = 3, points: Filter = ALL) -> dict[str, Metric]:
    """Numbers of points.  The mean and the mode that values are compared with are those over ``points``."""
    high, low, first = above(ht_break, elev), above(min_ht, elev), returns(1)
    over = lambda name, dep, f: Metric(name, "int32", array=arrays.count_above, deps=(dep.where(points),), filter=f, attributes=(elev,))
    made = [
        _count("all_count", ALL),
        _count("all_count_above_minht", low),
        _count("all_count_above_htbreak", high),
        _count("1st_count_above_htbreak", first & high),
        over("all_count_above_mean", mean, ALL),
        # "above mode" is above the mean here, as the reference has it
        over("all_count_above_mode", mean, ALL),
        over("1st_count_above_mean", mean, first),
        over("1st_count_above_mode", mode, first),
        _count("1st_count", first),
        *[_count(f"r{k}_count", returns(k) & low) for k in range(1, 8)],
    ]
    return {m.name: m for m in made}


def covers(elev: str = "Z", min_ht: float = 2, ht_break: float = 3, points: Filter = ALL) -> dict[str, Metric]:
    """Percentages of counts.  Keys differ from the names of three metrics."""
    c = counts(elev, min_ht, ht_break, points)
    high, first = above(ht_break, elev), returns(1)

    def share(name: str, part: Metric, whole: Metric, attr: str) -> Metric:
        return Metric(name, project=lambda a, b: 100 * F.try_divide(a.cast("double"), b), deps=(part, whole), dep_attrs=(part.attributes[0], whole.attributes[0]), attributes=(attr,))

    own = lambda f, attr: _count(f"own_count_{f.name}", f, attr)
    return {
        "all_cover": share("all_cover_above_htbreak", own(high, "ReturnNumber"), c["all_count"], "ReturnNumber"),
        "all_cover_above_mean": share("all_cover_above_mean", c["all_count_above_mean"], own(ALL, elev), elev),
        # its own points are those over the height limit, unlike its siblings', as the reference has it
        "all_cover_above_mode": share("all_cover_above_mode", c["all_count_above_mode"], own(points, elev), elev),
        "1st_cover": share("1st_cover_above_htbreak", own(first & high, "ReturnNumber"), c["1st_count"], "ReturnNumber"),
        "1st_cover_above_mean": share("1st_cover_above_mean", c["1st_count_above_mean"], own(first, elev), elev),
        "1st_cover_above_mode": share("1st_cover_above_mode", c["1st_count_above_mode"], own(first, elev), elev),
        "all_1st_cover": share("all_1st_cover_above_htbreak", c["all_count_above_htbreak"], own(first, "ReturnNumber"), "ReturnNumber"),
        "all_1st_cover_above_mean": share("all_1st_cover_above_mean", c["all_count_above_mean"], own(first, elev), elev),
        "all_1st_cover_above_mode": share("all_1st_cover_above_mode", c["all_count_above_mode"], own(first, elev), elev),
    }


def grid_metrics(elev: str = "Z", min_ht: float = 2, ht_break: float = 3) -> dict[str, Metric]:
    """The default set of a database: 68 metrics in 104 columns."""
    if elev not in ("Z", "HeightAboveGround"):
        raise ValueError("elevation is Z or HeightAboveGround")
    over = above(min_ht, elev)
    two, one = (elev, "Intensity"), (elev,)
    out: dict[str, Metric] = {}

    def add(key: str, m: Metric, attrs: tuple[str, ...], f: Filter = over) -> None:
        out[key] = filtered(m, f).on(*attrs)

    for key, m in percentiles.items():
        add(key, m, one if key == "profile_area" else two, ALL if key == "profile_area" else over)
    for key, m in l_moments.items():
        add(key, m, two)
    for key, m in statistics.items():
        add(key, m, one if key in ("crr", "sqmean", "cumean") else two)
    for key, m in product_moments.items():
        add(key, m, two)
    for key, m in aad.items():
        add(key, m, two if key == "aad" else one)
    return out | counts(elev, min_ht, ht_break, over) | covers(elev, min_ht, ht_break, over)


def filtered(m: Metric, f: Filter) -> Metric:
    """A metric and all it depends on, on the points of a filter."""
    return replace(m, filter=m.filter & f, deps=tuple(filtered(d, f) for d in m.deps))


@dataclass(frozen=True)
class Registry:
    """Named groups and single metrics, as users name them."""

    extra: dict[str, Metric] = field(default_factory=dict)

    GROUPS = {"stats": statistics, "p_moments": product_moments, "l_moments": l_moments, "percentiles": percentiles, "aad": aad, "all": all_metrics}

    def resolve(self, names: str | list[str]) -> list[Metric]:
        """Metrics of a list of group names, ``grid_metrics[_elev[_min_ht[_ht_break]]]``, and metric names, in declared order."""
        out: dict[str, Metric] = {}
        for name in names.split(",") if isinstance(names, str) else names:
            name = name.strip()
            if name in self.GROUPS:
                found = self.GROUPS[name]
            elif name.startswith("grid_metrics"):
                parts = [p for p in name[len("grid_metrics") :].split("_") if p]
                found = grid_metrics(*parts[:1], *map(float, parts[1:3]))
            elif name in self.extra or name in all_metrics or name in aad:
                found = {name: (self.extra | all_metrics | aad)[name]}
            else:
                raise ValueError(f"no metric or group named {name!r}")
            for m in found.values():
                out.setdefault(m.name, m)
        return list(out.values())
