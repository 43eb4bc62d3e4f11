import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from celltide import cli
from celltide.functions.geometry import CENTER, CORNER, Bounds
from celltide.operators import verbs
from celltide.operators.metrics import Metric
from celltide.operators.verbs import ShatterConfig
from celltide.sinks import raster
from celltide.sources import las
from celltide.sources import points as src
from celltide.store import CellStore, Files, Ingest, StoreConfig, as_date, date_pair

BOX = Bounds(300, 300, 600, 600)
POINTS = "X double, Y double, Z double, Intensity int, NumberOfReturns short, ReturnNumber short"


def cloud(spark, alignment=CORNER):
    low, high, off = (300, 600, 0) if alignment == CORNER else (285, 615, 15)
    xs = spark.range(low, high).select(F.col("id").cast("double").alias("X"))
    rows = xs.crossJoin(xs.withColumnRenamed("X", "Y"))
    v = F.floor((F.col("Y") + off) / 30)
    return rows.select("X", "Y", v.cast("double").alias("Z"), v.cast("int").alias("Intensity"), v.cast("short").alias("NumberOfReturns"), v.cast("short").alias("ReturnNumber"))


def new(spark, path, alignment=CORNER, **kw):
    config = StoreConfig(BOX, 30, "EPSG:5070", alignment, metrics=["mean", "median"], xsize=5, ysize=5)
    for k, v in kw.items():
        setattr(config, k, v)
    return verbs.initialize(spark, str(path), config)


@pytest.mark.parametrize("alignment,n,cells", [(CORNER, 90_000, 100), (CENTER, 108_900, 121)])
def test_life_of_a_database(spark, tmp_path, alignment, n, cells):
    store = new(spark, tmp_path / "db", alignment)
    pts = cloud(spark, alignment).persist()
    one = verbs.shatter(store, pts, ShatterConfig(dates=("2011-01-01", "2012-01-01"), name="one"))
    assert one.finished and one.point_count == n and one.time_slot == 1
    seen = store.read().collect()
    assert len(seen) == cells
    top = -(-store.grid.root.maxy // 30)
    for r in seen:
        assert r.m_Z_mean == r.m_Z_median == top - r.Y - 1 and set(r.Z) == {r.m_Z_mean} and r["count"] == len(r.Z) == 900
    # a second ingest hides the first, which is seen as of its time
    two = verbs.shatter(store, pts.withColumn("Z", F.col("Z") + 100), ShatterConfig(dates="2013-05-05", name="two"))
    assert two.time_slot == 2 and len(store.history()) == 2
    assert {r.time_slot for r in store.read().collect()} == {2} and store.read().count() == cells
    before = store.read(as_of_ms=one.written_to).collect()
    assert {r.time_slot for r in before} == {1} and len(before) == cells
    assert store.read(dates=("2011-06-01", "2011-07-01")).first().time_slot == 1
    # restart overwrites its own slot
    again = verbs.restart(store, pts, "two")
    assert again.time_slot == 2 and again.point_count == n and min(r.m_Z_mean for r in store.read().collect()) < 100
    # delete hides the older cells too
    verbs.delete(store, "two")
    assert store.read().count() == 0 and not store.entry("two").finished
    with pytest.raises(KeyError):
        verbs.delete(store, "three")
    verbs.restart(store, pts, "two")
    store.compact()
    assert store.read().count() == cells and {r.time_slot for r in store.read().collect()} == {2}
    pts.unpersist()


@pytest.mark.parametrize("alignment,left", [(CORNER, 67_500), (CENTER, 86_400)])
def test_resume_skips_finished_cells(spark, tmp_path, alignment, left):
    store = new(spark, tmp_path / "db", alignment)
    pts = cloud(spark, alignment)
    entry = verbs.shatter(store, pts.where("X < 0"), ShatterConfig(dates="2011-01-01", name="r", bounds=BOX))
    entry.mbr, entry.finished = [[0, 5, 0, 5]], False
    store.save(entry)
    assert verbs.resume(store, pts, "r").point_count == left
    assert store.read().where("X < 5 AND Y < 5").count() == 0


def test_interrupted_ingest_goes_on(spark, tmp_path, monkeypatch):
    """Killed in its third strip, before and after that strip's cells are written."""
    for late in (False, True):
        store = new(spark, tmp_path / f"db{late}", xsize=2, ysize=5)
        pts, write, n = cloud(spark), store.write_cells, []

        def fails(cells, entry, batch=0):
            n.append(batch)
            if len(n) == 3:
                if late:
                    write(cells, entry, batch)
                raise KeyboardInterrupt
            return write(cells, entry, batch)

        monkeypatch.setattr(store, "write_cells", fails)
        with pytest.raises(KeyboardInterrupt):
            verbs.shatter(store, pts, ShatterConfig(dates="2011-01-01", name="x", batches=5))
        store = CellStore.open(spark, str(tmp_path / f"db{late}"))
        half = store.entry("x")
        assert not half.finished and half.done == [0, 1] and half.point_count == 36_000 and store.read().count() == 40
        assert verbs.resume(store, pts, "x").point_count == 54_000
        rows = store.all_cells().collect()
        assert len(rows) == 100 and sum(r["count"] for r in rows) == 90_000 and store.entry("x").finished


def test_compaction_and_delete(spark, tmp_path, monkeypatch):
    store = new(spark, tmp_path / "db")
    pts = cloud(spark)
    verbs.shatter(store, pts, ShatterConfig(dates="2011-01-01", name="old"))
    verbs.shatter(store, pts.where("X < 390"), ShatterConfig(dates="2012-01-01", name="new", bounds=Bounds(300, 300, 390, 600)))
    # a crash before the manifest is written changes nothing
    replace = store.files.replace
    monkeypatch.setattr(store.files, "replace", lambda *a: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError):
        store.compact()
    monkeypatch.setattr(store.files, "replace", replace)
    assert store.read().count() == 100 and len(store.vacuum()) == 1
    store.compact()
    assert store.read().groupBy("time_slot").count().orderBy("time_slot").collect() == [(1, 70), (2, 30)]
    assert [f["in_base"] for f in store.fragments()] == [True, True] and store.vacuum() == []
    verbs.delete(store, "old")
    assert {r.time_slot for r in store.read().collect()} == {2} and store.read().count() == 30
    verbs.restart(store, pts.where("X >= 570"), "old")
    assert store.read().groupBy("time_slot").count().orderBy("time_slot").collect() == [(1, 10), (2, 30)]
    store.compact()
    assert store.read().count() == 40 and dict(store.read().dtypes)["m_Z_mean"] == "float"
    three = verbs.shatter(store, pts, ShatterConfig(dates="2013-01-01", name="three"))
    assert three.time_slot == 3 and store.read().count() == 100
    last = store.fragments(since_ms=three.written_from, inside=True)
    assert [(f["name"], f["in_base"], f["files"] > 0, f["bytes"] > 0) for f in last] == [("three", False, True, True)] and len(store.fragments(before_ms=three.written_from - 1)) == 2


def test_history_and_info(spark, tmp_path):
    store = new(spark, tmp_path / "db")
    pts = cloud(spark)
    for k, part in enumerate(BOX.bisect()):
        verbs.shatter(store, pts, ShatterConfig(dates=f"2011-01-0{k + 2}", bounds=part, name=f"q{k}"))
    assert sum(e.point_count for e in store.history()) == 90_000
    for k, part in enumerate(BOX.bisect()):
        assert [e.name for e in store.history(bounds=part)] == [f"q{k}"]
        assert [e.name for e in store.history(dates=f"2011-01-0{k + 2}")] == [f"q{k}"]
    assert [e.name for e in store.history(dates=("2011-01-03", "2011-01-04"))] == ["q1", "q2"]
    info = verbs.info(store, name="q3", concise=True)
    assert len(info["history"]) == 1 and "mbr" not in info["history"][0] and len(info["metadata"]["attributes"]) == 4
    assert verbs.history_table(store).where("maxx <= 450").count() == 2
    assert [store.reserve_slot() for _ in range(3)] == [5, 6, 7]


def test_configuration(spark, tmp_path):
    store = new(spark, tmp_path / "db", CENTER, xsize=1000, ysize=1000)
    assert store.config.xsize == 12
    assert CellStore.open(spark, str(tmp_path / "db")).config == store.config
    with pytest.raises(FileExistsError):
        new(spark, tmp_path / "db")
    with pytest.raises(FileNotFoundError):
        CellStore.open(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError, match="Missing required dependency, ReturnNumber."):
        new(spark, tmp_path / "x", attributes={"Z": "double", "Intensity": "int"}, metrics=["grid_metrics"])
    with pytest.raises(ValueError, match="projected"):
        new(spark, tmp_path / "x", projected=False)
    files = Files(spark, str(tmp_path / "db"))
    files.replace("extra.json", {"a": 1})
    files.replace("extra.json", {"a": 2})
    assert files.read("extra.json") == {"a": 2} and not files.create("extra.json", {})
    assert as_date("2011-01-02T10:00:00Z") == "2011-01-02" and date_pair(["2012-01-01", "2011-01-01"]) == ("2011-01-01", "2012-01-01")
    for bad in ("yesterday", ["2011-01-01"] * 3):
        with pytest.raises(ValueError):
            date_pair(bad)
    assert Ingest("n", 1, [0, 0, 1, 1], "2011-01-01", "2011-01-05").overlaps_dates("2011-01-05", "2011-01-09")


def test_disjoint_data_and_parity(spark, tmp_path):
    store = new(spark, tmp_path / "db", metrics=["grid_metrics"])
    far = cloud(spark).withColumn("X", F.col("X") + 10_000)
    assert verbs.shatter(store, far, ShatterConfig(dates="2011-01-01")).point_count == 0
    assert store.read() is None and verbs.extract(store, columns=["m_Z_mean"]).count() == 100
    low = spark.createDataFrame([(301.0, 301.0, 1.0, 1, 1, 1), (331.0, 301.0, 9.0, 1, 1, 1)], POINTS)
    verbs.shatter(store, low, ShatterConfig(dates="2011-01-01", name="full"))
    assert sorted(r.m_ReturnNumber_all_count for r in store.read().collect()) == [1, 1]
    verbs.shatter(store, low, ShatterConfig(dates="2011-01-01", name="like", parity=True))
    assert sorted(str(r.m_ReturnNumber_all_count) for r in store.read().collect()) == ["1", "None"]


@pytest.mark.parametrize("alignment", [CORNER, CENTER])
def test_rasters(spark, tmp_path, alignment):
    store = new(spark, tmp_path / "db", alignment)
    pts = cloud(spark, alignment).where("X < 540")
    verbs.shatter(store, pts, ShatterConfig(dates="2011-01-01"))
    verbs.extract(store, str(tmp_path / "out"), ["m_Z_mean"])
    data, tags = raster.read_tiff(str(tmp_path / "out" / "m_Z_mean.tif"))
    root, size = store.grid.root, int((store.grid.root.maxx - store.grid.root.minx) / 30)
    assert data.shape == (size, size) and tags[33550][:2] == (30, 30) and tags[33922][3:5] == (root.minx, root.maxy) and tags[42113].startswith("-9999") and "EPSG:5070" in tags[34737]
    top = -(-root.maxy // 30)
    edge = int((540 - root.minx) // 30)
    for y in range(size):
        assert (data[y, :edge] == top - y - 1).all() and (data[y, edge + 1 :] == -9999).all()
    part = verbs.extract(store, str(tmp_path / "asc"), ["m_Z_mean"], Bounds(300, 300, 450, 450), form="asc")
    lines = (tmp_path / "asc" / "m_Z_mean.asc").read_text().splitlines()
    assert lines[0] == f"ncols {len(lines[6].split())}" and part.count() == len(lines[6].split()) * (len(lines) - 6)
    verbs.extract(store, str(tmp_path / "pq"), form="parquet")
    assert spark.read.parquet(str(tmp_path / "pq")).count() == size * size
    with pytest.raises(ValueError):
        verbs.extract(store, columns=["m_Z_nothing"])
    with pytest.raises(ValueError, match="shares no cell"):
        verbs.extract(store, bounds=Bounds(0, 0, 30, 30))


def test_tiff_types(spark):
    for dtype, (kind, sample) in raster.SAMPLES.items():
        head = raster.tiff_header(3, 2, dtype, 1.0, Bounds(0, 0, 3, 2), 0, "")
        assert struct.unpack_from("<2sH", head) == (b"II", 42) and len(head) % 2 == 0 and np.dtype(kind).itemsize and sample


def test_las_and_pipelines(spark, tmp_path):
    rng = np.random.default_rng(0)
    n = 1000
    x, y, z = (np.round(rng.random(n) * 100, 2) for _ in range(3))
    las.write(str(tmp_path / "a.las"), x, y, z, rng.integers(0, 65535, n), rng.integers(1, 4, n), np.full(n, 4))
    df = src.load(spark, str(tmp_path / "a.las"))
    assert df.count() == n and df.agg(F.sum("X")).first()[0] == pytest.approx(x.sum()) and df.select("ReturnNumber").distinct().count() == 3
    assert src.load(spark, str(tmp_path / "a.las"), bounds=Bounds(10, 10, 50, 50)).count() == ((x >= 10) & (x <= 50) & (y >= 10) & (y <= 50)).sum()
    spec = {"pipeline": [str(tmp_path / "a.las"), {"type": "filters.range", "limits": "Z[20:60],X[:90]"}, {"type": "filters.assign", "value": "W = Z * 2"}, {"type": "filters.crop", "bounds": "([0,100],[0,50])"}, {"type": "writers.las", "filename": "o"}]}
    (tmp_path / "p.json").write_text(json.dumps(spec))
    out = src.load(spark, str(tmp_path / "p.json"))
    assert out.count() == ((z >= 20) & (z <= 60) & (x <= 90) & (y <= 50)).sum() and "W" in out.columns
    for bad in ([], [str(tmp_path / "a.las")] * 2, [{"type": "readers.ept", "filename": "e"}], [str(tmp_path / "a.las"), {"type": "filters.magic"}]):
        with pytest.raises(ValueError):
            src.validated(bad)
    for bad in ("a.copc.laz", "x/ept.json"):
        with pytest.raises(ValueError):
            src.kind_of(bad)
    df.select("X", "Y").write.json(str(tmp_path / "pts.json"))
    assert src.load(spark, str(tmp_path / "a.las"), {"A": "X + 1"}).columns == ["A"]
    assert src.estimated_count(spark, str(tmp_path / "a.las")) == n == src.estimated_count(spark, str(tmp_path / "pts.json"))


def test_command_line(spark, tmp_path):
    cloud(spark).write.parquet(str(tmp_path / "c.parquet"))
    (tmp_path / "mine.py").write_text("from pyspark.sql import functions as F\nfrom celltide.operators.metrics import Metric\ndef metrics():\n    return [Metric('exists', 'uint8', aggregate=lambda x: F.when(F.count(x) > 0, 1))]\n")
    (tmp_path / "bad.py").write_text("def metrics():\n    return [1]\n")
    db = ["-d", str(tmp_path / "db"), "--user-metrics", str(tmp_path / "mine.py")]
    made = cli.run([*db, "initialize", "--bounds", "[300,300,600,600]", "--crs", "EPSG:5070", "-a", "Z,Intensity", "-m", "p_moments,exists", "--alignment", "AlignToCorner"], spark)
    assert made["metrics"] == ["p_moments", "exists"]
    assert cli.run([*db, "scan", str(tmp_path / "c.parquet"), "--depth", "5"], spark)["tile_info"]["recommended"] == 100
    e = cli.run([*db, "shatter", str(tmp_path / "c.parquet"), "--dates", "2011-01-01", "2012-01-01", "--name", "n"], spark)
    assert e["point_count"] == 90_000
    assert len(cli.run([*db, "info", "--history"], spark)["history"]) == 1
    out = cli.run([*db, "extract", "-o", str(tmp_path / "o"), "-m", "mean,exists"], spark)
    assert out["columns"] == ["m_Z_mean", "m_Intensity_mean", "m_Z_exists", "m_Intensity_exists"] and (tmp_path / "o" / "m_Z_exists.tif").exists()
    assert cli.run([*db, "resume", "--id", "n", str(tmp_path / "c.parquet")], spark)["point_count"] == 0
    assert cli.run([*db, "restart", "--id", "n", str(tmp_path / "c.parquet")], spark)["finished"]
    assert cli.run([*db, "delete", "--id", "n"], spark)["deleted"]
    with pytest.raises(ValueError):
        cli.load_metrics(str(tmp_path / "bad.py"))
    assert isinstance(cli.load_metrics(str(tmp_path / "mine.py"))[0], Metric)


def test_stream(spark, tmp_path):
    from celltide.streaming.ingest import shatter_stream

    cloud(spark).repartition(2).write.parquet(str(tmp_path / "in"))
    store = new(spark, tmp_path / "db")
    points = spark.readStream.schema(cloud(spark).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for _ in range(2):
        shatter_stream(store, points, "2011-01-01", str(tmp_path / "ck")).awaitTermination(120)
    assert sum(e.point_count for e in store.history()) == 90_000 and {e.name for e in store.history()} == {"stream-0", "stream-1"}
