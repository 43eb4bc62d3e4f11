import itertools

import pytest
from pyspark.sql import functions as F

from celltide.functions.geometry import CENTER, CORNER, Bounds, Extents, Grid
from celltide.operators import points as p
from celltide.operators import tiling

BOX = Bounds(300, 300, 600, 600)


@pytest.fixture(scope="module")
def clouds(spark):
    """Integer points whose value is constant per cell of a 30 unit grid, for both alignments."""
    made = {}
    for alignment, low, high, off in ((CORNER, 300, 600, 0), (CENTER, 285, 615, 15)):
        rows = spark.range(low, high).select(F.col("id").cast("double").alias("X")).crossJoin(spark.range(low, high).select(F.col("id").cast("double").alias("Y")))
        made[alignment] = rows.withColumn("Z", F.floor((F.col("Y") + off) / 30).cast("double")).persist()
    yield made
    for df in made.values():
        df.unpersist()


@pytest.mark.parametrize("text", ["([1,101],[2,102],[3,103])", '{"minx":1,"miny":2,"maxx":101,"maxy":102}', "[1,2,101,102]", "[1,2,3,101,102,103]", [1, 2, 101, 102]])
def test_parse(text):
    assert Bounds.parse(text) == Bounds(1, 2, 101, 102)


def test_bad_bounds():
    for bad in ("x", "[1,2,3]", '{"minx":1}', "5"):
        with pytest.raises(ValueError):
            Bounds.parse(bad)
    with pytest.raises(ValueError):
        BOX.aligned(30, "diagonal")


def test_alignment():
    assert BOX.aligned(30, "PixelIsArea") == BOX
    assert BOX.aligned(30, CENTER) == Bounds(285, 285, 615, 615)
    assert Bounds(301, 299, 599, 601).aligned(30, CORNER) == Bounds(300, 270, 600, 630)
    for alignment in (CORNER, CENTER):
        once = Bounds(1.5, -7, 99, 101).aligned(30, alignment)
        assert once.aligned(30, alignment) == once


def test_boxes():
    a, b = Bounds(0, 0, 10, 10), Bounds(10, 0, 20, 10)
    assert a.disjoint(b) and a.shared(b) is None and not a.disjoint(Bounds(9, 9, 11, 11))
    assert a.shared(Bounds(5, -5, 20, 5)) == Bounds(5, 0, 10, 5)
    assert a.bisect() == [Bounds(0, 0, 5, 5), Bounds(5, 0, 10, 5), Bounds(0, 5, 5, 10), Bounds(5, 5, 10, 10)]
    assert str(a) == "([0.00,10.00],[0.00,10.00])"


@pytest.mark.parametrize("alignment,cells,n", [(CORNER, 100, 90_000), (CENTER, 121, 108_900)])
def test_binning(clouds, alignment, cells, n):
    grid = Grid(BOX, 30, alignment)
    rows = p.binned(p.within(clouds[alignment], grid.root, 30), grid, ["Z"]).groupBy("xi", "yi").agg(F.min("Z").alias("lo"), F.max("Z").alias("hi"), F.count("*").alias("n")).collect()
    assert len(rows) == cells and sum(r.n for r in rows) == n
    top = -(-grid.root.maxy // 30)
    assert all(r.lo == r.hi == top - r.yi - 1 for r in rows)


def test_counts_of_quarters(clouds):
    for alignment, n in ((CORNER, 90_000), (CENTER, 108_900)):
        grid = Grid(BOX, 30, alignment)
        parts = grid.extents().split()
        assert sum(p.within(clouds[alignment], e.bounds).count() for e in parts) == n
    lower = {CORNER: 22_500, CENTER: 32_400}
    for alignment, n in lower.items():
        assert p.within(clouds[alignment], Grid(Bounds(300, 300, 450, 450), 30, alignment).root).count() == n


def test_closed_counts(clouds):
    grid_free = clouds[CORNER].where("X % 30 <> 0 AND Y % 30 <> 0")
    assert p.count_closed(grid_free, BOX) == 84_100
    r = p.source_bounds(clouds[CORNER]).first()
    assert tuple(r) == (300, 300, 599, 599)


@pytest.mark.parametrize("alignment", [CORNER, CENTER])
@pytest.mark.parametrize("size", [1, 5, 9, 16, 10_000])
def test_leaves_cover_without_overlap(alignment, size):
    e = Grid(BOX, 30, alignment).extents()
    seen = list(itertools.chain.from_iterable(leaf.indices() for leaf in e.leaves(size)))
    assert sorted(seen) == sorted(e.indices()) and len(set(seen)) == len(seen) == e.cell_count


@pytest.mark.parametrize("alignment", [CORNER, CENTER])
def test_split_covers_without_overlap(alignment):
    e = Grid(Bounds(0, 0, 210, 330), 30, alignment).extents()
    seen = list(itertools.chain.from_iterable(part.indices() for part in e.split()))
    assert sorted(seen) == sorted(e.indices()) and len(set(seen)) == len(seen)


def test_large_tiling():
    e = Grid(Bounds(-9484547, 5652971, -9475016, 5681265), 5, CORNER).extents()
    assert sum(leaf.cell_count for leaf in e.leaves(10_000)) == (e.x2 - e.x1) * (e.y2 - e.y1)


def test_quadtree(clouds):
    for alignment, n in ((CORNER, 90_000), (CENTER, 108_900)):
        e = Grid(BOX, 30, alignment).extents()
        tiles = tiling.quadtree(clouds[alignment], e, 5000)
        cells = list(itertools.chain.from_iterable(t.indices() for t in tiles))
        assert sorted(cells) == sorted(e.indices())
        counts = tiling.histogram(clouds[alignment], e)
        assert sum(counts.count(t) for t in tiles) == n and all(counts.count(t) <= 5000 for t in tiles)
        assert tiling.quadtree(clouds[alignment].where("X < 0"), e) == []


def test_coarse_histogram_counts_at_least(clouds, monkeypatch):
    monkeypatch.setattr(tiling, "MAX_BLOCKS", 20)
    e = Grid(BOX, 30, CORNER).extents()
    rough = tiling.histogram(clouds[CORNER], e)
    assert rough.side > 1 and rough.count(e) == 90_000
    assert all(rough.count(part) >= 22_500 for part in e.split())


def test_scan(clouds):
    for alignment, cells in ((CORNER, 100), (CENTER, 121)):
        grid = Grid(BOX, 30, alignment)
        info = tiling.scan(clouds[alignment], grid, None, 10, 10, 5)
        assert info["tile_info"]["recommended"] == 1
        whole = tiling.scan(clouds[alignment], grid, None, depth=5)
        assert whole["tile_info"]["recommended"] == cells and whole["tile_info"]["num_cells"] == cells
    nothing = tiling.scan(clouds[CORNER], Grid(BOX, 30, CORNER), Bounds(0, 0, 1, 1))
    assert nothing["tile_info"]["num_tiles"] == 0


def test_extents_overlap():
    grid = Grid(BOX, 30, CORNER)
    a = Extents.of(grid, Bounds(300, 300, 450, 450))
    assert (a.x1, a.x2, a.y1, a.y2) == (0, 5, 5, 10)
    assert a.overlap(grid.extents()) == a and a.disjoint((5, 10, 0, 5)) and not a.disjoint((4, 5, 9, 10))
