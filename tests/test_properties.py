"""Invariants of boxes and grids on generated values."""

import math

from hypothesis import given
from hypothesis import strategies as st

from celltide.functions.geometry import CENTER, CORNER, Bounds, Extents, Grid

whole = st.integers(-500, 500)
boxes = st.tuples(whole, whole, st.integers(1, 300), st.integers(1, 300)).map(lambda v: Bounds(v[0], v[1], v[0] + v[2], v[1] + v[3]))
alignments = st.sampled_from([CORNER, CENTER])
resolutions = st.sampled_from([1, 2, 4, 8, 30, 64])


@given(boxes, resolutions, alignments)
def test_alignment_grows_once(box, res, alignment):
    grown = box.aligned(res, alignment)
    assert grown.aligned(res, alignment) == grown
    assert grown.minx <= box.minx and grown.maxx >= box.maxx and grown.miny <= box.miny and grown.maxy >= box.maxy
    assert grown.maxx - grown.minx < box.maxx - box.minx + 2 * res


@given(boxes, boxes)
def test_shared_is_symmetric(a, b):
    assert a.shared(b) == b.shared(a)
    assert (a.shared(b) is None) == a.disjoint(b)


@given(boxes, resolutions, alignments, st.integers(1, 60))
def test_leaves_and_quarters_cover(box, res, alignment, size):
    e = Grid(box, max(res, 16), alignment).extents()
    cells = sorted(e.indices())
    for parts in (e.leaves(size), e.split()):
        assert sorted(c for p in parts for c in p.indices()) == cells
    assert e.cell_count == len(cells)


@given(boxes, resolutions, alignments, st.floats(0, 0.999), st.floats(0, 0.999))
def test_points_lie_in_their_cells(box, res, alignment, u, v):
    grid = Grid(box, res, alignment)
    x = grid.root.minx + u * (grid.root.maxx - grid.root.minx)
    y = grid.root.miny + v * (grid.root.maxy - grid.root.miny)
    xi, yi = math.floor((x - grid.root.minx) / res), math.ceil((grid.root.maxy - y) / res - 1)
    e = grid.extents()
    assert e.x1 <= xi < e.x2 and -1 <= yi < e.y2
    assert grid.root.minx + xi * res <= x < grid.root.minx + (xi + 1) * res + 1e-9


@given(boxes)
def test_text_forms_agree(box):
    import json

    forms = [box.to_list(), json.dumps(box.to_list()), json.dumps(dict(zip(("minx", "miny", "maxx", "maxy"), box.to_list()))), f"([{box.minx},{box.maxx}],[{box.miny},{box.maxy}])"]
    assert {Bounds.parse(f) for f in forms} == {box}
    assert isinstance(Grid(box, 5).extents(), Extents)
