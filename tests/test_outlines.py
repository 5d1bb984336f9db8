import json
import math

import numpy as np
import pytest

from spillspark.operators import outlines, raster

DEGREES = (0.01, 0.0, 124.5, 0.0, -0.005, 30.8)


def outside(cells):
    """Number of holes: parts of the outside, by sides, that don't reach the frame."""
    rs, cs = [r for r, _ in cells], [c for _, c in cells]
    free = {(r, c) for r in range(min(rs) - 1, max(rs) + 2) for c in range(min(cs) - 1, max(cs) + 2)} - cells
    parts = 0
    while free:
        todo, parts = [free.pop()], parts + 1
        while todo:
            r, c = todo.pop()
            for x in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                if x in free:
                    free.remove(x)
                    todo.append(x)
    return parts - 1


def labelled(spark, mask):
    oil = spark.createDataFrame([(1, int(r), int(c)) for r, c in zip(*np.nonzero(mask), strict=True)], "scene_id long, r long, c long")
    return raster.scene_components(oil, 16)


def check(rings, cells):
    """``rings``: of one component."""
    shells = [r for r in rings if r.is_shell]
    assert len(shells) == 1 and len(rings) - 1 == outside(cells)
    assert sum(r.twice for r in rings) == 2 * len(cells)
    for r in rings:
        p = [(x.r, x.c) for x in r.points]
        assert p[0] == p[-1] and len(set(p)) == len(p) - 1 >= 4  # closed, never touching itself
        for a, b, c in zip([p[-2], *p], p, p[1:], strict=False):
            assert (a[0] == b[0]) != (b[0] == c[0])  # corners only
        enclosed = sum(b.c * a.r - a.c * b.r for a, b in zip(r.points, r.points[1:], strict=False))
        assert enclosed == r.twice and (enclosed > 0) == r.is_shell
        assert sum(abs(a.r - b.r) + abs(a.c - b.c) for a, b in zip(r.points, r.points[1:], strict=False)) == r.sides


@pytest.mark.parametrize(("size", "share"), [(4, 0.62), (8, 0.7), (64, 0.62)])
def test_rings_do_not_depend_on_tiles(spark, size, share):
    mask = np.random.default_rng(5).random((30, 37)) < share
    table = labelled(spark, mask).cache()
    cells, rings = {}, {}
    for x in table.collect():
        cells.setdefault(x.component, set()).add((x.r, x.c))
    for x in outlines.rings(table, size).collect():
        rings.setdefault(x.component, []).append(x)
    assert rings.keys() == cells.keys()
    for k, own in cells.items():
        check(rings[k], own)


def test_a_ring_over_many_tiles(spark):
    """A spiral: one shell whose pieces lie in nearly all tiles."""
    n, mask, r, c, d, left = 41, np.zeros((41, 41), bool), 0, 0, 0, 41
    mask[0, 0] = True
    while left > 2:
        for _ in range(2):
            for _ in range(left - 1):
                r, c = r + (0, 1, 0, -1)[d], c + (1, 0, -1, 0)[d]
                if not (0 <= r < n and 0 <= c < n):
                    r, c = r - (0, 1, 0, -1)[d], c - (1, 0, -1, 0)[d]
                    break
                mask[r, c] = True
            d = (d + 1) % 4
        left -= 2
    mask[20:23, 20:23] = [[1, 1, 1], [1, 0, 1], [1, 1, 1]]
    table = labelled(spark, mask)
    cells = {}
    for x in table.collect():
        cells.setdefault(x.component, set()).add((x.r, x.c))
    rings = {}
    for x in outlines.rings(table, 4).collect():
        rings.setdefault(x.component, []).append(x)
    for k, own in cells.items():
        check(rings[k], own)


def test_corners_that_touch(spark):
    """A ring of pixels closed over a corner: a hole that touches the shell there, and two holes that touch each other."""
    first = ["1111", "1001", "1010", "1100"]
    second = ["11111", "10111", "11011", "11111"]
    for rows, holes in ((first, 1), (second, 2)):
        mask = np.array([[c == "1" for c in row] for row in rows])
        got = outlines.rings(labelled(spark, mask), 2).collect()
        by = {}
        for x in got:
            by.setdefault(x.component, []).append(x)
        main = max(by.values(), key=len)
        assert sum(not r.is_shell for r in main) == holes or len(by) > 1
        assert all(sum(r.is_shell for r in v) == 1 for v in by.values())


def test_multipolygon_and_measures(spark):
    cells = [(0, 0), (0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1), (2, 2)]
    df = spark.createDataFrame([(1, 7, r, c) for r, c in cells] + [(1, 8, 9, 9)], "scene_id long, component long, r long, c long")
    shapes = outlines.polygons(outlines.rings(df, 2), (10.0, 0.0, 100.0, 0.0, -10.0, 200.0))
    document = json.loads(outlines.multipolygons(shapes).first().document)
    assert document["type"] == "MultiPolygon" and [len(p) for p in document["coordinates"]] == [2, 1]

    def area(ring):
        return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:], strict=False))) / 2

    assert [[area(r) for r in p] for p in document["coordinates"]] == [[900.0, 100.0], [100.0]]
    assert sorted(document["coordinates"][1][0][:4]) == [[190, 100], [190, 110], [200, 100], [200, 110]]
    flat = {r.component: r for r in outlines.measures(outlines.chains(df, 2), (10.0, 0.0, 100.0, 0.0, -10.0, 200.0)).collect()}
    assert (flat[7].area_m2, flat[7].perimeter_m, flat[8].area_m2) == (800.0, 160.0, 100.0)
    mask = df.selectExpr("scene_id", "r", "c", "1 as is_oil")
    whole = raster.mask_geometry(mask, DEGREES, geographic=True).first()
    parts = outlines.measures(outlines.chains(df, 2), DEGREES, geographic=True).collect()
    assert math.isclose(sum(r.area_m2 for r in parts), whole.area_m2, rel_tol=1e-9)
    assert math.isclose(sum(r.perimeter_m for r in parts), whole.perimeter_m, rel_tol=1e-12)


def test_no_pixels(spark):
    none = spark.createDataFrame([], "scene_id long, component long, r long, c long")
    assert outlines.rings(none, 4).count() == 0
