import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spillspark.operators import raster


def test_mask_geometry(spark):
    rows = [(1, 0, 0, 1), (1, 0, 1, 0), (1, 1, 0, 0), (1, 1, 1, 0), (2, 0, 0, 0)]
    got = {r.scene_id: r for r in raster.mask_geometry(spark.createDataFrame(rows, "scene_id long, r long, c long, is_oil int"), (10.0, 0.0, 100.0, 0.0, -10.0, 200.0)).collect()}
    a, b = got[1], got[2]
    assert (a.has_oil, a.area_m2, a.perimeter_m, a.centroid_x, a.centroid_y) == (True, 100.0, 40.0, 105.0, 195.0)
    assert (a.x_min, a.y_min, a.x_max, a.y_max) == (100.0, 190.0, 110.0, 200.0)
    assert (b.has_oil, b.area_m2, b.perimeter_m, b.centroid_x) == (False, 0.0, 0.0, None)


def test_mask_in_degrees(spark):
    """Area and perimeter of a map in degrees are those of its sides in EPSG:3857."""
    cells = [(0, 0), (0, 1), (1, 1), (5, 3)]
    df = spark.createDataFrame([(1, r, c, 1) for r, c in cells], "scene_id long, r long, c long, is_oil int")
    for turn in ((0.01, 0.0, 124.5, 0.0, -0.005, 30.8), (0.008, 0.003, 10.0, 0.006, -0.004, 55.0)):
        a, b, x0, d, e, y0 = turn

        def ground(r, c):
            lon, lat = a * c + b * r + x0, d * c + e * r + y0  # noqa: B023
            return math.radians(lon) * 6378137, 6378137 * math.log(math.tan(math.pi / 4 + math.radians(lat) / 2))

        area = length = 0.0
        for r, c in cells:
            p = [ground(*x) for x in ((r, c), (r + 1, c), (r + 1, c + 1), (r, c + 1))]
            area += abs(sum(p[k - 1][0] * p[k][1] - p[k][0] * p[k - 1][1] for k in range(4))) / 2
            for (dr, dc), k in (((0, -1), (0, 1)), ((1, 0), (1, 2)), ((0, 1), (2, 3)), ((-1, 0), (3, 0))):
                if (r + dr, c + dc) not in cells:
                    length += math.dist(p[k[0]], p[k[1]])
        got = raster.mask_geometry(df, turn, geographic=True).first()
        assert math.isclose(got.area_m2, area, rel_tol=1e-6) and math.isclose(got.perimeter_m, length, rel_tol=1e-9)


def test_calibration(spark):
    lut = spark.createDataFrame([(1, "VV", y * 10, x * 10, z) for y, x, z in ((0, 0, 10.0), (0, 1, 20.0), (1, 0, 30.0), (1, 1, 40.0))], "scene_id long, pol string, line long, pixel long, a_sigma double")
    px = spark.createDataFrame([(1, "VV", 5, 5, 2.5), (1, "VV", 99, -3, 0.0)], "scene_id long, pol string, r long, c long, dn double")
    got = {r.r: r for r in raster.calibrate(px, lut).collect()}
    assert got[5].a == 25.0 and abs(got[5].db + 20) < 1e-9 and got[99].a == 30.0 and got[99].db == -50.0
    values = [-60.0, -50.0, -22.5, 5.0, 10.0, float("nan"), float("inf"), float("-inf")]
    out = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", raster.normalise(F.col("v")).alias("n")).orderBy("i").collect()
    assert [r.n for r in out] == [0, 0, 0.5, 1, 1, 0, 1, 0]


def test_scene_counts(spark):
    """300 x 300, upper and lower 50 rows without signal, a square of oil."""
    px = spark.range(90_000).select(F.lit(1).cast("long").alias("scene_id"), F.expr("id div 300").alias("r"), (F.col("id") % 300).alias("c"))
    valid = F.col("r").between(50, 249)
    prob = F.when(F.col("r") < 50, 0.95).when(F.col("r").between(100, 149) & F.col("c").between(100, 149), 0.85).otherwise(0.2)
    px = px.select("*", prob.alias("prob"), *[F.when(valid, 9.0).otherwise(0.0).alias(b) for b in ("vv", "vh")])
    n = raster.mask_counts(raster.masks(px)).first()
    assert (n.n_valid, n.n_invalid, n.n_oil, n.n_core) == (60_000, 30_000, 2_500, 2_500)
    s = raster.component_stats(raster.scene_components(raster.masks(px).where("oil"), size=64)).collect()
    assert [(x.n, x.r0, x.r1, x.c0, x.c1, x.density) for x in s] == [(2500, 100, 149, 100, 149, 1.0)]
    small = raster.downsample(raster.masks(px)).where("oil").count()
    assert small == 9
    nothing = raster.mask_counts(raster.masks(px.withColumn("vv", F.lit(0.0)))).first()
    assert nothing.oil_percent is None


def labels(mask):
    out, n = np.zeros(mask.shape, int), 0
    for r, c in zip(*np.nonzero(mask), strict=True):
        if not out[r, c]:
            n, todo = n + 1, [(r, c)]
            out[r, c] = n
            while todo:
                a, b = todo.pop()
                for x, y in ((a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)):
                    if 0 <= x < mask.shape[0] and 0 <= y < mask.shape[1] and mask[x, y] and not out[x, y]:
                        out[x, y] = n
                        todo.append((x, y))
    return out


@pytest.mark.parametrize("size", [4, 16])
def test_components_do_not_depend_on_tiles(spark, size):
    g = np.random.default_rng(1)
    mask = g.random((40, 40)) < 0.55
    oil = spark.createDataFrame([(1, int(r), int(c)) for r, c in zip(*np.nonzero(mask), strict=True)], "scene_id long, r long, c long")
    got = {}
    for x in raster.scene_components(oil, size).collect():
        got.setdefault(x.component, set()).add((x.r, x.c))
    want = {}
    lab = labels(mask)
    for r, c in zip(*np.nonzero(mask), strict=True):
        want.setdefault(lab[r, c], set()).add((int(r), int(c)))
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    assert all(k == min(r * 2**31 + c for r, c in v) for k, v in got.items())


def test_tiles(spark):
    t = raster.tile_grid(spark.createDataFrame([(1, 600, 700)], "scene_id long, height int, width int")).orderBy("row_off", "col_off").collect()
    assert len(t) == 4 and (t[-1].valid_h, t[-1].valid_w, t[-1].pad_h) == (88, 188, 424)
    rows = [(1, 0, 0, 2, 3, [1.0] * 6, [2.0] * 6)]
    tiles = spark.createDataFrame(rows, "scene_id long, row_off long, col_off long, valid_h int, valid_w int, vv array<double>, vh array<double>")
    p = raster.score_tiles(tiles, lambda: raster.corner_predictor, size=4).collect()
    assert len(p) == 6 and [(x.r, x.c) for x in p if x.is_oil] == [(0, 0)]
    assert math.isclose(sum(x.prob for x in p), 0.95)
    a = raster.overlap_average(spark.createDataFrame([(1, 0, 0, 0.2), (1, 0, 0, 0.4)], "scene_id long, r long, c long, prob double")).first()
    assert math.isclose(a.prob, 0.3)
