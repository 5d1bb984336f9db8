import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spillspark.functions import chain, geo, grids
from spillspark.operators import drift, georef
from spillspark.sources import sinks

TIES = [(1, y, x, 120.0 + 0.0004 * x + 0.00003 * y + (x // 100) * 0.001, 30.0 - 0.0003 * y + 0.00002 * x) for y in (0, 100, 200) for x in (0, 100, 300)]
STATS = "scene_id long, component long, n long, r0 long, r1 long, c0 long, c1 long, density double, rank long"


def at(line, pixel):
    """Bilinear by hand."""
    ys, xs = [0, 100, 200], [0, 100, 300]
    line, pixel = min(max(line, 0), 200), min(max(pixel, 0), 300)
    j, i = min(sum(y <= line for y in ys) - 1, 1), min(sum(x <= pixel for x in xs) - 1, 1)
    node = {(y, x): (lon, lat) for _, y, x, lon, lat in TIES}
    ty, tx = (line - ys[j]) / (ys[j + 1] - ys[j]), (pixel - xs[i]) / (xs[i + 1] - xs[i])
    return [
        (node[ys[j], xs[i]][k] * (1 - tx) + node[ys[j], xs[i + 1]][k] * tx) * (1 - ty) + (node[ys[j + 1], xs[i]][k] * (1 - tx) + node[ys[j + 1], xs[i + 1]][k] * tx) * ty
        for k in (0, 1)
    ]


@pytest.fixture(scope="module")
def ties(spark):
    return spark.createDataFrame(TIES, "scene_id long, line long, pixel long, lon double, lat double")


def test_component_on_the_ground(spark, ties):
    stats = spark.createDataFrame([(1, 7, 6, 3, 5, 2, 4, 6 / 9, 1), (1, 9, 1, 60, 60, 90, 90, 1.0, 2)], STATS)
    got = {r.component: r for r in georef.component_shapes(stats, ties, scale=4).collect()}
    r = got[7]
    corners = [at(12, 8), at(12, 20), at(24, 20), at(24, 8)]
    assert np.allclose([(p.x, p.y) for p in r.ring], [*corners, corners[0]], rtol=0, atol=1e-12)
    assert r.zone == 51
    lon, lat = np.array(corners).T
    x, y = drift.utm_numpy(lon, lat, 51)
    area = abs(sum(x[a] * y[(a + 1) % 4] - x[(a + 1) % 4] * y[a] for a in range(4))) / 2
    assert math.isclose(r.area_m2, area * 6 / 9, rel_tol=1e-7)
    assert math.isclose(r.perimeter_m, sum(math.hypot(x[a] - x[a - 1], y[a] - y[a - 1]) for a in range(4)), rel_tol=1e-9)
    assert np.allclose((r.centroid_lon, r.centroid_lat), at(16, 12), atol=1e-12) and r.full_size == 96
    # Beyond the last tie point the box is clamped to the edge.
    assert np.allclose([(p.x, p.y) for p in got[9].ring][2], at(200, 300), atol=1e-12)
    fixed = georef.component_shapes(stats, ties, scale=4, zone=52).where("component = 7").first()
    assert fixed.zone == 52 and math.isclose(fixed.area_m2, r.area_m2, rel_tol=5e-2)


def test_totals_and_features(spark, ties):
    stats = spark.createDataFrame([(1, 7, 6, 3, 5, 2, 4, 6 / 9, 1), (1, 9, 1, 10, 10, 30, 31, 0.5, 2)], STATS)
    shapes = georef.component_shapes(stats, ties)
    counts = spark.createDataFrame([(1, 100, 8, 2, 8.0, 2.0)], "scene_id long, n_valid long, n_oil long, n_core long, oil_percent double, core_percent double")
    t, own = georef.spill_totals(shapes, counts).first(), shapes.collect()
    assert t.n_components == 2 and math.isclose(t.area_m2, sum(r.area_m2 for r in own)) and math.isclose(t.core_area_m2, t.area_m2 / 4)
    lons = [p.x for r in own for p in r.ring]
    assert math.isclose(t.centroid_lon, sum(lons) / 10) and (t.lon_min, t.lon_max) == (min(lons), max(lons))
    f = [json.loads(r.feature) for r in sinks.component_features(shapes, core=True).collect()]
    assert len(f) == 1 and f[0]["geometry"]["type"] == "Polygon" and f[0]["properties"]["component_id"] == 1
    ring = f[0]["geometry"]["coordinates"][0]
    assert len(ring) == 5 and ring[0] == ring[-1] and np.allclose(ring[0], at(3, 2), atol=1e-12)


def test_utm_columns_agree(spark):
    rows = [(lon, lat, zone) for zone in (31, 51, 52) for lon in np.linspace(zone * 6 - 186, zone * 6 - 180, 5).tolist() for lat in (-33.0, 0.0, 31.5, 66.0)]
    df = spark.createDataFrame(rows, "lon double, lat double, zone int")
    levels, x, y = geo.utm_levels("lon", "lat", "zone")
    for r in chain.apply(df, levels, {"x": x, "y": y}).collect():
        ex, ny = drift.utm_numpy(np.array([r.lon]), np.array([r.lat]), r.zone)
        assert abs(r.x - ex[0]) < 1e-6 and abs(r.y - ny[0]) < 1e-6
    back = df.where("zone = 52")
    x, y = geo.to_utm(F.col("lon"), F.col("lat"))
    lon, lat = geo.from_utm(F.col("x"), F.col("y"))
    for r in back.select("lon", "lat", x.alias("x"), y.alias("y")).select("*", lon.alias("lon2"), lat.alias("lat2")).collect():
        assert abs(r.lon - r.lon2) < 1e-9 and abs(r.lat - r.lat2) < 1e-9


def test_incomplete_cells_are_left_out(spark):
    nodes = [(1, y, x, float(y + x)) for y in (0, 10, 20) for x in (0, 10) if (y, x) != (20, 10)]
    grid = spark.createDataFrame(nodes, "f long, y long, x long, v double")
    assert [(r.g_iy, r.g_ix) for r in grids.cells(grid, ["f"], "y", "x", ["v"]).collect()] == [(0, 0)]
    points = spark.createDataFrame([(1, 5, 5, "a"), (1, 15, 5, "b"), (2, 5, 5, "c")], "f long, y long, x long, name string")
    assert [(r.name, r.v) for r in grids.interpolate(points, grid, ["f"], "y", "x", ["v"]).collect()] == [("a", 10.0)]
