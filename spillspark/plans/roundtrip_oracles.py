"""SQL for DuckDB of the queries in ``roundtrips``: what was written, said without writing it."""

from __future__ import annotations

from math import pi

from spillspark.functions import geo
from spillspark.plans.oracles import (
    AIS, BOUNDARY, COUNTS, END, FOUND, GROUND, INC, LITE, MASK, MEASURED, PAIRS, PX, RISK, ROW_HIGH, ROW_WIDE, SCORED, SPILL, STATS, A, _mask_geometry, components, geodesic, hindcast, num, q,
)
from spillspark.sources.derived import DAY_US

SUMS = """sums AS (
  SELECT vessel_id, min(us) AS first_us, avg(speed) AS mean_speed, stddev_pop(heading) AS heading_std,
    arg_min(lon, row(us, lon, lat)) AS lon, arg_min(lat, row(us, lon, lat)) AS lat, 125.0e0 AS x0, 30.0e0 AS y0 FROM ais GROUP BY vessel_id
)"""
WHERE = "closest AS (SELECT incident_id, vessel_id, arg_min(lon, d_m) AS closest_lon, arg_min(lat, d_m) AS closest_lat FROM measured GROUP BY incident_id, vessel_id)"
#: The ring of an impact zone is a regular polygon of 128 corners.
AREA, LENGTH = 64 * 5000.0**2, 2 * 128 * 5000.0


def percent(column: str, p: int) -> str:
    return f"round(quantile_cont({column}, {p / 100}), 6) AS p{p}"


def detected(c: str) -> list[str]:
    """Calibrated and normalised pixels, scored by nv / (c + nv + nh), and their masks."""
    return [
        "a AS (SELECT scene_id, r, c, vv, vh, least(r, 300) * 0.5e0 + least(c, 160) * 0.25e0 AS a FROM px)",
        "db AS (SELECT *, CASE WHEN vv > 0 THEN 10 * log10(greatest(vv * vv / ((400.0e0 + a) * (400.0e0 + a)), 1e-7)) ELSE -50.0 END AS dv, CASE WHEN vh > 0 THEN 10 * log10(greatest(vh * vh / ((500.0e0 + a) * (500.0e0 + a)), 1e-7)) ELSE -50.0 END AS dh FROM a)",
        "n AS (SELECT *, (greatest(-50.0e0, least(5.0e0, dv)) + 50) / 55 AS nv, (greatest(-50.0e0, least(5.0e0, dh)) + 50) / 55 AS nh FROM db)",
        MASK.replace("FROM px", f"FROM (SELECT scene_id, r, c, vv, vh, nv / ({c} + nv + nh) AS prob FROM n)"),
    ]


ORACLE_SQL: dict[str, str] = {
    "csv_reports": q(AIS, "SELECT CASE WHEN user_id % 3 = 0 THEN 'MMSI_' || user_id ELSE vessel_id END AS vessel_id, user_id AS mmsi, us, round(lat, 6) AS lat, round(lon, 6) AS lon, speed, heading FROM ais WHERE event_id % 10 <> 0"),
    "json_reports": q(AIS, "SELECT CASE user_id % 4 WHEN 0 THEN vessel_id WHEN 1 THEN user_id::VARCHAR WHEN 2 THEN 'N' || user_id ELSE 'UNKNOWN' END AS vessel_id, us, true AS mirrored, round(lat, 6) AS lat, round(lon, 6) AS lon, CASE WHEN event_id % 7 = 0 THEN 0.0 ELSE speed END AS speed, heading FROM ais WHERE event_id % 11 <> 0"),
    "environment_files": q(SPILL, "SELECT region_id, round(avg(wind_u), 6) AS wind_u, round(avg(wind_v), 6) AS wind_v, round(avg(cur_u), 6) AS cur_u, round(avg(cur_v), 6) AS cur_v FROM inc GROUP BY region_id"),
    "grid_slices": q(
        AIS, f"cell AS (SELECT user_id % 5 AS field_id, us // {10 * DAY_US} AS time, event_id % 2 AS depth, floor(lat * 4) / 4 AS lat, floor(lon * 4) / 4 AS lon, avg(speed) AS u, avg(heading) AS v FROM ais GROUP BY ALL)",
        "first_time AS (SELECT * FROM cell QUALIFY time = min(time) OVER (PARTITION BY field_id))", "first_depth AS (SELECT * FROM first_time QUALIFY depth = min(depth) OVER (PARTITION BY field_id))",
        "SELECT field_id, lat, lon, round(u, 6) AS u, round(coalesce(v, avg(v) OVER (PARTITION BY field_id)), 6) AS v FROM first_depth",
    ),
    "vector_grid_cells": q(AIS, "k AS (SELECT user_id, speed, heading, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) - 1 AS k, count(*) OVER (PARTITION BY user_id) AS n FROM ais)", "SELECT user_id AS grid_id, k // 4 AS row, k % 4 AS col, speed AS u, coalesce(heading, -1.0) AS v FROM k WHERE n % 4 = 0"),
    "calibration_scan": q(PX, "level AS (SELECT scene_id, round(avg(vv), 3) AS level FROM px GROUP BY scene_id)", "SELECT scene_id, 'VV' AS pol, l AS line, x AS pixel, round(level + l * 0.5e0 + x * 0.25e0, 6) AS a_sigma FROM level, (SELECT unnest(range(0, 301, 50)) AS l) a, (SELECT unnest(range(0, 161, 40)) AS x) b"),
    "pixel_geolocation": q(PX, "SELECT scene_id, r AS line, c AS pixel, round(124 + least(c, 160) * 0.01e0 + scene_id * 0.1e0, 6) AS lon, round(31 - least(r, 300) * 0.005e0, 6) AS lat FROM px WHERE r % 4 = 0 AND c % 4 = 0"),
    "incident_catalogue": "SELECT 'I' || s_suppkey AS incident_id, s_name AS name, 'R' || s_nationkey AS region, s_suppkey * 0.25e0 AS lat, 2::BIGINT AS n_expected, s_name || '.csv' AS ais_file FROM supplier WHERE s_suppkey % 7 <> 0",
    "format_classes": "SELECT CASE p_partkey % 7 WHEN 0 THEN 'CSV' WHEN 1 THEN 'JSON' WHEN 2 THEN 'NetCDF' WHEN 3 THEN 'GeoTIFF' WHEN 4 THEN 'ZIP' WHEN 5 THEN 'UNKNOWN' ELSE 'NetCDF' END AS kind, count(*)::BIGINT AS n FROM part GROUP BY 1",
    "summary_aliases": q(AIS, SUMS, geodesic("sums", "s", "d", "vessel_id, first_us, mean_speed, heading_std", "lon", "lat", "x0", "y0"), "SELECT vessel_id, first_us, CASE WHEN substr(vessel_id, 2)::BIGINT % 5 <= 2 THEN round(d, 1) ELSE 0.0 END AS distance_m, round(mean_speed, 6) AS speed, round(heading_std, 4) AS course FROM s"),
    "vessel_keys": """SELECT c_custkey AS ordinal,
  CASE WHEN c_custkey % 2 = 1 THEN 'C' || c_custkey WHEN c_custkey % 3 = 0 THEN c_custkey || '.0' WHEN c_custkey % 7 = 0 THEN c_name ELSE 'UNKNOWN' END AS key_id,
  CASE WHEN c_custkey % 5 = 0 THEN c_name WHEN c_custkey % 3 = 0 THEN 'MMSI_' || c_custkey ELSE 'UNKNOWN' END AS key_name,
  CASE WHEN c_custkey % 2 = 1 THEN 'C' || c_custkey WHEN c_custkey % 3 = 0 THEN c_custkey || '.0' WHEN c_custkey % 5 = 0 THEN c_name WHEN c_custkey % 7 = 0 THEN c_name ELSE 'VESSEL-' || c_custkey END AS key_truthy FROM customer""",
    "input_validation": """WITH up AS (
  SELECT o_custkey AS a, ['sentinel', 'wind', 'current', 'ais'][(o_orderkey % 4)::INT + 1] AS category, bool_or(o_orderkey % 3 <> 0) AS valid FROM orders GROUP BY 1, 2
), need AS (
  SELECT a, c, CASE WHEN c = 'sentinel' OR a % 2 = 0 AND c = 'ais' THEN 'error' ELSE 'warning' END AS severity FROM (SELECT DISTINCT o_custkey AS a FROM orders), (SELECT unnest(['sentinel', 'wind', 'current', 'ais']) AS c)
), lack AS (SELECT need.* FROM need LEFT JOIN up ON up.a = need.a AND category = c WHERE NOT coalesce(valid, false)
) SELECT d.a AS analysis_id, coalesce(string_agg(CASE WHEN severity = 'error' THEN c END, ',' ORDER BY c), '') AS errors, coalesce(string_agg(CASE WHEN severity = 'warning' THEN c END, ',' ORDER BY c), '') AS warnings,
  coalesce(count_if(severity = 'error'), 0) = 0 AS can_run FROM (SELECT DISTINCT a FROM need) d LEFT JOIN lack USING (a) GROUP BY d.a""",
    "closest_points": q(*LITE, WHERE, "SELECT vessel_id, 'Point' AS kind, round(closest_lon, 6) AS lon, round(closest_lat, 6) AS lat, d_source_km, score FROM topped JOIN closest USING (incident_id, vessel_id) WHERE rank <= 3"),
    "zone_polygons": q(SPILL, f"SELECT incident_id, 'Polygon' AS kind, 129::BIGINT AS n_points, round({num(AREA)} * sin({num(2 * pi / 128)}), 0) AS area_m2, round({num(LENGTH)} * sin({num(pi / 128)}), 1) AS length_m, 10000.0e0 AS width_m FROM inc"),
    "component_shapes": q(
        PX, MASK, components(""), STATS, *GROUND, "few AS (SELECT *, count(*) OVER (PARTITION BY scene_id) AS n_all FROM ground)",
        "SELECT rank::BIGINT AS component_id, round(ground_m2, 2) AS area_m2, round(ground_m2 / 1e6, 4) AS area_km2, round(outline_m, 2) AS perimeter_m, round(lat4, 6) AS centroid_lat, round(lon4, 6) AS centroid_lon, n AS pixel_count_approx, 'Polygon' AS kind, 5::BIGINT AS n_points, "
        + ", ".join(f"round(lon{k}, 9) AS lon{k}, round(lat{k}, 9) AS lat{k}" for k in range(3)) + " FROM few WHERE rank <= greatest(1, n_all // 4)", recursive=True,
    ),
    "result_documents": q(*RISK, "SELECT incident_id, (CASE WHEN incident_id = 3 THEN -1 ELSE 1 END * count(*) OVER (PARTITION BY incident_id))::BIGINT AS n, vessel_id, risk_level, d_trajectory_km FROM risk"),
    "raster_tiles": q(PX, "SELECT scene_id, r // 32 * 32 AS row_off, c // 32 * 32 AS col_off, count(*)::BIGINT AS n, round(sum(prob), 6) AS prob FROM px WHERE r >= 32 AND r < 96 GROUP BY 1, 2, 3"),
    "outline_rings": q(PX, MASK, components(""), BOUNDARY, "SELECT scene_id, component, 1::BIGINT AS n_shells, n_holes, f::BIGINT AS area, sides, n_corners, 0::BIGINT AS n_open FROM boundary", recursive=True),
    "spill_polygons": q(PX, MASK, components(""), BOUNDARY, "SELECT scene_id, component, 'MultiPolygon' AS type, n_holes, n_corners, true AS closed, round(124.5e0 + 0.01e0 * c0, 6) AS lon_min, round(30.8e0 - 0.005e0 * r0, 6) AS lat_max, 2::BIGINT AS axes, round(area_m2, 1) AS area_m2, round(perimeter_m, 2) AS perimeter_m FROM boundary", recursive=True),
    "tile_grid": q(PX, "size AS (SELECT scene_id, max(r) + 1 AS h, max(c) + 1 AS w FROM px GROUP BY scene_id)", "t AS (SELECT scene_id, h, w, y AS row_off, unnest(range(0, w, 48)) AS col_off FROM (SELECT *, unnest(range(0, h, 48)) AS y FROM size))", "SELECT scene_id, row_off, col_off, least(48, h - row_off) AS valid_h, least(48, w - col_off) AS valid_w, 48 - least(48, h - row_off) AS pad_h, 48 - least(48, w - col_off) AS pad_w FROM t"),
    "overlap_mean": q(PX, "SELECT scene_id, r, c, round(CASE WHEN r % 8 < 4 THEN prob * 0.75e0 ELSE prob END, 6) AS prob FROM px"),
    "band_join": q(PX.replace("px AS", "every AS", 1), "px AS (SELECT * FROM every WHERE vv >= 2 AND vh <> 5)", MASK, COUNTS, "SELECT *, n_pixels - n_valid AS n_invalid, round(100.0e0 * n_oil / nullif(n_valid, 0), 4) AS oil_percent, round(100.0e0 * n_core / nullif(n_valid, 0), 4) AS core_percent FROM counts"),
    "turned_outline": q(PX, MASK, """core AS (SELECT scene_id, r, c FROM mask WHERE core), corner AS (
  SELECT scene_id, 8.0e0 * (c + j) + 3.0e0 * (r + i) + 1000 AS x, 6.0e0 * (c + j) - 4.0e0 * (r + i) + 5000 AS y FROM core, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) k(i, j)
), box AS (SELECT scene_id, min(x) AS x_min, min(y) AS y_min, max(x) AS x_max, max(y) AS y_max FROM corner GROUP BY scene_id
), open AS (
  SELECT k.scene_id, sum(CASE WHEN d.dr = 0 THEN 5.0e0 ELSE 10.0e0 END) AS perimeter_m FROM core k, (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) d(dr, dc)
  WHERE NOT EXISTS (SELECT 1 FROM core o WHERE o.scene_id = k.scene_id AND o.r = k.r + d.dr AND o.c = k.c + d.dc) GROUP BY k.scene_id
)""", """SELECT s.scene_id, count(k.r)::BIGINT AS pixel_count, count(k.r) * 50.0e0 AS area_m2, round(coalesce(any_value(perimeter_m), 0), 4) AS perimeter_m,
  round(8.0e0 * (avg(c) + 0.5e0) + 3.0e0 * (avg(r) + 0.5e0) + 1000, 4) AS centroid_x, round(6.0e0 * (avg(c) + 0.5e0) - 4.0e0 * (avg(r) + 0.5e0) + 5000, 4) AS centroid_y,
  any_value(x_min) AS x_min, any_value(y_min) AS y_min, any_value(x_max) AS x_max, any_value(y_max) AS y_max
FROM (SELECT DISTINCT scene_id FROM px) s LEFT JOIN core k USING (scene_id) LEFT JOIN box USING (scene_id) LEFT JOIN open USING (scene_id) GROUP BY s.scene_id"""),
    "analysis_view": q(PX, MASK, _mask_geometry(0.01, 124.5, -0.005, 30.8), f"SELECT scene_id AS analysis_id, 'complete' AS status, coalesce((SELECT round(sum({ROW_WIDE} * {ROW_HIGH}), 0) FROM core WHERE core.scene_id = outline.scene_id), 0) AS area_m2, round(centroid_x, 6) AS lon, round(centroid_y, 6) AS lat, round((x_max - x_min) * (y_max - y_min), 6) AS box_area, 5::BIGINT AS n_corners, 'V' || scene_id AS top_vessel, round(pixel_count / 1000, 6) AS top_score FROM outline"),
    "leg_speeds": q(
        AIS, "lagged AS (SELECT vessel_id, us, lon, lat, lag(lon) OVER w AS lon_b, lag(lat) OVER w AS lat_b, lag(us) OVER w AS us_b FROM ais WINDOW w AS (PARTITION BY vessel_id ORDER BY us, lon, lat)), kept AS (SELECT * FROM lagged WHERE us > us_b)",
        geodesic("kept", "legs", "leg_m", "vessel_id, us, us_b, lon, lat, lon_b, lat_b", "lon_b", "lat_b", "lon", "lat"),
        f"SELECT vessel_id, us, round(leg_m / ((us - us_b) / 1e6) * {num(geo.KNOTS)}, 4) AS knots, CASE WHEN sqrt((lon - lon_b) * (lon - lon_b) + (lat - lat_b) * (lat - lat_b)) < 1e-6 THEN 'Stationary' ELSE list_extract({geo.COMPASS_8!r}, (floor((((degrees(atan2(lon - lon_b, lat - lat_b)) + 360) % 360) + 22.5) / 45)::INT % 8) + 1) END AS direction FROM legs",
    ),
    "scene_detection": q(PX, *detected("0.25e0"), "SELECT scene_id, round(min(prob), 6) AS p_min, round(max(prob), 6) AS p_max, round(avg(prob), 6) AS p_mean, " + ", ".join(percent("prob", k) for k in (10, 50, 99)) + ", count(*)::BIGINT AS n_pixels, count_if(valid)::BIGINT AS n_valid, count_if(oil)::BIGINT AS n_oil, count_if(core)::BIGINT AS n_core FROM mask GROUP BY scene_id"),
    "full_investigation": q(
        AIS, PX, *detected("0.02e0"), COUNTS, components(""), STATS, *GROUND,
        "totals AS (SELECT scene_id, count(*)::BIGINT AS n_components, sum(ground_m2) AS area_m2, avg((2 * lon0 + lon1 + lon2 + lon3) / 5) AS centroid_lon, avg((2 * lat0 + lat1 + lat2 + lat3) / 5) AS centroid_lat FROM ground GROUP BY scene_id)",
        f"spot0 AS (SELECT scene_id AS incident_id, scene_id % 5 AS region_id, {10 * DAY_US} AS target_us, centroid_lon AS lon0, centroid_lat AS lat0 FROM totals)",
        *[p.replace("FROM inc)", "FROM spot0)") for p in hindcast(24)],
        "inc AS (SELECT incident_id, lon AS lon0, lat AS lat0, us AS target_us, radius_m / 1000 AS radius_km FROM way WHERE step = 24)",
        PAIRS, MEASURED, FOUND, "wp AS (SELECT a.vessel_id, a.lon AS vlon, a.lat AS vlat, w.incident_id, w.lon AS wlon, w.lat AS wlat FROM (SELECT DISTINCT vessel_id, lon, lat FROM ais) a, way w)",
        geodesic("wp", "wp1", "d_way", "vessel_id, incident_id", "vlon", "vlat", "wlon", "wlat"),
        "wmin AS (SELECT incident_id, vessel_id, round(min(d_way) / 1000, 2) AS d_trajectory_km FROM wp1 GROUP BY incident_id, vessel_id)",
        "with_path AS (SELECT * FROM evidence JOIN wmin USING (incident_id, vessel_id))", SCORED.format(source="with_path"),
        """SELECT i.scene_id AS incident_id, round(area_m2, 1) AS area_m2, n_components, n_oil, round(centroid_lon, 7) AS centroid_lon, round(o.lon0, 5) AS origin_lon, round(o.lat0, 5) AS origin_lat, o.target_us AS origin_us,
  vessel_id, rank, d_source_km, d_trajectory_km, in_zone_count, score FROM (SELECT DISTINCT scene_id FROM px) i LEFT JOIN (totals JOIN counts USING (scene_id)) t USING (scene_id) LEFT JOIN inc o ON o.incident_id = i.scene_id LEFT JOIN (SELECT * FROM topped WHERE rank <= 10) r ON r.incident_id = i.scene_id""",
        recursive=True,
    ),
}
