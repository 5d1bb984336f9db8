"""The registered queries as SQL for DuckDB, over the same tables."""

from __future__ import annotations

from math import pi

from spillspark.functions import chain, geo
from spillspark.sources.derived import AIS_SQL, DAY_US, INCIDENTS_SQL, PIXELS_SQL, SPILLS_SQL, TIES_SQL

AIS = f"ais AS ({AIS_SQL})"
INC = f"inc AS ({INCIDENTS_SQL})"
SPILL = f"inc AS ({SPILLS_SQL})"  # instead of INC
PX = f"px AS ({PIXELS_SQL})"
A = geo.A


def num(x: float) -> str:
    """A literal that is a double."""
    return repr(x) if "e" in repr(x) else f"{x!r}e0"


def q(*parts: str, recursive: bool = False) -> str:
    """The last part selects; the others are common table expressions."""
    return f"WITH {'RECURSIVE ' * recursive}" + ",\n".join(parts[:-1]) + "\n" + parts[-1]


def geodesic(source: str, name: str, out: str, columns: str, *ends: str) -> str:
    levels, d = geo.geodesic_levels(*ends)
    return chain.ctes(source, name, levels, {out: d}, columns)


# -- attribution --------------------------------------------------------------

PAIRS = "pairs AS (SELECT a.vessel_id, a.lon, a.lat, a.us, a.speed, a.heading, i.incident_id, i.lon0, i.lat0, i.target_us, i.radius_km FROM ais a, inc i)"
MEASURED = geodesic("pairs", "measured", "d_m", "vessel_id, lon, lat, us, speed, heading, incident_id, lon0, lat0, target_us, radius_km", "lon", "lat", "lon0", "lat0")
FOUND = f"""found AS (
  SELECT incident_id, vessel_id, count(*)::BIGINT AS record_count, min(us) AS first_us, max(us) AS last_us,
    min(d_m) AS d_m, arg_min(us, row(d_m, us)) AS closest_us, sum(CASE WHEN d_m <= radius_km * 1000 THEN 1 ELSE 0 END)::BIGINT AS in_zone_count,
    round(avg(speed), 2) AS mean_speed, round(stddev_pop(heading), 2) AS heading_std,
    any_value(radius_km) AS radius_km, any_value(target_us) AS target_us
  FROM measured GROUP BY incident_id, vessel_id
), evidence AS (
  SELECT *, round(d_m / 1000, 2) AS d_source_km, round(abs(closest_us - target_us) / {DAY_US}, 2) AS dt_days FROM found
)"""
SCORED = """scored AS (
  SELECT *, exp(-d_source_km / greatest(10.0, 2 * radius_km)) AS s1, exp(-dt_days / 10.0) AS s2,
    exp(-d_trajectory_km / greatest(10.0, 2 * radius_km)) AS s3, coalesce(exp(-heading_std / 30.0), 0.5) AS s4 FROM {source}
), ranked AS (
  SELECT *, round(s1, 4) AS spatial_score, round(s2, 4) AS temporal_score, round(s3, 4) AS trajectory_score, round(s4, 4) AS heading_score,
    round(0.0e0 + 0.35e0 * s1 + 0.30e0 * s2 + 0.20e0 * s3 + 0.15e0 * s4, 4) AS score FROM scored
), topped AS (
  SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY score DESC, first_us, vessel_id)::BIGINT AS rank FROM ranked
)"""
LITE = [AIS, INC, PAIRS, MEASURED, FOUND, "with_path AS (SELECT *, d_source_km AS d_trajectory_km FROM evidence)", SCORED.format(source="with_path")]

MERCATOR = f"{A!r}e0 * radians({{lon}}) AS mx0, {A!r}e0 * ln(tan({pi / 4!r}e0 + radians({{lat}}) / 2)) AS my0"


def simulated(source: str, name: str, n: int, step_s: int, sign: int) -> str:
    return f"""{name}_v AS (
  SELECT *, {sign}e0 * (cur_u + wind_u * 0.03e0) AS vx, {sign}e0 * (cur_v + wind_v * 0.03e0) AS vy, {MERCATOR.format(lon='lon0', lat='lat0')} FROM {source}
), {name}_m AS (
  SELECT v.*, s.step, mx0 + vx * {step_s} * s.step AS mx, my0 + vy * {step_s} * s.step AS my
  FROM {name}_v v, (SELECT unnest(range(0, {n + 1}))::INT AS step) s
), {name} AS (
  SELECT *, degrees(mx / {A!r}e0) AS lon, degrees(2 * atan(exp(my / {A!r}e0)) - {pi / 2!r}e0) AS lat,
    target_us + step::BIGINT * {sign * step_s * 1_000_000} AS us FROM {name}_m
)"""


def hindcast(n: int) -> list[str]:
    """Steps of an hour backward through the linear field, on UTM zone 52, step after step (recursive)."""
    radius, forward, inverse, latitude = geo._series()
    e = (geo.FLATTENING * (2 - geo.FLATTENING)) ** 0.5
    size = num(0.9996 * radius)
    series = lambda k, f, g, a, b: " + ".join(f"{num(x)} * {f}({2 * (i + 1)} * {a}) * {g}({2 * (i + 1)} * {b})" for i, x in enumerate(k))
    speed = "0.2500137e0 + 0.125e0 * ((lat - 27) / 2) + 0.03e0 * (region_id * 2.0e0 + (lon - 122) / 2) AS vx, region_id * -0.1250193e0 - 0.0000171e0 + 0.0625e0 * ((lon - 122) / 2) + 0.03e0 * (5.0e0 - (lat - 27) / 2) AS vy"
    return [
        "w1 AS (SELECT *, sin(radians(lat0)) AS s, radians(lon0 - 129.0e0) AS dl FROM inc)",
        f"w2 AS (SELECT *, sinh(atanh(s) - {num(e)} * atanh({num(e)} * s)) AS t FROM w1)",
        "w3 AS (SELECT *, atan2(t, cos(dl)) AS xi, asinh(sin(dl) / sqrt(t * t + cos(dl) * cos(dl))) AS eta FROM w2)",
        f"""path AS (
  SELECT incident_id, region_id, target_us, 0 AS step, lon0 AS lon, lat0 AS lat, 500000.0e0 + {size} * (eta + {series(forward, 'cos', 'sinh', 'xi', 'eta')}) AS x, {size} * (xi + {series(forward, 'sin', 'cosh', 'xi', 'eta')}) AS y FROM w3
  UNION ALL
  SELECT incident_id, region_id, target_us, step, degrees(atan2(sinh(b), cos(a))) + 129 AS lon, degrees(chi + """
        + " + ".join(f"{num(k)} * sin({2 * (j + 1)} * chi)" for j, k in enumerate(latitude))
        + f""") AS lat, x, y FROM (
    SELECT *, asin(sin(a) / cosh(b)) AS chi FROM (
      SELECT *, xi - ({series(inverse, 'sin', 'cosh', 'xi', 'eta')}) AS a, eta - ({series(inverse, 'cos', 'sinh', 'xi', 'eta')}) AS b FROM (
        SELECT *, y / {size} AS xi, (x - 500000.0e0) / {size} AS eta FROM (
          SELECT incident_id, region_id, target_us, step + 1 AS step, x - vx * 3600 AS x, y - vy * 3600 AS y FROM (SELECT *, {speed} FROM path WHERE step < {n})))))
)""",
        f"way AS (SELECT incident_id, step::INT AS step, target_us - step * 3600000000 AS us, lon, lat, vx, vy, 5000.0e0 + 300.0e0 * step AS radius_m FROM (SELECT *, {speed} FROM path))",
    ]


LATEST = "latest AS (SELECT vessel_id, max(row(us, lon, lat, speed, coalesce(heading, -1))) AS m FROM ais GROUP BY vessel_id), last AS (SELECT a.vessel_id, a.us, a.lon, a.lat, a.speed, a.heading FROM ais a JOIN (SELECT vessel_id, max(us) AS us FROM ais GROUP BY vessel_id) b USING (vessel_id, us))"

# -- search areas -------------------------------------------------------------


def near(source: str, hours: int, name: str = "near") -> str:
    """Plain range join: no cells."""
    cols = "event_id, vessel_id, lon, lat, us, speed, heading, incident_id, lon0, lat0, target_us, radius_km"
    pairs = f"{name}_p AS (SELECT a.event_id, a.vessel_id, a.lon, a.lat, a.us, a.speed, a.heading, i.incident_id, i.lon0, i.lat0, i.target_us, i.radius_km FROM ais a, {source} i WHERE abs(a.us - i.target_us) <= {hours * 3_600_000_000})"
    return pairs + ",\n" + geodesic(f"{name}_p", f"{name}_g", "d_m", cols, "lon", "lat", "lon0", "lat0") + f",\n{name} AS (SELECT * FROM {name}_g WHERE d_m <= radius_km * 1000)"


def summaries(source: str) -> str:
    first = f"""sums AS (
  SELECT incident_id, vessel_id, count(*)::BIGINT AS n, min(us) AS first_us, max(us) AS last_us, avg(speed) AS mean_speed, stddev_pop(heading) AS heading_std,
    arg_min(lon, row(us, lon, lat)) AS lon, arg_min(lat, row(us, lon, lat)) AS lat, any_value(lon0) AS lon0, any_value(lat0) AS lat0, any_value(target_us) AS target_us
  FROM {source} GROUP BY incident_id, vessel_id
)"""
    return first + ",\n" + geodesic("sums", "summaries", "distance_m", "*", "lon", "lat", "lon0", "lat0")


PROTOTYPE = """base AS (
  SELECT incident_id, vessel_id, first_us, round(distance_m, 2) AS d, coalesce(round(heading_std, 4), 0.0) AS h, abs(first_us - target_us) / 1e6 AS t FROM summaries
), bounds AS (
  SELECT incident_id, min(d) AS d0, max(d) AS d1, min(h) AS h0, max(h) AS h1, min(t) AS t0, max(t) AS t1 FROM base GROUP BY incident_id
), parts AS (
  SELECT incident_id, vessel_id, first_us, 1.0e0 AS s,
    CASE WHEN t IS NULL THEN 0.0 WHEN t1 > t0 THEN 1 - (t - t0) / (t1 - t0) ELSE 1.0 END AS tp,
    CASE WHEN h1 > h0 THEN 1 - (h - h0) / (h1 - h0) ELSE 1.0 END AS tr,
    CASE WHEN d1 > d0 THEN 1 - (d - d0) / (d1 - d0) ELSE 1.0 END AS hc
  FROM base JOIN bounds USING (incident_id)
), proto AS (
  SELECT incident_id, vessel_id, first_us, round(0.0e0 + 0.25e0 * s + 0.25e0 * tp + 0.25e0 * tr + 0.25e0 * hc, 3) AS overall_score,
    round(s, 3) AS spatial_proximity, round(tp, 3) AS temporal_proximity, round(tr, 3) AS trajectory_consistency, round(hc, 3) AS heading_consistency FROM parts
), proto_ranked AS (
  SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY overall_score DESC, first_us, vessel_id)::BIGINT AS rank FROM proto
)"""

#: After PROTOTYPE: distance counts as spatial and the spread as heading; the reasons in words.
OWN_MODE = """own AS (
  SELECT p.incident_id, p.vessel_id, p.first_us, round(0.0e0 + 0.25e0 * hc + 0.25e0 * tp + 0.25e0 * tr + 0.25e0 * tr, 3) AS overall_score, round(hc, 3) AS spatial_proximity, round(tr, 3) AS heading_consistency,
    'Distance ' || printf('%.1f', round(d, 1)) || ' m from estimated origin' AS told_spatial, '|observation - spill time| = ' || printf('%.1f', round(t, 1)) || ' s' AS told_temporal,
    'Heading variance ' || printf('%.1f', round(h, 1)) || ' deg' AS told_trajectory, 'Proximity based on distance ' || printf('%.1f', round(d, 1)) || ' m' AS told_heading
  FROM parts p JOIN base b USING (incident_id, vessel_id)
)"""

# -- risk ---------------------------------------------------------------------

END = f"""ends_v AS (
  SELECT incident_id, lon0, lat0, cur_u + wind_u * 0.03e0 AS vx, cur_v + wind_v * 0.03e0 AS vy, {MERCATOR.format(lon='lon0', lat='lat0')} FROM inc
), ends_m AS (SELECT *, mx0 + vx * 600.0e0 * 36 AS mx, my0 + vy * 600.0e0 * 36 AS my FROM ends_v
), ends AS (
  SELECT *, degrees(mx / {A!r}e0) AS end_lon, degrees(2 * atan(exp(my / {A!r}e0)) - {pi / 2!r}e0) AS end_lat, 5.0e0 AS radius_zone_km, sqrt(vx * vx + vy * vy) AS speed_m_s FROM ends_m
)"""
RISK = [
    AIS, INC, LATEST, END, simulated("inc", "way", 36, 600, 1),
    "rp AS (SELECT l.vessel_id, l.lon, l.lat, l.speed, l.heading, e.incident_id, e.lon0, e.lat0, e.end_lon, e.end_lat, e.radius_zone_km, e.speed_m_s FROM last l, ends e)",
    geodesic("rp", "rp1", "d_spill", "vessel_id, lon, lat, speed, heading, incident_id, lon0, lat0, end_lon, end_lat, radius_zone_km, speed_m_s", "lon", "lat", "lon0", "lat0"),
    geodesic("rp1", "rp2", "d_impact", "*", "lon", "lat", "end_lon", "end_lat").replace("SELECT *, d_spill", "SELECT *, d_spill"),
    "wp AS (SELECT l.vessel_id, l.lon AS vlon, l.lat AS vlat, w.incident_id, w.step, w.lon AS wlon, w.lat AS wlat FROM last l, way w)",
    geodesic("wp", "wp1", "d_way", "vessel_id, incident_id, step", "vlon", "vlat", "wlon", "wlat"),
    "wmin AS (SELECT incident_id, vessel_id, min(d_way) AS d_way, arg_min(step, row(d_way, step)) AS step FROM wp1 GROUP BY incident_id, vessel_id)",
    """risk AS (
  SELECT r.incident_id, r.vessel_id,
    CASE WHEN d_impact / 1000 <= radius_zone_km OR d_way / 1000 <= 3 THEN 'HIGH' WHEN d_way / 1000 <= 10 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
    round(d_spill / 1000, 2) AS d_spill_km, round(d_way / 1000, 2) AS d_trajectory_km, round(d_impact / 1000, 2) AS d_impact_km,
    (d_impact / 1000 <= radius_zone_km OR d_way / 1000 <= 3) AS inside_impact_zone,
    CASE WHEN speed_m_s > 0.05 THEN round(w.step * 600.0e0 / 60, 1) END AS slick_closest_minutes,
    round(speed, 1) AS speed_knots, round(heading, 1) AS heading_deg, round(lon, 6) AS lon,
    CASE WHEN d_impact / 1000 <= radius_zone_km OR d_way / 1000 <= 3 THEN 'HIGH RISK: Vessel is directly within the predicted impact zone (' || printf('%.1f', round(d_way / 1000, 1)) || ' km from forecast path, ' || printf('%.1f', round(d_impact / 1000, 1)) || ' km from impact center). Immediate advisory warning and evasive action recommended.'
      WHEN d_way / 1000 <= 10 THEN 'MEDIUM RISK: Vessel is within the 10 km warning corridor (' || printf('%.1f', round(d_way / 1000, 1)) || ' km from predicted drift track). Precautionary monitoring active.'
      ELSE 'LOW RISK: Vessel is outside the immediate warning distance (' || printf('%.1f', round(d_way / 1000, 1)) || ' km from predicted track) but remains within the regional forecast domain.' END AS explanation
  FROM rp2 r JOIN wmin w USING (incident_id, vessel_id)
)""",
]

# -- raster -------------------------------------------------------------------

MASK = "mask AS (SELECT *, (vv > 0 AND vh > 0) AS valid, (vv > 0 AND vh > 0 AND prob >= 0.5) AS oil, (vv > 0 AND vh > 0 AND prob >= 0.7) AS core FROM px)"
COUNTS = """counts AS (
  SELECT scene_id, count(*)::BIGINT AS n_pixels, count_if(valid)::BIGINT AS n_valid, count_if(oil)::BIGINT AS n_oil, count_if(core)::BIGINT AS n_core FROM mask GROUP BY scene_id
)"""


def components(tile: str) -> str:
    """Smallest pixel number reachable over 4-neighbours; ``tile`` keeps a step inside."""
    return f"""oil AS MATERIALIZED (SELECT scene_id, r, c, r * 2147483648 + c AS p FROM mask WHERE oil
), step AS MATERIALIZED (
  SELECT a.p AS a, b.p AS b, a.scene_id FROM oil a JOIN oil b ON a.scene_id = b.scene_id AND abs(a.r - b.r) + abs(a.c - b.c) = 1
    AND b.r IN (a.r - 1, a.r, a.r + 1){tile}
), reach(scene_id, p, q) AS (
  SELECT scene_id, p, p FROM oil
  UNION
  SELECT x.scene_id, s.b, x.q FROM reach x JOIN step s ON s.scene_id = x.scene_id AND s.a = x.p WHERE s.b > x.q
), label AS (SELECT scene_id, p, min(q) AS component FROM reach GROUP BY scene_id, p
)"""


# A pixel number spreads upwards only; a component's least number reaches all of it
# unless its way goes through smaller numbers, and none of its pixels is smaller.
IN_TILE = " AND a.r // 8 = b.r // 8 AND a.c // 8 = b.c // 8"
STATS = """shapes AS (
  SELECT scene_id, component, count(*)::BIGINT AS n, min(p // 2147483648) AS r0, max(p // 2147483648) AS r1, min(p % 2147483648) AS c0, max(p % 2147483648) AS c1 FROM label GROUP BY scene_id, component
), dense AS (
  SELECT *, n / ((r1 - r0 + 1) * (c1 - c0 + 1)) AS density, row_number() OVER (PARTITION BY scene_id ORDER BY n DESC, component)::BIGINT AS rank FROM shapes
), geometry AS (
  SELECT *, (r1 - r0 + 1) * 10.0e0 * ((c1 - c0 + 1) * 10.0e0) * density AS area_m2, 2 * ((r1 - r0 + 1) * 10.0e0 + (c1 - c0 + 1) * 10.0e0) AS perimeter_m FROM dense WHERE n >= 2
)"""
TIES = f"ties AS MATERIALIZED ({TIES_SQL})"
_CORNERS = "(VALUES (0, 0, 0), (1, 0, 1), (2, 1, 1), (3, 1, 0), (4, NULL, NULL)) v(k, i, j)"
_LEVELS, _EAST, _NORTH = geo.utm_levels("lon", "lat", "zone")


def _between(v: str) -> str:
    return f"(a.{v} * (1 - tx) + b.{v} * tx) * (1 - ty) + (c.{v} * (1 - tx) + d.{v} * tx) * ty AS {v}"


def _k(k: int, v: str) -> str:
    return f"max(CASE WHEN k = {k} THEN {v} END) AS {v}{k}"


#: Component boxes of STATS on the ground: each corner between the four tie points around it.
GROUND = [
    TIES,
    f"""spot AS (
  SELECT scene_id, component, k, coalesce(CASE i WHEN 0 THEN r0 WHEN 1 THEN r1 + 1 END, (r0 + r1) / 2.0e0) AS line, coalesce(CASE j WHEN 0 THEN c0 WHEN 1 THEN c1 + 1 END, (c0 + c1) / 2.0e0) AS pixel
  FROM geometry, {_CORNERS}
), cell AS (SELECT *, least(floor(line / 50), 5) * 50 AS y0, least(floor(pixel / 40), 3) * 40 AS x0 FROM spot
), share AS (SELECT *, (line - y0) / 50.0e0 AS ty, (pixel - x0) / 40.0e0 AS tx FROM cell
), zoned AS (SELECT scene_id, least(60, greatest(1, floor((avg(lon) + 180) / 6) + 1)) AS zone FROM ties GROUP BY scene_id
), warped AS (
  SELECT s.scene_id, s.component, s.k, zone, {_between('lon')}, {_between('lat')} FROM share s JOIN zoned USING (scene_id)
    JOIN ties a ON a.scene_id = s.scene_id AND a.line = y0 AND a.pixel = x0 JOIN ties b ON b.scene_id = s.scene_id AND b.line = y0 AND b.pixel = x0 + 40
    JOIN ties c ON c.scene_id = s.scene_id AND c.line = y0 + 50 AND c.pixel = x0 JOIN ties d ON d.scene_id = s.scene_id AND d.line = y0 + 50 AND d.pixel = x0 + 40
)""",
    chain.ctes("warped", "metric", _LEVELS, {"x": _EAST, "y": _NORTH}, "scene_id, component, k, zone, lon, lat"),
    f"""quad AS (
  SELECT scene_id, component, any_value(zone)::BIGINT AS zone, {", ".join(_k(k, v) for k in range(5) for v in ("lon", "lat", "x", "y"))} FROM metric GROUP BY scene_id, component
), ground AS (
  SELECT g.scene_id, g.component, rank, n, q.*  EXCLUDE (scene_id, component),
    abs((x1 - x0) * (y2 - y0) - (x2 - x0) * (y1 - y0) + (x2 - x0) * (y3 - y0) - (x3 - x0) * (y2 - y0)) / 2 * g.density AS ground_m2,
    sqrt(power(x1 - x0, 2) + power(y1 - y0, 2)) + sqrt(power(x2 - x1, 2) + power(y2 - y1, 2)) + sqrt(power(x3 - x2, 2) + power(y3 - y2, 2)) + sqrt(power(x0 - x3, 2) + power(y0 - y3, 2)) AS outline_m
  FROM geometry g JOIN quad q USING (scene_id, component)
)""",
]
GRID = "grid AS (SELECT f.field_id, 33.0e0 - iy * 0.5e0 AS lat, 123.0e0 + ix * 0.75e0 AS lon, (ix - 4) * 0.5e0 + field_id * 0.25e0 AS u, (iy - 3) * 0.25e0 + ix * 0.125e0 AS v FROM (SELECT DISTINCT region_id AS field_id FROM inc) f, (SELECT unnest(range(0, 10)) AS iy) a, (SELECT unnest(range(0, 10)) AS ix) b)"


def _mask_geometry(a: float, x0: float, e: float, y0: float) -> str:
    return f"""core AS (SELECT scene_id, r, c FROM mask WHERE core
), open AS (
  SELECT k.scene_id, sum(CASE WHEN d.dr = 0 THEN {abs(e)!r}e0 ELSE {abs(a)!r}e0 END) AS perimeter_m
  FROM core k, (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) d(dr, dc)
  WHERE NOT EXISTS (SELECT 1 FROM core o WHERE o.scene_id = k.scene_id AND o.r = k.r + d.dr AND o.c = k.c + d.dc) GROUP BY k.scene_id
), outline AS (
  SELECT s.scene_id, count(k.r) > 0 AS has_oil, count(k.r)::BIGINT AS pixel_count, count(k.r) * {num(abs(a * e))} AS area_m2, coalesce(any_value(o.perimeter_m), 0.0) AS perimeter_m,
    {x0!r}e0 + {a!r}e0 * (avg(k.c) + 0.5e0) AS centroid_x, {y0!r}e0 + {e!r}e0 * (avg(k.r) + 0.5e0) AS centroid_y,
    {x0!r}e0 + {a!r}e0 * min(k.c) AS x_min, {y0!r}e0 + {e!r}e0 * (max(k.r) + 1) AS y_min, {x0!r}e0 + {a!r}e0 * (max(k.c) + 1) AS x_max, {y0!r}e0 + {e!r}e0 * min(k.r) AS y_max
  FROM (SELECT DISTINCT scene_id FROM mask) s LEFT JOIN core k USING (scene_id) LEFT JOIN open o USING (scene_id) GROUP BY s.scene_id
)"""


def _northing(lat: str) -> str:
    return f"{A!r}e0 * ln(tan({pi / 4!r}e0 + radians({lat}) / 2))"


#: Area and outline in EPSG:3857 of a pixel row of 0.01 by 0.005 degrees from (124.5, 30.8).
ROW_WIDE = f"({A!r}e0 * radians(0.01e0))"
ROW_HIGH = f"({_northing('30.8e0 - 0.005e0 * r')} - {_northing('30.8e0 - 0.005e0 * (r + 1)')})"
#: Per component: shapes of its boundary from the pixels around each lattice point, by Euler's formula.
BOUNDARY = f"""pix AS MATERIALIZED (SELECT scene_id, component, p // 2147483648 AS r, p % 2147483648 AS c FROM label
), point AS (
  SELECT scene_id, component, r + i AS y, c + j AS x, count(*) AS n, sum(CASE WHEN i = j THEN 1 ELSE -1 END) AS diagonal FROM pix, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) v(i, j) GROUP BY ALL
), points AS (SELECT scene_id, component, count(*) AS v, sum(CASE WHEN n IN (1, 3) THEN 1 WHEN n = 2 AND abs(diagonal) = 2 THEN 2 ELSE 0 END)::BIGINT AS n_corners FROM point GROUP BY scene_id, component
), edge AS (
  SELECT scene_id, component, k, CASE WHEN k < 2 THEN r + k ELSE r END AS y, CASE WHEN k > 1 THEN c + k - 2 ELSE c END AS x, k // 2 AS upright, min(r) AS r, count(*) AS n
  FROM pix, (SELECT unnest(range(4)) AS k) GROUP BY ALL
), sides AS (SELECT scene_id, component, upright, y, x, min(r) AS r, sum(n) AS n FROM edge GROUP BY ALL
), edges AS (
  SELECT scene_id, component, count(*) AS e, count_if(n = 1)::BIGINT AS sides, sum(CASE WHEN n > 1 THEN 0 WHEN upright = 1 THEN {ROW_HIGH} ELSE {ROW_WIDE} END) AS perimeter_m FROM sides GROUP BY scene_id, component
), faces AS (SELECT scene_id, component, count(*) AS f, sum({ROW_WIDE} * {ROW_HIGH}) AS area_m2, min(c) AS c0, min(r) AS r0 FROM pix GROUP BY scene_id, component
), boundary AS (SELECT *, (1 - (v - e + f))::BIGINT AS n_holes FROM points JOIN edges USING (scene_id, component) JOIN faces USING (scene_id, component))"""


TRACKS = "pts AS (SELECT vessel_id, us, lon, lat, row_number() OVER (PARTITION BY vessel_id ORDER BY us, lon, lat) - 1 AS k, count(*) OVER (PARTITION BY vessel_id) AS n FROM ais)"
DETAIL = "vessel AS (SELECT vessel_id, 'NAME_' || vessel_id AS vessel_name, lon, lat, speed FROM last)"

ORACLE_SQL: dict[str, str] = {
    "vessel_attribution_topk": q(*LITE, "SELECT incident_id, vessel_id, rank, record_count, d_source_km, dt_days, in_zone_count, mean_speed, heading_std, spatial_score, temporal_score, trajectory_score, heading_score, score FROM topped WHERE rank <= 3"),
    "historical_attribution": q(
        AIS, INC, PAIRS, MEASURED, FOUND, simulated("inc", "way", 3, 28800, -1),
        "wp AS (SELECT a.vessel_id, a.lon AS vlon, a.lat AS vlat, w.incident_id, w.lon AS wlon, w.lat AS wlat FROM ais a, way w)",
        geodesic("wp", "wp1", "d_way", "vessel_id, incident_id", "vlon", "vlat", "wlon", "wlat"),
        "wmin AS (SELECT incident_id, vessel_id, round(min(d_way) / 1000, 2) AS d_trajectory_km FROM wp1 GROUP BY incident_id, vessel_id)",
        "with_path AS (SELECT * FROM evidence JOIN wmin USING (incident_id, vessel_id))", SCORED.format(source="with_path"),
        "SELECT incident_id, vessel_id, rank, d_source_km, d_trajectory_km, trajectory_score, score FROM topped WHERE rank <= 10",
    ),
    "evidence_sentences": q(*LITE, """SELECT *, line_1 AS by_spatial, line_2 AS by_temporal, line_3 AS by_trajectory, line_4 AS by_track FROM (SELECT incident_id, rank, vessel_id,
  CASE WHEN in_zone_count > 0 THEN 'Vessel AIS observations intersect the estimated source zone (' || in_zone_count || ' records within ' || printf('%.1f', round(radius_km, 1)) || ' km).'
    ELSE 'Closest approach is ' || printf('%.1f', round(d_source_km, 1)) || ' km from the estimated source centroid.' END AS line_1,
  'Closest temporal approach occurred at ' || strftime(TIMESTAMP '2024-01-01 00:00:00' + to_microseconds(closest_us), '%Y-%m-%dT%H:%M:%SZ') || ' (delta: ' || printf('%.1f', round(dt_days, 1)) || ' days from hindcast epoch).' AS line_2,
  CASE WHEN record_count >= 2 THEN 'Reconstructed track contains ' || record_count || ' AIS points with mean speed ' || mean_speed || ' knots.'
    ELSE 'Single isolated AIS transmission recorded (' || record_count || ' observation).' END AS line_4,
  'Minimum distance to reconstructed backward drift trajectory is ' || printf('%.1f', round(d_trajectory_km, 1)) || ' km.' AS line_3, 4::BIGINT AS n_categories
FROM topped WHERE rank <= 3)"""),
    "evidence_matrix": q(*LITE, """SELECT incident_id, f.factor,
  max(CASE WHEN rank = 1 THEN f.v END) AS rank_1, max(CASE WHEN rank = 2 THEN f.v END) AS rank_2, max(CASE WHEN rank = 3 THEN f.v END) AS rank_3
FROM (SELECT incident_id, rank, unnest([{'factor': 'spatial', 'v': spatial_score}, {'factor': 'temporal', 'v': temporal_score}, {'factor': 'trajectory', 'v': trajectory_score}, {'factor': 'heading', 'v': heading_score}]) AS f FROM topped WHERE rank <= 3) GROUP BY incident_id, f.factor"""),
    "evidence_flags": q(*LITE, """SELECT incident_id, rank, f.factor AS factor, CASE WHEN f.v > 0.4 THEN 'match' ELSE 'warning' END AS status, round(100 * f.v)::BIGINT AS percent
FROM (SELECT incident_id, rank, unnest([{'factor': 'spatial', 'v': spatial_score}, {'factor': 'temporal', 'v': temporal_score}, {'factor': 'trajectory', 'v': trajectory_score}, {'factor': 'heading', 'v': heading_score}]) AS f FROM topped WHERE rank <= 3)"""),
    "candidate_details": q(*LITE, LATEST, DETAIL, """SELECT t.incident_id, t.rank, v.vessel_name, round(v.lon, 6) AS lon, round(v.lat, 6) AS lat, v.speed FROM topped t LEFT JOIN vessel v USING (vessel_id) WHERE t.rank <= 3"""),
    "contextual_traffic": q(*LITE, "SELECT vessel_id, CASE WHEN vessel_id IN (SELECT vessel_id FROM topped WHERE rank <= 3) THEN 'ranked' ELSE 'context' END AS kind FROM (SELECT DISTINCT vessel_id FROM ais)"),
    "ais_area_window_summary": q(AIS, INC, near("inc", 48), summaries("near"), """SELECT incident_id, vessel_id, n, first_us, last_us, (last_us - first_us) / 1e6 AS duration_s, round(mean_speed, 6) AS mean_speed, round(heading_std, 3) AS heading_std, round(distance_m, 3) AS distance_m FROM summaries"""),
    "prototype_explanations": q(AIS, INC, near("inc", 48), summaries("near"), PROTOTYPE, OWN_MODE,
        "SELECT incident_id, vessel_id, row_number() OVER (PARTITION BY incident_id ORDER BY overall_score DESC, first_us, vessel_id)::BIGINT AS rank, overall_score, spatial_proximity, heading_consistency, told_spatial, told_temporal, told_trajectory, told_heading FROM own",
    ),
    "prototype_scores": q(AIS, INC, near("inc", 48), summaries("near"), PROTOTYPE, "SELECT incident_id, vessel_id, rank, overall_score, spatial_proximity, temporal_proximity, trajectory_consistency, heading_consistency FROM proto_ranked"),
    "latest_position": q(AIS, LATEST, "SELECT vessel_id, us, round(lon, 6) AS lon, round(lat, 6) AS lat, speed, heading FROM last"),
    "track_legs": q(
        AIS, "lagged AS (SELECT vessel_id, us, lon, lat, lag(lon) OVER w AS lon_b, lag(lat) OVER w AS lat_b, lag(us) OVER w AS us_b FROM ais WINDOW w AS (PARTITION BY vessel_id ORDER BY us, lon, lat)), kept AS (SELECT * FROM lagged WHERE us_b IS NOT NULL)",
        geodesic("kept", "legs", "leg_m", "vessel_id, us, us_b", "lon_b", "lat_b", "lon", "lat"),
        "SELECT vessel_id, us, round(leg_m, 2) AS leg_m, round((us - us_b) / 1e6, 2) AS leg_s FROM legs",
    ),
    "track_progress": q(AIS, TRACKS, """SELECT a.vessel_id, a.n::BIGINT AS n, round(a.lon + (b.lon - a.lon) * ((a.n - 1) * 0.375e0 - a.k), 8) AS lon, round(a.lat + (b.lat - a.lat) * ((a.n - 1) * 0.375e0 - a.k), 8) AS lat, (a.k + 2)::BIGINT AS n_path
FROM pts a JOIN pts b ON a.vessel_id = b.vessel_id AND b.k = least(a.k + 1, a.n - 1) WHERE a.k = floor((a.n - 1) * 0.375e0)"""),
    "track_lines": q(AIS, TRACKS, "SELECT vessel_id, 'LineString' AS geometry_type, n::BIGINT AS n_points, round(lon, 6) AS first_lon FROM pts WHERE k = 0 AND n >= 2"),
    "ais_dataset_stats": q(AIS, "SELECT count(*)::BIGINT AS n_rows, count(DISTINCT vessel_id)::BIGINT AS n_vessels, min(us) AS first_us, max(us) AS last_us FROM ais"),
    "search_area_cell_join": q(AIS, INC, near("inc", 72), "SELECT incident_id, event_id, vessel_id, round(d_m, 2) AS d_m FROM near"),
    "polygon_window_filter": q(AIS, INC, f"""corner AS (
  SELECT incident_id, lon0 + 0.0e0 AS ax, lat0 + 0.0e0 AS ay, lon0 + 0.9e0 AS bx, lat0 + 0.1e0 AS by_, lon0 + 0.5e0 AS cx, lat0 + 0.7e0 AS cy, target_us FROM inc
), side AS (
  SELECT a.event_id, a.vessel_id, k.incident_id,
    sign((bx - ax) * (lat - ay) - (by_ - ay) * (lon - ax)) AS s1, sign((cx - bx) * (lat - by_) - (cy - by_) * (lon - bx)) AS s2, sign((ax - cx) * (lat - cy) - (ay - cy) * (lon - cx)) AS s3
  FROM ais a, corner k WHERE a.us BETWEEN target_us - {3 * DAY_US} AND target_us + {3 * DAY_US}
)""", "SELECT incident_id, event_id, vessel_id FROM side WHERE s1 > 0 AND s2 > 0 AND s3 > 0"),
    "drift_forward": q(SPILL, simulated("inc", "way", 24, 1800, 1), "SELECT incident_id, step, round(lon, 6) AS lon, round(lat, 6) AS lat, us, round(vx, 6) AS vx, round(vy, 6) AS vy FROM way"),
    "drift_backward": q(
        SPILL, simulated("inc", "way", 24, 3600, -1),
        "leg AS (SELECT incident_id, step, lon, lat, us, coalesce(lag(lon) OVER w, lon) AS lon_b, coalesce(lag(lat) OVER w, lat) AS lat_b FROM way WINDOW w AS (PARTITION BY incident_id ORDER BY step))",
        geodesic("leg", "legs", "leg_m", "incident_id, step, lon, lat, us", "lon_b", "lat_b", "lon", "lat"),
        "SELECT incident_id, step, round(lon, 6) AS lon, round(lat, 6) AS lat, us, round(sum(leg_m) OVER (PARTITION BY incident_id ORDER BY step), 2) AS path_m FROM legs",
    ),
    "impact_zone": q(
        SPILL, END, geodesic("ends", "told", "drift_m", "*", "lon0", "lat0", "end_lon", "end_lat"),
        f"""SELECT incident_id, round(end_lon, 6) AS end_lon, round(end_lat, 6) AS end_lat, radius_zone_km, round(speed_m_s, 4) AS speed_m_s,
  CASE WHEN speed_m_s < 1e-6 THEN 'Stationary' ELSE list_extract({geo.COMPASS!r}, (floor((((degrees(atan2(vx, vy)) + 360) % 360) + 11.25) / 22.5)::INT % 16) + 1) END AS direction,
  round(drift_m / 1000, 4) AS drift_km, 129::BIGINT AS n_ring, round(degrees((mx + 5000.0e0 * cos({-pi / 2!r}e0)) / {A!r}e0), 6) AS south_lon,
  round(degrees(2 * atan(exp((my - 5000.0e0) / {A!r}e0)) - {pi / 2!r}e0), 6) AS south_lat FROM told""",
    ),
    "vessel_risk": q(*RISK, "SELECT incident_id, vessel_id, risk_level, d_spill_km, d_trajectory_km, d_impact_km, inside_impact_zone, slick_closest_minutes, speed_knots, heading_deg, explanation FROM risk"),
    "risk_order": q(*RISK, "SELECT concat(vessel_id, '/', incident_id) AS vessel_incident, risk_level, d_trajectory_km FROM risk ORDER BY CASE risk_level WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 3 END, d_trajectory_km, vessel_incident LIMIT 20"),
    "synthetic_distances": q(
        AIS, "moved AS (SELECT event_id, vessel_id, us, user_id % 2 = 0 AS flat, CASE WHEN user_id % 2 = 0 THEN 1000 + 100 * lon ELSE lon END AS lon, CASE WHEN user_id % 2 = 0 THEN 1000 + 100 * lat ELSE lat END AS lat FROM ais)",
        "lagged AS (SELECT *, lag(lon) OVER w AS lon_b, lag(lat) OVER w AS lat_b FROM moved WINDOW w AS (PARTITION BY vessel_id ORDER BY us, event_id))",
        "kept AS (SELECT * FROM lagged WHERE lon_b IS NOT NULL AND NOT flat)", geodesic("kept", "legs", "leg_m", "event_id", "lon_b", "lat_b", "lon", "lat"),
        "SELECT event_id, round(leg_m, 3) AS leg_m FROM legs UNION ALL SELECT event_id, round(sqrt(power(lon - lon_b, 2) + power(lat - lat_b, 2)), 3) FROM lagged WHERE lon_b IS NOT NULL AND flat",
    ),
    "risk_counts": q(*RISK, "SELECT incident_id, count_if(risk_level = 'HIGH')::BIGINT AS n_high, count_if(risk_level = 'MEDIUM')::BIGINT AS n_medium, count_if(risk_level = 'LOW')::BIGINT AS n_low FROM risk GROUP BY incident_id"),
    "risk_features": q(*RISK, "SELECT incident_id, vessel_id, risk_level, lon FROM risk"),
    "kpi_overview": q(SPILL, "SELECT count(*)::BIGINT AS n_incidents, count_if(radius_km >= 35)::BIGINT AS n_high, round(sum(radius_km * radius_km), 1) AS area_km2 FROM inc"),
    "grid_interpolate": q(SPILL, GRID, """axis AS (
  SELECT incident_id, region_id AS field_id, lon0, lat0, floor((lon0 - 123.0e0) / 0.75e0) AS ix, floor((lat0 - 28.5e0) / 0.5e0) AS jy FROM inc
), t AS (SELECT *, (lon0 - 123.0e0 - ix * 0.75e0) / 0.75e0 AS tx, (lat0 - 28.5e0 - jy * 0.5e0) / 0.5e0 AS ty FROM axis
)""", """SELECT incident_id, t.field_id,
  round(sum(g.u * (CASE WHEN g.lon > 123.0e0 + (ix + 0.5e0) * 0.75e0 THEN tx ELSE 1 - tx END) * (CASE WHEN g.lat > 28.5e0 + (jy + 0.5e0) * 0.5e0 THEN ty ELSE 1 - ty END)), 6) AS u,
  round(sum(g.v * (CASE WHEN g.lon > 123.0e0 + (ix + 0.5e0) * 0.75e0 THEN tx ELSE 1 - tx END) * (CASE WHEN g.lat > 28.5e0 + (jy + 0.5e0) * 0.5e0 THEN ty ELSE 1 - ty END)), 6) AS v
FROM t JOIN grid g ON g.field_id = t.field_id AND abs(g.lon - 123.0e0 - (ix + 0.5e0) * 0.75e0) < 0.4e0 AND abs(g.lat - 28.5e0 - (jy + 0.5e0) * 0.5e0) < 0.3e0 GROUP BY incident_id, t.field_id"""),
    "sar_calibrate": q(PX, "SELECT scene_id, r, c, round(a, 6) AS a, round(CASE WHEN vv > 0 THEN 10 * log10(greatest(vv * vv / (a * a), 1e-7)) ELSE -50.0 END, 6) AS db FROM (SELECT *, 400.0e0 + least(r, 300) * 0.5e0 + least(c, 160) * 0.25e0 AS a FROM px)"),
    "sar_normalise": q(PX, "SELECT scene_id, r, c, round((greatest(-50.0e0, least(5.0e0, CASE WHEN vh > 0 THEN 10 * log10(greatest(vh * vh / (25.0e0 * 25.0e0), 1e-7)) ELSE -50.0 END)) + 50) / 55, 6) AS vh_norm FROM px"),
    "mask_counts": q(PX, MASK, COUNTS, "SELECT *, n_pixels - n_valid AS n_invalid, round(100.0e0 * n_oil / nullif(n_valid, 0), 4) AS oil_percent, round(100.0e0 * n_core / nullif(n_valid, 0), 4) AS core_percent FROM counts"),
    "scene_stats": q(PX, "SELECT scene_id, round(min(prob), 6) AS p_min, round(max(prob), 6) AS p_max, round(avg(prob), 6) AS p_mean, round(sum(prob), 4) AS p_sum, count_if(prob >= 0.5)::BIGINT AS n_oil FROM px GROUP BY scene_id"),
    "scene_percentiles": q(PX, "SELECT scene_id, " + ", ".join(f"round(quantile_cont(prob, {p / 100}), 6) AS p{p}" for p in (10, 25, 50, 75, 90, 95, 99)) + " FROM px GROUP BY scene_id"),
    "downsample": q(PX, "SELECT scene_id, r // 4 AS r, c // 4 AS c, round(prob, 6) AS prob FROM px WHERE r % 4 = 0 AND c % 4 = 0"),
    "mask_geometry": q(PX, MASK, _mask_geometry(10.0, 1000.0, -10.0, 5000.0), "SELECT scene_id, has_oil, pixel_count, area_m2, perimeter_m, round(centroid_x, 4) AS centroid_x, round(centroid_y, 4) AS centroid_y, x_min, y_min, x_max, y_max FROM outline"),
    "components_tile": q(PX, MASK, components(IN_TILE), "SELECT scene_id, component, count(*)::BIGINT AS n FROM label GROUP BY scene_id, component", recursive=True),
    "components_scene": q(PX, MASK, components(""), STATS, "SELECT scene_id, component, n, r0, r1, c0, c1, round(density, 6) AS density FROM dense", recursive=True),
    "top_components": q(PX, MASK, components(""), STATS, "SELECT scene_id, rank, n, round(area_m2, 4) AS area_m2, perimeter_m, (r0 + r1) / 2.0e0 AS centre_r, (c0 + c1) / 2.0e0 AS centre_c FROM geometry WHERE rank <= 10", recursive=True),
    "georeferenced_components": q(PX, MASK, components(""), STATS, *GROUND, """SELECT scene_id, rank, n, zone, round(ground_m2, 1) AS area_m2, round(outline_m, 1) AS perimeter_m, round(lon4, 9) AS centroid_lon, round(lat4, 9) AS centroid_lat,
  """ + ", ".join(f"round(lon{k}, 9) AS lon{k}, round(lat{k}, 9) AS lat{k}" for k in range(4)) + ", round(x0, 3) AS x0, round(y0, 3) AS y0, round(x2, 3) AS x2, round(y2, 3) AS y2 FROM ground", recursive=True),
    "spill_totals": q(PX, MASK, COUNTS, components(""), STATS, *GROUND, """totals AS (
  SELECT scene_id, count(*)::BIGINT AS n_components, any_value(zone) AS zone, sum(ground_m2) AS area_m2, sum(outline_m) AS perimeter_m,
    avg((2 * lon0 + lon1 + lon2 + lon3) / 5) AS centroid_lon, avg((2 * lat0 + lat1 + lat2 + lat3) / 5) AS centroid_lat,
    """ + ", ".join(f"min(least({v}0, {v}1, {v}2, {v}3)) AS {v}_min, max(greatest({v}0, {v}1, {v}2, {v}3)) AS {v}_max" for v in ("lon", "lat", "x", "y")) + """ FROM ground GROUP BY scene_id
)""", "SELECT scene_id, n_components, zone, round(area_m2, 1) AS area_m2, round(perimeter_m, 1) AS perimeter_m, round(centroid_lon, 9) AS centroid_lon, round(centroid_lat, 9) AS centroid_lat, "
        + ", ".join(f"round({v}_{e}, {9 if v[0] == 'l' else 3}) AS {v}_{e}" for v in ("lon", "lat", "x", "y") for e in ("min", "max"))
        + ", n_valid, n_oil, n_core, round(100.0e0 * n_oil / nullif(n_valid, 0), 4) AS oil_percent, round(100.0e0 * n_core / nullif(n_valid, 0), 4) AS core_percent, round(area_m2 * n_core / greatest(n_oil, 1), 1) AS core_area_m2 FROM totals JOIN counts USING (scene_id)", recursive=True),
    "tile_scoring": q(PX, "SELECT scene_id, r, c, round(vv / (1 + vv + vh), 6) AS prob, (vv / (1 + vv + vh) >= 0.5)::INT AS is_oil FROM px"),
    "incident_readiness": q(SPILL, """f AS (
  SELECT incident_id, u.kind AS kind, u.present AS present FROM (SELECT incident_id, unnest([
    {'kind': 'ais', 'present': (incident_id + 1) % 2 <> 0 OR (incident_id + 1) % 3 <> 0},
    {'kind': 'wind', 'present': (incident_id + 1) % 4 <> 0}, {'kind': 'vv', 'present': (incident_id + 1) % 5 <> 0}]) AS u FROM inc)
)""", """SELECT incident_id, CASE WHEN bool_and(present) AND incident_id % 6 <> 0 THEN 'ready' ELSE 'missing_inputs' END AS status, count_if(NOT present)::BIGINT AS n_missing,
  coalesce(string_agg(CASE WHEN NOT present THEN kind END, ',' ORDER BY kind), '') AS missing FROM f GROUP BY incident_id"""),
    "incremental_pending": q(AIS, INC, PAIRS, MEASURED, FOUND, "SELECT incident_id, name FROM inc WHERE incident_id NOT IN (SELECT incident_id FROM evidence WHERE d_source_km <= 2)"),
    "geojson_features": q(SPILL, simulated("inc", "way", 3, 3600, 1), """SELECT incident_id, 1 AS kind, step, 'Point' AS geometry_type, step::BIGINT AS told_step FROM way
UNION ALL SELECT incident_id, 0, NULL, 'LineString', NULL FROM inc"""),
    "report_facts": q(*LITE, f"SELECT i.incident_id, i.name, round(i.lon0, 6) AS lon0, round(i.lat0, 6) AS lat0, round({pi!r}e0 * i.radius_km * i.radius_km, 2) AS area_km2, t.vessel_id, t.score, 4::BIGINT AS n_evidence FROM inc i LEFT JOIN topped t ON t.incident_id = i.incident_id AND t.rank = 1"),
    "candidate_distances": q(AIS, INC, LATEST, "d AS (SELECT incident_id, vessel_id, sqrt(power((lon - lon0) * 111.0e0 * cos(radians(lat0)), 2) + power((lat - lat0) * 111.0e0, 2)) AS km FROM last, inc)", "SELECT incident_id, vessel_id, round(km, 4) AS flat_km FROM d WHERE km <= 60"),
    "hindcast_grid": q(SPILL, *hindcast(24), "SELECT incident_id, step, us, round(lon, 5) AS lon, round(lat, 5) AS lat, round(vx, 5) AS vx, round(vy, 5) AS vy, radius_m FROM way", recursive=True),
    "mask_to_candidates": q(
        AIS, PX, MASK, _mask_geometry(0.01, 124.5, -0.005, 30.8),
        f"start AS (SELECT scene_id AS incident_id, centroid_x AS lon0, centroid_y AS lat0, {10 * DAY_US} AS target_us, 4.0e0 AS wind_u, -2.0e0 AS wind_v, 0.2e0 AS cur_u, 0.1e0 AS cur_v FROM outline WHERE has_oil)",
        simulated("start", "back", 1, 86400, -1), "origin AS (SELECT incident_id, lon AS lon0, lat AS lat0, target_us, 40.0e0 AS radius_km FROM back WHERE step = 1)",
        near("origin", 120), summaries("near"), PROTOTYPE,
        "SELECT incident_id, vessel_id, rank, overall_score, temporal_proximity, heading_consistency FROM proto_ranked WHERE rank <= 20",
    ),
}
