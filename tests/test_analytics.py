"""Attribution, risk, drift and tracks on small fixtures with known values."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from spillspark.operators import attribution, catalog, drift, joins, risk, tracks
from spillspark.sources import sinks

BASE = dt.datetime(2024, 1, 1)
REPORT = "vessel_id string, lon double, lat double, us long, speed double, heading double"


def us(text):
    return int((dt.datetime.fromisoformat(text) - BASE).total_seconds() * 1e6)


def zone(spark, **more):
    row = {"incident_id": 1, "lon0": 125.0, "lat0": 30.0, "target_us": us("2018-01-14"), "radius_km": 50.0, "wind_u": 10.0, "wind_v": 0.0, "cur_u": 0.2, "cur_v": 0.0} | more
    return spark.createDataFrame([tuple(row.values())], "incident_id long, lon0 double, lat0 double, target_us long, radius_km double, wind_u double, wind_v double, cur_u double, cur_v double")


def test_scores_of_known_evidence(spark):
    """Rounded evidence of three vessels and their scores."""
    rows = [
        (1, "ALPHA", 2, 0, 7.35, 7.35, 0.04, 0.5, 50.0, 2, 10.0),
        (1, "GAMMA", 1, 0, 29.4, 29.4, 1.25, None, 50.0, 1, 9.0),
        (1, "BETA", 1, 0, 742.13, 742.13, 3.5, 0.0, 50.0, 0, 8.0),
    ]
    found = spark.createDataFrame(rows, "incident_id long, vessel_id string, record_count long, first_us long, d_source_km double, d_trajectory_km double, dt_days double, heading_std double, radius_km double, in_zone_count long, mean_speed double").withColumn("closest_us", F.lit(us("2018-01-14T01:00:00")))
    ranks = attribution.ranked(attribution.scored(found))
    got = {r.vessel_id: r for r in ranks.collect()}
    assert [round(got[v].score, 4) for v in ("ALPHA", "GAMMA", "BETA")] == [0.9573, 0.7497, 0.3617]
    assert [got[v].rank for v in ("ALPHA", "GAMMA", "BETA")] == [1, 2, 3] and got["GAMMA"].heading_score == 0.5
    told = {r.vessel_id: r for r in attribution.categories(attribution.evidence_lines(ranks)).collect()}
    assert told["ALPHA"].evidence[0] == "Vessel AIS observations intersect the estimated source zone (2 records within 50.0 km)."
    assert told["BETA"].evidence[0] == "Closest approach is 742.1 km from the estimated source centroid."
    assert told["BETA"].evidence[1].startswith("Closest temporal approach occurred at 2018-01-14T01:00:00Z (delta: 3.5 days")
    assert told["BETA"].evidence[3] == "Single isolated AIS transmission recorded (1 observation)."
    assert set(told["ALPHA"].by_category) == {"spatial", "temporal", "trajectory", "track"}
    assert told["BETA"].by_category["track"] == told["BETA"].evidence[3] and told["ALPHA"].by_category["spatial"] == told["ALPHA"].evidence[0]
    wide = {r.factor: r for r in attribution.matrix(ranks).collect()}
    assert wide["heading"].rank_2 == 0.5 and wide["spatial"].rank_1 == got["ALPHA"].spatial_score
    flags = attribution.evidence_flags(ranks).where("vessel_id = 'BETA'").first().flags
    assert [(f.factor, f.status) for f in flags][0] == ("spatial", "warning") and flags[3].percent == 100


def test_evidence_times_come_from_the_closest_report(spark):
    rows = [("A", 125.0, 30.0, us("2018-01-15"), 5.0, 10.0), ("A", 126.0, 30.0, us("2018-01-14"), 7.0, 20.0), ("B", 125.0, 31.0, us("2018-01-14"), None, None)]
    got = {r.vessel_id: r for r in attribution.evidence(spark.createDataFrame(rows, REPORT), zone(spark)).collect()}
    a, b = got["A"], got["B"]
    assert (a.d_source_km, a.dt_days, a.in_zone_count, a.record_count, a.mean_speed, a.heading_std) == (0.0, 1.0, 1, 2, 6.0, 5.0)
    assert b.heading_std is None and b.mean_speed is None and abs(b.d_source_km - 110.86) < 0.02


def test_prototype_order_and_missing_times(spark):
    rows = [(1, "V1", 2000.0, 100, 5.0, 0), (1, "V2", 1000.0, None, 15.0, 0), (1, "V3", 1000.0, 300_000_000, 5.0, 0)]
    p = attribution.prototype(spark.createDataFrame(rows, "incident_id long, vessel_id string, distance_m double, first_us long, heading_spread double, target_us long"))
    got = {r.vessel_id: r for r in p.collect()}
    assert got["V2"].temporal_proximity == 0.0 and got["V2"].explanations["temporal"].startswith("Observation timestamp unavailable")
    assert got["V1"].spatial_proximity == 1.0 and got["V1"].heading_consistency == 0.0 and got["V3"].overall_score == 0.75
    assert sorted(r.rank for r in got.values()) == [1, 2, 3]


def test_risk_fleet(spark):
    """One vessel of each tier, and the forecast's own numbers."""
    t = us("2018-01-14")
    rows = [("V_TANKER_101", 125.0735, 30.0, t, 8.0, 90.0), ("V_CARGO_202", 125.09, 30.045, t, 9.0, 80.0), ("V_TRAWLER_303", 125.09, 30.225, t, 3.0, 0.0), ("V_TANKER_101", 120.0, 20.0, t - 1, 8.0, 90.0)]
    steps, end = risk.forecast(zone(spark), 6.0)
    e = end.first()
    assert steps.count() == 37 and e.direction == "East" and e.radius_zone_km == 5.0 and abs(e.drift_m / 1000 - 9.36) < 0.01 and len(e.ring) == 129
    got = {r.vessel_id: r for r in risk.ordered(risk.assess(spark.createDataFrame(rows, REPORT), zone(spark))).collect()}
    assert {k: r.risk_level for k, r in got.items()} == {"V_TANKER_101": "HIGH", "V_CARGO_202": "MEDIUM", "V_TRAWLER_303": "LOW"}
    assert got["V_TANKER_101"].slick_closest_minutes > 0 and got["V_TANKER_101"].explanation.startswith("HIGH RISK")
    n = risk.counts(risk.assess(spark.createDataFrame(rows, REPORT), zone(spark))).first()
    assert (n.n_high, n.n_medium, n.n_low) == (1, 1, 1)


def test_drift_displacement(spark):
    z = zone(spark, wind_u=2.0, cur_u=0.5)
    got = drift.simulate(z, 1, 3600).orderBy("step").collect()
    assert len(got) == 2
    x = [r.x for r in drift.simulate(z, 1, 3600).select("step", (F.radians("lon") * 6378137.0).alias("x")).orderBy("step").collect()]
    assert abs(x[1] - x[0] - 2016) < 1e-6
    back = drift.simulate(z, 1, 3600, direction="backward").where("step = 1").first()
    assert back.lon < 125 and back.us == us("2018-01-14") - 3_600_000_000
    with pytest.raises(ValueError):
        drift.velocity(direction="sideways")


def grid(spark):
    rows = [("f", 28.0 + i, 125.0 + j, float("nan") if (i, j) == (0, 0) else 10.0, 0.0, 0.0, 0.5) for i in range(4) for j in range(4)]
    return spark.createDataFrame(rows, "field_id string, lat double, lon double, wind_u double, wind_v double, cur_u double, cur_v double")


def test_hindcast_moves_against_wind_and_current(spark):
    starts = spark.createDataFrame([(1, "f", 126.5, 29.5, 0), (2, "f", 126.6, 29.4, 0)], "incident_id long, field_id string, lon0 double, lat0 double, target_us long")
    got = drift.hindcast(starts, grid(spark), 10, 3600, block=1).where("incident_id = 1").orderBy("step").collect()
    assert len(got) == 11 and got[-1].lon < got[0].lon and got[-1].lat < got[0].lat
    assert all(a.radius_m < b.radius_m for a, b in zip(got, got[1:], strict=False)) and abs(got[0].lon - 126.5) < 1e-9


def test_interpolation(spark):
    g = spark.createDataFrame([(1, 30.0 - i, 1.0 + j, float(10 * (2 * i + j)), float("nan") if i else 1.0) for i in range(2) for j in range(2)], "field_id int, lat double, lon double, u double, v double")
    p = spark.createDataFrame([(1, 1.5, 29.5), (1, -50.0, 99.0)], "field_id int, lon double, lat double")
    got = sorted(r.u for r in drift.interpolate(p, g).collect())
    assert got == [0.0, 15.0]
    assert [r.v for r in drift.fill_grid(g).collect()] == [1.0] * 4


def test_search_area_loses_nothing(spark):
    rows = [(f"V{k}", -180 + 0.37 * (k * 53 % 973), -60 + 0.13 * (k * 37 % 911), 0, 1.0, 1.0) for k in range(900)] + [("W", 179.99, 10.0, 0, 1.0, 1.0), ("E", -179.99, 10.0, 0, 1.0, 1.0)]
    zones = spark.createDataFrame([(1, 179.95, 10.0, 0, 30.0), (2, -100.0, 40.0, 0, 900.0), (3, 0.0, -50.0, 0, 400.0)], "incident_id long, lon0 double, lat0 double, target_us long, radius_km double")
    reports = spark.createDataFrame(rows, REPORT)
    got = {(r.incident_id, r.vessel_id) for r in joins.search_area_join(reports, zones, hours=1).collect()}
    from spillspark.functions import geo

    every = geo.with_geodesic(reports.crossJoin(zones), "d", "lon", "lat", "lon0", "lat0").select("incident_id", "vessel_id", "d", "radius_km").collect()
    assert got == {(r.incident_id, r.vessel_id) for r in every if r.d <= r.radius_km * 1000} and {(1, "W"), (1, "E")} <= got


def test_tracks(spark):
    rows = [("A", 1.0, 2.0, 30, 1.0, 350.0), ("A", 0.0, 0.0, 10, 3.0, 10.0), ("A", 0.5, 1.0, None, 2.0, None), ("B", 5.0, 5.0, 1, 1.0, 1.0)]
    r = spark.createDataFrame(rows, REPORT)
    t = {x.vessel_id: x for x in tracks.group_tracks(r).collect()}
    assert [p.us for p in t["A"].points] == [None, 10, 30]
    assert tracks.latest(r).where("vessel_id = 'A'").first().us == 30
    s = tracks.summarize(r.where("us is not null").withColumns({"x0": F.lit(0.0), "y0": F.lit(0.0)}), "x0", "y0").where("vessel_id = 'A'").first()
    assert s.distance_m == 0 and s.mean_speed == 2.0 and s.heading_std == 170.0 and abs(s.heading_std_circular - 10) < 0.1
    at = tracks.progress(tracks.group_tracks(r.where("us is not null")), 50).where("vessel_id = 'A'").first()
    assert (at.lon, at.lat, len(at.path)) == (0.5, 1.0, 2)
    lines = sinks.track_features(tracks.group_tracks(r)).collect()
    assert [x.vessel_id for x in lines] == ["A"]


def test_details_and_context(spark):
    c = spark.createDataFrame([("1", "ONE"), ("x", "TWO"), ("9", "NINE")], "vessel_id string, vessel_name string")
    v = spark.createDataFrame([("1", "OTHER", 7), ("2", "TWO", 8), ("3", "THREE", 9)], "vessel_id string, vessel_name string, length int")
    assert {r.vessel_id: r.length for r in joins.details_by_id_or_name(c, v).collect()} == {"1": 7, "x": 8, "9": None}
    assert [r.vessel_id for r in joins.not_among(v, c).collect()] == ["3"]


def test_catalogue(spark):
    i = spark.createDataFrame([("a", {"ais": "x.json", "wind": "w.nc"}), ("b", {"ais": "x.json"})], "incident_id string, expected_files map<string,string>")
    files = catalog.files_present(i, spark.createDataFrame([("a", "ais.csv"), ("b", "other")], "incident_id string, name string"))
    got = {r.incident_id: (r.status, r.missing) for r in catalog.readiness(files, i.select("incident_id", F.lit(True).alias("model_present"))).collect()}
    assert got == {"a": ("missing_inputs", ["wind"]), "b": ("missing_inputs", ["ais"])}
    rules = spark.createDataFrame([("m", "sentinel", "error"), ("m", "ais", "warning")], "mode string, category string, severity string")
    u = spark.createDataFrame([(1, "m", "sentinel", True), (2, "m", "ais", True)], "analysis_id int, mode string, category string, valid boolean")
    v = {r.analysis_id: (r.errors, r.warnings, r.can_run) for r in catalog.validate_inputs(u, rules).collect()}
    assert v == {1: ([], ["ais"], True), 2: (["sentinel"], [], False)}
    assert [r.incident_id for r in catalog.pending(i, i.where("incident_id = 'a'")).collect()] == ["b"]
    kinds = [spark.range(1).select(catalog.format_class(F.lit(p)).alias("k")).first().k for p in ("a.CSV", "b.json", "c.nc", "d.tiff", "e.zip", "f")]
    assert kinds == ["CSV", "JSON", "NetCDF", "GeoTIFF", "ZIP", "UNKNOWN"]
