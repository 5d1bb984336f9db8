import json
import os

import pytest
from pyspark.sql import functions as F

from spillspark.sources import readers, sinks


def test_header_map():
    got = readers.header_map(["Timestamp_UTC", "vessel_name", "mmsi", "imo", "latitude", "longitude", "sog_knots", "cog_deg", "heading_deg"])
    assert got["timestamp_utc"] == "Timestamp_UTC" and got["speed_knots"] == "sog_knots" and got["course_deg"] == "cog_deg"
    assert readers.header_map(["obs_time", "platform", "lat", "lon"])["latitude"] == "lat"
    for bad in (["time", "lat"], ["lat", "LAT", "lon", "time"]):
        with pytest.raises(ValueError):
            readers.header_map(bad)


def test_ais_csv(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("timestamp_utc,vessel_name,mmsi,imo,latitude,longitude,sog_knots,cog_deg,heading_deg\n2018-01-06 10:00:00.5,SHIP,,1,30.5,125.5,9.1,10,\n2018-01-06T10:00:00+08:00,,123.0,1,30.5,125.5,9.1,10,20\n2018-01-06 11:00:00,X,1,1,,125,1,1,1\n")
    got = sorted(readers.ais_csv(spark, str(p)).collect(), key=lambda r: r.vessel_id)
    assert [(r.vessel_id, r.heading_deg, r.timestamp_utc.hour) for r in got] == [("MMSI_123", 20.0, 2), ("SHIP", None, 10)]


def test_normalised_records(spark, tmp_path):
    p = tmp_path / "a.json"
    p.write_text(json.dumps([{"mmsi": 5, "latitude": 1, "longitude": 2, "timestamp_utc": "2024-01-01T00:00:01Z", "sog": 4.5}, {"name": "N", "latitude": 1, "longitude": 2, "time": "junk"}, {"vessel_id": "V", "latitude": 1.0, "longitude": 2.0, "time": "2024-01-01 00:00:02"}]))
    got = {r.vessel_id: r for r in readers.ais_json(spark, str(p)).collect()}
    assert set(got) == {"5", "V"} and got["5"].us == 1_000_000 and got["5"].speed == 4.5 and got["V"].speed == 0.0
    raw = spark.read.json(str(p), multiLine=True)
    assert readers.normalised(raw, F.lit("2024-01-01").cast("timestamp")).count() == 3


def test_environment_and_grids(spark, tmp_path):
    p = tmp_path / "e.json"
    p.write_text('{"wind": [1.5, -2], "current": [0.1, 0.2]}')
    assert tuple(readers.environment_json(spark, str(p)).first()) == (1.5, -2.0, 0.1, 0.2)
    rows = [("g", [0.0], 2, 1, [1.0, 2.0], [3.0, 4.0]), ("bad", [0.0], 2, 2, [1.0], [1.0])]
    cells = readers.vector_grids(spark.createDataFrame(rows, "grid_id string, bounds array<double>, width int, height int, u array<double>, v array<double>")).collect()
    assert sorted((c.grid_id, c.row, c.col, c.u, c.v) for c in cells) == [("g", 0, 0, 1.0, 3.0), ("g", 0, 1, 2.0, 4.0)]
    t = readers.grid_table(spark.createDataFrame([("f", 2, 1.0, 2.0, 9.0, 9.0), ("f", 1, 1.0, 2.0, 5.0, 6.0)], "field_id string, time int, latitude double, longitude double, u double, v double")).collect()
    assert [(x.u, x.v) for x in t] == [(5.0, 6.0)]


def test_annotation_xml(spark, tmp_path):
    p = tmp_path / "c.xml"
    p.write_text("<c><l><calibrationVector><line>0</line><pixel count='3'>0 350 700</pixel><sigmaNought>500.0 500.0 501.0</sigmaNought></calibrationVector></l></c>")
    got = readers.calibration_xml(spark, str(p), 1, "VV").orderBy("pixel").collect()
    assert [(r.pixel, r.a_sigma) for r in got] == [(0, 500.0), (350, 500.0), (700, 501.0)]
    q = tmp_path / "g.xml"
    points = "".join(f"<geolocationGridPoint><line>{y}</line><pixel>{x}</pixel><latitude>{30 - y / 300}</latitude><longitude>{125 + x / 300}</longitude></geolocationGridPoint>" for y in (0, 300) for x in (0, 300))
    q.write_text(f"<g>{points}</g>")
    at = readers.pixel_positions(spark.createDataFrame([(1, 150, 150)], "scene_id long, line long, pixel long"), readers.geolocation_xml(spark, str(q), 1)).first()
    assert abs(at.lon - 125.5) < 1e-9 and abs(at.lat - 29.5) < 1e-9


def test_catalogue_scan(spark, tmp_path):
    for name, text in (("b", json.dumps({"incident_id": "b", "name": "B", "expected_files": {"ais": "a.csv"}}, indent=1)), ("a", json.dumps({"incident_id": "a"})), ("c", "{broken")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "metadata.json").write_text(text)
    assert [r.incident_id for r in readers.incident_metadata(spark, str(tmp_path)).collect()] == ["a", "b"]
    assert {r.name for r in readers.listing(spark, str(tmp_path)).collect()} == {"metadata.json"}


def test_sinks(spark, tmp_path):
    steps = spark.createDataFrame([(1, 0, 1.0, 2.0, 0), (1, 1, 3.0, 4.0, 5)], "incident_id long, step int, lon double, lat double, us long")
    f = sinks.trajectory_features(steps).orderBy("incident_id", "kind", "step").collect()
    parsed = [json.loads(x.feature) for x in f]
    assert [p["geometry"]["type"] for p in parsed] == ["LineString", "Point", "Point"] and parsed[0]["geometry"]["coordinates"] == [[1, 2], [3, 4]]
    doc = json.loads(sinks.collections(sinks.trajectory_features(steps)).first().document)
    assert len(doc["features"]) == 3
    sinks.write_features(sinks.trajectory_features(steps), str(tmp_path / "f"))
    assert spark.read.text(str(tmp_path / "f")).count() == 3
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "incident_id long, v string")
    sinks.write_documents(rows, str(tmp_path / "d"))
    sinks.write_documents(rows.where("incident_id = 2").withColumn("v", F.lit("c")), str(tmp_path / "d"))
    assert sorted((r.incident_id, r.v) for r in spark.read.json(str(tmp_path / "d")).collect()) == [(1, "a"), (2, "c")]
    px = spark.range(100).select(F.lit(1).alias("scene_id"), F.expr("id div 10").alias("r"), (F.col("id") % 10).alias("c"), F.lit(0.5).alias("prob"))
    sinks.write_tiles(px, str(tmp_path / "t"), 4)
    assert spark.read.parquet(str(tmp_path / "t")).where("row_off = 8 and col_off = 4").count() == 8


def test_folders_of_many_keys_are_dealt_over_tasks(spark, tmp_path, monkeypatch):
    """A folder and a file per key, each written by one of several tasks, nothing left out or left over."""
    monkeypatch.setattr(sinks, "FOLDERS", 5)
    path = f"{tmp_path}/folders"
    sinks.write_folders(spark.range(40).repartition(1).select(F.col("id").alias("folder"), F.concat(F.lit("v"), "id").alias("value")), path, "folder")
    names = [(d.rpartition("/")[2], x) for d, _, files in os.walk(path) for x in files if x.startswith("part-")]
    assert sorted(d for d, _ in names) == sorted(f"folder={i}" for i in range(40)) and len({x.split("-")[1] for _, x in names}) > 3
    assert not [d for d in os.listdir(path) if d.startswith("_temporary")]
    assert {(r.folder, r.value) for r in spark.read.text(path).collect()} == {(i, f"v{i}") for i in range(40)}
    sinks.write_folders(spark.range(0).select(F.col("id").alias("folder"), F.lit("v").alias("value")), f"{path}-none", "folder")
