import datetime as dt

from pyspark.sql import functions as F

from spillspark.functions import geo
from spillspark.streaming import live

SCHEMA = "vessel_id string, ts timestamp, lon double, lat double, speed double"


def feed(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))


def drain(df, mode, name):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()


def test_latest_and_alerts(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [("A", t, 125.0, 30.0, 1.0), ("A", t + dt.timedelta(minutes=5), 125.1, 30.0, 1.0), ("A", t + dt.timedelta(minutes=5), 125.1, 30.0, 1.0), ("B", t, 140.0, 30.0, 1.0)]
    stream = feed(spark, tmp_path, rows)
    drain(live.latest_positions(stream), "update", "latest")
    assert sorted((r.vessel_id, r.lon) for r in spark.table("latest").collect()) == [("A", 125.1), ("B", 140.0)]
    way = spark.createDataFrame([(1, 125.1, 30.01), (1, 125.2, 30.0)], "incident_id long, lon double, lat double")
    drain(live.alerts(live.deduplicated(stream), way), "append", "alerts")
    got = {(r.vessel_id, r.risk_level) for r in spark.table("alerts").collect()}
    assert got == {("A", "HIGH"), ("A", "MEDIUM")}  # B is out of reach


def test_windowed_counts(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [("A", t + dt.timedelta(minutes=m), 125.0, 30.0, 1.0) for m in (1, 2, 12, 60)]
    risks = feed(spark, tmp_path, rows).withColumn("risk_level", F.lit("HIGH"))
    drain(live.windowed_counts(risks), "append", "counts")
    assert sorted((r.window.start.minute, r.n) for r in spark.table("counts").collect()) == [(0, 2), (10, 1)]


def test_alerts_are_those_of_the_batch_tiers(spark):
    """Against every pair of positions and waypoints, over the antimeridian too."""
    t = dt.datetime(2024, 1, 1)
    places = [(f"V{k}", t, (179.7 + 0.011 * (k * 37 % 60) + 180) % 360 - 180, 10 + 0.009 * (k * 23 % 60), 1.0) for k in range(120)]
    ways = [(i, (179.95 + 0.02 * k + 180) % 360 - 180, 10.1 + 0.07 * i + 0.01 * k) for i in range(4) for k in range(6)]
    rows, way = spark.createDataFrame(places, SCHEMA), spark.createDataFrame(ways, "incident_id long, lon double, lat double")
    got = {(r.incident_id, r.vessel_id): (r.d_km, r.risk_level) for r in live.alerts(rows, way).collect()}
    pairs = rows.crossJoin(way.selectExpr("incident_id", "lon as w_lon", "lat as w_lat"))
    least = geo.with_geodesic(pairs, "d", "lon", "lat", "w_lon", "w_lat").groupBy("incident_id", "vessel_id").agg((F.min("d") / 1000).alias("km")).collect()
    want = {(r.incident_id, r.vessel_id): (round(r.km, 2), "HIGH" if r.km <= 3 else "MEDIUM") for r in least if r.km <= 10}
    assert got.keys() == want.keys() and len({k for _, k in want.values()}) == 2
    assert all(abs(got[k][0] - want[k][0]) <= 0.011 and got[k][1] == want[k][1] for k in want)


def test_silent_vessels_are_forgotten(spark, tmp_path):
    """A vessel whose last batch holds only older reports keeps a timer, over a restart too."""
    t = dt.datetime(2024, 1, 1)
    at = lambda hours: t + dt.timedelta(hours=hours)
    check = str(tmp_path / "check")

    def step(rows, name):
        stream = feed(spark, tmp_path, rows)
        q = live.latest_positions(stream, idle="6 hours").writeStream.outputMode("update").format("memory").queryName(name).option("checkpointLocation", check)
        q = q.foreachBatch(lambda df, _: seen.extend((r.vessel_id, r.lon) for r in df.collect())).start()
        q.processAllAvailable()
        left = [p["stateOperators"][-1]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
        q.stop()
        return left[-1]

    seen: list = []
    step([("A", at(2), 125.0, 30.0, 1.0)], "a")
    step([("A", at(1.9), 124.0, 30.0, 1.0), ("B", at(2), 126.0, 30.0, 1.0)], "b")  # older: A's latest stays
    assert sorted(seen) == [("A", 125.0), ("B", 126.0)]
    step([("C", at(20), 127.0, 30.0, 1.0)], "c")
    assert step([("C", at(21), 127.5, 30.0, 1.0)], "d") == 1  # only C is still known
    assert sorted(seen) == [("A", 125.0), ("B", 126.0), ("C", 127.0), ("C", 127.5)]
