"""Vessel tracks from position reports (vessel_id, lon, lat, us, speed, heading)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spillspark.functions import geo


def group_tracks(reports: DataFrame) -> DataFrame:
    """One row per vessel with its reports in time order, unknown times first."""
    point = F.struct("us", "lon", "lat", "speed", "heading")
    return reports.groupBy("vessel_id").agg(F.array_sort(F.collect_list(point)).alias("points"), F.count(F.lit(1)).alias("n"))


def summarize(reports: DataFrame, lon0: str, lat0: str, keys: tuple[str, ...] = ("vessel_id",)) -> DataFrame:
    """Per key: span, distance of the first report from (lon0, lat0), mean speed, heading spread.

    ``heading_std`` is the population deviation of the numbers as they are;
    ``heading_std_circular`` treats them as angles.
    """
    sums = reports.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("us").alias("first_us"),
        F.max("us").alias("last_us"),
        F.min(F.struct("us", "lon", "lat", F.col(lon0).alias("lon0"), F.col(lat0).alias("lat0"))).alias("first"),
        F.avg("speed").alias("mean_speed"),
        F.stddev_pop("heading").alias("heading_std"),
        F.hypot(F.avg(F.sin(F.radians("heading"))), F.avg(F.cos(F.radians("heading")))).alias("length"),
    )
    flat = sums.select(*keys, "n", "first_us", "last_us", "mean_speed", "heading_std", "length", F.col("first.lon").alias("lon"), F.col("first.lat").alias("lat"), F.col("first.lon0").alias("lon0"), F.col("first.lat0").alias("lat0"))
    return (
        geo.with_track_distance(flat, "distance_m", "lon", "lat", "lon0", "lat0")
        .withColumn("duration_s", (F.col("last_us") - F.col("first_us")) / 1e6)
        .withColumn("heading_std_circular", F.degrees(F.sqrt(-2 * F.log(F.least(F.col("length"), F.lit(1.0))))))
        .drop("length", "lon0", "lat0")
    )


def latest(reports: DataFrame) -> DataFrame:
    """The last report of each vessel; partial maxima combine before the shuffle."""
    row = F.struct("us", "lon", "lat", "speed", "heading")
    return reports.groupBy("vessel_id").agg(F.max(row).alias("r")).select("vessel_id", "r.*")


def legs(reports: DataFrame) -> DataFrame:
    """Consecutive positions of a track with leg distance and time."""
    w = Window.partitionBy("vessel_id").orderBy("us", "lon", "lat")
    before = reports.withColumns({f"{c}_from": F.lag(c).over(w) for c in ("lon", "lat", "us")}).where("us_from is not null")
    return geo.with_geodesic(before, "leg_m", "lon_from", "lat_from", "lon", "lat").withColumn("leg_s", (F.col("us") - F.col("us_from")) / 1e6)


def progress(tracks: DataFrame, percent: float) -> DataFrame:
    """Position at ``percent`` of a track by point number, and the part up to there."""
    at = (F.size("points") - 1) * (percent / 100)
    low = F.floor(at).cast("int")
    share = at - low
    a = F.get("points", low)
    b = F.get("points", F.least(low + 1, F.size("points") - 1))
    lon, lat = a["lon"] + (b["lon"] - a["lon"]) * share, a["lat"] + (b["lat"] - a["lat"]) * share
    pair = lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"))
    path = F.concat(F.transform(F.slice("points", 1, low + 1), pair), F.array(F.struct(lon.alias("lon"), lat.alias("lat"))))
    return tracks.withColumns({"lon": lon, "lat": lat, "path": path})


def dataset_stats(reports: DataFrame) -> DataFrame:
    return reports.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("vessel_id").alias("n_vessels"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))
