"""Outputs: GeoJSON features, nested JSON documents, raster tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def feature(properties: Column, kind: str, coordinates: Column) -> Column:
    """GeoJSON feature text."""
    geometry = F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), geometry.alias("geometry")))


def track_features(tracks: DataFrame) -> DataFrame:
    """LineStrings of tracks with two points at least."""
    line = F.transform("points", lambda p: F.array(p["lon"], p["lat"]))
    props = F.struct("vessel_id", F.col("n").alias("observation_count"), F.get("points", 0)["us"].alias("first_us"), F.get("points", F.size("points") - 1)["us"].alias("last_us"))
    return tracks.where(F.size("points") >= 2).select("vessel_id", feature(props, "LineString", line).alias("feature"))


def closest_features(scores: DataFrame) -> DataFrame:
    """Points of closest approach."""
    props = F.struct("vessel_id", "d_source_km", "d_trajectory_km", "closest_us", "score")
    return scores.select("incident_id", "vessel_id", feature(props, "Point", F.array("closest_lon", "closest_lat")).alias("feature"))


def trajectory_features(steps: DataFrame) -> DataFrame:
    """Per incident one LineString, then a Point per step: ordered by (kind, step)."""
    w = F.array_sort(F.collect_list(F.struct("step", "lon", "lat")))
    lines = steps.groupBy("incident_id").agg(w.alias("p"))
    line = lines.select(
        "incident_id", F.lit(0).alias("kind"), F.lit(None).cast("int").alias("step"),
        feature(F.struct(F.size("p").alias("n_steps")), "LineString", F.transform("p", lambda p: F.array(p["lon"], p["lat"]))).alias("feature"),
    )
    points = steps.select("incident_id", F.lit(1).alias("kind"), "step", feature(F.struct("step", "us"), "Point", F.array("lon", "lat")).alias("feature"))
    return line.unionByName(points)


def zone_features(zones: DataFrame) -> DataFrame:
    """Polygons of zones with a ``ring`` of struct<x, y>."""
    ring = F.array(F.transform("ring", lambda p: F.array(p["x"], p["y"])))
    return zones.select("incident_id", feature(F.struct("incident_id", "radius_zone_km"), "Polygon", ring).alias("feature"))


def risk_features(risks: DataFrame) -> DataFrame:
    """Points of vessels at risk, in no order of risk."""
    props = F.struct("vessel_id", "risk_level", "d_trajectory_km", "inside_impact_zone", F.col("slick_closest_minutes").alias("eta_minutes"), "explanation")
    return risks.select("incident_id", "vessel_id", feature(props, "Point", F.array("lon", "lat")).alias("feature"))


def component_features(shapes: DataFrame, core: bool = False) -> DataFrame:
    """Georeferenced component boxes by rank, in degrees; ``core`` keeps the first quarter, one at least."""
    if core:
        w = Window.partitionBy("scene_id")
        shapes = shapes.withColumn("of", F.count(F.lit(1)).over(w)).where(F.col("rank") <= F.greatest(F.lit(1), F.floor(F.col("of") / 4)))
    props = F.struct(
        F.col("rank").alias("component_id"), F.round("area_m2", 2).alias("area_m2"), F.round(F.col("area_m2") / 1e6, 4).alias("area_km2"), F.round("perimeter_m", 2).alias("perimeter_m"),
        F.round("centroid_lat", 6).alias("centroid_lat"), F.round("centroid_lon", 6).alias("centroid_lon"), F.col("full_size").alias("pixel_count_approx"),
    )
    ring = F.array(F.transform("ring", lambda p: F.array(p["x"], p["y"])))
    return shapes.select("scene_id", "rank", feature(props, "Polygon", ring).alias("feature"))


def write_features(features: DataFrame, path: str) -> None:
    """Newline-delimited features."""
    features.select(F.col("feature").alias("value")).write.mode("overwrite").text(path)


def collections(features: DataFrame, key: str = "incident_id") -> DataFrame:
    """One FeatureCollection document per key."""
    joined = features.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list("feature")), ",").alias("f"))
    return joined.select(key, F.concat(F.lit('{"type":"FeatureCollection","features":['), "f", F.lit("]}")).alias("document"))


def write_documents(rows: DataFrame, path: str, key: str = "incident_id") -> None:
    """Nested JSON, a folder per key; only the keys written are replaced."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).json(path)


FOLDERS = 256  # that a task writes


def write_folders(rows: DataFrame, path: str, key: str) -> None:
    """Text of many keys (key, value), a folder and a file for each, under a ``path`` that is new.

    The keys are dealt over tasks, and each task moves its folders to their place: by
    default the driver would, one after the other. What a failed job leaves there
    isn't taken back.
    """
    dealt = rows.repartition(max(1, -(-rows.count() // FOLDERS)), key)
    dealt.write.option("mapreduce.fileoutputcommitter.algorithm.version", 2).partitionBy(key).text(path)


def write_tiles(pixels: DataFrame, path: str, size: int = 512) -> None:
    """Raster as Parquet by scene, in tile order."""
    tiled = pixels.withColumns({"row_off": F.expr(f"r div {size} * {size}"), "col_off": F.expr(f"c div {size} * {size}")})
    ordered = tiled.repartition("scene_id", "row_off").sortWithinPartitions("scene_id", "row_off", "col_off", "r", "c")
    ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("scene_id").parquet(path)
