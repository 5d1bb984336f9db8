"""Spills on the ground: component boxes warped through a scene's tie points, measured in its UTM zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spillspark.functions import chain, geo, grids

RING = (0, 1, 2, 3, 0)


def zones(ties: DataFrame) -> DataFrame:
    """(scene_id, zone): the UTM zone of the mean longitude of each scene's tie points."""
    zone = F.floor((F.avg("lon") + 180) / 6) + 1
    return ties.groupBy("scene_id").agg(F.greatest(F.lit(1), F.least(F.lit(60), zone)).cast("int").alias("zone"))


def positions(points: DataFrame, ties: DataFrame) -> DataFrame:
    """``points`` (scene_id, line, pixel and others) with lon and lat, bilinear between tie points."""
    ties = ties.select("scene_id", F.col("line").cast("double").alias("line"), F.col("pixel").cast("double").alias("pixel"), "lon", "lat")
    return grids.interpolate(points, ties, ["scene_id"], "line", "pixel", ["lon", "lat"])


def component_shapes(stats: DataFrame, ties: DataFrame, scale: int = 1, zone: int | None = None) -> DataFrame:
    """Components (scene_id, component, n, r0, r1, c0, c1, density, rank) with their box on the ground.

    ``ring``: the box's corners in degrees, closed; ``utm``: the same in metres, in
    ``zone`` or the scene's own. ``area_m2`` is the box's area there times the share of
    its pixels that are oil, ``perimeter_m`` its outline. ``ties``: scene_id,
    line, pixel, lon, lat, in pixels of full resolution, of which a pixel here is ``scale``.
    """
    top, bottom, left, right = F.col("r0") * scale, (F.col("r1") + 1) * scale, F.col("c0") * scale, (F.col("c1") + 1) * scale
    middle = ((F.col("r0") + F.col("r1")) / 2.0 * scale, (F.col("c0") + F.col("c1")) / 2.0 * scale)
    places = [(top, left), (top, right), (bottom, right), (bottom, left), middle]
    spot = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), y.cast("double").alias("line"), x.cast("double").alias("pixel")) for k, (y, x) in enumerate(places)]))
    at = positions(stats.select("scene_id", "component", spot.alias("p")).select("scene_id", "component", "p.*"), ties)
    at = at.join(zones(ties), "scene_id") if zone is None else at.withColumn("zone", F.lit(zone))
    levels, x, y = geo.utm_levels("lon", "lat", "zone")
    flat = chain.apply(at, levels, {"x": x, "y": y})
    corner = F.struct("lon", "lat", "x", "y")
    ground = flat.groupBy("scene_id", "component").agg(F.first("zone").alias("zone"), *[F.max(F.when(F.col("k") == k, corner)).alias(f"k{k}") for k in range(5)])
    side = lambda a, b: F.hypot(F.col(f"k{b}.x") - F.col(f"k{a}.x"), F.col(f"k{b}.y") - F.col(f"k{a}.y"))
    # Relative to the first corner: differences keep their digits.
    dx = lambda k: F.col(f"k{k}.x") - F.col("k0.x")
    dy = lambda k: F.col(f"k{k}.y") - F.col("k0.y")
    twice = (dx(1) * dy(2) - dx(2) * dy(1)) + (dx(2) * dy(3) - dx(3) * dy(2))
    listed = lambda a, b: F.array(*[F.struct(F.col(f"k{k}.{a}").alias("x"), F.col(f"k{k}.{b}").alias("y")) for k in RING])
    shaped = ground.select(
        "scene_id", "component", "zone", listed("lon", "lat").alias("ring"), listed("x", "y").alias("utm"), (F.abs(twice) / 2).alias("box_m2"),
        sum((side(a, b) for a, b in zip(RING[:-1], RING[1:], strict=True)), F.lit(0.0)).alias("perimeter_m"), F.col("k4.lon").alias("centroid_lon"), F.col("k4.lat").alias("centroid_lat"),
    )
    both = stats.join(shaped, ["scene_id", "component"])
    return both.withColumns({"area_m2": F.col("box_m2") * F.col("density"), "full_size": F.col("n") * scale * scale}).drop("box_m2")


def _ends(ring: str, axis: str, pick) -> Column:
    return pick(F.transform(ring, lambda p: p[axis]))


def spill_totals(shapes: DataFrame, counts: DataFrame) -> DataFrame:
    """Totals per scene of georeferenced components: area, outline, centroid, boxes in degrees and metres, core.

    The centroid is the mean of all ring vertices (five per box, the first
    twice). The core's area is the whole area by the share of core pixels.
    """
    mean = lambda axis: F.sum(F.aggregate("ring", F.lit(0.0), lambda s, p: s + p[axis])) / F.sum(F.size("ring"))
    box = [fold(_ends(ring, axis, pick)).alias(f"{name}_{end}") for ring, names in (("ring", ("lon", "lat")), ("utm", ("x", "y"))) for axis, name in zip("xy", names, strict=True) for end, fold, pick in (("min", F.min, F.array_min), ("max", F.max, F.array_max))]
    t = shapes.groupBy("scene_id").agg(F.count(F.lit(1)).alias("n_components"), F.first("zone").alias("zone"), F.sum("area_m2").alias("area_m2"), F.sum("perimeter_m").alias("perimeter_m"), mean("x").alias("centroid_lon"), mean("y").alias("centroid_lat"), *box)
    both = t.join(counts.select("scene_id", "n_valid", "n_oil", "n_core", "oil_percent", "core_percent"), "scene_id")
    return both.withColumn("core_area_m2", F.col("area_m2") * F.col("n_core") / F.greatest(F.col("n_oil"), F.lit(1)))
