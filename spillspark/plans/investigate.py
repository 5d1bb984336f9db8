"""Detection and whole investigations as chains of stages whose results are kept.

See ``manifest`` for what is kept and when it is made anew.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spillspark.operators import attribution, drift, georef, raster
from spillspark.plans.manifest import Input, Stage, Store
from spillspark.sources import workspace


def scene_detection(pixels: DataFrame, lut: DataFrame, predictor: Callable[[], raster.Predictor], size: int) -> DataFrame:
    """Scores of calibrated scenes: (scene_id, r, c, prob, is_oil, vv, vh).

    ``pixels``: scene_id, r, c, vv, vh as digital numbers; ``lut``: see
    ``raster.calibrate``. Both bands are calibrated, normalised, cut into tiles
    and scored tile by tile.
    """
    bands = None
    for pol in ("vv", "vh"):
        own = raster.calibrate(pixels.select("scene_id", F.lit(pol.upper()).alias("pol"), "r", "c", F.col(pol).alias("dn")), lut)
        own = own.select("scene_id", "r", "c", raster.normalise(F.col("db")).alias(f"{pol}_norm"))
        bands = own if bands is None else bands.join(own, ["scene_id", "r", "c"])
    at = bands.withColumns({"row_off": F.expr(f"r div {size} * {size}"), "col_off": F.expr(f"c div {size} * {size}")})
    # Tiles begin at their offsets, whatever pixels they lack.
    rows = at.groupBy("scene_id", "row_off", "col_off").agg(
        F.array_sort(F.collect_list(F.struct("r", "c", "vv_norm", "vh_norm"))).alias("p"),
        (F.max("r") - F.col("row_off") + 1).cast("int").alias("valid_h"), (F.max("c") - F.col("col_off") + 1).cast("int").alias("valid_w"),
    )
    place = F.transform("p", lambda p: ((p["r"] - F.col("row_off")) * F.col("valid_w") + p["c"] - F.col("col_off")).cast("int"))
    tiles = rows.select("scene_id", "row_off", "col_off", "valid_h", "valid_w", place.alias("at"), F.transform("p", lambda p: p["vv_norm"]).alias("vv"), F.transform("p", lambda p: p["vh_norm"]).alias("vh"))
    scored = raster.score_tiles(tiles, predictor, size=size)
    return scored.join(pixels.select("scene_id", "r", "c", "vv", "vh"), ["scene_id", "r", "c"])


def detection_report(scored: DataFrame) -> DataFrame:
    """Statistics, percentiles and mask counts of each scored scene; the scores are written once."""
    scored = workspace.written(scored, "scored")
    counts = raster.mask_counts(raster.masks(scored.drop("is_oil")))
    return raster.scene_stats(scored).drop("n_oil").join(raster.percentiles(scored), "scene_id").join(counts, "scene_id")


def stages(predictor: Callable[[], raster.Predictor], named: str, tile: int = raster.TILE, least_pixels: int = 50, hours: float = 144, step_s: float = 3600, radius0_m: float = 5000.0, top: int = 10) -> list[Stage]:
    """Detection, geometry, drift and attribution of incidents; ``named`` tells the predictor apart.

    Inputs: ``pixels`` (incident_id, r, c, vv, vh as digital numbers), ``lut`` and ``ties`` of each
    incident's scene, ``times`` (incident_id, field_id, target_us), ``winds`` (a grid
    per field_id) and ``reports``.
    """

    def of(rows: DataFrame, todo: DataFrame) -> DataFrame:
        return rows.join(todo, "incident_id", "left_semi")

    def scene(rows: DataFrame) -> DataFrame:
        return rows.withColumnRenamed("incident_id", "scene_id")

    def detection(todo: DataFrame, pixels: DataFrame, lut: DataFrame) -> DataFrame:
        scored = scene_detection(scene(of(pixels, todo)), scene(of(lut, todo)), predictor, tile)
        return scored.drop("is_oil").withColumnRenamed("scene_id", "incident_id")

    def geometry(todo: DataFrame, detected: DataFrame, ties: DataFrame) -> DataFrame:
        masked = raster.masks(scene(of(detected, todo)))
        stats = raster.without_speckle(raster.component_stats(raster.scene_components(masked.where("oil"))), least_pixels, 1)
        totals = georef.spill_totals(georef.component_shapes(stats, scene(of(ties, todo))), raster.mask_counts(masked))
        return totals.withColumnRenamed("scene_id", "incident_id")

    def hindcast(todo: DataFrame, spill: DataFrame, times: DataFrame, winds: DataFrame) -> DataFrame:
        starts = of(spill, todo).join(times, "incident_id").select("incident_id", "field_id", F.col("centroid_lon").alias("lon0"), F.col("centroid_lat").alias("lat0"), "target_us")
        return drift.hindcast(starts, winds, hours, step_s, radius0_m=radius0_m)

    def candidates(todo: DataFrame, path: DataFrame, reports: DataFrame) -> DataFrame:
        own = workspace.written(of(path, todo), "path")
        last = own.groupBy("incident_id").agg(F.max_by(F.struct("lon", "lat", "us", "radius_m"), "step").alias("e"))
        zones = last.select("incident_id", F.col("e.lon").alias("lon0"), F.col("e.lat").alias("lat0"), F.col("e.us").alias("target_us"), (F.col("e.radius_m") / 1000).alias("radius_km"))
        return attribution.leading(reports, zones, own, top)

    return [
        Stage("detection", ("pixels", "lut"), detection, (named, tile)),
        Stage("geometry", ("detection", "ties"), geometry, (raster.OIL, raster.CORE, least_pixels)),
        Stage("drift", ("geometry", "times", "winds"), hindcast, (hours, step_s, radius0_m)),
        Stage("attribution", ("drift", "reports"), candidates, (top, tuple(sorted(attribution.WEIGHTS.items())))),
    ]


def investigation(store: Store, incidents: DataFrame, inputs: dict[str, Input], chain: list[Stage], force: bool = False) -> DataFrame:
    """One row per incident and candidate, with the spill and its origin; incidents without oil have one without."""
    made = store.run(incidents, inputs, chain, force)
    last = made["drift"].groupBy("incident_id").agg(F.max_by(F.struct("lon", "lat", "us"), "step").alias("origin"))
    whole = incidents.select("incident_id").distinct().join(made["geometry"], "incident_id", "left").join(last, "incident_id", "left").join(made["attribution"], "incident_id", "left")
    return whole
