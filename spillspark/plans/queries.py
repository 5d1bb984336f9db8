"""The registered queries of the spill analytics, over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spillspark.functions import geo
from spillspark.operators import attribution, catalog, drift, georef, joins, raster, risk, tracks
from spillspark.sources import derived, sinks


def _reports(spark: SparkSession, d: str) -> DataFrame:
    return derived.ais(spark, d)


def _incidents(spark: SparkSession, d: str) -> DataFrame:
    return derived.incidents(spark, d)


def _spills(spark: SparkSession, d: str) -> DataFrame:
    return derived.spills(spark, d)


def _r(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


# -- attribution --------------------------------------------------------------


def vessel_attribution_topk(spark: SparkSession, d: str) -> DataFrame:
    found = attribution.evidence(_reports(spark, d), _incidents(spark, d))
    ranks = attribution.ranked(attribution.scored(found)).where("rank <= 3")
    return ranks.select("incident_id", "vessel_id", "rank", "record_count", "d_source_km", "dt_days", "in_zone_count", "mean_speed", "heading_std", "spatial_score", "temporal_score", "trajectory_score", "heading_score", "score")


def _waypoints(spark: SparkSession, d: str) -> DataFrame:
    return drift.simulate(_incidents(spark, d), 24, 8 * 3600, direction="backward")


def historical_attribution(spark: SparkSession, d: str) -> DataFrame:
    found = attribution.evidence(_reports(spark, d), _incidents(spark, d), _waypoints(spark, d))
    ranks = attribution.ranked(attribution.scored(found)).where("rank <= 10")
    return ranks.select("incident_id", "vessel_id", "rank", "d_source_km", "d_trajectory_km", "trajectory_score", "score")


def _top(spark: SparkSession, d: str, k: int = 3) -> DataFrame:
    found = attribution.evidence(_reports(spark, d), _incidents(spark, d))
    return attribution.ranked(attribution.scored(found)).where(F.col("rank") <= k)


def evidence_sentences(spark: SparkSession, d: str) -> DataFrame:
    told = attribution.categories(attribution.evidence_lines(_top(spark, d)))
    return told.select("incident_id", "rank", "vessel_id", *[F.get("evidence", i).alias(f"line_{i + 1}") for i in range(4)], F.size("by_category").cast("bigint").alias("n_categories"), *[F.try_element_at("by_category", F.lit(c)).alias(f"by_{c}") for c in ("spatial", "temporal", "trajectory", "track")])


def evidence_matrix(spark: SparkSession, d: str) -> DataFrame:
    return attribution.matrix(_top(spark, d))


def evidence_flags(spark: SparkSession, d: str) -> DataFrame:
    flags = attribution.evidence_flags(_top(spark, d)).select("incident_id", "rank", F.explode("flags").alias("f"))
    return flags.select("incident_id", "rank", "f.factor", "f.status", F.col("f.percent").cast("bigint").alias("percent"))


def _vessels(spark: SparkSession, d: str) -> DataFrame:
    """Vessel details by id, with names that some candidates carry instead."""
    last = tracks.latest(_reports(spark, d))
    return last.select("vessel_id", F.concat(F.lit("NAME_"), "vessel_id").alias("vessel_name"), "lon", "lat", "speed")


def candidate_details(spark: SparkSession, d: str) -> DataFrame:
    odd = F.col("rank") == 2  # known by name only
    top = _top(spark, d).select("incident_id", "rank", F.concat(F.lit("NAME_"), "vessel_id").alias("vessel_name"), F.when(odd, F.concat(F.lit("X"), "vessel_id")).otherwise(F.col("vessel_id")).alias("vessel_id"))
    both = joins.details_by_id_or_name(top, _vessels(spark, d))
    return _r(both.select("incident_id", "rank", "vessel_name", "lon", "lat", "speed"), 6, "lon", "lat")


def contextual_traffic(spark: SparkSession, d: str) -> DataFrame:
    top = _top(spark, d).select("vessel_id", F.concat(F.lit("NAME_"), "vessel_id").alias("vessel_name"))
    rest = joins.not_among(_vessels(spark, d), top).select("vessel_id", F.lit("context").alias("kind"))
    return top.select("vessel_id").distinct().withColumn("kind", F.lit("ranked")).unionByName(rest)


def _summaries(spark: SparkSession, d: str) -> DataFrame:
    near = joins.search_area_join(_reports(spark, d), _incidents(spark, d), hours=48)
    s = tracks.summarize(near, "lon0", "lat0", ("incident_id", "vessel_id"))
    return s.join(_incidents(spark, d).select("incident_id", "target_us"), "incident_id")


def prototype_scores(spark: SparkSession, d: str) -> DataFrame:
    s = _r(_summaries(spark, d), 2, "distance_m").withColumn("heading_spread", F.round("heading_std", 4))
    p = attribution.prototype(s)
    return p.select("incident_id", "vessel_id", "rank", "overall_score", "spatial_proximity", "temporal_proximity", "trajectory_consistency", "heading_consistency")


def prototype_explanations(spark: SparkSession, d: str) -> DataFrame:
    """The prototype's reasons in words, and its scores where distance counts as spatial."""
    s = _r(_summaries(spark, d), 2, "distance_m").withColumn("heading_spread", F.round("heading_std", 4))
    p = attribution.prototype(s, mode="own")
    told = [F.try_element_at("explanations", F.lit(k)).alias(f"told_{k}") for k in ("spatial", "temporal", "trajectory", "heading")]
    return p.select("incident_id", "vessel_id", "rank", "overall_score", "spatial_proximity", "heading_consistency", *told)


# -- tracks -------------------------------------------------------------------


def ais_area_window_summary(spark: SparkSession, d: str) -> DataFrame:
    cols = ["incident_id", "vessel_id", "n", "first_us", "last_us", "duration_s", "mean_speed", "heading_std", "distance_m"]
    # Means of values with two places have no ties at the sixth.
    return _r(_r(_summaries(spark, d).select(*cols), 6, "mean_speed"), 3, "heading_std", "distance_m")


def latest_position(spark: SparkSession, d: str) -> DataFrame:
    return _r(tracks.latest(_reports(spark, d)), 6, "lon", "lat")


def track_legs(spark: SparkSession, d: str) -> DataFrame:
    legs = tracks.legs(_reports(spark, d)).select("vessel_id", "us", "leg_m", "leg_s")
    return _r(legs, 2, "leg_m", "leg_s")


def track_progress(spark: SparkSession, d: str) -> DataFrame:
    at = tracks.progress(tracks.group_tracks(_reports(spark, d)), 37.5)
    return _r(at.select("vessel_id", "n", "lon", "lat", F.size("path").cast("bigint").alias("n_path")), 8, "lon", "lat")


def track_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = sinks.track_features(tracks.group_tracks(_reports(spark, d)))
    kind = F.get_json_object("feature", "$.geometry.type")
    n = F.get_json_object("feature", "$.properties.observation_count").cast("bigint")
    first = F.get_json_object("feature", "$.geometry.coordinates[0][0]").cast("double")
    return lines.select("vessel_id", kind.alias("geometry_type"), n.alias("n_points"), F.round(first, 6).alias("first_lon"))


def ais_dataset_stats(spark: SparkSession, d: str) -> DataFrame:
    return tracks.dataset_stats(_reports(spark, d))


def search_area_cell_join(spark: SparkSession, d: str) -> DataFrame:
    near = joins.search_area_join(_reports(spark, d), _incidents(spark, d), hours=72)
    return _r(near.select("incident_id", "event_id", "vessel_id", "d_m"), 2, "d_m")


def polygon_window_filter(spark: SparkSession, d: str) -> DataFrame:
    corner = lambda x, y: F.struct((F.col("lon0") + x).alias("x"), (F.col("lat0") + y).alias("y"))
    areas = _incidents(spark, d).select(
        "incident_id", F.array(corner(0.0, 0.0), corner(0.9, 0.1), corner(0.5, 0.7), corner(0.0, 0.0)).alias("ring"),
        (F.col("target_us") - 3 * derived.DAY_US).alias("start_us"), (F.col("target_us") + 3 * derived.DAY_US).alias("end_us"),
    )
    return joins.inside_polygon(_reports(spark, d), areas).select("incident_id", "event_id", "vessel_id")


# -- drift and risk -----------------------------------------------------------


def drift_forward(spark: SparkSession, d: str) -> DataFrame:
    return _r(drift.simulate(_spills(spark, d), 12, 1800).select("incident_id", "step", "lon", "lat", "us", "vx", "vy"), 6, "lon", "lat", "vx", "vy")


def drift_backward(spark: SparkSession, d: str) -> DataFrame:
    steps = drift.path_totals(drift.simulate(_spills(spark, d), 24, 3600, direction="backward"))
    return _r(_r(steps.select("incident_id", "step", "lon", "lat", "us", "path_m"), 6, "lon", "lat"), 2, "path_m")


def impact_zone(spark: SparkSession, d: str) -> DataFrame:
    _, end = risk.forecast(_spills(spark, d), 6)
    out = end.select("incident_id", "end_lon", "end_lat", "radius_zone_km", "speed_m_s", "direction", (F.col("drift_m") / 1000).alias("drift_km"), F.size("ring").cast("bigint").alias("n_ring"), F.get("ring", 32)["x"].alias("south_lon"), F.get("ring", 32)["y"].alias("south_lat"))
    return _r(_r(out, 6, "end_lon", "end_lat", "south_lon", "south_lat"), 4, "speed_m_s", "drift_km")


def vessel_risk(spark: SparkSession, d: str) -> DataFrame:
    return risk.assess(_reports(spark, d), _incidents(spark, d)).drop("lon", "lat", "risk_rank")


def risk_counts(spark: SparkSession, d: str) -> DataFrame:
    return risk.counts(risk.assess(_reports(spark, d), _incidents(spark, d)))


def risk_order(spark: SparkSession, d: str) -> DataFrame:
    """The first 20 vessels of all incidents in order of risk."""
    first = risk.ordered(risk.assess(_reports(spark, d), _incidents(spark, d)).withColumn("vessel_id", F.concat_ws("/", "vessel_id", "incident_id"))).limit(20)
    return first.select(F.col("vessel_id").alias("vessel_incident"), "risk_level", "d_trajectory_km")


def synthetic_distances(spark: SparkSession, d: str) -> DataFrame:
    """Distances of a track's legs where every second vessel has coordinates in metres of its own plane."""
    plane = F.expr("user_id % 2 = 0")
    rows = _reports(spark, d).select("vessel_id", "us", "event_id", *[F.when(plane, 1000 + 100 * F.col(c)).otherwise(F.col(c)).alias(c) for c in ("lon", "lat")])
    w = Window.partitionBy("vessel_id").orderBy("us", "event_id")
    legs = rows.withColumns({"lon_b": F.lag("lon").over(w), "lat_b": F.lag("lat").over(w)}).where("lon_b is not null")
    return _r(geo.with_track_distance(legs, "leg_m", "lon_b", "lat_b", "lon", "lat").select("event_id", "leg_m"), 3, "leg_m")


def kpi_overview(spark: SparkSession, d: str) -> DataFrame:
    """Incidents by severity, and their source areas."""
    one = _spills(spark, d).withColumns({"severity": F.when(F.col("radius_km") >= 35, "HIGH").when(F.col("radius_km") >= 25, "MEDIUM").otherwise("LOW"), "area_km2": F.col("radius_km") * F.col("radius_km")})
    good = one.where(F.col("lat0").between(-90, 90) & F.col("lon0").between(-180, 180))
    return good.agg(F.count(F.lit(1)).alias("n_incidents"), F.count_if(F.col("severity") == "HIGH").alias("n_high"), F.round(F.sum("area_km2"), 1).alias("area_km2"))


# -- grids --------------------------------------------------------------------


def _grid(spark: SparkSession, d: str) -> DataFrame:
    """A 10 x 10 grid per region around the incidents, latitudes descending on input."""
    i = spark.range(100).select(F.expr("cast(id div 10 AS int)").alias("iy"), F.expr("cast(id % 10 AS int)").alias("ix"))
    regions = _spills(spark, d).select(F.col("region_id").alias("field_id")).distinct()
    at = regions.join(F.broadcast(i)).withColumns({"lat": 33.0 - F.col("iy") * 0.5, "lon": 123.0 + F.col("ix") * 0.75})
    return at.select("field_id", "lat", "lon", ((F.col("ix") - 4) * 0.5 + F.col("field_id") * 0.25).alias("u"), ((F.col("iy") - 3) * 0.25 + F.col("ix") * 0.125).alias("v"))


def grid_interpolate(spark: SparkSession, d: str) -> DataFrame:
    points = _spills(spark, d).select("incident_id", F.col("region_id").alias("field_id"), F.col("lon0").alias("lon"), F.col("lat0").alias("lat"))
    return _r(drift.interpolate(points, _grid(spark, d)).select("incident_id", "field_id", "u", "v"), 6, "u", "v")


def winds(fields: DataFrame, west: int = 0, east: int = 4) -> DataFrame:
    """Winds and currents of ``fields`` (field_id) that vary with the place, at nodes two degrees apart from (122, 27).

    They are linear in it, so that bilinear values are exact and SQL can say them.
    """
    i = fields.sparkSession.range(4 * (east - west)).select(F.expr("cast(id % 4 AS double)").alias("y"), F.expr(f"cast(id div 4 + {west} AS double)").alias("x"))
    at = fields.join(F.broadcast(i))
    return at.select("field_id", (27 + 2 * F.col("y")).alias("lat"), (122 + 2 * F.col("x")).alias("lon"), (F.col("field_id") * 2.0 + F.col("x")).alias("wind_u"), (5.0 - F.col("y")).alias("wind_v"), (0.2500137 + 0.125 * F.col("y")).alias("cur_u"), (F.col("field_id") * -0.1250193 - 0.0000171 + 0.0625 * F.col("x")).alias("cur_v"))


def hindcast_grid(spark: SparkSession, d: str) -> DataFrame:
    """Backward drift of a day by steps of an hour through winds and currents, field by field, in blocks of starts."""
    starts = _spills(spark, d).select("incident_id", F.col("region_id").alias("field_id"), "lon0", "lat0", "target_us")
    out = drift.hindcast(starts, winds(starts.select("field_id").distinct()), 24, 3600, block=256)
    return _r(_r(out.select("incident_id", "step", "us", "lon", "lat", "vx", "vy", "radius_m"), 5, "lon", "lat", "vx", "vy"), 6, "radius_m")


# -- raster -------------------------------------------------------------------


def _pixels(spark: SparkSession, d: str) -> DataFrame:
    return derived.pixels(spark, d)


def sar_calibrate(spark: SparkSession, d: str) -> DataFrame:
    px = _pixels(spark, d)
    nodes = px.select("scene_id").distinct().join(F.broadcast(spark.range(35).select(F.expr("id div 5 * 50").alias("line"), F.expr("id % 5 * 40").alias("pixel"))))
    lut = nodes.select("scene_id", F.lit("VV").alias("pol"), "line", "pixel", (400.0 + F.col("line") * 0.5 + F.col("pixel") * 0.25).alias("a_sigma"))
    out = raster.calibrate(px.select("scene_id", F.lit("VV").alias("pol"), "r", "c", F.col("vv").alias("dn")), lut)
    return _r(out.select("scene_id", "r", "c", "a", "db"), 6, "a", "db")


def sar_normalise(spark: SparkSession, d: str) -> DataFrame:
    px = _pixels(spark, d).select("scene_id", "r", "c", raster.normalise(raster.decibels(F.col("vh"), F.lit(25.0))).alias("vh_norm"))
    return _r(px, 6, "vh_norm")


def mask_counts(spark: SparkSession, d: str) -> DataFrame:
    return raster.mask_counts(raster.masks(_pixels(spark, d)))


def scene_stats(spark: SparkSession, d: str) -> DataFrame:
    return _r(_r(raster.scene_stats(_pixels(spark, d)), 6, "p_min", "p_max", "p_mean"), 4, "p_sum")


def scene_percentiles(spark: SparkSession, d: str) -> DataFrame:
    out = raster.percentiles(_pixels(spark, d))
    return _r(out, 6, *out.columns[1:])


def downsample(spark: SparkSession, d: str) -> DataFrame:
    return _r(raster.downsample(_pixels(spark, d), 4).select("scene_id", "r", "c", "prob"), 6, "prob")


def _mask(spark: SparkSession, d: str) -> DataFrame:
    return raster.masks(_pixels(spark, d))


def mask_geometry(spark: SparkSession, d: str) -> DataFrame:
    m = _mask(spark, d).select("scene_id", "r", "c", F.col("core").cast("int").alias("is_oil"))
    out = raster.mask_geometry(m, (10.0, 0.0, 1000.0, 0.0, -10.0, 5000.0))
    return _r(out, 4, "centroid_x", "centroid_y")


def components_tile(spark: SparkSession, d: str) -> DataFrame:
    found = raster.tile_components(_mask(spark, d).where("oil"))
    return found.groupBy("scene_id", F.col("label").alias("component")).agg(F.count(F.lit(1)).alias("n"))


def _components(spark: SparkSession, d: str) -> DataFrame:
    return raster.component_stats(raster.scene_components(_mask(spark, d).where("oil")))


def components_scene(spark: SparkSession, d: str) -> DataFrame:
    return _r(_components(spark, d).select("scene_id", "component", "n", "r0", "r1", "c0", "c1", "density"), 6, "density")


def top_components(spark: SparkSession, d: str) -> DataFrame:
    top = raster.component_geometry(raster.without_speckle(_components(spark, d), 2, 1), 10.0, 1).where("rank <= 10")
    return _r(top.select("scene_id", "rank", "n", "area_m2", "perimeter_m", "centre_r", "centre_c"), 4, "area_m2")


def georeferenced(spark: SparkSession, d: str) -> DataFrame:
    """Components of two pixels and more on the ground, by the scenes' tie points."""
    return georef.component_shapes(raster.without_speckle(_components(spark, d), 2, 1), derived.ties(spark, d))


def georeferenced_components(spark: SparkSession, d: str) -> DataFrame:
    at = lambda ring, k, axis, digits: F.round(F.get(ring, k)[axis], digits)
    return georeferenced(spark, d).select(
        "scene_id", "rank", "n", F.col("zone").cast("bigint").alias("zone"), *[F.round(c, 1).alias(c) for c in ("area_m2", "perimeter_m")], *[F.round(c, 9).alias(c) for c in ("centroid_lon", "centroid_lat")],
        *[at("ring", k, axis, 9).alias(f"{name}{k}") for k in range(4) for axis, name in (("x", "lon"), ("y", "lat"))], *[at("utm", k, axis, 3).alias(f"{axis}{k}") for k in (0, 2) for axis in "xy"],
    )


def spill_totals(spark: SparkSession, d: str) -> DataFrame:
    out = georef.spill_totals(georeferenced(spark, d), raster.mask_counts(_mask(spark, d))).withColumn("zone", F.col("zone").cast("bigint"))
    out = _r(out, 1, "area_m2", "perimeter_m", "core_area_m2")
    return _r(_r(out, 9, "centroid_lon", "centroid_lat", "lon_min", "lon_max", "lat_min", "lat_max"), 3, "x_min", "x_max", "y_min", "y_max")


def tile_scoring(spark: SparkSession, d: str) -> DataFrame:
    px = _pixels(spark, d)
    rows = px.groupBy("scene_id", "tile_row", "tile_col").agg(F.array_sort(F.collect_list(F.struct("r", "c", "vv", "vh"))).alias("p"))
    tiles = rows.select(
        "scene_id", (F.col("tile_row") * 8).alias("row_off"), (F.col("tile_col") * 8).alias("col_off"), F.lit(8).alias("valid_h"), F.lit(8).alias("valid_w"),
        F.transform("p", lambda p: p["vv"]).alias("vv"), F.transform("p", lambda p: p["vh"]).alias("vh"),
    )
    return _r(raster.score_tiles(tiles, lambda: lambda vv, vh: vv / (1 + vv + vh), size=16), 6, "prob")


# -- catalogue and outputs ----------------------------------------------------


def incident_readiness(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("incident_id")
    name = lambda k, ext: F.concat(F.lit(f"{k}_"), n.cast("string"), F.lit(ext))
    incidents = _spills(spark, d).withColumn("expected_files", F.create_map(F.lit("ais"), name("ais", ".json"), F.lit("wind"), name("wind", ".nc"), F.lit("vv"), name("vv", ".tif")))
    kinds = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), e.alias("name")) for m, e in ((2, F.lit("ais.csv")), (3, name("ais", ".json")), (4, name("wind", ".nc")), (5, name("vv", ".tif")))]))
    listing = incidents.select("incident_id", kinds.alias("f")).where((F.col("incident_id") + 1) % F.col("f.m") != 0).select("incident_id", "f.name")
    ready = catalog.readiness(catalog.files_present(incidents, listing), incidents.select("incident_id", (n % 6 != 0).alias("model_present")))
    return ready.select("incident_id", "status", "n_missing", F.array_join("missing", ",").alias("missing"))


def incremental_pending(spark: SparkSession, d: str) -> DataFrame:
    """Incidents to which no vessel has come within two kilometres."""
    near = joins.search_area_join(_reports(spark, d), _incidents(spark, d).withColumn("within_km", F.lit(2.01)), "within_km")
    done = near.where(F.round(F.col("d_m") / 1000, 2) <= 2)
    return catalog.pending(_incidents(spark, d), done).select("incident_id", "name")


def geojson_features(spark: SparkSession, d: str) -> DataFrame:
    steps = drift.simulate(_spills(spark, d), 3, 3600)
    f = sinks.trajectory_features(steps)
    return f.select("incident_id", "kind", "step", F.get_json_object("feature", "$.geometry.type").alias("geometry_type"), F.get_json_object("feature", "$.properties.step").cast("bigint").alias("told_step"))


def risk_features(spark: SparkSession, d: str) -> DataFrame:
    f = sinks.risk_features(risk.assess(_reports(spark, d), _incidents(spark, d)))
    return f.select("incident_id", "vessel_id", F.get_json_object("feature", "$.properties.risk_level").alias("risk_level"), F.round(F.get_json_object("feature", "$.geometry.coordinates[0]").cast("double"), 6).alias("lon"))


def report_facts(spark: SparkSession, d: str) -> DataFrame:
    """One row per incident: place, source area, first vessel and its first four reasons."""
    top = attribution.evidence_lines(_top(spark, d, 1))
    facts = _incidents(spark, d).join(top.select("incident_id", "vessel_id", "score", "evidence"), "incident_id", "left")
    return facts.select("incident_id", "name", F.round("lon0", 6).alias("lon0"), F.round("lat0", 6).alias("lat0"), F.round(F.lit(3.141592653589793) * F.col("radius_km") * F.col("radius_km"), 2).alias("area_km2"), "vessel_id", "score", F.size(F.slice("evidence", 1, 4)).cast("bigint").alias("n_evidence"))


def candidate_distances(spark: SparkSession, d: str) -> DataFrame:
    """Candidates within 60 km of the origin, by the flat-earth distance of the map view."""
    last = tracks.latest(_reports(spark, d))
    # The flat distance is within two hundredths of the geodesic: cells for 62 km hold all of 60.
    places = last.select("vessel_id", "lon", "lat", "us")
    pairs = joins.search_area_join(places, _incidents(spark, d).select("incident_id", "lon0", "lat0", F.lit(62.0).alias("within_km")), "within_km")
    km = geo.equirectangular_km(F.col("lon0"), F.col("lat0"), F.col("lon"), F.col("lat"))
    return _r(pairs.withColumn("flat_km", km).where("flat_km <= 60").select("incident_id", "vessel_id", "flat_km"), 4, "flat_km")


def mask_to_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Oil mask to outline centre, backward drift, 40 km search area and scores, per scene."""
    m = _mask(spark, d).select("scene_id", "r", "c", F.col("core").cast("int").alias("is_oil"))
    shape = raster.mask_geometry(m, (0.01, 0.0, 124.5, 0.0, -0.005, 30.8)).where("has_oil")
    starts = shape.select(F.col("scene_id").alias("incident_id"), F.col("centroid_x").alias("lon0"), F.col("centroid_y").alias("lat0"), F.lit(10 * derived.DAY_US).alias("target_us"), F.lit(4.0).alias("wind_u"), F.lit(-2.0).alias("wind_v"), F.lit(0.2).alias("cur_u"), F.lit(0.1).alias("cur_v"))
    end = drift.simulate(starts, 24, 24 * 3600, direction="backward").where("step = 1")
    origin = end.select("incident_id", F.col("lon").alias("lon0"), F.col("lat").alias("lat0"), "target_us", F.lit(40.0).alias("radius_km"))
    near = joins.search_area_join(_reports(spark, d), origin, hours=120)
    s = tracks.summarize(near, "lon0", "lat0", ("incident_id", "vessel_id")).join(origin.select("incident_id", "target_us"), "incident_id")
    p = attribution.prototype(_r(s, 2, "distance_m").withColumn("heading_spread", F.round("heading_std", 4)))
    return p.where("rank <= 20").select("incident_id", "vessel_id", "rank", "overall_score", "temporal_proximity", "heading_consistency")
