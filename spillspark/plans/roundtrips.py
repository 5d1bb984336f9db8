"""Registered queries of readers and sinks (written, read back), shapes and whole chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spillspark.functions import geo
from spillspark.operators import attribution, catalog, outlines, raster, risk, tracks
from spillspark.plans import investigate, queries
from spillspark.plans.manifest import Input, Store
from spillspark.sources import derived, readers, sinks, workspace
from spillspark.sources.workspace import new_folder

US = "timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', cast({} AS timestamp_ntz))"


def _text(ts: str) -> Column:
    return F.date_format(F.col(ts).cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss.SSSSSS")


def _documents(rows: DataFrame, key: str, path: str) -> str:
    """One JSON array per key, a file each."""
    body = F.concat(F.lit("["), F.array_join(F.collect_list("record"), ","), F.lit("]"))
    rows.groupBy(key).agg(body.alias("value")).write.partitionBy(key).text(path)
    return path


# -- readers ------------------------------------------------------------------


def csv_reports(spark: SparkSession, d: str) -> DataFrame:
    """Reports written as CSV under other headers, some without a name or a latitude."""
    every = F.col("user_id") % 3 == 0
    rows = derived.ais(spark, d).select(
        _text("ts").alias("Obs_Time"), F.when(~every, F.col("vessel_id")).alias("Ship_Name"), F.col("user_id").cast("double").alias("MMSI"),
        F.when(F.col("event_id") % 10 != 0, F.col("lat")).alias("Lat"), F.col("lon").alias("Lon"), F.col("speed").alias("SOG_kn"), F.col("heading").alias("Heading"),
    )
    path = new_folder(spark, "csv")
    rows.write.option("header", True).csv(path)
    got = readers.ais_csv(spark, path)
    return got.select("vessel_id", "mmsi", F.expr(US.format("timestamp_utc")).alias("us"), F.round("latitude", 6).alias("lat"), F.round("longitude", 6).alias("lon"), F.col("speed_knots").alias("speed"), F.col("heading_deg").alias("heading"))


def json_reports(spark: SparkSession, d: str) -> DataFrame:
    """Reports written as JSON arrays under aliases, some times unreadable, some speeds missing."""
    kind = F.col("user_id") % 4
    when = F.when(F.col("event_id") % 11 == 0, "junk").otherwise(_text("ts"))
    speed = F.when(F.col("event_id") % 7 != 0, F.col("speed"))
    record = F.to_json(F.struct(
        F.when(kind == 0, F.col("vessel_id")).alias("vessel_id"), F.when(kind == 1, F.col("user_id")).alias("mmsi"), F.when(kind == 2, F.concat(F.lit("N"), "user_id")).alias("name"),
        F.when(kind < 2, when).alias("timestamp_utc"), F.when(kind >= 2, when).alias("time"), F.when(kind < 2, speed).alias("sog"), F.when(kind >= 2, speed).alias("speed_kts"),
        F.col("heading").alias("cog"), F.col("lon").alias("longitude"), F.col("lat"),
    ))
    path = _documents(derived.ais(spark, d).select((F.col("user_id") % 32).alias("part"), record.alias("record")), "part", new_folder(spark, "json"))
    got = readers.ais_json(spark, path)
    return got.select("vessel_id", F.expr(US.format("timestamp")).alias("us"), (F.col("timestamp") == F.col("timestamp_utc")).alias("mirrored"), F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "speed", "heading")


def environment_files(spark: SparkSession, d: str) -> DataFrame:
    """A file of wind and current per region, read back with the drift they make."""
    mean = derived.spills(spark, d).groupBy("region_id").agg(*[F.avg(c).alias(c) for c in ("wind_u", "wind_v", "cur_u", "cur_v")])
    record = F.to_json(F.struct(F.array("wind_u", "wind_v").alias("wind"), F.array("cur_u", "cur_v").alias("current")))
    path = new_folder(spark, "environment")
    mean.select("region_id", record.alias("value")).write.partitionBy("region_id").text(path)
    got = readers.environment_json(spark, path)
    names = ("wind_u", "wind_v", "cur_u", "cur_v")
    return got.select(F.col("region_id").cast("bigint").alias("region_id"), *[F.round(c, 6).alias(c) for c in names])


def grid_slices(spark: SparkSession, d: str) -> DataFrame:
    """Mean speed and heading of reports per cell, day and depth; the first slice is read, gaps get the field's mean."""
    cells = derived.ais(spark, d).select(
        (F.col("user_id") % 5).alias("field_id"), F.expr(f"us div {10 * derived.DAY_US}").alias("time"), (F.col("event_id") % 2).alias("depth"),
        (F.floor(F.col("lat") * 4) / 4).alias("latitude"), (F.floor(F.col("lon") * 4) / 4).alias("longitude"), "speed", "heading",
    )
    mean = cells.groupBy("field_id", "time", "depth", "latitude", "longitude").agg(F.avg("speed").alias("u"), F.coalesce(F.avg("heading"), F.lit(float("nan"))).alias("v"))
    path = new_folder(spark, "grid")
    mean.write.parquet(path)
    from spillspark.operators import drift

    filled = drift.fill_grid(readers.grid_table(spark.read.parquet(path)))
    return filled.select("field_id", "lat", "lon", F.round("u", 6).alias("u"), F.round("v", 6).alias("v"))


def vector_grid_cells(spark: SparkSession, d: str) -> DataFrame:
    """A vessel's reports as a grid four wide; those that don't fill it are left out."""
    point = F.struct("us", "event_id", "speed", F.coalesce("heading", F.lit(-1.0)).alias("heading"))
    p = derived.ais(spark, d).groupBy("user_id").agg(F.array_sort(F.collect_list(point)).alias("p"))
    rows = p.select(
        F.col("user_id").alias("grid_id"), F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0)).alias("bounds"), F.lit(4).alias("width"), F.expr("cast(size(p) div 4 AS int)").alias("height"),
        F.transform("p", lambda x: x["speed"]).alias("u"), F.transform("p", lambda x: x["heading"]).alias("v"),
    )
    return readers.vector_grids(rows).select("grid_id", F.col("row").cast("bigint").alias("row"), F.col("col").cast("bigint").alias("col"), "u", "v")


def _annotation(spark: SparkSession, d: str, element: Column, name: str) -> str:
    """XML of ``element`` (of scene_id, line, pixel lists, level) per scene, a file each."""
    scenes = derived.pixels(spark, d).groupBy("scene_id").agg(F.round(F.avg("vv"), 3).alias("level"))
    lines = scenes.withColumn("line", F.explode(F.sequence(F.lit(0), F.lit(300), F.lit(50))))
    text = lines.select("scene_id", element.alias("e")).groupBy("scene_id").agg(F.concat(F.lit("<root>"), F.array_join(F.collect_list("e"), ""), F.lit("</root>")).alias("value"))
    path = new_folder(spark, name)
    text.write.partitionBy("scene_id").text(path)
    return path


def calibration_scan(spark: SparkSession, d: str) -> DataFrame:
    a = F.transform(F.sequence(F.lit(0), F.lit(160), F.lit(40)), lambda x: F.col("level") + F.col("line") * 0.5 + x * 0.25)
    element = F.concat(F.lit("<calibrationVector><line>"), F.col("line").cast("string"), F.lit("</line><pixel count=\"5\">0 40 80 120 160</pixel><sigmaNought>"), F.array_join(a.cast("array<string>"), " "), F.lit("</sigmaNought></calibrationVector>"))
    got = readers.calibration_xml(spark, _annotation(spark, d, element, "calibration"), None, "VV")
    return got.select("scene_id", "pol", "line", "pixel", F.round("a_sigma", 6).alias("a_sigma"))


def pixel_geolocation(spark: SparkSession, d: str) -> DataFrame:
    """Every fourth pixel's position by the tie points of its scene's annotation."""
    point = lambda x: F.concat(
        F.lit("<geolocationGridPoint><line>"), F.col("line").cast("string"), F.lit("</line><pixel>"), x.cast("string"), F.lit("</pixel><latitude>"), (31 - F.col("line") * 0.005).cast("string"),
        F.lit("</latitude><longitude>"), (124 + x * 0.01 + F.col("scene_id") * 0.1).cast("string"), F.lit("</longitude></geolocationGridPoint>"),
    )
    element = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(160), F.lit(40)), point), "")
    ties = readers.geolocation_xml(spark, _annotation(spark, d, element, "geolocation"), None)
    few = raster.downsample(derived.pixels(spark, d), 4).select("scene_id", (F.col("r") * 4).alias("line"), (F.col("c") * 4).alias("pixel"))
    at = readers.pixel_positions(few, ties)
    return at.select("scene_id", F.col("line").cast("bigint").alias("line"), F.col("pixel").cast("bigint").alias("pixel"), F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


def incident_catalogue(spark: SparkSession, d: str) -> DataFrame:
    """A metadata file per supplier, some broken, scanned by folder."""
    s = spark.read.parquet(f"{d}/supplier.parquet")
    location = F.struct(F.concat(F.lit("R"), F.col("s_nationkey").cast("string")).alias("region"), (F.col("s_suppkey") * 0.25).alias("approximate_latitude"))
    files = F.create_map(F.lit("ais"), F.concat("s_name", F.lit(".csv")), F.lit("wind"), F.lit("w.nc"))
    record = F.to_json(F.struct(F.concat(F.lit("I"), F.col("s_suppkey").cast("string")).alias("incident_id"), F.col("s_name").alias("name"), location.alias("location"), files.alias("expected_files")))
    path = new_folder(spark, "incidents")
    broken = F.col("s_suppkey") % 7 == 0
    sinks.write_folders(s.select(F.col("s_suppkey").alias("folder"), F.when(broken, "{broken").otherwise(record).alias("value")), path, "folder")
    got = readers.incident_metadata(spark, path, "part-*")
    return got.select("incident_id", "name", "location.region", F.col("location.approximate_latitude").alias("lat"), F.size("expected_files").cast("bigint").alias("n_expected"), F.element_at("expected_files", "ais").alias("ais_file"))


def format_classes(spark: SparkSession, d: str) -> DataFrame:
    endings = F.array(*[F.lit(x) for x in (".csv", ".JSON", ".nc4", ".tiff", ".zip", ".txt", ".NC")])
    path = F.concat(F.col("p_name"), F.lit("_"), F.col("p_partkey").cast("string"), F.get(endings, (F.col("p_partkey") % 7).cast("int")))
    kinds = spark.read.parquet(f"{d}/part.parquet").select(catalog.format_class(path).alias("kind"))
    return kinds.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def summary_aliases(spark: SparkSession, d: str) -> DataFrame:
    """Vessel summaries whose fields have other names: times, distances in metres or kilometres, speeds."""
    s = tracks.summarize(derived.ais(spark, d).withColumns({"x0": F.lit(125.0), "y0": F.lit(30.0)}), "x0", "y0")
    k = F.expr("cast(substr(vessel_id, 2) AS bigint) % 5")
    at = F.date_format(F.timestamp_add("MICROSECOND", F.col("first_us"), F.expr("timestamp_ntz'2024-01-01 00:00:00'")), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    d_m = F.round("distance_m", 1)
    told = s.select(
        "vessel_id", F.when(k == 0, at).when(k == 1, "junk").alias("first_timestamp"), F.when(k == 1, at).alias("timestamp"), F.when(k >= 2, at).alias("closest_timestamp"),
        F.when(k == 0, d_m).alias("distance_m"), F.when(k == 1, d_m).alias("distance"), F.when(k == 2, d_m / 1000).alias("distance_km"),
        F.when(k < 2, F.round("mean_speed", 6)).alias("sog"), F.when(k >= 2, F.round("mean_speed", 6)).alias("speed_knots"), F.round("heading_std", 4).alias("course"),
    )
    got = readers.summaries(told)
    return got.select("vessel_id", F.expr(US.format("first_ts")).alias("first_us"), F.round("distance_m", 1).alias("distance_m"), "speed", F.col("heading").alias("course"))


def vessel_keys(spark: SparkSession, d: str) -> DataFrame:
    """The three flavours of a vessel's key, from columns that are partly empty."""
    k = F.col("c_custkey")
    rows = spark.read.parquet(f"{d}/customer.parquet").select(
        k.alias("ordinal"), F.when(k % 2 == 0, "").otherwise(F.concat(F.lit("C"), k.cast("string"))).alias("vessel_id"), F.when(k % 3 == 0, k.cast("double")).alias("mmsi"),
        F.when(k % 5 == 0, F.concat(F.lit(" "), "c_name", F.lit(" "))).otherwise(" ").alias("vessel_name"), F.when(k % 7 == 0, F.col("c_name")).alias("name"),
    )
    return rows.select("ordinal", readers.vessel_key(rows).alias("key_id"), readers.vessel_key(rows, "name").alias("key_name"), readers.vessel_key(rows, "truthy", "ordinal").alias("key_truthy"))


def input_validation(spark: SparkSession, d: str) -> DataFrame:
    """Uploads of each customer's analysis against the rules of its mode."""
    category = F.get(F.array(*[F.lit(c) for c in ("sentinel", "wind", "current", "ais")]), (F.col("o_orderkey") % 4).cast("int"))
    uploads = spark.read.parquet(f"{d}/orders.parquet").select(
        F.col("o_custkey").alias("analysis_id"), F.when(F.col("o_custkey") % 2 == 0, "historical").otherwise("early").alias("mode"), category.alias("category"), (F.col("o_orderkey") % 3 != 0).alias("valid")
    )
    rules = spark.sql("SELECT mode, category, CASE WHEN category = 'sentinel' OR mode = 'historical' AND category = 'ais' THEN 'error' ELSE 'warning' END AS severity FROM VALUES ('historical'), ('early') AS m(mode), (VALUES ('sentinel'), ('wind'), ('current'), ('ais')) AS c(category)")
    got = catalog.validate_inputs(uploads, rules)
    return got.select("analysis_id", F.array_join("errors", ",").alias("errors"), F.array_join("warnings", ",").alias("warnings"), "can_run")


# -- sinks --------------------------------------------------------------------


def closest_points(spark: SparkSession, d: str) -> DataFrame:
    found = attribution.scored(attribution.evidence(derived.ais(spark, d), derived.incidents(spark, d)))
    path = new_folder(spark, "closest")
    sinks.write_features(sinks.closest_features(attribution.ranked(found).where("rank <= 3")), path)
    read = spark.read.text(path)
    told = lambda p: F.get_json_object("value", f"$.{p}")
    return read.select(
        told("properties.vessel_id").alias("vessel_id"), told("geometry.type").alias("kind"), F.round(told("geometry.coordinates[0]").cast("double"), 6).alias("lon"), F.round(told("geometry.coordinates[1]").cast("double"), 6).alias("lat"),
        told("properties.d_source_km").cast("double").alias("d_source_km"), told("properties.score").cast("double").alias("score"),
    )


def zone_polygons(spark: SparkSession, d: str) -> DataFrame:
    """Impact zones as polygons, read back, with their area, length and box on the plane."""
    _, end = risk.forecast(derived.spills(spark, d), 6)
    path = new_folder(spark, "zones")
    sinks.write_features(sinks.zone_features(end), path)
    shape = "struct<properties:struct<incident_id:bigint,radius_zone_km:double>,geometry:struct<type:string,coordinates:array<array<array<double>>>>>"
    f = spark.read.text(path).select(F.from_json("value", shape).alias("f"))
    points = F.transform(F.get("f.geometry.coordinates", 0), lambda p: F.struct(*[v.alias(n) for n, v in zip("xy", geo.to_mercator(p[0], p[1]), strict=True)]))
    got = f.select("f.properties.incident_id", F.col("f.geometry.type").alias("kind"), points.alias("ring"))
    xs = F.transform("ring", lambda p: p["x"])
    return got.select("incident_id", "kind", F.size("ring").cast("bigint").alias("n_points"), F.round(geo.ring_area(F.col("ring")), 0).alias("area_m2"), F.round(geo.ring_length(F.col("ring")), 1).alias("length_m"), F.round(F.array_max(xs) - F.array_min(xs), 1).alias("width_m"))


def component_shapes(spark: SparkSession, d: str) -> DataFrame:
    """The first quarter of each scene's georeferenced components, written as GeoJSON and read back."""
    path = new_folder(spark, "components")
    sinks.write_features(sinks.component_features(queries.georeferenced(spark, d), core=True), path)
    props = "component_id:bigint,area_m2:double,area_km2:double,perimeter_m:double,centroid_lat:double,centroid_lon:double,pixel_count_approx:bigint"
    f = F.from_json("value", f"struct<properties:struct<{props}>,geometry:struct<type:string,coordinates:array<array<array<double>>>>>")
    got = spark.read.text(path).select(f.alias("f")).select("f.properties.*", F.col("f.geometry.type").alias("kind"), F.get("f.geometry.coordinates", 0).alias("p"))
    ends = [F.round(F.get(F.get("p", k), i), 9).alias(f"{n}{k}") for k in range(3) for i, n in enumerate(("lon", "lat"))]
    return got.select("component_id", "area_m2", "area_km2", "perimeter_m", "centroid_lat", "centroid_lon", "pixel_count_approx", "kind", F.size("p").cast("bigint").alias("n_points"), *ends)


def result_documents(spark: SparkSession, d: str) -> DataFrame:
    """Risk results as nested documents per incident; one incident is written twice, and its last document counts."""
    graded = risk.assess(derived.ais(spark, d), derived.incidents(spark, d))
    entry = F.struct("vessel_id", "risk_level", "d_trajectory_km")
    rows = graded.groupBy("incident_id").agg(F.array_sort(F.collect_list(entry)).alias("vessels"), F.count(F.lit(1)).alias("n"))
    path = new_folder(spark, "results")
    sinks.write_documents(rows, path)
    sinks.write_documents(rows.where("incident_id = 3").withColumn("n", -F.col("n")), path)
    got = spark.read.schema("incident_id bigint, n bigint, vessels array<struct<vessel_id:string,risk_level:string,d_trajectory_km:double>>").json(path)
    return got.select("incident_id", "n", F.inline("vessels"))


def raster_tiles(spark: SparkSession, d: str) -> DataFrame:
    """The raster written by scene and tile, and one row of tiles of each scene read back."""
    path = new_folder(spark, "raster")
    sinks.write_tiles(derived.pixels(spark, d).select("scene_id", "r", "c", "prob"), path, 32)
    band = spark.read.parquet(path).where("row_off >= 32 and row_off < 96")
    out = band.groupBy(F.col("scene_id").cast("bigint").alias("scene_id"), "row_off", "col_off").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("prob"), 6).alias("prob"))
    return out


# -- raster and chains --------------------------------------------------------


#: Degrees a pixel, and the place of the first.
DEGREES = (0.01, 0.0, 124.5, 0.0, -0.005, 30.8)


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    return raster.scene_components(raster.masks(derived.pixels(spark, d)).where("oil"))


def outline_rings(spark: SparkSession, d: str) -> DataFrame:
    """Boundary rings of components, stitched over tiles: one shell each, holes, signed areas, sides and corners."""
    found = outlines.rings(_labelled(spark, d), 32)
    shell, hole = F.col("is_shell"), ~F.col("is_shell")
    return found.groupBy("scene_id", "component").agg(
        F.count_if(shell).alias("n_shells"), F.count_if(hole).alias("n_holes"), (F.sum("twice") / 2).cast("bigint").alias("area"), F.sum("sides").alias("sides"), F.sum(F.size("points") - 1).alias("n_corners"),
        F.count_if(F.element_at("points", 1) != F.element_at("points", -1)).alias("n_open"),
    )


def spill_polygons(spark: SparkSession, d: str) -> DataFrame:
    """Slicks of a map in degrees as one GeoJSON MultiPolygon per scene, read back, with their areas in square metres."""
    labelled = workspace.written(_labelled(spark, d), "labelled")
    path = new_folder(spark, "polygons")
    shapes = outlines.polygons(outlines.rings(labelled, 64), DEGREES)
    sinks.write_documents(outlines.multipolygons(shapes), path, "scene_id")
    read = F.from_json("document", "struct<type:string,coordinates:array<array<array<array<double>>>>>")
    parts = spark.read.schema("scene_id bigint, document string").json(path).select("scene_id", read.alias("g")).select("scene_id", "g.type", F.posexplode("g.coordinates").alias("k", "rings"))
    order = Window.partitionBy("scene_id").orderBy("component")
    areas = outlines.measures(outlines.chains(labelled, 64), DEGREES, geographic=True).withColumn("k", F.row_number().over(order) - 1)
    first = F.get(F.get("rings", 0), 0)
    ends = F.forall("rings", lambda x: F.element_at(x, 1) == F.element_at(x, -1))
    return parts.join(areas, ["scene_id", "k"]).select(
        "scene_id", "component", "type", (F.size("rings") - 1).cast("bigint").alias("n_holes"), F.aggregate("rings", F.lit(0), lambda s, x: s + F.size(x) - 1).cast("bigint").alias("n_corners"), ends.alias("closed"),
        F.round(F.array_min(F.transform(F.get("rings", 0), lambda p: p[0])), 6).alias("lon_min"), F.round(F.array_max(F.transform(F.get("rings", 0), lambda p: p[1])), 6).alias("lat_max"), F.size(first).cast("bigint").alias("axes"),
        F.round("area_m2", 1).alias("area_m2"), F.round("perimeter_m", 2).alias("perimeter_m"),
    )


def tile_grid(spark: SparkSession, d: str) -> DataFrame:
    scenes = derived.pixels(spark, d).groupBy("scene_id").agg((F.max("r") + 1).cast("int").alias("height"), (F.max("c") + 1).cast("int").alias("width"))
    t = raster.tile_grid(scenes, 48)
    return t.select("scene_id", *[F.col(c).cast("bigint").alias(c) for c in ("row_off", "col_off", "valid_h", "valid_w", "pad_h", "pad_w")])


def overlap_mean(spark: SparkSession, d: str) -> DataFrame:
    """Tiles that overlap by half a tile: the mean where they do."""
    px = derived.pixels(spark, d).select("scene_id", "r", "c", "prob")
    both = px.unionByName(px.where("r % 8 < 4").withColumn("prob", F.col("prob") / 2))
    return raster.overlap_average(both).select("scene_id", "r", "c", F.round("prob", 6).alias("prob"))


def band_join(spark: SparkSession, d: str) -> DataFrame:
    """Probability and bands as rasters of their own, joined on the grid, and the masks of the result."""
    one = lambda c: derived.pixels(spark, d).select("scene_id", "r", "c", F.col(c).alias("value"))
    both = raster.co_registered(one("prob"), one("vv").where("value >= 2"), one("vh").where("value <> 5"))
    return raster.mask_counts(raster.masks(both))


def turned_outline(spark: SparkSession, d: str) -> DataFrame:
    """Mask geometry under an affine map that turns and shears."""
    m = raster.masks(derived.pixels(spark, d)).select("scene_id", "r", "c", F.col("core").cast("int").alias("is_oil"))
    out = raster.mask_geometry(m, (8.0, 3.0, 1000.0, 6.0, -4.0, 5000.0))
    return out.select("scene_id", "pixel_count", "area_m2", *[F.round(c, 4).alias(c) for c in ("perimeter_m", "centroid_x", "centroid_y")], "x_min", "y_min", "x_max", "y_max")


def analysis_view(spark: SparkSession, d: str) -> DataFrame:
    """Nested results of scenes as flat rows."""
    m = raster.masks(derived.pixels(spark, d)).select("scene_id", "r", "c", F.col("core").cast("int").alias("is_oil"))
    g = raster.mask_geometry(m, DEGREES, geographic=True)
    spill = F.struct("area_m2", "perimeter_m", F.struct(F.col("centroid_x").alias("x"), F.col("centroid_y").alias("y")).alias("centroid"), F.array("x_min", "y_min", "x_max", "y_max").alias("bbox"))
    candidates = F.array(F.struct(F.concat(F.lit("V"), F.col("scene_id").cast("string")).alias("vessel_id"), (F.col("pixel_count") / 1000).alias("score")))
    flat = readers.analysis_view(g.select(F.col("scene_id").alias("analysis_id"), F.lit("complete").alias("status"), spill.alias("spill"), candidates.alias("candidates")))
    return flat.select("analysis_id", "status", F.round("area_m2", 0).alias("area_m2"), F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), F.round(geo.ring_area(F.col("polygon")), 6).alias("box_area"), F.size("polygon").cast("bigint").alias("n_corners"), "top_vessel", F.round("top_score", 6).alias("top_score"))


def leg_speeds(spark: SparkSession, d: str) -> DataFrame:
    """Speed in knots and direction on eight points of each leg."""
    legs = tracks.legs(derived.ais(spark, d)).where("leg_s > 0")
    way = geo.compass(F.col("lon") - F.col("lon_from"), F.col("lat") - F.col("lat_from"), geo.COMPASS_8)
    return legs.select("vessel_id", "us", F.round(geo.knots(F.col("leg_m") / F.col("leg_s")), 4).alias("knots"), way.alias("direction"))


def scene_detection(spark: SparkSession, d: str) -> DataFrame:
    """Calibration, normalisation, tiles, scores, statistics of whole scenes in one chain."""
    px = derived.pixels(spark, d).select("scene_id", "r", "c", "vv", "vh")
    nodes = px.select("scene_id").distinct().join(F.broadcast(spark.range(70).select(F.expr("id div 35").alias("p"), F.expr("id % 35 div 5 * 50").alias("line"), F.expr("id % 5 * 40").alias("pixel"))))
    lut = nodes.select("scene_id", F.when(F.col("p") == 0, "VV").otherwise("VH").alias("pol"), "line", "pixel", (400.0 + F.col("p") * 100 + F.col("line") * 0.5 + F.col("pixel") * 0.25).alias("a_sigma"))
    scored = investigate.scene_detection(px, lut, lambda: lambda vv, vh: vv / (0.25 + vv + vh), 64)
    out = investigate.detection_report(scored)
    return out.select("scene_id", *[F.round(c, 6).alias(c) for c in ("p_min", "p_max", "p_mean", "p10", "p50", "p99")], "n_pixels", "n_valid", "n_oil", "n_core")


def _inputs(spark: SparkSession, d: str) -> dict[str, Input]:
    """What the investigations of all scenes read."""
    px = derived.pixels(spark, d).select(F.col("scene_id").alias("incident_id"), "r", "c", "vv", "vh")
    scenes = px.select("incident_id").distinct()
    nodes = scenes.join(F.broadcast(spark.range(70).select(F.expr("id div 35").alias("p"), F.expr("id % 35 div 5 * 50").alias("line"), F.expr("id % 5 * 40").alias("pixel"))))
    lut = nodes.select("incident_id", F.when(F.col("p") == 0, "VV").otherwise("VH").alias("pol"), "line", "pixel", (400.0 + F.col("p") * 100 + F.col("line") * 0.5 + F.col("pixel") * 0.25).alias("a_sigma"))
    times = scenes.select("incident_id", (F.col("incident_id") % 5).alias("field_id"), F.lit(10 * derived.DAY_US).alias("target_us"))
    return {
        "pixels": Input(px), "lut": Input(lut), "ties": Input(derived.ties(spark, d).withColumnRenamed("scene_id", "incident_id")), "times": Input(times),
        "winds": Input(queries.winds(times.select("field_id").distinct(), -3, 10), None), "reports": Input(derived.ais(spark, d), None),
    }


def full_investigation(spark: SparkSession, d: str) -> DataFrame:
    """Detection, geometry, drift and attribution of every scene; half of the scenes were investigated before and are reused."""
    inputs = _inputs(spark, d)
    scenes = inputs["times"].rows.select("incident_id")
    store = Store(spark, new_folder(spark, "investigation"))
    chain = investigate.stages(lambda: lambda vv, vh: vv / (0.02 + vv + vh), "ratio", tile=64, least_pixels=2, hours=24)
    store.run(scenes.where("incident_id % 2 = 0"), inputs, chain)
    out = investigate.investigation(store, scenes, inputs, chain)
    return out.select(
        "incident_id", F.round("area_m2", 1).alias("area_m2"), "n_components", "n_oil", F.round("centroid_lon", 7).alias("centroid_lon"), F.round("origin.lon", 5).alias("origin_lon"), F.round("origin.lat", 5).alias("origin_lat"), F.col("origin.us").alias("origin_us"),
        "vessel_id", "rank", "d_source_km", "d_trajectory_km", "in_zone_count", "score",
    )


NAMES = (
    "csv_reports", "json_reports", "environment_files", "grid_slices", "vector_grid_cells", "calibration_scan", "pixel_geolocation", "incident_catalogue",
    "format_classes", "summary_aliases", "vessel_keys", "input_validation", "closest_points", "zone_polygons", "component_shapes", "result_documents",
    "raster_tiles", "outline_rings", "spill_polygons", "tile_grid", "overlap_mean", "band_join", "turned_outline", "analysis_view", "leg_speeds", "scene_detection",
    "full_investigation",
)

QUERIES = {name: globals()[name] for name in NAMES}
