"""Readers: position reports, environment fields, radar annotation, catalogues.

Inputs are normalised to a fixed schema here, never downstream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Accepted names of each field, exact names first, then parts of names, in this order.
FIELDS = {
    "timestamp_utc": (("timestamp_utc", "timestamp", "time", "datetime"), ("time", "date")),
    "vessel_name": (("vessel_name", "name"), ("vessel", "name")),
    "mmsi": (("mmsi",), ("mmsi",)),
    "latitude": (("latitude", "lat"), ("lat",)),
    "longitude": (("longitude", "lon"), ("lon",)),
    "speed_knots": (("speed_knots", "sog", "sog_knots", "speed"), ("sog", "speed")),
    "course_deg": (("cog_deg", "cog", "course"), ("cog", "course")),
    "heading_deg": (("heading_deg", "heading"), ("heading",)),
}
REQUIRED = ("timestamp_utc", "latitude", "longitude")
TIME_ALIASES = ("timestamp_utc", "timestamp", "time", "datetime")
SUMMARY_TIME_ALIASES = ("first_timestamp", "timestamp_utc", "timestamp", "closest_timestamp", "time", "datetime")
SPEED_ALIASES = ("speed", "speed_knots", "sog", "speed_kts")
HEADING_ALIASES = ("heading", "heading_deg", "cog", "course")
DISTANCE_ALIASES = (("distance_m", 1.0), ("distance", 1.0), ("distance_km", 1000.0))


def header_map(columns: list[str]) -> dict[str, str]:
    """Field to column: exact names before parts, each column used once.

    A required field without a column, or two columns of one exact name
    (whatever their case), is an error.
    """
    lower = [c.strip().lower() for c in columns]
    if len(set(lower)) < len(lower):
        raise ValueError("columns repeat: " + ", ".join(sorted({c for c in lower if lower.count(c) > 1})))
    out: dict[str, str] = {}
    free = dict(zip(lower, columns, strict=True))
    for field, (exact, _) in FIELDS.items():
        hit = next((x for x in exact if x in free), None)
        if hit:
            out[field] = free.pop(hit)
    for field, (_, parts) in FIELDS.items():
        if field not in out and (hit := next((c for p in parts for c in free if p in c), None)):
            out[field] = free.pop(hit)
    if missing := [f for f in REQUIRED if f not in out]:
        raise ValueError("no column for " + ", ".join(missing))
    return out


def parse_time(*columns: Column, strict: bool = False) -> Column:
    """First non-empty of the columns as a timestamp; zones are honoured, none means UTC (session zone).

    Unreadable text is null, or an error with ``strict``.
    """
    text = F.coalesce(*[F.nullif(F.trim(c.cast("string")), F.lit("")) for c in columns])
    return F.to_timestamp(text) if strict else F.try_to_timestamp(text)


def pick(df: DataFrame, names: tuple[str, ...], kind: str) -> Column:
    """First non-null of those of ``names`` that ``df`` has."""
    found = [F.expr(f"try_cast(`{n}` AS {kind})") for n in names if n in df.columns]
    return F.coalesce(*found) if found else F.lit(None).cast(kind)


def vessel_key(df: DataFrame, flavour: str = "id", ordinal: str | None = None) -> Column:
    """Vessel key. id: vessel_id, mmsi, name. name: trimmed name, else MMSI_n. truthy: first non-empty, else VESSEL-n."""
    text = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) if c in df.columns else F.lit(None).cast("string")
    number = F.expr("cast(try_cast(mmsi AS bigint) AS string)") if "mmsi" in df.columns else F.lit(None).cast("string")
    if flavour == "id":
        return F.coalesce(text("vessel_id"), text("mmsi"), text("name"), F.lit("UNKNOWN"))
    if flavour == "name":
        return F.coalesce(text("vessel_name"), F.concat(F.lit("MMSI_"), number), F.lit("UNKNOWN"))
    last = F.concat(F.lit("VESSEL-"), F.col(ordinal).cast("string")) if ordinal else F.lit("UNKNOWN")
    return F.coalesce(text("vessel_id"), text("mmsi"), text("vessel_name"), text("name"), last)


def ais_csv(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Position reports from CSV with any of the known headers; all fields present, typed."""
    raw = spark.read.csv(path, header=True)
    names = header_map(raw.columns)
    at = lambda f, kind: F.expr(f"try_cast(`{names[f]}` AS {kind})").alias(f) if f in names else F.lit(None).cast(kind).alias(f)
    rows = raw.select(
        parse_time(F.col(names["timestamp_utc"]), strict=strict).alias("timestamp_utc"),
        at("vessel_name", "string"), F.expr(f"try_cast(try_cast(`{names['mmsi']}` AS double) AS bigint)").alias("mmsi") if "mmsi" in names else F.lit(None).cast("bigint").alias("mmsi"),
        at("latitude", "double"), at("longitude", "double"), at("speed_knots", "double"), at("course_deg", "double"), at("heading_deg", "double"),
    )
    return rows.where("latitude is not null and longitude is not null and timestamp_utc is not null").withColumn("vessel_id", vessel_key(rows, "name"))


def normalised(df: DataFrame, observed: Column | None = None) -> DataFrame:
    """Records with aliased fields to vessel_id, lon, lat, ts, us, speed, heading; bad rows dropped.

    ``observed`` stands in where a record has no readable time.
    """
    ts = parse_time(*[F.col(c) for c in TIME_ALIASES if c in df.columns]) if any(c in df.columns for c in TIME_ALIASES) else F.lit(None).cast("timestamp")
    ts = F.coalesce(ts, observed) if observed is not None else ts
    out = df.select(
        vessel_key(df).alias("vessel_id"), pick(df, ("longitude", "lon"), "double").alias("lon"), pick(df, ("latitude", "lat"), "double").alias("lat"),
        ts.alias("ts"), pick(df, SPEED_ALIASES, "double").alias("speed"), pick(df, HEADING_ALIASES, "double").alias("heading"),
    )
    kept = out.where("lon is not null and lat is not null and ts is not null")
    base = 1_704_067_200_000_000  # 2024-01-01 UTC
    return kept.withColumn("us", F.unix_micros("ts") - base).withColumns({"timestamp": F.col("ts"), "timestamp_utc": F.col("ts")})


def summaries(df: DataFrame) -> DataFrame:
    """Vessel summaries with aliased fields to vessel_id, first_ts, distance_m, speed, heading.

    The first readable time counts, in the order of its names; a missing distance is 0 m.
    """
    times = [parse_time(F.col(c)) for c in SUMMARY_TIME_ALIASES if c in df.columns]
    metres = [F.expr(f"try_cast(`{c}` AS double)") * unit for c, unit in DISTANCE_ALIASES if c in df.columns]
    return df.select(
        vessel_key(df).alias("vessel_id"),
        (F.coalesce(*times) if times else F.lit(None).cast("timestamp")).alias("first_ts"),
        F.coalesce(*metres, F.lit(0.0)).alias("distance_m"),
        pick(df, SPEED_ALIASES, "double").alias("speed"), pick(df, HEADING_ALIASES, "double").alias("heading"),
    )


def analysis_view(results: DataFrame) -> DataFrame:
    """Nested analysis results to one flat row each, with the box as a closed polygon ring.

    ``results``: analysis_id, status, spill struct<area_m2, perimeter_m,
    centroid struct<x, y>, bbox array of x_min, y_min, x_max, y_max>, candidates
    array of struct<vessel_id, score>.
    """
    x0, y0, x1, y1 = (F.get("spill.bbox", i) for i in range(4))
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    ring = F.array(corner(x0, y0), corner(x1, y0), corner(x1, y1), corner(x0, y1), corner(x0, y0))
    return results.select(
        "analysis_id", "status", F.col("spill.area_m2").alias("area_m2"), F.col("spill.perimeter_m").alias("perimeter_m"),
        F.col("spill.centroid.x").alias("lon"), F.col("spill.centroid.y").alias("lat"),
        F.when(F.size("spill.bbox") == 4, ring).alias("polygon"),
        F.coalesce(F.size("candidates"), F.lit(0)).alias("n_candidates"), F.get("candidates", 0)["vessel_id"].alias("top_vessel"), F.get("candidates", 0)["score"].alias("top_score"),
    )


def ais_json(spark: SparkSession, path: str) -> DataFrame:
    """Position reports from a JSON array; a missing speed is 0."""
    return normalised(spark.read.json(path, multiLine=True)).withColumn("speed", F.coalesce("speed", F.lit(0.0)))


def environment_json(spark: SparkSession, path: str) -> DataFrame:
    """{"wind": [u, v], "current": [u, v]} of one file or a folder of files to four columns.

    Columns that the folders' names give (region_id=3) come first.
    """
    raw = spark.read.schema("wind array<double>, current array<double>").json(path, multiLine=True)
    return raw.select(*[c for c in raw.columns if c not in ("wind", "current")], F.get("wind", 0).alias("wind_u"), F.get("wind", 1).alias("wind_v"), F.get("current", 0).alias("cur_u"), F.get("current", 1).alias("cur_v"))


def grid_table(df: DataFrame) -> DataFrame:
    """Long grid rows (field_id, time?, depth?, lat|latitude, lon|longitude, u, v): first time and depth."""
    out = df.withColumns({"lat": pick(df, ("lat", "latitude"), "double"), "lon": pick(df, ("lon", "longitude"), "double")})
    for axis in ("time", "depth"):
        if axis in df.columns:
            first = out.groupBy("field_id").agg(F.min(axis).alias("first"))
            out = out.join(first, "field_id").where(F.col(axis).eqNullSafe(F.col("first"))).drop("first")
    return out.select("field_id", "lat", "lon", F.col("u").cast("double").alias("u"), F.col("v").cast("double").alias("v"))


def vector_grids(df: DataFrame) -> DataFrame:
    """Rows of flat grids (grid_id, bounds, width, height, u[], v[]) to cells; malformed grids are left out."""
    n = F.col("width") * F.col("height")
    good = df.where((n > 0) & (F.size("u") == n) & (F.size("v") == n))
    cells = good.select("grid_id", "bounds", "width", "height", F.posexplode(F.arrays_zip("u", "v")).alias("k", "x"))
    return cells.select("grid_id", "bounds", F.expr("k div width").alias("row"), F.expr("k % width").alias("col"), "x.u", "x.v")


def _scene(scene_id: int | None) -> Column:
    return (F.col("scene_id") if scene_id is None else F.lit(scene_id)).cast("bigint").alias("scene_id")


def calibration_xml(spark: SparkSession, path: str, scene_id: int | None, pol: str) -> DataFrame:
    """Calibration vectors of annotation files to (scene_id, pol, line, pixel, a_sigma).

    Without ``scene_id`` the files' folders name it (scene_id=3).
    """
    raw = spark.read.schema("line bigint, pixel string, sigmaNought string").option("rowTag", "calibrationVector").format("xml").load(path)
    numbers = lambda c: F.transform(F.filter(F.split(F.trim(c), r"\s+"), lambda x: x != ""), lambda x: x.cast("double"))
    z = raw.select(_scene(scene_id), "line", F.explode(F.arrays_zip(numbers(F.col("pixel")).alias("pixel"), numbers(F.col("sigmaNought")).alias("a"))).alias("z"))
    return z.select("scene_id", F.lit(pol).alias("pol"), "line", F.col("z.pixel").cast("bigint").alias("pixel"), F.col("z.a").alias("a_sigma"))


def geolocation_xml(spark: SparkSession, path: str, scene_id: int | None) -> DataFrame:
    """Tie points of annotation files to (scene_id, line, pixel, lat, lon); see ``calibration_xml``."""
    raw = spark.read.schema("line bigint, pixel bigint, latitude double, longitude double").option("rowTag", "geolocationGridPoint").format("xml").load(path)
    return raw.select(_scene(scene_id), "line", "pixel", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))


def pixel_positions(pixels: DataFrame, ties: DataFrame) -> DataFrame:
    """Longitude and latitude of pixels (scene_id, line, pixel) from tie points, bilinear."""
    from spillspark.operators import georef

    at = pixels.select("scene_id", F.col("line").cast("double").alias("line"), F.col("pixel").cast("double").alias("pixel"))
    return georef.positions(at, ties)


def incident_metadata(spark: SparkSession, root: str, name: str = "metadata.json") -> DataFrame:
    """The file ``name`` of every folder under ``root``; unreadable files are left out, sorted by id."""
    schema = (
        "incident_id string, name string, description string, observation_time string, location struct<region:string,approximate_latitude:double,approximate_longitude:double>, "
        "timeline struct<collision_date:string,sinking_date:string,sar_observation:string>, expected_files map<string,string>, "
        "source_metadata struct<satellite:string,polarizations:array<string>,mode:string,product_type:string>, _corrupt_record string"
    )
    raw = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(f"{root}/*/{name}")
    return raw.where("_corrupt_record is null and incident_id is not null").drop("_corrupt_record").orderBy("incident_id")


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, name, length) of the files under ``root``; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length")
