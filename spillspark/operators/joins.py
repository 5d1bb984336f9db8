"""Spatio-temporal joins of position reports with incidents.

``search_area_join`` is the scalable one: both sides meet on grid cells by an
equality join, and the exact test follows. The all-pairs form exists for
results that need every vessel of an incident: the incidents are its query set.
Up to a checked size they are broadcast, beyond it they are dealt in blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spillspark.functions import geo

MAX_INCIDENTS = 20_000  # broadcast at once, or points of their paths
SPREAD = 64  # tasks that share a block of incidents
METRES_PER_DEGREE = 110_574.0  # least length of a degree of latitude


def with_all_incidents(reports: DataFrame, incidents: DataFrame, size: Column | None = None) -> DataFrame:
    """Every report with every incident.

    ``size``: what a row of ``incidents`` counts for (1; the length of its path).
    Their sum is counted first: up to ``MAX_INCIDENTS`` the incidents are
    broadcast. Beyond it they are dealt in blocks of about that size, each block to
    ``SPREAD`` tasks that hold a share of the reports, by an equality join.
    """
    total = incidents.agg(F.sum(F.lit(1) if size is None else size)).first()[0] or 0
    if total <= MAX_INCIDENTS:
        return reports.crossJoin(F.broadcast(incidents))
    blocks = -(-total // MAX_INCIDENTS)
    copies = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = incidents.withColumn("block__", F.pmod(F.xxhash64("incident_id", "lon0", "lat0"), F.lit(blocks)).cast("int")).withColumn("share__", copies(SPREAD))
    keyed = reports.withColumn("share__", F.pmod(F.xxhash64("vessel_id", "lon", "lat"), F.lit(SPREAD)).cast("int")).withColumn("block__", copies(int(blocks)))
    return keyed.join(dealt, ["block__", "share__"]).drop("block__", "share__")


def search_area_join(
    reports: DataFrame,
    incidents: DataFrame,
    radius_km: str = "radius_km",
    hours: float | None = None,
    cell: float = 0.5,
) -> DataFrame:
    """Reports within ``radius_km`` of an incident and ``hours`` of its time, with ``d_m``.

    An incident covers the cells of its bounding box (longitudes wrap at the
    antimeridian); each report lies in one cell. Busy cells are left to the
    adaptive skew join, which splits them.
    """
    reach = F.col(radius_km) * 1000 / METRES_PER_DEGREE
    top = F.least(F.lit(89.0), F.abs(F.col("lat0")) + reach)
    wide = F.least(F.lit(180.0), reach / F.cos(F.radians(top)) * 1.01)
    across = int(round(360 / cell))
    rows = F.sequence(F.floor((F.col("lat0") - reach) / cell).cast("int"), F.floor((F.col("lat0") + reach) / cell).cast("int"))
    columns = F.sequence(F.floor((F.col("lon0") - wide) / cell).cast("int"), F.floor((F.col("lon0") + wide) / cell).cast("int"))
    areas = incidents.withColumn("cell_y", F.explode(rows)).withColumn("cell_x", F.explode(F.array_distinct(F.transform(columns, lambda x: F.pmod(x, F.lit(across))))))
    keyed = reports.withColumns({
        "cell_y": F.floor(F.col("lat") / cell).cast("int"),
        "cell_x": F.pmod(F.floor(F.col("lon") / cell).cast("int"), F.lit(across)),
    })
    pairs = keyed.join(areas, ["cell_y", "cell_x"]).drop("cell_y", "cell_x")
    if hours is not None:
        pairs = pairs.where(F.abs(F.col("us") - F.col("target_us")) <= int(hours * 3_600_000_000))
    near = pairs.where(F.abs(F.col("lat") - F.col("lat0")) <= reach)
    measured = geo.with_geodesic(near, "d_exact", "lon", "lat", "lon0", "lat0")
    # A filter on the distance would be pushed through the chain of columns and
    # spell the whole series out once per use; it stops at a generated column.
    held = measured.withColumn("d_m", F.explode(F.array("d_exact"))).drop("d_exact")
    return held.where(F.col("d_m") <= F.col(radius_km) * 1000)


def inside_polygon(reports: DataFrame, areas: DataFrame, start: str = "start_us", end: str = "end_us", cell: float = 0.5) -> DataFrame:
    """Reports strictly inside an area's ``ring`` (struct<x, y>) and in its closed time window."""
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    boxed = areas.withColumns({"x_min": F.array_min(xs), "x_max": F.array_max(xs), "y_min": F.array_min(ys), "y_max": F.array_max(ys), "turning": geo.turn(F.col("ring"))})
    steps = lambda a, b: F.sequence(F.floor(F.col(a) / cell).cast("int"), F.floor(F.col(b) / cell).cast("int"))
    areas = boxed.withColumn("cell_y", F.explode(steps("y_min", "y_max"))).withColumn("cell_x", F.explode(steps("x_min", "x_max")))
    keyed = reports.withColumns({"cell_y": F.floor(F.col("lat") / cell).cast("int"), "cell_x": F.floor(F.col("lon") / cell).cast("int")})
    pairs = keyed.join(areas, ["cell_y", "cell_x"]).where(F.col("us").between(F.col(start), F.col(end)))
    box = F.col("lon").between(F.col("x_min"), F.col("x_max")) & F.col("lat").between(F.col("y_min"), F.col("y_max"))
    exact = geo.inside(F.col("ring"), F.col("lon"), F.col("lat"), F.col("turning"))
    return pairs.where(box).where(exact).drop("cell_y", "cell_x", "x_min", "x_max", "y_min", "y_max", "turning")


def details_by_id_or_name(candidates: DataFrame, vessels: DataFrame) -> DataFrame:
    """Candidates with the details of the vessel that matches by id, else by name."""
    fields = [c for c in vessels.columns if c not in ("vessel_id", "vessel_name")]
    by_id = vessels.select("vessel_id", *[F.col(c).alias(f"i_{c}") for c in fields], F.lit(True).alias("i_hit"))
    by_name = vessels.where("vessel_name is not null").dropDuplicates(["vessel_name"]).select("vessel_name", *[F.col(c).alias(f"n_{c}") for c in fields])
    both = candidates.join(by_id, "vessel_id", "left").join(by_name, "vessel_name", "left")
    return both.select(*candidates.columns, *[F.when(F.col("i_hit"), F.col(f"i_{c}")).otherwise(F.col(f"n_{c}")).alias(c) for c in fields])


def not_among(vessels: DataFrame, candidates: DataFrame) -> DataFrame:
    """Vessels that aren't candidates, neither by id nor by name."""
    named = candidates.where("vessel_name is not null").select("vessel_name").distinct()
    return vessels.join(candidates.select("vessel_id").distinct(), "vessel_id", "left_anti").join(named, "vessel_name", "left_anti")
