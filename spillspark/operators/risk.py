"""Early warning: forecast of a slick and the vessels in its way."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spillspark.functions import geo
from spillspark.operators import drift, joins, tracks

# Distances and growth of the forecast's uncertainty.
WARNING_KM, HIGH_KM = 10.0, 3.0
RADIUS0_KM, GROWTH_KM_PER_H = 2.0, 0.5


def forecast(incidents: DataFrame, hours: float, step_s: float = 600.0, windage: float = drift.WINDAGE) -> tuple[DataFrame, DataFrame]:
    """(trajectory, impact): steps, and per incident end point, zone radius, speed, direction, ring."""
    steps = drift.simulate(incidents, hours, step_s, windage)
    vx, vy = drift.velocity(windage)
    n = max(1, int(hours * 3600 / step_s))
    radius = RADIUS0_KM + GROWTH_KM_PER_H * hours
    end = incidents.withColumns({"vx": vx, "vy": vy})
    x, y = geo.to_mercator(F.col("lon0"), F.col("lat0"))
    end = end.withColumns({"mx": x + F.col("vx") * step_s * n, "my": y + F.col("vy") * step_s * n})
    lon, lat = geo.from_mercator(F.col("mx"), F.col("my"))
    zone = geo.ring(F.col("mx"), F.col("my"), F.lit(radius * 1000))

    def degrees(p):
        a, b = geo.from_mercator(p["x"], p["y"])
        return F.struct(a.alias("x"), b.alias("y"))

    end = end.withColumns({
        "end_lon": lon, "end_lat": lat, "radius_zone_km": F.lit(radius), "speed_m_s": F.hypot("vx", "vy"),
        "direction": geo.compass(F.col("vx"), F.col("vy")), "ring": F.transform(zone, degrees),
    })
    end = geo.with_geodesic(end, "drift_m", "lon0", "lat0", "end_lon", "end_lat")
    return steps, end.drop("mx", "my")


def assess(reports: DataFrame, incidents: DataFrame, hours: float = 6.0, step_s: float = 600.0) -> DataFrame:
    """One row per (incident, vessel): distances, tier, time of closest slick, reason.

    Only each vessel's last report counts. ``slick_closest_minutes`` is when
    the slick passes closest to that position (null if it hardly drifts).
    """
    _, end = forecast(incidents, hours, step_s)
    last = geo.known(tracks.latest(reports), "lon", "lat")
    ends = end.select("incident_id", "lon0", "lat0", "vx", "vy", "end_lon", "end_lat", "radius_zone_km", "speed_m_s")
    ends = geo.known(ends, "lon0", "lat0", "vx", "vy", "end_lon", "end_lat")
    pairs = joins.with_all_incidents(last, ends)
    # The path is a straight line from the start: a pair makes its points itself.
    n = max(1, int(hours * 3600 / step_s))
    way = pairs.select("incident_id", "vessel_id", "lon", "lat", "lon0", "lat0", "vx", "vy", F.explode(F.sequence(F.lit(0), F.lit(n))).alias("step"))
    x, y = geo.to_mercator(F.col("lon0"), F.col("lat0"))
    way = way.withColumns({"mx": x + F.col("vx") * step_s * F.col("step"), "my": y + F.col("vy") * step_s * F.col("step")})
    w_lon, w_lat = geo.from_mercator(F.col("mx"), F.col("my"))
    way = way.withColumns({"w_lon": w_lon, "w_lat": w_lat})
    near = geo.with_geodesic(way, "d_way", "lon", "lat", "w_lon", "w_lat").groupBy("incident_id", "vessel_id").agg(F.min("d_way").alias("d_way"), F.min_by("step", "d_way").alias("step"))
    measured = geo.with_geodesic(geo.with_geodesic(pairs, "d_spill", "lon", "lat", "lon0", "lat0"), "d_impact", "lon", "lat", "end_lon", "end_lat")
    both = measured.join(near, ["incident_id", "vessel_id"])
    t, i = F.col("d_way") / 1000, F.col("d_impact") / 1000
    high = (i <= F.col("radius_zone_km")) | (t <= HIGH_KM)
    tier = F.when(high, "HIGH").when(t <= WARNING_KM, "MEDIUM").otherwise("LOW")
    text = lambda e: F.format_string("%.1f", F.round(e, 1))
    # The sentences.
    reason = (
        F.when(high, F.concat(F.lit("HIGH RISK: Vessel is directly within the predicted impact zone ("), text(t), F.lit(" km from forecast path, "), text(i), F.lit(" km from impact center). Immediate advisory warning and evasive action recommended.")))
        .when(t <= WARNING_KM, F.concat(F.lit(f"MEDIUM RISK: Vessel is within the {WARNING_KM:.0f} km warning corridor ("), text(t), F.lit(" km from predicted drift track). Precautionary monitoring active.")))
        .otherwise(F.concat(F.lit("LOW RISK: Vessel is outside the immediate warning distance ("), text(t), F.lit(" km from predicted track) but remains within the regional forecast domain.")))
    )
    return both.select(
        "incident_id", "vessel_id", tier.alias("risk_level"),
        F.when(high, 0).when(t <= WARNING_KM, 1).otherwise(2).alias("risk_rank"),
        F.round(F.col("d_spill") / 1000, 2).alias("d_spill_km"), F.round(t, 2).alias("d_trajectory_km"), F.round(i, 2).alias("d_impact_km"),
        high.alias("inside_impact_zone"),
        F.when(F.col("speed_m_s") > 0.05, F.round(F.col("step") * step_s / 60, 1)).alias("slick_closest_minutes"),
        F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), F.round("speed", 1).alias("speed_knots"), F.round("heading", 1).alias("heading_deg"),
        reason.alias("explanation"),
    )


def counts(risks: DataFrame) -> DataFrame:
    one = lambda k: F.count_if(F.col("risk_level") == k).alias(f"n_{k.lower()}")
    return risks.groupBy("incident_id").agg(one("HIGH"), one("MEDIUM"), one("LOW"))


def ordered(risks: DataFrame) -> DataFrame:
    return risks.orderBy("risk_rank", "d_trajectory_km", "vessel_id")
