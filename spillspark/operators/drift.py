"""Drift of a slick: constant velocity in closed form, and through a grid."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spillspark.functions import geo
from spillspark.functions import grids as cells_of

WINDAGE = 0.03


def velocity(windage: float = WINDAGE, direction: str = "forward"):
    """Net drift from wind_u, wind_v, cur_u, cur_v; reversed for a hindcast."""
    if direction not in ("forward", "backward"):
        raise ValueError("direction must be 'forward' or 'backward'")
    sign = 1.0 if direction == "forward" else -1.0
    return sign * (F.col("cur_u") + F.col("wind_u") * windage), sign * (F.col("cur_v") + F.col("wind_v") * windage)


def simulate(starts: DataFrame, hours: float, step_s: float, windage: float = WINDAGE, direction: str = "forward", metric_crs: str = "mercator") -> DataFrame:
    """One row per start and step: ``step``, ``lon``, ``lat``, ``vx``, ``vy``, ``us``.

    Displacement is linear in time, so every step is computed from the start
    and the job is one narrow stage. Steps: max(1, floor(hours * 3600 / step)),
    and the start. ``metric_crs``: mercator (its metres aren't scaled by
    latitude) or utm.
    """
    n = max(1, int(hours * 3600 / step_s))
    vx, vy = velocity(windage, direction)
    moved = starts.withColumns({"vx": vx, "vy": vy}).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(n))))
    to, back = (geo.to_mercator, geo.from_mercator) if metric_crs == "mercator" else (geo.to_utm, geo.from_utm)
    x, y = to(F.col("lon0"), F.col("lat0"))
    moved = moved.withColumns({"mx": x + F.col("vx") * step_s * F.col("step"), "my": y + F.col("vy") * step_s * F.col("step")})
    lon, lat = back(F.col("mx"), F.col("my"))
    sign = 1 if direction == "forward" else -1
    us = F.col("target_us") + F.col("step").cast("bigint") * int(sign * step_s * 1e6)
    return moved.withColumns({"lon": lon, "lat": lat, "us": us}).drop("mx", "my")


def path_totals(steps: DataFrame, key: str = "incident_id") -> DataFrame:
    """Adds the distance so far (metres) along each trajectory."""


    w = Window.partitionBy(key).orderBy("step")
    legs = steps.withColumns({"lon_b": F.lag("lon").over(w), "lat_b": F.lag("lat").over(w)})
    legs = geo.with_geodesic(legs.withColumns({"lon_b": F.coalesce("lon_b", "lon"), "lat_b": F.coalesce("lat_b", "lat")}), "leg_m", "lon_b", "lat_b", "lon", "lat")
    return legs.withColumn("path_m", F.sum("leg_m").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("lon_b", "lat_b")


def fill_grid(grid: DataFrame) -> DataFrame:
    """NaN and null components become the field's mean."""


    w = Window.partitionBy("field_id")
    clean = {c: F.when(~F.isnan(c), F.col(c)) for c in ("u", "v")}
    return grid.withColumns({c: F.coalesce(clean[c], F.avg(clean[c]).over(w)) for c in ("u", "v")})


def interpolate(points: DataFrame, grid: DataFrame) -> DataFrame:
    """Bilinear u, v of ``grid`` (field_id, lat, lon, u, v) at ``points`` (field_id, lon, lat).

    Axes may ascend or descend on input; points outside are clamped to the
    edge. See ``grids``: cells carry their corners, so points are joined once.
    """
    return cells_of.interpolate(points, grid, ["field_id"], "lat", "lon", ["u", "v"])


def _bilinear(lats: np.ndarray, lons: np.ndarray, field: np.ndarray, lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    iy = np.clip(np.searchsorted(lats, lat, side="right") - 1, 0, len(lats) - 2)
    ix = np.clip(np.searchsorted(lons, lon, side="right") - 1, 0, len(lons) - 2)
    ty = np.clip((lat - lats[iy]) / (lats[iy + 1] - lats[iy]), 0, 1)
    tx = np.clip((lon - lons[ix]) / (lons[ix + 1] - lons[ix]), 0, 1)
    low = field[iy, ix] * (1 - tx) + field[iy, ix + 1] * tx
    high = field[iy + 1, ix] * (1 - tx) + field[iy + 1, ix + 1] * tx
    return low * (1 - ty) + high * ty


TRAJECTORY = "incident_id bigint, step int, lon double, lat double, us bigint, vx double, vy double, radius_m double"


BLOCK = 2048  # starts that step together in one task


def hindcast(starts: DataFrame, grid: DataFrame, hours: float, step_s: float, windage: float = WINDAGE, radius0_m: float = 5000.0, growth_m_per_h: float = 300.0, block: int = BLOCK) -> DataFrame:
    """Backward Euler steps of many incidents through wind and current grids.

    ``starts``: incident_id, field_id, lon0, lat0, target_us. ``grid``:
    field_id, lat, lon, wind_u, wind_v, cur_u, cur_v. Time is sequential, so
    starts of a field step together, vectorised. They are counted per field and dealt in blocks of
    about ``block``, each with the field's grid: a task holds the steps of one block.
    """
    n = math.ceil(hours * 3600 / step_s)
    counts = starts.groupBy("field_id").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    salted = starts.join(counts, "field_id").withColumn("salt", F.pmod(F.xxhash64("incident_id"), F.col("blocks")).cast("int")).drop("blocks")
    grids = grid.join(counts, "field_id").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    # Both sides may come from one table: columns of their own keep them apart.
    salted, grids = (x.select(*[F.col(c).alias(c) for c in x.columns]) for x in (salted, grids))

    def run(points: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
        if points.empty or cells.empty:
            return pd.DataFrame({c.split()[0]: [] for c in TRAJECTORY.split(", ")})
        lats, lons = np.unique(cells.lat), np.unique(cells.lon)
        fields = {}
        for c in ("wind_u", "wind_v", "cur_u", "cur_v"):
            values = cells.pivot(index="lat", columns="lon", values=c).to_numpy(float)
            fields[c] = np.where(np.isnan(values), np.nanmean(values), values)
        lon, lat, rows = points.lon0.to_numpy(float), points.lat0.to_numpy(float), []
        x, y = utm_numpy(lon, lat)
        for step in range(n + 1):
            at = {c: _bilinear(lats, lons, f, lat, lon) for c, f in fields.items()}
            vx, vy = at["cur_u"] + windage * at["wind_u"], at["cur_v"] + windage * at["wind_v"]
            us = points.target_us.to_numpy() - int(step * step_s * 1e6)
            rows.append(pd.DataFrame({"incident_id": points.incident_id, "step": step, "lon": lon, "lat": lat, "us": us, "vx": vx, "vy": vy, "radius_m": radius0_m + growth_m_per_h * step * step_s / 3600}))
            x, y = x - vx * step_s, y - vy * step_s
            lon, lat = lonlat_numpy(x, y)
        return pd.concat(rows)

    return salted.groupBy("field_id", "salt").cogroup(grids.groupBy("field_id", "salt")).applyInPandas(run, TRAJECTORY)


def utm_numpy(lon: np.ndarray, lat: np.ndarray, zone: int = 52) -> tuple[np.ndarray, np.ndarray]:
    radius, forward, _, _ = geo._series()
    e = math.sqrt(geo.FLATTENING * (2 - geo.FLATTENING))
    s = np.sin(np.radians(lat))
    t = np.sinh(np.arctanh(s) - e * np.arctanh(e * s))
    dl = np.radians(lon - (zone * 6 - 183))
    xi, eta = np.arctan2(t, np.cos(dl)), np.arcsinh(np.sin(dl) / np.hypot(t, np.cos(dl)))
    north = xi + sum(a * np.sin(2 * (k + 1) * xi) * np.cosh(2 * (k + 1) * eta) for k, a in enumerate(forward))
    east = eta + sum(a * np.cos(2 * (k + 1) * xi) * np.sinh(2 * (k + 1) * eta) for k, a in enumerate(forward))
    return geo.UTM_EAST + geo.UTM_SCALE * radius * east, geo.UTM_SCALE * radius * north


def lonlat_numpy(x: np.ndarray, y: np.ndarray, zone: int = 52) -> tuple[np.ndarray, np.ndarray]:
    radius, _, inverse, latitude = geo._series()
    xi, eta = y / (geo.UTM_SCALE * radius), (x - geo.UTM_EAST) / (geo.UTM_SCALE * radius)
    a = xi - sum(b * np.sin(2 * (k + 1) * xi) * np.cosh(2 * (k + 1) * eta) for k, b in enumerate(inverse))
    b = eta - sum(c * np.cos(2 * (k + 1) * xi) * np.sinh(2 * (k + 1) * eta) for k, c in enumerate(inverse))
    chi = np.arcsin(np.sin(a) / np.cosh(b))
    lat = chi + sum(d * np.sin(2 * (k + 1) * chi) for k, d in enumerate(latitude))
    return np.degrees(np.arctan2(np.sinh(b), np.cos(a))) + (zone * 6 - 183), np.degrees(lat)
