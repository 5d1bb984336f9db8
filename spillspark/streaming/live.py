"""Position reports as a stream: latest position, live alerts, windowed counts."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from spillspark.functions import geo
from spillspark.operators.joins import METRES_PER_DEGREE
from spillspark.operators.risk import HIGH_KM, WARNING_KM

LATEST = "vessel_id string, ts timestamp, lon double, lat double, speed double"


def deduplicated(reports: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Reports (vessel_id, ts, lon, lat, speed) without repeats within the watermark."""
    return reports.withWatermark("ts", late).dropDuplicatesWithinWatermark(["vessel_id", "ts"])


def latest_positions(reports: DataFrame, late: str = "10 minutes", idle: str = "1 day") -> DataFrame:
    """A row whenever a vessel's latest position moves on; older reports are ignored.

    State per vessel is one position; a vessel that is silent for ``idle`` of
    event time is forgotten.
    """
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        best: Any = state.get if state.exists else None
        moved = False
        for batch in batches:
            top = batch.sort_values("ts").iloc[-1]
            seen = (int(pd.Timestamp(top.ts).value), float(top.lon), float(top.lat), float(top.speed))
            if best is None or seen[0] > best[0]:
                best, moved = seen, True
        # The timer is only valid for one call: without a new one the state would stay for ever.
        state.update(best)
        state.setTimeoutTimestamp(max(best[0] // 1_000_000, state.getCurrentWatermarkMs()) + idle_ms)
        if moved:
            yield pd.DataFrame({"vessel_id": [key[0]], "ts": [pd.Timestamp(best[0])], "lon": [best[1]], "lat": [best[2]], "speed": [best[3]]})

    return (
        deduplicated(reports, late)
        .groupBy("vessel_id")
        .applyInPandasWithState(update, LATEST, "ns long, lon double, lat double, speed double", "update", GroupStateTimeout.EventTimeTimeout)
    )


CELL = 0.25  # degrees


def reach(waypoints: DataFrame, km: float = WARNING_KM) -> DataFrame:
    """(cell_y, cell_x, incident_id, path): for each cell the waypoints that may be within ``km`` of a place in it."""
    high = km * 1000 / METRES_PER_DEGREE
    top = F.least(F.lit(89.0), F.abs("lat") + high)
    wide = F.least(F.lit(180.0), high / F.cos(F.radians(top)) * 1.01)
    across = int(round(360 / CELL))
    cells = lambda c, d: F.sequence(F.floor((F.col(c) - d) / CELL).cast("int"), F.floor((F.col(c) + d) / CELL).cast("int"))
    at = waypoints.where("lon is not null and lat is not null").withColumn("cell_y", F.explode(cells("lat", F.lit(high))))
    at = at.withColumn("cell_x", F.explode(F.array_distinct(F.transform(cells("lon", wide), lambda x: F.pmod(x, F.lit(across))))))
    return at.groupBy("cell_y", "cell_x", "incident_id").agg(F.collect_list(F.struct("lon", "lat")).alias("path"))


def alerts(positions: DataFrame, waypoints: DataFrame) -> DataFrame:
    """Positions within reach of a forecast path: a stream-static join on cells, graded by geodesics as in batch.

    ``waypoints``: incident_id, lon, lat (a batch table of any size). A position meets
    the incidents of its cell only. The waypoint is the nearer of the two that are nearest on the
    sphere, which is within half a percent of the ellipsoid. Positions out of reach give no row.
    """
    keyed = positions.withColumns({"cell_y": F.floor(F.col("lat") / CELL).cast("int"), "cell_x": F.pmod(F.floor(F.col("lon") / CELL).cast("int"), F.lit(int(round(360 / CELL))))})
    pairs = keyed.join(reach(waypoints), ["cell_y", "cell_x"])
    near = F.array_sort(F.transform("path", lambda p: F.struct(geo.haversine(F.col("lon"), F.col("lat"), p["lon"], p["lat"]).alias("d"), p["lon"].alias("lon"), p["lat"].alias("lat"))))
    two = pairs.withColumn("near", near).where(F.get("near", 0)["d"] <= WARNING_KM * 1000 * 1.01)
    last = F.least(F.size("near") - 1, F.lit(1))
    two = two.select("incident_id", "vessel_id", "ts", "lon", "lat", F.get("near", 0)["lon"].alias("lon_1"), F.get("near", 0)["lat"].alias("lat_1"), F.get("near", last)["lon"].alias("lon_2"), F.get("near", last)["lat"].alias("lat_2"))
    for k in "12":
        two = geo.with_geodesic(two, f"d_{k}", "lon", "lat", f"lon_{k}", f"lat_{k}")
    told = two.withColumn("d_km", F.explode(F.array(F.least("d_1", "d_2") / 1000))).where(F.col("d_km") <= WARNING_KM)
    tier = F.when(F.col("d_km") <= HIGH_KM, "HIGH").otherwise("MEDIUM")
    return told.select("incident_id", "vessel_id", "ts", F.round("d_km", 2).alias("d_km"), tier.alias("risk_level"))


def windowed_counts(risks: DataFrame, late: str = "10 minutes", width: str = "10 minutes") -> DataFrame:
    """Tumbling counts per tier, for append mode."""
    return risks.withWatermark("ts", late).groupBy(F.window("ts", width), "risk_level").agg(F.count(F.lit(1)).alias("n"))
