"""Position reports, incidents, pixels and grids derived from the shared test tables.

Integer arithmetic, so that Spark and the SQL text below give equal values.
Times are microseconds since 2024-01-01 (``us``) and need no time zone.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

DAY_US = 86_400_000_000

_AIS = """
SELECT event_id, concat('V', cast(user_id AS {string})) AS vessel_id, user_id,
  29.0e0 + (user_id * 37 % 200) / 100.0e0 + (event_id * 7919 % 1000) / 20000.0e0 AS lat,
  124.0e0 + (user_id * 53 % 300) / 100.0e0 + (event_id * 104729 % 1000) / 20000.0e0 AS lon,
  ts, {us} AS us, value AS speed,
  CASE WHEN event_type = 'error' THEN NULL
    ELSE cast(cast(regexp_extract(props, '([0-9]+)', 1) AS bigint) * 37 % 360 AS double) END AS heading
FROM {events}
"""

_INCIDENTS = """
SELECT cast(n_nationkey AS bigint) AS incident_id, n_name AS name,
  124.5e0 + n_nationkey * 0.1e0 AS lon0, 29.2e0 + n_nationkey * 0.06e0 AS lat0,
  (2 + n_nationkey) * cast(86400000000 AS bigint) AS target_us,
  20.0e0 + (n_nationkey % 5) * 5 AS radius_km,
  (n_nationkey % 7 - 3) * 1.5e0 AS wind_u, (n_nationkey % 5 - 2) * 2.0e0 AS wind_v,
  (n_nationkey % 3 - 1) * 0.3e0 AS cur_u, (n_nationkey % 4 - 1) * 0.2e0 AS cur_v,
  cast(n_regionkey AS bigint) AS region_id
FROM {nation}
"""

_SPILLS = """
SELECT c_custkey AS incident_id, c_name AS name,
  124.5e0 + (c_custkey * 41 % 97) * 0.025e0 AS lon0, 29.2e0 + (c_custkey * 29 % 89) * 0.017e0 AS lat0,
  (2 + c_custkey % 25) * cast(86400000000 AS bigint) AS target_us,
  20.0e0 + (c_custkey % 5) * 5 AS radius_km,
  (c_custkey % 7 - 3) * 1.5e0 AS wind_u, (c_custkey % 5 - 2) * 2.0e0 AS wind_v,
  (c_custkey % 3 - 1) * 0.3e0 AS cur_u, (c_custkey % 4 - 1) * 0.2e0 AS cur_v,
  cast(c_nationkey % 5 AS bigint) AS region_id
FROM {customer}
"""

_PIXELS = """
SELECT p.vec_id, p.scene_id, p.tile_row, p.tile_col,
  p.tile_row * 8 + p.k {div} 8 AS r, p.tile_col * 8 + p.k % 8 AS c,
  1 / (1 + exp(-8 * p.v)) AS prob,
  cast(((p.tile_row * 8 + p.k {div} 8) * 31 + (p.tile_col * 8 + p.k % 8) * 17) % 50 AS double) AS vv,
  cast(((p.tile_row * 8 + p.k {div} 8) * 13 + (p.tile_col * 8 + p.k % 8) * 29) % 47 AS double) AS vh
FROM ({exploded}) p
"""

_TIES = """
SELECT scene_id, line, pixel, 121.0e0 + scene_id * 2.5e0 + pixel * 0.00600017e0 + line * 0.00030011e0 + (pixel {div} 40 % 2) * 0.0009e0 AS lon,
  31.0e0 - line * 0.00500013e0 + pixel * 0.00010007e0 + (line {div} 50 % 3) * 0.0007e0 AS lat
FROM (SELECT DISTINCT scene_id FROM ({pixels}) s) s, (SELECT {each}({lines}) AS line) a, (SELECT {each}({samples}) AS pixel) b
"""

_EXPLODED_SPARK = """
SELECT vec_id, vec_id div 512 AS scene_id, (vec_id % 512) div 16 AS tile_row, vec_id % 16 AS tile_col, cast(k AS bigint) AS k, cast(v AS double) AS v
FROM (SELECT vec_id, posexplode(embedding) AS (k, v) FROM {embeddings})
"""
_EXPLODED_SQL = """
SELECT vec_id, vec_id // 512 AS scene_id, (vec_id % 512) // 16 AS tile_row, vec_id % 16 AS tile_col, cast(k - 1 AS bigint) AS k, cast(embedding[k] AS double) AS v
FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS k FROM embeddings)
"""

#: The same tables as text for DuckDB.
AIS_SQL = _AIS.format(string="varchar", us="epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')", events="events")
INCIDENTS_SQL = _INCIDENTS.format(nation="nation")
SPILLS_SQL = _SPILLS.format(customer="customer")
PIXELS_SQL = _PIXELS.format(div="//", exploded=_EXPLODED_SQL)
TIES_SQL = _TIES.format(div="//", pixels="SELECT scene_id FROM px", each="unnest", lines="range(0, 301, 50)", samples="range(0, 161, 40)")


def importable(spark: SparkSession) -> None:
    """Let Python workers find this package where the driver found it.

    On a cluster the package is installed or shipped with the job.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [env.get("PYTHONPATH", ""), root]))


def _view(spark: SparkSession, sf_dir: str, name: str) -> str:
    importable(spark)
    return f"parquet.`{sf_dir}/{name}.parquet`"


def ais(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vessel_id, lat, lon, ts, us, speed, heading: one row per event."""
    us = "timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', cast(ts AS timestamp_ntz))"
    return spark.sql(_AIS.format(string="string", us=us, events=_view(spark, sf_dir, "events")))


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Origin, epoch, source radius, wind and current of 25 incidents."""
    return spark.sql(_INCIDENTS.format(nation=_view(spark, sf_dir, "nation")))


def spills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slicks, one per customer: as many as the tables are large, with the columns of ``incidents``."""
    return spark.sql(_SPILLS.format(customer=_view(spark, sf_dir, "customer")))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scene_id, tile, global row r and column c, prob, vv, vh: 8 x 8 tiles, 16 across, 32 down."""
    return spark.sql(_PIXELS.format(div="div", exploded=_EXPLODED_SPARK.format(embeddings=_view(spark, sf_dir, "embeddings"))))


def ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tie points of the scenes of ``pixels``: lon and lat every 50 lines and 40 pixels, uneven between neighbours."""
    pixels = f"SELECT vec_id div 512 AS scene_id FROM {_view(spark, sf_dir, 'embeddings')}"
    return spark.sql(_TIES.format(div="div", pixels=pixels, each="explode", lines="sequence(0L, 300L, 50L)", samples="sequence(0L, 160L, 40L)"))
