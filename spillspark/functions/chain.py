"""Formulas as levels of SQL expressions, each level using the columns before it.

Both sides of a comparison can run the same closed formula: Spark adds one
projection per level, so nothing is expanded more than once, and the SQL text
becomes one common table expression per level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Levels = list[dict[str, str]]


def apply(df: DataFrame, levels: Levels, keep: dict[str, str]) -> DataFrame:
    """``df`` with the columns of ``keep`` (new name: level column) added."""
    names = df.columns
    for level in levels:
        df = df.withColumns({k: F.expr(v) for k, v in level.items()})
    return df.select(*names, *[F.col(v).alias(k) for k, v in keep.items()])


def ctes(source: str, name: str, levels: Levels, keep: dict[str, str], columns: str) -> str:
    """CTE text that reads ``source`` (already defined) and defines ``name``."""
    out, last = [], source
    for i, level in enumerate(levels):
        now = f"{name}_{i}"
        out.append(f"{now} AS (SELECT *, " + ", ".join(f"{v} AS {k}" for k, v in level.items()) + f" FROM {last})")
        last = now
    out.append(f"{name} AS (SELECT {columns}, " + ", ".join(f"{v} AS {k}" for k, v in keep.items()) + f" FROM {last})")
    return ",\n".join(out)
