"""Every registered query of the spill analytics against its SQL at the smallest size."""

import math
import os

import duckdb
import pytest

from spillspark.plans import registry

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="needs the given tables")


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return float(v) if isinstance(v, float) else v


def rows(table):
    names = sorted(table.column_names)
    columns = [table.column(n).to_pylist() for n in names]
    return names, sorted(([plain(v) for v in r] for r in zip(*columns, strict=True)), key=repr)


def place(values):
    """A unit in the last place that a column's values are rounded to, a billionth at least."""
    digits = [len(repr(round(v, 9)).partition(".")[2]) if "e" not in repr(round(v, 9)) else 9 for v in values if isinstance(v, float) and math.isfinite(v)]
    return 10.0 ** -max(digits, default=9)


@pytest.mark.parametrize("name", registry.NAMES)
def test_query(spark, name):
    c = duckdb.connect()
    for t in ("events", "embeddings", "nation", "customer", "supplier", "orders", "part"):
        c.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    got, want = registry.QUERIES[name](spark, D).toArrow(), c.execute(registry.ORACLE_SQL[name]).to_arrow_table()
    a, b = rows(got), rows(want)
    assert a[0] == b[0] and len(a[1]) == len(b[1])
    # Sums in another order may round the last place of their column the other way.
    unit = [place(column) for column in zip(*b[1], strict=True)]
    for x, y in zip(a[1], b[1], strict=True):
        assert all(p == q or isinstance(p, float) and isinstance(q, (int, float)) and abs(p - q) < max(1.1 * u, 1e-9 * abs(q)) for p, q, u in zip(x, y, unit, strict=True)), (x, y)
