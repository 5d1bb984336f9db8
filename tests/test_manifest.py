import os
import tempfile

import pytest
from pyspark.sql import functions as F

from spillspark.plans import investigate
from spillspark.plans.manifest import Input, Stage, Store, fingerprint


def table(spark, rows):
    return spark.createDataFrame(rows, "incident_id long, x long")


def chain(calls):
    """double: twice x; total: the sum of these; named: the sum with a word of a shared table."""

    def double(todo, xs):
        calls.append("double")
        return xs.join(todo, "incident_id", "left_semi").withColumn("x", 2 * F.col("x"))

    def total(todo, doubled):
        calls.append("total")
        return doubled.join(todo, "incident_id", "left_semi").groupBy("incident_id").agg((F.sum("x") % 100).alias("s"))

    def named(todo, sums, words):
        calls.append("named")
        return sums.join(todo, "incident_id", "left_semi").join(F.broadcast(words))

    return [Stage("double", ("xs",), double), Stage("total", ("double",), total, ("mod", 100)), Stage("named", ("total", "words"), named)]


@pytest.fixture
def store(spark):
    return Store(spark, tempfile.mkdtemp(prefix="spark-", dir="/tmp"))


def run(spark, store, rows, word="a", force=False, ids=(1, 2, 3), calls=None):
    inputs = {"xs": Input(table(spark, rows)), "words": Input(spark.createDataFrame([(word,)], "word string"), None)}
    incidents = spark.createDataFrame([(i,) for i in ids], "incident_id long")
    made = store.run(incidents, inputs, chain([] if calls is None else calls), force)
    return sorted(map(tuple, made["named"].select("incident_id", "s", "word").collect())), dict(store.ran)


ROWS = [(1, 10), (1, 20), (2, 5), (3, 7)]


def test_only_what_hangs_on_a_change_is_made_again(spark, store):
    want = [(1, 60, "a"), (2, 10, "a"), (3, 14, "a")]
    assert run(spark, store, ROWS[:3], ids=(1, 2)) == (want[:2], {"double": 2, "total": 2, "named": 2})
    assert run(spark, store, ROWS) == (want, {"double": 1, "total": 1, "named": 1})  # the new incident only
    calls = []
    assert run(spark, store, ROWS, calls=calls) == (want, {"double": 0, "total": 0, "named": 0}) and not calls
    # One incident's input changes: its own stages run again, the others' don't.
    changed = [*ROWS[:2], (2, 6), ROWS[3]]
    assert run(spark, store, changed) == ([want[0], (2, 12, "a"), want[2]], {"double": 1, "total": 1, "named": 1})
    # It comes to the same sum (modulo 100): what hangs on the sum stays.
    same = [*ROWS[:2], (2, 56), ROWS[3]]
    assert run(spark, store, same) == ([want[0], (2, 12, "a"), want[2]], {"double": 1, "total": 1, "named": 0})
    # The shared table changes: its stage runs for all, the others don't.
    assert run(spark, store, same, "b") == ([(1, 60, "b"), (2, 12, "b"), (3, 14, "b")], {"double": 0, "total": 0, "named": 3})
    assert run(spark, store, same, "b", force=True)[1] == {"double": 3, "total": 3, "named": 3}
    # Rows in another order, or an incident left out, change nothing.
    assert run(spark, store, same[::-1], "b", ids=(3, 1)) == ([(1, 60, "b"), (3, 14, "b")], {"double": 0, "total": 0, "named": 0})


def test_no_incidents_and_no_rows(spark, store):
    assert run(spark, store, ROWS, ids=()) == ([], {"double": 0, "total": 0, "named": 0})
    assert run(spark, store, ROWS, ids=(9,)) == ([], {"double": 1, "total": 1, "named": 1})  # nothing known of it
    assert run(spark, store, ROWS, ids=(9,)) == ([], {"double": 0, "total": 0, "named": 0})
    assert run(spark, store, ROWS, ids=(9, 1)) == ([(1, 60, "a")], {"double": 1, "total": 1, "named": 1})


def test_a_failed_run_leaves_everything_as_it_was(spark, store):
    before = run(spark, store, ROWS)[0]

    def fails(todo, xs):
        return xs.join(todo, "incident_id", "left_semi").select("incident_id", F.raise_error(F.lit("no")).cast("long").alias("x"))

    bad = [Stage("double", ("xs",), fails)]
    inputs = {"xs": Input(table(spark, [(1, 11)]))}
    with pytest.raises(Exception, match="no"):
        store.run(spark.createDataFrame([(1,)], "incident_id long"), inputs, bad)
    assert run(spark, store, ROWS) == (before, {"double": 0, "total": 0, "named": 0})
    # A version that another job has published is never overwritten.
    store.versions = lambda: []
    with pytest.raises(RuntimeError, match="another job"):
        store.publish(spark.createDataFrame([(1, "double", 1, 1, "r")], "incident_id long, stage string, input long, output long, run string"))


def test_a_version_stands_for_the_rows(spark, store):
    one = [Stage("double", ("xs",), chain([])[0].make)]
    ids = spark.createDataFrame([(1,)], "incident_id long")
    for version, ran in (("s1", 1), ("s1", 0), ("s2", 1)):
        store.run(ids, {"xs": Input(table(spark, ROWS), version=version)}, one)
        assert store.ran == {"double": ran}


def test_fingerprints(spark):
    a = {r.incident_id: r.fp for r in fingerprint(table(spark, [(1, 1), (1, 2), (2, 1), (2, 2), (3, 1), (3, 1), (4, None)])).collect()}
    b = {r.incident_id: r.fp for r in fingerprint(table(spark, [(1, 2), (1, 1), (3, 1), (4, None)])).collect()}
    assert a[1] == b[1] and a[4] == b[4] and a[3] != b[3] and len(set(a.values())) == 4


def test_investigation_of_scenes_with_and_without_oil(spark, store):
    """A scene with a slick, one without, and later a change of the winds alone."""
    px = [(i, r, c, 30.0 if i == 1 and 2 <= r < 6 and 3 <= c < 9 else 5.0, 6.0) for i in (1, 2) for r in range(8) for c in range(12)]
    nodes = [(i, line, pixel) for i in (1, 2) for line in (0, 8) for pixel in (0, 12)]
    lut = [(i, pol, line, pixel, 100.0) for i, line, pixel in nodes for pol in ("VV", "VH")]
    ties = [(i, line, pixel, 125 + pixel * 0.01, 30 - line * 0.01) for i, line, pixel in nodes]

    def inputs(u):
        winds = [(0, 20.0 + 20 * y, 110.0 + 30 * x, u, 0.0, 0.1, 0.0) for y in (0, 1) for x in (0, 1)]
        return {
            "pixels": Input(spark.createDataFrame(px, "incident_id long, r long, c long, vv double, vh double")),
            "lut": Input(spark.createDataFrame(lut, "incident_id long, pol string, line long, pixel long, a_sigma double")),
            "ties": Input(spark.createDataFrame(ties, "incident_id long, line long, pixel long, lon double, lat double")),
            "times": Input(spark.createDataFrame([(1, 0, 10**12), (2, 0, 10**12)], "incident_id long, field_id long, target_us long")),
            "winds": Input(spark.createDataFrame(winds, "field_id long, lat double, lon double, wind_u double, wind_v double, cur_u double, cur_v double"), None),
            "reports": Input(spark.createDataFrame([("V1", 125.0, 30.0, 10**12, 9.0, 90.0), ("V2", 126.0, 31.0, 10**12, 9.0, 80.0)], "vessel_id string, lon double, lat double, us long, speed double, heading double"), None),
        }

    steps = investigate.stages(lambda: lambda vv, vh: (vv > 0.55) * 0.9, "threshold", tile=8, least_pixels=2, hours=3)
    both = spark.createDataFrame([(1,), (2,)], "incident_id long")
    dry = investigate.investigation(store, both.where("incident_id = 2"), inputs(5.0), steps).collect()
    assert [(r.incident_id, r.area_m2, r.vessel_id) for r in dry] == [(2, None, None)]  # nothing was found at first
    got = {(r.incident_id, r.vessel_id): r for r in investigate.investigation(store, both, inputs(5.0), steps).collect()}
    assert got.keys() == {(1, "V1"), (1, "V2"), (2, None)} and store.ran == {"detection": 1, "geometry": 1, "drift": 1, "attribution": 1}
    assert got[1, "V1"].n_oil == 24 and got[1, "V1"].rank == 1 and got[1, "V1"].origin.lon < got[1, "V1"].centroid_lon
    assert abs(got[1, "V1"].area_m2 - 24 * 1108.5 * 964.6) < 0.01 * 24 * 1108.5 * 964.6
    again = {(r.incident_id, r.vessel_id): r for r in investigate.investigation(store, both, inputs(50.0), steps).collect()}
    assert store.ran == {"detection": 0, "geometry": 0, "drift": 2, "attribution": 1}
    assert again[1, "V1"].area_m2 == got[1, "V1"].area_m2 and again[1, "V1"].origin.lon < got[1, "V1"].origin.lon
    assert os.path.isdir(f"{store.root}/manifest/v1")
