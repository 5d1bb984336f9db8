import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spillspark.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, is_anchor boolean, uid string, score string"
LAST = 1 << 70


def brute(rows, keep=5):
    """Every row for every anchor, with Python's integers."""
    kept = [(k, [int(np.floor(256 * float(np.float32(x)))) for x in v], label, a) for k, v, label, a in rows if label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, (k, v, label, anchor) in enumerate(kept):
        if not anchor:
            continue
        score = [(-sum(a * b for a, b in zip(v, w, strict=True)), LAST if i is None else i, m) for m, (i, w, _, _) in enumerate(kept)]
        for s, _, m in sorted(x for x in score if x[2] != n and kept[x[2]][2] == label)[:keep]:
            hard = sorted(x for x in score if kept[x[2]][2] != label and 80 * -s <= 100 * -x[0] <= 100 * -s)[:keep]
            out += [(k, kept[m][0], r + 1, kept[x[2]][0], -s, -x[0]) for r, x in enumerate(hard)]
    return sorted(out, key=repr)


def clustered(n, seed, width=10, scale=1.0):
    r = random.Random(seed)
    centres = [[r.gauss(0, scale) for _ in range(width)] for _ in range(12)]
    return [(k, [c + r.gauss(0, 0.3 * scale) for c in r.choice(centres)], r.randrange(4), k % 20 == 0) for k in range(n)]


def result(spark, rows, parts=5):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(parts)
    out = negatives.mine(df)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


def test_against_every_row(spark, monkeypatch):
    monkeypatch.setattr(negatives, "LEAST_BUCKET", 40)  # many buckets, and cells of several
    monkeypatch.setattr(negatives, "PROBE", 60)
    rows = clustered(500, 1)
    # One vector a third of the table; an id twice, in whole and not; no id; no label.
    rows += [(1000 + k, rows[40][1], k % 3, k == 9) for k in range(250)] + [rows[20], (20, rows[41][1], 1, True), (None, rows[40][1], 2, True), (None, rows[40][1], 3, None), (2000, rows[7][1], None, True)]
    rows += [(3000, None, 1, True), (3001, [None] + [0.0] * 9, 1, True), (3002, [float("nan")] * 10, 1, True), (3003, [float("-inf")] * 10, 1, False)]
    assert result(spark, rows) == brute(rows)


def test_large_components(spark):
    rows = clustered(80, 2, width=7, scale=15_000)
    rows = [r for r in rows if max(map(abs, r[1])) < 65_000]
    assert result(spark, rows, 2) == brute(rows)


def test_few_labels_and_none(spark):
    rows = [(0, [1.0, 0.0], 1, True), (1, [0.5, 0.0], 1, False), (2, [0.45, 0.0], 2, False), (3, [-1.0, 0.0], 1, True), (4, [0.0, 0.0], 3, True)]
    assert result(spark, rows, 1) == brute(rows) != []
    assert result(spark, [(1, [1.0], 1, True), (2, [1.0], 1, True)], 1) == []  # no other label; halves of none and one
    assert result(spark, [(1, [1.0], None, True)], 1) == [] and result(spark, [], 1) == []


def test_lengths(spark):
    with pytest.raises(Exception, match="one length|of others"):
        result(spark, [(1, [1.0, 2.0], 1, True), (2, [1.0], 1, True)], 1)


def test_walk_goes_by_falling_bounds():
    r = np.random.default_rng(3)
    for _ in range(50):
        one, two = r.integers(0, 9, 5).astype(float), r.integers(0, 9, 7).astype(float)
        sizes = r.integers(0, 3, 35)
        bounds = (one[:, None] + two[None]).ravel()
        cells = negatives.walk(one, two, sizes, 6, 1 << 40)
        assert sorted(cells) == np.flatnonzero((bounds >= 6) & (sizes > 0)).tolist()
        assert (np.diff(bounds[cells]) <= 0).all()
        assert len(negatives.walk(one, two, sizes, -1, 4)) <= 4


def test_cells_beyond_the_window_are_not_read(spark, monkeypatch):
    monkeypatch.setattr(negatives, "PROBE", 100)
    rows = clustered(3000, 5)
    kept = spark.createDataFrame([(k, label, a, [int(np.floor(256 * x)) for x in v]) for k, v, label, a in rows], "id long, label long, anchor boolean, v array<int>")
    table, index = negatives.build(kept)
    one = lambda x: F.array(F.lit(x).cast("bigint"))
    anchors = table.where("anchor").select("uid", "label", "v", one(600_000).alias("lows"), one(negatives.HIGHEST).alias("tops"))
    seen = negatives.visits(anchors, index, negatives.HIGHEST).select("uid", F.explode("cells").alias("c")).distinct().collect()
    read = sum(int(index.sizes[r.c]) for r in seen)
    assert read < 0.6 * 3000 * 150  # of all rows for all anchors
