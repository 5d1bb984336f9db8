"""The starts of the outlier estimate compute each median once."""

import numpy as np

from spillspark.llm import quality


def test_medians_are_computed_once(spark):
    rows = [(g, *[(k * (j + 3)) % 97 for j in range(6)]) for g in ("a", "b") for k in range(80)]
    fit = spark.createDataFrame(rows, "g string, " + ", ".join(f"{x} long" for x in quality.FEATURES))
    made = quality._starts(fit)
    assert "Window" not in made._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.g, r.start): r for r in made.collect()}
    for g in ("a", "b"):
        for j in range(6):
            assert got[g, 0][f"mu{j}"] == got[g, 1][f"mu{j}"] == sorted(r[j + 1] for r in rows if r[0] == g)[39] / 1000


def test_every_start_takes_all_rows(spark):
    """Against numpy over all rows; four of six starts were sets drawn by hash."""
    r = np.random.default_rng(8)
    x = np.round(r.standard_normal((301, 6)) * 900 + np.arange(6) * 500).astype(int)
    x[:40] += 6000
    df = spark.createDataFrame([("a", *map(int, row)) for row in x], "g string, " + ", ".join(f"{n} long" for n in quality.FEATURES))
    got = {row.start: row for row in quality._starts(df).collect()}
    assert sorted(got) == [0, 1, 2, 3, 4, 5]
    m = np.sort(x, axis=0)[150]
    v = np.maximum(1.4826 * np.sort(np.abs(x - m), axis=0)[150] / 1000, quality.FLOOR)
    z = (x - m) / 1000 / v
    far = np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)
    for start, y in enumerate([np.tanh(z), 2.45 * z / far, z * np.minimum(1, 2.8 / far), np.sign(z) * np.log1p(np.abs(z))], 2):
        c = np.cov(y.T, bias=True) + np.eye(6) * quality.FLOOR**2
        w = np.array([[got[start][f"w{i}{j}"] if j <= i else 0 for j in range(6)] for i in range(6)]) * v
        assert np.allclose([got[start][f"mu{i}"] for i in range(6)], m / 1000 + v * y.mean(0), atol=2e-3)
        assert np.allclose(w.T @ w, np.linalg.inv(c), rtol=1e-2, atol=1e-2)
