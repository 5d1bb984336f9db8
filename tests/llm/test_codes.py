import hashlib
import random

import numpy as np
import pytest

from spillspark.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label int, id string, code string"


def brute(rows, parts=16, entries=64, rounds=2):
    """Every part against every entry, with Python's integers."""
    kept = [(k, [int(np.floor(256 * float(np.float32(x)))) for x in v], l) for k, v, l in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = len(kept[0][1]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][1]))[:entries]
    books = [[cut[i][p] for i in order] for p in range(parts)]

    def near(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), i) for i, e in enumerate(books[p]))

    for _ in range(rounds):
        after = []
        for p in range(parts):
            members = {}
            for c in cut:
                members.setdefault(near(p, c[p])[1], []).append(c[p])
            after.append([[sum(x[j] for x in members[i]) // len(members[i]) for j in range(width)] if i in members else e for i, e in enumerate(books[p])])
        books = after
    found = [[near(p, c[p]) for p in range(parts)] for c in cut]
    error = [sum(d for d, _ in f) for f in found]
    by = {}
    for (_, _, label), e in zip(kept, error, strict=True):
        by[label] = by.get(label, 0) + e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((k, "".join(f"{i:02x}" for _, i in f), e, by[label], sha) for (k, _, label), f, e in zip(kept, found, error, strict=True)), key=repr)


def vectors(n, seed, width=32):
    r = random.Random(seed)
    centres = [[r.uniform(-1, 1) for _ in range(width)] for _ in range(7)]
    return [(k, [c + r.gauss(0, 0.2) for c in r.choice(centres)], r.choice([0, 1, 2, None])) for k in range(n)]


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def result(df):
    return sorted((tuple(r)[:5] for r in df.collect()), key=repr)


def test_against_every_entry(spark):
    rows = vectors(300, 3)
    # Ties and repeats: equal vectors under other ids, an id twice, no id, a third of all rows alike.
    rows += [(1000 + k, rows[5][1], 1) for k in range(150)] + [(9, [0.5] * 32, 2), (9, [-0.5] * 32, None), (None, rows[6][1], 0), rows[8]]
    # Dropped: no vector, a null component, components that aren't finite.
    rows += [(-1, None, 0), (-2, [None] + [0.0] * 31, 0), (-3, [float("nan")] * 32, 0), (-4, [float("inf")] + [0.0] * 31, 0)]
    df = codes.compress(table(spark, rows).repartition(5))
    assert df.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256", "n_exact"]
    assert result(df) == brute(rows)
    exact = [r.n_exact for r in df.collect()]
    assert max(exact) <= 16 * 64 and sum(exact) < 0.7 * len(exact) * 16 * 64  # bounds do prune


def test_few_rows_and_none(spark):
    rows = vectors(5, 4, 16)
    assert result(codes.compress(table(spark, rows))) == brute(rows)
    for none in ([], [(1, None, 0)]):
        df = codes.compress(table(spark, none))
        assert df.count() == 0 and df.columns[:2] == ["vec_id", "code"]


def test_lengths_and_sizes(spark):
    for odd in ([(1, [0.0] * 15, 0)], [(1, [0.0] * 16, 0), (2, [0.0] * 32, 0)], [(1, [1e9] * 16, 0)]):
        with pytest.raises(Exception, match="multiple of 16|of others|too large"):
            codes.compress(table(spark, odd)).collect()


def test_bounds_never_pass_over_the_nearest():
    r = np.random.default_rng(1)
    for scale in (2, 300, 100_000):
        points, book = r.integers(-scale, scale, (500, 3)), r.integers(-scale, scale, (40, 3))
        pivots = codes.pivots_of(book)
        found, best, _ = codes.nearest(points, codes.far_from(points, pivots), book, codes.far_from(book, pivots))
        d = ((points[:, None] - book[None]) ** 2).sum(2)
        assert (found == d.argmin(1)).all() and (best == d.min(1)).all()
