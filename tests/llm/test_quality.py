import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from spillspark.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    again = Counter(windows)
    covered = {j for i, x in enumerate(windows) if again[x] > 1 for j in range(i, i + 8)}
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed)


def made():
    r = random.Random(4)
    voc = "the of thaner ereaing onst élan ßt 12 blent er. Oth, wh st".split()
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, "a\x0bb\x0cc\rd\n\nd\nd \n\r\n"), (4, "x " * 60), (5, "a b c d e f g h a b c d e f g h i " * 2), (6, "é" * 100_000)]
    for k in range(7, 200):
        w = [r.choice(voc) + r.choice(["", "re", "ti", "ou"]) for _ in range(r.randint(10, 200))]
        if k % 9 == 0:
            w = [x + "***" for x in w]
        if k % 7 == 0:
            w = w + w[: r.randint(0, 30)]
        rows.append((k, "".join(x + r.choice(" \n  ") for x in w)))
    return [(k, t, r.choice(["en", "fr", None]), r.choice(["s", None])) for k, t in rows]


def test_counts_and_verdicts(spark):
    rows = made()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "1 as g", "2 as n_words", "'a' as words")
    got = {r.doc_id: r for r in quality.judged(df).collect()}
    assert len(got) == len(rows)
    for k, t, _, _ in rows:
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(t), k
        assert not (r.base_failed and r.kept)
    fine = [r for r in got.values() if not r.base_failed and r.doc_id > 6]
    junk = [r for r in fine if r.doc_id % 9 == 0]
    assert junk and not any(r.kept for r in junk)
    clean = [r for r in fine if r.doc_id % 9]
    assert sum(r.kept for r in clean) >= 0.95 * len(clean)


def test_estimate_matches_numpy(spark):
    g = np.random.default_rng(0)
    x = np.round(g.standard_normal((400, 6)) * 1000 + np.arange(6) * 700).astype(int)
    x[:60] += 9000  # outliers that a plain mean would follow
    df = spark.createDataFrame([("all", False, *map(int, row)) for row in x], "g string, base_failed boolean, " + ", ".join(f"x{i} long" for i in range(1, 7)))
    fit = quality.estimates(df).collect()[0]
    mu = np.array([fit[f"mu{i}"] for i in range(6)])
    w = np.array([[fit[f"w{i}{j}"] if j <= i else 0 for j in range(6)] for i in range(6)])
    y = (x / 1000 - mu) @ w.T
    d2 = (y**2).sum(1)
    assert d2[:60].min() > 10 * np.median(d2[60:])
    near = np.argsort(d2)[:300]
    c = x[near] / 1000
    s = np.cov(c.T, bias=True) + np.eye(6) * quality.FLOOR**2
    # the winner is a fixed point of the concentration step
    assert np.allclose(c.mean(0), mu, atol=0.08) and np.allclose(np.linalg.inv(s), w.T @ w, rtol=0.25, atol=0.15)


def test_empty(spark):
    assert quality.judged(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).collect() == []


def test_accepted_keeps_columns_of_any_name(spark):
    rows = [(k, t, "en", "s", k, "x") for k, t in [(1, "some plain words of a text " * 1 + " ".join(f"w{i}" for i in range(30))), (2, "short"), (2, None)]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, q_hash long, text_key string")
    got = quality.accepted(df)
    assert got.columns == df.columns and list(map(tuple, got.collect())) == rows[:1]


def test_the_nearest_share_is_exact(spark):
    """Counts by weight: exactly the share, whatever ties there are."""
    g = np.random.default_rng(2)
    x = np.round(g.standard_normal((333, 6)) * 300).astype(int)
    x[:150] = x[0]  # one group of equal rows
    df = spark.createDataFrame([("all", *map(int, row)) for row in x], "g string, " + ", ".join(f"x{i} long" for i in range(1, 7)))
    p = range(6)
    one = df.limit(1).selectExpr("g", "0 as start", *[f"{float(x[0][i]) / 1000}D as mu{i}" for i in p], *[f"{1.0 if i == j else 0.0}D as w{i}{j}" for i, j in quality.PAIRS])
    one = one.withColumn("logdet", F.lit(0.0))
    bins = quality._nearest(quality._sums(quality._distances(df, one))).collect()
    assert abs(sum(r.n * r.part for r in bins) - int(0.75 * 333)) < 1e-9
    rest = sorted(((row - x[0]) / 1000) @ ((row - x[0]) / 1000) for row in x)
    end = max(r.bin for r in bins if r.part)
    assert np.exp(end / quality.BINS) - 1e-6 <= rest[int(0.75 * 333) - 1] <= np.exp((end + 1) / quality.BINS)
    fitted = quality._estimate(quality._nearest(quality._sums(quality._distances(df, one)))).first()
    near = x[np.argsort([((row - x[0]) / 1000) @ ((row - x[0]) / 1000) for row in x], kind="stable")[: int(0.75 * 333)]] / 1000
    assert np.allclose([fitted[f"mu{i}"] for i in range(6)], near.mean(0), atol=0.01)


def plain(k, n=60):
    r = random.Random(k)
    return " ".join(r.choice("some plain words of a text that goes on and says little".split()) + str(r.randrange(99)) for _ in range(n + r.randrange(9)))


def test_every_document_is_judged(spark):
    """Small sources, small languages, and a table that is small itself."""
    odd = " ".join("$$%d##ABC" % k for k in range(60))
    rows = [(k, plain(k), "en", "big") for k in range(150)] + [(1000 + k, plain(k), "en", f"s{k % 9}") for k in range(70)] + [(2000 + k, plain(k), "fr", "s") for k in range(5)] + [(2999, odd, "fr", "s"), (1999, odd, "en", "s0"), (3000, "few words", "de", None)]
    got = {r.doc_id: r for r in quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    by = lambda low, high: {r.judged_by for k, r in got.items() if low <= k < high}
    assert (by(0, 1000), by(1000, 2000), by(2000, 3000), by(3000, 3001)) == ({"source"}, {"lang"}, {"all"}, {"none"})
    assert not got[1999].kept and not got[2999].kept and not got[3000].kept
    assert all(r.kept and r.distance is not None and r.settled for k, r in got.items() if k not in (1999, 2999, 3000))


def test_small_tables(spark):
    odd = " ".join("$$%d##ABC" % k for k in range(60))
    rows = [(k, plain(k), "en", "s") for k in range(9)]
    for extra in ([(9, odd, "en", "s")],):
        got = {r.doc_id: r for r in quality.judged(spark.createDataFrame(rows + extra, "doc_id long, text string, lang string, source string")).collect()}
        assert all(r.judged_by == "all" and r.distance is not None and r.kept == (k < 9) for k, r in got.items())
    alone = quality.judged(spark.createDataFrame(rows[:1], "doc_id long, text string, lang string, source string")).first()
    assert alone.kept and alone.distance == 0


def test_very_long_texts(spark):
    rows = [(k, plain(k), "en", "s") for k in range(70)] + [(100, plain(1, 200_000), "en", "s"), (101, "z" * 2_000_000, "en", "s"), (102, "a b c d e f g h " * 100_000, "en", "s")]
    got = {r.doc_id: r for r in quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert got[100].n_words >= 200_000 and not got[100].base_failed and got[100].distance is not None
    assert got[101].n_words == 1 and not got[101].kept and got[102].n_repeat_words == 800_000 and got[102].base_failed
