import random
import re

import numpy as np
import pytest

from spillspark.llm import ngrams

SCHEMA = "doc_id long, text string, node string, h string, n string"


def shingles(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) > 3 else ({tuple(w)} if w else set())


def brute(rows):
    """Every pair of rows."""
    sets = [shingles(t) for _, t in rows]
    comp = list(range(len(rows)))

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                comp[root(a)] = root(b)
    ids = {}
    for k, (i, _) in enumerate(rows):
        ids.setdefault(root(k), []).append(i)
    least = {r: min((i for i in v if i is not None), default=None) for r, v in ids.items()}
    return sorted(((i, len(sets[k]), least[root(k)] if sets[k] else i) for k, (i, _) in enumerate(rows)), key=repr)


def made(seed=1, groups=12, copies=9):
    """Groups of near copies, among texts that share a long passage or nothing."""
    r = random.Random(seed)
    voc = [a + b for a in "tha era ouí nde ßch Qx".split() for b in "re on st en ly".split()]
    passage = [r.choice(voc) for _ in range(40)]
    rows = [(0, ""), (1, None), (2, "one"), (3, "ONE"), (4, "one\ttwo"), (5, " \n"), (6, "a b c"), (7, "É b c d"), (8, "é b c d"), (9, "one two"), (10, "A b\x0bc D"), (None, "a b c d"), (10, "a b c d"), (None, "")]
    for g in range(groups):
        base = [r.choice(voc) for _ in range(r.randint(30, 120))] + (passage if g % 2 else [])
        for c in range(copies):
            w = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 3])):
                w[r.randrange(len(w))] = "x%d" % r.randrange(60)
            rows.append((100 * (g + 1) + c, " ".join(w[: len(w) - r.choice([0, 0, 3, 9])])))
    for k in range(60):
        rows.append((5000 + k, " ".join(passage + [r.choice(voc) for _ in range(r.randint(0, 25))])))
    r.shuffle(rows)
    return rows


def result(spark, rows):
    df = ngrams.near_duplicates(spark.createDataFrame([(*x, "x", "y", "z") for x in rows], SCHEMA).repartition(5))
    assert df.columns == ["doc_id", "n_shingles", "component_id"]
    return sorted((tuple(x) for x in df.collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_every_pair(spark, seed):
    rows = made(seed)
    got, want = result(spark, rows), brute(rows)
    assert got == want
    assert len({c for _, n, c in want if n}) < len(rows) - 40  # there is something to find


def test_large_blocks_are_split(spark, monkeypatch):
    monkeypatch.setattr(ngrams, "ROWS", 6)
    monkeypatch.setattr(ngrams, "CHUNK", 16)
    rows = made(3, groups=4, copies=40)
    assert result(spark, rows) == brute(rows)


def test_chains_and_copies(spark):
    words = ["w%d" % k for k in range(400)]
    rows = [(k, " ".join(words[k : k + 100])) for k in range(0, 60, 4)]  # each links with its neighbours only
    rows += [(1000 + k, rows[3][1]) for k in range(120)] + [rows[2], rows[2]]
    got = result(spark, rows)
    assert got == brute(rows) and {c for _, _, c in got} == {0}


def test_very_long_text(spark):
    r = random.Random(8)
    words = ["v%d" % r.randrange(10_000_000) for _ in range(250_000)]
    other = words[: 240_000] + ["y"]
    rows = [(5, " ".join(words)), (3, " ".join(other)), (4, " ".join(words[:150_000])), (9, "z" * 3_000_000)]
    assert result(spark, rows) == brute(rows)


def test_no_rows(spark):
    assert result(spark, []) == [] and result(spark, [(3, None)]) == [(3, 0, 3)]


def test_product_counts_like_sets():
    r = np.random.default_rng(4)
    for _ in range(40):
        k = int(r.integers(2, 40))
        base = r.integers(0, 60, 50)
        sets = [np.unique(np.where(r.random(50) < 0.04, r.integers(0, 99, 50), base)) for _ in range(k)]
        n = np.array([len(s) for s in sets])
        part = r.integers(0, 2, k)
        left, right = np.flatnonzero(part == 0), np.flatnonzero(part == 1)
        if r.random() < 0.5:
            left = right = np.arange(k)
        got = ngrams.linked(ngrams.overlaps(np.repeat(np.arange(k), n), np.concatenate(sets), left, right, n), n[left][:, None], n[right][None])
        for x, a in enumerate(left):
            for y, b in enumerate(right):
                if a != b:
                    assert got[x, y] == ngrams.linked(len(np.intersect1d(sets[a], sets[b])), n[a], n[b])
