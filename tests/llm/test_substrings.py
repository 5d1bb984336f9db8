import hashlib
import random
import re

import numpy as np

from spillspark.llm import runs, substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    """Per row, whatever its id; of rows with one id, the earlier in the list is first."""
    words = [(k if k is not None else -(1 << 63), i, k, WORD.findall(t or "")) for i, (k, t) in enumerate(rows)]
    seen, out = set(), []
    for _, _, k, w in sorted(words):
        gone = set()
        for i in range(len(w) - 19):
            x = tuple(w[i : i + 20])
            if x in seen:
                gone |= set(range(i, i + 20))
            seen.add(x)
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((k, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def dedup(spark, rows, parts=4):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as k", "2 as own", "3 as a", "4 as uid")
    return sorted(map(tuple, substrings.dedup(df.repartition(parts) if parts else df).collect()), key=repr)


def made(n=90):
    r = random.Random(8)
    voc = [a + b for a in ["tha", "er", "É", "ßt", "on"] for b in ["re", "on.", "st", "en", "ly"]]
    text = lambda m: [r.choice(voc) for _ in range(m)]
    passage, base = text(60), text(200)
    rows = [(0, None), (1, ""), (2, "a " * 19), (3, "a " * 20), (4, "a\t" * 70), (5, "a\x0b" * 21), (6, " ".join(passage[:20])), (7, "x" * 50_000)]
    for k in range(8, n):
        w = text(r.randint(0, 120))
        if k % 3 == 0:
            w[len(w) // 2 : len(w) // 2] = passage[r.randint(0, 20) : r.randint(30, 60)]
        if k % 5 == 0:
            w = list(base)
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = "edit%d" % k
        if k % 7 == 0:
            w = w + w[: r.randint(0, 60)]
        rows.append((k, r.choice([" ", "\n", " \r\n"]).join(w)))
    r.shuffle(rows)
    return rows


def test_against_brute_force(spark):
    rows = made()
    assert dedup(spark, rows) == brute(rows)


def test_runs_cut_anywhere(spark, monkeypatch):
    r = np.random.default_rng(1)
    tokens = runs.mix(r.integers(0, 3, 3000).astype(np.uint64))
    at = np.array([0, 5, 700, 720, 3000])
    for piece in (64, 1 << 20):
        monkeypatch.setattr(runs, "PIECE", piece)
        found = runs.find_runs(tokens, at, 20, 4)
        windows = sorted((d, s + i) for d, s, n in zip(found["doc"], found["start"], found["n"], strict=True) for i in range(n))
        assert windows == [(d, i) for d in range(4) for i in range(max(0, at[d + 1] - at[d] - 19))]
        spans = {}
        for d, s, n, a, h in zip(*(found[k] for k in ("doc", "start", "n", "anchor", "span")), strict=True):
            x = tuple(tokens[at[d] + s : at[d] + s + n + 19])
            assert spans.setdefault((a, h), x) == x


def test_odd_rows(spark):
    assert substrings.dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    t = " ".join(map(str, range(25)))
    rows = [(None, t), (1, t), (1, t), (2, None)]
    got = dedup(spark, rows)
    assert got == brute(rows) and [x[2] for x in got] == [25, 25, 0, 0]
    rows = [(1, t), (1, t)]
    assert sorted(x[2] for x in dedup(spark, rows)) == [0, 25]


def test_rows_that_share_an_id(spark):
    t = " ".join(map(str, range(25)))
    rows = [(7, t), (7, t + " more"), (7, "other words " * 3), (None, "x " + t)]
    got = dedup(spark, rows, 0)
    assert got == brute(rows)


def test_many_rows_without_an_id(spark):
    r = random.Random(3)
    some = [" ".join(r.choice("abcdef") + str(r.randint(0, 9)) for _ in range(22)) for _ in range(40)]
    rows = [(None, some[k] if k < 40 else " ".join(f"{k}w{j}" for j in range(21)) if k % 100 else some[k // 100 % 40]) for k in range(10_000)]
    assert dedup(spark, rows) == brute(rows)


def test_words_made_to_collide(spark):
    """Sums with powers of any odd base agree on these two words: they are different."""
    one = "".join("ab"[i.bit_count() % 2] for i in range(1024))
    two = one.translate(str.maketrans("ab", "ba"))
    rest = " ".join(f"w{i}" for i in range(10))
    rows = [(1, f"{rest} {one} {rest}"), (2, f"{rest} {two} {rest}")]
    assert dedup(spark, rows) == brute(rows) and all(x[2] == 0 for x in brute(rows))
    ab = ("left", "right")
    rows = [(k, " ".join(ab[(i.bit_count() + k) % 2] for i in range(32))) for k in (0, 1)]
    assert dedup(spark, rows) == brute(rows)
