import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from spillspark.llm import suffixes


def brute(rows, w=200):
    """Per row, whatever its id: n_bytes, n_removed, n_spans, digest."""
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(b[i : i + w] for b in data for i in range(len(b) - w + 1))
    out = []
    for (k, _), b in zip(rows, data, strict=True):
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - w + 1):
            if seen[b[i : i + w]] > 1:
                gone[i : i + w] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0]) if len(b) else 0
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        out.append((k, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def dedup(spark, rows, parts=4):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as k", "2 as part", "3 as a", "4 as uid").repartition(parts)
    return sorted(map(tuple, suffixes.dedup(df).collect()), key=repr)


def made(n=70):
    r = random.Random(6)
    voc = [a + b for a in ["tha", "er", "É", "ßt", "on"] for b in ["re", "on.", "st", "en", "ly"]]
    text = lambda m: " ".join(r.choice(voc) for _ in range(m))
    passage, base = text(120), text(200)
    rows = [(0, None), (1, ""), (2, "a" * 199), (3, "a" * 200), (4, "b" * 700), (5, "b" * 201), (6, "xy" * 400), (7, "é" * 30_000)]
    for k in range(8, n):
        t = text(r.randint(0, 90))
        if k % 3 == 0:
            a = r.randint(0, 300)
            t = t[:100] + passage[a : a + r.randint(150, 500)] + t[100:]
        if k % 5 == 0:
            t = base
            for _ in range(r.randint(0, 3)):
                a = r.randrange(len(t))
                t = t[:a] + "Z%d" % k + t[a + 1 :]
        if k % 7 == 0:
            t = t + t[: r.randint(0, 400)]
        rows.append((k, t))
    r.shuffle(rows)
    return rows


def test_suffix_order_is_sorted():
    r = random.Random(1)
    for size in (1, 2, 30, 400):
        for alphabet in (b"\x01", b"\x01\x02", bytes(range(1, 9))):
            t = np.array([r.choice(alphabet) for _ in range(size)] + [0], np.uint8)
            order = suffixes.suffix_order(t, np.ones(len(t), bool), 1 << 12)
            b = t.tobytes()
            assert order.tolist() == sorted(range(len(b)), key=lambda i: b[i:])


@pytest.mark.parametrize("hot", [4096, 2])
def test_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "HOT", hot)
    rows = made()
    assert dedup(spark, rows) == brute(rows)


def test_blocks_of_whole_anchors(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "BLOCK", 700)
    rows = made()
    assert dedup(spark, rows) == brute(rows)


def test_a_common_passage_in_many_contexts(spark, monkeypatch):
    """One anchor with far more runs than are sorted together, at every level of cutting."""
    monkeypatch.setattr(suffixes, "HOT", 30)
    r = random.Random(9)
    some = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    line = some(230)
    rows = [(k, some(r.randint(0, 90)) + line[: r.randint(60, 230)] + some(r.randint(0, 90))) for k in range(150)]
    rows += [(200 + k, line[20:212] + f"{k % 20:06d}" + line[:10]) for k in range(40)]
    assert dedup(spark, rows) == brute(rows)


def test_odd_rows(spark):
    assert suffixes.dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    t = "".join(chr(65 + i % 23) + str(i) for i in range(120))
    rows = [(None, t), (1, t), (1, t), (2, None), (3, "x" + t[:199]), (4, t[:150]), (4, None)]
    assert dedup(spark, rows) == brute(rows)
    rows = [(1, t[:260]), (1, t[:260])]
    assert dedup(spark, rows) == brute(rows) and all(x[2] == 260 for x in brute(rows))


def test_many_rows_without_an_id(spark):
    r = random.Random(3)
    some = ["".join(r.choice("abcdef ") for _ in range(210)) for _ in range(40)]
    rows = [(None, some[k] if k < 40 else f"{k} " * 45 if k % 100 else some[k // 100 % 40]) for k in range(3000)]
    assert dedup(spark, rows) == brute(rows)


def thue_morse(n):
    return "".join("ab"[i.bit_count() % 2] for i in range(n))


def test_texts_made_to_collide(spark):
    """Sums with powers of any odd base agree on these two: they are no copies."""
    x, y = (f"begin {t} end" for t in (thue_morse(2048), thue_morse(2048).translate(str.maketrans("ab", "ba"))))
    rows = [(1, x), (2, y)]
    assert dedup(spark, rows) == brute(rows)


def test_a_very_long_text(spark):
    r = random.Random(2)
    long = "".join(r.choice("abcdefgh ") for _ in range(3_000_000))
    rows = [(1, long), (2, long[1_500_000 : 1_500_300]), (3, "é" * 100)]
    got = dedup(spark, rows)
    assert [x[:4] for x in got] == [(1, 3_000_000, 300, 1), (2, 300, 300, 1), (3, 200, 0, 0)]
