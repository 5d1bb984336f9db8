import random

import numpy as np

from spillspark.llm import latent


def made():
    r = random.Random(12)
    voc = [a + b + c for a in ["th", "er", "é", "ou", "st"] for b in "aeiou" for c in ["re", "n", "ly", "ed", "sh", "tion"]]
    voc = [x + y for x in voc for y in voc[::7]]
    text = lambda n: [r.choice(voc) if r.random() < 0.7 else r.choice(voc[:9]) for _ in range(n)]
    items = [(i, [text(r.randint(5, 25)), text(r.randint(6, 12))]) for i in range(30)]
    say = lambda parts: " ".join(" ".join(p).capitalize() + "." for p in parts)
    docs, want = [], {}
    for k in range(300):
        w = text(r.randint(0, 300))
        i, parts = r.choice(items)
        flat = [x for p in parts for x in p]
        if k % 6 == 0:  # as it is
            w[len(w) // 2 : len(w) // 2] = say(parts).split()
            want[k] = {i}
        elif k % 6 == 1:  # every tenth word another
            w = w + [x if j % 10 != 4 else r.choice(voc) for j, x in enumerate(flat)]
            want[k] = {i}
        elif k % 6 == 2:  # a clean document with a few words in common
            a = r.randrange(len(flat))
            w = w + flat[a : a + 4]
        docs.append((k, " ".join(w)))
    docs += [(1000, None), (1001, ""), (1002, "x" * 100_000), (None, say(items[0][1]))]
    return docs, [(i, say(p)) for i, p in items] + [(None, "a b c"), (90, None), (91, "..."), (92, "")], want


def brute(items, docs):
    """Longest common subsequence of every item with every window of every document."""
    one = lambda t: latent.words_of(np.frombuffer((t or "").encode(), np.uint8), np.array([0, len((t or "").encode())]))[0]
    out = {}
    for k, t in docs:
        w = one(t)
        out[k] = {i for i, s in items if i is not None and s and one(s).size and latent.aligned(one(s), one(s.split(". ")[-1]), w)}
    return out


def test_against_brute_force(spark):
    docs, items, want = made()
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as share", "2 as uid", "3 as item_ids").repartition(3)
    got = {r.doc_id: set(r.item_ids) for r in latent.decontaminate(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert {k: v for k, v in got.items() if k in want} == want
    assert got[None] == {0} and not any(got[k] for k in got if k is not None and k not in want)
    assert got == brute(items, docs)


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(latent, "ITEM_BLOCK", 7)
    docs, items, want = made()
    rows = latent.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(rows) == len(docs)
    assert {r.doc_id: set(r.item_ids) for r in rows if r.contaminated and r.doc_id is not None} == want


def test_svd_matches_numpy(spark, monkeypatch):
    monkeypatch.setattr(latent, "HASHED", 1 << 10)
    monkeypatch.setattr(latent, "CHUNK", 128)
    g = np.random.default_rng(0)
    a = np.zeros((200, 1 << 10), np.float32)
    a[:, :60] = g.standard_normal((200, 5)) @ g.standard_normal((5, 60)) + 0.01 * g.standard_normal((200, 60))
    rows = [(np.flatnonzero(r).tolist(), r[r != 0].tolist()) for r in a]
    v, s = latent.randomised_svd(spark.createDataFrame(rows, "w array<int>, v array<float>").repartition(3), rank=5, extra=5)
    _, want, vt = np.linalg.svd(a, full_matrices=False)
    assert np.allclose(s, want[:5], rtol=1e-3)
    assert np.allclose(np.abs(vt[:5] @ v), np.eye(5), atol=1e-2)


def test_common_subsequence():
    r = random.Random(3)
    for _ in range(50):
        a, b = ([r.randint(0, 4) for _ in range(r.randint(0, 30))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert latent.common(np.array(a, np.uint64), np.array(b, np.uint64)) == t[-1][-1]


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert latent.decontaminate(none, bench).collect() == []
    got = latent.decontaminate(spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string"), bench.limit(0)).collect()
    assert [(r.contaminated, r.n_items) for r in got] == [(False, 0)]
