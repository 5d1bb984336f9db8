import os
import zlib

import numpy as np
import pytest

from spillspark.llm import bytenet as b
from spillspark.llm import queries

D = "/root/testdata/sf0.01"


def slow(model, text):
    """One text, one filter position at a time."""
    starts = [0]
    while starts[-1] + b.CHUNK < len(text):
        starts.append(starts[-1] + b.CHUNK - b.OVERLAP)
    maxima = []
    for s in starts:
        byte = lambda i: text[i] if 0 <= i < len(text) else 0
        best = np.full(b.FILTERS, -np.inf)
        for p in range(b.POSITIONS):
            x = []
            for k in range(b.KERNEL):
                i = s + p * b.STEP + k
                x += [*model["embed"][byte(i)], *(float(byte(i) == byte(i - lag) and byte(i) != 0) for lag in b.LAGS)]
            best = np.maximum(best, np.array(x) @ model["filters"])
        maxima.append(np.maximum(best + model["bias"], 0))
    hidden = np.maximum(np.mean(maxima, axis=0) @ model["dense"] + model["dense_bias"], 0)
    return 1 / (1 + np.exp(-(hidden @ model["out"] + model["out_bias"][0])))


def test_score_is_the_network():
    m = b.initial()
    texts = [b"", b"a", b"abc abc abc " * 40, "é".encode() * 300, bytes(range(32, 127)) * 9, b"x" * 256, b"y" * 257]
    raw, at = np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum([len(t) for t in texts])]
    assert np.allclose(b.score(m, raw, at), [slow(m, t) for t in texts], atol=1e-5)


def test_gradient_by_differences():
    m = {k: v.astype(np.float64) for k, v in b.initial(3).items()}
    texts = [b"the quick brown fox " * 20, b"*** %%% aaa bbb aaa bbb"]
    raw, at = np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum([len(t) for t in texts])]
    y, w = np.array([1.0, 0.0]), np.array([1.0, 2.0])

    def loss():
        p = b.score(m, raw, at)
        return -(w * (y * np.log(p) + (1 - y) * np.log(1 - p))).mean()

    g = b.step(m, raw, at, y, w)
    r = np.random.default_rng(0)
    for k, v in m.items():
        big = np.argsort(-np.abs(g[k]).ravel())[:40]
        for i in r.choice(big, min(4, len(big)), replace=False):
            old, h = v.flat[i], 1e-2
            v.flat[i] = old + h
            up = loss()
            v.flat[i] = old - h
            down = loss()
            v.flat[i] = old
            assert abs((up - down) / (2 * h) - g[k].flat[i]) < 0.05 * abs(g[k].flat[i]) + 2e-4, (k, i)


@pytest.mark.skipif(not os.path.isdir(D), reason="needs the given tables")
def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in queries.op8_quality_classifier(spark, D).collect()}
    labels = spark.read.parquet(f"{D}/labels.parquet").collect()
    out = [(r.quality, got[r.doc_id].score) for r in labels if got[r.doc_id].held_out]
    assert all(got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in labels)
    good, bad = [s for q, s in out if q], [s for q, s in out if not q]
    auc = np.mean([(a > c) + 0.5 * (a == c) for a in good for c in bad])
    assert auc > 0.95
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in got.values())


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, "x"), (1, None), (1, ""), (2, "q" * 300_000)], "doc_id long, text string").selectExpr("*", "0 as score")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = b.classify(docs, none).collect()
    assert len(got) == 4 and sum(r.held_out is None for r in got) == 1
    assert b.classify(docs.limit(0), none).collect() == []


def test_a_very_long_text_scores_as_its_chunks():
    g = np.random.default_rng(4)
    raw = g.integers(32, 127, 3_000_000).astype(np.uint8)
    m = b.initial()
    at = np.array([0, 700, 2_999_000, 3_000_000])
    block, text = b.chunks(raw, at)
    whole = b.combined(m, np.concatenate([b.pooled(m, block[a : a + 500]) for a in range(0, len(block), 500)]), text, 3)
    assert np.allclose(b.score(m, raw, at), whole, atol=1e-6)
    some, of = b.chunks(raw, at, 5, 900)
    assert (some == block[5:900]).all() and (of == text[5:900]).all()
