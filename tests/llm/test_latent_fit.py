"""The latent space is fitted on the passages of all documents."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from spillspark.llm import latent


def hashed(text):
    return latent.hashed(latent.words_of(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))[0])


def many(spark):
    """More documents than ``SAMPLE_DOCS``: those beyond by hash speak of something else."""
    ids = spark.range(latent.SAMPLE_DOCS + 400).select(F.col("id").alias("doc_id"))
    order = [r.doc_id for r in ids.orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    rng, late = random.Random(1), set(order[latent.SAMPLE_DOCS :])
    text = lambda k: " ".join(rng.choice([f"{'late' if k in late else 'early'}{i}" for i in range(40)]) for _ in range(60))
    return spark.createDataFrame([(k, text(k)) for k in sorted(order)], "doc_id long, text string")


def told(monkeypatch, run):
    """How much of the late and early words' vectors lies in the basis that ``run`` searches with."""
    seen, plain = [], latent._scan
    monkeypatch.setattr(latent, "_scan", lambda docs, items, basis, idf, kind: seen.append(basis) or plain(docs, items, basis, idf, kind))
    run()
    return [np.linalg.norm(seen[0][np.unique(np.concatenate([hashed(f"{w}{i}") for i in range(40)]))]) for w in ("late", "early")]


ITEMS = [(1, "what is early0 of early1 and early2? early3 early4 early5.")]


def test_every_document_is_fitted(spark, monkeypatch):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    late, early = told(monkeypatch, lambda: latent.decontaminate(many(spark), items))
    assert late > 0.5 * early > 0


def test_pipeline_fits_every_document(spark, monkeypatch, tmp_path):
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    late, early = told(monkeypatch, lambda: corpus_pipeline.decontamination(spark, many(spark), str(tmp_path)))
    assert late > 0.5 * early > 0


def test_product_matches_plain_passages():
    r = np.random.default_rng(1)
    texts = [" ".join(f"w{x % 300}" for x in r.zipf(1.3, size=n)) for n in (0, 1, 5, 24, 25, 48, 49, 72, 73, 200, 333)]
    idf = r.random(latent.HASHED).astype(np.float32)
    basis = r.standard_normal((latent.HASHED, 7)).astype(np.float32)
    weights = r.choice([1.0, 10.0], size=len(texts))
    total, want = np.zeros((latent.HASHED, 7)), np.zeros((latent.HASHED, 7))
    latent.text_product(idf)(pa.RecordBatch.from_arrays([pa.array(texts), pa.array(weights)], ["text", "weight"]), basis, total)
    for text, weight in zip(texts, weights, strict=True):
        w = hashed(text)
        for s in range(0, max(len(w) - latent.BLOCK, 1), latent.BLOCK):
            own, tf = np.unique(w[s : s + 2 * latent.BLOCK], return_counts=True)
            v = tf * idf[own]
            if len(own):
                v *= weight / np.linalg.norm(v)
                want[own] += np.outer(v, v @ basis[own])
    assert np.allclose(total, want, rtol=1e-4, atol=1e-3)
