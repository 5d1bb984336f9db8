"""The stages against brute-force versions on a small corpus."""

import os
import re
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from spillspark.llm import packing
from tests.llm import test_pii as pii_cases
from tests.llm import test_quality as quality_cases
from tests.llm import test_simhash as simhash_cases

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    if not os.path.isdir(D):
        pytest.skip("needs the given tables")
    docs = spark.read.parquet(f"{D}/documents.parquet")
    # a repeated row, and nulls in every column
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "the of " * 30, None, None, None)], docs.schema)
    docs = docs.unionByName(docs.where("doc_id in (3, 4)")).unionByName(odd)
    out = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        out.append((name, stage(spark, out[-1][1], D).cache()))
    return out


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_order_and_columns(stages):
    assert [n for n, _ in stages[1:]] == ["quality_rules", "near_dedup", "decontamination", "pii", "packing"]
    for _, df in stages[1:-1]:
        assert df.columns == stages[0][1].columns


def test_quality(stages):
    before, after = rows(stages[0][1]), rows(stages[1][1])
    assert len(after) < len(before)
    for r in after:
        assert not quality_cases.brute(r["text"])[-1]
    junk = [r for r in before if r["text"] and quality_cases.brute(r["text"])[2] > 0.2 * len(r["text"].split())]
    ids = {r["doc_id"] for r in after}
    assert junk and not any(r["doc_id"] in ids for r in junk)
    clean = [r for r in before if r["text"] and not quality_cases.brute(r["text"])[-1] and quality_cases.brute(r["text"])[2] == 0 and r["text"].upper() != r["text"]]
    assert sum(r["doc_id"] in ids for r in clean) > 0.9 * len(clean)


def test_near_dedup(stages):
    before, after = rows(stages[1][1]), rows(stages[2][1])
    found = simhash_cases.brute([(r["doc_id"], r["text"]) for r in before])
    want = sorted({c for _, c in found.values()})
    assert sorted(r["doc_id"] for r in after) == want


def test_decontamination(spark, stages):
    before, after = rows(stages[2][1]), {r["doc_id"] for r in rows(stages[3][1])}
    plain = lambda t: " ".join(re.findall(r"\w+", t.lower()))
    items = [plain(r.text) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    for r in before:
        held = any(i in plain(r["text"]) for i in items)
        assert held == (r["doc_id"] not in after), r["doc_id"]


def test_pii(stages):
    before, after = {r["doc_id"]: r for r in rows(stages[3][1])}, {r["doc_id"]: r for r in rows(stages[4][1])}
    assert before.keys() == after.keys()
    for k, r in after.items():
        found = pii_cases.brute(before[k]["text"])
        left = pii_cases.brute(r["text"])
        assert not any(left.values()) and r["n_chars"] == len(r["text"])
        if not any(found.values()) and "token" not in before[k]["text"]:
            assert r["text"] == before[k]["text"]


def test_packing(stages):
    texts = {r["doc_id"]: r["text"] for r in rows(stages[4][1])}
    t = Tokenizer.from_file(packing.vocabulary_path())
    pieces = {}
    for p in rows(stages[5][1]):
        pieces.setdefault(p["doc_id"], []).append(p)
    assert pieces.keys() == texts.keys()
    for k, own in pieces.items():
        want = np.array([*t.encode(texts[k] or "", add_special_tokens=False).ids, 1], "<u4")
        own.sort(key=lambda p: p["start"])
        assert [p["start"] for p in own] == np.cumsum([0] + [p["length"] for p in own])[:-1].tolist()
        assert b"".join(np.frombuffer(p["ids"], np.uint16).astype("<u4").tobytes() for p in own) == want.tobytes()
        assert all(p["ids_crc32"] == zlib.crc32(want[p["start"] : p["start"] + p["length"]].tobytes()) for p in own)


def test_columns_of_any_name_and_empty_tables(spark):
    if not os.path.isdir(D):
        pytest.skip("needs the given tables")
    extra = ("row", "whole_row", "masked_text", "masked", "q_hash", "text_key", "sim_id", "sim_key", "uid", "id", "own", "a b.c")
    docs = spark.read.parquet(f"{D}/documents.parquet").where("doc_id < 60").selectExpr("*", *[f"doc_id + {i} as `{c}`" for i, c in enumerate(extra)])
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, D)
        assert after.columns == docs.columns, name
        kept = after.collect()
        assert kept and all(r[c] == r["doc_id"] + i for r in kept for i, c in enumerate(extra)), name
        assert stage(spark, empty, D).collect() == [], name
        docs = spark.createDataFrame(kept, docs.schema)
    assert corpus_pipeline.STAGES[-1][1](spark, empty, D).collect() == []
