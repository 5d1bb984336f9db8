import random
import sys
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from spillspark.llm import packing


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(packing.vocabulary_path())
    return lambda s: t.encode(s, add_special_tokens=False).ids


def made():
    r = random.Random(2)
    odd = ["", None, "É café don't 12.5", "a<|endoftext|>b <|startoftext|>", "ΑΣ İx  y\x1cz", "x" * 9000, "!!! ?? it's we'LL ½3²"]
    return [(i, t) for i, t in enumerate(odd)] + [(i, " ".join(r.choice(["the", "Oion,", "ßtun", "pré", "x9-z"]) for _ in range(r.randint(1, 900)))) for i in range(len(odd), 60)]


def test_ids_are_the_tokenizers(plain):
    e = packing.Encoder(packing.vocabulary_path())
    texts = [t or "" for _, t in made()]
    for t, ids in zip(texts, e.encode([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(ids, np.uint16).tolist() == plain(t)


def test_round_trip(spark, plain):
    rows = made()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as key", "2 as n", "3 as ids").repartition(5)
    for length in (64, 2048):
        got = packing.pack(df, length=length, with_ids=True).collect()
        want = {k: [*plain(t or ""), 1] for k, t in rows}
        stream = {}
        for p in got:
            ids = np.frombuffer(p.ids, np.uint16)
            assert ids.tolist() == want[p.doc_id][p.start : p.start + p.length] and p.doc_tokens == len(want[p.doc_id])
            assert p.ids_crc32 == zlib.crc32(ids.astype("<u4").tobytes())
            for j in range(p.length):
                assert (place := (p.sequence_id, p.offset + j)) not in stream and p.offset + j < length
                stream[place] = True
        total = sum(map(len, want.values()))
        assert sorted(stream) == [(i // length, i % length) for i in range(total)]


def test_hilbert_is_a_curve():
    side = 8
    grid = np.stack(np.meshgrid(*[np.arange(side)] * 3, indexing="ij"), -1).reshape(-1, 3)
    keys = packing.hilbert(grid, bits=3)
    assert sorted(keys.tolist()) == list(range(side**3))
    walk = grid[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_edges_of_input(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    got = packing.pack(spark.createDataFrame([(1, "the"), (1, "the"), (None, None)], "doc_id long, text string")).collect()
    assert sorted((p.doc_id or 0, p.length) for p in got) == [(0, 1), (1, 2), (1, 2)]


def test_a_very_long_text(spark, plain):
    r = random.Random(7)
    text = " ".join(r.choice(["the", "Oion,", "ßtun", "pré", "x9-z"]) + str(r.randint(0, 999)) for _ in range(120_000))
    rows = packing.pack(spark.createDataFrame([(1, text), (2, "short one"), (1, None)], "doc_id long, text string")).collect()
    want = plain(text) + [1]
    own = sorted((x for x in rows if x.doc_tokens == len(want)), key=lambda x: x.start)
    assert [x.start for x in own] == np.cumsum([0] + [x.length for x in own])[:-1].tolist() and sum(x.length for x in own) == len(want)
    assert all(x.ids_crc32 == zlib.crc32(np.array(want[x.start : x.start + x.length], "<u4").tobytes()) for x in own)


def test_the_encoder_holds_little():
    """Workers that wait keep what they hold: 120 MB of words were too much for an executor's packing."""
    r = random.Random(9)
    e = packing.Encoder(packing.vocabulary_path())
    for _ in range(80):
        e.encode([" ".join("".join(r.choice("abcdefgh") for _ in range(14)) for _ in range(5000)).encode()])
    held = sum(sys.getsizeof(d) + sum(sys.getsizeof(k) + sys.getsizeof(v) for k, v in d.items()) for d in (e.words, e.known))
    assert held < 80e6
