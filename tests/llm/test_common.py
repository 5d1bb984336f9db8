import random
import re

import numpy as np
import pyarrow as pa

from spillspark.llm import common, substrings
from spillspark.llm.components import components


def test_word_bounds():
    r = random.Random(7)
    for _ in range(100):
        docs = ["".join(r.choice("ab é\n\t\x0b") for _ in range(r.randint(0, 12))).encode() for _ in range(r.randint(1, 6))]
        raw, at = np.frombuffer(b"".join(docs), np.uint8), np.r_[0, np.cumsum([len(d) for d in docs])]
        start, end, words = substrings.word_spans(raw, at)
        for i, d in enumerate(docs):
            own = [raw.tobytes()[a:b] for a, b in zip(start[words[i] : words[i + 1]], end[words[i] : words[i + 1]], strict=True)]
            assert own == re.findall(rb"[^\x20\x09-\x0D]+", d)


def test_slabs_keep_rows_whole():
    texts = ["a" * n for n in (0, 5, 50, 3, 3, 100, 0)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    parts = list(common.slabs([batch, batch.slice(0, 0)], size=10))
    assert [t for p in parts for t in p.column("text").to_pylist()] == texts
    assert all(p.num_rows == 1 or sum(len(t or "") for t in p.column("text").to_pylist()) <= 10 for p in parts)
    raw, at = common.byte_column(batch.slice(1, 4).column("text"))
    assert len(raw) == 61 and at.tolist() == [0, 5, 55, 58, 61]


def test_components(spark):
    r = random.Random(2)
    pairs = [(r.randint(0, 60), r.randint(0, 60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)] + [(200, 200 + i) for i in range(1, 20)]
    got = {x.node: x.component for x in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a != b:
            x, y = sorted((root(a), root(b)))
            up[y] = x
    assert got == {x: root(x) for x in up}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
