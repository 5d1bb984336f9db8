"""op5 on notices that are broken over lines."""

import random
import time

from spillspark.llm import licenses, queries
from tests.llm.test_licenses import WORD, brute, low, made

BSD = "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that\n"
MPL = "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. */\n"
GPL = "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General\nPublic License"


def runs(text):
    """The line rule, and every run of a template's length, one by one."""
    n_words, n_base, first, last, base, labels, score = brute(text)
    w, more, best = WORD.findall(low(text)), set(filter(None, labels.split(","))), score
    for t, label in licenses.TEMPLATES:
        own, size = set(t.split()), len(t.split())
        for s in range(max(len(w) - size, 0) + 1):
            held = len(own & set(w[s : s + size])) / len(own)
            if held >= licenses.THRESHOLD - 1e-9:
                more.add(label)
                best = max(best, held)
    return (n_words, n_base, first, last, base, ",".join(sorted(more)), 1.0 if base else best)


def test_wrapped_against_brute_force(spark):
    r = random.Random(2)
    rows = made() + [(1000, BSD), (1001, MPL), (1002, GPL), (1003, "a\n" + BSD * 2 + MPL)]
    for k in range(100):
        w = [x for t, _ in r.sample(licenses.TEMPLATES, 2) for x in t.split() if r.random() > 0.1]
        rows.append((2000 + k, "".join(x + r.choice([" ", " ", " ", "\n", "\n * "]) for x in w)))
    got = {x.doc_id: tuple(x)[1:] for x in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), wrapped=True).collect()}
    for k, t in rows:
        assert got[k] == runs(t), (k, got[k], runs(t))


def test_query_finds_wrapped_notices(spark, tmp_path):
    spark.createDataFrame([(1, BSD), (2, MPL), (3, "plain\ntext")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: x.labels for x in queries.op5_license_scan(spark, str(tmp_path)).collect()}
    assert got == {1: "bsd", 2: "mpl", 3: ""}


def test_very_long_texts(spark):
    """Two million letters, a third of the words from templates, twelve words a line."""
    r = random.Random(6)
    common = sorted({w for t, _ in licenses.TEMPLATES for w in t.split()})

    def text(n):
        return "".join((r.choice(common) if r.random() < 0.3 else "word%d" % r.randrange(999)) + ("\n" if i % 12 == 11 else " ") for i in range(n))

    small, large = text(4_000), text(280_000)
    rows = [(1, small), (2, large + MPL + text(20_000)), (3, "x" * 2_000_000), (4, ("the license of\n" * 60_000))]
    assert len(rows[1][1]) > 2_000_000
    began = time.time()
    got = {x.doc_id: tuple(x)[1:] for x in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), wrapped=True).collect()}
    took = time.time() - began
    assert got[1] == runs(small) and "mpl" in got[2][5].split(",") and got[3][0] == 1 and got[4][5] == ""
    assert took < 120  # it took hours before
