"""Rounds and tasks of the connected components."""

import random

import pytest

from spillspark.llm import components as graph


def brute(links):
    of = {x: x for ab in links for x in ab}

    def root(x):
        while of[x] != x:
            x = of[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        of[b] = a
    return {x: root(x) for x in of}


@pytest.fixture
def written(monkeypatch):
    out, plain = [], graph.written
    monkeypatch.setattr(graph, "written", lambda df, name: out.append(df.rdd.getNumPartitions()) or plain(df, name))
    return out


def test_stars_take_no_round(spark, written):
    links = [(k, 0) for k in range(1, 50)] + [(100 + k, 60) for k in range(9)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == brute(links)
    assert len(written) == 1


def test_tasks_follow_the_edges_not_the_shuffle(spark, written):
    rng = random.Random(3)
    links = [(k, k + 1) for k in range(40)] + [(rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(200)] + [(500, 500)]
    names = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == brute([x for x in links if x[0] != x[1]])
    assert len(written) > 1 and max(written[1:]) <= graph.LEAST_PARTS


def test_no_links(spark):
    assert not graph.components(spark.createDataFrame([(1, 1)], "a long, b long")).collect()
