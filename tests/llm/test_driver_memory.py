"""The driver hands memory back between the jobs of an operator, not only between stages."""

from spillspark.llm import common, quality


def test_a_heap_beyond_its_share_is_collected_between_jobs(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(common, "release", lambda s: seen.append(s))
    rows = [("a", *[(k * (j + 3)) % 97 for j in range(6)]) for k in range(80)]
    fit = spark.createDataFrame([(*r, False) for r in rows], "g string, " + ", ".join(f"{x} long" for x in quality.FEATURES) + ", base_failed boolean")
    monkeypatch.setattr(common, "HEAP_SHARE", 2.0)
    quality.estimates(fit)
    assert not seen
    monkeypatch.setattr(common, "HEAP_SHARE", 0.0)
    quality.estimates(fit)
    assert len(seen) > quality.FIRST_STEPS + 2  # starts, every step, what was chosen


def test_release_trims_memory_outside_the_heap(spark, monkeypatch):
    assert "Trim native heap" in common._trim(spark)
    seen = []
    monkeypatch.setattr(common, "_trim", lambda s: seen.append(s))
    common.release(spark)
    assert seen == [spark]
