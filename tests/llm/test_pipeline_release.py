"""Between stages the driver lets go of what the last one left."""

import corpus_pipeline


def test_driver_collects_after_every_stage(spark, monkeypatch, tmp_path):
    seen = []
    spark.createDataFrame([(1, "a b")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(corpus_pipeline, "release", lambda s: seen.append("release"), raising=False)
    stage = lambda n: (n, lambda s, docs, d: seen.append(n) or docs)
    monkeypatch.setattr(corpus_pipeline, "STAGES", [stage("one"), stage("two")])
    assert corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert seen == ["one", "release", "two", "release"]


def test_stages_hand_few_rows_to_python_at_a_time(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    try:
        corpus_pipeline.pack_sequences(spark, docs, "")
        assert spark.conf.get(corpus_pipeline.BATCH) == "2000"
        spark.conf.set(corpus_pipeline.BATCH, "77")  # the user's own stays
        corpus_pipeline.pack_sequences(spark, docs, "")
        assert spark.conf.get(corpus_pipeline.BATCH) == "77"
    finally:
        spark.conf.unset(corpus_pipeline.BATCH)
