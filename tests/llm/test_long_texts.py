"""Very long texts through op3 and op9."""

import random

from pyspark.sql import functions as F

from spillspark.llm import chat, pii


def test_personal_data_in_a_very_long_text(spark):
    r = random.Random(3)
    words = ["word%d" % r.randrange(1000) for _ in range(300_000)]
    places = r.sample(range(len(words)), 200)
    for k in places:
        words[k] = f"name{k}@mail.example.org"
    text = " ".join(words)
    assert len(text) > 2_000_000
    rows = [(1, text), (1, text), (2, "x" * 1_000_000 + " a@b.cd")]
    got = pii.detect(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()
    assert [x.n_email for x in got] == [200, 200, 1] and got[0].base_sha256 == got[1].base_sha256
    at = text.index("@mail")
    assert f"email:{text.rindex(' ', 0, at) + 1 if ' ' in text[:at] else 0}:{text.index(' ', at)}" in got[0].spans


def test_a_very_long_turn(spark):
    long = "a<|im_end|>b\n" * 80_000
    rows = [(7, 0, "user", "hi"), (7, 1, "assistant", long), (7, 1, "assistant", long)]
    made = chat.formatted(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).first()
    assert "".join(s.text for s in made.segments) == made.formatted and len(made.formatted) > 2 * len(long)
    told = chat.digests(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("formatted", F.lit(1))).first()
    assert told.n_turns == 3 and told.loss_chars == 2 * len(long)
