import random
import re

from spillspark.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute(text):
    w = WORD.findall(low(text))
    at = [(i, label) for p, label in licenses.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    base = {label for _, label in at}
    best, more = 0.0, set()
    for line in low(text).split("\n"):
        block = set(WORD.findall(line))
        for t, label in licenses.TEMPLATES:
            t = set(t.split())
            if len(t & block) >= licenses.THRESHOLD * len(t) - 1e-9:
                more.add(label)
                best = max(best, len(t & block) / len(t))
    first, last = (min(at)[0], max(at)[0]) if at else (None, None)
    return (len(w), len(at), first, last, ",".join(sorted(base)), ",".join(sorted(base | more)), 1.0 if base else best)


def made():
    r = random.Random(9)
    rows = [None, "", "MIT license mit LICENSE", "gnu\ngeneral-public_license", "Cc-By cc by", "wK mit licenİe", "É" * 100_000, "a" * 300_000 + " apache license"]
    voc = [w for t, _ in licenses.TEMPLATES for w in t.split()] + ["thaner", "ereß"] * 20
    for _ in range(250):
        lines = []
        for _ in range(r.randint(1, 6)):
            if r.random() < 0.4:
                w = r.choice(licenses.TEMPLATES)[0].split()
                w = [x for x in w if r.random() > 0.18] + [r.choice(voc) for _ in range(r.randint(0, 4))]
                r.shuffle(w)
            else:
                w = [r.choice(voc) for _ in range(r.randint(0, 30))]
            lines.append(r.choice([" ", ", ", "-"]).join(x.upper() if r.random() < 0.2 else x for x in w))
        rows.append("\n".join(lines))
    return list(enumerate(rows))


def test_against_brute_force(spark):
    rows = made()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as uid", "2 as label").repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in licenses.scan(df).collect()}
    for k, t in rows:
        assert got[k] == brute(t), (k, got[k], brute(t))


def test_empty_and_repeats(spark):
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    got = licenses.scan(spark.createDataFrame([(None, "mit license"), (1, "x"), (1, "x")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.base_labels) for r in got) == [(0, "mit"), (1, ""), (1, "")]
