import random

import xxhash

from spillspark.llm import simhash


def brute(rows):
    fps = {}
    for k, t in rows:
        w = (t or "").encode().lower().split()
        sh = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 3 else ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(s, seed=42) for s in sh]
        fps[k] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    comp = {k: k for k in fps}
    moved = True
    while moved:
        moved = False
        for a in fps:
            for b in fps:
                if (fps[a] ^ fps[b]).bit_count() <= 3 and comp[b] < comp[a]:
                    comp[a] = comp[b]
                    moved = True
    return {k: (f"{fps[k]:016x}", comp[k]) for k in fps}


def made(n=120):
    r = random.Random(5)
    voc = [a + b for a in "tha era ouí nde ßch".split() for b in "re on st en ly".split()]
    rows = [(0, ""), (1, None), (2, "one"), (3, "ONE"), (4, "one\ttwo"), (5, " \n"), (6, "a b c"), (7, "É b c d"), (8, "é b c d")]
    base = [r.choice(voc) for _ in range(90)]
    for k in range(9, n):
        w = list(base) if k % 3 else [r.choice(voc) for _ in range(r.randint(1, 60))]
        if k % 3 == 1:
            w[r.randrange(len(w))] = "x%d" % k
        rows.append((k, " ".join(w)))
    return rows


def test_against_brute_force(spark):
    rows = made()
    got = {r[0]: (r[1], r[2]) for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_hot_buckets_are_split(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 4)
    rows = made(80)
    got = {r[0]: (r[1], r[2]) for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_links_are_exact(spark):
    r = random.Random(3)
    seeds = [r.getrandbits(64) for _ in range(20)]
    fps = {s for x in seeds for s in [x] + [x ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 5))) for _ in range(8)]}
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    found = simhash.links(spark.createDataFrame(signed, "fp long")).collect()
    assert all(((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3 for a, b in found)
    near = {(a, b) for (a,) in signed for (b,) in signed if a < b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3}

    def classes(pairs):
        up = {}

        def root(x):
            while up.setdefault(x, x) != x:
                x = up[x]
            return x

        for a, b in pairs:
            up[root(a)] = root(b)
        out = {}
        for x in up:
            out.setdefault(root(x), set()).add(x)
        return sorted(map(sorted, out.values()))

    assert classes(near) == classes(found)


def test_edges_of_input(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, fp string, component_id int, id long")
    assert simhash.near_duplicates(empty).collect() == []
    twice = spark.createDataFrame([(None, "a b c d"), (1, "a b c d"), (1, "a b c d"), (2, None)], "doc_id long, text string")
    got = simhash.near_duplicates(twice).collect()
    assert sorted(r.component_id for r in got) == [1, 1, 1, 2]


def test_long_texts_in_pieces(monkeypatch):
    r = random.Random(5)
    texts = [" ".join(r.choice("ab Cd é x1 longerword".split()) for _ in range(n)).encode() for n in (0, 1, 2, 3, 50, 700)] + [b"  \t a \n b  ", b"x" * 5000 + b" y z w"]
    want = {w: [simhash.fingerprint(t, w) for t in texts] for w in (1, 3, 5)}
    monkeypatch.setattr(simhash, "PIECE", 7)
    assert want == {w: [simhash.fingerprint(t, w) for t in texts] for w in (1, 3, 5)}


def test_one_of_each_keeps_columns_of_any_name(spark):
    rows = [(2, "a b c d", 5, "k", 1.5), (1, "a b c d", 6, "l", 2.5), (3, None, 7, None, None), (None, "other words here now", 8, "m", 0.5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, sim_id int, sim_key string, row double")
    got = simhash.one_of_each(df)
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((rows[1], rows[2], rows[3]), key=repr)


def test_one_of_each_takes_text_ids(spark):
    rows = [("b", "a b c d"), ("a", "a b c d"), ("a", "a b c d"), (None, "a b c d e"), ("c", None), ("c", ""), (None, "other words here now")]
    got = simhash.one_of_each(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([("a", "a b c d"), (None, "a b c d e"), ("c", None), (None, "other words here now")], key=repr) or len(got) == 4
