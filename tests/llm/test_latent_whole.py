"""op7 against aligning every item with every window of every document."""

import random

import numpy as np
import pytest

from spillspark.llm import latent


def one(t):
    return latent.words_of(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0]


def vocabulary(r, n=3000):
    return ["".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(3, 9))) for _ in range(n)]


def found(spark, docs, items):
    rows = latent.decontaminate(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string")).collect()
    return {x.doc_id: set(x.item_ids) for x in rows}


def brute(item, ending, text):
    """Plain dynamic program at every window: what the rules say, without bounds or steps."""
    item, ending, words = one(item).tolist(), one(ending).tolist(), one(text).tolist()
    size = latent.reach(len(item))

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b):
                last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
        return row[-1]

    best = 0.0
    for s in range(max(len(words) - size, 0) + 1):
        own = words[s : s + size]
        share = lcs(item, own) / len(item)
        if share >= latent.ALIGNED or share >= latent.PARAPHRASED and lcs(ending, own) >= latent.ANSWERED * len(ending):
            best = max(best, share)
    return best


def test_paraphrases_that_need_the_answer_rule(spark):
    r = random.Random(4)
    voc = vocabulary(r)
    often = voc[:40]
    text = lambda n: [r.choice(often) if r.random() < 0.5 else r.choice(voc) for _ in range(n)]
    items = [(i, text(r.randint(20, 45)), text(r.randint(4, 7))) for i in range(20)]
    docs, want = [], {}
    for k in range(latent.SAMPLE_DOCS + 500):
        w = text(r.randint(20, 60))
        if k % 10 == 0:
            i, body, ending = items[k // 10 % 20]
            n = len(body) + len(ending)
            keep = set(r.sample(range(len(body)), -(-62 * n // 100) - len(ending)))
            own = [x if j in keep else r.choice(voc) for j, x in enumerate(body)] + ending
            at = r.randrange(len(w))
            w[at:at] = own
            want[k] = {i}
        docs.append((k, " ".join(w)))
    got = found(spark, docs, [(i, " ".join(a) + ". " + " ".join(b) + ".") for i, a, b in items])
    assert {k: v for k, v in got.items() if v} == want


def test_every_window_like_a_plain_dynamic_program():
    r = random.Random(8)
    basis, idf = np.ones((latent.HASHED, 4), np.float32), np.ones(latent.HASHED, np.float32)
    voc = vocabulary(r, 40)
    for _ in range(60):
        text = lambda n: [r.choice(voc) for _ in range(n)]
        body, ending = text(r.randint(1, 16)), text(r.randint(1, 5))
        flat = body + ending
        w = text(r.randint(0, 30)) + [x for x in flat if r.random() < 0.8] + text(r.randint(0, 30))
        items = latent.prepared([7], [" ".join(body) + ". " + " ".join(ending)], basis, idf)
        raw = " ".join(w)
        got = latent.matches(one(raw), np.array([0, len(w)]), items, basis, idf)[0].get(0, 0.0)
        assert abs(got - brute(" ".join(flat), " ".join(ending), raw)) < 1e-9


def test_copies_that_hold_many_rows(spark):
    r = random.Random(5)
    voc = vocabulary(r)
    item = [r.choice(voc) for _ in range(30)]
    docs = []
    for k in range(300):
        w = [r.choice(voc) for _ in range(40)]
        docs.append((k, " ".join(w[:20] + item + w[20:] if k % 3 else w)))
    got = found(spark, docs, [(1, " ".join(item) + ".")])
    assert got == {k: {1} if k % 3 else set() for k in range(300)}


def test_tables_of_one_document(spark):
    assert found(spark, [(1, "x y a b c d e f")], [(1, "a b c d e f")]) == {1: {1}}


def test_long_items(spark):
    r = random.Random(6)
    voc = vocabulary(r)
    items = [(i, [r.choice(voc) for _ in range(n)]) for i, n in enumerate((220, 495, 777, 1200))]
    docs, want = [], {}
    for k in range(80):
        w = [r.choice(voc) for _ in range(150)]
        if k % 2:
            i, own = items[k // 2 % 4]
            at = r.randrange(len(w))
            w[at:at] = own
            want[k] = {i}
        docs.append((k, " ".join(w)))
    got = found(spark, docs, [(i, " ".join(w) + ".") for i, w in items])
    assert {k: v for k, v in got.items() if v} == want


@pytest.mark.parametrize("share", [4, 9])
def test_items_in_most_of_ten_documents(spark, share):
    r = random.Random(share)
    voc = vocabulary(r, 300)
    item = [r.choice(voc) for _ in range(30)]
    text = lambda: [r.choice(voc) for _ in range(100)]
    docs = [(k, " ".join(text() + (item if k < share else []) + text())) for k in range(10)]
    assert found(spark, docs, [(1, " ".join(item) + ".")]) == {k: {1} if k < share else set() for k in range(10)}


def test_the_search_alone_finds_what_is_found(spark):
    """Recall of the cosine search against the complete result: verbatim items and three quarters kept."""
    r = random.Random(11)
    voc = vocabulary(r)
    items = [(i, [r.choice(voc) for _ in range(r.randint(12, 60))]) for i in range(40)]
    docs = []
    for k in range(400):
        w = [r.choice(voc) for _ in range(r.randint(0, 200))]
        own = items[k % 40][1]
        if k % 2:
            keep = set(r.sample(range(len(own)), -(-78 * len(own) // 100)))
            own = [x if j in keep else r.choice(voc) for j, x in enumerate(own)]
        at = r.randint(0, len(w))
        docs.append((k, " ".join(w[:at] + own + w[at:])))
    rows = latent.decontaminate(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame([(i, " ".join(w) + ".") for i, w in items], "item_id long, text string")).collect()
    assert all(k % 40 in x.item_ids for k, x in ((x.doc_id, x) for x in rows))
    assert sum(x.n_searched for x in rows) >= 0.95 * sum(x.n_items for x in rows)


def test_ids_of_any_type_and_repeated_items(spark, monkeypatch):
    for block in (1024, 3):
        monkeypatch.setattr(latent, "ITEM_BLOCK", block)
        items = [(f"i{k}", " ".join(f"w{k}x{j}" for j in range(12))) for k in range(9)]
        docs = [(1, "start " + items[3][1] + " end " + items[5][1]), (1, "start " + items[3][1]), (2, None), (None, items[0][1])]
        rows = latent.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items + items[:4], "item_id string, text string")).collect()
        assert sorted((x.doc_id or 0, x.item_ids) for x in rows) == [(0, ["i0"]), (1, ["i3"]), (1, ["i3", "i5"]), (2, [])]


def test_words_made_to_collide(spark):
    one = "".join("ab"[i.bit_count() % 2] for i in range(1024))
    words = latent.words_of(np.frombuffer(f"{one} {one.translate(str.maketrans('ab', 'ba'))} {one.upper()}".encode(), np.uint8), np.array([0, 3 * 1024 + 2]))[0]
    assert words[0] != words[1] and words[0] == words[2]
