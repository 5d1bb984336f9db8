"""What a product with all passages costs, and the sums it is made of."""

import time

import numpy as np
import pyarrow as pa

from spillspark.llm import latent


def zipf_text(r, n):
    return " ".join(f"w{x % 20000}" for x in r.zipf(1.25, size=n))


def test_word_sums_match_plain_adding():
    r = np.random.default_rng(3)
    for texts in ([zipf_text(r, n) for n in (0, 1, 24, 25, 9000)], ["same " * 5000], [""]):
        raw = [t.encode() for t in texts]
        words, at = latent.words_of(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(t) for t in raw]))
        padded = latent.laid(latent.hashed(words), at)[0]
        back = r.standard_normal((len(padded) // latent.BLOCK + 1, 5)).astype(np.float32)
        held, sums = latent.word_sums(padded, back)
        want = np.zeros((latent.HASHED + 1, 5))
        np.add.at(want, padded, np.repeat(back[:-1], latent.BLOCK, axis=0))
        assert sorted(held.tolist()) == np.unique(padded[padded < latent.HASHED]).tolist()
        assert np.allclose(sums, want[held], rtol=1e-3, atol=1e-3)


def test_a_product_costs_little_more_than_reading_the_words():
    """About 4 times as much; sorting all words' rows and adding them up took 13 times as much."""
    r = np.random.default_rng(4)
    texts = [zipf_text(r, 1500) for _ in range(400)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(np.ones(len(texts)))], ["text", "weight"])
    raw = [t.encode() for t in texts]
    flat, at = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(t) for t in raw])
    product = latent.text_product(np.ones(latent.HASHED, np.float32))
    basis = r.standard_normal((latent.HASHED, latent.RANK + latent.EXTRA)).astype(np.float32)
    total = np.zeros(basis.shape)

    def least(run):
        spent = []
        for _ in range(3):
            t = time.thread_time()
            run()
            spent.append(time.thread_time() - t)
        return min(spent)

    assert least(lambda: product(batch, basis, total)) < 8 * least(lambda: latent.words_of(flat, at))


def test_kept_words_are_those_of_the_texts():
    batch = pa.RecordBatch.from_arrays([pa.array(["One two", None, "", "two \u00e9 " * 90000, "x"])], ["text"])
    kept = [part for k in latent.keep(iter([batch])) for part in latent.kept_words(k)]
    plain = list(latent.text_words(batch))
    assert np.array_equal(np.concatenate([w for w, _, _ in kept]), np.concatenate([w for w, _, _ in plain]))
    assert np.array_equal(np.concatenate([np.diff(at) for _, at, _ in kept]), np.concatenate([np.diff(at) for _, at, _ in plain]))


def test_items_word_for_word():
    a = np.arange(1, 9, dtype=np.uint64)
    assert latent.holds(a, a[2:5]) and latent.holds(a, a) and not latent.holds(a, a[[2, 4]]) and not latent.holds(a[:2], a[:3])
    # Bytes that begin inside a word don't count.
    near = np.array([1 << 56, 2 << 56 | 5], np.uint64)
    assert not latent.holds(near, np.frombuffer(near.tobytes()[1:9], np.uint64))
