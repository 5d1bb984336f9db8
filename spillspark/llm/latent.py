"""Benchmark decontamination by latent semantic retrieval.

1. Hashed words of all documents are written once, and their document frequencies
   counted over all documents.
2. A randomised SVD of TF-IDF passages gives a latent space: all passages of all
   documents, and all benchmark items. Spark holds the rows; each product with
   the matrix and its transpose is a job with partial sums per task, and only matrices of
   fixed size (hashed words by rank) reach the driver.
3. Candidate search: every passage of every document is projected and compared
   with the passages of every item; a cosine of ``COSINE`` or more makes the
   stretch around it a candidate.
4. What a cosine can't tell (an item of a few words in a longer passage, words
   that are everywhere, paraphrases that keep little) comes by an exact way: an
   item's ``PARAPHRASED`` share can only be kept in order if so many of its
   rarest words stand in one window, and an index of these finds every such
   window. So nothing that step 5 accepts is passed over, at any size.
5. Candidates that hold enough of the item's words are aligned with the whole
   item: the longest common subsequence within a window of the item's size, at
   every place, and, for paraphrases that keep less, the item's last sentence
   (the answer) as well.

``n_searched`` tells how many of the items found were candidates by cosine, which
measures the search of step 3 against the complete result.

The items are the query set, in blocks of about ``ITEM_BLOCK`` by hash: one scan
and one broadcast at a time for each, so a larger benchmark doesn't need more
memory.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DataType, StructField, StructType

from spillspark.llm.common import byte_column, slabs, spare, word_bounds, word_hashes, written

HASHED = 1 << 15
RANK, EXTRA, ROUNDS = 96, 16, 2
SAMPLE_DOCS = 2000
ITEM_WEIGHT = 10.0  # of an item's passages beside ``SAMPLE_DOCS`` documents; among more they keep that share
BLOCK = 24  # words; a passage is two blocks
LEAST_WEIGHT = 0.05  # of a word that is everywhere
RARE = 0.25  # of the words that an item must keep: so many have to be among its rare ones
ALIGNED, PARAPHRASED, ANSWERED = 0.75, 0.6, 0.9
COSINE = 0.5  # what the exact way of step 4 finds beyond it costs little; verbatim items have 0.77 and more
ITEM_BLOCK = 1024
KEPT_SLAB = 1 << 18  # bytes of kept words at a time
SCAN_SLAB = 1 << 22  # bytes of text that are searched for all items at a time
CHUNK = 512
FIT_PARTS = 16  # tasks of a product with all passages at least (or two a core), each of which sends one matrix

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[128:] = True
_WORD[48:58] = _WORD[97:123] = _WORD[65:91] = True


def words_of(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (A-Z lower-cased; ASCII letters, digits, non-ASCII), offsets."""
    start, end, words = word_bounds(_WORD[raw], at)
    return word_hashes(_LOWER[raw], start, end), words


def hashed(words: np.ndarray) -> np.ndarray:
    return (words & np.uint64(HASHED - 1)).astype(np.int32)


def text_words(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, pa.RecordBatch]]:
    """Hashed words, offsets and rows, slab by slab, of rows with a text."""
    for slab in slabs([batch]):
        words, at = words_of(*byte_column(slab.column("text")))
        yield hashed(words), at, slab


def kept_words(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, pa.RecordBatch]]:
    """The same of rows of ``keep``: two bytes a word."""
    for slab in slabs([batch], "w", KEPT_SLAB):
        raw, at = byte_column(slab.column("w"))
        yield raw.view("<u2").astype(np.int32), at // 2, slab


def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashed words of each text, which are read once and counted and multiplied often."""
    for batch in batches:
        for w, at, slab in text_words(batch):
            size = pa.py_buffer((2 * at).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(slab), [None, size, pa.py_buffer(w.astype("<u2"))]).cast(pa.binary())], ["w"])


def frequencies(kept: DataFrame) -> tuple[np.ndarray, int]:
    """Documents holding each hashed word, and all documents: counted in Spark over all rows of ``keep``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, docs = np.zeros(HASHED, np.int64), 0
        for batch in batches:
            for w, at, slab in kept_words(batch):
                key = np.sort(np.repeat(np.arange(len(at) - 1) * HASHED, np.diff(at)) + w)
                total += np.bincount(key[np.diff(key, prepend=-1) != 0] % HASHED, minlength=HASHED)
                docs += slab.num_rows
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[some, -1].astype(np.int32)), pa.array(np.r_[total[some], docs])], ["w", "n"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(HASHED + 1, np.int64)  # the last place, -1, is the number of documents
        for batch in batches:
            out[np.asarray(batch.column("w"))] = np.asarray(batch.column("n"))
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["m"])

    # A row per hashed word, whatever the number of documents: they are added in many tasks and reach the driver as one.
    counts = kept.mapInArrow(run, "w int, n bigint").groupBy("w").agg(F.sum("n").alias("n"))
    row = counts.repartition(1).mapInArrow(packed, "m binary").first()  # none if the table has no partitions
    out = np.frombuffer(row.m, np.int64) if row else np.zeros(HASHED + 1, np.int64)
    return out[:-1], int(out[-1])


def weights_of(counts: np.ndarray, docs: int) -> np.ndarray:
    """Inverse document frequency; words that are everywhere keep a small weight."""
    return np.maximum(np.log((docs + 1) / (counts + 1)), LEAST_WEIGHT).astype(np.float32)


def laid(w: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashed words ``w`` in blocks, filled up with ``HASHED``; of each passage its two blocks, document, place there.

    The block after the last one stands for none.
    """
    size = np.diff(at)
    blocks = -(-size // BLOCK)
    first = np.r_[0, np.cumsum(blocks)]
    padded = np.full(first[-1] * BLOCK, HASHED, np.int32)
    padded[np.arange(len(w)) + np.repeat(first[:-1] * BLOCK - at[:-1], size)] = w
    count = np.where(size > 0, np.maximum(blocks - 1, 1), 0)
    doc = np.repeat(np.arange(len(size)), count)
    inside = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    block = first[:-1][doc] + inside
    return padded, block, np.where(inside + 1 < blocks[doc], block + 1, first[-1]), doc, inside


def block_sums(padded: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sums of the words' ``rows`` in each block of ``laid``, and a row of zeros.

    First words of all blocks, second words, and so on, some blocks at a time:
    what is added stays in the cache.
    """
    sums = np.zeros((len(padded) // BLOCK + 1, rows.shape[1]), np.float32)
    cells = padded.reshape(-1, BLOCK).T.copy()
    more = np.empty((min(len(sums), 1024), rows.shape[1]), np.float32)
    for a in range(0, len(sums) - 1, 1024):
        b = min(a + 1024, len(sums) - 1)
        np.take(rows, cells[0, a:b], axis=0, out=sums[a:b], mode="clip")
        for k in range(1, BLOCK):
            sums[a:b] += np.take(rows, cells[k, a:b], axis=0, out=more[: b - a], mode="clip")
    return sums


def word_sums(padded: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words in the blocks of ``laid``, and for each the sum of its blocks' rows of ``back``, a block once for each time.

    Words in a fiftieth of the blocks or more: a product with their counts per block.
    Others: all words' first places, their second places, and so on.
    """
    size = np.bincount(padded, minlength=HASHED + 1)[:HASHED]
    held = np.argsort(-size, kind="stable")[: np.count_nonzero(size)]
    block = np.argsort(padded.astype(np.uint16), kind="stable") // BLOCK
    first, size = (np.cumsum(size) - size)[held], size[held]
    sums = np.empty((len(held), back.shape[1]), np.float32)
    often = int(np.count_nonzero(size >= max(32, len(back) // 50)))
    step = max(1, (1 << 19) // len(back))
    for a in range(0, often, step):
        b = min(a + step, often)
        cell = np.concatenate([block[first[k] : first[k] + size[k]] + (k - a) * len(back) for k in range(a, b)])
        np.dot(np.bincount(cell, minlength=(b - a) * len(back)).astype(np.float32).reshape(b - a, -1), back, out=sums[a:b])
    more = np.empty((min(len(held), 1024), back.shape[1]), np.float32)
    for a in range(often, len(held), 1024):
        b = min(a + 1024, len(held))
        np.take(back, block[first[a:b]], axis=0, out=sums[a:b], mode="clip")
        for k in range(1, int(size[a])):
            e = a + int(np.count_nonzero(size[a:b] > k))
            sums[a:e] += np.take(back, block[first[a:e] + k], axis=0, out=more[: e - a], mode="clip")
    return held, sums


def text_product(idf: np.ndarray, words=text_words):
    """Product of ``randomised_svd`` for rows (text, weight), or (w, weight) with ``kept_words``: the TF-IDF rows of all their passages, of unit length times the weight.

    A passage is two blocks, so a block's words are summed, and its share of the
    product handed back to them, once for both of its passages.
    """
    squares = np.r_[idf, 0].astype(np.float64) ** 2

    def product(batch: pa.RecordBatch, basis: np.ndarray, total: np.ndarray) -> None:
        rows, own_total = weighted(basis, idf), np.zeros(total.shape, np.float32)
        for w, at, slab in words(batch):
            padded, block, after, doc, _ = laid(w, at)
            if not len(block):
                continue
            cells = np.vstack([padded.reshape(-1, BLOCK), np.full((1, BLOCK), HASHED, np.int32)])
            own = np.sort(np.hstack([cells[block], cells[after]]), axis=1)
            new = np.ones(own.shape, bool)
            np.not_equal(own[:, 1:], own[:, :-1], out=new[:, 1:])
            own, new = own.ravel(), np.flatnonzero(new)
            tf = np.diff(np.r_[new, len(own)])
            norm = np.bincount(new // (2 * BLOCK), weights=tf * tf * squares[own[new]], minlength=len(block))
            weight = np.asarray(slab.column("weight"))[doc]
            scale = np.where(norm > 0, weight * weight / np.maximum(norm, 1e-30), 0).astype(np.float32)
            sums = block_sums(padded, rows)
            z = (sums[block] + sums[after]) * scale[:, None]
            back = np.zeros_like(sums)
            back[block] = z
            back[after] += z  # distinct but for the last row, which no word is in
            held, sums = word_sums(padded, back)
            own_total[held] += sums
        for a in range(0, HASHED, CHUNK):
            total[a : a + CHUNK] += own_total[a : a + CHUNK] * idf[a : a + CHUNK, None]

    return product


def _rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = np.asarray(batch.column("w").value_lengths())
    return np.repeat(np.arange(len(n)), n), np.asarray(batch.column("w").flatten()), np.asarray(batch.column("v").flatten())


def _project(batch: pa.RecordBatch, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    row, w, v = _rows(batch)
    out = np.zeros((batch.num_rows, basis.shape[1]), np.float32)
    some = np.unique(row)
    if len(row):
        out[some] = np.add.reduceat(basis[w] * v[:, None], np.searchsorted(row, some), axis=0)
    return out, row, w, v


def _summed(rows: DataFrame, part, chunks: int, shape: tuple[int, int]) -> np.ndarray:
    """Sum over tasks of the matrices that ``part`` makes of its batches.

    A task sends its partial sum in ``chunks`` pieces; Spark brings equal
    pieces together and adds them, and the driver receives one matrix.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, np.float64)
        for batch in batches:
            part(batch, total)
        pieces = [p.astype(np.float32).tobytes() for p in np.array_split(total, chunks)]
        yield pa.RecordBatch.from_arrays([pa.array(range(chunks), pa.int32()), pa.array(pieces, pa.binary())], ["c", "m"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, m in zip(batch.column("c").to_pylist(), batch.column("m").to_pylist(), strict=True):
                totals[c] = totals.get(c, 0) + np.frombuffer(m, np.float32).astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array([t.astype(np.float32).tobytes() for t in totals.values()], pa.binary())], ["c", "m"])

    out = np.zeros(shape, np.float32)
    at = np.cumsum([0] + [len(p) for p in np.array_split(out, chunks)])
    # Added in many tasks, then piece after piece: the driver holds the matrix once.
    pieces = rows.mapInArrow(run, "c int, m binary").repartition("c").mapInArrow(add, "c int, m binary").repartition(1)
    for r in pieces.toLocalIterator():
        out[at[r.c] : at[r.c + 1]] = np.frombuffer(r.m, np.float32).reshape(-1, shape[1])
    return out


def orthonormal(y: np.ndarray) -> np.ndarray:
    """The columns of ``y`` made orthonormal, in place: eigenvectors of their Gram matrix, twice.

    Directions that ``y`` doesn't have (fewer rows than columns) become zero.
    """
    for _ in range(2):
        gram = np.zeros((y.shape[1],) * 2)
        for a in range(0, len(y), CHUNK):
            part = y[a : a + CHUNK].astype(np.float64)
            gram += part.T @ part
        values, vectors = np.linalg.eigh(gram)
        some = values > 1e-10 * max(values[-1], 1e-30)
        turn = np.where(some, vectors / np.sqrt(np.where(some, values, 1)), 0)
        for a in range(0, len(y), CHUNK):
            y[a : a + CHUNK] = y[a : a + CHUNK] @ turn
    return y


def row_product(batch: pa.RecordBatch, basis: np.ndarray, total: np.ndarray) -> None:
    """Product of ``randomised_svd`` for sparse rows (w array, v array)."""
    for a in range(0, batch.num_rows, 256):
        y, row, w, v = _project(batch.slice(a, 256), basis)
        order = np.argsort(w, kind="stable")
        if len(order):
            first = np.flatnonzero(np.r_[True, np.diff(w[order]) != 0])
            total[w[order][first]] += np.add.reduceat(y[row[order]] * v[order][:, None], first, axis=0)


def randomised_svd(rows: DataFrame, rank: int = RANK, extra: int = EXTRA, rounds: int = ROUNDS, seed: int = 5, product=row_product) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors (hashed words by ``rank``) and singular values of ``rows``.

    Subspace iteration: the random block goes through the matrix and its transpose
    ``rounds`` times and is made orthonormal between, on the driver (fixed size).
    The last product and its block give the vectors (Nystroem's form), without another pass.
    ``product`` adds the product of a batch of ``rows``.
    """
    spark = rows.sparkSession
    basis = made = np.random.default_rng(seed).standard_normal((HASHED, rank + extra), dtype=np.float32)
    for k in range(rounds):
        basis = orthonormal(made) if k else made
        spare(spark)
        sent = spark.sparkContext.broadcast(basis)
        made = _summed(rows, lambda batch, total, sent=sent: product(batch, sent.value, total), HASHED // CHUNK, basis.shape)
        sent.destroy()
    small = np.zeros((basis.shape[1],) * 2)
    for a in range(0, len(basis), CHUNK):
        small += basis[a : a + CHUNK].T.astype(np.float64) @ made[a : a + CHUNK]
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    some = values > 1e-5 * max(values[-1], 1e-30)
    half = made @ np.where(some, vectors / np.sqrt(np.where(some, values, 1)), 0).astype(np.float32)
    gram = np.zeros_like(small)
    for a in range(0, len(half), CHUNK):
        part = half[a : a + CHUNK].astype(np.float64)
        gram += part.T @ part
    values, vectors = np.linalg.eigh(gram)
    top = np.argsort(-values)[:rank]
    values = np.maximum(values[top], 0)
    some = values > 1e-10 * max(values.max(initial=0), 1e-30)
    return half @ np.where(some, vectors[:, top] / np.sqrt(np.where(some, values, 1)), 0).astype(np.float32), np.sqrt(values)


@dataclass
class Items:
    """A block of benchmark items: ids, words, last sentences, latent vectors, index of rare words."""

    ids: list
    words: list[np.ndarray]
    answers: list[np.ndarray]
    latent: np.ndarray  # unit vectors
    passages: np.ndarray  # unit vectors of the items' passages
    owner: np.ndarray  # whose passages they are
    vocabulary: np.ndarray  # sorted words of all items
    held: list[np.ndarray]  # each item's distinct words as places in the vocabulary
    window: np.ndarray  # words of a window
    need: np.ndarray  # words that a window must share
    rare_need: np.ndarray  # and of the rare ones
    first: np.ndarray  # for each word of the vocabulary, where its items begin in ``rare``
    rare: np.ndarray  # items that have the word among their rare ones

    def places(self, words: np.ndarray) -> np.ndarray:
        """Places in the vocabulary; its length for other words."""
        out = np.full(len(words), len(self.vocabulary))
        some = np.zeros(HASHED, bool)
        some[hashed(self.vocabulary)] = True
        some = np.flatnonzero(some[hashed(words)])
        v = np.searchsorted(self.vocabulary, words[some])
        same = np.r_[self.vocabulary, np.uint64(0)][v] == words[some]
        out[some[same]] = v[same]
        return out


def least(share: float, size: int) -> int:
    """The smallest count that is ``share`` of ``size``."""
    return math.ceil(share * size - 1e-9)


def unit(w: np.ndarray, basis: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """The latent vector of hashed words, of unit length (or zero)."""
    z = idf[w] @ basis[w]
    return z / max(np.linalg.norm(z), 1e-6)


def weighted(basis: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """The latent vector of each hashed word with its weight, and a row of zeros."""
    return np.vstack([basis * idf[:, None], np.zeros((1, basis.shape[1]), np.float32)]).astype(np.float32)


def projected(w: np.ndarray, at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit latent vectors of all passages, their documents and first words.

    ``w``: hashed words of documents that lie at ``at``; ``rows``: see ``weighted``.
    """
    padded, block, after, doc, inside = laid(w, at)
    sums = block_sums(np.minimum(padded, len(rows) - 1), rows)
    z = sums[block] + sums[after]
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-6)
    return z, doc, at[:-1][doc] + inside * BLOCK


def prepared(ids: list, texts: list[str], basis: np.ndarray, idf: np.ndarray) -> Items:
    one = lambda t: words_of(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0]
    words = [one(t) for t in texts]
    ends = [[s for s in re.split(r"(?<=[.!?])\s+", t.strip()) if one(s).size] for t in texts]
    answers = [one(s[-1]) if s else w for s, w in zip(ends, words, strict=True)]
    latent = np.array([unit(hashed(w), basis, idf) for w in words], np.float32).reshape(-1, basis.shape[1])
    ends_at = np.r_[0, np.cumsum([len(w) for w in words])].astype(np.int64)
    used, own = np.unique(hashed(np.concatenate([*words, np.zeros(0, np.uint64)])), return_inverse=True)
    passed, owner, _ = projected(own.astype(np.int32), ends_at, weighted(basis[used], idf[used]))
    vocabulary = np.unique(np.concatenate([*words, np.zeros(0, np.uint64)]))
    held, need, rare_need, pairs = [], [], [], []
    for i, item in enumerate(words):
        v = np.searchsorted(vocabulary, item)
        n = least(PARAPHRASED, len(item))
        k = max(1, round(RARE * n))
        # Of any so many words of the item, k at least are among those kept: the rarest cost least.
        rare = v[np.argsort(-idf[hashed(item)], kind="stable")][: len(item) - n + k]
        held.append(np.unique(v))
        need.append(n)
        rare_need.append(k)
        pairs += [(w, i) for w in np.unique(rare).tolist()]
    index = np.array(sorted(pairs), np.int64).reshape(-1, 2)
    first = np.searchsorted(index[:, 0], np.arange(len(vocabulary) + 2))
    first[-1] = first[-2]  # words that no item has
    window = np.array([reach(len(w)) for w in words], np.int64)
    return Items(ids, words, answers, latent, passed, owner, vocabulary, held, window, np.array(need, np.int64), np.array(rare_need, np.int64), first, index[:, 1].copy())



def common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, bits of a number for a row."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b.tolist():
        if x in masks:  # others leave the row as it is
            m = row & masks[x]
            row = ((row + m) | (row - m)) & full
    return len(a) - row.bit_count()


def reach(size: int) -> int:
    """Words of a window in which an item of ``size`` words is looked for."""
    return size + max(2, size // 5)


def holds(near: np.ndarray, item: np.ndarray) -> bool:
    """Whether the words of ``item`` stand in ``near`` side by side."""
    raw, key = near.tobytes(), item.tobytes()
    at = raw.find(key)
    while at % item.itemsize and at > 0:
        at = raw.find(key, at + 1)
    return at >= 0


def aligned(item: np.ndarray, answer: np.ndarray, near: np.ndarray, hits: np.ndarray | None = None) -> float:
    """Best share of the item that a window of ``near`` keeps in order, 0 if too little.

    Windows are as long as the item and a fifth more, and begin at every word.
    From one to the next a common subsequence grows by one word at most, so
    windows that can't reach what is asked for are stepped over.
    """
    n = len(item)
    if not n:
        return 0.0
    if holds(near, item):
        return 1.0
    size, best = reach(n), 0
    kept, whole, ending = least(PARAPHRASED, n), least(ALIGNED, n), least(ANSWERED, len(answer))
    held = np.r_[0, np.cumsum(np.isin(near, item) if hits is None else hits)]
    start = np.arange(max(len(near) - size, 0) + 1)
    start = start[held[np.minimum(start + size, len(near))] - held[start] >= kept].tolist()
    s = 0
    for at in start:
        if at < s:
            continue
        own = near[at : at + size]
        c = common(item, own)
        if c < max(kept, best + 1):
            s = at + max(kept, best + 1) - c
            continue
        a = ending if c >= whole else common(answer, own)
        if a >= ending:
            best, s = c, at + 1
            if best == n:
                break
        else:
            s = at + min(whole - c, ending - a)
    return best / n


def sharing(words: np.ndarray, at: np.ndarray, v: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, item, begin, end): stretches with all windows that hold enough of an item's rare words."""
    count = (items.first[1:] - items.first[:-1])[v]
    place = np.repeat(np.arange(len(v)), count)
    i = items.rare[np.arange(len(place)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(items.first[v], count)]
    key = np.sort(i * len(v) + place)
    i, place = np.divmod(key, max(len(v), 1))
    doc = np.searchsorted(at, place, side="right") - 1
    last = np.arange(len(key)) + items.rare_need[i] - 1
    some = np.flatnonzero(last < len(key))
    last = last[some]
    some, last = (x[(i[some] == i[last]) & (doc[some] == doc[last]) & (place[last] - place[some] < items.window[i[some]])] for x in (some, last))
    i, doc, begin, end = i[some], doc[some], place[last] - items.window[i[some]] + 1, place[some] + items.window[i[some]]
    begin = np.maximum(np.minimum(begin, at[1:][doc] - items.window[i]), at[:-1][doc])
    end = np.minimum(end, at[1:][doc])
    # Stretches whose windows begin side by side are one.
    new = np.r_[True, (i[1:] != i[:-1]) | (doc[1:] != doc[:-1]) | (begin[1:] > place[some][:-1] + 1)][: len(i)]
    first = np.flatnonzero(new)
    return doc[first], i[first], begin[first], end[np.r_[first[1:], len(i)] - 1] if len(i) else end


def searched(w: np.ndarray, at: np.ndarray, items: Items, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, item, begin, end, cosine): stretches around the passages like one of an item's."""
    z, doc, start = projected(w, at, rows)
    out = []
    for a in range(0, len(z), 4096):
        cosine = z[a : a + 4096] @ items.passages.T
        p, q = np.nonzero(cosine >= COSINE)
        i, d = items.owner[q], doc[a + p]
        begin = np.maximum(start[a + p] - items.window[i], at[:-1][d])
        end = np.minimum(start[a + p] + 2 * BLOCK + items.window[i], at[1:][d])
        out.append((d, i, begin, end, cosine[p, q]))
    return tuple(np.concatenate([x[k] for x in out]) if out else np.zeros(0, (np.float64 if k == 4 else np.int64)) for k in range(5))


def merged(doc: np.ndarray, item: np.ndarray, begin: np.ndarray, end: np.ndarray, cosine: np.ndarray) -> tuple[np.ndarray, ...]:
    """Stretches of one document and item that meet made one, by item and document; the largest cosine counts."""
    if not len(doc):
        return doc, item, begin, end, cosine
    order = np.lexsort((begin, doc, item))
    doc, item, begin, end, cosine = (x[order] for x in (doc, item, begin, end, cosine))
    lane = np.cumsum(np.r_[0, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])]) * (int(end.max()) + 1)
    reached = np.maximum.accumulate(end + lane)
    first = np.flatnonzero(np.r_[True, begin[1:] + lane[1:] > reached[:-1]])
    return doc[first], item[first], begin[first], np.maximum.reduceat(end, first), np.maximum.reduceat(cosine, first)


def matches(words: np.ndarray, at: np.ndarray, items: Items, basis: np.ndarray, idf: np.ndarray, rows: np.ndarray | None = None, led: list[set] | None = None) -> list[dict]:
    """For each document of a slab: item number to aligned share.

    ``led`` gets the items that the cosine search led to; ``rows``: see ``weighted``.
    """
    found: list[dict] = [{} for _ in range(len(at) - 1)]
    v, w = items.places(words), hashed(words)
    doc, item, begin, end, cosine = searched(w, at, items, weighted(basis, idf) if rows is None else rows)
    exact = sharing(words, at, v, items)
    none = np.full(len(exact[0]), -1.0)  # not by cosine
    doc, item, begin, end, cosine = merged(*(np.r_[x, y] for x, y in zip((doc, item, begin, end, cosine), (*exact, none), strict=True)))
    mine = np.zeros(len(items.vocabulary) + 1, bool)
    some = []
    for own in np.split(np.arange(len(item)), np.flatnonzero(np.diff(item)) + 1):  # they come item by item
        if len(own):
            i = int(item[own[0]])
            mine[items.held[i]] = True
            some += own[enough(v, begin[own], end[own], mine, int(items.window[i]), int(items.need[i]))].tolist()
            mine[items.held[i]] = False
    for k in sorted(some, key=lambda k: -cosine[k]):
        d, i, a, b = int(doc[k]), int(item[k]), int(begin[k]), int(end[k])
        if found[d].get(i) != 1.0:
            mine[items.held[i]] = True
            share = aligned(items.words[i], items.answers[i], words[a:b], mine[v[a:b]])
            mine[items.held[i]] = False
            if share:
                found[d][i] = max(found[d].get(i, 0), share)
                if led is not None and cosine[k] >= COSINE:
                    led[d].add(i)
    return found


def enough(v: np.ndarray, begin: np.ndarray, end: np.ndarray, mine: np.ndarray, window: int, need: int) -> np.ndarray:
    """Whether a window of each stretch holds ``need`` of the words ``mine``."""
    out = np.zeros(len(begin), bool)
    order = np.argsort(end - begin, kind="stable")
    a = 0
    while a < len(order):
        # Stretches of like length make one block of about a million places.
        b = min(len(order), a + max(1, (1 << 20) // max(int((end - begin)[order[min(len(order) - 1, a + 1023)]]), 1)), a + 1024)
        rows = order[a:b]
        place = begin[rows, None] + np.arange(int((end - begin)[rows].max()))
        hits = mine[v[np.minimum(place, len(v) - 1)]] & (place < end[rows, None])
        held = np.cumsum(hits, axis=1, dtype=np.int32)
        held[:, window:] -= held[:, :-window].copy()
        out[rows] = held.max(axis=1, initial=0) >= need
        a = b
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, contaminated, n_items, item_ids, share, n_searched) for each row of ``docs`` (doc_id, text).

    ``id_col`` is what the result is told by: doc_id, or any other column, such
    as a struct of the whole row.

    ``item_ids`` is the ascending list of items found (any type of id),
    ``share`` the largest part of an item kept in order. Null and empty texts
    are clean, texts may be of any length; null, empty and wordless items are
    left out, and repeated items count once; rows that repeat an id are judged
    one by one; other columns, whatever their names, are ignored; an empty
    table, or an empty benchmark, finds nothing.
    """
    docs = docs.select("doc_id", F.col(id_col).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    kept = written(docs.select("text").mapInArrow(keep, "w binary"), "words")
    counts, total = frequencies(kept)
    idf = weights_of(counts, total)
    items = written(benchmark.select("item_id", "text").where("item_id is not null and text is not null").distinct(), "items")
    docs = docs.select("id", "text")
    # Among more documents items weigh more, so that the space doesn't lose sight of them.
    beside = ITEM_WEIGHT * math.sqrt(max(total / SAMPLE_DOCS, 1))
    rows = kept.select("w", F.lit(1.0).alias("weight")).unionByName(items.select("text").mapInArrow(keep, "w binary").select("w", F.lit(beside).alias("weight")))
    basis, _ = randomised_svd(rows.coalesce(max(FIT_PARTS, 2 * docs.sparkSession.sparkContext.defaultParallelism)), product=text_product(idf, kept_words))

    kind = items.schema["item_id"].dataType
    blocks = max(1, -(-items.count() // ITEM_BLOCK))
    held = (items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect() for b in range(blocks))
    made = (prepared([r.item_id for r in h], [r.text for r in h], basis, idf) for h in held)
    if blocks == 1:
        return _verdicts(id_col, _scan(docs, next(made), basis, idf, kind)[0])
    # Several scans: a row is told by its number in a written table of its own.
    numbered = written(docs.withColumn("uid", F.monotonically_increasing_id()), "documents")
    every = None
    for block in made:
        found, sent = _scan(numbered.select("uid", "text"), block, basis, idf, kind)
        part = written(found.where("size(item_ids) > 0"), "found")
        sent.destroy()
        every = part if every is None else every.unionByName(part)
    ids = F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids")
    merged_ = every.groupBy("uid").agg(ids, F.max("share").alias("share"), F.sum("n_searched").cast("int").alias("n_searched"))
    none = F.array().cast(found.schema["item_ids"].dataType)
    whole = numbered.select("uid", "id").join(merged_, "uid", "left")
    return _verdicts(id_col, whole.select("id", F.coalesce("item_ids", none).alias("item_ids"), F.coalesce("share", F.lit(0.0)).alias("share"), F.coalesce("n_searched", F.lit(0)).alias("n_searched")))


def _verdicts(id_col: str, found: DataFrame) -> DataFrame:
    n = F.size("item_ids").cast("bigint")
    return found.select(F.col("id").alias(id_col), (n > 0).alias("contaminated"), n.alias("n_items"), "item_ids", "share", F.col("n_searched").cast("bigint").alias("n_searched"))


def _scan(docs: DataFrame, items: Items, basis: np.ndarray, idf: np.ndarray, kind: DataType) -> tuple[DataFrame, Broadcast]:
    """Keys of ``docs`` with item_ids, share and n_searched for one block of items; what was sent for it."""
    sent = docs.sparkSession.sparkContext.broadcast((items, basis, idf))
    keys = [c for c in docs.columns if c != "text"]
    lists = pa.list_(to_arrow_type(kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, basis, idf = sent.value
        rows = weighted(basis, idf)
        for batch in slabs(batches, size=SCAN_SLAB):
            words, at = words_of(*byte_column(batch.column("text")))
            led: list[set] = [set() for _ in range(batch.num_rows)]
            found = matches(words, at, items, basis, idf, rows, led)
            ids = pa.array([sorted({items.ids[i] for i in f}) for f in found], lists)
            share = pa.array([round(max(f.values(), default=0.0), 6) for f in found], pa.float64())
            by = pa.array([len({items.ids[i] for i in f}) for f in led], pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), ids, share, by], [*keys, "item_ids", "share", "n_searched"])

    made = [StructField("item_ids", ArrayType(kind)), *StructType.fromDDL("share double, n_searched int").fields]
    return docs.mapInArrow(run, StructType([*(docs.schema[k] for k in keys), *made])), sent
