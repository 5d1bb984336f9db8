"""Repeated word windows: every window of 20 words hashed and counted.

Rabin-Karp hashes of all windows are computed over whole texts. Windows are
counted in Spark in bundles (runs, see ``runs``, told by the sum of their
windows' hashes): bundles equal as a whole at once, and the windows of
differing bundles with a common anchor one by one, by two 64-bit hashes. Of each
distinct window the first occurrence stays (smaller doc_id, then smaller row
number, then smaller place); repeats merge into maximal intervals and their
words go.

A window is told by 64 bits of anchor and 64 of hash in a bundle, or by 128 bits
on its own; word hashes mix eight bytes at a time from a secret start.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spillspark.llm import runs as R
from spillspark.llm.common import byte_column, mix, slabs, word_bounds, word_hashes, written

WINDOW, GRAM = 20, 4
_WORD = ~np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def word_spans(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the words' offsets per document."""
    return word_bounds(_WORD[raw], at)


def word_tokens(seed: int = 0) -> R.Tokens:
    def tokens(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start, end, words = word_spans(raw, at)
        return word_hashes(raw, start, end, seed), words

    return tokens


def _window_hashes(tokens: R.Tokens) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Two hashes of each window of the runs in ``own``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slabs(batches):
            words, offsets = tokens(*byte_column(batch.column("text")))
            doc, own = R.flat_own(batch)
            n = own["n"].astype(np.int64)
            which = np.repeat(np.arange(len(n)), n)
            place = own["start"][which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
            at = offsets[:-1][doc[which]] + place
            hashes = [R.every_hash(R.prefix_hash(t), WINDOW)[at] if len(at) else at for t in (words, mix(words ^ np.uint64(0xA5A5A5A5A5A5A5A5)))]
            row = pa.array(doc[which])
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(h.view(np.int64)) for h in hashes), batch.column("doc_id").take(row), batch.column("uid").take(row), pa.array(place.astype(np.int32))],
                ["w1", "w2", "doc_id", "uid", "place"],
            )

    return run


def _finish(raw: np.ndarray, at: np.ndarray, doc: np.ndarray, lo: np.ndarray, hi: np.ndarray):
    start, end, words = word_spans(raw, at)
    gone = R.cover(len(start), words[:-1][doc] + lo, words[:-1][doc] + hi)
    data = raw.tobytes()
    counts = np.r_[0, np.cumsum(gone)]
    digests = []
    start, end = start.tolist(), end.tolist()
    for d in range(len(at) - 1):
        a, b = words[d], words[d + 1]
        text = data[at[d] : at[d + 1]].split() if counts[a] == counts[b] else [data[start[i] : end[i]] for i in range(a, b) if not gone[i]]
        digests.append(hashlib.sha256(b" ".join(text)).hexdigest())
    return np.diff(words), counts[words[1:]] - counts[words[:-1]], digests


def removal_intervals(docs: DataFrame) -> DataFrame:
    """(uid, lo, hi): word intervals to remove, of ``runs.numbered`` documents."""
    tokens = word_tokens(secrets.randbits(63))
    found = R.repeated_runs(docs, tokens, WINDOW, GRAM, ("a", "s", "doc_id", "uid", "occ"))
    first = F.min(F.struct("doc_id", "uid", "occ")).alias("first")
    distinct = written(found.groupBy("a", "s").agg(first, F.count(F.lit(1)).alias("c")), "distinct")

    later = found.join(distinct.where("c > 1").select("a", "s", "first"), ["a", "s"]).where("uid <> first.uid or occ <> first.occ")
    start = R.place_of(F.col("occ"))
    whole = later.select("uid", start.alias("lo"), (start + R.length_of(F.col("occ")) - 1 + WINDOW).alias("hi"))

    various = written(distinct.groupBy("a").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("a"), "various")
    begin = R.place_of(F.col("first.occ")).alias("start")
    heads = distinct.join(various, "a").select("first.uid", begin, R.length_of(F.col("first.occ")).alias("n"))
    windows = R.with_texts(heads, docs, ("start", "n")).mapInArrow(_window_hashes(tokens), "w1 bigint, w2 bigint, doc_id bigint, uid bigint, place int")
    heads_first = windows.groupBy("w1", "w2").agg(F.min(F.struct("doc_id", "uid", "place")).alias("first"), F.count(F.lit(1)).alias("c"))
    known = written(heads_first.where("c > 1").select("w1", "w2", "first"), "windows")
    again = windows.join(known, ["w1", "w2"]).where("uid <> first.uid or place <> first.place")
    return whole.unionByName(again.select("uid", F.col("place").alias("lo"), (F.col("place") + WINDOW).alias("hi")))


def dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for each row of ``docs`` (doc_id, text).

    Ids are integers; a null id is smaller than any other; a null or empty text
    has no words. Rows that repeat an id, or have none, are documents of their
    own: of equal texts among them one counts as the first and stays. Texts may
    be of any length (a row's own intervals meet in one task); other columns,
    whatever their names, are ignored; an empty table gives an empty result.
    """
    rows = R.numbered(docs)
    return R.removed(rows, removal_intervals(rows), _finish, "n_words bigint, n_removed bigint, kept_sha256 string")
