"""Repeated fixed-length windows of documents: what both substring operators share.

A document is a row of tokens (bytes or words). Rabin-Karp hashes of every
window and of every short gram come from one running sum with powers of an odd
base modulo 2**64. Each window is named by its anchor, the smallest gram hash
inside it (leftmost on ties), so equal windows have equal anchors at equal
places. Consecutive windows with one anchor form a run, told by the sum of its
windows' mixed hashes, and runs are what is counted first: a window can only
repeat if its anchor does, and equal runs repeat as a whole. What travels is
one row per run, about a ninth (words) or an eightieth (bytes) of the number of
windows, and only runs whose anchor repeats travel further.

Rows of documents are numbered once, in a table written to the shared folder
and bucketed by that number, so joins with it shuffle only the other side, and
rows that repeat an id, or have none, stay apart. Positions are token numbers.
Tokens are made with a secret number per job: texts can't be built to collide.

Joins on an anchor or a run have two written or freshly shuffled sides, so
adaptive execution splits the partition of one that many rows share.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spillspark.llm.common import byte_column, mix, shared_dir, slabs, written

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
PIECE = 1 << 20  # windows worked on at a time
LOW = np.uint64((1 << 24) - 1)


_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse to the powers 0 to n - 1, from one growing table."""
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, b in enumerate((BASE, INVERSE)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _POWERS[i] = np.cumprod(p, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


def prefix_hash(tokens: np.ndarray) -> np.ndarray:
    """Running sums of token * BASE**i, one longer than ``tokens``."""
    out = np.zeros(len(tokens) + 1, np.uint64)
    np.cumsum(tokens * _powers(len(tokens))[0], out=out[1:], dtype=np.uint64)
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Position-free hash of tokens [start, end)."""
    return mix((prefix[end] - prefix[start]) * _powers(len(prefix))[1][start] ^ mix((end - start).astype(np.uint64)))


def every_hash(prefix: np.ndarray, size: int) -> np.ndarray:
    """Position-free hash of each ``size`` consecutive tokens."""
    return mix((prefix[size:] - prefix[:-size]) * _powers(len(prefix))[1][: len(prefix) - size])


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    """Minimum of each ``size`` consecutive values, by block minima from both ends."""
    n = len(x) - size + 1
    padded = np.full(-(-len(x) // size) * size, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, size)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[size - 1 : size - 1 + n])


def find_runs(tokens: np.ndarray, at: np.ndarray, window: int, gram: int) -> dict[str, np.ndarray]:
    """Runs of all windows of the documents whose tokens lie at ``at``.

    Arrays doc, start (token number in its document), n (windows), anchor, span
    (sum of the mixed hashes of the run's windows).
    """
    parts: dict[str, list] = {k: [] for k in ("doc", "start", "n", "anchor", "span")}
    size, docs = np.diff(at), np.arange(len(at) - 1)
    for low in range(0, max(len(tokens) - window + 1, 0), PIECE):
        own = tokens[low : low + PIECE + window - 1]
        prefix = prefix_hash(own)
        grams, windows = every_hash(prefix, gram), every_hash(prefix, window)
        place = np.arange(len(grams), dtype=np.uint64)
        arg = (sliding_min((grams & ~LOW) | place, window - gram + 1) & LOW).astype(np.int64)
        first = np.maximum(at[:-1], low)
        last = np.minimum(at[:-1] + size - window, low + len(arg) - 1)
        some = last >= first
        if not some.any():
            continue
        d, first, last = docs[some], first[some] - low, last[some] - low
        count = last - first + 1
        doc = np.repeat(d, count)
        i = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
        a = arg[i]
        new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (doc[1:] != doc[:-1])])
        n = np.diff(np.r_[new, len(i)])
        begin = i[new]
        parts["doc"].append(doc[new])
        parts["start"].append(begin + low - at[:-1][doc[new]])
        parts["n"].append(n)
        parts["anchor"].append(grams[a[new]])
        parts["span"].append(np.add.reduceat(windows[i], new))
    kinds = {"anchor": np.uint64, "span": np.uint64}
    return {k: np.concatenate(v) if v else np.zeros(0, kinds.get(k, np.int64)) for k, v in parts.items()}


Tokens = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def numbered(docs: DataFrame) -> DataFrame:
    """(uid, doc_id, text): each row's own number; null text as empty. Written, bucketed by uid."""
    spark = docs.sparkSession
    buckets = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 100_000)  # Spark's own bound on buckets
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    name = f"numbered_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark).rstrip('/')}/{name}"
    rows.repartition(buckets, "uid").write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets, "uid").saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name only: the files stay, and ``out`` reads them
    return out


def pack_np(start: np.ndarray, n: np.ndarray | int = 0) -> np.ndarray:
    """Place and length as one number, eight bits for the length."""
    return (start.astype(np.int64) << 8) | n


def place_of(occ: Column) -> Column:
    return F.shiftright(occ, 8).cast("int")


def length_of(occ: Column) -> Column:
    """Windows in the run (0 for a single window)."""
    return occ.bitwiseAND(F.lit(255)).cast("int")


def all_runs(docs: DataFrame, tokens: Tokens, window: int, gram: int, columns: tuple[str, ...]) -> DataFrame:
    """``columns``, of a, s, uid, doc_id and occ, for every run of every document of ``numbered``."""
    if window - gram + 1 > 255:
        raise ValueError("a run's length takes eight bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slabs(batches):
            found = find_runs(*tokens(*byte_column(batch.column("text"))), window, gram)
            made = {
                "a": lambda f=found: pa.array(f["anchor"].view(np.int64)),
                "s": lambda f=found: pa.array(f["span"].view(np.int64)),
                "uid": lambda f=found, b=batch: b.column("uid").take(pa.array(f["doc"])),
                "doc_id": lambda f=found, b=batch: b.column("doc_id").take(pa.array(f["doc"])),
                "occ": lambda f=found: pa.array(pack_np(f["start"], f["n"])),
            }
            yield pa.RecordBatch.from_arrays([made[c]() for c in columns], list(columns))

    return docs.mapInArrow(run, ", ".join(f"{c} bigint" for c in columns))


def repeated_runs(docs: DataFrame, tokens: Tokens, window: int, gram: int, columns: tuple[str, ...]) -> DataFrame:
    """The runs whose anchor occurs in two runs at least, written."""
    anchors = all_runs(docs, tokens, window, gram, ("a",)).groupBy("a").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("a")
    return written(all_runs(docs, tokens, window, gram, columns).join(written(anchors, "anchors"), "a", "left_semi"), "runs")


def with_texts(rows: DataFrame, docs: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Documents of ``numbered`` that have rows, with the list ``own`` of ``fields`` of these."""
    lists = rows.groupBy("uid").agg(F.collect_list(F.struct(*fields)).alias("own"))
    return docs.join(lists, "uid")


def flat_own(batch: pa.RecordBatch) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The lists in column ``own``: document of each entry, and its fields."""
    lists = batch.column("own")
    doc = np.repeat(np.arange(batch.num_rows), np.asarray(lists.value_lengths()))
    flat = lists.flatten()
    return doc, {flat.type[i].name: np.asarray(flat.field(i)) for i in range(flat.type.num_fields)}


def removed(docs: DataFrame, intervals: DataFrame, finish: Callable, schema: str) -> DataFrame:
    """``finish`` over each document of ``numbered`` and its intervals (uid, lo, hi), all rows kept.

    ``finish`` gets bytes, offsets, and the intervals as arrays (document, lo, hi).
    """
    lists = intervals.groupBy("uid").agg(F.collect_list(F.struct("lo", "hi")).alias("own"))
    joined = docs.join(lists, "uid", "left")
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slabs(batches):
            lists = batch.column("own")
            doc = np.repeat(np.arange(batch.num_rows), np.asarray(lists.value_lengths().fill_null(0)))
            flat = lists.flatten()
            arrays = finish(*byte_column(batch.column("text")), doc, np.asarray(flat.field(0)), np.asarray(flat.field(1)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, arrays)], ["doc_id", *names])

    return joined.select("doc_id", "text", "own").mapInArrow(run, "doc_id bigint, " + schema)


def cover(length: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Which of ``length`` positions the intervals [lo, hi) cover."""
    steps = np.zeros(length + 1, np.int64)
    np.add.at(steps, lo, 1)
    np.add.at(steps, hi, -1)
    return np.cumsum(steps[:-1]) > 0
