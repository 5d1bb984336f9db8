"""SimHash near-duplicates by deletion-variant signatures.

Words are split at ASCII white space after A-Z are lower-cased; a document's
fingerprint has a bit set where over half of its shingles' XXH64 values (seed
42) have it set. Documents link at ``distance`` or fewer differing bits.

Candidate search: a 64-bit fingerprint is cut into two halves. Of three
differing bits one half gets one at most, so two linked fingerprints share a
half exactly or up to one bit. Each half is indexed whole and in the 32
variants with one bit deleted, and fingerprints are joined by equality. A variant's
bucket is split by the deleted bit, so it only meets pairs that differ there
and no pair is found under many variants.

Equal fingerprints are one class before anything is joined, so copies cost
nothing. Buckets are blocks of at most ``BLOCK`` fingerprints: a larger bucket
is dealt as pairs of blocks over many tasks, exactly. A task compares its two
blocks with numpy and emits only a spanning set of links (each fingerprint's
first partner, then unions of what is still apart), never all pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spillspark.llm.common import byte_column, slabs, whole_row, written
from spillspark.llm.components import components

BLOCK = 2048
PIECE = 1 << 20  # bytes of a text at a time
_SPACE = re.compile(rb"[ \t-\r]")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, fp long) for each row; no words (or null): zero. Whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slabs(batches):
            raw, at = byte_column(batch.column("text"))
            data = raw.tobytes()
            fps = [fingerprint(data[a:b], words) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.array(fps, np.uint64).view(np.int64))], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp bigint")
    return out.select(F.col("id").alias(id_col), "fp")


def fingerprint(text: bytes, words: int = 3) -> int:
    """The fingerprint of one UTF-8 text, read in pieces that end at white space."""
    total, n, at = np.zeros(64, np.int64), 0, 0
    parts: list[bytes] = []
    digest = xxhash.xxh64_digest
    while at < len(text):
        space = _SPACE.search(text, at + PIECE)
        end = space.start() if space else len(text)
        parts += text[at:end].lower().split()  # bytes: only A-Z change, only ASCII space splits
        at = end
        if len(parts) < words:
            continue
        flat = b" ".join(parts)
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        stop = np.cumsum(size + 1) - 1
        first = (stop - size)[: len(parts) - words + 1].tolist()
        hashes = b"".join([digest(flat[a:b], 42) for a, b in zip(first, stop[words - 1 :].tolist(), strict=True)])
        total += ones(np.frombuffer(hashes, np.uint8).reshape(-1, 8))
        n += len(first)
        parts = parts[len(parts) - words + 1 :]  # the last words begin the next piece's shingles
    if not n and parts:
        total, n = ones(np.frombuffer(digest(b" ".join(parts), 42), np.uint8).reshape(-1, 8)), 1
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big") if n else 0


def ones(rows: np.ndarray) -> np.ndarray:
    """How many of the big-endian 8-byte rows have each bit set."""
    total = np.zeros(64, np.int64)
    for a in range(0, len(rows), 4096):
        total += np.unpackbits(rows[a : a + 4096], axis=1).sum(axis=0, dtype=np.int64)
    return total


def links(fps: DataFrame, distance: int = 3) -> DataFrame:
    """Spanning links (a, b) among the distinct fingerprints in column ``fp``.

    Two fingerprints within ``distance`` (0 to 3) are always connected through
    the result; no link joins fingerprints further apart.
    """
    if not 0 <= distance <= 3:
        raise ValueError("two halves with one deleted bit reach three differing bits")
    # A fingerprint makes 66 rows: dealt evenly, however few bytes they are before.
    tasks = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    one = fps.select("fp").where("fp is not null").distinct().repartition(tasks)
    variants = one.mapInArrow(_variants, "bucket bigint, fp bigint")
    sizes = variants.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK)
    hot = written(sizes, "hot")
    usual = variants.join(hot.select("bucket"), "bucket", "left_anti").select("bucket", F.lit(0).alias("part"), "fp")
    # A hot bucket of k blocks becomes k*k/2 parts, each with two blocks.
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("fp", F.lit(7)), blocks).cast("int")
    split = (
        variants.join(hot, "bucket")
        .withColumn("k", blocks)
        .withColumn("i", mine)
        .select(
            "bucket",
            F.explode(
                F.transform(
                    F.sequence(F.lit(0), F.col("k") - 1),
                    lambda j: F.least(j, F.col("i")) * F.col("k") + F.greatest(j, F.col("i")) + 1,
                )
            ).alias("part"),
            "fp",
        )
    )
    dealt = usual.unionByName(split).repartition("bucket", "part").sortWithinPartitions("bucket", "part")
    return dealt.mapInArrow(lambda batches: _compare(batches, distance), "a bigint, b bigint")


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bucket numbers of both halves: whole, and with each of 32 bits deleted."""
    low = np.uint64(0xFFFFFFFF)
    for batch in batches:
        fp = np.asarray(batch.column("fp")).view(np.uint64)
        for half in (0, 1):
            v = (fp >> np.uint64(32)) if half == 0 else (fp & low)
            buckets = [v | np.uint64(half << 40)]
            for p in range(32):
                gone = v & ~np.uint64(1 << p) & low
                buckets.append(gone | np.uint64(half << 40) | np.uint64((p + 1) << 32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(buckets).view(np.int64)), pa.array(np.tile(fp, 33).view(np.int64))],
                ["bucket", "fp"],
            )


def _compare(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (bucket, part) to spanning links of each group."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def out(bucket: np.ndarray, part: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        pairs = _groups(bucket, part, fp, distance)
        a, b = (np.concatenate([p[i] for p in pairs]) if pairs else np.zeros(0, np.uint64) for i in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append((np.asarray(batch.column("bucket")), np.asarray(batch.column("part")), np.asarray(batch.column("fp")).view(np.uint64)))
        bucket, part, fp = (np.concatenate([h[i] for h in held]) for i in range(3))
        last = int(np.flatnonzero((bucket != bucket[-1]) | (part != part[-1]))[-1]) + 1 if bucket[0] != bucket[-1] or part[0] != part[-1] else 0
        held = [(bucket[last:], part[last:], fp[last:])]  # the last group may go on
        if last:
            yield out(bucket[:last], part[:last], fp[:last])
    if held:
        yield out(*held[0])


def _groups(bucket: np.ndarray, part: np.ndarray, fp: np.ndarray, distance: int) -> list[tuple[np.ndarray, np.ndarray]]:
    new = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (part[1:] != part[:-1])])
    size = np.diff(np.r_[new, len(bucket)])
    pairs = []
    two = new[size == 2]  # most groups are pairs: all at once
    near = np.bitwise_count(fp[two] ^ fp[two + 1]) <= distance
    pairs.append((fp[two][near], fp[two + 1][near]))
    for start, n in zip(new[size > 2].tolist(), size[size > 2].tolist(), strict=True):
        pairs.append(spanning(fp[start : start + n], distance))
    return pairs


def spanning(fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the graph "within ``distance``" over ``fp``."""
    rest, a, b = fp.copy(), [], []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count(rest ^ x) <= distance
            found = rest[near]
            if len(found):
                a.append(np.full(len(found), x, np.uint64))
                b.append(found)
                queue.extend(found)
                rest = rest[~near]
    empty = np.zeros(0, np.uint64)
    return (np.concatenate(a) if a else empty, np.concatenate(b) if b else empty)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, distance: int = 3) -> DataFrame:
    """(id, fingerprint, component_id), one row per input row.

    ``component_id`` is the smallest id reachable over links, itself included.
    Null or wordless texts have fingerprint zero and link like any other. Rows
    that repeat an id each get a row; a null id takes part in the links but
    never names a component unless all ids there are null. Texts may be of any
    length; other columns, whatever their names, are ignored. An empty table
    gives an empty result.
    """
    fps = written(fingerprints(docs, id_col, text_col, words).withColumnRenamed(id_col, "id"), "fps")
    classes = written(fps.groupBy("fp").agg(F.min("id").alias("rep")), "classes")
    roots = components(links(classes, distance))
    named = classes.join(roots, classes.fp == roots.node, "left").select("fp", "rep", F.coalesce("component", "fp").alias("root"))
    smallest = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    by_fp = named.join(smallest, "root").select("fp", "component_id")
    return fps.join(by_fp, "fp").select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, words: int = 3, distance: int = 3) -> DataFrame:
    """The rows of ``docs`` (doc_id, text) without near duplicates, all columns.

    Of each group the row with the smallest (doc_id, hash of the text) stays. Ids
    may be of any type that has an order, numbers or texts; a null id is smaller
    than any other; of rows equal in both, one stays. Null and wordless texts are
    one group, very long ones count whole; other columns may have any names; an
    empty table stays empty.
    """
    own = docs.select(whole_row(docs).alias("row"), F.struct(F.col("doc_id").alias("k"), F.xxhash64("text").alias("h")).alias("id"), "text")
    named = near_duplicates(own, "id", "text", words, distance).where(F.col("id").eqNullSafe(F.col("component_id")))
    first = named.select(F.col("id.k").alias("first_k"), F.col("id.h").alias("first_h")).distinct()
    rows = own.join(first, F.col("id.k").eqNullSafe(F.col("first_k")) & (F.col("id.h") == F.col("first_h")), "left_semi")
    return rows.groupBy("id").agg(F.first("row").alias("row")).select("row.*")
