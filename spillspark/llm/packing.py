"""Packing documents into fixed-length sequences along a Hilbert curve.

A document's tokens are counted in hashed buckets, damped, normalised and
projected to four dimensions with a fixed random matrix; the Hilbert index of
that point is its place on the curve. The tokenised documents are written once
to the shared folder. The light columns (curve key, id, length) are
range-sorted; a running sum inside each range plus the sums of the ranges
before it gives every document's place in one gapless stream of ids, and the
stream is cut every ``length`` ids. Only the very last sequence can be short.

Keys that many copies share are split by the id that follows in the sort key,
so a hot key is dealt over several ranges. What is broadcast has one row per
range.
"""

from __future__ import annotations

import functools
import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spillspark.llm.common import byte_column, slabs, written

VOCABULARY = "word_bpe_49k.json"
LENGTH = 2048
END_ID = 1
BUCKETS = 1024
DIMS, BITS = 4, 15
#: Entries after which a worker forgets the words it has met. Workers that wait keep theirs, so that an
#: executor holds these more often than it has cores.
MEMO_WORDS, MEMO_PIECES = 50_000, 1_000_000

# Fixed values of the vocabulary's own splitting rule, for ASCII and Latin-1.
LETTERS = "a-zªµºß-öø-ÿ"
NUMBERS = "0-9²³¹¼½¾"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Token ids of texts, equal to the tokenizer's own, with memories of words.

    White space never reaches a token and words don't influence each other, so
    a text's ids are those of its words. Words of plain printable ASCII or
    Latin-1 letters are cut by the vocabulary's rule and each distinct piece is
    encoded once; any other word goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import re

        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.pieces = Tokenizer(self.whole.model)
        self.pieces.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        # Without < a word can't hold a special token.
        self.simple = re.compile(r"[!-;=-~¡-ÿ]+").fullmatch
        self.cut = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^\s{LETTERS}{NUMBERS}]+").findall
        self.words: dict[bytes, bytes] = {}
        self.known: dict[str, bytes] = {}

    def _learn(self, new: list[bytes]) -> None:
        plain, cuts, fresh = [], [], set()
        for w in new:
            s = w.decode()
            if self.simple(s):
                c = self.cut(s.lower())
                plain.append(w)
                cuts.append(c)
                fresh.update(c)
            else:
                self.words[w] = array("H", self.whole.encode(s, add_special_tokens=False).ids).tobytes()
        known = self.known
        todo = [p for p in fresh if p not in known]
        for a in range(0, len(todo), 4096):
            part = todo[a : a + 4096]
            for p, e in zip(part, self.pieces.encode_batch_fast(part, add_special_tokens=False), strict=True):
                known[p] = array("H", e.ids).tobytes()
        for w, c in zip(plain, cuts, strict=True):
            self.words[w] = b"".join([known[p] for p in c])

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian 16-bit ids of each UTF-8 text."""
        if len(self.words) > MEMO_WORDS:
            self.words.clear()
        if len(self.known) > MEMO_PIECES:
            self.known.clear()
        out = []
        for text in texts:
            words = text.split()
            new = set(words).difference(self.words)
            if new:
                self._learn(list(new))
            out.append(b"".join(map(self.words.__getitem__, words)))
        return out


@functools.cache
def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary."""
    return Encoder(path)


@functools.cache
def projection(dims: int = DIMS) -> np.ndarray:
    return np.random.default_rng(20).standard_normal((BUCKETS, dims)).astype(np.float32)


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert index of integer points (n, dims), each coordinate under 2**bits."""
    x = points.T.astype(np.int64).copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the curve's rotations, from the highest bit down
        low = q - 1
        for i in range(dims):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(flip, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros(points.shape[0], np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        turn = np.where((x[-1] & q) != 0, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    key = np.zeros(points.shape[0], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Curve key of each document of the flat id array; ``at`` holds offsets."""
    n = len(at) - 1
    keys = np.empty(n, np.int64)
    for a in range(0, n, 1024):
        b = min(n, a + 1024)
        flat = ids[at[a] : at[b]].astype(np.int64)
        doc = np.repeat(np.arange(b - a), np.diff(at[a : b + 1]))
        counts = np.bincount(doc * BUCKETS + (flat * 40503 >> 4) % BUCKETS, minlength=(b - a) * BUCKETS).reshape(b - a, BUCKETS)
        vectors = np.log1p(counts.astype(np.float32))
        vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
        points = vectors @ projection()  # about standard normal per dimension
        keys[a:b] = hilbert(np.clip((points / 8 + 0.5) * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64))
    return keys


def tokenised(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, n, ids): ids are little-endian 16-bit, the end id included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = END_ID.to_bytes(2, "little")
        for batch in slabs(batches):
            raw, at = byte_column(batch.column("text"))
            data = raw.tobytes()
            ids = [x + end for x in encoder(path).encode([data[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)])]
            n = np.array([len(x) // 2 for x in ids], np.int64)
            keys = curve_keys(np.frombuffer(b"".join(ids), np.uint16), np.r_[0, np.cumsum(n)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(keys), pa.array(n), pa.array(ids, pa.binary())], ["doc_id", "key", "n", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, key bigint, n bigint, ids binary")


def _local_starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Running sums inside one sorted range, and the range's number."""
    here, total = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = np.asarray(batch.column("n"))
        end = total + np.cumsum(n)
        yield pa.RecordBatch.from_arrays([batch.column("uid"), pa.array(end - n), pa.array(n), pa.array(np.full(len(n), here, np.int32))], ["uid", "local", "n", "range"])
        total = int(end[-1]) if len(end) else total


def cut(ids: bytes, place: int, length: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(start, length, crc, sequence, offset) of the pieces of one document."""
    flat, start = np.frombuffer(ids, np.uint16).astype("<u4"), 0
    while start < len(flat):
        offset = (place + start) % length
        size = min(length - offset, len(flat) - start)
        yield start, size, zlib.crc32(flat[start : start + size].tobytes()), (place + start) // length, offset
        start += size


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of documents with their places in sequences of ``length`` ids.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    and with ``with_ids`` the piece's ids as 16-bit little-endian bytes. A null
    or empty text has the end id alone; texts may be of any length and make as
    many pieces as they need. Ties on the curve go by id, then by row. Rows that
    repeat an id, in whole or not, are packed one by one; a null id sorts first.
    Other columns, whatever their names, are ignored. Empty tables give no pieces.
    """
    path = path or vocabulary_path()
    tokens = written(tokenised(docs, path, id_col, text_col).withColumn("uid", F.monotonically_increasing_id()), "tokens")
    order = tokens.select("key", "doc_id", "uid", "n").repartitionByRange("key", "doc_id", "uid").sortWithinPartitions("key", "doc_id", "uid")
    local = written(order.select("uid", "n").mapInArrow(_local_starts, "uid bigint, local bigint, n bigint, range int"), "places")
    sums = local.groupBy("range").agg(F.sum("n").alias("s"))
    base = sums.select("range", (F.sum("s").over(Window.orderBy("range")) - F.col("s")).alias("base"))
    places = local.join(F.broadcast(base), "range").select("uid", (F.col("base") + F.col("local")).alias("place"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, pieces, own = [], [], []
            columns = zip(batch.column("ids").to_pylist(), batch.column("place").to_pylist(), strict=True)
            for i, (ids, place) in enumerate(columns):
                for piece in cut(ids, place, length):
                    rows.append(i)
                    pieces.append((piece[0], piece[1], piece[2], len(ids) // 2, piece[3], piece[4]))
                    if with_ids:
                        own.append(ids[2 * piece[0] : 2 * (piece[0] + piece[1])])
            numbers = np.array(pieces, np.int64).reshape(-1, 6)
            arrays = [batch.column("doc_id").take(pa.array(rows, pa.int64())), *(pa.array(np.ascontiguousarray(numbers[:, j])) for j in range(6))]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(own, pa.binary())] * with_ids, names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"{c} bigint" for c in names[1:7]) + (", ids binary" if with_ids else "")
    return tokens.select("uid", "doc_id", "ids").join(places, "uid").select("doc_id", "ids", "place").mapInArrow(run, schema).withColumnRenamed("doc_id", id_col)
