"""Suffix-array deduplication: every byte under a repeated 200-byte string goes.

Documents are cut into runs of windows that share an anchor (see ``runs``), so
equal strings always meet under one anchor. The distinct runs of an anchor, and
a second copy of each that has one, are dealt to tasks by anchor, and blocks of
whole anchors are sorted there by the two-stage method: suffixes smaller than
their successor are sorted directly, all others are induced by one scan over
the buckets of first bytes, smallest first. Common prefixes of adjacent
suffixes, compared byte by byte, then tell which 200-byte strings occur twice:
nothing is removed but by them. Hashes only say where else a sorted run stands,
and let the direct sort stop early among strings that agree on all 200 bytes.
Only starts of 200-byte strings (and the suffixes needed to induce them) are
sorted, and only as deep as 200 bytes can tell.

An anchor with more than ``HOT`` runs to sort isn't brought to one task. Its
runs are cut again with longer anchors, at last of 200 bytes: then all strings
of an anchor are equal, and two of them are sorted.
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
from spillspark.llm.common import byte_column, mix, slabs, written

WINDOW = 200
GRAMS = (24, 112, 184, 200)  # bytes of an anchor: the first, then for what is too frequent
HOT = 1024
BLOCK = 1 << 20  # bytes sorted at a time, whole anchors
_BYTES = mix(np.arange(1, 257, dtype=np.uint64))


def byte_tokens(seed: int = 0) -> R.Tokens:
    table = mix(_BYTES ^ np.uint64(seed))
    return lambda raw, at: (table[raw], at)


def suffix_order(text: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``wanted`` suffixes in order, as far as ``depth`` bytes can tell.

    ``text`` ends with a zero, and zeros stand between its parts. Two-stage
    sorting: B suffixes (smaller than their successor) directly, A suffixes
    induced. Suffixes that aren't wanted take part only where inducing a
    wanted one needs them.
    """
    n = len(text)
    change = np.r_[np.flatnonzero(text[1:] != text[:-1]), n - 1]
    at = change[np.searchsorted(change, np.arange(n))]  # last position of the run of equal bytes
    small = np.zeros(n, bool)
    inner = at < n - 1
    small[inner] = text[at[inner]] < text[at[inner] + 1]

    # An A suffix is induced from its successor: keep chains up to the first B.
    next_b = np.r_[np.flatnonzero(small), n - 1]
    edge = np.flatnonzero(wanted & ~np.r_[wanted[1:], False])  # each stretch's last wanted suffix
    needed = wanted.astype(np.int64)
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, edge, 1)
    np.add.at(steps, next_b[np.searchsorted(next_b, edge)] + 1, -1)
    needed = (needed + np.cumsum(steps[:-1])) > 0

    tokens = _BYTES[np.r_[text, np.zeros(depth, np.uint8)]]
    whole = R.every_hash(R.prefix_hash(tokens), depth)
    direct = _sorted_directly(np.flatnonzero(needed & small), keys(text), whole, depth)
    return _induced(text, direct, needed & ~small, n)


def keys(text: np.ndarray) -> np.ndarray:
    """The next eight bytes at each position as one number, zeros past the end."""
    padded = np.r_[text, np.zeros(8, np.uint8)]
    key = np.zeros(len(text), np.uint64)
    for i in range(8):
        key = (key << np.uint64(8)) | padded[i : i + len(text)]
    return key


def _sorted_directly(positions: np.ndarray, key: np.ndarray, whole: np.ndarray, depth: int) -> np.ndarray:
    """Sort suffixes by eight bytes at a time; each round only keeps ties.

    Ties whose members agree in ``whole``, the hash of ``depth`` bytes, are left as they are.
    """
    if not len(positions):
        return positions
    order = positions[np.argsort(key[positions], kind="stable")]
    k = key[order]
    group = np.cumsum(np.r_[0, k[1:] != k[:-1]])  # equal so far
    tied = np.arange(len(order))
    n = len(key)
    for at in range(8, depth, 8):
        w = whole[order[tied]]
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        low, high = np.minimum.reduceat(w, first), np.maximum.reduceat(w, first)
        keep = np.repeat(low != high, np.diff(np.r_[first, len(group)]))
        tied, group = tied[keep], group[keep]
        if not len(tied):
            break
        member = order[tied]
        place = member + at
        k = np.where(place < n, key[np.minimum(place, n - 1)], 0)
        # Groups are already together: sort inside them.
        inner = np.lexsort((k, group))
        member, k, group = member[inner], k[inner], group[inner]
        order[tied] = member
        group = np.cumsum(np.r_[0, (k[1:] != k[:-1]) | (group[1:] != group[:-1])])
    return order


def _induced(text: np.ndarray, direct: np.ndarray, larger: np.ndarray, n: int) -> np.ndarray:
    """Scan buckets of first bytes upwards and place each A suffix behind its successor.

    In a bucket the A suffixes come before the B suffixes. An A suffix starts
    with its successor's first byte or a greater one, so when a bucket is
    reached, all its A suffixes that come from smaller buckets are in place;
    those from the bucket itself follow in waves.
    """
    first = text[direct]
    cut = np.searchsorted(first, np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    end = n - 1  # the last zero has no successor: it is the smallest of all
    if larger[end]:
        waiting[0].append(np.array([end]))
    out = []
    for c in range(256):
        wave = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        own = direct[cut[c] : cut[c + 1]]
        if not len(wave) and not len(own):
            continue
        bucket = []
        while len(wave):  # suffixes that repeat the byte induce each other
            bucket.append(wave)
            before = wave[wave > 0] - 1
            wave = before[larger[before] & (text[before] == c)]
        placed = np.concatenate([*bucket, own])
        out.append(placed)
        before = placed[placed > 0] - 1
        before = before[larger[before] & (text[before] > c)]
        if len(before):
            byte = text[before]
            by = np.argsort(byte, kind="stable")
            before, byte = before[by], byte[by]
            edges = np.flatnonzero(np.r_[True, byte[1:] != byte[:-1], True])
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                waiting[byte[a]].append(before[a:b])
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def common_prefix(key: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Common prefix of each suffix with the one before it, in whole eights up to ``depth``.

    ``key``: the next eight bytes at each position, with zeros for ``depth`` positions past the end.
    """
    out = np.zeros(len(order), np.int64)
    left = np.arange(1, len(order))
    for at in range(0, depth, 8):
        if not len(left):
            break
        left = left[key[order[left] + at] == key[order[left - 1] + at]]
        out[left] = min(depth, at + 8)
    return out


def repeated_starts(raw: np.ndarray, at: np.ndarray, counts: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Which of the first ``counts`` strings of ``window`` bytes of each part occur twice.

    The parts lie in ``raw`` at ``at``. Returns flags, part after part, and
    their offsets. ``window`` is a multiple of eight. No byte is 255 (UTF-8 has none).
    """
    size = np.diff(at)
    begin = at[:-1] + np.arange(len(size))
    text = np.zeros(len(raw) + len(size), np.uint8)  # zeros stand at the parts' ends
    text[np.arange(len(raw)) + np.repeat(np.arange(len(size)), size)] = raw + np.uint8(1)
    offsets = np.r_[0, np.cumsum(counts)]
    start = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - begin, counts)
    wanted = np.zeros(len(text), bool)
    wanted[start] = True
    if not len(start):
        return np.zeros(0, bool), offsets
    order = suffix_order(text, wanted, window)
    order = order[wanted[order]]
    same = common_prefix(np.r_[keys(text), np.zeros(window, np.uint64)], order, window) >= window
    twice = np.zeros(len(text), bool)
    twice[order[same]] = True
    twice[order[:-1][same[1:]]] = True
    return twice[start], offsets


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of each run in ``own``."""
    for batch in slabs(batches):
        raw, at = byte_column(batch.column("text"))
        doc, own = R.flat_own(batch)
        for a in range(0, len(doc), 20_000):
            f = {k: v[a : a + 20_000] for k, v in own.items()}
            n = f["n"].astype(np.int64)
            part, offsets = _cut(raw, at[:-1][doc[a : a + 20_000]] + f["start"], n - 1 + WINDOW)
            data = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(part)])
            yield pa.RecordBatch.from_arrays([pa.array(f["g"]), pa.array(f["s"]), pa.array(n.astype(np.int32)), data], ["g", "s", "n", "part"])


def _cut(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes [start, start + size) one after the other, and their offsets."""
    offsets = np.r_[0, np.cumsum(size)]
    return raw[np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], size)], offsets


def _sort_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ordered by (g, s) to (g, s, lo, hi) of repeated window starts, one row for a run's two copies."""
    held: list[pa.RecordBatch] = []
    bytes_held = 0

    def done(rows: pa.RecordBatch) -> pa.RecordBatch:
        g, s, n = (np.asarray(rows.column(c)) for c in ("g", "s", "n"))
        flags, offsets = repeated_starts(*byte_column(rows.column("part")), n.astype(np.int64))
        edge = np.zeros(len(flags) + 1, bool)
        edge[offsets] = True  # a range ends with its part
        begin = np.flatnonzero(flags & (edge[:-1] | ~np.r_[False, flags[:-1]])) if len(flags) else offsets[:0]
        end = np.flatnonzero(flags & (edge[1:] | ~np.r_[flags[1:], False])) + 1 if len(flags) else offsets[:0]
        row = np.searchsorted(offsets, begin, side="right") - 1
        first = np.r_[True, (g[1:] != g[:-1]) | (s[1:] != s[:-1])][: len(g)]
        some = first[row]
        row, begin, end = row[some], begin[some], end[some]
        return pa.RecordBatch.from_arrays([pa.array(g[row]), pa.array(s[row]), pa.array((begin - offsets[row]).astype(np.int32)), pa.array((end - offsets[row]).astype(np.int32))], ["g", "s", "lo", "hi"])

    for batch in batches:
        if not batch.num_rows:
            continue
        g = np.asarray(batch.column("g"))
        _, at = byte_column(batch.column("part"))
        before = held[-1].column("g")[-1].as_py() if held else None
        new = np.flatnonzero(np.r_[before != g[0], g[1:] != g[:-1]])  # where an anchor begins
        begin = 0
        while len(cut := new[(new >= begin) & (at[new] - at[begin] + bytes_held >= BLOCK)]):
            held.append(batch.slice(begin, cut[0] - begin))
            yield done(_joined(held))
            held, bytes_held, begin = [], 0, int(cut[0])
        held.append(batch.slice(begin))
        bytes_held += int(at[-1] - at[begin])
    if held:
        yield done(_joined(held))


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def _cut_again(tokens: R.Tokens, gram: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The runs in ``own`` cut by longer anchors: (g, s, uid, start, n, og, os, off), the run and the place in it kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slabs(batches):
            raw, at = byte_column(batch.column("text"))
            doc, own = R.flat_own(batch)
            for a in range(0, len(doc), 4096):
                f = {k: v[a : a + 4096] for k, v in own.items()}
                part, offsets = _cut(raw, at[:-1][doc[a : a + 4096]] + f["start"], f["n"].astype(np.int64) - 1 + WINDOW)
                found = R.find_runs(*tokens(part, offsets), WINDOW, gram)
                i = found["doc"]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(found["anchor"].view(np.int64)), pa.array(found["span"].view(np.int64)), batch.column("uid").take(pa.array(doc[a : a + 4096][i])),
                        pa.array((f["start"][i] + found["start"]).astype(np.int32)), pa.array(found["n"].astype(np.int32)),
                        pa.array(f["g"][i]), pa.array(f["s"][i]), pa.array(found["start"].astype(np.int32)),
                    ],
                    ["g", "s", "uid", "start", "n", "og", "os", "off"],
                )

    return run


def _marks(rows: DataFrame, docs: DataFrame, grams: tuple[int, ...]) -> DataFrame:
    """(g, s, lo, hi): repeated window starts of each distinct run (g, s) among ``rows`` (g, s, uid, start, n)."""
    two = (F.min(F.struct("uid", "start", "n")).alias("x"), F.max(F.struct("uid", "start", "n")).alias("y"))
    distinct = written(rows.groupBy("g", "s").agg(*two), "distinct")
    copies = distinct.select("g", "s", F.explode(F.array_distinct(F.array("x", "y"))).alias("o")).select("g", "s", "o.*")
    sizes = written(distinct.groupBy("g").agg(F.sum(F.when(F.col("x") == F.col("y"), 1).otherwise(2)).alias("c")).where("c > 1"), "sizes")
    usual = copies.join(sizes.where(F.col("c") <= HOT).select("g"), "g") if grams else copies.join(sizes.select("g"), "g")
    parts = R.with_texts(usual, docs, ("g", "s", "start", "n")).mapInArrow(_parts, "g bigint, s bigint, n int, part binary")
    marks = parts.repartition("g").sortWithinPartitions("g", "s").mapInArrow(_sort_blocks, "g bigint, s bigint, lo int, hi int")
    if not grams or not sizes.where(F.col("c") > HOT).limit(1).count():
        return marks
    many = copies.join(sizes.where(F.col("c") > HOT).select("g"), "g")
    cut = R.with_texts(many, docs, ("g", "s", "start", "n")).mapInArrow(_cut_again(byte_tokens(secrets.randbits(63)), grams[0]), "g bigint, s bigint, uid bigint, start int, n int, og bigint, os bigint, off int")
    cut = written(cut, "cut")
    inner = written(_marks(cut.select("g", "s", "uid", "start", "n"), docs, grams[1:]), "marks")
    up = cut.join(inner, ["g", "s"]).select(F.col("og").alias("g"), F.col("os").alias("s"), (F.col("off") + F.col("lo")).alias("lo"), (F.col("off") + F.col("hi")).alias("hi"))
    return marks.unionByName(up.distinct())


def removal_intervals(docs: DataFrame) -> DataFrame:
    """(uid, lo, hi): byte intervals to remove, of ``runs.numbered`` documents."""
    found = R.repeated_runs(docs, byte_tokens(secrets.randbits(63)), WINDOW, GRAMS[0], ("a", "s", "uid", "occ"))
    start = R.place_of(F.col("occ"))
    rows = found.select(F.col("a").alias("g"), "s", "uid", start.alias("start"), R.length_of(F.col("occ")).alias("n"))
    marks = written(_marks(rows, docs, GRAMS[1:]), "marks")
    return rows.join(marks, ["g", "s"]).select("uid", (F.col("start") + F.col("lo")).alias("lo"), (F.col("start") + F.col("hi") - 1 + WINDOW).alias("hi"))


def _finish(raw: np.ndarray, at: np.ndarray, doc: np.ndarray, lo: np.ndarray, hi: np.ndarray):
    gone = R.cover(len(raw), at[:-1][doc] + lo, at[:-1][doc] + hi)
    counts = np.r_[0, np.cumsum(gone)]
    edge = gone & ~np.r_[False, gone[:-1]][: len(gone)]
    edge[at[:-1][at[:-1] < len(raw)]] |= gone[at[:-1][at[:-1] < len(raw)]]  # a new document starts a new span
    spans = np.r_[0, np.cumsum(edge)]
    digests = []
    for d in range(len(at) - 1):
        a, b = at[d], at[d + 1]
        own = raw[a:b] if counts[a] == counts[b] else raw[a:b][~gone[a:b]]
        digests.append(hashlib.sha256(own.tobytes()).hexdigest())
    return np.diff(at), counts[at[1:]] - counts[at[:-1]], spans[at[1:]] - spans[at[:-1]], digests


def dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each row of ``docs`` (doc_id, text).

    All copies of a repeated string go, the first included. Ids are integers; a
    null or empty text has no bytes. Rows that repeat an id, or have none, are
    documents of their own, so equal rows repeat each other. Texts may be of
    any length (a row's own intervals meet in one task); other columns,
    whatever their names, are ignored; an empty table gives an empty result.
    """
    rows = R.numbered(docs)
    return R.removed(rows, removal_intervals(rows), _finish, "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
