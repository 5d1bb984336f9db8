"""Hard negatives by an inverted multi-index, exact.

Index. Vectors are cut into two halves; each half has a codebook, fitted by
k-means on ``SAMPLE`` rows with the smallest hashes. A row lies in the cell of
its two nearest entries. Every row is indexed: the radius of an entry is the
largest distance of any row's half from it, and cells are counted, both over
all rows. There are about sqrt(rows) cells, ``MAX_ENTRIES`` squared at most.

Search. For an anchor, the best score a row under a half's entry can have is
(half of the anchor . entry) + (its norm) x (radius), and a cell's bound is the
sum of its two. A heap walks the cells by falling bounds, as in the
multi-sequence algorithm. A window of scores is certified when the next bound
is below the score it still needs: the last of those found so far, or its lower
end. Cells behind that are never read.

An anchor has one window for its positives (same label, no limits) and then one
for each of them (other labels, from a share of its score up to it). Each kind
takes two passes: a probe of the first cells, ``PROBE`` rows, only to learn the score
that is needed, and the pass that certifies.

A pass deals index rows and visits to buckets of cells. Large cells are split
over several buckets and small ones share one, so a bucket holds a bounded
number of rows, also when one vector is very common. A task holds a
bucket's rows, streams the anchors that visit it past them, and emits the
best few per window. An anchor visits a bucket once, with the list of its cells
there.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spillspark.llm.common import mix, written
from spillspark.llm.vectors import integers, matrix, usable, width_of

SAMPLE = 4096
MAX_ENTRIES = 256
KMEANS_ROUNDS = 8
PROBE = 1024
LEAST_BUCKET, MOST_BUCKET = 256, 8192  # rows
ANCHORS_AT_ONCE = 1024
LOWEST, HIGHEST = -(1 << 62), 1 << 62
_EXACT = float(1 << 53)

ROW = "bucket bigint, kind int, uid bigint, id bigint, label bigint, cell int, v array<int>, cells array<int>, lows array<bigint>, tops array<bigint>"
FOUND = "uid bigint, w int, score bigint, other bigint, other_uid bigint"


@dataclass
class Index:
    """Codebooks and radii of the two halves, and where each cell's rows are."""

    books: tuple[np.ndarray, np.ndarray]
    radii: tuple[np.ndarray, np.ndarray]
    sizes: np.ndarray  # rows per cell
    first: np.ndarray  # first bucket of each cell
    pieces: np.ndarray  # buckets of each cell

    def bounds(self, q: np.ndarray) -> list[np.ndarray]:
        """Best score that a row can add under each entry of each half, for each row of ``q``."""
        out, cut = [], self.books[0].shape[1]
        for half, book, radius in zip((q[:, :cut], q[:, cut:]), self.books, self.radii, strict=True):
            norm = np.linalg.norm(half, axis=1)[:, None]
            size = np.linalg.norm(book, axis=1)[None]
            # Sums are rounded: a bound may only be too high.
            out.append(half @ book.T + norm * radius[None] + 1e-9 * norm * (size + radius[None]) + 0.25)
        return out

    def buckets_of(self, cell: np.ndarray, uid: np.ndarray) -> np.ndarray:
        return self.first[cell] + (mix(uid.astype(np.uint64)) % self.pieces[cell].astype(np.uint64)).astype(np.int64)


def walk(one: np.ndarray, two: np.ndarray, sizes: np.ndarray, needed: float, most_rows: int) -> list[int]:
    """Cells with rows by falling sum of bounds, down to ``needed`` or until ``most_rows`` rows are passed."""
    a, b = np.argsort(-one, kind="stable"), np.argsort(-two, kind="stable")
    one, two, a, b = one[a].tolist(), two[b].tolist(), a.tolist(), b.tolist()
    heap, next_in_row, found, rows = [(-(one[0] + two[0]), 0, 0)], [0] * len(a), [], 0
    while heap:
        bound, i, j = heapq.heappop(heap)
        if -bound < needed or rows >= most_rows:
            break
        cell = a[i] * len(b) + b[j]
        if sizes[cell]:
            found.append(cell)
            rows += int(sizes[cell])
        next_in_row[i] = j + 1
        # A pair comes up once its left and its upper neighbour are out.
        if j + 1 < len(b) and (i == 0 or next_in_row[i - 1] > j + 1):
            heapq.heappush(heap, (-(one[i] + two[j + 1]), i, j + 1))
        if i + 1 < len(a) and next_in_row[i + 1] == j:
            heapq.heappush(heap, (-(one[i + 1] + two[j]), i + 1, j))
    return found


def codebook(points: np.ndarray, entries: int) -> np.ndarray:
    """k-means over a bounded sample: starts at evenly spaced distinct points."""
    distinct = np.unique(points, axis=0)
    book = distinct[np.linspace(0, len(distinct) - 1, min(entries, len(distinct))).astype(int)].astype(np.float64)
    for _ in range(KMEANS_ROUNDS):
        near = _nearest(points, book)[0]
        n = np.bincount(near, minlength=len(book))
        sums = np.stack([np.bincount(near, points[:, i], len(book)) for i in range(points.shape[1])], axis=1) if points.shape[1] else book * 0
        book = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], book)
    return book


def _nearest(points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry and distance of each point."""
    near = ((book * book).sum(1)[None] - 2 * points @ book.T).argmin(1)
    return near, np.linalg.norm(points - book[near], axis=1)


def build(kept: DataFrame) -> tuple[DataFrame, Index] | None:
    """Written index rows (uid, id, label, anchor, v, cell) of all of ``kept``, and its directory."""
    spark = kept.sparkSession
    rows = kept.count()
    width = width_of(kept)
    if not rows:
        return None
    sample = kept.select("v", F.xxhash64("id", "v").alias("h")).orderBy("h").limit(SAMPLE).select("v").collect()
    if {len(r.v) for r in sample} != {width} or not width:
        raise ValueError("vectors need one length of at least one")
    points = np.array([r.v for r in sample], np.float64)
    cut = width // 2
    entries = min(MAX_ENTRIES, max(2, round(1.5 * rows**0.25)))
    books = codebook(points[:, :cut], entries), codebook(points[:, cut:], entries)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column("v"), width).astype(np.float64)
            (i, r1), (j, r2) = _nearest(v[:, :cut], books[0]), _nearest(v[:, cut:], books[1])
            cell = (i * len(books[1]) + j).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(r1), pa.array(r2)], [*batch.schema.names, "cell", "r1", "r2"])

    placed = kept.withColumn("uid", F.monotonically_increasing_id()).select("uid", "id", "label", "anchor", "v")
    table = written(placed.mapInArrow(place, "uid bigint, id bigint, label bigint, anchor boolean, v array<int>, cell int, r1 double, r2 double"), "multi_index")
    cells = table.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("r1").alias("r1"), F.max("r2").alias("r2")).collect()  # a row per cell
    sizes = np.zeros(len(books[0]) * len(books[1]), np.int64)
    radii = np.zeros(len(books[0])), np.zeros(len(books[1]))
    for r in cells:
        sizes[r.cell] = r.n
        i, j = divmod(r.cell, len(books[1]))
        radii[0][i], radii[1][j] = max(radii[0][i], r.r1), max(radii[1][j], r.r2)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bucket = min(MOST_BUCKET, max(LEAST_BUCKET, rows // (4 * tasks)))
    pieces = np.maximum(1, -(-sizes // bucket))
    first, now, room = np.zeros(len(sizes), np.int64), -1, 0
    for c in np.flatnonzero(sizes).tolist():
        if pieces[c] > 1 or sizes[c] > room:
            first[c], now, room = now + 1, now + int(pieces[c]), bucket - int(sizes[c])
        else:
            first[c], room = now, room - int(sizes[c])
    return table.drop("r1", "r2"), Index(books, radii, sizes, first, pieces)


def visits(anchors: DataFrame, index: Index, most_rows: int) -> DataFrame:
    """A row per anchor and bucket that its walk comes to, with its cells there.

    ``anchors``: uid, label, v, and the windows as ``lows`` and ``tops``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                q = matrix(batch.column("v"), sum(b.shape[1] for b in index.books)).astype(np.float64)
                one, two = index.bounds(q)
                who, bucket, cells = [], [], []
                for k, (lows, tops) in enumerate(zip(batch.column("lows").to_pylist(), batch.column("tops").to_pylist(), strict=True)):
                    needed = min((low for low, top in zip(lows, tops, strict=True) if low <= top), default=None)
                    if needed is None:
                        continue
                    own: dict[int, list[int]] = {}
                    for c in walk(one[k], two[k], index.sizes, needed, most_rows):
                        for b in range(int(index.first[c]), int(index.first[c] + index.pieces[c])):
                            own.setdefault(b, []).append(c)
                    who += [k] * len(own)
                    bucket += own.keys()
                    cells += own.values()
                take = pa.array(who, pa.int32())
                nulls = pa.nulls(len(who), pa.int64())
                made = {"bucket": pa.array(bucket, pa.int64()), "kind": pa.array(np.ones(len(who), np.int32)), "id": nulls, "cell": nulls.cast(pa.int32()), "cells": pa.array(cells, pa.list_(pa.int32()))}
                names = [c.split()[0] for c in ROW.split(", ")]
                yield pa.RecordBatch.from_arrays([made[n] if n in made else batch.column(n).take(take) for n in names], names)

    return anchors.select("uid", "label", "v", "lows", "tops").mapInArrow(run, ROW)


def _dealt(table: DataFrame, index: Index) -> DataFrame:
    """Index rows with their buckets, in the columns of visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket = index.buckets_of(np.asarray(batch.column("cell")), np.asarray(batch.column("uid")))
            yield pa.RecordBatch.from_arrays([pa.array(bucket), *batch.columns], ["bucket", *batch.schema.names])

    dealt = table.select("uid", "id", "label", "cell", "v").mapInArrow(run, "bucket bigint, uid bigint, id bigint, label bigint, cell int, v array<int>")
    none = lambda kind: F.lit(None).cast(kind)
    return dealt.select("bucket", F.lit(0).alias("kind"), "uid", "id", "label", "cell", "v", none("array<int>").alias("cells"), none("array<bigint>").alias("lows"), none("array<bigint>").alias("tops"))


def best(table: DataFrame, index: Index, anchors: DataFrame, same: bool, keep: int, most_rows: int) -> DataFrame:
    """(uid, w, rank, score, other, other_uid): the first ``keep`` rows of each window among the visited cells.

    ``same``: rows of the anchor's label, without itself; else those of other labels.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, ready = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket, kind = np.asarray(batch.column("bucket")), np.asarray(batch.column("kind"))
            new = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (kind[1:] != kind[:-1])]).tolist()
            for a, b in zip(new, [*new[1:], len(bucket)], strict=True):
                if bucket[a] != now:
                    now, held, ready = bucket[a], [], None
                if kind[a] == 0:
                    held.append(batch.slice(a, b - a))
                elif held:
                    ready = ready or _Bucket(held)
                    for at in range(a, b, ANCHORS_AT_ONCE):
                        yield ready.compare(batch.slice(at, min(ANCHORS_AT_ONCE, b - at)), same, keep)

    both = _dealt(table, index).unionByName(visits(anchors, index, most_rows)).repartition("bucket").sortWithinPartitions("bucket", "kind")
    found = both.mapInArrow(run, FOUND)
    rank = F.row_number().over(Window.partitionBy("uid", "w").orderBy(F.desc("score"), F.asc_nulls_last("other"), "other_uid"))
    return found.withColumn("rank", rank).where(F.col("rank") <= keep)


class _Bucket:
    """The index rows of one bucket, sorted by cell."""

    def __init__(self, parts: list[pa.RecordBatch]):
        rows = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        cell = np.asarray(rows.column("cell"))
        order = np.argsort(cell, kind="stable")
        self.v = matrix(rows.column("v"), len(rows.column("v")[0]))[order].astype(np.float64)
        self.uid, self.label, self.cell = (np.asarray(rows.column(c))[order] for c in ("uid", "label", "cell"))
        self.none = np.asarray(rows.column("id").is_null())[order]
        self.id = np.asarray(rows.column("id").fill_null(0))[order]
        self.size = float(np.abs(self.v).max(initial=0))
        start = np.flatnonzero(np.r_[True, self.cell[1:] != self.cell[:-1]])
        self.at = dict(zip(self.cell[start].tolist(), zip(start.tolist(), [*start[1:].tolist(), len(self.cell)], strict=True), strict=True))

    def scores(self, q: np.ndarray, a: int, b: int) -> np.ndarray:
        """Exact inner products: as doubles where no sum can leave their integers, else as integers."""
        v = self.v[a:b]
        if float(np.abs(q).max(initial=0)) * self.size * q.shape[1] < _EXACT:
            return (q @ v.T).astype(np.int64)
        return q.astype(np.int64) @ v.astype(np.int64).T

    def compare(self, anchors: pa.RecordBatch, same: bool, keep: int) -> pa.RecordBatch:
        q = matrix(anchors.column("v"), self.v.shape[1]).astype(np.float64)
        uid, label = np.asarray(anchors.column("uid")), np.asarray(anchors.column("label"))
        n = np.asarray(anchors.column("lows").value_lengths())
        # Windows side by side; what an anchor lacks is an empty window.
        lows, tops = np.full((len(q), n.max()), HIGHEST), np.full((len(q), n.max()), LOWEST)
        there = np.arange(n.max())[None] < n[:, None]
        lows[there], tops[there] = np.asarray(anchors.column("lows").flatten()), np.asarray(anchors.column("tops").flatten())
        m = np.asarray(anchors.column("cells").value_lengths())
        who, cells = np.repeat(np.arange(len(q)), m), np.asarray(anchors.column("cells").flatten())
        order = np.argsort(cells, kind="stable")
        who, cells = who[order], cells[order]
        start = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]]).tolist()
        hits: list[tuple[np.ndarray, ...]] = []
        for s, e in zip(start, [*start[1:], len(cells)], strict=True):
            if int(cells[s]) not in self.at:  # this cell's rows are in other buckets
                continue
            a, b = self.at[int(cells[s])]
            own = who[s:e]
            score = self.scores(q[own], a, b)
            fits = (label[own][:, None] == self.label[None, a:b]) == same
            if same:
                fits &= uid[own][:, None] != self.uid[None, a:b]
            for w in range(lows.shape[1]):
                i, j = np.nonzero(fits & (score >= lows[own, w][:, None]) & (score <= tops[own, w][:, None]))
                if len(i):
                    hits.append((own[i], np.full(len(i), w, np.int32), score[i, j], j + a))
        if not hits:
            who = w = score = row = np.zeros(0, np.int64)
        else:
            who, w, score, row = (np.concatenate([h[k] for h in hits]) for k in range(4))
            order = np.lexsort((self.uid[row], self.id[row], self.none[row], -score, w, who))
            who, w, score, row = who[order], w[order], score[order], row[order]
            new = np.flatnonzero(np.r_[True, (who[1:] != who[:-1]) | (w[1:] != w[:-1])])
            rank = np.arange(len(who)) - np.repeat(new, np.diff(np.r_[new, len(who)]))
            who, w, score, row = (x[rank < keep] for x in (who, w, score, row))
        other = pa.array(self.id[row], mask=self.none[row])
        return pa.RecordBatch.from_arrays([pa.array(uid[who]), pa.array(w.astype(np.int32)), pa.array(score), other, pa.array(self.uid[row])], ["uid", "w", "score", "other", "other_uid"])


def mine(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", anchor_col: str = "is_anchor", positives: int = 5, negatives: int = 5, share: tuple[int, int] = (80, 100)) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of each anchor and positive.

    Scores are inner products of floor(256 * x). Rows where ``anchor_col`` is
    true are the anchors. Positives are an anchor's ``positives`` best other rows of its label (all,
    if fewer); negatives the ``negatives`` best of other labels from ``share`` of
    the positive's score up to that score. Ties go to the smaller id.

    Rows without a label or vector, or with null or non-finite components, take
    no part. Rows that repeat an id are rows of their own: each is an anchor, a
    positive or a negative by itself. A null id comes last among ties. A
    positive without negatives gives no row, nor does one of a negative score,
    whose window is empty. Vectors of different lengths, or with a component of
    65,536 or more, are an error. Other columns, whatever their names, are
    ignored; an empty table gives an empty result.
    """
    kept = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"), F.coalesce(anchor_col, F.lit(False)).alias("anchor"), F.col(vector_col).alias("v"))
    kept = kept.where(usable(F.col("v")) & F.col("label").isNotNull()).withColumn("v", integers(F.col("v")))
    made = build(kept)
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    if made is None:
        return rows.sparkSession.createDataFrame([], ", ".join(f"{n} {'int' if n == 'rank' else 'bigint'}" for n in names))
    table, index = made
    anchors = table.where("anchor").select("uid", "id", "label", "v")

    def certified(asked: DataFrame, same: bool, keep: int, name: str) -> DataFrame:
        """``best`` over all cells that can matter to the windows of ``asked``."""
        probe = best(table, index, asked, same, keep, PROBE)
        # The last of a full window's first ones is what its others have to reach.
        reached = written(probe.groupBy("uid", "w").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).where(F.col("n") == keep).groupBy("uid").agg(F.map_from_entries(F.collect_list(F.struct("w", "least"))).alias("reached")), "probed")
        higher = F.transform("lows", lambda low, w: F.greatest(low, F.coalesce(F.try_element_at("reached", w), low)))
        narrowed = asked.join(reached, "uid", "left").select("uid", "label", "v", F.coalesce(higher, "lows").alias("lows"), "tops")
        return written(best(table, index, narrowed, same, keep, HIGHEST), name)

    one = lambda x: F.array(F.lit(x).cast("bigint"))
    found = certified(anchors.select("uid", "label", "v", one(LOWEST).alias("lows"), one(HIGHEST).alias("tops")), True, positives, "positives")
    few, all_ = share
    windows = found.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("rank", "score"))).alias("p"))
    # The smallest s with few * score <= all * s; scores below zero have none.
    needed = F.expr(f"transform(p, x -> if(x.score >= 0, (x.score * {few} + {all_ - 1}) div {all_}, {HIGHEST}))")
    asked = written(anchors.join(windows, "uid").select("uid", "label", "v", needed.alias("lows"), F.transform("p", lambda p: p["score"]).alias("tops")), "windows")
    hard = certified(asked, False, negatives, "negatives")
    pairs = found.select("uid", (F.col("rank") - 1).alias("w"), F.col("other").alias("positive_id"), F.col("score").alias("positive_score"))
    named = anchors.select("uid", F.col("id").alias("anchor_id"))
    return hard.join(pairs, ["uid", "w"]).join(named, "uid").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


#: The same by scoring every row for every anchor, in DuckDB SQL.
ORACLE = """
with kept as materialized (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v
  from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)
, scored as materialized (
  select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, cast(list_inner_product(a.v, b.v) as bigint) as score
  from kept a, kept b where a.vec_id % 100 = 0 and a.vec_id <> b.vec_id)
, positives as (
  select anchor_id, vec_id as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select p.anchor_id, p.positive_id, cast(row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.vec_id) as int) as rank,
  s.vec_id as negative_id, p.positive_score, s.score as negative_score
from positives p join scored s on p.anchor_id = s.anchor_id and not s.same
  and 80 * p.positive_score <= 100 * s.score and 100 * s.score <= 100 * p.positive_score
qualify rank <= 5
"""
