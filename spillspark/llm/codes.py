"""Vector codes: product quantisation with exact integers, pruned by LAESA pivots.

Vectors are cut into equal parts; each part position has a codebook, refined in
rounds of nearest-entry assignment. ``PIVOTS`` fixed points per part position
are chosen once, farthest first among the starting entries. The distances of
every part to them are computed once and written beside the vectors; in each
round only the entries' distances to the pivots are new. By the triangle
inequality the largest difference of the two is a lower bound of the distance
of part and entry: entries are taken in the order of their bounds, and once a
bound is beyond the best distance found no exact distance is evaluated any more.
Exact distances are sums of squared integers; ``n_exact`` counts them.

A round's sums are made per task, one row per entry, and added by Spark; the
codebooks (parts x entries x width integers, whatever the number of vectors) are
all that reaches the driver and goes back to the tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spillspark.llm.common import written
from spillspark.llm.vectors import flat, integers, matrix, usable, width_of

PARTS, ENTRIES, ROUNDS = 16, 64, 2
PIVOTS = 4
SLAB = 4096  # vectors at a time
_TOP = np.iinfo(np.int64).max


def pivots_of(book: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    """Entries of ``book`` that lie far apart: the first, then always the farthest from those chosen."""
    chosen = [0]
    while len(chosen) < min(count, len(book)):
        gap = ((book[:, None] - book[chosen][None]) ** 2).sum(2).min(1)
        chosen.append(int(gap.argmax()))
    return book[chosen]


def far_from(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(((points[:, None] - pivots[None]) ** 2).sum(2).astype(np.float64))


def nearest(points: np.ndarray, far: np.ndarray, book: np.ndarray, hub: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest entry (lower index on ties), squared distance, and exact evaluations, of each point.

    ``far`` and ``hub``: distances of the points and of the entries to the pivots.
    """
    bound = np.zeros((len(points), len(book)))
    for p in range(far.shape[1]):
        apart = np.abs(far[:, p, None] - hub[None, :, p])
        # Roots are rounded: a bound may only be too low.
        np.maximum(bound, apart - 1e-9 * (far[:, p, None] + hub[None, :, p]), out=bound)
    bound *= bound
    order = np.argsort(bound, axis=1, kind="stable")
    best, found, spent = np.full(len(points), _TOP), np.full(len(points), len(book)), np.zeros(len(points), np.int64)
    live = np.arange(len(points))
    for step in range(len(book)):
        e = order[live, step]
        open_ = bound[live, e] <= best[live]
        live, e = live[open_], e[open_]
        if not len(live):
            break
        d = ((points[live] - book[e]) ** 2).sum(1)
        better = (d < best[live]) | ((d == best[live]) & (e < found[live]))
        best[live[better]], found[live[better]] = d[better], e[better]
        spent[live] += 1
    return found, best, spent


def _assigned(batches: Iterator[pa.RecordBatch], books: np.ndarray, pivots: list[np.ndarray]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Batches with their integers (rows, parts, width) and entries, squared distances and evaluations (rows, parts)."""
    parts, _, width = books.shape
    hubs = [far_from(books[p], pivots[p]) for p in range(parts)]
    for whole in batches:
        for a in range(0, whole.num_rows, SLAB):
            batch = whole.slice(a, SLAB)
            v = matrix(batch.column("v"), parts * width).astype(np.int64).reshape(-1, parts, width)
            far = matrix(batch.column("far"), parts * len(pivots[0])).reshape(-1, parts, len(pivots[0]))
            own = [nearest(v[:, p], far[:, p], books[p], hubs[p]) for p in range(parts)]
            yield batch, v, *(np.stack([o[i] for o in own], axis=1) for i in range(3))


def refined(rows: DataFrame, books: np.ndarray, pivots: list[np.ndarray]) -> np.ndarray:
    """The codebooks after one round: means of the assigned parts, rounded down; unused entries stay."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for _, v, code, _, _ in _assigned(batches, books, pivots):
            slot = (code + entries * np.arange(parts)).ravel()
            counts += np.bincount(slot, minlength=len(counts))
            np.add.at(sums, slot, v.reshape(-1, width))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some]), *[pa.array(sums[some, i]) for i in range(width)]], ["slot", "n", *[f"s{i}" for i in range(width)]])

    made = rows.select("v", "far").mapInArrow(run, "slot bigint, n bigint, " + ", ".join(f"s{i} bigint" for i in range(width)))
    total = made.groupBy("slot").agg(*[F.sum(c).alias(c) for c in made.columns[1:]])
    out = books.reshape(-1, width).copy()
    for r in total.collect():  # parts x entries rows at most
        out[r.slot] = [s // r.n for s in r[2:]]
    return out.reshape(books.shape)


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """One row per vector: its id, code, error, label_error, codebooks_sha256, n_exact.

    ``code`` has two hex digits per part; ``error`` sums the squared distances
    of parts and entries, ``label_error`` the errors of all rows of the same
    label (nulls together), ``n_exact`` counts the exact distances evaluated
    for the last assignment.

    Rows whose vector is null, or holds null or non-finite components, are
    dropped; so are all when none is left, and the result is empty, as for an
    empty table. Null ids come after all others and rows that repeat an id, in
    whole or not, are rows of their own (by their components among one id).
    Ties go to the lower entry. With fewer rows than ``entries`` the codebooks are smaller. Vectors
    of different lengths, of a length that ``parts`` doesn't divide, or with a
    component of 65,536 or more are an error. Other columns, whatever their
    names, are ignored.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits per part")
    kept = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v")).where(usable(F.col("v")))
    kept = kept.select("id", "label", integers(F.col("v")).alias("v"))
    first = kept.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    names = [id_col, "code", "error", "label_error", "codebooks_sha256", "n_exact"]
    if not first:
        empty = kept.select("id", F.lit("").alias("code"), *[F.lit(0).cast("bigint").alias(c) for c in ("error", "label_error")], F.lit("").alias("codebooks_sha256"), F.lit(0).cast("bigint").alias("n_exact"))
        return empty.limit(0).toDF(*names)
    size = {len(r.v) for r in first}
    if len(size) > 1 or min(size) == 0 or min(size) % parts:
        raise ValueError(f"vectors need one length, a multiple of {parts}: {sorted(size)}")
    width = min(size) // parts
    books = np.array([r.v for r in first], np.int64).reshape(-1, parts, width).transpose(1, 0, 2).copy()
    pivots = [pivots_of(b) for b in books]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column("v"), parts * width).astype(np.int64).reshape(-1, parts, width)
            far = np.concatenate([far_from(v[:, p], pivots[p]) for p in range(parts)], axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, flat(far)], ["id", "label", "v", "far"])

    kind = kept.schema["label"].dataType.simpleString()
    table = written(kept.mapInArrow(measure, f"id bigint, label {kind}, v array<int>, far array<double>"), "parts")
    for _ in range(rounds):
        books = refined(table, books, pivots)
    last = books

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, code, error, spent in _assigned(batches, last, pivots):
            text = [row.tobytes().hex() for row in code.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(text, pa.string()), pa.array(error.sum(1)), pa.array(spent.sum(1))], ["id", "label", "code", "error", "n_exact"])

    coded = written(table.mapInArrow(encode, f"id bigint, label {kind}, code string, error bigint, n_exact bigint"), "codes")
    # Written, so that the planner knows its size: sent to all tasks if it is small, else joined by key.
    sums = written(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "label_errors")
    both = coded.join(sums, coded.label.eqNullSafe(sums.of))
    return both.select("id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"), "n_exact").toDF(*names)


def _oracle() -> str:
    """The same by comparing every part with every entry, in DuckDB SQL."""
    books = """
, book0 as materialized (select p, row_number() over (partition by p order by vec_id) - 1 as e, part as entry from parts where vec_id in (select vec_id from kept order by vec_id limit 64))"""
    for k in range(ROUNDS):
        books += f"""
, near{k} as materialized (
  select a.vec_id, a.p, any_value(a.part) as part, min(cast(list_sum(list_transform(list_zip(a.part, b.entry), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as bigint) * 64 + b.e) as best
  from parts a join book{k} b using (p) group by a.vec_id, a.p)
, sums{k} as materialized (
  select p, e, i, sum(x) as s, count(*) as n
  from (select p, best % 64 as e, unnest(part) as x, unnest(range(1, len(part) + 1)) as i from near{k}) group by p, e, i)
, mean{k} as materialized (
  select p, e, list(cast((s - ((s % n) + n) % n) / n as bigint) order by i) as entry from sums{k} group by p, e)
, book{k + 1} as materialized (
  select b.p, b.e, coalesce(m.entry, b.entry) as entry from book{k} b left join mean{k} m on b.p = m.p and b.e = m.e)"""
    return f"""
with kept as materialized (
  select vec_id, label, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)
, parts as materialized (
  select vec_id, label, p, list_slice(v, p * (len(v) // 16) + 1, (p + 1) * (len(v) // 16)) as part
  from kept, (select unnest(range(16)) as p)){books}
, last as materialized (
  select a.vec_id, a.p, any_value(a.label) as label, min(cast(list_sum(list_transform(list_zip(a.part, b.entry), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as bigint) * 64 + b.e) as best
  from parts a join book{ROUNDS} b using (p) group by a.vec_id, a.p)
, coded as (
  select vec_id, any_value(label) as label, string_agg(printf('%02x', best % 64), '' order by p) as code, cast(sum(best // 64) as bigint) as error
  from last group by vec_id)
, hash as (
  select sha256(string_agg(array_to_string(entry, ','), ',' order by p, e)) as codebooks_sha256 from book{ROUNDS})
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256 from coded, hash
"""


ORACLE = _oracle()
