"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence.

A document's set are its distinct shingles of ``WORDS`` words, as 64-bit hashes.
Two sets link if 100 times their overlap is ``LINK`` times their union or more,
so a set of n links only where it shares ``least_overlap(n)`` of its n-grams:
all bounds below follow from the sizes.

1. Equal sets are one class (by 128 bits), so copies cost nothing.
2. Screening. Of a set's smallest hashes, half as many again as it may lack, those
   that no other class holds among its own are counted. A class with more of them than it may lack has
   no partner and goes. This drops most documents with one shuffle of about
   a quarter of the n-grams.
3. The rest is the incidence matrix. Of each row only the rarest n-grams are
   needed, one more than it may lack, to meet every partner in one column. Rows
   that share a column of these are in one block of the product; blocks are
   the components of that graph, so nothing outside a block can overlap enough.
4. In a block, overlaps of all its rows are accumulated column by column, in
   chunks of columns: few-row columns as pairs, others as dense products.
   Pairs whose sizes alone forbid a link, or whose overlap can't get there any
   more, are discarded. What leaves a block is a spanning forest of its links.

A block of more than ``ROWS`` rows or ``NGRAMS`` n-grams is dealt as pairs of parts over
many tasks, exactly. Before that, rows of large blocks are compared with the
first row of their columns; those that link are one component from then on, and parts
of one component aren't compared with each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spillspark.llm.common import byte_column, mix, slabs, word_bounds, word_hashes, written
from spillspark.llm.components import components

WORDS, LINK = 4, 85
ROWS, NGRAMS = 1024, 1 << 21  # of a part of a block
CHUNK = 4096  # columns of a dense product
FEW = 6  # rows of a column that is paired
LEAST_TASKS, TASK_ROWS = 8, 2000  # tasks of a stage after a shuffle, and the sets that are worth one

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.ones(256, bool)
_WORD[[9, 10, 11, 12, 13, 32]] = False
_STEP = np.uint64(0x9E3779B97F4A7C15)


def least_overlap(n):
    """What a set of ``n`` shares with any partner at least."""
    return (LINK * n + 99) // 100


def linked(overlap, n, m):
    return (100 + LINK) * overlap >= LINK * (n + m)


def sets_of(raw: np.ndarray, at: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, and their offsets per document."""
    start, end, bound = word_bounds(_WORD[raw], at)
    w = word_hashes(_LOWER[raw], start, end)
    n = np.diff(bound)
    count = np.where(n >= words, n - words + 1, np.minimum(n, 1))
    doc = np.repeat(np.arange(len(n)), count)
    first = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(bound[:-1], count)
    size = np.minimum(n, words)[doc]
    h = size.astype(np.uint64)
    for k in range(words):
        more = k < size
        h = np.where(more, mix(h * _STEP + w[np.minimum(first + k, max(len(w) - 1, 0))]), h) if len(w) else h
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])] if len(h) else np.zeros(0, bool)
    h, doc = h[new], doc[new]
    return h, np.r_[0, np.cumsum(np.bincount(doc, minlength=len(n)))]


def _keys(h: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit sums over each set."""
    out = []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        total = np.r_[np.uint64(0), np.cumsum(mix(h ^ np.uint64(salt)), dtype=np.uint64)]
        out.append((total[at[1:]] - total[at[:-1]]).view(np.int64))
    return out


def _lists(h: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(h.view(np.int64)))


def signed_sets(docs: DataFrame, words: int, screen: bool) -> DataFrame:
    """(doc_id, n, k1, k2, h): sizes and keys of the sets, and the hashes, or with ``screen`` only the smallest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slabs(batches):
            h, at = sets_of(*byte_column(batch.column("text")), words)
            n = np.diff(at)
            k1, k2 = _keys(h, at)
            if screen:
                spare = n - least_overlap(n) + 1
                take = np.minimum(n, spare + spare // 2)
                h = h[np.arange(len(h)) - np.repeat(at[:-1], n) < np.repeat(take, n)]
                at = np.r_[0, np.cumsum(take)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(k1), pa.array(k2), _lists(h, at)], ["doc_id", "n", "k1", "k2", "h"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n bigint, k1 bigint, k2 bigint, h array<bigint>")


def _tasks(rows: int) -> int:
    """Tasks for ``rows`` sets: a shuffle may have many more partitions than they fill."""
    return max(LEAST_TASKS, -(-rows // TASK_ROWS))


def survivors(table: DataFrame) -> DataFrame:
    """Classes (node, k1, k2, n, rep, alive) of the rows of ``signed_sets``; alive: what screening leaves. Written."""
    tasks = _tasks(table.count())
    classes = table.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n")).coalesce(tasks)
    # An n-gram whose smallest and largest class key agree is in no other class's list.
    held = table.select(F.explode("h").alias("h"), "k1").groupBy("h").agg(F.min("k1").alias("k1"), F.max("k1").alias("last"))
    alone = held.where("k1 = last").coalesce(tasks).groupBy("k1").agg(F.count(F.lit(1)).alias("alone"))
    spare = F.col("n") - F.expr(f"({LINK} * n + 99) div 100")
    alive = (F.col("n") > 0) & (F.coalesce("alone", F.lit(0)) <= spare)
    both = classes.join(alone, "k1", "left").coalesce(tasks)
    return written(both.select(F.monotonically_increasing_id().alias("node"), "k1", "k2", "n", "rep", alive.alias("alive")), "classes")


def rare_columns(sets: DataFrame) -> DataFrame:
    """(h, node): of each set the rarest n-grams that others hold, one more than it may lack besides those it has alone."""
    tasks = _tasks(sets.count())
    entries = sets.select(F.explode("h").alias("h"), "node")
    shared = entries.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    lists = entries.join(shared, "h").coalesce(tasks).groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("own"))
    need = sets.select("node", F.expr(f"({LINK} * n + 99) div 100").cast("int").alias("least"))
    own = lists.join(need, "node").where("size(own) >= least").coalesce(tasks)
    return own.select(F.explode(F.expr("transform(slice(own, 1, size(own) - least + 1), x -> x.h)")).alias("h"), "node")


def blocks(columns: DataFrame, tasks: int) -> tuple[DataFrame, DataFrame]:
    """Edges (node, first) to the first row of each column, and (node, block) of the components they make."""
    first = columns.groupBy("h").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    hung = columns.join(first.coalesce(tasks), "h").where("node <> first").select("node", "first").coalesce(tasks)
    edges = written(hung.distinct().coalesce(tasks), "edges")
    found = components(edges.select(F.col("node").alias("a"), F.col("first").alias("b")))
    return edges, written(found.select("node", F.col("component").alias("block")).coalesce(tasks), "blocks")


def _first_links(edges: DataFrame, members: DataFrame, large: DataFrame) -> DataFrame:
    """Links (a, b) of rows of large blocks with the smallest first row of their columns."""
    rows = members.join(large.select("block"), "block", "left_semi")
    one = edges.groupBy("node").agg(F.min("first").alias("first"))
    mine = rows.select("node", "n", "h").join(one, "node")
    other = rows.select(F.col("node").alias("first"), F.col("n").alias("m"), F.col("h").alias("g"))
    both = mine.join(other, "first").where(100 * F.least("n", "m") >= LINK * F.greatest("n", "m"))
    overlap = F.size(F.array_intersect("h", "g"))
    return written(both.where((100 + LINK) * overlap >= LINK * (F.col("n") + F.col("m"))).select(F.col("node").alias("a"), F.col("first").alias("b")), "first_links")


def dealt(members: DataFrame, sizes: DataFrame, large: DataFrame, known: DataFrame) -> DataFrame:
    """(block, i, j, part, node, n, h): rows by pairs of parts i <= j of their block.

    A large block's largest known component is cut into parts that aren't
    paired with each other; its other rows are paired with all.
    """
    parts = lambda rows, grams: F.greatest(F.ceil(rows / ROWS), F.ceil(grams / NGRAMS)).cast("int")
    usual = members.join(large.select("block"), "block", "left_anti").select("block", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("part"), "node", "n", "h")
    inside = members.join(large.select("block"), "block", "left_semi").join(known.select("node", F.col("component").alias("own")), "node", "left").withColumn("own", F.coalesce("own", "node"))
    counts = inside.groupBy("block", "own").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("grams"))
    main = counts.groupBy("block").agg(F.max(F.struct("rows", "own", "grams")).alias("m"))
    shape = main.join(sizes, "block").select(
        "block", F.col("m.own").alias("main"), parts(F.col("m.rows"), F.col("m.grams")).alias("mains"),
        parts(F.col("rows") - F.col("m.rows"), F.col("grams") - F.col("m.grams")).alias("others"),
    )
    at = inside.join(written(shape, "shape"), "block").withColumn("is_main", F.col("own") == F.col("main"))
    spread = lambda k: F.pmod(F.xxhash64("node"), F.greatest(k, F.lit(1))).cast("int")
    at = at.withColumn("part", F.when(F.col("is_main"), F.col("others") + spread(F.col("mains"))).otherwise(spread(F.col("others"))))
    upto = F.when(F.col("is_main"), F.col("others")).otherwise(F.col("others") + F.col("mains"))
    with_ = at.where(upto > 0).withColumn("x", F.explode(F.sequence(F.lit(0), upto - 1)))
    split = with_.select("block", F.least("part", "x").alias("i"), F.greatest("part", "x").alias("j"), "part", "node", "n", "h")
    return usual.unionByName(split)


def overlaps(rows: np.ndarray, cols: np.ndarray, left: np.ndarray, right: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Overlap counts of the rows ``left`` with the rows ``right``, exact where a link is possible.

    ``rows`` and ``cols``: the entries of the incidence; ``n``: sizes of the rows.
    """
    out = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(cols, kind="stable")
    rows, cols = rows[order], cols[order]
    new = np.flatnonzero(np.r_[True, cols[1:] != cols[:-1]]) if len(cols) else np.zeros(0, np.int64)
    size = np.diff(np.r_[new, len(cols)])
    number = np.repeat(np.arange(len(new)), size)
    to_left, to_right = np.full(len(n), -1), np.full(len(n), -1)
    to_left[left], to_right[right] = np.arange(len(left)), np.arange(len(right))
    few = (size > 1) & (size <= FEW)
    for d in range(1, FEW):
        e = np.flatnonzero(few[number[: len(cols) - d]] & (number[d:] == number[: len(cols) - d])) if len(cols) > d else np.zeros(0, np.int64)
        for a, b in ((rows[e], rows[e + d]), (rows[e + d], rows[e])):
            some = (to_left[a] >= 0) & (to_right[b] >= 0)
            np.add.at(out, (to_left[a[some]], to_right[b[some]]), 1)
    many = np.flatnonzero(size > FEW)
    open_ = (100 * np.minimum(n[left][:, None], n[right][None]) >= LINK * np.maximum(n[left][:, None], n[right][None]))
    rest = np.zeros(len(n), np.int64)
    entries = np.flatnonzero(size[number] > FEW)
    np.add.at(rest, rows[entries], 1)
    for c in range(0, len(many), CHUNK):
        most = out + np.minimum(rest[left][:, None], rest[right][None])
        open_ &= linked(most, n[left][:, None], n[right][None])
        if not open_.any():
            break
        own = many[c : c + CHUNK]
        place = np.full(len(size), -1)
        place[own] = np.arange(len(own))
        e = entries[place[number[entries]] >= 0]
        x = np.zeros((len(n), len(own)), np.float32)
        x[rows[e], place[number[e]]] = 1
        out += x[left] @ x[right].T
        np.subtract.at(rest, rows[e], 1)
    out[~open_] = 0
    return out


def spanning(near: np.ndarray, left: np.ndarray, right: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links: pairs of row numbers."""
    whole = np.zeros((rows, rows), bool)
    whole[np.ix_(left, right)] = near
    whole |= whole.T
    np.fill_diagonal(whole, False)
    rest, a, b = whole.any(1), [], []
    while rest.any():
        queue = [int(rest.argmax())]
        rest[queue[0]] = False
        while queue:
            x = queue.pop()
            found = np.flatnonzero(whole[x] & rest)
            rest[found] = False
            a.append(np.full(len(found), x))
            b.append(found)
            queue.extend(found.tolist())
    none = np.zeros(0, np.int64)
    return (np.concatenate(a) if a else none, np.concatenate(b) if b else none)


def _product(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Links (nodes) of a spanning forest of one pair of parts."""
    node, n, part = (np.asarray(group.column(c).combine_chunks()) for c in ("node", "n", "part"))
    h = group.column("h").combine_chunks()
    cols = np.asarray(h.flatten())
    if len(node) == 2 and group.column("i")[0] == group.column("j")[0]:
        shared = len(np.intersect1d(cols[: n[0]], cols[n[0] :], assume_unique=True))
        return (node[:1], node[1:]) if linked(shared, n[0], n[1]) else (node[:0], node[:0])
    i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
    left, right = np.flatnonzero(part == i), np.flatnonzero(part == j)
    near = linked(overlaps(np.repeat(np.arange(len(node)), n), cols, left, right, n), n[left][:, None], n[right][None])
    a, b = spanning(near, left, right, len(node))
    return node[a], node[b]


def links(rows: DataFrame) -> DataFrame:
    """Links (a, b): a spanning forest of each pair of parts of ``dealt``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        a: list[np.ndarray] = []
        b: list[np.ndarray] = []

        def close() -> None:
            if sum(x.num_rows for x in held) > 1:
                x, y = _product(pa.Table.from_batches(held))
                a.append(x)
                b.append(y)
            held.clear()

        def out() -> pa.RecordBatch:
            x, y = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (a, b))
            a.clear()
            b.clear()
            return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in ("block", "i", "j")])
            if held and (key[:, 0] != [held[0].column(c)[0].as_py() for c in ("block", "i", "j")]).any():
                close()
            new = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1
            for s, e in zip([0, *new.tolist()], [*new.tolist(), batch.num_rows], strict=True):
                held.append(batch.slice(s, e - s))
                if e < batch.num_rows:
                    close()
            yield out()
        close()
        yield out()

    keys = ["block", "i", "j"]
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(id, n_shingles, component_id), one row per input row.

    ``component_id`` is the smallest id reachable over links, itself included.
    A null, empty or wordless text has no shingles and links with nothing, not
    even its like; one of fewer than ``words`` words has one, its whole
    sequence. Texts may be of any length. Rows that repeat an id each get a
    row; a null id takes part in the links but names a component only where all
    ids are null. Other columns, whatever their names, are ignored; an empty
    table gives an empty result.
    """
    own = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    table = written(signed_sets(own, words, True), "sets")
    classes = survivors(table)
    alive = classes.where("alive").select("node", "k1", "k2", "rep")
    asked = alive.select(F.col("rep").alias("of")).distinct()
    texts = own.join(asked, own.doc_id.eqNullSafe(asked.of), "left_semi")
    whole = signed_sets(texts, words, False).drop("doc_id").join(alive.drop("rep"), ["k1", "k2"])
    tasks, rest = _tasks(table.count()), _tasks(alive.count())
    sets = written(whole.coalesce(tasks).dropDuplicates(["node"]).select("node", "n", "h").coalesce(rest), "incidence")
    edges, found = blocks(written(rare_columns(sets), "columns"), rest)
    members = written(sets.join(found, "node").select("block", "node", "n", "h").coalesce(rest), "members")
    sizes = written(members.groupBy("block").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("grams")).coalesce(rest), "sizes")
    large = sizes.where((F.col("rows") > ROWS) | ((F.col("grams") > NGRAMS) & (F.col("rows") > 2)))
    known = _first_links(edges, members, large)
    more = links(dealt(members, sizes, large, components(known)))
    roots = components(known.unionByName(more))
    named = classes.join(roots, classes.node == roots.node, "left").select("k1", "k2", "rep", F.coalesce("component", classes.node).alias("root")).coalesce(tasks)
    smallest = named.groupBy("root").agg(F.min("rep").alias("component"))
    by_key = named.join(smallest, "root").select("k1", "k2", "component").coalesce(tasks)
    both = table.select("doc_id", "n", "k1", "k2").join(by_key, ["k1", "k2"]).coalesce(tasks)
    return both.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))


#: The same by joining all shingles of all documents, in DuckDB SQL.
ORACLE = """
with recursive cut as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents)
, sets as materialized (
  select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 2), lambda i: array_to_string(list_slice(w, i, i + 3), ' ')) end) as s from cut)
, entries as materialized (select doc_id, len(s) as n, hash(unnest(s)) as h from sets)
, links as materialized (
  select a.doc_id as x, b.doc_id as y from entries a join entries b on a.h = b.h and a.doc_id < b.doc_id
  where 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  group by a.doc_id, b.doc_id having 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*)))
, around as materialized (select x, y from links union select y, x from links)
, reach as (select doc_id as x, doc_id as y from documents union select r.x, a.y from reach r join around a on r.y = a.x)
select s.doc_id, cast(len(s.s) as bigint) as n_shingles, r.component_id
from sets s join (select x, min(y) as component_id from reach group by x) r on s.doc_id = r.x
"""
