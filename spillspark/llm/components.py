"""Connected components of a link table, as a loop of DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spillspark.llm.common import written

MAX_ROUNDS = 60
LEAST_PARTS, PART_EDGES = 8, 50_000


def components(links: DataFrame) -> DataFrame:
    """Smallest node reachable from each node that has a link.

    ``links``: columns a, b (long), either direction, repeats allowed.
    Returns node, component. Alternates large-star and small-star steps: every
    node's neighbours are hung onto the smallest of them, until the edges are
    stars. Edges only, at most one per node and round survives, so a group of any size
    stays linear; min() combines before its shuffle, so a hub doesn't meet in
    one task. Each round is written to the shared folder. Its stages have as many
    tasks as its edges need, however many partitions a shuffle has.
    """
    edges = written(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links"
    )
    for _ in range(MAX_ROUNDS):
        count, stars = _shape(edges)
        if stars:
            break
        parts = max(LEAST_PARTS, -(-count // PART_EDGES))
        edges = written(_small_star(_large_star(edges, parts), parts), "links")
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _shape(edges: DataFrame) -> tuple[int, bool]:
    """Number of edges, and whether all hang on roots: each node on one, and none on a node that hangs itself."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    row = nodes.agg(F.sum("up").alias("n"), F.max((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).alias("open")).first()
    return row.n or 0, not row.open


def _large_star(edges: DataFrame, parts: int) -> DataFrame:
    """Each node links its larger neighbours to its smallest neighbour or itself."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    hung = both.where("v > u").join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.coalesce(parts).distinct().coalesce(parts)


def _small_star(edges: DataFrame, parts: int) -> DataFrame:
    """Each node links its smaller neighbours and itself to the smallest of them."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    hung = edges.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(low.select("u", F.col("m").alias("v"))).coalesce(parts).distinct().coalesce(parts)
