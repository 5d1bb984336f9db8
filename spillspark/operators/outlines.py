"""Polygons of components: boundary chains inside tiles, stitched over tile borders by list ranking.

A side between an oil pixel and its outside is directed so that the oil lies on
its left: west above a pixel, south on its left, east below, north on its
right. Each side has one successor. Where two pixels of a component touch at a
corner only, the boundary crosses over to the other pixel: as they are
connected elsewhere, rings then never touch themselves, so a component has
exactly one shell, and holes that touch at a corner are rings of their own.

Tiles are traced by themselves, with their neighbours' border pixels around
them; chains are cut at tile borders. Only these pieces go on: each finds its
successor by a join, then the smallest number on its ring and its place there
by pointer doubling, in as many rounds as the logarithm of a ring's pieces.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spillspark.functions import geo
from spillspark.operators.raster import TILE, affine
from spillspark.sources.workspace import written

STEPS = ((0, -1), (1, 0), (0, 1), (-1, 0))  # west, south, east, north: a left turn is the next one
#: Per direction: where the outside lies, and where the side starts, from the pixel.
OUTSIDE = (((-1, 0), (0, 1)), ((0, -1), (0, 0)), ((1, 0), (1, 0)), ((0, 1), (1, 1)))
CHAIN = "scene_id bigint, component bigint, r0 bigint, c0 bigint, d0 int, r1 bigint, c1 bigint, d1 int, closed boolean, twice bigint, sides bigint, points array<struct<r:bigint,c:bigint>>"
MAX_ROUNDS = 64


def chains(labelled: DataFrame, size: int = TILE) -> DataFrame:
    """Boundary pieces of components (scene_id, component, r, c), tile by tile, written with an ``id``.

    ``points``: the start and every corner, without the end; ``twice``: the sum
    of c * r' - c' * r over the piece's stretches; ``closed``: a whole ring.
    """
    own = labelled.select("scene_id", "component", F.col("r").cast("bigint").alias("r"), F.col("c").cast("bigint").alias("c"))
    tile = lambda r, c: F.struct(F.expr(f"{r} div {size}").alias("y"), F.expr(f"{c} div {size}").alias("x"))
    near = F.array(*[F.when((F.col("r") + dr >= 0) & (F.col("c") + dc >= 0), tile(f"(r + {dr})", f"(c + {dc})")) for dr, dc in ((0, 0), *STEPS)])
    spread = own.withColumn("t", F.explode(F.array_distinct(F.filter(near, lambda t: t.isNotNull()))))

    def trace(p: pd.DataFrame) -> pd.DataFrame:
        y, x = p.t.iloc[0]["y"], p.t.iloc[0]["x"]
        r, c, comp = (p[k].to_numpy() for k in ("r", "c", "component"))
        found = list(trace_tile(r, c, comp, int(y) * size, int(x) * size, size))
        out = pd.DataFrame(found, columns=[n.split()[0] for n in CHAIN.replace("r:bigint,c:bigint", "").split(", ")][1:])
        out.insert(0, "scene_id", p.scene_id.iloc[0])
        return out

    traced = spread.groupBy("scene_id", "t").applyInPandas(trace, CHAIN)
    return written(traced.withColumn("id", F.monotonically_increasing_id()), "chains")


def trace_tile(r: np.ndarray, c: np.ndarray, comp: np.ndarray, top: int, left: int, size: int):
    """Pieces of the boundary of a tile's own pixels, given these and their neighbours: tuples as in ``CHAIN``."""
    above, before, width = r.min() - 1, c.min() - 1, int(c.max() - c.min()) + 4
    pixel = lambda y, x: (y - above) * width + x - before
    there = np.sort(pixel(r, c))
    mine = (r // size * size == top) & (c // size * size == left)
    r, c, comp = r[mine], c[mine], comp[mine]
    parts = []
    for d, ((dr, dc), (sr, sc)) in enumerate(OUTSIDE):
        key = pixel(r + dr, c + dc)
        taken = there[np.minimum(np.searchsorted(there, key), len(there) - 1)] == key
        parts.append((comp[~taken], r[~taken] + sr, c[~taken] + sc, np.full((~taken).sum(), d)))
    comp, r, c, d = (np.concatenate(x) for x in zip(*parts, strict=True))
    if not len(comp):
        return
    step = np.array(STEPS)
    er, ec = r + step[d, 0], c + step[d, 1]
    # Successor: the side of the same component that starts where this one ends.
    names, number = np.unique(comp, return_inverse=True)
    place = lambda y, x: (number * (size + 1) + y - top) * (size + 1) + x - left
    start, end = place(r, c), place(er, ec)
    order = np.lexsort((d, start))
    at = np.searchsorted(start[order], end)
    cut = (er % size == 0) | (ec % size == 0)
    at = np.where(cut, 0, at)
    after = order[at]
    second = order[np.minimum(at + 1, len(order) - 1)]
    crossing = (d + 3) % 4
    after = np.where((start[second] == end) & (d[second] == crossing) & (d[after] != crossing), second, after)
    begins = (r % size == 0) | (c % size == 0)
    nxt, d_, r_, c_ = np.where(cut, -1, after).tolist(), d.tolist(), r.tolist(), c.tolist()
    seen = bytearray(len(nxt))
    for closed, firsts in ((False, np.flatnonzero(begins)), (True, np.arange(len(nxt)))):
        for first in firsts.tolist():
            if seen[first]:
                continue
            points, now, last, twice, sides = [], first, None, 0, 0
            while now >= 0 and not seen[now]:
                seen[now] = 1
                if last is None or d_[now] != d_[last]:
                    points.append({"r": r_[now], "c": c_[now]})
                last, sides = now, sides + 1
                dr, dc = STEPS[d_[now]]
                twice += c_[now] * (r_[now] + dr) - (c_[now] + dc) * r_[now]
                now = nxt[now]
            dr, dc = STEPS[d_[last]]
            yield int(names[number[first]]), r_[first], c_[first], d_[first], r_[last] + dr, c_[last] + dc, d_[last], closed, twice, sides, points


def stitched(pieces: DataFrame) -> DataFrame:
    """``pieces`` of ``chains`` with ``ring`` (a number) and ``place`` (their order on it)."""
    open_ = pieces.where("not closed").select("scene_id", "component", "id", "r0", "c0", "d0", "r1", "c1", "d1")
    ends = open_.select("scene_id", "component", "id", F.col("r1").alias("r"), F.col("c1").alias("c"), "d1")
    starts = open_.select("scene_id", "component", F.col("id").alias("next"), F.col("r0").alias("r"), F.col("c0").alias("c"), "d0")
    straight = F.when(F.col("d0") == (F.col("d1") + 3) % 4, 0).otherwise(1)  # crossing over comes first
    links = written(ends.join(starts, ["scene_id", "component", "r", "c"]).groupBy("id").agg(F.min_by("next", straight).alias("next")), "links")

    def doubled(now: DataFrame, value: str, merge, done, name: str) -> DataFrame:
        for _ in range(MAX_ROUNDS):
            ahead = now.select(F.col("id").alias("jump"), F.col("jump").alias("further"), F.col(value).alias("theirs"))
            both = now.join(ahead, "jump").withColumn("was", F.col(value)).withColumn(value, merge(F.col(value), F.col("theirs")))
            now = written(both.select("id", F.col("jump").alias("from"), F.col("further").alias("jump"), value, "was"), name)
            if not now.where(~done).limit(1).count():
                return now
            now = now.select("id", "jump", value)
        raise RuntimeError("rings did not settle")

    # The smallest number on the ring: unchanged everywhere means that all of it was seen.
    low = doubled(links.select("id", F.col("next").alias("jump"), F.col("id").alias("low")), "low", F.least, F.col("low") == F.col("was"), "rings").select("id", "low")
    # The number of steps to that piece, where the pointers come to rest.
    rest = F.col("id") == F.col("low")
    steps = links.join(low, "id").select("id", F.when(rest, F.col("id")).otherwise(F.col("next")).alias("jump"), F.when(rest, 0).otherwise(1).cast("bigint").alias("steps"))
    placed = doubled(steps, "steps", lambda a, b: a + b, F.col("jump") == F.col("from"), "places").select("id", "steps")
    order = low.join(placed, "id").select("id", F.col("low").alias("ring"), F.when(F.col("steps") > 0, -F.col("steps")).otherwise(F.lit(-(1 << 62))).alias("place"))
    return pieces.join(order, "id", "left").withColumns({"ring": F.coalesce("ring", "id"), "place": F.coalesce("place", F.lit(0))})


def rings(labelled: DataFrame, size: int = TILE) -> DataFrame:
    """(scene_id, component, ring, is_shell, twice, sides, points): closed rings, corners only, the first one again at the end.

    ``twice``: twice the enclosed pixels, positive for shells, negative for holes. A ring is one row:
    that is the output asked for, and its size.
    """
    whole = stitched(chains(labelled, size)).groupBy("scene_id", "component", "ring").agg(
        (-F.sum("twice")).alias("twice"), F.sum("sides").alias("sides"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", "points"))), lambda p: p["points"])).alias("p")
    )
    before = lambda i: F.get("p", F.pmod(i - 1 + F.size("p"), F.size("p")))
    after = lambda i: F.get("p", F.pmod(i + 1, F.size("p")))
    # Where pieces meet the boundary may go straight on.
    corner = lambda x, i: ~(((before(i)["r"] == x["r"]) & (x["r"] == after(i)["r"])) | ((before(i)["c"] == x["c"]) & (x["c"] == after(i)["c"])))
    corners = whole.withColumn("p", F.filter("p", corner))
    return corners.select("scene_id", "component", "ring", (F.col("twice") > 0).alias("is_shell"), "twice", "sides", F.concat("p", F.slice("p", 1, 1)).alias("points"))


def polygons(found: DataFrame, transform: tuple[float, ...]) -> DataFrame:
    """(scene_id, component, n_holes, n_points, polygon): a shell with its holes, under an affine map.

    ``polygon``: array of rings of [x, y], the shell first, holes by their first corner.
    """

    def mapped(p: Column) -> Column:
        x, y = affine(p["r"], p["c"], *transform)
        return F.array(x, y)

    lines = found.select("scene_id", "component", "is_shell", F.size("points").alias("n"), F.transform("points", mapped).alias("line"))
    whole = lines.groupBy("scene_id", "component").agg(F.array_sort(F.collect_list(F.struct((~F.col("is_shell")).alias("hole"), "line"))).alias("l"), F.sum("n").alias("n_points"))
    return whole.select("scene_id", "component", (F.size("l") - 1).cast("bigint").alias("n_holes"), "n_points", F.transform("l", lambda x: x["line"]).alias("polygon"))


def multipolygons(shapes: DataFrame) -> DataFrame:
    """One GeoJSON MultiPolygon per scene, components by their first pixel: one document, as asked for."""
    parts = shapes.groupBy("scene_id").agg(F.array_sort(F.collect_list(F.struct("component", "polygon"))).alias("p"))
    told = F.struct(F.lit("MultiPolygon").alias("type"), F.transform("p", lambda x: x["polygon"]).alias("coordinates"))
    return parts.select("scene_id", F.to_json(told).alias("document"))


def measures(pieces: DataFrame, transform: tuple[float, ...], geographic: bool = False) -> DataFrame:
    """(scene_id, component, area_m2, perimeter_m): Green's theorem over the pieces of ``chains``.

    With ``geographic`` the map's coordinates are degrees, and each corner is
    projected to EPSG:3857 before summing. Only sums leave a piece.
    """
    x0, y0 = ground(F.lit(float(transform[2])), F.lit(float(transform[5])), geographic)

    def placed(p: Column) -> Column:
        x, y = ground(*affine(p["r"], p["c"], *transform), geographic)
        return F.struct((x - x0).alias("x"), (y - y0).alias("y"))

    end = F.array(F.struct(F.col("r1").alias("r"), F.col("c1").alias("c")))
    way = pieces.select("scene_id", "component", F.transform(F.concat("points", end), placed).alias("w"))
    sums = way.select("scene_id", "component", F.aggregate(geo.edges(F.col("w")), F.lit(0.0), lambda s, e: s + e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]).alias("twice"), geo.ring_length(F.col("w")).alias("length"))
    return sums.groupBy("scene_id", "component").agg((F.abs(F.sum("twice")) / 2).alias("area_m2"), F.sum("length").alias("perimeter_m"))


def ground(x: Column, y: Column, geographic: bool) -> tuple[Column, Column]:
    """Metres on the plane: map coordinates as they are, or degrees through EPSG:3857."""
    return geo.to_mercator(x, y) if geographic else (x, y)
