"""Radar rasters as pixel and tile tables: calibration, statistics, components, outlines."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spillspark.functions import geo
from spillspark.sources.workspace import shared_folder

# Thresholds, floors and sizes of the detection chain.
OIL, CORE = 0.50, 0.70
NO_SIGNAL_DB, TOP_DB = -50.0, 5.0
SCALE = 16
TILE = 512


# -- calibration --------------------------------------------------------------


def lut_cells(lut: DataFrame) -> DataFrame:
    """Cells between neighbouring nodes of a calibration table (scene_id, pol, line, pixel, a_sigma)."""
    w = Window.partitionBy("scene_id", "pol", "line").orderBy("pixel")
    right = lut.withColumns({"x1": F.lead("pixel").over(w), "z01": F.lead("a_sigma").over(w)}).where("x1 is not null")
    down = Window.partitionBy("scene_id", "pol", "pixel").orderBy("line")
    cells = right.withColumns({"y1": F.lead("line").over(down), "z10": F.lead("a_sigma").over(down), "z11": F.lead("z01").over(down)}).where("y1 is not null")
    return cells.select("scene_id", "pol", F.col("line").alias("y0"), "y1", F.col("pixel").alias("x0"), "x1", F.col("a_sigma").alias("z00"), "z01", "z10", "z11")


def calibrate(pixels: DataFrame, lut: DataFrame, dn: str = "dn") -> DataFrame:
    """Adds ``a`` (bilinear, clamped) and ``db`` = 10 log10(max(dn^2 / a^2, 1e-7)); dn <= 0 is -50 dB.

    A pixel finds its cell by the numbers of its row and column among the
    nodes, so the join is one of equality. Node lists are one row per scene.
    """
    nodes = lut.groupBy("scene_id", "pol").agg(F.array_sort(F.collect_set("line")).alias("ys"), F.array_sort(F.collect_set("pixel")).alias("xs"))
    cells = lut_cells(lut).join(nodes, ["scene_id", "pol"]).withColumns({"iy": F.array_position("ys", F.col("y0")) - 1, "ix": F.array_position("xs", F.col("x0")) - 1}).drop("ys", "xs")
    at = pixels.join(nodes, ["scene_id", "pol"])
    for i, axis, value in (("iy", "ys", "r"), ("ix", "xs", "c")):
        at = at.withColumn(i, _cell(axis, value))
    both = at.drop("ys", "xs").join(cells, ["scene_id", "pol", "iy", "ix"])
    t = lambda v, lo, hi: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(v) - F.col(lo)) / (F.col(hi) - F.col(lo))))
    both = both.withColumns({"tx": t("c", "x0", "x1"), "ty": t("r", "y0", "y1")})
    low = F.col("z00") * (1 - F.col("tx")) + F.col("z01") * F.col("tx")
    high = F.col("z10") * (1 - F.col("tx")) + F.col("z11") * F.col("tx")
    out = both.withColumn("a", low * (1 - F.col("ty")) + high * F.col("ty"))
    return out.withColumn("db", decibels(F.col(dn), F.col("a"))).drop("iy", "ix", "y0", "y1", "x0", "x1", "z00", "z01", "z10", "z11", "tx", "ty")


def _cell(axis: str, value: str) -> Column:
    below = F.size(F.filter(axis, lambda a: a <= F.col(value)))
    return F.greatest(F.lit(0), F.least(below - 1, F.size(axis) - 2)).cast("bigint")


def decibels(dn: Column, a: Column) -> Column:
    return F.when(dn > 0, 10 * F.log10(F.greatest(dn * dn / (a * a), F.lit(1e-7)))).otherwise(NO_SIGNAL_DB)


def normalise(db: Column) -> Column:
    """NaN and -inf to -50, +inf to 5, clipped and scaled to [0, 1]."""
    whole = F.when(F.isnan(db) | (db == float("-inf")), NO_SIGNAL_DB).when(db == float("inf"), TOP_DB).otherwise(db)
    return (F.greatest(F.lit(NO_SIGNAL_DB), F.least(F.lit(TOP_DB), whole)) - NO_SIGNAL_DB) / (TOP_DB - NO_SIGNAL_DB)


# -- statistics ---------------------------------------------------------------


def masks(pixels: DataFrame) -> DataFrame:
    """Adds valid (both signals positive), oil and core, gated by valid."""
    valid = (F.col("vv") > 0) & (F.col("vh") > 0)
    return pixels.withColumns({"valid": valid, "oil": valid & (F.col("prob") >= OIL), "core": valid & (F.col("prob") >= CORE)})


def mask_counts(masked: DataFrame) -> DataFrame:
    """Pixels by kind per scene and their percentages of valid pixels (null without any)."""
    n = masked.groupBy("scene_id").agg(
        F.count(F.lit(1)).alias("n_pixels"), F.count_if("valid").alias("n_valid"), F.count_if("oil").alias("n_oil"), F.count_if("core").alias("n_core")
    )
    share = lambda c: F.round(F.try_divide(100.0 * F.col(c), F.col("n_valid").cast("double")), 4)
    return n.withColumns({"n_invalid": F.col("n_pixels") - F.col("n_valid"), "oil_percent": share("n_oil"), "core_percent": share("n_core")})


def scene_stats(pixels: DataFrame, threshold: float = OIL) -> DataFrame:
    return pixels.groupBy("scene_id").agg(
        F.min("prob").alias("p_min"), F.max("prob").alias("p_max"), F.avg("prob").alias("p_mean"), F.sum("prob").alias("p_sum"), F.count_if(F.col("prob") >= threshold).alias("n_oil")
    )


PERCENTILES = (0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99)
BINS = 4096


def percentiles(pixels: DataFrame, exact: bool = True, accuracy: int = 10_000) -> DataFrame:
    """Percentiles 10 to 99 of the probability per scene, between neighbours by share.

    The exact form finds by a histogram of the scene in which bin each wanted
    rank lies; only the distinct values of those bins are then counted. The
    other form is approximate.
    """
    names = [f"p{round(100 * x)}" for x in PERCENTILES]
    if not exact:
        made = F.percentile_approx("prob", list(PERCENTILES), accuracy)
        return pixels.groupBy("scene_id").agg(made.alias("p")).select("scene_id", *[F.get("p", i).alias(n) for i, n in enumerate(names)])
    binned = pixels.where("prob is not null").select("scene_id", "prob", F.floor(F.col("prob") * BINS).alias("bin"))
    scene = Window.partitionBy("scene_id")
    hist = binned.groupBy("scene_id", "bin").agg(F.count(F.lit(1)).alias("c"))
    hist = hist.withColumns({"upto": F.sum("c").over(scene.orderBy("bin")), "n": F.sum("c").over(scene)})
    ranks = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), (F.lit(x) * (F.col("n") - 1)).alias("at")) for n, x in zip(names, PERCENTILES, strict=True)]))
    ends = F.explode(F.array(*[F.struct((F.floor("w.at") + k).alias("rank"), F.abs(1 - k - F.col("w.at") + F.floor("w.at")).alias("share")) for k in (0, 1)]))
    wanted = hist.select("scene_id", "bin", "c", "upto", ranks.alias("w")).select("scene_id", "bin", "c", "upto", "w.name", ends.alias("e"))
    wanted = wanted.select("scene_id", "bin", "name", "e.share", (F.col("e.rank") - F.col("upto") + F.col("c")).alias("k"), "c").where("k >= 0 and k < c and share > 0")
    values = binned.join(wanted.select("scene_id", "bin").distinct(), ["scene_id", "bin"], "left_semi").groupBy("scene_id", "bin", "prob").agg(F.count(F.lit(1)).alias("m"))
    values = values.withColumn("to", F.sum("m").over(Window.partitionBy("scene_id", "bin").orderBy("prob")))
    found = wanted.join(values, ["scene_id", "bin"]).where("k >= to - m and k < to")
    return found.groupBy("scene_id").agg(*[F.sum(F.when(F.col("name") == n, F.col("share") * F.col("prob"))).alias(n) for n in names])


def downsample(pixels: DataFrame, scale: int = SCALE) -> DataFrame:
    """Every ``scale``-th row and column of the whole scene."""
    return pixels.where((F.col("r") % scale == 0) & (F.col("c") % scale == 0)).withColumns({"r": F.expr(f"r div {scale}"), "c": F.expr(f"c div {scale}")})


def overlap_average(tiles: DataFrame) -> DataFrame:
    """Mean probability where tiles overlap."""
    return tiles.groupBy("scene_id", "r", "c").agg(F.avg("prob").alias("prob"))


def affine(r: Column, c: Column, a: float, b: float, x0: float, d: float, e: float, y0: float) -> tuple[Column, Column]:
    """Column and row to coordinates."""
    return a * c + b * r + x0, d * c + e * r + y0


def mask_geometry(mask: DataFrame, transform: tuple[float, float, float, float, float, float], geographic: bool = False) -> DataFrame:
    """Area, perimeter, centroid and box of the oil pixels (scene_id, r, c, is_oil), per scene.

    ``transform``: see ``affine``; it may turn and shear. Centroid and box are
    in the map's coordinates. With ``geographic`` these are degrees, and area and perimeter
    are taken in EPSG:3857. Both are sums over the sides without an oil neighbour,
    found by a join with the shifted pixels: lengths, and the area by Green's theorem.
    """
    oil = mask.where("is_oil = 1").select("scene_id", F.col("r").cast("bigint").alias("r"), F.col("c").cast("bigint").alias("c"))
    # Where the neighbour lies, and the side's ends, with oil on its left.
    around = ((-1, 0, 0, 1, 0, 0), (0, -1, 0, 0, 1, 0), (1, 0, 1, 0, 1, 1), (0, 1, 1, 1, 0, 1))
    side = F.explode(F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(("dr", "dc", "ar", "ac", "br", "bc"), x, strict=True)]) for x in around]))
    sides = oil.withColumn("n", side).select("scene_id", (F.col("r") + F.col("n.dr")).alias("r"), (F.col("c") + F.col("n.dc")).alias("c"), *[(F.col(k[1]) + F.col(f"n.{k}")).alias(k) for k in ("ar", "ac", "br", "bc")])
    open_ = sides.join(oil, ["scene_id", "r", "c"], "left_anti")
    metres = geo.to_mercator if geographic else lambda x, y: (x, y)
    # Relative to the map's origin: sums keep their digits.
    x0, y0 = metres(F.lit(float(transform[2])), F.lit(float(transform[5])))
    for k in "ab":
        x, y = metres(*affine(F.col(f"{k}r"), F.col(f"{k}c"), *transform))
        open_ = open_.withColumns({f"{k}x": x - x0, f"{k}y": y - y0})
    measured = open_.groupBy("scene_id").agg(
        (F.abs(F.sum(F.col("ax") * F.col("by") - F.col("bx") * F.col("ay"))) / 2).alias("area_m2"), F.sum(F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))).alias("perimeter_m")
    )
    corners = [affine(F.col("r") + i, F.col("c") + j, *transform) for i in (0, 1) for j in (0, 1)]
    xs, ys = [x for x, _ in corners], [y for _, y in corners]
    sums = oil.groupBy("scene_id").agg(
        F.count(F.lit(1)).alias("pixel_count"), F.avg("c").alias("mc"), F.avg("r").alias("mr"),
        F.min(F.least(*xs)).alias("x_min"), F.min(F.least(*ys)).alias("y_min"), F.max(F.greatest(*xs)).alias("x_max"), F.max(F.greatest(*ys)).alias("y_max"),
    )
    centre = affine(F.col("mr") + 0.5, F.col("mc") + 0.5, *transform)
    scenes = mask.select("scene_id").distinct()
    return scenes.join(sums, "scene_id", "left").join(measured, "scene_id", "left").select(
        "scene_id",
        F.col("pixel_count").isNotNull().alias("has_oil"),
        F.coalesce("pixel_count", F.lit(0)).alias("pixel_count"),
        F.coalesce("area_m2", F.lit(0.0)).alias("area_m2"),
        F.coalesce("perimeter_m", F.lit(0.0)).alias("perimeter_m"),
        centre[0].alias("centroid_x"), centre[1].alias("centroid_y"),
        "x_min", "y_min", "x_max", "y_max",
    )


def co_registered(prob: DataFrame, vv: DataFrame, vh: DataFrame) -> DataFrame:
    """Probability, VV and VH rasters (scene_id, r, c, value) of one grid as one pixel table: the pixels that all have."""
    on = ["scene_id", "r", "c"]
    return prob.withColumnRenamed("value", "prob").join(vv.withColumnRenamed("value", "vv"), on).join(vh.withColumnRenamed("value", "vh"), on)


# -- tiles --------------------------------------------------------------------


def tile_grid(scenes: DataFrame, size: int = TILE) -> DataFrame:
    """Tiles of each scene (scene_id, height, width) with their valid sizes and padding."""
    t = scenes.withColumn("row_off", F.explode(F.sequence(F.lit(0), F.col("height") - 1, F.lit(size)))).withColumn("col_off", F.explode(F.sequence(F.lit(0), F.col("width") - 1, F.lit(size))))
    t = t.withColumns({"valid_h": F.least(F.lit(size), F.col("height") - F.col("row_off")), "valid_w": F.least(F.lit(size), F.col("width") - F.col("col_off"))})
    return t.withColumns({"pad_h": size - F.col("valid_h"), "pad_w": size - F.col("valid_w")})


Predictor = Callable[[np.ndarray, np.ndarray], np.ndarray]


def corner_predictor(vv: np.ndarray, vh: np.ndarray) -> np.ndarray:
    """Probability 0.95 at the first pixel, 0 elsewhere."""
    p = np.zeros(vv.shape)
    p[0, 0] = 0.95
    return p


def score_tiles(tiles: DataFrame, make_predictor: Callable[[], Predictor], size: int = TILE, threshold: float = OIL) -> DataFrame:
    """Probability and mask per pixel of tile rows (scene_id, row_off, col_off, valid_h, valid_w, vv, vh).

    The predictor is made once per task. Tiles at the edge are padded by
    reflection to ``size`` and cut back. Rows stream through, tile by tile. With
    a column ``at`` (numbers of the pixels in ``vv`` and ``vh``, row by row) a tile
    may lack pixels: they are zero to the predictor and get no row.
    """
    fields = ["scene_id", "row_off", "col_off", "valid_h", "valid_w", "vv", "vh", *(["at"] if "at" in tiles.columns else [])]

    def band(values: np.ndarray, at: np.ndarray, h: int, w: int) -> np.ndarray:
        whole = np.zeros(h * w)
        whole[at] = np.asarray(values, float)
        return np.pad(whole.reshape(h, w), ((0, size - h), (0, size - w)), mode="symmetric" if min(h, w) == 1 else "reflect")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = make_predictor()
        for batch in batches:
            for t in batch.itertuples(index=False):
                h, w = int(t.valid_h), int(t.valid_w)
                at = np.asarray(t.at, np.int64) if "at" in fields else np.arange(h * w)
                p = predict(band(t.vv, at, h, w), band(t.vh, at, h, w))[:h, :w].ravel()[at]
                yield pd.DataFrame({"scene_id": t.scene_id, "r": at // w + t.row_off, "c": at % w + t.col_off, "prob": p, "is_oil": (p >= threshold).astype(int)})

    return tiles.select(*fields).mapInPandas(run, "scene_id bigint, r bigint, c bigint, prob double, is_oil int")


# -- components ---------------------------------------------------------------


def label_tile(r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """4-neighbour component of each pixel (sorted by row, column): position of its first pixel.

    Stretches of a row are the nodes; those that touch in neighbouring rows take
    the smallest number around and jump to its own, until nothing moves.
    """
    if not len(r):
        return np.zeros(0, np.int64)
    new = np.r_[True, (r[1:] != r[:-1]) | (c[1:] != c[:-1] + 1)]
    run = np.cumsum(new) - 1
    width = int(c.max()) + 2
    key = r.astype(np.int64) * width + c
    below = np.searchsorted(key, key + width)
    touch = np.flatnonzero(np.r_[key, -1][below] == key + width)
    a, b = run[touch], run[below[touch]]
    low = np.arange(run[-1] + 1)
    while True:
        least = np.minimum(low[a], low[b])
        after = low.copy()
        np.minimum.at(after, low[a], least)
        np.minimum.at(after, low[b], least)
        np.minimum.at(after, a, least)
        np.minimum.at(after, b, least)
        after = after[after]
        if (after == low).all():
            return np.flatnonzero(new)[low[run]]
        low = after


def tile_components(oil: DataFrame, size: int = 8) -> DataFrame:
    """(scene_id, r, c, tile, label): components inside square tiles.

    ``label`` is r * 2**31 + c of the component's first pixel in row order, so
    it doesn't depend on anything but the pixels.
    """
    tiled = oil.select("scene_id", F.col("r").cast("bigint"), F.col("c").cast("bigint")).withColumn("tile", F.shiftleft(F.expr(f"r div {size}"), 31) + F.expr(f"c div {size}"))

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["r", "c"], ignore_index=True)
        first = label_tile(p.r.to_numpy(), p.c.to_numpy())
        p["label"] = p.r.to_numpy()[first] * (1 << 31) + p.c.to_numpy()[first]
        return p

    return tiled.groupBy("scene_id", "tile").applyInPandas(run, "scene_id bigint, r bigint, c bigint, tile bigint, label bigint")


def scene_components(oil: DataFrame, size: int = TILE, rounds: int = 40) -> DataFrame:
    """(scene_id, r, c, component): components over the whole scene.

    Tiles are labelled on their own; then only pairs of labels that touch over
    a tile border go on: each label takes the smallest label next to it and
    jumps to that label's own label, until nothing changes. The pixel table is
    joined once at the end.
    """
    local = tile_components(oil, size)
    shared_folder(oil.sparkSession)
    local = local.checkpoint()
    border = local.where(f"r % {size} in (0, {size - 1}) or c % {size} in (0, {size - 1})")
    other = border.select("scene_id", F.col("r").alias("r2"), F.col("c").alias("c2"), F.col("tile").alias("tile2"), F.col("label").alias("label2"))
    pairs = None
    for dr, dc in ((1, 0), (0, 1)):
        near = border.withColumns({"r2": F.col("r") + dr, "c2": F.col("c") + dc}).join(other, ["scene_id", "r2", "c2"]).where("tile <> tile2").select("scene_id", F.col("label").alias("a"), F.col("label2").alias("b"))
        pairs = near if pairs is None else pairs.unionByName(near)
    both = pairs.unionByName(pairs.select("scene_id", F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    now = both.select("scene_id", F.col("a").alias("node")).distinct().withColumn("root", F.col("node"))
    for _ in range(rounds):
        step = both.join(now.select("scene_id", F.col("node").alias("b"), F.col("root").alias("rb")), ["scene_id", "b"]).groupBy("scene_id", F.col("a").alias("node")).agg(F.min("rb").alias("low"))
        low = now.join(step, ["scene_id", "node"]).select("scene_id", "node", F.least("root", "low").alias("root"), F.col("root").alias("was"))
        jump = low.select("scene_id", F.col("node").alias("root"), F.col("root").alias("next"))
        after = low.join(jump, ["scene_id", "root"], "left").select("scene_id", "node", F.least(F.coalesce("next", "root"), "root").alias("root"), "was").checkpoint()
        moved = after.where("root <> was").limit(1).count()
        now = after.select("scene_id", "node", "root")
        if not moved:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.select("scene_id", F.col("node").alias("label"), F.col("root").alias("component"))
    return local.join(roots, ["scene_id", "label"], "left").select("scene_id", "r", "c", F.coalesce("component", "label").alias("component"))


def component_stats(labelled: DataFrame, scale: int = 1) -> DataFrame:
    """Size, box, centre, fill density and rank by size of each component."""
    s = labelled.groupBy("scene_id", "component").agg(F.count(F.lit(1)).alias("n"), F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1"))
    box = (F.col("r1") - F.col("r0") + 1) * (F.col("c1") - F.col("c0") + 1)
    w = Window.partitionBy("scene_id").orderBy(F.desc("n"), "component")
    return s.withColumns({"full_size": F.col("n") * scale * scale, "centre_r": (F.col("r0") + F.col("r1")) / 2.0, "centre_c": (F.col("c0") + F.col("c1")) / 2.0, "density": F.col("n") / box, "rank": F.row_number().over(w).cast("bigint")})


def without_speckle(stats: DataFrame, least_pixels: int = 50, scale: int = SCALE) -> DataFrame:
    """Components of at least ``least_pixels`` full-resolution pixels (rounded down to whole samples, one at least)."""
    return stats.where(F.col("n") >= max(1, least_pixels // (scale * scale)))


def component_geometry(stats: DataFrame, cell_m: float = 10.0, scale: int = SCALE) -> DataFrame:
    """Area (box times density) and perimeter of each component's box on a metric grid."""
    side = cell_m * scale
    h, w = (F.col("r1") - F.col("r0") + 1) * side, (F.col("c1") - F.col("c0") + 1) * side
    return stats.withColumns({"area_m2": h * w * F.col("density"), "perimeter_m": 2 * (h + w)})
