"""Greedy suppression of boxes, exactly, in rounds over the boxes left, and suppression across crops.

Boxes of about one size and place are a group: all of one overlap by more than the limit, or nearly. In each round
the best boxes of groups stay that no group near with a better best box can reach, and what these overlap
goes, until nothing is left: what stays is what going through the boxes from the best on would keep. Boxes only
meet boxes that stay, never all that they overlap, and an image's boxes need not be in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfield.plans.scratch import drop_path, materialize, materialize_at

BOX = ("x0", "y0", "x1", "y1")


def _overlap(a: str, b: str) -> Column:
    side = lambda lo, hi: F.greatest(F.least(F.col(a + hi), F.col(b + hi)) - F.greatest(F.col(a + lo), F.col(b + lo)), F.lit(0.0))
    area = lambda p: (F.col(p + "x1") - F.col(p + "x0")) * (F.col(p + "y1") - F.col(p + "y0"))
    shared = side("x0", "x1") * side("y0", "y1")
    return shared / (area(a) + area(b) - shared)


def _reaches(limit: float) -> Column:
    """Whether box a may overlap by more than the limit with a box of group g: one in its hull, of an area from small to large."""
    side = lambda lo, hi: F.greatest(F.least(F.col("a_" + hi), F.col("g_" + hi)) - F.greatest(F.col("a_" + lo), F.col("g_" + lo)), F.lit(0.0))
    area = (F.col("a_x1") - F.col("a_x0")) * (F.col("a_y1") - F.col("a_y0"))
    # rounding must not part what overlaps by a hair more than the limit
    shared, least = side("x0", "x1") * side("y0", "y1") * (1 + 1e-9), limit * (1 - 1e-9)
    return (shared > least * area) & (shared > least * F.col("g_small")) & (F.col("g_large") > least * area)


def _meet(few: DataFrame, many: DataFrame, up: int) -> DataFrame:
    """Pairs (a_*, g_*) of rows of one image that share a cell as wide as the latter's level; few are put into the cells of `up` levels around theirs."""

    def cells(df: DataFrame, level: Column, prefix: str) -> DataFrame:
        out = df.withColumn("cell", level)
        width = F.pow(F.lit(2.0), F.col("cell"))
        for n, lo, hi in (("ci", "x0", "x1"), ("cj", "y0", "y1")):
            out = out.withColumn(n, F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))))
        return out.select("image", "cell", "ci", "cj", *[F.col(c).alias(prefix + c) for c in df.columns if c != "image"])

    around = F.explode(F.sequence(F.col("level") - up, F.col("level") + up))
    return cells(few, around, "a_").join(cells(many, F.col("level"), "g_"), ["image", "cell", "ci", "cj"])


def suppress(df: DataFrame, image: str, ident: str, limit: float = 0.7, order: list[Column] | None = None) -> DataFrame:
    """image, ident of boxes (x0, y0, x1, y1, score) that stay, from the highest score on, ties by ident; image and ident name a row.

    order: columns of less for better, instead of the score. Boxes of no area overlap nothing. Boxes whose
    corners or score are null or not finite are left out.
    """
    if limit <= 0:
        raise ValueError("the limit has to be over 0")
    good = F.lit(True)
    for c in (*BOX, *(() if order else ("score",))):
        good &= F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) != float("inf"))
    ranked = F.struct(*[c.alias(f"o{k}") for k, c in enumerate(order or [-F.col("score")])], F.col(ident).alias("ident"))
    rows = df.filter(good).select(F.col(image).alias("image"), F.col(ident).alias("ident"), ranked.alias("rank"), *[F.col(c).cast("double").alias(c) for c in BOX])
    rows = materialize(rows.withColumn("id", F.monotonically_increasing_id()), "boxes")
    named = [F.col("image").alias(image), F.col("ident").alias(ident)]
    if limit >= 1:
        return rows.select(*named)
    # groups: sides and corners alike by a sixth of what the limit leaves; two boxes over the limit have sides alike by it
    step = (1 - limit) / 6
    up = math.ceil(math.log2((1 + step) / limit)) + 1
    flat = (F.col("x1") <= F.col("x0")) | (F.col("y1") <= F.col("y0"))
    alive = rows.filter(~flat)
    for n, lo, hi in (("w", "x0", "x1"), ("h", "y0", "y1")):
        alive = alive.withColumn(n, F.floor(F.log(F.col(hi) - F.col(lo)) / math.log1p(step)))
        alive = alive.withColumn("g" + n, F.floor(F.col(lo) / (F.pow(F.lit(1 + step), F.col(n)) * step)))
    alive = alive.withColumn("level", F.ceil((F.greatest("w", "h") + 1) * math.log2(1 + step)).cast("int"))
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    key = ["image", "w", "h", "gw", "gh", "level"]
    alive, path = materialize_at(alive, "alive")
    stay = rows.filter(flat).select("id")
    while not alive.isEmpty():
        hull = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
        best = F.min(F.struct("rank", "id", *[F.col(c).alias("b" + c) for c in BOX])).alias("b")
        groups, old = materialize_at(alive.groupBy(*key).agg(best, *hull, F.min(area).alias("small"), F.max(area).alias("large")).drop("w", "h", "gw", "gh"), "groups")
        first = groups.select("image", "level", "b.id", "b.rank", *[F.col("b.b" + c).alias(c) for c in BOX])
        held = _meet(first, groups, up).filter((F.col("g_b.rank") < F.col("a_rank")) & _reaches(limit)).select(F.col("a_id").alias("id"))
        kept = materialize(first.join(held, "id", "left_anti"), "kept")
        stay = stay.unionByName(kept.select("id"))
        fall = _meet(kept, alive.select("image", "level", "id", *BOX), up).filter((F.col("a_id") != F.col("g_id")) & (_overlap("a_", "g_") > limit)).select(F.col("g_id").alias("id"))
        following, new = materialize_at(alive.join(fall.unionByName(kept.select("id")), "id", "left_anti"), "alive")
        for done in (path, old):
            drop_path(df.sparkSession, done)
        alive, path = following, new
    drop_path(df.sparkSession, path)
    return rows.join(stay, "id", "left_semi").select(*named)


def suppress_across_crops(df: DataFrame, image: str, ident: str, crop: str, limit: float = 0.7) -> DataFrame:
    """As suppress, where boxes of smaller crops are better; crop: an array x0, y0, x1, y1 that a box was found in."""
    c = F.col(crop)
    return suppress(df, image, ident, limit, [((c[2] - c[0]) * (c[3] - c[1])).cast("double")])


def crops(images: DataFrame, image: str, width: str, height: str, layers: int, overlap: float = 512 / 1500) -> DataFrame:
    """image, layer, x0, y0, x1, y1: an image whole (layer 0), and for each layer k a grid of 2 ** k overlapping crops a side."""
    layer = F.explode(F.sequence(F.lit(0), F.lit(layers))).alias("layer")
    rows = images.select(F.col(image).alias("image"), F.col(width).alias("w"), F.col(height).alias("h"), layer).withColumn("n", F.pow(F.lit(2), F.col("layer")).cast("int"))
    shared = F.when(F.col("layer") == 0, 0).otherwise(F.floor(F.least("w", "h") * overlap * (2 / F.col("n")))).cast("int")
    rows = rows.withColumn("o", shared)
    for n, size in (("i", "w"), ("j", "h")):
        rows = rows.withColumn(f"s{n}", F.ceil((F.col("o") * (F.col("n") - 1) + F.col(size)) / F.col("n")).cast("int")).withColumn(n, F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    at = {"x0": (F.col("si") - F.col("o")) * F.col("i"), "y0": (F.col("sj") - F.col("o")) * F.col("j")}
    ends = {"x1": F.least(at["x0"] + F.col("si"), F.col("w")), "y1": F.least(at["y0"] + F.col("sj"), F.col("h"))}
    return rows.select(F.col("image").alias(image), "layer", *[c.cast("int").alias(n) for n, c in (at | ends).items()])
