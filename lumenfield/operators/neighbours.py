"""Nearest neighbours without a radius, exactly, on a tree of cells.

Cells halve the extent of the points on their first axes (three at most), level by level, down to
cells that hold few points. Most rows have what they look for within one leaf cell's side of
themselves, and one join with the adjacent cells shows it. What is left, such as far outliers, goes down the tree from its top:
of each row's cells those stay that may hold something nearer than what others are sure to hold. A
cell's box bounds its distances, so no neighbour is lost, and a row keeps few cells on each level.
Every step is an equality join on a cell; no point meets all others.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfield.plans.scratch import materialize

#: A leaf holds at most so many points for each neighbour that is looked for, if DEEPEST halvings are enough.
LEAF, DEEPEST = 16, 24
#: Levels above hold at most 8 ** LEVEL cells, which are broadcast.
SMALL = 4


def _square(pairs: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [x * x for x in pairs])


def distance(point: list[str], a: str, b: str) -> Column:
    """Euclidean distance between the columns with prefixes a and b."""
    return F.sqrt(_square([F.col(a + c) - F.col(b + c) for c in point]))


class Cells:
    """A table's extent and cells. points: finite coordinates only."""

    def __init__(self, points: DataFrame, point: list[str], few: int):
        self.point, self.axes = point, point[:3]
        row = points.agg(*[f(c).alias(f"{n}{k}") for k, c in enumerate(self.axes) for n, f in (("lo", F.min), ("hi", F.max))], F.count(F.lit(1)).alias("n")).first()
        self.n = row["n"]
        self.low = [row[f"lo{k}"] or 0.0 for k in range(len(self.axes))]
        self.side = max([(row[f"hi{k}"] or 0.0) - low for k, low in enumerate(self.low)] + [0.0]) or 1.0
        self.depth = max(1, math.ceil(math.log2(max(1.0, self.n / few)) / len(self.axes)))
        while self.n > few and self.depth < DEEPEST:
            most = points.groupBy(*self.at(self.depth)).count().agg(F.max("count")).first()[0]
            if most <= few:
                break
            self.depth += 1

    def at(self, level: int, names: str = "c", shift: int = 0) -> list[Column]:
        """A row's cell on a level, as columns; places outside the extent count on."""
        width = self.side / 2**level
        return [(F.floor((F.col(c) - F.lit(float(low))) / F.lit(width)) + shift).alias(f"{names}{k}_") for k, (c, low) in enumerate(zip(self.axes, self.low, strict=True))]

    def boxes(self, points: DataFrame) -> list[DataFrame]:
        """For each level its cells with their number of points (by weight w_) and the box around these."""
        keys = [f"c{k}_" for k in range(len(self.axes))]
        last = self.at(self.depth)
        box = [F.min(c).alias(f"lo_{c}") for c in self.point] + [F.max(c).alias(f"hi_{c}") for c in self.point]
        leaves = materialize(points.select(*last, *self.point, "w_").groupBy(*keys).agg(F.sum("w_").alias("n_"), *box), "cells")
        again = [F.min(f"lo_{c}").alias(f"lo_{c}") for c in self.point] + [F.max(f"hi_{c}").alias(f"hi_{c}") for c in self.point]
        up = [leaves.withColumns({k: F.shiftright(k, self.depth - level) for k in keys}) for level in range(self.depth)]
        return [*(df.groupBy(*keys).agg(F.sum("n_").alias("n_"), *again) for df in up), leaves]


def candidates(left: DataFrame, right: DataFrame, point: list[str], k: int, weight: str | None = None) -> DataFrame:
    """l_<columns of left>, r_<columns of right>, distance: of each left row all pairs up to its k-th nearest, and perhaps more.

    Rows of right count as often as `weight` says. left: a column "id", unique. Rows whose coordinates
    are null or not finite are left out. Where right has fewer than k, all its rows are paired.
    """
    finite = lambda df: df.filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")) for c in point]))
    doubles = lambda df: df.withColumns({c: F.col(c).cast("double") for c in point})
    left = materialize(finite(doubles(left)), "left")
    right = materialize(finite(doubles(right)).withColumn("w_", F.col(weight).cast("long") if weight else F.lit(1).cast("long")), "right")
    cells = Cells(right, point, LEAF * k)
    keys = [f"c{i}_" for i in range(len(cells.axes))]
    held = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns if c != "w_"], "w_", *cells.at(cells.depth))
    named = left.select(*[F.col(c).alias(f"l_{c}") for c in left.columns], *cells.at(cells.depth))
    near = named
    for c in keys:
        near = near.withColumn(c, F.explode(F.array(*[F.col(c) + d for d in (-1, 0, 1)])))
    width = cells.side / 2**cells.depth
    near = near.join(held, keys).withColumn("distance", distance(point, "l_", "r_")).filter(F.col("distance") <= width).drop(*keys)
    near = materialize(near, "near")
    sure = near.groupBy("l_id").agg(F.sum("w_").alias("s_")).filter(F.col("s_") >= k).select("l_id")
    near, rest = near.join(sure, "l_id", "left_semi"), materialize(named.drop(*keys).join(sure, "l_id", "left_anti"), "rest")
    if not cells.n or not rest.limit(1).count():
        return near.drop("w_")
    levels = cells.boxes(right)
    # the first levels' cells, 8 at most, go with every row
    top = levels[1].collect()
    coordinates = [f"l_{c}" for c in point]
    start = [F.struct(*[F.lit(r[c]).alias(c) for c in levels[1].columns]) for r in top]
    open_rows = rest.select("l_id", *coordinates, F.explode(F.array(*start)).alias("b")).select("l_id", *coordinates, "b.*")
    for level in range(1, len(levels)):
        if level > 1:
            up = levels[level].select(*[F.shiftright(c, 1).alias(c) for c in keys], *[F.col(c).alias(f"own_{c}") for c in keys], *[c for c in levels[level].columns if c not in keys])
            open_rows = open_rows.select("l_id", *coordinates, *keys).join(F.broadcast(up) if level <= SMALL else up, keys)
            open_rows = open_rows.drop(*keys).withColumnsRenamed({f"own_{c}": c for c in keys})
        below = _square([F.greatest(F.col(f"lo_{c}") - F.col(f"l_{c}"), F.col(f"l_{c}") - F.col(f"hi_{c}"), F.lit(0.0)) for c in point])
        above = _square([F.greatest(F.col(f"hi_{c}") - F.col(f"l_{c}"), F.col(f"l_{c}") - F.col(f"lo_{c}")) for c in point])
        packed = open_rows.select("l_id", *coordinates, F.struct(above.alias("above"), "n_", below.alias("below"), *keys).alias("b"))
        rows = packed.groupBy("l_id", *coordinates).agg(F.array_sort(F.collect_list("b")).alias("bs"))
        # the least bound that is sure to have k within it
        start_at = F.struct(F.lit(0).cast("long").alias("n"), F.lit(float("inf")).cast("double").alias("u"))
        step = lambda s, b: F.when(s["n"] >= k, s).otherwise(F.struct((s["n"] + b["n_"]).alias("n"), F.when(s["n"] + b["n_"] >= k, b["above"]).otherwise(F.lit(float("inf"))).alias("u")))
        rows = rows.withColumn("u", F.aggregate("bs", start_at, step)["u"])
        # sums of squares may round either way
        rows = rows.withColumn("b", F.explode(F.filter("bs", lambda b: b["below"] <= F.col("u") * (1 + 1e-9))))
        open_rows = rows.select("l_id", *coordinates, *[F.col(f"b.{c}").alias(c) for c in keys])
    far = open_rows.select("l_id", *keys).join(held, keys).drop(*keys).join(rest, "l_id").withColumn("distance", distance(point, "l_", "r_"))
    return near.drop("w_").unionByName(far.select(*[c for c in near.columns if c != "w_"]))


def nearest(left: DataFrame, right: DataFrame, point: list[str], left_id: str, right_id: str, k: int = 1) -> DataFrame:
    """left_id, right_id, distance, rank: the k nearest right rows of each left row, however far; ties by right_id.

    left_id has to be unique. Rows without finite coordinates have no neighbours and are none.
    """
    pairs = candidates(left.select(F.col(left_id).alias("id"), *point), right.select(F.col(right_id).alias("id"), *point), point, k)
    best = pairs.groupBy("l_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("distance", F.col("r_id").alias("right_id")))), 1, k).alias("b"))
    out = best.select(F.col("l_id").alias("left_id"), F.posexplode("b").alias("i", "b"))
    return out.select("left_id", "b.right_id", "b.distance", (F.col("i") + 1).alias("rank"))


def reach(points: DataFrame, ident: str, point: list[str], k: int, weight: str | None = None) -> DataFrame:
    """id, reach: the distance within which a point has k points, itself included; null where there are fewer."""
    rows = points.select(F.col(ident).alias("id"), *point, (F.col(weight) if weight else F.lit(1)).alias("many"))
    pairs = candidates(rows.select("id", *point), rows, point, k, "many")
    step = lambda s, b: F.when(s["n"] >= k, s).otherwise(F.struct((s["n"] + b["many"]).alias("n"), b["distance"].alias("d")))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("d"))
    found = pairs.groupBy("l_id").agg(F.array_sort(F.collect_list(F.struct("distance", F.col("r_many").cast("long").alias("many")))).alias("b"))
    last = F.aggregate("b", start, step)
    return found.select(F.col("l_id").alias("id"), F.when(last["n"] >= k, last["d"]).alias("reach"))
