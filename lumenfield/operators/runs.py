"""Masks as runs of pixels in columns: components, holes and islands, overlap, and the compact text of their lengths.

A mask is a table of runs: mask, x (column), y0 and y1 (first and last row of the run). A run's size says
nothing about the mask's, so no pixel array is ever made; all masks of a table are worked on at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfield.operators.components import connected_components
from lumenfield.plans.scratch import materialize


def from_counts(masks: DataFrame, mask: str, counts: str, height: str) -> DataFrame:
    """Runs of masks given as column-major lengths, the first of them background; runs over several columns are cut."""
    steps = F.aggregate(F.col(counts), F.array(F.lit(0).cast("long")), lambda s, n: F.concat(s, F.array(F.element_at(s, -1) + n)))
    spans = masks.select(F.col(mask).alias("mask"), F.col(height).cast("long").alias("h"), F.posexplode(F.arrays_zip(F.slice(steps, 1, F.size(counts)).alias("a"), F.slice(steps, 2, F.size(counts)).alias("b"))).alias("i", "s"))
    spans = spans.filter((F.col("i") % 2 == 1) & (F.col("s.a") < F.col("s.b"))).select("mask", "h", F.col("s.a").alias("a"), (F.col("s.b") - 1).alias("b"))
    cut = spans.withColumn("x", F.explode(F.sequence(F.floor(F.col("a") / F.col("h")), F.floor(F.col("b") / F.col("h")))))
    return cut.select("mask", "x", F.greatest(F.col("a") - F.col("x") * F.col("h"), F.lit(0)).alias("y0"), F.least(F.col("b") - F.col("x") * F.col("h"), F.col("h") - 1).alias("y1"))


def from_pixels(pixels: DataFrame, mask: str, x: str, y: str) -> DataFrame:
    """Runs of masks given as pixels; repeated pixels count once."""
    own = pixels.select(F.col(mask).alias("mask"), F.col(x).cast("long").alias("x"), F.col(y).cast("long").alias("y")).dropna().distinct()
    line = F.col("y") - F.row_number().over(Window.partitionBy("mask", "x").orderBy("y"))
    return own.withColumn("line", line).groupBy("mask", "x", "line").agg(F.min("y").alias("y0"), F.max("y").alias("y1")).drop("line")


def complement(runs: DataFrame, sizes: DataFrame) -> DataFrame:
    """Runs of what masks leave out of their images; sizes: mask, width, height."""
    columns = sizes.select("mask", F.col("height").cast("long").alias("h"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("width").cast("long") - 1)).alias("x")).filter("h > 0 and x >= 0")
    ends = columns.select("mask", "x", F.lit(-1).cast("long").alias("y0"), F.lit(-1).cast("long").alias("y1")).unionByName(columns.select("mask", "x", F.col("h").alias("y0"), F.col("h").alias("y1")))
    every = runs.select("mask", "x", "y0", "y1").join(sizes.select("mask"), "mask", "left_semi").unionByName(ends)
    after = F.lead("y0").over(Window.partitionBy("mask", "x").orderBy("y0"))
    return every.select("mask", "x", (F.col("y1") + 1).alias("y0"), (after - 1).alias("y1")).filter("y0 <= y1")


def components(runs: DataFrame) -> DataFrame:
    """Runs with their component, named by the least run number in it, and its area; pixels touch on 8 sides."""
    rows = materialize(runs.select("mask", "x", "y0", "y1").withColumn("run", F.monotonically_increasing_id()), "runs")
    right = rows.select("mask", (F.col("x") - 1).alias("x"), F.col("y0").alias("r0"), F.col("y1").alias("r1"), F.col("run").alias("b"))
    edges = rows.select("mask", "x", "y0", "y1", F.col("run").alias("a")).join(right, ["mask", "x"]).filter("r0 <= y1 + 1 and r1 >= y0 - 1")
    parts = connected_components(edges.select("a", "b")).withColumnRenamed("node", "run")
    named = materialize(rows.join(parts, "run", "left").withColumn("component", F.coalesce("component", "run")), "named")
    areas = named.groupBy("mask", "component").agg(F.sum(F.col("y1") - F.col("y0") + 1).alias("area"))
    return named.join(areas, ["mask", "component"]).select("mask", "x", "y0", "y1", "run", "component", "area")


def drop_islands(runs: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Runs of masks without components under an area, and mask, changed. Where all are that small the largest stays, the first by column and row of equal ones."""
    named = components(runs)
    parts = named.groupBy("mask", "component").agg(F.max("area").alias("area"), F.min(F.struct("y0", "x")).alias("at"))
    best = parts.groupBy("mask").agg(F.max(F.struct("area", (-F.col("at.y0")).alias("y"), (-F.col("at.x")).alias("x"), "component")).alias("b"), F.min("area").alias("smallest"))
    best = best.select("mask", F.col("b.component").alias("largest"), F.col("b.area").alias("most"), F.col("smallest").alias("smallest"))
    kept = named.join(best, "mask").filter((F.col("area") >= least) | ((F.col("most") < least) & (F.col("component") == F.col("largest"))))
    return kept.select("mask", "x", "y0", "y1"), best.select("mask", (F.col("smallest") < least).alias("changed"))


def fill_holes(runs: DataFrame, sizes: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Runs of masks with the components of their background under an area filled, and mask, changed."""
    back = components(complement(runs, sizes))
    left = back.filter(F.col("area") >= least).select("mask", "x", "y0", "y1")
    changed = sizes.select("mask").join(back.groupBy("mask").agg(F.min("area").alias("smallest")), "mask", "left")
    return complement(left, sizes), changed.select("mask", F.coalesce(F.col("smallest") < least, F.lit(False)).alias("changed"))


def box(runs: DataFrame, sizes: DataFrame) -> DataFrame:
    """mask, x0, y0, x1, y1 about its pixels; an empty one has width, height, -1, -1."""
    found = runs.groupBy("mask").agg(F.min("x").alias("x0"), F.min("y0").alias("y0"), F.max("x").alias("x1"), F.max("y1").alias("y1"))
    out = sizes.select("mask", "width", "height").join(found, "mask", "left")
    return out.select("mask", F.coalesce("x0", "width").alias("x0"), F.coalesce("y0", "height").alias("y0"), F.coalesce("x1", F.lit(-1)).alias("x1"), F.coalesce("y1", F.lit(-1)).alias("y1"))


def area(counts: Column) -> Column:
    """Pixels of a mask given as lengths."""
    return F.aggregate(F.filter(counts, lambda n, i: i % 2 == 1), F.lit(0).cast("long"), lambda s, n: s + n)


def intersection(a: Column, b: Column) -> Column:
    """Pixels that two masks share, from their lengths: their ends are merged in order and walked through once."""

    def ends(counts: Column, which: int) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<at:bigint,which:int>>").alias("e"))
        step = lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["e"], F.array(F.struct((s["at"] + n).cast("long").alias("at"), F.lit(which).alias("which")))).alias("e"))
        return F.aggregate(counts, start, step)["e"]

    merged = F.array_sort(F.concat(ends(a, 0), ends(b, 1)))
    zero = lambda name: F.lit(0).cast("long").alias(name)
    start = F.struct(zero("at"), zero("a"), zero("b"), zero("n"))
    step = lambda s, e: F.struct(
        e["at"].alias("at"),
        F.when(e["which"] == 0, 1 - s["a"]).otherwise(s["a"]).alias("a"),
        F.when(e["which"] == 1, 1 - s["b"]).otherwise(s["b"]).alias("b"),
        (s["n"] + (e["at"] - s["at"]) * s["a"] * s["b"]).alias("n"),
    )
    return F.aggregate(merged, start, step)["n"]


def iou(a: Column, b: Column) -> Column:
    """Shared over joint pixels of two masks of one size given as lengths; 0 where both are empty."""
    shared = intersection(a, b)
    return F.coalesce(F.try_divide(shared, area(a) + area(b) - shared), F.lit(0.0))


def to_text(counts: Column) -> Column:
    """Lengths as the compact text of COCO: from the fourth on their difference to the one two before, in signed groups of 5 bits, lowest first."""
    small = F.transform(counts, lambda n, i: n.cast("long") - F.when(i > 2, F.get(counts, i - 2)).otherwise(F.lit(0)).cast("long"))

    def groups(x: Column) -> Column:
        # the least number of groups that hold x and its sign
        need = F.lit(13)
        for k in range(12, 0, -1):
            need = F.when((x >= -(1 << (5 * k - 1))) & (x < (1 << (5 * k - 1))), F.lit(k)).otherwise(need)
        bits = F.transform(F.sequence(F.lit(0), need - 1), lambda k: F.char(F.call_function("shiftright", x, 5 * k).bitwiseAND(31) + F.when(k < need - 1, 32).otherwise(0) + 48))
        return F.array_join(bits, "")

    return F.array_join(F.transform(small, groups), "")


def from_text(text: Column) -> Column:
    """Lengths from their compact text."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: (F.ascii(c) - 48).cast("long"))
    start = F.struct(F.array().cast("array<bigint>").alias("out"), F.lit(0).cast("long").alias("x"), F.lit(0).alias("k"))

    def step(s: Column, c: Column) -> Column:
        x = s["x"].bitwiseOR(F.call_function("shiftleft", c.bitwiseAND(31), 5 * s["k"]))
        signed = F.when(c.bitwiseAND(16) != 0, x.bitwiseOR(F.call_function("shiftleft", F.lit(-1).cast("long"), 5 * (s["k"] + 1)))).otherwise(x)
        n = F.size(s["out"])
        whole = signed + F.when(n > 2, F.get(s["out"], n - 2)).otherwise(F.lit(0))
        more = c.bitwiseAND(32) != 0
        return F.struct(F.when(more, s["out"]).otherwise(F.concat(s["out"], F.array(whole))).alias("out"), F.when(more, x).otherwise(F.lit(0).cast("long")).alias("x"), F.when(more, s["k"] + 1).otherwise(F.lit(0)).alias("k"))

    return F.aggregate(codes, start, step)["out"]
