"""Smooth rotations between samples: spherical quadrangles over windows of four orientations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfield.functions.geometry import cells, normalize, quaternion_conjugate, quaternion_multiply


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.transform(F.array(value), f)[0]


def _product(a: Column, b: Column) -> Column:
    return _once(a, lambda x: _once(b, lambda y: quaternion_multiply(x, y)))


def logarithm(q: Column) -> Column:
    """The vector (x, y, z) of half the turn of a unit quaternion (w first)."""

    def of(q: Column) -> Column:
        w, x, y, z = cells(q, 4)
        size = F.sqrt(x * x + y * y + z * z)
        scale = F.when(size > 1e-12, F.atan2(size, w) / F.when(size > 1e-12, size)).otherwise(1.0)
        return _once(scale, lambda s: F.array(x * s, y * s, z * s))

    return _once(q, of)


def exponential(v: Column) -> Column:
    """The unit quaternion that logarithm brings to v."""

    def of(v: Column) -> Column:
        x, y, z = cells(v, 3)
        size = F.sqrt(x * x + y * y + z * z)
        scale = lambda n: F.when(n > 1e-12, F.sin(n) / F.when(n > 1e-12, n)).otherwise(1.0)
        return _once(size, lambda n: _once(scale(n), lambda s: F.array(F.cos(n), x * s, y * s, z * s)))

    return _once(v, of)


def scaled(v: Column, by: Column | float) -> Column:
    return F.transform(v, lambda x: x * by)


def added(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def quadrangles(poses: DataFrame, series: str, ts: str, quaternion: str) -> DataFrame:
    """series, t1, t2, q1, q2, a, b: the pieces between neighbouring orientations of a series and their inner control points.

    At a control point the turns to the neighbours on either side, per time, balance; a series' ends are their own.
    Orientations of which only the sign differs are the same; each takes the sign nearer to the one before.
    """
    w = Window.partitionBy("series").orderBy("t")
    rows = poses.select(F.col(series).alias("series"), F.col(ts).cast("double").alias("t"), normalize(F.col(quaternion), 4).alias("raw")).filter("t is not null and raw is not null")
    turned = F.aggregate(F.zip_with("raw", F.lag("raw").over(w), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) < 0
    rows = rows.withColumn("odd", F.coalesce(turned.cast("int"), F.lit(0))).withColumn("odd", F.sum("odd").over(w.rowsBetween(Window.unboundedPreceding, 0)) % 2)
    rows = rows.withColumn("q1", F.when(F.col("odd") == 1, scaled(F.col("raw"), -1.0)).otherwise(F.col("raw"))).select("series", F.col("t").alias("t1"), "q1")
    w = Window.partitionBy("series").orderBy("t1")
    rows = rows.withColumns({"t0": F.lag("t1").over(w), "q0": F.lag("q1").over(w), "t2": F.lead("t1").over(w), "q2": F.lead("q1").over(w), "t3": F.lead("t1", 2).over(w), "q3": F.lead("q1", 2).over(w)})
    for name, one, two in (("l0", "q0", "q1"), ("l1", "q1", "q2"), ("l2", "q2", "q3")):
        rows = rows.withColumn(name, logarithm(_product(quaternion_conjugate(F.col(one)), F.col(two))))
    span = F.col("t2") - F.col("t1")
    rows = rows.withColumn("va", scaled(added(scaled(F.col("l0"), span / (F.col("t1") - F.col("t0"))), scaled(F.col("l1"), -1.0)), 0.25))
    rows = rows.withColumn("vb", scaled(added(F.col("l1"), scaled(F.col("l2"), -span / (F.col("t3") - F.col("t2")))), 0.25))
    a = F.when(F.col("q0").isNotNull() & F.col("q2").isNotNull(), _product(F.col("q1"), exponential(F.col("va")))).otherwise(F.col("q1"))
    b = F.when(F.col("q3").isNotNull(), _product(F.col("q2"), exponential(F.col("vb")))).otherwise(F.col("q2"))
    return rows.select("series", "t1", "t2", "q1", "q2", a.alias("a"), b.alias("b"))


def between(one: Column, two: Column, share: Column) -> Column:
    """On the arc from one orientation to the other, without a change of sign."""
    turn = lambda q: logarithm(_product(quaternion_conjugate(q), two))
    return _once(one, lambda q: _product(q, exponential(scaled(turn(q), share))))


def squad(poses: DataFrame, frames: DataFrame, series: str, ts: str, quaternion: str = "quaternion") -> DataFrame:
    """series, ts, quaternion of frames (series, ts) on the smooth curve through the poses; a series' ends hold beyond it.

    Frames of series without poses, or without a time, are left out. A series' times have to differ.
    """
    piece = F.struct("t1", "t2", "q1", "q2", "a", "b")
    own = quadrangles(poses, series, ts, quaternion).select("series", F.col("t1").alias("t"), F.lit(0).alias("frame"), piece.alias("p"))
    asked = frames.select(F.col(series).alias("series"), F.col(ts).cast("double").alias("t"), F.lit(1).alias("frame"), F.lit(None).cast(own.schema["p"].dataType).alias("p"))
    w = Window.partitionBy("series").orderBy("t", "frame")
    rows = own.unionByName(asked.filter("t is not null")).withColumn("p", F.coalesce(F.last("p", True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first("p", True).over(w.rowsBetween(0, Window.unboundedFollowing))))
    rows = rows.filter("frame = 1 and p is not null").select("series", "t", "p.*")
    rows = rows.withColumn("u", F.when(F.col("t2").isNotNull(), F.least(F.greatest((F.col("t") - F.col("t1")) / (F.col("t2") - F.col("t1")), F.lit(0.0)), F.lit(1.0))).otherwise(0.0))
    rows = rows.withColumns({"outer": between(F.col("q1"), F.coalesce("q2", "q1"), F.col("u")), "inner": between(F.col("a"), F.coalesce("b", "a"), F.col("u"))})
    out = normalize(between(F.col("outer"), F.col("inner"), 2 * F.col("u") * (1 - F.col("u"))), 4)
    return rows.select(F.col("series").alias(series), F.col("t").alias(ts), out.alias(quaternion))
