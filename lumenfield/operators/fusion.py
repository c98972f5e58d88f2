"""Clouds of points: voxel fusion, scales and normalisation, as aggregations over the whole cloud."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfield.operators.evaluation import finite
from lumenfield.operators.quantiles import join_groups, quantiles

POINT = ["x", "y", "z"]


def voxel_fuse(samples: DataFrame, group: list[str], value: str, weight: str, size: float = 0.01, least: float = 1.0) -> DataFrame:
    """vx, vy, vz, the weighted mean of a value in each voxel and its weight, of voxels with enough of it.

    Partial sums are made before the shuffle, so what travels is a row a voxel and task.
    """
    cells = [F.floor(F.col(a) / size).alias(f"v{a}") for a in POINT]
    w, v = F.col(weight), F.col(value)
    good = finite(value) & finite(weight) & (w > 0)
    sums = samples.filter(good).select(*group, *cells, (w * v).alias("wv_"), w.alias("w_")).groupBy(*group, "vx", "vy", "vz").agg(F.sum("wv_").alias("s_"), F.sum("w_").alias("weight"))
    return sums.filter(F.col("weight") >= least).select(*group, "vx", "vy", "vz", (F.col("s_") / F.col("weight")).alias(value), "weight")


def truncated_distance(surface: Column | str, depth: Column | str, cut: float) -> Column:
    """Signed distance along the ray over the truncation, at most 1; null far behind the surface."""
    d = (F.col(surface) if isinstance(surface, str) else surface) - (F.col(depth) if isinstance(depth, str) else depth)
    return F.when(d >= -cut, F.least(d / cut, F.lit(1.0)))


def scene_scale(points: DataFrame, group: list[str], low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Length of the box between two percentiles of each axis."""
    spans = quantiles(points, group, {f"{n}{a}": (a, s) for a in POINT for n, s in (("lo", low), ("hi", high))})
    return spans.select(*group, F.sqrt(sum(((F.col(f"hi{a}") - F.col(f"lo{a}")) * (F.col(f"hi{a}") - F.col(f"lo{a}")) for a in POINT), F.lit(0.0))).alias("scale"))


def normalisation(points: DataFrame, group: list[str], how: str = "avg", least: float = 1e-3, most: float = 1e3) -> DataFrame:
    """The factor that points are divided by: mean or median of their distances from the origin, kept within limits."""
    distance = F.sqrt(sum((F.col(a) * F.col(a) for a in POINT), F.lit(0.0)))
    rows = points.withColumn("d_", distance).filter(finite("d_"))
    if how == "median":
        return quantiles(rows, group, {"m_": ("d_", 0.5)}).select(*group, F.greatest(F.least("m_", F.lit(most)), F.lit(least)).alias("factor"))
    figure = F.avg(F.log1p("d_")) if how == "log" else F.avg("d_")
    return rows.groupBy(*group).agg(F.greatest(F.least(figure, F.lit(most)), F.lit(least)).alias("factor"))


def median_centre(points: DataFrame, group: list[str]) -> DataFrame:
    """Median of each axis, and the median distance from it."""
    both = join_groups(points, quantiles(points, group, {f"c{a}": (a, 0.5) for a in POINT}), group)
    d = F.sqrt(sum(((F.col(a) - F.col(f"c{a}")) * (F.col(a) - F.col(f"c{a}")) for a in POINT), F.lit(0.0)))
    return quantiles(both.withColumn("d_", d), [*group, "cx", "cy", "cz"], {"scale": ("d_", 0.5)})


def masked_mean(df: DataFrame, group: list[str], value: str, mask: str) -> DataFrame:
    """Weighted mean under a mask, and whether it is defined; 0 where it is not."""
    m = F.col(mask).cast("double")
    mean = F.sum(F.col(value) * m) / F.nullif(F.sum(m), F.lit(0.0))
    return df.groupBy(*group).agg(mean.alias("m_")).select(*group, F.when(finite("m_"), F.col("m_")).otherwise(0.0).alias("mean"), F.coalesce(finite("m_"), F.lit(False)).alias("valid"))


def depth_statistics(df: DataFrame, group: list[str], depth: str) -> DataFrame:
    """p1, p99, mean, std and share of the positive depths."""
    d = F.when(finite(depth) & (F.col(depth) > 0), F.col(depth))
    rows = df.withColumn("d_", d)
    figures = rows.groupBy(*group).agg(
        F.avg(d).alias("mean"), F.stddev_pop(d).alias("std"), (F.count(d) / F.count(F.lit(1))).alias("valid_ratio")
    )
    return join_groups(figures, quantiles(rows, group, {"p1": ("d_", 0.01), "p99": ("d_", 0.99)}), group)


def episodes(items: DataFrame, ident: str, cls: str, shots: int, seed: int) -> DataFrame:
    """query, class, shot, support: other members of a query's class, drawn by hash with replacement between draws.

    A draw is a place in the class's order; one that hits the query takes the next member. Classes of one
    member have no support and are left out.
    """
    order = Window.partitionBy(cls).orderBy(ident)
    placed = items.select(ident, cls, (F.row_number().over(order) - 1).alias("i_"), F.count(F.lit(1)).over(Window.partitionBy(cls)).alias("n_")).filter("n_ > 1")
    draw = placed.withColumn("shot", F.explode(F.sequence(F.lit(0), F.lit(shots - 1))))
    place = F.pmod(F.xxhash64(F.col(ident), F.col("shot"), F.lit(seed)), F.col("n_"))
    draw = draw.withColumn("p_", place).withColumn("p_", F.when(F.col("p_") == F.col("i_"), F.pmod(F.col("p_") + 1, F.col("n_"))).otherwise(F.col("p_")))
    held = placed.select(F.col(cls), F.col("i_").alias("p_"), F.col(ident).alias("support"))
    return draw.join(held, [cls, "p_"]).select(F.col(ident).alias("query"), F.col(cls).alias("class"), "shot", "support")
