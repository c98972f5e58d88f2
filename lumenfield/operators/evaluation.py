"""Evaluation: depth, pose, trajectory and segmentation metrics as single aggregations where possible."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfield.operators.datasets import global_index
from lumenfield.operators.quantiles import join_groups, quantiles


def finite(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def view_reliability(df: DataFrame, view: str, confidence: str) -> DataFrame:
    """Mean of the finite positive confidences of each view; 0 if there are none."""
    good = F.when(finite(confidence) & (F.col(confidence) > 0), F.col(confidence))
    return df.groupBy(view).agg(F.coalesce(F.avg(good), F.lit(0.0)).alias("reliability"))


def percentile_filter(df: DataFrame, group: list[str], value: str, share: float, strict: bool = False) -> DataFrame:
    """Rows at (or above, if strict) their group's percentile. Two passes and a join on the group, no window over it."""
    limit = quantiles(df.filter(finite(value)), group, {"p_": (value, share)})
    held = df.join(limit, group)
    return held.filter(F.col(value) > F.col("p_") if strict else F.col(value) >= F.col("p_")).drop("p_")


def clamp_depth(df: DataFrame, group: list[str], depth: str, share: float) -> DataFrame:
    """Depths above their group's percentile become 0."""
    limit = quantiles(df.filter(finite(depth)), group, {"p_": (depth, share)})
    return df.join(limit, group, "left").withColumn(depth, F.when(F.col(depth) > F.col("p_"), 0.0).otherwise(F.col(depth))).drop("p_")


def median_scale(df: DataFrame, group: list[str], gt: str, pred: str) -> DataFrame:
    """Scales that align predictions: by medians and by least squares; 1 where they are not defined."""
    rows = df.filter(finite(gt) & finite(pred) & (F.col(gt) > 0) & (F.col(pred) > 0))
    middle = quantiles(rows, group, {"gt_": (gt, 0.5), "pred_": (pred, 0.5)})
    fitted = rows.groupBy(*group).agg(
        F.coalesce(F.sum(F.col(gt) * F.col(pred)) / F.nullif(F.sum(F.col(pred) * F.col(pred)), F.lit(0.0)), F.lit(1.0)).alias("scale_lstsq"),
    )
    ratio = F.coalesce(F.col("gt_") / F.nullif(F.col("pred_"), F.lit(0.0)), F.lit(1.0))
    return join_groups(fitted, middle, group).select(*group, ratio.alias("scale_median"), "scale_lstsq")


def depth_metrics(df: DataFrame, group: list[str], gt: str, pred: str, inlier: float = 1.03) -> DataFrame:
    """Error figures of positive predictions against positive truths, in one aggregation."""
    g, p = F.col(gt), F.col(pred)
    rows = df.withColumn("ok_", finite(gt) & finite(pred) & (g > 0) & (p > 0))
    ratio, err = F.greatest(g / p, p / g), p - g
    when = lambda c: F.when(F.col("ok_"), c)
    share = lambda t: (F.avg(when((ratio < t).cast("double"))) * 100)
    return rows.groupBy(*group).agg(
        F.count_if("ok_").alias("n_valid"),
        (F.avg(F.col("ok_").cast("double")) * 100).alias("valid_ratio"),
        F.avg(when(F.abs(err))).alias("mae"),
        F.sqrt(F.avg(when(err * err))).alias("rmse"),
        (F.avg(when(F.abs(err) / g)) * 100).alias("abs_rel"),
        F.avg(when(err * err / g)).alias("sq_rel"),
        F.sqrt(F.avg(when(F.pow(F.log(p) - F.log(g), F.lit(2))))).alias("log_rmse"),
        share(inlier).alias("inliers"),
        share(1.25).alias("delta1"),
        share(1.25**2).alias("delta2"),
        share(1.25**3).alias("delta3"),
    )


def summarize(df: DataFrame, metrics: list[str]) -> DataFrame:
    """metric, mean, median, std, min, max, n of finite values, one row a metric."""
    longer = df.unpivot([], [F.col(m).cast("double").alias(m) for m in metrics], "metric", "x").filter(finite("x"))
    middle = quantiles(longer, ["metric"], {"median": ("x", 0.5)})
    figures = longer.groupBy("metric").agg(
        F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"), F.count("x").alias("n")
    )
    return join_groups(figures, middle, ["metric"])


def sparsification(df: DataFrame, error: str, uncertainty: str, key: str, steps: int = 100) -> DataFrame:
    """step, ratio: mean error of the rows left when the most uncertain step/steps are taken away, over that of all.

    Rows are counted and summed by percentile bins; the curve is a running sum over the bins.
    """
    ranked = global_index(df.select(error, uncertainty, key), [F.desc(uncertainty), key], "r_")
    total = df.agg(F.count(F.lit(1)).alias("n"), F.sum(error).alias("s")).first()
    bins = ranked.withColumn("step", F.floor(F.col("r_") * steps / F.lit(max(total["n"], 1))))
    sums = bins.groupBy("step").agg(F.count(F.lit(1)).alias("n"), F.sum(error).alias("s"), F.lit(total["n"]).alias("n_"), F.lit(total["s"]).alias("s_"))
    left = Window.orderBy("step").rowsBetween(0, Window.unboundedFollowing)
    return sums.select("step", (F.sum("s").over(left) / F.sum("n").over(left) / (F.col("s_") / F.col("n_"))).alias("ratio"))


def class_iou(df: DataFrame, group: list[str], pred: Column, gt: Column, ignore: Column | None = None) -> DataFrame:
    """Intersections and unions of background and foreground: group, fg, inter, union_, iou."""
    rows = df.withColumn("p_", pred.cast("int")).withColumn("g_", gt.cast("int"))
    rows = rows.filter(~ignore) if ignore is not None else rows
    counts = rows.groupBy(*group).agg(
        *[f(k) for k in (0, 1) for f in (lambda k: F.count_if((F.col("p_") == k) & (F.col("g_") == k)).alias(f"i{k}"), lambda k: F.count_if((F.col("p_") == k) | (F.col("g_") == k)).alias(f"u{k}"))]
    )
    pair = F.explode(F.array(*[F.struct(F.lit(k).alias("fg"), F.col(f"i{k}").alias("inter"), F.col(f"u{k}").alias("union_")) for k in (0, 1)]))
    return counts.select(*group, pair.alias("x")).select(*group, "x.*", (F.col("x.inter") / F.greatest(F.col("x.union_"), F.lit(1))).alias("iou"))


def mean_iou(per_class: DataFrame) -> DataFrame:
    """miou of the foregrounds and fb_iou of summed intersections and unions."""
    return per_class.agg(
        F.avg(F.when(F.col("fg") == 1, F.col("iou"))).alias("miou"),
        (
            (F.sum(F.when(F.col("fg") == 0, F.col("inter"))) / F.sum(F.when(F.col("fg") == 0, F.col("union_"))))
            + (F.sum(F.when(F.col("fg") == 1, F.col("inter"))) / F.sum(F.when(F.col("fg") == 1, F.col("union_"))))
        ).alias("two_fb"),
    ).select("miou", (F.col("two_fb") / 2).alias("fb_iou"))


def auc(df: DataFrame, error: Column, most: int = 30) -> DataFrame:
    """Mean of the cumulative histogram of errors in bins of 1 from 0 to most; the last bin takes its right end."""
    total = df.count()
    bins = df.select(F.when(error == most, most - 1).otherwise(F.floor(error)).alias("bin")).filter((F.col("bin") >= 0) & (F.col("bin") < most))
    counts = bins.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    grid = df.sparkSession.range(most).select(F.col("id").alias("bin")).join(counts, "bin", "left")
    run = F.sum(F.coalesce("n", F.lit(0))).over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    return grid.select((run / max(total, 1)).alias("c")).agg(F.avg("c").alias("auc"))


def pose_errors(df: DataFrame, gt: list[str], pred: list[str]) -> DataFrame:
    """Statistics of the distances between two positions."""
    d = F.sqrt(sum(((F.col(a) - F.col(b)) * (F.col(a) - F.col(b)) for a, b in zip(gt, pred, strict=True)), F.lit(0.0)))
    rows = df.select(d.alias("d"))
    figures = rows.agg(
        F.avg("d").alias("mean"), F.stddev_pop("d").alias("std"), F.max("d").alias("max"), F.min("d").alias("min"), F.count("d").alias("n")
    )
    return join_groups(figures, quantiles(rows, [], {"median": ("d", 0.5)}), [])
