"""Aggregations, bounded pools and set-wise helpers over frames, masks, scores and records."""

from __future__ import annotations

from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfield.operators.quantiles import join_groups, quantiles


def cumulative_class_iou(df: DataFrame, image: str, pred: str, gt: str, classes: int) -> DataFrame:
    """(class_id, iou): each class's mean over images, in order, of its IoU cumulated so far.

    Pixels are counted by image and class first; the running sums then see one row for each.
    """
    both = F.explode(F.array(F.struct(F.col(pred).alias("c"), (F.col(pred) == F.col(gt)).cast("long").alias("i"), F.lit(1).alias("u")), F.struct(F.col(gt).alias("c"), F.lit(0).cast("long").alias("i"), (F.col(pred) != F.col(gt)).cast("int").alias("u"))))
    counts = df.select(image, both.alias("x")).groupBy(image, F.col("x.c").alias("class_id")).agg(F.sum("x.i").alias("i"), F.sum("x.u").alias("u"))
    grid = df.select(image).distinct().withColumn("class_id", F.explode(F.sequence(F.lit(0), F.lit(classes - 1))))
    w = Window.partitionBy("class_id").orderBy(image).rowsBetween(Window.unboundedPreceding, 0)
    rows = grid.join(counts, [image, "class_id"], "left").select(image, "class_id", F.coalesce("i", F.lit(0)).alias("i"), F.coalesce("u", F.lit(0)).alias("u"))
    return rows.select("class_id", (F.sum("i").over(w) / F.greatest(F.sum("u").over(w), F.lit(1))).alias("v")).groupBy("class_id").agg(F.avg("v").alias("iou"))


def pixel_accuracy(df: DataFrame, group: list[str], pred: str, gt: str) -> DataFrame:
    return df.groupBy(*group).agg(F.avg((F.col(pred) == F.col(gt)).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("pixels"))


def average_meter(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """val, sum, count and avg so far."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("val", F.col(value)).withColumn("sum", F.sum(value).over(w)).withColumn("count", F.count(value).over(w)).withColumn("avg", F.avg(value).over(w))


def merge_meters(parts: DataFrame, group: list[str], total: str, count: str) -> DataFrame:
    """Workers' sums and counts as one: only these two travel."""
    return parts.groupBy(*group).agg(F.sum(total).alias("total"), F.sum(count).alias("n")).withColumn("global_avg", F.col("total") / F.greatest(F.col("n"), F.lit(1)))


def masked_median(df: DataFrame, group: list[str], value: str, mask: Column) -> DataFrame:
    """Median of the values under the mask; NaN if there are none."""
    return quantiles(df.withColumn("m_", F.when(mask, F.col(value))), group, {"median": ("m_", 0.5)}).withColumn("median", F.coalesce("median", F.lit(float("nan"))))


def joint_quantile(parts: list[DataFrame], group: list[str], depth: str, valid: Column, share: float = 0.5) -> DataFrame:
    """One quantile over the valid depths of several views together; NaN is no depth."""
    rows = parts[0].select(*group, depth, valid.alias("ok_"))
    for p in parts[1:]:
        rows = rows.unionByName(p.select(*group, depth, valid.alias("ok_")))
    return rows.filter(F.col("ok_") & ~F.isnan(F.col(depth).cast("double"))).transform(lambda held: quantiles(held, group, {"depth": (depth, share)}))


def mean_distance_scale(points: DataFrame, group: list[str], mask: Column, least: float = 1e-3, most: float = 1e3) -> DataFrame:
    """Mean distance of the masked points from the first camera, their origin, within limits."""
    far = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)
    m = F.coalesce(mask, F.lit(False)).cast("double")
    return points.groupBy(*group).agg(F.least(F.greatest(F.sum(far * m) / (F.sum(m) + 1e-3), F.lit(least)), F.lit(most)).alias("scale"))


def masks_info(frames: DataFrame, group: list[str], frame: str, masks: str) -> DataFrame:
    """Frames, frames with masks, masks, and masks of each frame in order."""
    return frames.groupBy(*group).agg(
        F.count(F.lit(1)).alias("frames"),
        F.count_if(F.col(masks) > 0).alias("with_masks"),
        F.sum(masks).alias("masks"),
        F.transform(F.array_sort(F.collect_list(F.struct(frame, masks))), lambda x: x[masks]).alias("per_frame"),
    )


def cloud_info(points: DataFrame, group: list[str]) -> DataFrame:
    """Number of points and their bounding box."""
    return points.groupBy(*group).agg(F.count(F.lit(1)).alias("points"), *[f(a).alias(f"{n}_{a}") for a in "xyz" for n, f in (("min", F.min), ("max", F.max))])


def tile_average(scores: DataFrame, pixel: list[str], score: str) -> DataFrame:
    """Scores of overlapping tiles and flips, summed and divided by how many cover a pixel."""
    return scores.groupBy(*pixel).agg((F.sum(score) / F.count(score)).alias(score))


def members(df: DataFrame, cls: str, ident: str) -> DataFrame:
    """Each class's or scene's members in order."""
    return df.groupBy(cls).agg(F.array_sort(F.collect_set(ident)).alias("members"))


def by_directory(paths: DataFrame, path: str, component: int) -> DataFrame:
    """Paths with the component of theirs that they are grouped by, counted from 1, or from the end if negative."""
    return paths.select(F.try_element_at(F.split(path, "/"), F.lit(component)).alias("directory"), path)


def ranked_labels(df: DataFrame, label: str) -> DataFrame:
    """Distinct labels and their rank from 0. Labels are few: their ranks take one task."""
    return df.select(label).distinct().withColumn("rank", F.dense_rank().over(Window.orderBy(label)) - 1)


def principal_colours(df: DataFrame, feature: str, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """Features of all views on their first three principal axes, each stretched from a low to a high percentile."""
    n = len(df.select(feature).first()[0])
    wide = df.select("*", *[F.col(feature)[k].cast("double").alias(f"f{k}_") for k in range(n)])
    vectors = VectorAssembler(inputCols=[f"f{k}_" for k in range(n)], outputCol="v_").transform(wide)
    found = PCA(k=3, inputCol="v_", outputCol="p_").fit(vectors).transform(vectors).withColumn("p_", vector_to_array("p_"))
    axes = found.select(*[F.col("p_")[k].alias(f"a{k}") for k in range(3)])
    ends = quantiles(axes, [], {f"{e}{k}": (f"a{k}", s) for k in range(3) for e, s in (("lo", low), ("hi", high))}).first()
    scaled = [F.least(F.greatest((F.col("p_")[k] - ends[f"lo{k}"]) / max(ends[f"hi{k}"] - ends[f"lo{k}"], 1e-12), F.lit(0.0)), F.lit(1.0)) for k in range(3)]
    return found.withColumn("colour", F.array(*scaled)).drop("v_", "p_", *[f"f{k}_" for k in range(n)])


def least_absolute(df: DataFrame, x: str, y: str, rounds: int = 50, tiny: float = 1e-6) -> tuple[float, float]:
    """(s, t) with the least sum of |s x + t - y|, by reweighted sums: a round is one aggregation of five numbers."""
    s, t = 1.0, 0.0
    for k in range(rounds):
        w = F.lit(1.0) if not k else 1 / F.greatest(F.abs(F.col(x) * s + t - F.col(y)), F.lit(tiny))
        a = df.agg(*[F.sum(w * c).alias(n) for n, c in (("w", F.lit(1.0)), ("x", F.col(x)), ("y", F.col(y)), ("xx", F.col(x) * F.col(x)), ("xy", F.col(x) * F.col(y)))]).first()
        if a["w"] is None:
            break
        det = a["w"] * a["xx"] - a["x"] * a["x"]
        new = ((a["w"] * a["xy"] - a["x"] * a["y"]) / det, (a["xx"] * a["y"] - a["x"] * a["xy"]) / det) if det else (0.0, a["y"] / a["w"])
        done = max(abs(new[0] - s), abs(new[1] - t)) < tiny
        s, t = new
        if done:
            break
    return s, t


def spaced_neighbours(ranked: DataFrame, anchor: str, rank: str, most: int, count: int) -> DataFrame:
    """Of each anchor's `most` nearest, `count` at even distances of rank from the first on."""
    stride = max(1, most // count)
    return ranked.filter((F.col(rank) <= most) & ((F.col(rank) - 1) % stride == 0) & (F.col(rank) <= stride * count))


def last_n(df: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """What a first-in first-out pool of n holds at the end; `order` decides without ties."""
    w = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("r_", F.row_number().over(w)).filter(F.col("r_") <= n).drop("r_")


def fifo_mean(df: DataFrame, key: str, order: list[str], value: str, n: int) -> DataFrame:
    """Mean of a bounded pool after each push."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(-(n - 1), 0)
    return df.withColumn("pool_mean", F.avg(value).over(w))


def arg_least(df: DataFrame, group: list[str], ident: str, value: str) -> DataFrame:
    """The id of each group's least value; of equal ones the least id."""
    return df.groupBy(*group).agg(F.min_by(ident, F.struct(value, ident)).alias(ident), F.min(value).alias(value))


def arg_most(df: DataFrame, group: list[str], ident: str, value: str) -> DataFrame:
    """The id of each group's greatest value; of equal ones the least id."""
    return df.groupBy(*group).agg(F.max_by(ident, F.struct(value, -F.col(ident))).alias(ident), F.max(value).alias(value))


def top_n(df: DataFrame, group: list[str], score: str, ident: str, n: int) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(F.col(score).desc(), ident)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def fetch(indexed: DataFrame, index: str, wanted: DataFrame) -> DataFrame:
    """Rows of a concatenated sequence set at the wanted indexes, as often as they are asked for."""
    return wanted.join(indexed, index)


def side_by_side(left: DataFrame, right: DataFrame, ordinal: str) -> DataFrame:
    """Two tables' columns next to each other by ordinal; what one lacks is null."""
    return left.join(right, ordinal, "full_outer")


def merge_records(df: DataFrame, key: str, order: str, lists: list[str], single: list[str]) -> DataFrame:
    """Records of one key as one: lists one after the other in order, of other fields the first."""
    packed = F.array_sort(F.collect_list(F.struct(order, *lists)))

    def field(name: str) -> Column:
        return F.flatten(F.transform(packed, lambda x: x[name])).alias(name)

    return df.groupBy(key).agg(*map(field, lists), *[F.min_by(c, order).alias(c) for c in single])


def sorted_union(df: DataFrame, values: str) -> DataFrame:
    """Distinct values of all lists."""
    return df.select(F.explode(values).alias("value")).distinct().orderBy("value")


def matching_tensors(model: DataFrame, checkpoint: DataFrame) -> DataFrame:
    """Checkpoint tensors that the model has by name and shape; raises if there are none."""
    found = checkpoint.join(model.select("name", "shape"), ["name", "shape"], "left_semi")
    if found.isEmpty():
        raise ValueError("no tensor of the checkpoint fits the model")
    return found


def latest_version(names: DataFrame, name: str, pattern: str = "version_([0-9]+)") -> DataFrame:
    number = F.regexp_extract(name, pattern, 1)
    return names.filter(number != "").agg(F.max_by(name, number.cast("long")).alias(name), F.max(number.cast("long")).alias("version"))


def min_max(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Values of each item brought to 0 to 1; an item of one value is 0."""
    ends = df.groupBy(*group).agg(F.min(value).alias("lo_"), F.max(value).alias("hi_"))
    scaled = F.coalesce(F.try_divide(F.col(value) - F.col("lo_"), F.col("hi_") - F.col("lo_")), F.lit(0.0))
    return join_groups(df, ends, group).withColumn(value, scaled).drop("lo_", "hi_")


def with_empty_metrics(frames: DataFrame, metrics: DataFrame, key: str, counts: list[str]) -> DataFrame:
    """A row of metrics for every frame: NaN, and 0 for counts, where nothing was measured."""
    out = frames.join(metrics, key, "left")
    for c in metrics.columns:
        if c != key:
            out = out.withColumn(c, F.coalesce(c, F.lit(0) if c in counts else F.lit(float("nan"))))
    return out


def multiple(total: Column | str, of: int, up: bool = False) -> Column:
    """A number brought to a multiple, downwards or upwards."""
    total = F.col(total) if isinstance(total, str) else total
    return ((F.ceil(total / of) if up else F.floor(total / of)) * of).cast("long")
