"""Dataset algebra: concatenation, repetition, resizing, splits and samples, deterministic by hash."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfield.plans.scratch import materialize


def global_index(df: DataFrame, order: list[Column | str], name: str = "index") -> DataFrame:
    """Rows numbered from 0 in a total order, without bringing them into one task.

    A range shuffle puts them in order; each partition numbers its own rows, and the sizes of the
    partitions before, one row a partition, are added.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("m_", F.monotonically_increasing_id())
    ordered = materialize(ordered, "ordered").withColumn("p_", F.shiftright("m_", 33))
    sizes = ordered.groupBy("p_").agg(F.count(F.lit(1)).alias("n_"))
    before = F.coalesce(F.sum("n_").over(Window.orderBy("p_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("p_", before.alias("o_"))
    numbered = ordered.join(F.broadcast(offsets), "p_").withColumn(name, F.col("o_") + F.col("m_").bitwiseAND((1 << 33) - 1))
    return numbered.drop("p_", "m_", "o_")


def concat(parts: list[tuple[str, DataFrame]], order: list[str]) -> DataFrame:
    """Rows of all parts with dataset, local_index and global_index (local plus the sizes before)."""
    numbered = [
        global_index(df, order, "local_index").withColumns({"dataset": F.lit(name), "ordinal_": F.lit(k)})
        for k, (name, df) in enumerate(parts)
    ]
    all_ = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)
    sizes = all_.groupBy("ordinal_").agg(F.count(F.lit(1)).alias("n_"))
    before = F.coalesce(F.sum("n_").over(Window.orderBy("ordinal_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("ordinal_", before.alias("o_"))
    return all_.join(F.broadcast(offsets), "ordinal_").withColumn("global_index", F.col("o_") + F.col("local_index")).drop("ordinal_", "o_")


def repeat(df: DataFrame, times: int) -> DataFrame:
    """Every row `times` times, adjacent, with copy from 0."""
    return df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))


def resize(df: DataFrame, key: str, size: int, seed: int = 0) -> DataFrame:
    """A permutation of the rows by hash of key and seed, extended cyclically and cut to size: position from 0."""
    total = df.count()
    if not total:
        return df.withColumn("position", F.lit(0).cast("long"))
    placed = global_index(df.withColumn("h_", F.xxhash64(F.col(key), F.lit(777 + seed))), ["h_", key], "i_").drop("h_")
    cycles = -(-size // total)
    out = placed.withColumn("c_", F.explode(F.sequence(F.lit(0), F.lit(max(0, cycles - 1)))))
    return out.withColumn("position", (F.col("c_") * total + F.col("i_")).cast("long")).filter(F.col("position") < size).drop("i_", "c_")


def fold_contiguous(df: DataFrame, cls: str, fold: int, per_fold: int, train: bool = False) -> DataFrame:
    inside = F.floor(F.col(cls) / per_fold) == fold
    return df.filter(~inside if train else inside)


def fold_strided(df: DataFrame, cls: str, fold: int, folds: int, train: bool = False) -> DataFrame:
    inside = F.pmod(F.col(cls), F.lit(folds)) == fold
    return df.filter(~inside if train else inside)


def range_split(df: DataFrame, value: str, limits: list[tuple[int, str]], rest: str) -> DataFrame:
    """split: the name of the first limit that a value is under."""
    out = F.when(F.col(value) < limits[0][0], limits[0][1])
    for limit, name in limits[1:]:
        out = out.when(F.col(value) < limit, name)
    return df.withColumn("split", out.otherwise(rest))


def min_group_size(df: DataFrame, group: str, least: int) -> DataFrame:
    """Rows of groups with enough rows; groups are counted before they are joined back."""
    good = df.groupBy(group).agg(F.count(F.lit(1)).alias("n_")).filter(F.col("n_") >= least).select(group)
    return df.join(good, group, "left_semi")


def shard_prune(df: DataFrame, shard: Column, begin: int, end: int) -> DataFrame:
    return df.filter((shard >= begin) & (shard < end))


def systematic(df: DataFrame, order: list[str], most: int) -> DataFrame:
    """Every ceil(n / most)-th row in order."""
    stride = max(1, -(-df.count() // most))
    out = global_index(df, order, "i_")
    return out.filter(F.pmod(F.col("i_"), F.lit(stride)) == 0).drop("i_")


def first_n(df: DataFrame, group: list[str], order: list[str], n: int) -> DataFrame:
    return df.withColumn("r_", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("r_") <= n).drop("r_")


def sample_n(df: DataFrame, group: list[str], key: str, n: int, seed: int) -> DataFrame:
    """n rows of each group without replacement, by hash of key and seed."""
    return first_n(df.withColumn("h_", F.xxhash64(F.col(key), F.lit(seed))), group, ["h_", key], n).drop("h_")


def split_by_hash(df: DataFrame, key: str, share: float = 0.9, seed: int = 0) -> DataFrame:
    """split: train or val, the same for all rows of a key."""
    part = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(10_000)) / 10_000
    return df.withColumn("split", F.when(part < share, "train").otherwise("val"))


def batches(df: DataFrame, key: str, size: int, pool: int, seed: int) -> DataFrame:
    """Full batches of a shuffled table: batch, and feature, the same within a batch."""
    out = global_index(df.withColumn("h_", F.xxhash64(F.col(key), F.lit(seed))), ["h_", key], "i_")
    out = out.withColumn("batch", F.floor(F.col("i_") / size)).filter(F.col("batch") < df.count() // size).drop("h_", "i_")
    return out.withColumn("feature", F.pmod(F.xxhash64("batch", F.lit(seed)), F.lit(pool)))


def margin_best(df: DataFrame, group: str, ident: str, score: str, share: float = 0.6) -> DataFrame:
    """The best row's id of each group whose score is at least share of the best and second best together."""
    top = first_n(df, [group], [F.desc(score), ident], 2)
    both = top.groupBy(group).agg(
        F.max_by(ident, F.struct(F.col(score), -F.col(ident))).alias("best_id"), F.max(score).alias("best"), F.when(F.count(F.lit(1)) > 1, F.min(score)).alias("second")
    )
    return both.filter(F.col("best") >= share * (F.col("best") + F.greatest(F.coalesce("second", F.lit(0.0)), F.lit(0.0))))


def renumber(df: DataFrame, order: list[Column | str], prefix: str = "object_") -> DataFrame:
    """object_id by order, from object_0001 on."""
    return global_index(df, order, "i_").withColumn("object_id", F.format_string(prefix + "%04d", F.col("i_") + 1)).drop("i_")


def latest(df: DataFrame, key: str, sequence: str) -> DataFrame:
    """The last row of each key: an append log read as a table of full replacements."""
    best = df.groupBy(key).agg(F.max_by(F.struct(*[c for c in df.columns if c != key]), sequence).alias("b"))
    return best.select(key, "b.*")
