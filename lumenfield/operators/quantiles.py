"""Exact quantiles of groups of any size, by histograms that are refined where the quantiles lie.

Groups of at most FEW values are sorted as they are. Of larger ones each pass counts the values between
two bounds in BINS bins, all groups and quantiles at once, and keeps of each quantile the bin that
holds it, until that holds few values or only one distinct value. What tasks hand on is a row for each bin,
however large a group is, and no task holds a group's values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfield.plans.scratch import materialize

FEW, BINS = 100_000, 1024


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys])


def join_groups(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """left with right's other columns; null keys are equal; without keys right has one row for all."""
    if not keys:
        keys = ["one_"]
        return join_groups(left.withColumn("one_", F.lit(0)), right.withColumn("one_", F.lit(0)), keys, how).drop("one_")
    named = right.withColumnsRenamed({k: f"{k}_g_" for k in keys})
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"{k}_g_")) for k in keys])
    return left.join(named, same, how).drop(*[f"{k}_g_" for k in keys])


def quantiles(df: DataFrame, group: list[str], wanted: dict[str, tuple[str | Column, float]], few: int = FEW, bins: int = BINS) -> DataFrame:
    """group, and a column for each wanted name: the quantile (0 to 1, linear between ranks) of a column's finite values.

    Null where a group has none. Each group of df has a row; without group columns there is one row.
    """
    columns = {name: (F.col(c) if isinstance(c, str) else c).cast("double") for name, (c, _) in wanted.items()}
    finite = {name: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c) for name, c in columns.items()}
    counts = df.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if counts <= few:
        return df.groupBy(*group).agg(*[F.percentile(finite[name], F.lit(share)).alias(name) for name, (_, share) in wanted.items()])
    # values that several quantiles are of are kept once
    texts = {name: str(c) for name, c in columns.items()}
    number = {text: k for k, text in enumerate(dict.fromkeys(texts.values()))}
    of = {number[texts[name]]: finite[name] for name in wanted}
    every = F.explode(F.array(*[F.struct(F.lit(k).alias("col_"), c.alias("x_")) for k, c in of.items()])).alias("v")
    values = materialize(df.select(*group, every).select(*group, "v.*").filter("x_ is not null"), "values")
    keys = [*group, "col_"]
    sizes = materialize(values.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_"), F.min("x_").alias("lo_"), F.max("x_").alias("hi_")), "sizes")
    ranks = [F.struct(F.lit(number[texts[name]]).alias("c"), F.lit(name).alias("name_"), F.lit(float(share)).alias("share_")) for name, (_, share) in wanted.items()]
    place = F.col("share_") * (F.col("n_") - 1)
    goals = sizes.withColumn("q", F.explode(F.array(*ranks))).filter("q.c = col_").select(*keys, "n_", "lo_", "hi_", "q.name_", "q.share_").withColumn("place_", place)
    goals = goals.select("*", F.explode(F.array(F.floor("place_"), F.ceil("place_"))).alias("rank_")).distinct()
    ends = F.when((F.col("lo_") == F.col("hi_")) | (F.col("rank_") <= 0), F.col("lo_")).when(F.col("rank_") >= F.col("n_") - 1, F.col("hi_"))
    goals = materialize(goals.withColumn("wanted_", F.col("rank_")).withColumn("value_", ends), "goals")
    done = []
    while True:
        done.append(goals.filter("value_ is not null or n_ <= %d" % few))
        open_goals = goals.filter("value_ is null and n_ > %d" % few)
        if not open_goals.limit(1).count():
            break
        spans = open_goals.select(*keys, "lo_", "hi_").distinct()
        inside = join_groups(values, spans, keys, "inner").filter("x_ between lo_ and hi_")
        # halves, so that the width of the widest range is finite
        part = (F.col("x_") / 2 - F.col("lo_") / 2) / (F.col("hi_") / 2 - F.col("lo_") / 2)
        counted = inside.groupBy(*keys, "lo_", "hi_", F.least(F.floor(part * bins), F.lit(bins - 1)).alias("bin_"))
        counted = materialize(counted.agg(F.count(F.lit(1)).alias("m_"), F.min("x_").alias("least_"), F.max("x_").alias("most_")), "bins")
        before = F.coalesce(F.sum("m_").over(Window.partitionBy(*keys, "lo_", "hi_").orderBy("bin_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        counted = counted.withColumn("before_", before)
        found = join_groups(open_goals, counted, [*keys, "lo_", "hi_"], "inner").filter("rank_ >= before_ and rank_ < before_ + m_")
        goals = found.select(*keys, F.col("m_").alias("n_"), F.col("least_").alias("lo_"), F.col("most_").alias("hi_"), "name_", "share_", "place_", (F.col("rank_") - F.col("before_")).alias("rank_"), "wanted_")
        goals = materialize(goals.withColumn("value_", ends), "goals")
    known = materialize(reduce(DataFrame.unionByName, done), "found")
    few_left = known.filter("value_ is null")
    spans = few_left.select(*keys, "lo_", "hi_").distinct()
    held = join_groups(values, spans, keys, "inner").filter("x_ between lo_ and hi_").groupBy(*keys, "lo_", "hi_").agg(F.array_sort(F.collect_list("x_")).alias("xs_"))
    sorted_ = join_groups(few_left, held, [*keys, "lo_", "hi_"], "inner").withColumn("value_", F.element_at("xs_", (F.col("rank_") + 1).cast("int")))
    both = known.filter("value_ is not null").select(*group, "name_", "place_", "wanted_", "value_").unionByName(sorted_.select(*group, "name_", "place_", "wanted_", "value_"))
    weight = 1 - F.abs(F.col("place_") - F.col("wanted_"))
    wide = both.groupBy(*group).agg(*[F.sum(F.when(F.col("name_") == name, F.col("value_") * weight)).alias(name) for name in wanted])
    everyone = df.groupBy(*group).agg(F.count(F.lit(1)).alias("n_")).drop("n_") if group else df.sparkSession.range(1).select()
    return join_groups(everyone, wide, group)
