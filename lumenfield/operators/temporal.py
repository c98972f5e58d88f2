"""Ordered and time-based operators: nearest and bracket joins, decimation, moving statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _merged(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, values: list[str]) -> DataFrame:
    """Left and right rows on one time line; each row sees the right rows around it.

    One shuffle and one sort by (key, time): an as-of join without a range join.
    """
    pack = F.struct(F.col(right_ts).alias("ts"), *values)
    rows = left.select(F.col(key).alias("k_"), F.col(left_ts).alias("t_"), F.struct(*left.columns).alias("l_"), F.lit(None).alias("r_")).unionByName(
        right.select(F.col(key).alias("k_"), F.col(right_ts).alias("t_"), F.lit(None).alias("l_"), pack.alias("r_"))
    )
    # both frames start at the partition's end that comes first in their order, so that each grows row by row
    back = Window.partitionBy("k_").orderBy("t_").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = Window.partitionBy("k_").orderBy(F.col("t_").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        rows.withColumn("before_", F.max("r_").over(back))
        .withColumn("after_", F.min("r_").over(ahead))
        .filter("l_ is not null")
        .select("l_.*", "before_", "after_")
    )


def asof_nearest(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, values: list[str], after_end: str = "drop") -> DataFrame:
    """Each left row with the right row of its key that is nearest in time; ties go to the earlier one.

    Of right rows with equal times the greatest by value serves looking back, the least looking ahead.
    Rows later than the last right row are dropped, or kept with after_end="keep".
    """
    both = _merged(left, right, key, left_ts, right_ts, values)
    back, ahead = F.col(left_ts) - F.col("before_.ts"), F.col("after_.ts") - F.col(left_ts)
    pick = F.when(F.col("after_").isNull() | (back <= ahead), F.col("before_")).otherwise(F.col("after_"))
    out = both.filter("after_ is not null") if after_end == "drop" else both
    out = out.withColumn("n_", pick).filter("n_ is not null")
    return out.select(*left.columns, F.col("n_.ts").alias("matched_ts"), *[F.col(f"n_.{v}").alias(f"matched_{v}") for v in values])


def interpolate_linear(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, values: list[str]) -> DataFrame:
    """Each left row with right's values interpolated at its time; clamped to the first and last right row."""
    both = _merged(left, right, key, left_ts, right_ts, values).filter("before_ is not null or after_ is not null")
    a, b = F.coalesce("before_", "after_"), F.coalesce("after_", "before_")
    both = both.withColumn("a_", a).withColumn("b_", b)
    span = F.col("b_.ts") - F.col("a_.ts")
    share = F.when(span == 0, F.lit(0.0)).otherwise((F.col(left_ts) - F.col("a_.ts")) / span)
    out = [(F.col(f"a_.{v}") + (F.col(f"b_.{v}") - F.col(f"a_.{v}")) * share).alias(v) for v in values]
    return both.select(*left.columns, *out)


def leading_skip(df: DataFrame, key: str, order: list[str], dark: Column, most: float = 0.5) -> DataFrame:
    """Each key's rows from its first one that is not dark, or from the share `most` of its rows at the latest."""
    w = Window.partitionBy(key).orderBy(*order)
    whole = Window.partitionBy(key)
    out = df.withColumn("i_", F.row_number().over(w) - 1).withColumn("d_", dark)
    first = F.min(F.when(~F.col("d_"), F.col("i_"))).over(whole)
    cap = F.floor(F.count(F.lit(1)).over(whole) * most)
    start = F.least(F.coalesce(first, cap + 1), cap + 1)
    return out.withColumn("s_", start).filter("i_ >= s_").drop("i_", "d_", "s_")


def decimate(df: DataFrame, key: str, ts: str, interval: float, order: list[str]) -> DataFrame:
    """The first row of every interval since its key's first time; equal to the accumulating rule for rows denser than that."""
    start = F.min(ts).over(Window.partitionBy(key))
    out = df.withColumn("b_", F.floor((F.col(ts) - start) / interval))
    return out.withColumn("r_", F.row_number().over(Window.partitionBy(key, "b_").orderBy(ts, *order))).filter("r_ = 1").drop("b_", "r_")


def decimate_accumulating(df: DataFrame, key: str, ts: str, interval: float, order: list[str]) -> DataFrame:
    """Rows at or after the next mark, which moves on by one interval for each row taken, from the key's first time.

    After gaps several rows in a row are taken until the marks have caught up. A row's number of marks
    reached bounds how many may be taken up to it, and each row takes one at most: what is taken up to row
    n is the least, over rows m up to n, of the marks reached at m and the rows after it.
    """
    w = Window.partitionBy(key).orderBy(ts, *order)
    reached = F.floor((F.col(ts) - F.first(ts).over(w)) / interval) + 1
    placed = df.withColumn("n_", F.row_number().over(w)).withColumn("c_", reached - F.col("n_"))
    upto = F.col("n_") + F.least(F.min("c_").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    taken = placed.withColumn("t_", upto)
    return taken.withColumn("b_", F.coalesce(F.lag("t_").over(w), F.lit(0))).filter("t_ > b_").drop("n_", "c_", "t_", "b_")


def moving(df: DataFrame, key: str, order: list[str], value: str, last: int = 20) -> DataFrame:
    """Mean, maximum and lower median of the last rows, and the running mean of all."""
    w = Window.partitionBy(key).orderBy(*order)
    near, all_ = w.rowsBetween(1 - last, 0), w.rowsBetween(Window.unboundedPreceding, 0)
    held = F.sort_array(F.collect_list(value).over(near))
    return (
        df.withColumn("moving_avg", F.avg(value).over(near))
        .withColumn("moving_max", F.max(value).over(near))
        .withColumn("moving_median", F.element_at(held, F.floor((F.size(held) + 1) / 2).cast("int")))
        .withColumn("global_avg", F.avg(value).over(all_))
    )


def every_nth(df: DataFrame, key: str, order: list[str], stride: int, skip: int = 0) -> DataFrame:
    """Rows skip, skip + stride, ... of each key."""
    out = df.withColumn("i_", F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1)
    return out.filter((F.col("i_") >= skip) & (F.pmod(F.col("i_") - skip, F.lit(stride)) == 0)).drop("i_")


def rebase_first(df: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """Values less those of the key's first row."""
    first = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumns({v: F.col(v) - F.first(v).over(first) for v in values})


def time_delta(df: DataFrame, key: str, ts: str, least: float = 1e-6) -> DataFrame:
    """Seconds since the row before, of milliseconds; at least `least`, and 0 for the first row."""
    step = (F.col(ts) - F.lag(ts).over(Window.partitionBy(key).orderBy(ts))) / 1000.0
    return df.withColumn("dt", F.coalesce(F.greatest(step, F.lit(least)), F.lit(0.0)))


def run_lengths(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Runs of equal values in order: key, run (from 0), value, length."""
    w = Window.partitionBy(key).orderBy(*order)
    change = F.coalesce((~F.lag(value).over(w).eqNullSafe(F.col(value))).cast("int"), F.lit(1))
    change = F.when(F.row_number().over(w) == 1, 0).otherwise(change)
    runs = df.withColumn("c_", change).withColumn("run", F.sum("c_").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(key, "run").agg(F.first(value).alias(value), F.count(F.lit(1)).alias("length"))
