"""Reading the documents tables and picking the columns an operator needs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfield.session import ship_package


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def pieces(table, rows: int):
    """An Arrow record batch in slices of a number of rows, so that Python holds few texts at once."""
    for at in range(0, table.num_rows, rows):
        yield table.slice(at, rows)


def least_keys(df: DataFrame, key: str, most: int, total: int, *ties: str) -> DataFrame:
    """At most `most` of a table's `total` rows, those of least key (a 64-bit hash); equal keys by ties.

    Keys are even, so rows under a bound that about twice as many pass are enough to choose from: what
    tasks hand on does not grow with the table.
    """
    if total > 2 * most + 1000:
        df = df.filter(F.col(key) < int(-(2**63) + 2**64 * ((2 * most + 1000) / total)))
    return df.orderBy(key, *ties).limit(most)


def salted(rows: DataFrame, unique: DataFrame, key: str, share: int = 512, parts: int = 64) -> DataFrame:
    """rows joined to a table with one row for each key; no task gets all rows of a key that many have.

    Keys that hold more than a share of all rows, at most `share` keys, are broadcast; their rows are
    dealt over `parts` parts, and their single row of the other table is repeated for each.
    """
    total = rows.count()
    hot = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n_")).filter((F.col("n_") * share > total) & (F.col("n_") > parts))
    hot = F.broadcast(hot.select(key, F.lit(True).alias("hot_")))
    dealt = F.when(F.col("hot_"), F.pmod(F.monotonically_increasing_id(), F.lit(parts))).otherwise(F.lit(0).cast("long"))
    left = rows.join(hot, key, "left").withColumn("salt_", dealt).drop("hot_")
    salts = F.when(F.col("hot_"), F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    right = unique.join(hot, key, "left").withColumn("salt_", F.explode(salts)).drop("hot_")
    return left.join(right, [key, "salt_"]).drop("salt_")
