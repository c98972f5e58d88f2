"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step is a map-side combined minimum and an equi-join on the node, so a hub with a third of
all edges is pre-aggregated before it is shuffled and its join partition can be split by AQE.
Nothing is collected: only an edge count and a checksum reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfield.plans.scratch import drop_path, materialize_at


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (src > dst) to edges (src > dst).

    Large star: each node's larger neighbours move to its smallest neighbour (or itself).
    Small star: each node and its smaller neighbours move to the smallest of them.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = both.groupBy("src").agg(F.min("dst").alias("low"))
        moved = (
            both.filter("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.least("low", "src").alias("dst"))
        )
    else:
        least = edges.groupBy("src").agg(F.min("dst").alias("low"))
        joined = edges.join(least, "src")
        moved = joined.select(F.col("dst").alias("src"), F.col("low").alias("dst")).unionByName(
            least.select("src", F.col("low").alias("dst"))
        )
    return moved.filter("src > dst").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that has an edge; component is the smallest node reachable.

    Null ends, loops and repeated edges are ignored. Raises if max_rounds is not enough.
    """
    spark = edges.sparkSession
    start = (
        edges.select(F.greatest(a, b).alias("src"), F.least(a, b).alias("dst"))
        .filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("src") != F.col("dst")))
        .distinct()
    )
    current, path = materialize_at(start, "edges")
    sign = None
    for _ in range(max_rounds):
        following, new = materialize_at(_star(_star(current, large=True), large=False), "edges")
        drop_path(spark, path)
        current, path = following, new
        row = current.agg(
            F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("src", "dst")).alias("x")
        ).first()
        if (row["n"], row["x"]) == sign:
            break
        sign = (row["n"], row["x"])
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = current.select(F.col("dst").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return current.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(roots)
