"""Near-duplicate vectors through a pivot-permutation index.

A vector is described by the ordered list of its NEAREST reference points (pivots), themselves rows
of the table. Pivots are fitted on a bounded sample, SAMPLE times their number of distinct vectors
with the least hashes, farthest first, so that a dense group does not take more than its share of
them. Their number is the square root of a quarter of the distinct vectors, 96 to 4,096, which keeps
lists short at every size; they are broadcast (at most 4,096 vectors). Two vectors are compared if their lists share at least SHARED pivots. The inverted lists are kept by
sets of SHARED pivots instead of single ones: two vectors share that many exactly if they meet in
one of those lists, and the lists stay short, which single pivots' lists would not.

Vectors that meet are compared in blocks by matrix products in double precision. A pair that meets
in several lists is taken in one of them, known from the counts of pivots that it shares. A list
longer than BLOCK is dealt over several tasks as all pairs of its blocks of BLOCK vectors. What comes
out is, for each vector and block, its number of links and one edge to each group that it joins, so
no pairs are emitted. Equal vectors are collapsed first and counted by their number.

A vector that is null, empty, zero or holds null or non-finite components links with nothing. Vectors
of different lengths are never linked; each length has an index of its own. Each row of the table returns one row, repeated rows and vec_ids too; rows
with a null vec_id link like others and name a component only if all of its ids are null; kept is
then false. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfield.llm.tables import least_keys, salted
from lumenfield.operators.components import connected_components
from lumenfield.plans.scratch import materialize
from lumenfield.session import ship_package

LEAST = 0.95
NEAREST, SHARED, BLOCK = 6, 2, 512
FEWEST, MOST, SAMPLE = 96, 4096, 8


def unit_rows(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as rows of length 1, in double precision."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    matrix = values.reshape(len(column), -1)
    # scaled by the largest component first, so that squares neither overflow nor vanish
    matrix = matrix / np.abs(matrix).max(1, keepdims=True)
    return matrix / np.sqrt((matrix * matrix).sum(1, keepdims=True))


def spread(sample: np.ndarray, count: int) -> np.ndarray:
    """Rows of a sample, each the farthest from those before it."""
    chosen, closest = [0], sample @ sample[0]
    while len(chosen) < min(count, len(sample)):
        following = int(closest.argmin())
        if closest[following] > 1 - 1e-12:
            break
        chosen.append(following)
        np.maximum(closest, sample @ sample[following], out=closest)
    return sample[chosen]


def nearest(vectors: np.ndarray, pivots: np.ndarray, count: int) -> np.ndarray:
    """Numbers of each row's nearest pivots, nearest first; ties by number."""
    away = -(vectors @ pivots.T)
    if count < away.shape[1]:
        some = np.sort(np.argpartition(away, count - 1, axis=1)[:, :count], axis=1)
    else:
        some = np.broadcast_to(np.arange(away.shape[1]), away.shape)
    order = np.argsort(np.take_along_axis(away, some, 1), axis=1, kind="stable")
    return np.take_along_axis(some, order, 1).astype(np.int32)


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the links i-j among n rows connect: each row to its group's first."""
    low = np.arange(n)
    while True:
        before = low.copy()
        np.minimum.at(low, i, low[j])
        np.minimum.at(low, j, low[i])
        low = low[low]
        if (before == low).all():
            break
    own = np.flatnonzero(low != np.arange(n))
    return own, low[own]


def compare(uid: np.ndarray, weight: np.ndarray, vectors: np.ndarray, lists: np.ndarray, triple: list[int], pivots: int, half: np.ndarray, least: float) -> tuple[np.ndarray, ...]:
    """Links among the members of a list that are this list's to report: (uid, links, edge to).

    half: 0 and 1 for two blocks that are compared with each other only, all 2 for one block.
    """
    holds = np.zeros((len(uid), pivots), np.float32)
    np.put_along_axis(holds, lists.astype(np.int64), 1, axis=1)
    a = np.flatnonzero(half != 1)
    b = a if (half == 2).all() else np.flatnonzero(half == 1)
    if not len(a) or not len(b):
        return (np.zeros(0, np.int64),) * 3
    linked = vectors[a] @ vectors[b].T >= least
    # the list is a pair's first if no more than its own pivots are shared up to the last of them
    shared = holds[a][:, : triple[-1] + 1] @ holds[b][:, : triple[-1] + 1].T
    linked &= shared == len(triple)
    if a is b:
        np.fill_diagonal(linked, False)
    count = np.zeros(len(uid), np.int64)
    count[a] += linked @ weight[b]
    if a is not b:
        count[b] += weight[a] @ linked
    i, j = np.nonzero(linked)
    own, to = _forest(a[i], b[j], len(uid))
    edge = uid.copy()
    edge[own] = uid[to]
    used = np.flatnonzero(count)
    return uid[used], count[used], edge[used]


def near_duplicates(
    table: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    least: float = LEAST,
    pivots: int | None = None,
    k: int = NEAREST,
    shared: int = SHARED,
    block: int = BLOCK,
) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    spark = table.sparkSession
    ship_package(spark)
    kind = "array<float>" if dict(table.dtypes)[embedding] == "array<float>" else "array<double>"
    rows = table.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast(kind).alias("v"))
    good = F.coalesce(
        (F.size("v") > 0)
        & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists("v", lambda x: x != 0),
        F.lit(False),
    )
    rows = materialize(rows.withColumn("vec", F.when(good, F.col("v"))).select("vec_id", "vec"), "vectors")
    lengths_found = sorted(r["d"] for r in rows.filter("vec is not null").select(F.size("vec").alias("d")).distinct().collect())
    alone = rows.filter("vec is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = alone
    for length in lengths_found:
        fits = rows.filter(F.coalesce(F.size("vec") == length, F.lit(False)))
        out = out.unionByName(_linked(fits, kind, least, pivots, k, shared, block))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _linked(rows: DataFrame, kind: str, least: float, pivots: int | None, k: int, shared: int, block: int) -> DataFrame:
    """vec_id, n_links and component_id of vectors of one length."""
    spark = rows.sparkSession
    distinct = (
        rows.groupBy("vec")
        .agg(F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("least_id"))
        .withColumn("uid", F.monotonically_increasing_id())
    )
    distinct = materialize(distinct, "distinct")
    pivots = pivots or min(MOST, max(FEWEST, round((distinct.count() / 4) ** 0.5)))
    keyed = distinct.select("vec", F.xxhash64("vec").alias("key"))
    sample = least_keys(keyed, "key", SAMPLE * pivots, distinct.count(), "vec").select("vec").toArrow()
    points = spread(unit_rows(sample.column("vec").combine_chunks()), pivots)
    k_own, shared_own = min(k, len(points)), min(shared, len(points))
    count, sent = len(points), spark.sparkContext.broadcast(points)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = unit_rows(batch.column("vec"))
            lists = nearest(vectors, sent.value, k_own)
            ordered = np.sort(lists, axis=1).astype(np.int64)
            sets = list(itertools.combinations(range(k_own), shared_own))
            keys = np.zeros((len(lists), len(sets)), np.int64)
            for n, own in enumerate(sets):
                for at in own:
                    keys[:, n] = keys[:, n] * count + ordered[:, at]
            yield pa.RecordBatch.from_arrays(
                [batch.column("uid"), batch.column("weight"), batch.column("vec"), pa.array(list(lists.astype(np.int16))), pa.array(list(keys))],
                ["uid", "weight", "vec", "lists", "keys"],
            )

    described = materialize(
        distinct.select("uid", "weight", "vec").mapInArrow(describe, f"uid long, weight long, vec {kind}, lists array<smallint>, keys array<long>"),
        "described",
    )
    entries = described.select("uid", F.explode("keys").alias("key"))
    # lists of one vector have no pairs; longer ones are cut into blocks by a hash of the vector's number
    lengths = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    lengths = lengths.withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    placed = entries.join(lengths, "key").withColumn("own", F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    placed = placed.withColumn("other", other).select(
        "uid",
        "key",
        F.least("own", "other").alias("i"),
        F.greatest("own", "other").alias("j"),
        F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("half"),
    )
    members = placed.join(described.select("uid", "weight", "vec", "lists"), "uid")

    def verify(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        rest, triple = int(key[0]), []
        for _ in range(shared_own):
            rest, pivot = divmod(rest, count)
            triple.append(pivot)
        vectors = unit_rows(pa.array(group["vec"]))
        got = compare(
            group["uid"].to_numpy(), group["weight"].to_numpy(), vectors, np.stack(group["lists"]), triple[::-1], count, group["half"].to_numpy(), least
        )
        return pd.DataFrame(dict(zip(("uid", "links", "to"), got, strict=True)))

    found = materialize(members.groupBy("key", "i", "j").applyInPandas(verify, "uid long, links long, to long"), "links")
    counts = found.groupBy("uid").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select(F.col("uid").alias("a"), F.col("to").alias("b")))
    named = distinct.select("uid", "least_id", "weight").join(parts, F.col("uid") == F.col("node"), "left")
    named = materialize(named.select("uid", "least_id", "weight", F.coalesce("component", "uid").alias("component")), "named")
    smallest = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    by_uid = named.join(smallest, "component").join(counts, "uid", "left").select(
        "uid", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id"
    )
    by_vec = distinct.select("uid", "vec").join(by_uid, "uid").drop("uid")
    return salted(rows, by_vec, "vec").select("vec_id", "n_links", "component_id")
