"""Exact quantiles of groups against Spark's own, where histograms are refined and where not."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfield.operators.quantiles import join_groups, quantiles

def wanted():
    return {"a": ("x", 0.1), "m": ("x", 0.5), "b": (F.col("x") * 2, 0.99), "ym": ("y", 0.5), "top": ("y", 1.0), "low": ("y", 0.0)}


@pytest.fixture(scope="module")
def rows(spark):
    g = F.when(F.col("id") % 3 < 2, F.col("id") % 3)
    x = F.when(F.col("id") % 11 == 0, None).when(F.col("id") % 13 == 0, float("nan")).otherwise(F.exp(F.col("id") * 7919 % 4001 / 300))
    return spark.range(20_000).select(g.alias("g"), x.alias("x"), F.floor(F.col("id") * 31 % 5).cast("double").alias("y"))


@pytest.mark.parametrize(("group", "few"), [(["g"], 100), ([], 100), (["g"], 100_000)])
def test_quantiles(rows, group, few):
    clean = rows.withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    want = clean.groupBy(*group).agg(*[F.percentile(F.col(c) if isinstance(c, str) else c, F.lit(s)).alias(n) for n, (c, s) in wanted().items()]).collect()
    got = {tuple(r[k] for k in group): r for r in quantiles(rows, group, wanted(), few=few, bins=16).collect()}
    assert len(got) == len(want)
    for r in want:
        assert all(np.isclose(got[tuple(r[k] for k in group)][n], r[n], rtol=1e-12) for n in wanted())


def test_one_group_of_millions_of_values(spark):
    # 6,000,011 is prime: all values are different
    rows = spark.range(6_000_000).select((F.col("id") * 7919 % 6_000_011).cast("double").alias("v"))
    got = quantiles(rows, [], {"m": ("v", 0.5), "p": ("v", 0.001)}).first()
    values = np.sort(np.arange(6_000_000) * 7919 % 6_000_011)
    assert got["m"] == np.quantile(values, 0.5) and np.isclose(got["p"], np.quantile(values, 0.001))


def test_odd_groups(spark):
    rows = spark.createDataFrame([("a", None), ("a", float("inf")), (None, 1.0), (None, 3.0), ("b", 7.0)] + [("c", 5.0)] * 60 + [("c", 1e308), ("c", -1e308)], "g string, x double")
    for few in (1, 1000):
        got = {r["g"]: r["m"] for r in quantiles(rows, ["g"], {"m": ("x", 0.5)}, few=few, bins=4).collect()}
        assert got == {"a": None, None: 2.0, "b": 7.0, "c": 5.0}
    assert quantiles(rows.limit(0), ["g"], {"m": ("x", 0.5)}).count() == 0
    assert quantiles(rows.limit(0), [], {"m": ("x", 0.5)}, few=-1).first()["m"] is None
    assert join_groups(rows, rows.groupBy("g").count(), ["g"]).filter("count is null").count() == 0
