"""Suppression in rounds against going through boxes one by one."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfield.operators import suppression


def greedy(rows: list, limit: float) -> set:
    kept: list = []
    for r in rows:
        a = r[2:6]
        hit = False
        for k in kept:
            b = k[2:6]
            if k[0] == r[0]:
                shared = max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
                union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - shared
                hit |= union > 0 and shared / union > limit
        if not hit:
            kept.append(r)
    return {r[:2] for r in kept}


@pytest.mark.parametrize("limit", [0.7, 0.2])
def test_rounds_keep_what_the_greedy_rule_keeps(spark, limit):
    rng = np.random.default_rng(int(limit * 10))
    rows = []
    for k in range(400):
        x, y, w, h = rng.random() * 10, rng.random() * 10, *(2.0 ** rng.uniform(-3, 3, 2))
        rows.append((int(k % 3), k, float(x), float(y), float(x + w), float(y + h), float(np.round(rng.random(), 2))))
    rows += [(1, 400 + k, *rows[1][2:6], 0.5) for k in range(30)]  # equal boxes
    rows += [(1, 500, 1.0, 1.0, 1.0, 4.0, 0.9), (1, 501, 1.0, 1.0, 1.0, 4.0, 0.8), (2, 502, -9.0, -9.0, -5.0, -5.0, 0.1)]
    bad = [(1, 600, None, 0.0, 1.0, 1.0, 0.5), (1, 601, 0.0, 0.0, 1.0, 1.0, float("nan"))]
    boxes = spark.createDataFrame(rows + bad, "image int, id long, x0 double, y0 double, x1 double, y1 double, score double")
    got = {tuple(r) for r in suppression.suppress(boxes, "image", "id", limit).collect()}
    assert got == greedy(sorted(rows, key=lambda r: (-r[6], r[1])), limit)
    crops = [[0.0, 0.0, 10.0, 10.0], [0.0, 0.0, 5.0, 5.0], [2.0, 2.0, 5.0, 5.0]]
    named = boxes.withColumn("crop", F.element_at(F.array(*[F.array(*map(F.lit, c)) for c in crops]), (F.col("id") % 3 + 1).cast("int")))
    got = {tuple(r) for r in suppression.suppress_across_crops(named.filter("id < 600"), "image", "id", "crop", limit).collect()}
    assert got == greedy(sorted(rows, key=lambda r: ({0: 100.0, 1: 25.0, 2: 9.0}[r[1] % 3], r[1])), limit)
    assert suppression.suppress(boxes.limit(0), "image", "id", limit).count() == 0


def test_one_image_is_dealt_over_tasks(spark):
    # a chain in which every other box stays, and a crowd of equal boxes
    boxes = spark.range(60_000).selectExpr("1 as image", "id", "if(id < 50000, id % 20000 * 10.0, 7e6) as x0", "0.0 as y0", "if(id < 50000, id % 20000 * 10.0, 7e6) + 9 as x1", "9.0 as y1", "1.0 / (id + 1) as score")
    assert suppression.suppress(boxes, "image", "id", 0.5).count() == 20_001


def test_a_crowd_is_not_paired(spark):
    # each of 30,000 boxes overlaps thousands of others; of 400 million pairs and more none is written
    boxes = spark.range(30_000).selectExpr("1 as image", "id", "pmod(hash(id), 1000) / 5000.0 as x0", "pmod(hash(id, 7), 1000) / 5000.0 as y0", "pmod(hash(id, 9), 100000) / 1e5 as score")
    boxes = boxes.selectExpr("*", "x0 + 0.2 as x1", "y0 + 0.2 as y1")
    got = {tuple(r) for r in suppression.suppress(boxes, "image", "id", 0.5).collect()}
    rows = [(r["image"], r["id"], r["x0"], r["y0"], r["x1"], r["y1"], r["score"]) for r in boxes.collect()]
    assert got == greedy(sorted(rows, key=lambda r: (-r[6], r[1])), 0.5) and len(got) < 50
