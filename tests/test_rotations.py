"""Smooth rotations against numpy on all samples."""

from __future__ import annotations

import numpy as np

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenfield.operators import rotations, trajectory


def mul(a, b):
    return np.concatenate(([a[0] * b[0] - a[1:] @ b[1:]], a[0] * b[1:] + b[0] * a[1:] + np.cross(a[1:], b[1:])))


def inv(q):
    return q * np.array([1, -1, -1, -1.0])


def log(q):
    n = np.linalg.norm(q[1:])
    return q[1:] * (np.arctan2(n, q[0]) / n if n > 1e-12 else 1.0)


def exp(v):
    n = np.linalg.norm(v)
    return np.concatenate(([np.cos(n)], v * (np.sin(n) / n if n > 1e-12 else 1.0)))


def arc(a, b, u):
    return mul(a, exp(u * log(mul(inv(a), b))))


def curve(times, qs, t):
    qs = [np.array(q, float) / np.linalg.norm(q) for q in qs]
    for k in range(1, len(qs)):
        qs[k] = qs[k] * (1 if qs[k] @ qs[k - 1] >= 0 else -1)
    t = min(max(t, times[0]), times[-1])
    k = max(0, min(int(np.searchsorted(times, t, "right")) - 1, len(times) - 2))
    span = times[k + 1] - times[k]
    one, two, step = qs[k], qs[k + 1], log(mul(inv(qs[k]), qs[k + 1]))
    a = b = None
    if k:
        a = mul(one, exp(0.25 * (log(mul(inv(qs[k - 1]), one)) * span / (times[k] - times[k - 1]) - step)))
    if k + 2 < len(qs):
        b = mul(two, exp(-0.25 * (log(mul(inv(two), qs[k + 2])) * span / (times[k + 2] - times[k + 1]) - step)))
    u = (t - times[k]) / span
    return arc(arc(one, two, u), arc(one if a is None else a, two if b is None else b, u), 2 * u * (1 - u))


def test_squad(spark):
    rng = np.random.default_rng(8)
    poses, frames, want = [], [], {}
    for s in range(4):
        times = np.cumsum(rng.uniform(0.5, 2.0, 9)).tolist()
        q, qs = rng.normal(size=4), []
        for _ in times:
            q = q / np.linalg.norm(q) + rng.normal(size=4) * 0.15
            qs.append((q / np.linalg.norm(q) * rng.choice([-1, 1])).tolist())
        poses += [(s, t, x) for t, x in zip(times, qs, strict=True)]
        for t in [*rng.uniform(-1, times[-1] + 1, 25).tolist(), *times]:
            frames.append((s, t))
            want[s, t] = curve(times, qs, t)
    # a constant turn about one axis, uneven times
    for t in (0.0, 1.0, 1.5, 4.0, 4.25):
        poses.append((9, t, [np.cos(t / 4), 0.0, float(np.sin(t / 4)), 0.0]))
    for t in (0.3, 1.2, 2.2, 4.1):
        frames.append((9, t))
        want[9, t] = np.array([np.cos(t / 4), 0, np.sin(t / 4), 0])
    poses.append((5, 1.0, [1.0, 0.0, 0.0, 0.0]))
    frames += [(5, 7.0), (77, 1.0), (5, None)]
    want[5, 7.0] = np.array([1.0, 0, 0, 0])
    table = spark.createDataFrame([(s, t, [float(v) for v in x]) for s, t, x in poses], "s int, t double, quaternion array<double>")
    got = rotations.squad(table, spark.createDataFrame(frames, "s int, t double"), "s", "t").collect()
    assert len(got) == len(want)
    for r in got:
        q = np.array(r["quaternion"])
        assert abs(np.linalg.norm(q) - 1) < 1e-9 and abs(abs(q @ want[r["s"], r["t"]]) - 1) < 1e-9


def pose(rng):
    q = rng.normal(size=4)
    w, x, y, z = q / np.linalg.norm(q)
    out = np.eye(4)
    out[:3, :3] = [[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]]
    out[:3, 3] = rng.normal(size=3)
    return out


def test_relative_pose_errors(spark):
    rng = np.random.default_rng(12)
    truth, found = [[pose(rng) for _ in range(7)] for _ in range(2)]
    turn = pose(rng)
    rows = [("a", k, t.ravel().tolist(), f.ravel().tolist()) for k, (t, f) in enumerate(zip(truth, found, strict=True))]
    rows += [("same", k, t.ravel().tolist(), (turn @ t).ravel().tolist()) for k, t in enumerate(truth)] + [("one", 0, truth[0].ravel().tolist(), found[0].ravel().tolist())]
    table = spark.createDataFrame(rows, "s string, i int, t array<double>, f array<double>")
    for delta in (1, 3):
        angles, moves = [], []
        for k in range(7 - delta):
            e = np.linalg.inv(np.linalg.inv(truth[k]) @ truth[k + delta]) @ np.linalg.inv(found[k]) @ found[k + delta]
            angles.append(np.degrees(np.arccos((np.trace(e[:3, :3]) - 1) / 2)))
            moves.append(np.linalg.norm(e[:3, 3]))
        got = {r["s"]: r for r in trajectory.relative_pose_errors(table, "s", ["i"], "t", "f", delta).collect()}
        assert np.isclose(got["a"]["rpe_rotation"], np.sqrt(np.mean(np.square(angles)))) and np.isclose(got["a"]["rpe_translation"], np.sqrt(np.mean(np.square(moves))))
        assert got["a"]["n"] == 7 - delta and got["same"]["rpe_rotation"] < 1e-4 and got["same"]["rpe_translation"] < 1e-9
        assert got["one"]["n"] == 0 and got["one"]["rpe_rotation"] is None


def test_relative_pose_errors_over_batches(spark):
    # poses are computed after the sort, and pairs go on from batch to batch; pairs without a pose are left out
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    rows = spark.range(50).selectExpr("if(id < 40, 'a', if(id < 49, 'b', null)) as s", "id as i", "if(id = 44, null, id * 0.1) as a")
    turn = lambda a: F.when(a.isNotNull(), F.array(*[x if isinstance(x, Column) else F.lit(float(x)) for x in (F.cos(a), -F.sin(a), 0, a, F.sin(a), F.cos(a), 0, 0, 0, 0, 1, 0, 0, 0, 0, 1)]))
    try:
        spark.conf.set(size, "7")
        for delta in (1, 9):
            got = {r["s"]: r for r in trajectory.relative_pose_errors(rows, "s", ["i"], turn(F.lit(0.0) * F.col("a")), turn(F.col("a")), delta).collect()}
            assert {s: r["n"] for s, r in got.items()} == {"a": 40 - delta, "b": 6 if delta == 1 else 0, None: 0}
            assert np.isclose(got["a"]["rpe_rotation"], np.degrees(0.1 * delta)) and np.isclose(got["a"]["rpe_translation"], 0.1 * delta) and got[None]["rpe_rotation"] is None
    finally:
        spark.conf.set(size, before)
