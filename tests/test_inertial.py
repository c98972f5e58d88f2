"""The inertial filter on motions whose course is known."""

from __future__ import annotations

import math

import numpy as np
import pytest

from lumenfield.operators import inertial

SAMPLE = "series string, ts double, acc_x double, acc_y double, acc_z double, gyro_x double, gyro_y double, gyro_z double"


def motion(name: str, axis: int, total: float, push: float = 0.0, gravity: float = 9.81, steps: int = 100) -> list:
    """Samples of a camera that turns about one of its axes in a second, in sensor axes, and the true orientation of each."""
    out = []
    for k in range(steps + 1):
        a = total * k / steps
        c, s = math.cos(a), math.sin(a)
        turn = np.eye(3)
        i, j = [(1, 2), (2, 0), (0, 1)][axis]
        turn[i, i] = turn[j, j] = c
        turn[i, j], turn[j, i] = -s, s
        acc = turn.T @ [push if 20 <= k < 30 else 0, 0, gravity]
        gyro = np.zeros(3)
        gyro[axis] = total
        out.append((name, 10.0 * k, acc[0], -acc[1], -acc[2], gyro[0], -gyro[1], -gyro[2]))
    return [tuple(float(x) if not isinstance(x, str) else x for x in r) for r in out]


@pytest.fixture(scope="module")
def samples():
    rows = motion("still", 0, 0.0) + motion("pitch", 0, math.pi / 2) + motion("yaw", 2, math.pi / 2) + motion("eighth", 0, math.pi / 4)
    rows += motion("unit", 0, 0.0, gravity=1.0) + motion("push", 0, 0.0, push=1.0)
    return [("still", -10.0, *[0.0] * 6), *rows, ("still", 5000.0, None, *[0.0] * 5), ("still", 5000.0, float("nan"), *[1.0] * 5)]


@pytest.fixture(scope="module")
def tracks(spark, samples):
    out: dict = {}
    for r in inertial.track(spark.createDataFrame(samples, SAMPLE), "series").orderBy("series", "ts").collect():
        out.setdefault(r["series"], []).append((r["ts"], np.array(r["quaternion"]), np.array(r["position"])))
    return out


def test_turns(tracks):
    assert {k: len(v) for k, v in tracks.items()} == dict.fromkeys(["still", "pitch", "yaw", "eighth", "unit", "push"], 101)
    assert all(abs(np.linalg.norm(q) - 1) < 1e-10 for own in tracks.values() for _, q, _ in own)
    assert all(abs(q[0]) > 0.999999 and np.allclose(p, 0) for _, q, p in tracks["still"])
    last = tracks["pitch"][-1][1]
    angle = 2 * math.atan2(np.linalg.norm(last[1:]), abs(last[0]))
    assert abs(angle - math.pi / 2) < 0.15 * math.pi / 2 and abs(last[1]) > 10 * max(abs(last[2]), abs(last[3]))
    assert np.allclose(np.abs(tracks["yaw"][-1][1]), [math.cos(math.pi / 4), 0, 0, math.sin(math.pi / 4)], atol=1e-6)


def test_positions(tracks):
    assert all(np.allclose(p, 0) for _, _, p in tracks["unit"])
    assert np.linalg.norm(tracks["push"][-1][2]) > 0


def test_gain_pulls_to_the_level():
    # an orientation that is off comes back where the gain is on
    n = 400
    acc, still = np.tile([0.0, 0, 9.81], (n, 1)), np.zeros((n, 3))
    acc[0] = [0, 3.0, 9.0]
    ts = np.arange(n) * 10.0
    for gain, back in ((10.0, True), (0.0, False)):
        turns, _, _ = inertial.fold(["a"] * n, ts, acc, still, np.full(n, 9.81), gain)
        assert (abs(turns[-1][0]) > 0.99999) == back


def test_batches_carry_the_state(spark, samples, tracks):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = inertial.track(spark.createDataFrame(samples, SAMPLE).repartition(5), "series").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = {(k, t): (q, p) for k, own in tracks.items() for t, q, p in own}
    assert len(got) == len(want)
    assert all(np.allclose(r["quaternion"], want[r["series"], r["ts"]][0]) and np.allclose(r["position"], want[r["series"], r["ts"]][1]) for r in got)


def test_poses_at_frames(spark, samples, tracks):
    rows = spark.createDataFrame(samples, SAMPLE)
    frames = spark.createDataFrame([("eighth", 1000), ("eighth", 505), ("eighth", -50), ("eighth", 9999), ("push", 500), ("absent", 1)], "series string, at long")
    out = inertial.pose_lines(inertial.poses_at(inertial.track(rows, "series"), frames, "series", "at")).collect()
    got = {(r["series"], r["at"]): np.array(r["w2c"]).reshape(4, 4) for r in out}
    assert len(got) == 5
    c, s = math.cos(math.pi / 4), math.sin(math.pi / 4)
    assert np.allclose(got["eighth", 1000.0][:3, :3], [[1, 0, 0], [0, c, s], [0, -s, c]], atol=0.01)
    assert np.allclose(got["eighth", 9999.0], got["eighth", 1000.0]) and np.allclose(got["eighth", -50.0][:3, :3], np.eye(3), atol=1e-6)
    half = got["eighth", 505.0][:3, :3]
    assert abs(math.atan2(half[1, 2], half[1, 1]) - math.pi / 4 * 0.505) < 0.02
    at = tracks["push"][50][2]
    assert np.allclose(-got["push", 500.0][:3, :3].T @ got["push", 500.0][:3, 3], at)
    assert all(np.isclose(np.linalg.det(m[:3, :3]), 1) and np.allclose(m[3], [0, 0, 0, 1]) for m in got.values())
    assert all(len(r["line"].split()) == 16 and all(len(x.split(".")[1]) == 6 for x in r["line"].split()) for r in out)
    assert inertial.track(rows.limit(0), "series").count() == 0
