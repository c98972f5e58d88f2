"""Inertial tracks: orientation by a complementary filter, position by integration, and poses at frames' times.

A series is read in order of time, batch by batch, and what the next sample needs of those before is
carried from batch to batch: time, orientation, speed and position. A task never holds a series whole, and steps all
series of a batch together. What depends on a series as a whole, its median acceleration, is found before.

Samples are in the sensor's axes (y up, z towards the viewer) and turned to the camera's (y down, z
ahead). The filter turns the last orientation by the turning rate, to which GAIN times the turn from the
measured upward direction to the expected one is added. Samples that are all zero are no readings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfield.functions import geometry
from lumenfield.operators.quantiles import join_groups, quantiles
from lumenfield.session import ship_package

#: Standard gravity; units of g are taken where the median acceleration is under this limit.
GRAVITY, UNIT_LIMIT = 9.80665, 3.0
#: Acceleration without gravity under which a sensor rests, and what is left of its speed each step.
REST, DECAY = 0.5, 0.95
GAIN, SHORTEST, NOTHING = 10.0, 1e-6, 1e-9
_UP = np.array([0.0, 0.0, 1.0])


def rotate(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Vectors under unit quaternions (w first), row by row."""
    t = 2 * np.cross(q[..., 1:], v)
    return v + q[..., :1] * t + np.cross(q[..., 1:], t)


def multiply(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    w = a[..., :1] * b[..., :1] - (a[..., 1:] * b[..., 1:]).sum(-1, keepdims=True)
    return np.concatenate((w, a[..., :1] * b[..., 1:] + b[..., :1] * a[..., 1:] + np.cross(a[..., 1:], b[..., 1:])), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-300)


def level(up: np.ndarray) -> np.ndarray:
    """The rotations that turn measured upward directions to +z by the shortest way; half a turn about x where one points down."""
    size = np.linalg.norm(up, axis=-1, keepdims=True)
    up = np.where(size < 1e-6, _UP, up / np.maximum(size, 1e-300))
    q = _unit(np.concatenate((1 + up[..., 2:], np.cross(up, _UP)), -1))
    return np.where(up[..., 2:] < -1 + 1e-9, np.array([0.0, 1, 0, 0]), q)


class State:
    """Of some series: time, orientation, speed and position after their last sample."""

    def __init__(self, n: int):
        self.ts, self.q, self.speed, self.place = np.full(n, np.nan), np.tile([1.0, 0, 0, 0], (n, 1)), np.zeros((n, 3)), np.zeros((n, 3))

    def step(self, own: np.ndarray, ts: np.ndarray, acc: np.ndarray, gyro: np.ndarray, median: np.ndarray, gain: float) -> None:
        """One sample of each of the series in `own`, in camera axes."""
        fresh = np.isnan(self.ts[own])
        first, more = own[fresh], own[~fresh]
        self.q[first] = level(acc[fresh])
        dt = np.maximum((ts[~fresh] - self.ts[more]) / 1000.0, SHORTEST)[:, None]
        acc, rate, median, q = acc[~fresh], gyro[~fresh], median[~fresh], self.q[more]
        size = np.linalg.norm(acc, axis=1, keepdims=True)
        expected = rotate(q * (1, -1, -1, -1), np.broadcast_to(_UP, acc.shape))
        rate = rate + np.where(size > 1e-6, gain * np.cross(acc / np.maximum(size, 1e-300), expected), 0.0)
        turn = rate * dt
        angle = np.linalg.norm(turn, axis=1, keepdims=True)
        half = np.concatenate((np.cos(angle / 2), np.where(angle > 1e-12, np.sin(angle / 2) / np.maximum(angle, 1e-300), 0.5) * turn), 1)
        q = _unit(multiply(q, half))
        scale = np.where(median < UNIT_LIMIT, GRAVITY, 1.0)[:, None]
        moving = rotate(q, acc * scale) - _UP * (median[:, None] * scale)
        rests = np.linalg.norm(moving, axis=1, keepdims=True) < REST
        moving = np.where(rests, 0.0, moving)
        speed = np.where(rests, DECAY, 1.0) * self.speed[more]
        self.place[more] += speed * dt + moving * dt * dt / 2
        self.speed[more], self.q[more] = speed + moving * dt, q
        self.ts[own] = ts


def fold(series: list, ts: np.ndarray, acc: np.ndarray, gyro: np.ndarray, median: np.ndarray, gain: float, held: dict | None = None) -> tuple[np.ndarray, np.ndarray, dict]:
    """Orientations and positions after each sample of ordered rows, and what the last series needs to go on with."""
    start = [k for k in range(len(series)) if not k or series[k] != series[k - 1]]
    length = np.diff([*start, len(series)])
    state = State(len(start))
    if held and start and held["series"] == series[0]:
        state.ts[0], state.q[0], state.speed[0], state.place[0] = held["ts"], held["q"], held["speed"], held["place"]
    turns, places = np.empty((len(series), 4)), np.empty((len(series), 3))
    begin = np.array(start, np.int64)
    for k in range(int(length.max(initial=0))):
        own = np.flatnonzero(length > k)
        at = begin[own] + k
        state.step(own, ts[at], acc[at], gyro[at], median[at], gain)
        turns[at], places[at] = state.q[own], state.place[own]
    last = {"series": series[-1], "ts": state.ts[-1], "q": state.q[-1], "speed": state.speed[-1], "place": state.place[-1]} if start else (held or {})
    return turns, places, last


def track(samples: DataFrame, series: str, gain: float = GAIN) -> DataFrame:
    """series, ts, quaternion (camera to world, w first) and position of samples (ts in ms, acc_*, gyro_* in sensor axes).

    Rows with a null or non-finite reading, or none but zeros, are left out; equal times keep the order of
    their readings.
    """
    ship_package(samples.sparkSession)
    names = [f"{p}_{a}" for p in ("acc", "gyro") for a in "xyz"]
    good = F.col("ts").isNotNull()
    for c in names:
        good &= F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) != float("inf"))
    size = lambda p: F.sqrt(sum((F.pow(f"{p}_{a}", 2) for a in "xyz"), F.lit(0.0)))
    rows = samples.filter(good).select(series, F.col("ts").cast("double").alias("ts"), *[F.col(c).cast("double").alias(c) for c in names])
    rows = rows.filter((size("acc") >= NOTHING) | (size("gyro") >= NOTHING))
    rows = join_groups(rows, quantiles(rows.withColumn("a_", size("acc")), [series], {"median": ("a_", 0.5)}), [series])
    ordered = rows.select(F.col(series).alias("series"), "ts", *names, "median").repartition(F.col("series")).sortWithinPartitions("series", "ts", *names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        flip = np.array([1.0, -1, -1])
        for batch in batches:
            if not batch.num_rows:
                continue
            column = lambda c: batch.column(c).to_numpy(zero_copy_only=False)  # noqa: E731, B023
            acc, gyro = (np.stack([column(f"{p}_{a}") for a in "xyz"], 1) * flip for p in ("acc", "gyro"))
            ts = column("ts")
            turns, places, held = fold(batch.column("series").to_pylist(), ts, acc, gyro, column("median"), gain, held)
            yield pa.RecordBatch.from_arrays([batch.column("series"), pa.array(ts), pa.array(list(turns)), pa.array(list(places))], ["series", "ts", "quaternion", "position"])

    kind = dict(samples.dtypes)[series]
    return ordered.mapInArrow(run, f"series {kind}, ts double, quaternion array<double>, position array<double>").withColumnRenamed("series", series)


def poses_at(tracks: DataFrame, frames: DataFrame, series: str, ts: str) -> DataFrame:
    """series, ts, w2c: world-to-camera poses (16 numbers by rows) at frames' times, between the samples about them; a series' ends hold beyond it.

    Frames of series without samples are left out.
    """
    sample = F.struct(F.col("ts").alias("t"), "quaternion", "position")
    both = tracks.select(F.col(series).alias("series"), F.col("ts").alias("t"), F.lit(0).alias("frame"), sample.alias("s"))
    both = both.unionByName(frames.select(F.col(series).alias("series"), F.col(ts).cast("double").alias("t"), F.lit(1).alias("frame"), F.lit(None).cast(both.schema["s"].dataType).alias("s")))
    w = Window.partitionBy("series").orderBy("t", "frame")
    before = F.last("s", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("s", True).over(w.rowsBetween(0, Window.unboundedFollowing))
    rows = both.withColumns({"a": before, "b": after}).filter("frame = 1 and (a is not null or b is not null)")
    rows = rows.withColumns({"a": F.coalesce("a", "b"), "b": F.coalesce("b", "a")})
    share = F.when(F.col("b.t") > F.col("a.t"), (F.col("t") - F.col("a.t")) / (F.col("b.t") - F.col("a.t"))).otherwise(0.0)
    rows = rows.withColumn("u", share).withColumn("q", geometry.slerp(F.col("a.quaternion"), F.col("b.quaternion"), F.col("u")))
    w_, x, y, z = (F.col("q")[k] for k in range(4))
    # rows of the inverse rotation
    turn = [
        [1 - 2 * (y * y + z * z), 2 * (x * y + w_ * z), 2 * (x * z - w_ * y)],
        [2 * (x * y - w_ * z), 1 - 2 * (x * x + z * z), 2 * (y * z + w_ * x)],
        [2 * (x * z + w_ * y), 2 * (y * z - w_ * x), 1 - 2 * (x * x + y * y)],
    ]
    place = [F.col("a.position")[k] * (1 - F.col("u")) + F.col("b.position")[k] * F.col("u") for k in range(3)]
    cells = [c for row in turn for c in (*row, -sum((r * p for r, p in zip(row, place, strict=True)), F.lit(0.0)))]
    return rows.select(F.col("series").alias(series), F.col("t").alias(ts), F.array(*cells, F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("w2c"))


def pose_lines(poses: DataFrame) -> DataFrame:
    """poses with line: the pose's 16 numbers with six decimals each."""
    return poses.withColumn("line", F.array_join(F.transform("w2c", lambda x: F.format_string("%.6f", x)), " "))
