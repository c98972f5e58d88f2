"""Trajectories: association, alignment by sequence, absolute and relative errors, pairs of frames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfield.functions import geometry
from lumenfield.operators import vectors
from lumenfield.operators.quantiles import quantiles
from lumenfield.operators.temporal import asof_nearest
from lumenfield.session import ship_package

AXES = "xyz"


def frame_pairs(df: DataFrame, group: str, index: str, values: list[str]) -> DataFrame:
    """All unordered pairs of a group's frames: index_a < index_b and both frames' values. Groups are short clips."""
    side = lambda s: df.select(F.col(group), F.col(index).alias(f"{index}_{s}"), *[F.col(v).alias(f"{v}_{s}") for v in values])
    return side("a").join(side("b"), group).filter(F.col(f"{index}_a") < F.col(f"{index}_b"))


def accuracy_within(df: DataFrame, group: list[str], error: Column, limits: tuple[float, ...] = (5.0, 2.0)) -> DataFrame:
    """Share of rows with an error under each limit."""
    return df.groupBy(*group).agg(*[F.avg((error < x).cast("double")).alias(f"under_{x:g}") for x in limits])


def associate(truth: DataFrame, found: DataFrame, key: str, ts: str, values: list[str], tolerance: float) -> DataFrame:
    """Each row of a trajectory with the other's nearest row in time, no farther than the tolerance."""
    both = asof_nearest(truth, found, key, ts, ts, values, after_end="keep")
    return both.filter(F.abs(F.col(ts) - F.col("matched_ts")) <= tolerance)


def steps(df: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """Differences of each frame from the one before it (delta 1); a sequence's first frame has none."""
    w = Window.partitionBy(key).orderBy(*order)
    out = df
    for v in values:
        out = out.withColumn(f"d_{v}", F.col(v) - F.lag(v).over(w))
    return out.filter(F.col(f"d_{values[0]}").isNotNull())


def relative_poses(df: DataFrame, key: str, order: list[str], pose: str) -> DataFrame:
    """relative: the pose before, inverted, times the pose (4x4, camera to world)."""
    before = F.lag(pose).over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("before_", before).filter("before_ is not null").withColumn("relative", geometry.multiply(geometry.invert_pose("before_"), pose, 4)).drop("before_")


def rebase_poses(df: DataFrame, key: str, order: list[str], pose: str) -> DataFrame:
    """Each pose (4x4, camera to world) in the frame of its sequence's first one."""
    first = F.first(pose).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("first_", first).withColumn(pose, geometry.multiply(geometry.invert_pose("first_"), pose, 4)).drop("first_")


def alignments(pairs: DataFrame, key: str, scaled: bool = True) -> DataFrame:
    """(key, scale, rotation, shift) of the similarity that takes p* closest to g*, for each sequence.

    One aggregation of moments; the decomposition of each sequence's 3x3 covariance is one small row's work.
    """
    spark = pairs.sparkSession
    ship_package(spark)
    p, g = [F.col(f"p{a}") for a in AXES], [F.col(f"g{a}") for a in AXES]
    means = pairs.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{s}{a}") for s, side in (("p", p), ("g", g)) for a, c in zip(AXES, side, strict=True)]
    )
    far = lambda s, a: F.col(f"{s}{a}") - F.col(f"m{s}{a}")
    centred = pairs.join(means, key)
    moments = centred.groupBy(key, "n", *[f"m{s}{a}" for s in "pg" for a in AXES]).agg(
        F.avg(sum((far("p", a) * far("p", a) for a in AXES), F.lit(0.0))).alias("spread"), *[F.avg(far("g", a) * far("p", b)).alias(f"c{a}{b}") for a in AXES for b in AXES]
    )

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                u, s, v = np.linalg.svd(np.array([[row[f"c{a}{b}"] for b in AXES] for a in AXES]))
                sign = np.array([1, 1, np.sign(np.linalg.det(u) * np.linalg.det(v)) or 1])
                turn = u @ np.diag(sign) @ v
                scale = float((s * sign).sum() / row["spread"]) if scaled and row["spread"] > 0 else 1.0
                shift = np.array([row[f"mg{a}"] for a in AXES]) - scale * turn @ np.array([row[f"mp{a}"] for a in AXES])
                out.append((row[key], scale, turn.ravel().tolist(), shift.tolist()))
            yield pd.DataFrame(out, columns=[key, "scale", "rotation", "shift"])

    kind = dict(pairs.dtypes)[key]
    return moments.mapInPandas(solve, f"`{key}` {kind}, scale double, rotation array<double>, shift array<double>")


def trajectory_errors(pairs: DataFrame, key: str, order: list[str], align: bool = True) -> DataFrame:
    """(key, ate, rpe): root mean squares of aligned positions' and of consecutive steps' errors (g*, p*)."""
    rows = pairs
    if align:
        found = alignments(pairs, key)
        at = [sum((F.col("rotation")[3 * i + j] * F.col(f"p{b}") for j, b in enumerate(AXES)), F.lit(0.0)) * F.col("scale") + F.col("shift")[i] for i in range(3)]
        rows = pairs.join(found, key).select(*[c for c in pairs.columns if c not in {"px", "py", "pz"}], *[c.alias(f"p{a}") for a, c in zip(AXES, at, strict=True)])
    off = rows
    for a in AXES:
        off = off.withColumn(f"e{a}", F.col(f"p{a}") - F.col(f"g{a}"))
    w = Window.partitionBy(key).orderBy(*order)
    square = lambda cols: sum((c * c for c in cols), F.lit(0.0))
    off = off.withColumn("a_", square([F.col(f"e{a}") for a in AXES])).withColumn("r_", square([F.col(f"e{a}") - F.lag(f"e{a}").over(w) for a in AXES]))
    return off.groupBy(key).agg(F.sqrt(F.avg("a_")).alias("ate"), F.sqrt(F.coalesce(F.avg("r_"), F.lit(0.0))).alias("rpe"))


def relative_pose_errors(pairs: DataFrame, key: str, order: list[str], truth: str | Column, found: str | Column, delta: int = 1) -> DataFrame:
    """key, rpe_rotation (degrees) and rpe_translation: root mean squares over all pairs of poses `delta` apart; n of them.

    truth and found: camera-to-world poses (4x4). The error of a pair is what its true motion, undone, leaves
    of the found one; a turn common to all found poses changes neither figure. Sequences of `delta` poses or fewer
    have null errors and n 0; pairs that lack a pose are left out. Rows are sorted before the poses are computed, and read
    batch by batch with the last `delta` poses carried on; each batch gives sums of its sequences.
    """
    ship_package(pairs.sparkSession)
    kind = dict(pairs.dtypes)[key]
    placed = pairs.repartition(F.col(key)).sortWithinPartitions(key, *order)
    pose = lambda c: (F.col(c) if isinstance(c, str) else c).cast("array<double>")
    rows = placed.select(F.col(key).alias("key"), pose(truth).alias("t"), pose(found).alias("f"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            new = len(table)
            if kept is not None:
                table = pa.concat_tables([kept, table])
            kept = table.slice(max(0, len(table) - delta))
            coded = table["key"].combine_chunks().dictionary_encode(null_encoding="encode")
            code = np.asarray(coded.indices)
            turn, move, good = _motion_errors(table, delta)
            good &= code[delta:] == code[:-delta]
            at, size = code[delta:][good], len(coded.dictionary)
            # batches that only go on with sequences name them, too
            own = np.unique(code[-new:]) if new else np.zeros(0, int)
            total = lambda w: np.bincount(at, w, size)[own].astype(float)  # noqa: B023, E731
            yield pa.record_batch([coded.dictionary.take(pa.array(own)), *[pa.array(total(w)) for w in (turn[good] ** 2, move[good])], pa.array(np.bincount(at, minlength=size)[own])], ["key", "turn", "move", "n"])

    out = rows.mapInArrow(sums, f"key {kind}, turn double, move double, n long").groupBy(F.col("key").alias(key))
    n = F.sum("n")
    mean = lambda c: F.when(n > 0, F.sqrt(F.sum(c) / n))
    return out.agg(mean("turn").alias("rpe_rotation"), mean("move").alias("rpe_translation"), n.alias("n"))


def _motion_errors(table: pa.Table, delta: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Turn in degrees and squared shift of the error of each pose's motion from the one `delta` rows before, and which have all poses."""
    motions, good = [], np.ones(max(0, len(table) - delta), bool)
    for c in "tf":
        values, held = vectors.matrix(table[c])
        whole = held.sum(axis=1) == 16
        poses = np.zeros((len(values), 16))
        poses[whole] = values[whole, :16]
        poses = poses.reshape(-1, 4, 4)
        good &= whole[delta:] & whole[: len(whole) - delta][: len(good)]
        before, after = poses[: len(good)], poses[delta:]
        undone = before[:, :3, :3].transpose(0, 2, 1)
        motions.append((undone @ after[:, :3, :3], (undone @ (after[:, :3, 3] - before[:, :3, 3])[..., None])[..., 0]))
    (turn, shift), (found, moved) = motions
    trace = (turn * found).sum(axis=(1, 2))
    left = (turn.transpose(0, 2, 1) @ (moved - shift)[..., None])[..., 0]
    return np.degrees(np.arccos(np.clip((trace - 1) / 2, -1, 1))), (left**2).sum(axis=1), good


def mean_of_sequences(results: DataFrame, metrics: list[str]) -> DataFrame:
    """One row of means over sequences; zeros if there are none."""
    return results.agg(*[F.coalesce(F.avg(m), F.lit(0.0)).alias(m) for m in metrics])


def median_camera_distance(df: DataFrame, group: str, index: str, position: list[str]) -> DataFrame:
    pairs = frame_pairs(df, group, index, position)
    distance = F.sqrt(sum(((F.col(f"{p}_a") - F.col(f"{p}_b")) ** 2 for p in position), F.lit(0.0)))
    return quantiles(pairs.withColumn("d_", distance), [group], {"distance": ("d_", 0.5)})


def clamp_times(targets: DataFrame, ends: DataFrame, key: str, ts: str) -> tuple[DataFrame, DataFrame]:
    """Targets before a recording's start are put at 0, those after its end (column end) are left out: (kept, dropped)."""
    both = targets.join(ends, key)
    late = F.col(ts) > F.col("end")
    kept = both.filter(~late).withColumn(ts, F.greatest(F.col(ts), F.lit(0)))
    return kept.drop("end"), both.filter(late).drop("end")


def uncovered(frames: DataFrame, poses: DataFrame, key: str, ts: str) -> DataFrame:
    """Frames outside the time range of their scene's poses, or of scenes without any."""
    span = poses.groupBy(key).agg(F.min(ts).alias("lo_"), F.max(ts).alias("hi_"))
    return frames.join(span, key, "left").filter(F.col("lo_").isNull() | ~F.col(ts).between(F.col("lo_"), F.col("hi_"))).drop("lo_", "hi_")


def require_coverage(frames: DataFrame, poses: DataFrame, key: str, ts: str) -> DataFrame:
    """The frames; raises if some lie outside the poses' time range."""
    missing = uncovered(frames, poses, key, ts)
    if not missing.isEmpty():
        raise ValueError(f"frames outside the pose range, such as {missing.first().asDict()}")
    return frames


def views(images: DataFrame, records: DataFrame, poses: DataFrame, reliability: DataFrame, stem: str) -> DataFrame:
    """Views that have an image, a record and a pose of one stem; reliability is 0 where it is not known."""
    out = images.join(records, stem).join(poses, stem).join(reliability, stem, "left")
    return out.withColumn("reliability", F.coalesce("reliability", F.lit(0.0)))
