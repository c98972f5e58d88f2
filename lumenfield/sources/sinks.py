"""Sinks and further sources: trajectories, point clouds, intrinsics, pools, documents, archives.

What Spark writes is committed by Spark. Files of a foreign format are made by tasks as binary values
of a table, each read back before it is handed on, so a lost executor costs only its running tasks.
"""

from __future__ import annotations

import io
import json
import os
import zipfile
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfield.functions.geometry import C, cells
from lumenfield.session import ship_package

# trajectories


def write_trajectory(poses: DataFrame, path: str, decimals: int = 9) -> None:
    """Lines "time x y z qx qy qz qw" in order of time over the files' order; position and rotation (w, x, y, z) are arrays."""
    spark = poses.sparkSession
    w, x, y, z = cells("rotation", 4)
    numbers = [F.col("ts").cast("double"), *cells("position", 3), x, y, z, w]
    line = F.concat_ws(" ", *[F.format_string(f"%.{decimals}f", n) for n in numbers])
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    poses.repartitionByRange(parts, "ts").sortWithinPartitions("ts").select(line.alias("value")).write.text(path)


def read_timestamps(spark: SparkSession, path: str) -> DataFrame:
    """The first number of each line that is no comment."""
    lines = spark.read.text(path).filter(~F.col("value").startswith("#") & (F.trim("value") != ""))
    return lines.select(F.split(F.trim("value"), r"[\s,]+")[0].cast("double").alias("ts"))


# point clouds

_PLY = [("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("red", "u1"), ("green", "u1"), ("blue", "u1")]
_NAMES = {"<f4": "float", "u1": "uchar"}


def ply_bytes(points: np.ndarray, colours: np.ndarray) -> bytes:
    """A binary little-endian cloud of points with colours."""
    head = ["ply", "format binary_little_endian 1.0", f"element vertex {len(points)}", *(f"property {_NAMES[k]} {n}" for n, k in _PLY), "end_header", ""]
    rows = np.zeros(len(points), np.dtype(_PLY))
    for k, (name, _) in enumerate(_PLY):
        rows[name] = points[:, k] if k < 3 else colours[:, k - 3]
    return "\n".join(head).encode() + rows.tobytes()


def ply_points(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(points, colours) of such a cloud."""
    head, _, body = raw.partition(b"end_header\n")
    lines = head.decode("ascii").splitlines()
    if lines[:2] != ["ply", "format binary_little_endian 1.0"]:
        raise ValueError("no binary little-endian PLY file")
    count = next(int(x.split()[2]) for x in lines if x.startswith("element vertex"))
    rows = np.frombuffer(body, np.dtype(_PLY), count)
    return np.stack([rows[n] for n in ("x", "y", "z")], 1), np.stack([rows[n] for n in ("red", "green", "blue")], 1)


def clouds(points: DataFrame, key: str) -> DataFrame:
    """(key, points, ply) of tables (key, x, y, z, red, green, blue): one file for each cloud, read back and compared.

    A cloud is one task's; those of the systems that this serves have at most some million points.
    """
    ship_package(points.sparkSession)

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        xyz, rgb = group[["x", "y", "z"]].to_numpy(np.float32), group[["red", "green", "blue"]].to_numpy(np.uint8)
        raw = ply_bytes(xyz, rgb)
        again = ply_points(raw)
        if not (np.array_equal(again[0], xyz) and np.array_equal(again[1], rgb)):
            raise ValueError("a cloud could not be read back")
        return pd.DataFrame({key: [group[key].iloc[0]], "points": [len(group)], "ply": [raw]})

    kind = dict(points.dtypes)[key]
    return points.select(key, "x", "y", "z", "red", "green", "blue").groupBy(key).applyInPandas(pack, f"`{key}` {kind}, points long, ply binary")


def cloud_rows(files: DataFrame, key: str, ply: str = "ply") -> DataFrame:
    """The points of cloud files as rows."""
    ship_package(files.sparkSession)

    def unpack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, raw in zip(frame[key], frame[ply], strict=True):
                xyz, rgb = ply_points(raw)
                cols = {n: xyz[:, k].astype(float) for k, n in enumerate("xyz")} | {n: rgb[:, k].astype(int) for k, n in enumerate(("red", "green", "blue"))}
                yield pd.DataFrame({key: [name] * len(xyz), **cols})

    kind = dict(files.dtypes)[key]
    return files.select(key, ply).mapInPandas(unpack, f"`{key}` {kind}, x double, y double, z double, red int, green int, blue int")


# intrinsics


def read_intrinsics(spark: SparkSession, path: str) -> DataFrame:
    """k (9 numbers), width and height of JSON documents with fx, fy, cx, cy."""
    rows = spark.read.schema("fx double, fy double, cx double, cy double, width int, height int").json(path, multiLine=True)
    zero = F.lit(0.0)
    return rows.select(F.array("fx", zero, "cx", zero, "fy", "cy", zero, zero, F.lit(1.0)).alias("k"), "width", "height")


def rescaled(k: C, width: Column, height: Column, to_width: Column, to_height: Column) -> Column:
    """Intrinsics of an image of one size for another size."""
    m, sx, sy = cells(k, 9), to_width / width, to_height / height
    return F.array(m[0] * sx, m[1], m[2] * sx, m[3], m[4] * sy, m[5] * sy, *m[6:9])


def npz(df: DataFrame, key: str, arrays: dict[str, list[int]]) -> DataFrame:
    """(key, npz): array columns of each row, in given shapes, as one NPZ file, read back and compared."""
    ship_package(df.sparkSession)

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                held = {n: np.asarray(row[n], np.float64).reshape(shape) for n, shape in arrays.items()}
                buffer = io.BytesIO()
                np.savez(buffer, **held)
                again = np.load(io.BytesIO(buffer.getvalue()))
                if any(not np.array_equal(again[n], x, equal_nan=True) for n, x in held.items()):
                    raise ValueError("arrays could not be read back")
                out.append((row[key], buffer.getvalue()))
            yield pd.DataFrame(out, columns=[key, "npz"])

    kind = dict(df.dtypes)[key]
    return df.select(key, *arrays).mapInPandas(pack, f"`{key}` {kind}, npz binary")


# documents


def write_document(spark: SparkSession, path: str, document: dict[str, Any]) -> None:
    """One small JSON document, written beside its place and renamed, in any store that Spark reaches."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target, part = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(path + ".part")
    store = target.getFileSystem(conf)
    stream = store.create(part, True)
    try:
        stream.write(bytearray(json.dumps(document, sort_keys=True, default=_plain).encode()))
    finally:
        stream.close()
    # what was there stays beside the new file until that is in place
    old = jvm.org.apache.hadoop.fs.Path(path + ".old")
    if store.exists(target):
        store.delete(old, False)
        if not store.rename(target, old):
            raise OSError(f"{path} could not be moved aside")
    if not store.rename(part, target):
        raise OSError(f"{path} could not be put in place; what was there is at {path}.old")
    store.delete(old, False)


def _plain(value: Any) -> Any:
    """numpy's numbers and arrays as Python's."""
    if isinstance(value, np.generic):
        return value.item()
    if isinstance(value, np.ndarray):
        return value.tolist()
    raise TypeError(f"{type(value).__name__} is no JSON value")


def read_document(spark: SparkSession, path: str) -> dict[str, Any]:
    return json.loads(spark.read.text(path, wholetext=True).first()["value"])


def write_pool(spark: SparkSession, pool: DataFrame, path: str, most: int = 50, retrieved: int = 10) -> None:
    """A pool of views, at most `most` rows, in its envelope."""
    rows = pool.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a pool has at most {most} views")
    write_document(spark, path, {"format_version": 2, "max_views": most, "retrieval_count": retrieved, "views": [r.asDict(recursive=True) for r in rows]})


def read_pool(spark: SparkSession, path: str, schema: str) -> DataFrame:
    found = read_document(spark, path)
    if found.get("format_version") != 2:
        raise ValueError("a pool of another format")
    return spark.createDataFrame(found["views"], schema)


def read_transforms(spark: SparkSession, path: str) -> DataFrame:
    """One row for each frame of a transforms.json: the file, the pose (16 numbers) and the camera's block."""
    camera = "w double, h double, fl_x double, fl_y double, cx double, cy double"
    rows = spark.read.schema(f"{camera}, frames array<struct<file_path string, transform_matrix array<array<double>>>>").json(path, multiLine=True)
    each = rows.withColumn("f", F.explode("frames"))
    return each.select(F.col("f.file_path").alias("file_path"), F.flatten("f.transform_matrix").alias("c2w"), *[x.split()[0] for x in camera.split(", ")])


def read_archives(spark: SparkSession, path: str, suffixes: tuple[str, ...] = (".jpg", ".jpeg", ".png")) -> DataFrame:
    """(archive, index, name, content) of the images in ZIP files, in order of name; names that lead out of the archive are refused."""
    ship_package(spark)

    def unzip(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for archive, raw in zip(frame["path"], frame["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(raw)) as opened:
                    names = sorted(n for n in opened.namelist() if n.lower().endswith(suffixes))
                    if any(n.startswith("/") or ".." in n.split("/") for n in names):
                        raise ValueError(f"{archive} holds names outside itself")
                    for k, n in enumerate(names):
                        yield pd.DataFrame({"archive": [archive], "index": [k], "name": [n], "content": [opened.read(n)]})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(unzip, "archive string, index int, name string, content binary")


def decoded(content: Column) -> Column:
    """Image bytes of base64 text; null where it is none."""
    return F.try_to_binary(content, F.lit("base64"))


# settings


def env_number(name: str, default: float, least: float | None = None, kind: type = int) -> float:
    """A setting from the environment: the default if it is unset or no number, never under the least."""
    try:
        value = kind(os.environ.get(name, default))
    except ValueError:
        value = kind(default)
    return value if least is None else max(kind(least), value)
