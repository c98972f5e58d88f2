"""Binary formats of depth maps, cameras and reconstructions, and a Python data source for the last."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from pathlib import Path

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Camera models and their numbers of parameters, by number.
CAMERA_MODELS = {
    0: ("SIMPLE_PINHOLE", 3), 1: ("PINHOLE", 4), 2: ("SIMPLE_RADIAL", 4), 3: ("RADIAL", 5), 4: ("OPENCV", 8), 5: ("OPENCV_FISHEYE", 8),
    6: ("FULL_OPENCV", 12), 7: ("FOV", 5), 8: ("SIMPLE_RADIAL_FISHEYE", 4), 9: ("RADIAL_FISHEYE", 5), 10: ("THIN_PRISM_FISHEYE", 12),
}


def read_array(raw: bytes) -> np.ndarray:
    """A dense map: "width&height&channels&" and float32 in column-major order."""
    at, numbers = 0, []
    while len(numbers) < 3:
        end = raw.index(b"&", at)
        numbers.append(int(raw[at:end]))
        at = end + 1
    w, h, c = numbers
    out = np.frombuffer(raw, "<f4", w * h * c, at).reshape((w, h, c), order="F").transpose(1, 0, 2)
    return out[:, :, 0] if c == 1 else out


def write_array(values: np.ndarray) -> bytes:
    values = values if values.ndim == 3 else values[:, :, None]
    h, w, c = values.shape
    return f"{w}&{h}&{c}&".encode() + values.transpose(1, 0, 2).astype("<f4").tobytes(order="F")


def read_pfm(raw: bytes) -> np.ndarray:
    """A PFM image, top row first; the scale's sign tells the byte order."""
    kind, size, scale, rest = raw.split(b"\n", 3)
    if kind.strip() not in (b"PF", b"Pf"):
        raise ValueError("this is no PFM image")
    w, h = map(int, size.split())
    channels = 3 if kind.strip() == b"PF" else 1
    out = np.frombuffer(rest, "<f4" if float(scale) < 0 else ">f4", w * h * channels).reshape(h, w, channels)[::-1]
    return out[:, :, 0] if channels == 1 else out


def read_camera_file(raw: bytes, tag: float = 202021.25) -> tuple[np.ndarray, np.ndarray]:
    """Intrinsics (3x3) and pose (3x4) in double precision after a tag that is checked."""
    if struct.unpack_from("<f", raw)[0] != tag:
        raise ValueError("the tag is wrong")
    values = np.frombuffer(raw, "<f8", 21, 4)
    return values[:9].reshape(3, 3), values[9:].reshape(3, 4)


def clean_depth(depth: np.ndarray, scale: float = 1.0, most: float = 1e9) -> np.ndarray:
    """Depths scaled; absurd and non-finite ones become 0."""
    out = np.asarray(depth, np.float64)
    return np.where(np.isfinite(out) & (out <= most), out, 0.0) / scale


def read_cameras(raw: bytes) -> Iterator[tuple]:
    count, at = struct.unpack_from("<Q", raw)[0], 8
    for _ in range(count):
        ident, model, width, height = struct.unpack_from("<iiQQ", raw, at)
        name, n = CAMERA_MODELS[model]
        params = struct.unpack_from(f"<{n}d", raw, at + 24)
        at += 24 + 8 * n
        yield ident, name, width, height, list(params)


def write_cameras(rows: list[tuple]) -> bytes:
    number = {name: k for k, (name, _) in CAMERA_MODELS.items()}
    out = [struct.pack("<Q", len(rows))]
    out += [struct.pack(f"<iiQQ{len(p)}d", i, number[name], w, h, *p) for i, name, w, h, p in rows]
    return b"".join(out)


def read_views(raw: bytes) -> Iterator[tuple]:
    """image_id, quaternion (w first), translation, camera_id, name and points (x, y, point id)."""
    count, at = struct.unpack_from("<Q", raw)[0], 8
    for _ in range(count):
        ident, *pose, camera = struct.unpack_from("<i7di", raw, at)
        at += 64
        end = raw.index(b"\0", at)
        name, at = raw[at:end].decode(), end + 1
        n = struct.unpack_from("<Q", raw, at)[0]
        points = [list(x) for x in struct.iter_unpack("<ddq", raw[at + 8 : at + 8 + 24 * n])]
        at += 8 + 24 * n
        yield ident, pose[:4], pose[4:], camera, name, points


def write_views(rows: list[tuple]) -> bytes:
    out = [struct.pack("<Q", len(rows))]
    for ident, q, t, camera, name, points in rows:
        out.append(struct.pack("<i7di", ident, *q, *t, camera) + name.encode() + b"\0" + struct.pack("<Q", len(points)))
        out += [struct.pack("<ddq", x, y, int(p)) for x, y, p in points]
    return b"".join(out)


class CameraReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        files = sorted(Path(self.path).rglob("cameras.bin")) if Path(self.path).is_dir() else [Path(self.path)]
        return [InputPartition(str(f)) for f in files]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from read_cameras(Path(partition.value).read_bytes())


class CameraSource(DataSource):
    """spark.read.format("sfm_cameras").load(folder): the cameras of reconstructions in a folder all workers see."""

    @classmethod
    def name(cls) -> str:
        return "sfm_cameras"

    def schema(self) -> str:
        return "camera_id int, model string, width long, height long, params array<double>"

    def reader(self, schema: object) -> CameraReader:
        return CameraReader(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CameraSource)
