"""Boxes, pixel grids, intrinsics, poses as records, and similarity transforms of poses, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenfield.functions import geometry
from lumenfield.functions.geometry import C, cells


def _rows(rotation: list[list[float]], shift: list[float]) -> list[list[Column]]:
    return [[*(F.lit(float(x)) for x in rotation[i]), F.lit(float(shift[i]))] for i in range(3)]


def scale_shift(w2c: C, scale: float) -> Column:
    """A 4x4 pose with its translation scaled."""
    m = cells(w2c, 16)
    return F.array(*[c * scale if k in (3, 7, 11) else c for k, c in enumerate(m)])


def flip_axes(vector: C) -> Column:
    """A sensor's vector in camera axes: x as it is, y and z turned round."""
    x, y, z = cells(vector, 3)
    return F.array(x, -y, -z)


def similarity_c2w(c2w: C, rotation: list[list[float]], scale: float, shift: list[float]) -> Column:
    """A camera-to-world pose under a similarity: its rotation is turned, its centre scaled, turned and moved."""
    m, r = cells(c2w, 16), _rows(rotation, shift)
    out = []
    for i in range(3):
        out += [sum((r[i][k] * m[4 * k + j] for k in range(3)), F.lit(0.0)) for j in range(3)]
        out.append(sum((r[i][k] * m[4 * k + 3] for k in range(3)), F.lit(0.0)) * scale + r[i][3])
    return F.array(*out, *map(F.lit, (0.0, 0.0, 0.0, 1.0)))


def similarity_w2c(w2c: C, rotation: list[list[float]], scale: float, shift: list[float]) -> Column:
    return geometry.invert_pose(similarity_c2w(geometry.invert_pose(w2c), rotation, scale, shift))


def as_vector(a: C) -> Column:
    return F.struct(*[c.alias(n) for n, c in zip("xyz", cells(a, 3), strict=True)])


def as_pose(c2w: C) -> Column:
    """{position {x y z}, rotation {x y z w}} of a camera-to-world pose."""
    m = cells(c2w, 16)
    q = cells(geometry.matrix_to_quaternion(F.array(*[m[4 * i + j] for i in range(3) for j in range(3)])), 4)
    return F.struct(as_vector(F.array(m[3], m[7], m[11])).alias("position"), F.struct(*[q[k].alias(n) for n, k in (("x", 1), ("y", 2), ("z", 3), ("w", 0))]).alias("rotation"))


def from_record(position: Column, rotation: Column) -> Column:
    """Camera-to-world pose of {x y z} and {x y z w}; null if the rotation has no length."""
    q = F.array(rotation["w"], rotation["x"], rotation["y"], rotation["z"])
    r = cells(geometry.quaternion_to_matrix(q), 9)
    p = [position[n] for n in "xyz"]
    made = F.array(*[x for i in range(3) for x in (*r[3 * i : 3 * i + 3], p[i])], *map(F.lit, (0.0, 0.0, 0.0, 1.0)))
    return F.when(geometry.array_norm(q, 4) > 1e-12, made)


def map_to_runtime(runtime: C, refined: C) -> Column:
    """What takes the map to the running session: the session's pose times the inverse of the refined one."""
    return geometry.multiply(runtime, geometry.invert_pose(refined), 4)


def decode_pose(encoding: C, width: Column, height: Column) -> tuple[Column, Column]:
    """(3x4 world to camera, 3x3 intrinsics with the centre as principal point) of translation, rotation xyzw and fields of view."""
    e = cells(encoding, 9)
    r = cells(geometry.quaternion_to_matrix(F.array(e[6], e[3], e[4], e[5])), 9)
    pose = F.array(*[x for i in range(3) for x in (*r[3 * i : 3 * i + 3], e[i])])
    fy, fx, zero = height / 2 / F.tan(e[7] / 2), width / 2 / F.tan(e[8] / 2), F.lit(0.0)
    return pose, F.array(fx, zero, width / 2, zero, fy, height / 2, zero, zero, F.lit(1.0))


def split_intrinsics(k: C) -> Column:
    m = cells(k, 9)
    return F.struct(m[0].alias("fx"), m[4].alias("fy"), m[2].alias("x0"), m[5].alias("y0"))


def ray_to_depth(distance: Column, u: Column, v: Column, k: C) -> Column:
    """Depth along the axis of a distance along a pixel's ray."""
    m = cells(k, 9)
    x, y = (u - m[2]) / m[0], (v - m[5]) / m[4]
    return distance / F.sqrt(x * x + y * y + 1)


def crop_intrinsics(k: C, width: Column, height: Column, out_width: Column, out_height: Column, scaling: float = 1.0) -> Column:
    """Intrinsics after scaling by pixel centres and a centred crop."""
    m = cells(k, 9)
    margin_x, margin_y = width * scaling - out_width, height * scaling - out_height
    return F.array(m[0] * scaling, m[1], (m[2] + 0.5) * scaling - 0.5 - margin_x * 0.5, m[3], m[4] * scaling, (m[5] + 0.5) * scaling - 0.5 - margin_y * 0.5, *m[6:9])


def inverse_3x3(a: C) -> Column:
    """The inverse by cofactors; null if there is none."""
    m = cells(a, 9)
    minor = lambda i, j: m[3 * ((i + 1) % 3) + (j + 1) % 3] * m[3 * ((i + 2) % 3) + (j + 2) % 3] - m[3 * ((i + 1) % 3) + (j + 2) % 3] * m[3 * ((i + 2) % 3) + (j + 1) % 3]
    det = sum((m[j] * minor(0, j) for j in range(3)), F.lit(0.0))
    return F.when(det != 0, F.array(*[F.try_divide(minor(j, i), det) for i in range(3) for j in range(3)]))


# boxes: x0, y0, x1, y1


def uncrop(box: Column, crop: Column) -> Column:
    """A box or points (x, y, x, y, ...) within a crop, in the image."""
    return F.transform(box, lambda x, i: x + F.element_at(crop, (i % 2 + 1).cast("int")))


def normalised(box: Column, width: Column, height: Column) -> Column:
    return F.array(box[0] / width, box[1] / height, box[2] / width, box[3] / height)


def denormalised(box: Column, width: Column, height: Column) -> Column:
    return F.array(box[0] * width, box[1] * height, box[2] * width, box[3] * height)


def centre_size(box: Column) -> Column:
    return F.array((box[0] + box[2]) / 2, (box[1] + box[3]) / 2, box[2] - box[0], box[3] - box[1])


def from_centre_size(cs: Column) -> Column:
    return F.array(cs[0] - cs[2] / 2, cs[1] - cs[3] / 2, cs[0] + cs[2] / 2, cs[1] + cs[3] / 2)


def to_model_space(points: Column, width: Column, height: Column, side: float = 1024.0, pixels: bool = True) -> Column:
    """Points (x, y, x, y, ...) in a square model image; from pixels, or from shares of the image."""
    return F.transform(points, lambda x, i: x * side / F.when(i % 2 == 0, width).otherwise(height) if pixels else x * side)


def longest_side(width: Column, height: Column, side: int = 1024) -> Column:
    """(width, height) with the longer side as asked for, rounded half up."""
    scale = F.lit(float(side)) / F.greatest(width, height)
    return F.array(F.floor(width * scale + 0.5), F.floor(height * scale + 0.5))


# pixels and pairs


def pixel_grid(width: Column, height: Column) -> Column:
    """All (x, y) of an image, row by row."""
    return F.flatten(F.transform(F.sequence(F.lit(0), height - 1), lambda y: F.transform(F.sequence(F.lit(0), width - 1), lambda x: F.array(x, y))))


def linear_index(y: Column, x: Column, width: Column) -> Column:
    return y * width + x


def row_and_column(index: Column, width: Column) -> Column:
    return F.array(F.floor(index / width), index % width)


def partner(index: Column) -> Column:
    """The other one of rows 2i and 2i + 1."""
    return index.bitwiseXOR(F.lit(1))


def drawn(key: Column, weights: list[float], seed: int = 0) -> Column:
    """A place in weights, from 0, drawn by hash of a key in proportion to them; the same for equal keys."""
    if not weights or min(weights) < 0 or sum(weights) <= 0:
        raise ValueError("weights have to be 0 or more, and some over 0")
    share = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 53)) / float(1 << 53)
    ends = [sum(weights[: k + 1]) / sum(weights) for k in range(len(weights) - 1)]
    return sum(((share >= e).cast("int") for e in ends), F.lit(0))


def labels_of(text: Column) -> Column:
    """Labels between commas, without white space around them."""
    return F.transform(F.split(text, ","), lambda x: F.trim(x))
