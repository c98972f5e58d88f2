"""Rotations, poses and cameras as column expressions.

A quaternion is an array (w, x, y, z), a 3x3 or 4x4 matrix an array in row-major order, a vector an
array of three. All expressions stay in the JVM.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

C = Column | str


def _c(a: C) -> Column:
    return F.col(a) if isinstance(a, str) else a


def cells(a: C, n: int) -> list[Column]:
    return [_c(a)[k].cast("double") for k in range(n)]


def array_norm(a: C, n: int) -> Column:
    return F.sqrt(sum((x * x for x in cells(a, n)), F.lit(0.0)))


def normalize(a: C, n: int) -> Column:
    size = array_norm(a, n)
    return F.transform(F.slice(_c(a), 1, n), lambda x: x.cast("double") / size)


def quaternion_multiply(a: C, b: C) -> Column:
    w, x, y, z = cells(a, 4)
    p, q, r, s = cells(b, 4)
    return F.array(w * p - x * q - y * r - z * s, w * q + x * p + y * s - z * r, w * r - x * s + y * p + z * q, w * s + x * r - y * q + z * p)


def quaternion_conjugate(a: C) -> Column:
    w, x, y, z = cells(a, 4)
    return F.array(w, -x, -y, -z)


def quaternion_to_matrix(a: C) -> Column:
    w, x, y, z = cells(normalize(a, 4), 4)
    one = F.lit(1.0)
    return F.array(
        one - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y),
        2 * (x * y + w * z), one - 2 * (x * x + z * z), 2 * (y * z - w * x),
        2 * (x * z - w * y), 2 * (y * z + w * x), one - 2 * (x * x + y * y),
    )


def matrix_to_quaternion(a: C) -> Column:
    """By whichever of the four components is largest; w is not negative."""
    m = cells(a, 9)
    trace = m[0] + m[4] + m[8]
    four = [trace, m[0] - m[4] - m[8], m[4] - m[0] - m[8], m[8] - m[0] - m[4]]
    size = [F.sqrt(F.greatest(1 + t, F.lit(0.0))) * 2 for t in four]
    a_, b_, c_ = m[7] - m[5], m[2] - m[6], m[3] - m[1]
    xy, xz, yz = m[1] + m[3], m[2] + m[6], m[5] + m[7]
    sign = lambda x: F.when(x < 0, -1.0).otherwise(1.0)
    made = [
        F.array(size[0] / 4, a_ / size[0], b_ / size[0], c_ / size[0]),
        F.array(F.abs(a_) / size[1], sign(a_) * size[1] / 4, sign(a_) * xy / size[1], sign(a_) * xz / size[1]),
        F.array(F.abs(b_) / size[2], sign(b_) * xy / size[2], sign(b_) * size[2] / 4, sign(b_) * yz / size[2]),
        F.array(F.abs(c_) / size[3], sign(c_) * xz / size[3], sign(c_) * yz / size[3], sign(c_) * size[3] / 4),
    ]
    most = F.greatest(*four)
    return F.when(four[0] == most, made[0]).when(four[1] == most, made[1]).when(four[2] == most, made[2]).otherwise(made[3])


def slerp(a: C, b: C, t: Column) -> Column:
    """Along the shorter way; nearly equal rotations are mixed linearly."""
    p, q = cells(a, 4), cells(b, 4)
    raw = sum((x * y for x, y in zip(p, q, strict=True)), F.lit(0.0))
    sign = F.when(raw < 0, -1.0).otherwise(1.0)
    d = F.least(F.abs(raw), F.lit(1.0))
    angle = F.acos(d)
    u = F.when(d > 0.9995, 1 - t).otherwise(F.sin((1 - t) * angle) / F.sin(angle))
    v = F.when(d > 0.9995, t).otherwise(F.sin(t * angle) / F.sin(angle))
    return normalize(F.array(*[x * u + y * sign * v for x, y in zip(p, q, strict=True)]), 4)


def axis_angle_to_matrix(a: C) -> Column:
    angle = array_norm(a, 3)
    x, y, z = (v / angle for v in cells(a, 3))
    s, c = F.sin(angle), F.cos(angle)
    k = 1 - c
    made = F.array(
        c + x * x * k, x * y * k - z * s, x * z * k + y * s,
        y * x * k + z * s, c + y * y * k, y * z * k - x * s,
        z * x * k - y * s, z * y * k + x * s, c + z * z * k,
    )
    return F.when(angle < 1e-10, identity(3)).otherwise(made)


def identity(n: int) -> Column:
    return F.array(*[F.lit(1.0 if i == j else 0.0) for i in range(n) for j in range(n)])


def multiply(a: C, b: C, n: int) -> Column:
    p, q = cells(a, n * n), cells(b, n * n)
    return F.array(*[sum((p[i * n + k] * q[k * n + j] for k in range(n)), F.lit(0.0)) for i in range(n) for j in range(n)])


def transpose(a: C, n: int) -> Column:
    m = cells(a, n * n)
    return F.array(*[m[j * n + i] for i in range(n) for j in range(n)])


def invert_pose(a: C) -> Column:
    """The inverse of a 4x4 rigid transform, in closed form."""
    m = cells(a, 16)
    rows = [[m[4 * j + i] for j in range(3)] for i in range(3)]
    shift = [-sum((rows[i][j] * m[4 * j + 3] for j in range(3)), F.lit(0.0)) for i in range(3)]
    return F.array(*[x for i in range(3) for x in (*rows[i], shift[i])], *map(F.lit, (0.0, 0.0, 0.0, 1.0)))


def pad_pose(a: C) -> Column:
    """A 3x4 pose as 4x4; a 4x4 one as it is."""
    a = _c(a)
    return F.when(F.size(a) == 12, F.concat(a, F.array(*map(F.lit, (0.0, 0.0, 0.0, 1.0))))).otherwise(a)


def camera_center(w2c: C) -> Column:
    m = cells(invert_pose(w2c), 16)
    return F.array(m[3], m[7], m[11])


def transform_point(pose: C, point: C) -> Column:
    m, p = cells(pose, 16), cells(point, 3)
    return F.array(*[sum((m[4 * i + j] * p[j] for j in range(3)), m[4 * i + 3]) for i in range(3)])


def similarity_point(point: C, rotation: list[list[float]], scale: float, translation: list[float]) -> Column:
    p = cells(point, 3)
    return F.array(*[sum((p[j] * float(scale * rotation[i][j]) for j in range(3)), F.lit(float(translation[i]))) for i in range(3)])


def rotation_angle(a: C, b: C) -> Column:
    """Degrees between two 3x3 rotations."""
    p, q = cells(a, 9), cells(b, 9)
    trace = sum((x * y for x, y in zip(p, q, strict=True)), F.lit(0.0))
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (trace - 1) / 2))))


def quaternion_error(a: C, b: C) -> Column:
    d = sum((x * y for x, y in zip(cells(a, 4), cells(b, 4), strict=True)), F.lit(0.0))
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 2 * d * d - 1))))


def direction_error(a: C, b: C) -> Column:
    """Degrees between two directions whatever their signs."""
    d = sum((x * y for x, y in zip(cells(a, 3), cells(b, 3), strict=True)), F.lit(0.0))
    angle = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), d / (array_norm(a, 3) * array_norm(b, 3))))))
    return F.when((array_norm(a, 3) == 0) | (array_norm(b, 3) == 0), F.lit(math.degrees(1e6))).otherwise(F.least(angle, 180 - angle))


def valid_pose(a: C) -> Column:
    """16 finite numbers, last row (0, 0, 0, 1), determinant of the rotation 1."""
    m = cells(a, 16)
    det = m[0] * (m[5] * m[10] - m[6] * m[9]) - m[1] * (m[4] * m[10] - m[6] * m[8]) + m[2] * (m[4] * m[9] - m[5] * m[8])
    good = (F.size(_c(a)) == 16) & ~F.exists(_c(a), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    for k, want in zip(range(12, 16), (0.0, 0.0, 0.0, 1.0), strict=True):
        good &= F.abs(m[k] - want) <= 1e-4
    return F.coalesce(good & (F.abs(det - 1) <= 1e-2), F.lit(False))


def valid_intrinsics(k: C, width: Column, height: Column) -> Column:
    m = cells(k, 9)
    good = (F.size(_c(k)) == 9) & ~F.exists(_c(k), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(good & (m[0] > 0) & (m[4] > 0) & (width > 0) & (height > 0), F.lit(False))


def scale_intrinsics(k: C, sx: Column, sy: Column) -> Column:
    m = cells(k, 9)
    return F.array(m[0] * sx, m[1], m[2] * sx, m[3], m[4] * sy, m[5] * sy, *m[6:])


def default_intrinsics(width: Column, height: Column) -> Column:
    z = F.lit(0.0)
    return F.array(width * 0.8, z, width / 2, z, height * 0.8, height / 2, z, z, F.lit(1.0))


def shift_intrinsics(k: C, pixels: float) -> Column:
    """The principal point moved, as between conventions half a pixel apart."""
    m = cells(k, 9)
    return F.array(m[0], m[1], m[2] + pixels, m[3], m[4], m[5] + pixels, *m[6:])


def unproject(u: Column, v: Column, depth: Column, k: C, c2w: C) -> Column:
    """The world point of a pixel with a depth."""
    m = cells(k, 9)
    return transform_point(c2w, F.array((u - m[2]) * depth / m[0], (v - m[5]) * depth / m[4], depth))


def project(point: C, k: C, w2c: C) -> Column:
    """(u, v, z) of a world point; no u and v in the camera's own plane."""
    x, y, z = cells(transform_point(w2c, point), 3)
    m = cells(k, 9)
    return F.array(F.try_divide(m[0] * x, z) + m[2], F.try_divide(m[4] * y, z) + m[5], z)


def visible(point: C, k: C, w2c: C, width: Column, height: Column) -> Column:
    u, v, z = cells(project(point, k, w2c), 3)
    return F.coalesce((z > 0) & (u >= 0) & (u < width) & (v >= 0) & (v < height), F.lit(False))


def disparity(depth: Column) -> Column:
    return F.when(depth > 0, 1 / depth).otherwise(0.0)


def pose_encoding(w2c: C, k: C, width: Column, height: Column) -> Column:
    """Translation, rotation (x, y, z, w) and the fields of view, height first."""
    m, n = cells(w2c, 16), cells(k, 9)
    q = cells(matrix_to_quaternion(F.array(*[m[4 * i + j] for i in range(3) for j in range(3)])), 4)
    return F.array(m[3], m[7], m[11], q[1], q[2], q[3], q[0], 2 * F.atan(height / 2 / n[4]), 2 * F.atan(width / 2 / n[0]))


def color_of(ident: Column) -> Column:
    """Red, green, blue and 255 from the first bytes of an id's digest."""
    digest = F.sha2(ident.cast("binary"), 256)
    return F.array(*[F.conv(F.substring(digest, at, 2), 16, 10).cast("int") for at in (1, 3, 5)], F.lit(255))


def resize_resolution(width: int, height: int, most: int = 250_000, divisor: int = 14) -> tuple[int, int]:
    """The widest size in whole divisors, its height rounded to the image's shape, of at most so many pixels."""
    tiles = most / divisor**2
    sizes = ((w, max(1, round(w * height / width))) for w in range(int(math.isqrt(most * width // height)) // divisor, 0, -1))
    w, h = next((s for s in sizes if s[0] * s[1] <= tiles), (1, 1))
    return w * divisor, h * divisor
