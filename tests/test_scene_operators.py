"""Visibility and surfaces against plain numpy and geometry."""

from __future__ import annotations

from collections import Counter

import numpy as np

from lumenfield.operators import surface, visibility

AXES = ["x", "y", "z"]
VIEW = "view long, w2c array<double>, fx double, fy double, cx double, cy double, width int, height int"


def looking(at: np.ndarray, eye: np.ndarray) -> np.ndarray:
    """World to camera, z forward."""
    z = (at - eye) / np.linalg.norm(at - eye)
    x = np.cross([0.0, 1.0, 0.1], z)
    x /= np.linalg.norm(x)
    out = np.eye(4)
    out[:3, :3] = [x, np.cross(z, x), z]
    out[:3, 3] = -out[:3, :3] @ eye
    return out


def brute_seen(points: np.ndarray, w2c: np.ndarray, k: tuple) -> np.ndarray:
    fx, fy, cx, cy, w, h = k
    p = points @ w2c[:3, :3].T + w2c[:3, 3]
    z = np.maximum(p[:, 2], 1e-12)
    u, v = (fx * p[:, 0] + cx * p[:, 2]) / z, (fy * p[:, 1] + cy * p[:, 2]) / z
    return (p[:, 2] > 0) & (u >= 0) & (u < w) & (v >= 0) & (v < h)


def test_visible_points_of_views(spark):
    rng = np.random.default_rng(2)
    points = np.concatenate([rng.normal(size=(6000, 3)) * 4, rng.normal(size=(2000, 3)) * 0.05 + 3])
    k = (80.0, 80.0, 32.0, 24.0, 64, 48)
    cameras = [looking(rng.normal(size=3), rng.normal(size=3) * 6) for _ in range(12)]
    rows = [(i, *map(float, p)) for i, p in enumerate(points)] + [(9001, None, 1.0, 2.0), (9002, float("nan"), 0.0, 1.0)]
    frame = spark.createDataFrame(rows, "fid long, x double, y double, z double")
    views = spark.createDataFrame([(i, c.ravel().tolist(), *k) for i, c in enumerate(cameras)] + [(99, [float("nan")] * 16, *k), (98, [1.0], *k), (97, None, *k)], VIEW)
    got = visibility.visible(frame, views, "fid", "view", AXES, 32).collect()
    want = {(i, int(p)) for i, c in enumerate(cameras) for p in np.flatnonzero(brute_seen(points, c, k))}
    assert {(r["view"], r["fid"]) for r in got} == want and len(got) == len(want) > 100
    # far fewer points are tested than there are pairs of views and points
    assert sum(r["tested"] for r in got) < 0.8 * len(want)
    assert visibility.visible(frame.limit(0), views, "fid", "view", AXES).count() == 0
    assert visibility.visible(frame, views.limit(0), "fid", "view", AXES).count() == 0
    pairs = {(r["a"], r["b"]): r["shared"] for r in visibility.shared_faces(visibility.visible(frame, views, "fid", "view", AXES), "view", "fid").collect()}
    sets = [{p for v, p in want if v == i} for i in range(12)]
    assert pairs == {(a, b): len(sets[a] & sets[b]) for a in range(12) for b in range(a + 1, 12) if sets[a] & sets[b]}


def closed(rows: list) -> bool:
    """Whether each edge of the mesh is in two triangles, once each way."""
    ways = Counter()
    for r in rows:
        e = [tuple(r[f"e{i}"]) for i in range(3)]
        ways.update((e[i], e[(i + 1) % 3]) for i in range(3))
    return all(n == 1 and ways[b, a] == 1 for (a, b), n in ways.items())


def test_triangles_of_a_sphere_are_closed(spark):
    voxel, radius = 0.1, 0.83
    grid = np.array(np.meshgrid(*[np.arange(-12, 13)] * 3, indexing="ij")).reshape(3, -1).T
    d = np.linalg.norm(grid * voxel, axis=1) - radius
    voxels = spark.createDataFrame([(*map(int, g), float(np.clip(x / 0.3, -1, 1))) for g, x in zip(grid, d, strict=True)], "vx long, vy long, vz long, tsdf double")
    rows = surface.extract(voxels, voxel).collect()
    points = np.array([[r["p0"], r["p1"], r["p2"]] for r in rows])
    assert len(rows) > 500 and closed(rows)
    assert np.abs(np.linalg.norm(points, axis=2) - radius).max() < voxel / 2
    normal = np.cross(points[:, 1] - points[:, 0], points[:, 2] - points[:, 0])
    flat = np.linalg.norm(normal, axis=1) < 1e-9
    assert ((normal * points.mean(1)).sum(1)[~flat] > 0).all()  # distances grow outwards
    area = np.linalg.norm(normal, axis=1).sum() / 2
    assert abs(area / (4 * np.pi * radius**2) - 1) < 0.03


def depth_of_sphere(w2c: np.ndarray, k: tuple, radius: float) -> np.ndarray:
    fx, fy, cx, cy, w, h = k
    u, v = np.meshgrid(np.arange(w), np.arange(h))
    ray = np.stack([(u + 0.5 - cx) / fx, (v + 0.5 - cy) / fy, np.ones((h, w))], 2)
    c = w2c[:3, 3]  # the sphere's middle as the camera has it
    a, b, e = (ray**2).sum(2), (ray * c).sum(2), c @ c - radius**2
    root = b * b - a * e
    return np.where(root > 0, (b - np.sqrt(np.maximum(root, 0))) / a, 0.0)


def test_fused_depth_frames_of_a_sphere(spark):
    k, radius, voxel, cut = (120.0, 120.0, 48.0, 48.0, 96, 96), 0.5, 0.05, 0.15
    eyes = [np.array(e, float) * 2 for e in ((1, 0, 0), (-1, 0, 0), (0, 1, 0.01), (0, -1, 0.01), (0, 0, 1), (0, 0, -1))]
    frames = [looking(np.zeros(3), e) for e in eyes]
    images = [depth_of_sphere(f, k, radius) for f in frames]
    pixels = [(n, int(u), int(v), float(i[v, u])) for n, i in enumerate(images) for v, u in zip(*np.nonzero(i), strict=True)] + [(0, 500, 2, 1.0), (0, 1, 1, None), (77, 1, 1, 1.0)]
    cameras = spark.createDataFrame([(n, f.ravel().tolist(), *k) for n, f in enumerate(frames)], VIEW.replace("view", "frame"))
    voxels = surface.integrate(spark.createDataFrame(pixels, "frame long, u int, v int, depth double"), cameras, "frame", voxel, cut, block=8)
    own: dict[tuple, list] = {}
    for image, f in zip(images, frames, strict=True):
        for cell, value in zip(*surface.fused(image, k[:4], f, voxel, cut, 50.0, 8), strict=True):
            own.setdefault(tuple(cell.tolist()), []).append(value)
    got = {(r["vx"], r["vy"], r["vz"]): (r["tsdf"], r["weight"]) for r in voxels.collect()}
    assert got.keys() == own.keys() and all(np.isclose(got[c][0], np.mean(v)) and got[c][1] == len(v) for c, v in own.items())
    rows = surface.extract(voxels, voxel).collect()
    far = np.abs(np.linalg.norm(np.array([[r["p0"], r["p1"], r["p2"]] for r in rows]).reshape(-1, 3), axis=1) - radius)
    assert len(rows) > 300 and np.quantile(far, 0.99) < voxel and np.median(far) < voxel / 3
    assert surface.integrate(spark.createDataFrame([], "frame long, u int, v int, depth double"), cameras, "frame").count() == 0
