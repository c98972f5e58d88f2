"""Surfaces from depth frames: truncated signed distances in voxels, fused over frames, and triangles at their zero.

A frame's pixels mark the blocks of BLOCK voxels a side that their rays meet within the truncation
about the surface. All voxels of a marked block are projected into the frame; those in front of the
surface, or behind it by no more than the truncation, take its distance there. A task sums what its frames
give to a voxel before anything is shuffled. A frame is one row group in one task: its size bounds it.

The surface runs through cubes of 2 x 2 x 2 neighbouring voxels, wherever these lie; each cube is cut
into six tetrahedra along its diagonal, the same way everywhere, so triangles of neighbouring cubes
meet edge to edge. In a tetrahedron the surface is where the distances, taken as linear, are zero.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfield.session import ship_package

VOXEL, TRUNCATION, FARTHEST, BLOCK = 0.01, 0.04, 50.0, 16
_VOXELS = "vx long, vy long, vz long, total double, weight double"
_CORNERS = np.array(list(itertools.product((0, 1), repeat=3)))
#: The tetrahedra of a cube: paths from corner 0 to corner 7 along one axis after the other.
_TETRAHEDRA = np.array([[0, *np.cumsum([4 >> a for a in order])] for order in itertools.permutations(range(3))])


def touched(u: np.ndarray, v: np.ndarray, depth: np.ndarray, k: tuple[float, float, float, float], c2w: np.ndarray, size: float, cut: float) -> np.ndarray:
    """Blocks of a side of `size` that the pixels' rays meet from `cut` before the surface to `cut` behind it."""
    fx, fy, cx, cy = k
    ray = np.stack([(u - cx) / fx, (v - cy) / fy, np.ones_like(depth)], 1)
    steps = np.linspace(-cut, cut, 1 + 2 * int(np.ceil(2 * cut / size)))
    z = np.maximum(depth[:, None] + steps, 0.0)
    points = (ray[:, None] * z[:, :, None]).reshape(-1, 3) @ c2w[:3, :3].T + c2w[:3, 3]
    return np.unique(np.floor(points / size).astype(np.int64), axis=0)


def fused(image: np.ndarray, k: tuple[float, float, float, float], w2c: np.ndarray, voxel: float, cut: float, farthest: float, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Voxels of one depth image (0 or not finite: nothing) and the truncated distances that it gives them."""
    v, u = np.nonzero(np.isfinite(image) & (image > 0) & (image <= farthest))
    if not len(u):
        return np.zeros((0, 3), np.int64), np.zeros(0)
    own = touched(u.astype(float), v.astype(float), image[v, u], k, np.linalg.inv(w2c), voxel * block, cut)
    inner = np.array(list(itertools.product(range(block), repeat=3)))
    cells, values = [], []
    for at in range(0, len(own), 64):
        grid = (own[at : at + 64, None] * block + inner).reshape(-1, 3)
        p = (grid * voxel) @ w2c[:3, :3].T + w2c[:3, 3]
        ahead = np.flatnonzero(p[:, 2] > 0)
        p, grid = p[ahead], grid[ahead]
        x, y = k[0] * p[:, 0] / p[:, 2] + k[2], k[1] * p[:, 1] / p[:, 2] + k[3]
        inside = np.flatnonzero((x >= 0) & (y >= 0) & (x <= image.shape[1] - 1) & (y <= image.shape[0] - 1))
        seen = image[y[inside].astype(np.int64), x[inside].astype(np.int64)]
        d = seen - p[inside, 2]
        good = np.isfinite(seen) & (seen > 0) & (seen <= farthest) & (d >= -cut)
        cells.append(grid[inside[good]])
        values.append(np.minimum(d[good] / cut, 1.0))
    return np.concatenate(cells), np.concatenate(values)


def _sums(cells: np.ndarray, totals: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    found, place = np.unique(cells, axis=0, return_inverse=True)
    return found, np.bincount(place.ravel(), totals, len(found)), np.bincount(place.ravel(), weights, len(found))


def integrate(pixels: DataFrame, cameras: DataFrame, frame: str, voxel: float = VOXEL, cut: float = TRUNCATION, farthest: float = FARTHEST, least: float = 1.0, block: int = BLOCK) -> DataFrame:
    """vx, vy, vz, tsdf, weight: of voxels that at least `least` frames give a distance, their mean and how many do.

    pixels: frame, u, v, depth; cameras: frame, w2c (16 numbers by rows), fx, fy, cx, cy, width, height.
    Pixels that are absent, null, not finite or outside the image give nothing.
    """
    ship_package(pixels.sparkSession)
    one = F.struct(F.col("u").cast("int").alias("u"), F.col("v").cast("int").alias("v"), F.col("depth").cast("double").alias("depth"))
    images = pixels.filter(F.col("depth").isNotNull() & (F.col("depth") > 0)).groupBy(frame).agg(F.collect_list(one).alias("p"))
    frames = images.join(cameras, frame).select(
        F.col("p.u").alias("u"), F.col("p.v").alias("v"), F.col("p.depth").alias("depth"), "w2c", *[F.col(c).cast("double").alias(c) for c in ("fx", "fy", "cx", "cy")], F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def packed() -> pa.RecordBatch:
            cells, total, weight = (np.concatenate(x) for x in zip(*held, strict=True))
            return pa.RecordBatch.from_arrays([*(pa.array(cells[:, i]) for i in range(3)), pa.array(total), pa.array(weight)], ["vx", "vy", "vz", "total", "weight"])

        for batch in batches:
            for n in range(batch.num_rows):
                r = {name: batch.column(name)[n] for name in batch.schema.names}
                image = np.zeros((r["height"].as_py(), r["width"].as_py()))
                u, v, depth = (np.array(r[c].values) for c in ("u", "v", "depth"))
                ok = (u >= 0) & (v >= 0) & (u < image.shape[1]) & (v < image.shape[0])
                image[v[ok], u[ok]] = depth[ok]
                w2c = np.array(r["w2c"].as_py(), float).reshape(4, 4)
                cells, values = fused(image, tuple(r[c].as_py() for c in ("fx", "fy", "cx", "cy")), w2c, voxel, cut, farthest, block)
                if len(cells):
                    held.append((cells, values, np.ones(len(cells))))
                if sum(len(x) for x, *_ in held) > 1 << 20:
                    held[:] = [_sums(*(np.concatenate(x) for x in zip(*held, strict=True)))]
                    if len(held[0][0]) > 1 << 19:
                        yield packed()
                        held.clear()
        if held:
            held[:] = [_sums(*(np.concatenate(x) for x in zip(*held, strict=True)))]
            yield packed()

    sums = frames.mapInArrow(run, _VOXELS).groupBy("vx", "vy", "vz").agg(F.sum("total").alias("total"), F.sum("weight").alias("weight"))
    return sums.filter(F.col("weight") >= least).select("vx", "vy", "vz", (F.col("total") / F.col("weight")).alias("tsdf"), "weight")


def triangles_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of cubes (n x 8 values, corners in the order of _CORNERS): cube of each triangle, its vertices' corner pairs (t x 3 x 2), shares from the first."""
    cubes, pairs = [], []
    for tetrahedron in _TETRAHEDRA:
        below = values[:, tetrahedron] < 0
        number = below.sum(1)
        for few, lone in ((1, True), (3, False)):
            row = np.flatnonzero(number == few)
            apex = (below[row] == lone).argmax(1)
            others = np.array([[x for x in range(4) if x != a] for a in range(4)])[apex]
            ends = np.stack([np.repeat(tetrahedron[apex][:, None], 3, 1), tetrahedron[others]], 2)
            cubes.append(row)
            pairs.append(ends)
        row = np.flatnonzero(number == 2)
        order = np.argsort(~below[row], axis=1, kind="stable")  # the two below first
        a, b, c, d = (tetrahedron[order[:, n]] for n in range(4))
        edge = lambda x, y: np.stack([x, y], 1)
        square = [edge(a, c), edge(a, d), edge(b, d), edge(b, c)]
        for three in ((0, 1, 2), (0, 2, 3)):
            cubes.append(row)
            pairs.append(np.stack([square[n] for n in three], 1))
    cube, pair = np.concatenate(cubes), np.sort(np.concatenate(pairs), axis=2)
    first, second = values[cube[:, None], pair[:, :, 0]], values[cube[:, None], pair[:, :, 1]]
    share = first / (first - second)
    # the side that triangles turn to is where values are positive
    place = _CORNERS[pair[:, :, 0]] + share[:, :, None] * (_CORNERS[pair[:, :, 1]] - _CORNERS[pair[:, :, 0]])
    normal = np.cross(place[:, 1] - place[:, 0], place[:, 2] - place[:, 0])
    rising = np.where(first < 0, 1.0, -1.0)[:, :, None] * (_CORNERS[pair[:, :, 1]] - _CORNERS[pair[:, :, 0]])
    turned = (normal * rising.sum(1)).sum(1) < 0
    pair[turned], share[turned] = pair[turned][:, ::-1], share[turned][:, ::-1]
    return cube, pair, share


def extract(voxels: DataFrame, voxel: float = VOXEL) -> DataFrame:
    """Triangles of the surface: cx, cy, cz of their cube, points p0, p1, p2 (x, y, z), and edges e0, e1, e2, the voxels (6 numbers) between which each point lies.

    Cubes with an absent corner have no surface. Equal edges are one vertex of the mesh.
    """
    ship_package(voxels.sparkSession)
    corner = F.explode(F.array(*[F.struct(*[F.lit(int(x)).alias(n) for x, n in zip(c, "xyz", strict=True)], F.lit(k).alias("k")) for k, c in enumerate(_CORNERS)]))
    spread = voxels.select("vx", "vy", "vz", "tsdf", corner.alias("c")).select(*[(F.col(f"v{a}") - F.col(f"c.{a}")).alias(f"c{a}") for a in "xyz"], "c.k", "tsdf")
    cubes = spread.groupBy("cx", "cy", "cz").agg(*[F.max(F.when(F.col("k") == k, F.col("tsdf"))).alias(f"d{k}") for k in range(8)])
    values = [F.col(f"d{k}") for k in range(8)]
    cubes = cubes.filter((F.least(*values) < 0) & (F.greatest(*values) >= 0)).dropna(subset=[f"d{k}" for k in range(8)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.stack([np.array(batch.column(f"c{a}")) for a in "xyz"], 1)
            cube, pair, share = triangles_of(np.stack([np.array(batch.column(f"d{k}")) for k in range(8)], 1))
            ends = own[cube][:, None, None] + _CORNERS[pair]  # triangles x 3 x 2 x 3
            place = (ends[:, :, 0] + share[:, :, None] * (ends[:, :, 1] - ends[:, :, 0])) * voxel
            lists = lambda x: pa.array(list(x))
            cols = [*(pa.array(own[cube][:, i]) for i in range(3)), *(lists(place[:, i]) for i in range(3)), *(lists(ends[:, i].reshape(-1, 6)) for i in range(3))]
            if len(cube):
                yield pa.RecordBatch.from_arrays(cols, ["cx", "cy", "cz", "p0", "p1", "p2", "e0", "e1", "e2"])

    kinds = ", ".join([*(f"c{a} long" for a in "xyz"), *(f"p{i} array<double>" for i in range(3)), *(f"e{i} array<long>" for i in range(3))])
    return cubes.mapInArrow(run, kinds)
