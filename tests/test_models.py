"""Sparse models as text."""

from __future__ import annotations

import random

import pytest

from lumenfield.sources import models


def test_points_and_cameras_as_text(spark, tmp_path):
    rng = random.Random(3)
    rows = []
    for k in range(5000):
        n = rng.randint(0, 6)
        rows.append((k, [rng.uniform(-1e3, 1e3) for _ in range(3)], [rng.randint(0, 255) for _ in range(3)], rng.random() * 1e-7, [rng.randint(1, 40) for _ in range(n)], [rng.randint(0, 9000) for _ in range(n)]))
    points = spark.createDataFrame(rows, "point_id long, xyz array<double>, rgb array<int>, error double, image_ids array<int>, point2d_idxs array<int>")
    models.write_points_text(points, str(tmp_path / "points"))
    assert sorted(map(tuple, models.read_points_text(spark, str(tmp_path / "points")).collect())) == rows
    # one file, with remarks and empty lines, is cut into several partitions
    one = tmp_path / "points3D.txt"
    one.write_text("# remarks\n\n" + "".join(f"{r[0]} {' '.join(map(repr, r[1]))}  {' '.join(map(str, r[2]))} {r[3]!r} {' '.join(f'{a} {b}' for a, b in zip(r[4], r[5], strict=True))}\n" for r in rows))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        back = models.read_points_text(spark, str(one))
        assert back.rdd.getNumPartitions() > 3 and sorted(map(tuple, back.collect())) == rows
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    seen: dict = {}
    for r in rows:
        for i in set(r[4]):
            seen.setdefault(i, []).append(len(r[4]))
    got = {r["image_id"]: (r["n_points"], r["mean_track"]) for r in models.track_lengths(points).collect()}
    assert got.keys() == seen.keys() and all(got[i][0] == len(v) and got[i][1] == pytest.approx(sum(v) / len(v)) for i, v in seen.items())
    assert models.model_format(spark, str(tmp_path)) is None
    for name in ("cameras", "images"):
        (tmp_path / f"{name}.txt").write_text("1 PINHOLE 64 48 50.5 50.25 32 24\n2 SIMPLE_RADIAL 10 20 1e-3 5 10 -0.125\n")
    assert models.model_format(spark, str(tmp_path)) == ".txt"
    cameras = models.read_cameras_text(spark, str(tmp_path / "cameras.txt"))
    assert sorted(map(tuple, cameras.collect())) == [(1, "PINHOLE", 64, 48, [50.5, 50.25, 32.0, 24.0]), (2, "SIMPLE_RADIAL", 10, 20, [0.001, 5.0, 10.0, -0.125])]
    models.write_cameras_text(cameras, str(tmp_path / "again"))
    assert sorted(models.read_cameras_text(spark, str(tmp_path / "again")).collect()) == sorted(cameras.collect())
    for name in models.PARTS:
        (tmp_path / f"{name}.bin").write_bytes(b"")
    assert models.model_format(spark, str(tmp_path)) == ".bin"
    (tmp_path / "bad.txt").write_text("1 2 3\n")
    with pytest.raises(Exception, match="not a line of points"):
        models.read_points_text(spark, str(tmp_path / "bad.txt")).collect()
