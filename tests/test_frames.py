"""Frame functions, trajectories and sinks against numpy and round trips."""

from __future__ import annotations

import base64
import io
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfield.functions import frames, geometry
from lumenfield.operators import predicates, reductions, suppression, trajectory
from lumenfield.sources import sinks


def lit(a):
    return F.array(*[F.lit(float(x)) for x in np.ravel(a)])


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def pose(seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    q *= np.sign(np.linalg.det(q))
    out = np.eye(4)
    out[:3, :3], out[:3, 3] = q, rng.normal(size=3)
    return out


def test_poses_under_a_similarity(spark):
    c2w, sim = pose(1), pose(2)
    r, t, s = sim[:3, :3], sim[:3, 3], 2.5
    want = np.eye(4)
    want[:3, :3], want[:3, 3] = r @ c2w[:3, :3], s * r @ c2w[:3, 3] + t
    assert np.allclose(value(spark, frames.similarity_c2w(lit(c2w), r.tolist(), s, t.tolist())), want.ravel())
    w2c = np.linalg.inv(c2w)
    assert np.allclose(value(spark, frames.similarity_w2c(lit(w2c), r.tolist(), s, t.tolist())), np.linalg.inv(want).ravel())
    assert np.allclose(value(spark, frames.map_to_runtime(lit(want), lit(c2w))), (want @ np.linalg.inv(c2w)).ravel())
    assert np.allclose(value(spark, frames.scale_shift(lit(c2w), 3.0))[3], 3 * c2w[0, 3])
    assert value(spark, frames.flip_axes(lit([1, 2, 3]))) == [1.0, -2.0, -3.0]


def test_pose_records_and_encodings(spark):
    c2w = pose(3)
    record = value(spark, frames.as_pose(lit(c2w)))
    again = value(spark, frames.from_record(F.struct(*[F.lit(record["position"][n]).alias(n) for n in "xyz"]), F.struct(*[F.lit(2 * record["rotation"][n]).alias(n) for n in "xyzw"])))
    assert np.allclose(again, c2w.ravel())
    none = F.struct(*[F.lit(0.0).alias(n) for n in "xyzw"])
    assert value(spark, frames.from_record(none, none)) is None
    k, w2c = np.array([[50, 0, 32], [0, 40, 24], [0, 0, 1.0]]), np.linalg.inv(c2w)
    code = lit(value(spark, geometry.pose_encoding(lit(w2c), lit(k), F.lit(64), F.lit(48))))
    got_pose, got_k = frames.decode_pose(code, F.lit(64), F.lit(48))
    assert np.allclose(value(spark, got_pose), w2c[:3].ravel()) and np.allclose(value(spark, got_k), k.ravel())


def test_matrices_boxes_and_crops(spark):
    a = np.random.default_rng(4).normal(size=(3, 3))
    assert np.allclose(value(spark, frames.inverse_3x3(lit(a))), np.linalg.inv(a).ravel())
    assert value(spark, frames.inverse_3x3(lit(np.zeros(9)))) is None
    box = lit([2, 4, 10, 12])
    assert value(spark, frames.from_centre_size(frames.centre_size(box))) == [2, 4, 10, 12]
    assert value(spark, frames.denormalised(frames.normalised(box, F.lit(20), F.lit(40)), F.lit(20), F.lit(40))) == [2, 4, 10, 12]
    assert value(spark, frames.to_model_space(box, F.lit(2.0), F.lit(4.0), 8.0)) == [8, 8, 40, 24]
    k = lit([50, 0, 32, 0, 40, 24, 0, 0, 1])
    assert value(spark, frames.crop_intrinsics(k, F.lit(64), F.lit(48), F.lit(32), F.lit(24)))[2:6] == [16, 0, 40, 12]
    images = spark.createDataFrame([(7, 100, 80)], "id int, w int, h int")
    crops = [tuple(r)[1:] for r in suppression.crops(images, "id", "w", "h", 2).orderBy("layer", "x0", "y0").collect()]
    assert len(crops) == 1 + 4 + 16 and crops[0] == (0, 0, 0, 100, 80)
    assert crops[1:5] == [(1, 0, 0, 64, 54), (1, 0, 27, 64, 80), (1, 37, 0, 100, 54), (1, 37, 27, 100, 80)]
    for layer in (1, 2):
        own = [c for c in crops if c[0] == layer]
        covered = np.zeros((80, 100), bool)
        for _, x0, y0, x1, y1 in own:
            covered[y0:y1, x0:x1] = True
        assert covered.all()
    counts = {r["k"]: r["count"] for r in spark.range(20_000).select(frames.drawn(F.col("id"), [3.0, 0.0, 1.0, 4.0], 5).alias("k")).groupBy("k").count().collect()}
    assert set(counts) == {0, 2, 3} and all(abs(counts[k] / 20_000 - w / 8) < 0.02 for k, w in ((0, 3), (2, 1), (3, 4)))


def test_trajectory_alignment(spark):
    rng, rows = np.random.default_rng(5), []
    for s in range(3):
        sim, scale = pose(10 + s), 0.5 + s
        g = rng.normal(size=(40, 3))
        p = ((g - sim[:3, 3]) @ sim[:3, :3]) / scale
        rows += [(s, i, *map(float, g[i]), *map(float, p[i])) for i in range(40)]
    pairs = spark.createDataFrame(rows, "k int, i int, gx double, gy double, gz double, px double, py double, pz double")
    for r in trajectory.alignments(pairs, "k").collect():
        sim = pose(10 + r["k"])
        assert np.isclose(r["scale"], 0.5 + r["k"]) and np.allclose(np.reshape(r["rotation"], (3, 3)), sim[:3, :3]) and np.allclose(r["shift"], sim[:3, 3])
    assert all(r["ate"] < 1e-9 and r["rpe"] < 1e-9 for r in trajectory.trajectory_errors(pairs, "k", ["i"]).collect())
    off = trajectory.trajectory_errors(pairs.withColumn("px", F.col("gx") + 3).withColumn("py", F.col("gy")).withColumn("pz", F.col("gz")), "k", ["i"], align=False)
    assert all(np.isclose(r["ate"], 3) and np.isclose(r["rpe"], 0, atol=1e-9) for r in off.collect())


def test_relative_and_rebased_poses(spark):
    poses = [pose(k) for k in range(4)]
    df = spark.createDataFrame([(0, k, p.ravel().tolist()) for k, p in enumerate(poses)], "s int, i int, c2w array<double>")
    for r in trajectory.relative_poses(df, "s", ["i"], "c2w").collect():
        assert np.allclose(r["relative"], (np.linalg.inv(poses[r["i"] - 1]) @ poses[r["i"]]).ravel())
    for r in trajectory.rebase_poses(df, "s", ["i"], "c2w").collect():
        assert np.allclose(r["c2w"], (np.linalg.inv(poses[0]) @ poses[r["i"]]).ravel())
    with pytest.raises(ValueError, match="outside"):
        trajectory.require_coverage(df.withColumn("i", F.col("i") + 1), df, "s", "i")


def test_least_absolute_deviations(spark):
    rng = np.random.default_rng(6)
    x = rng.uniform(1, 9, 300)
    y = 2 * x + 3
    y[:60] += rng.uniform(5, 50, 60)  # a fifth is far off
    s, t = reductions.least_absolute(spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)], "x double, y double"), "x", "y")
    assert abs(s - 2) < 1e-3 and abs(t - 3) < 1e-2


def test_gates(spark):
    got = spark.createDataFrame([("a.glb", 1), ("file:/x", 0), ("/x", 0), ("a/../b", 0), ("https://h/a", 1), ("HTTP://h/a", 0), (None, 1)], "u string, ok int")
    assert all(r["s"] == bool(r["ok"]) for r in got.select("ok", predicates.safe_asset("u").alias("s")).collect())
    with pytest.raises(ValueError, match="no tensor"):
        reductions.matching_tensors(*[spark.createDataFrame([(n, "3")], "name string, shape string") for n in "ab"])


def test_sinks_read_back(spark, tmp_path):
    rng = np.random.default_rng(7)
    rows = [(k % 2, *map(float, np.float32(rng.normal(size=3))), *map(int, rng.integers(0, 256, 3))) for k in range(50)]
    points = spark.createDataFrame(rows, "cloud int, x double, y double, z double, red int, green int, blue int")
    files = sinks.clouds(points, "cloud")
    assert sorted(sinks.cloud_rows(files, "cloud").collect()) == sorted(points.collect())
    info = reductions.cloud_info(points, ["cloud"]).collect()
    assert {r["cloud"]: r["points"] for r in info} == {0: 25, 1: 25}
    k = spark.createDataFrame([(1, [50.0, 0.0, 32.0, 0.0, 40.0, 24.0, 0.0, 0.0, 1.0])], "view int, k array<double>").withColumn("k", sinks.rescaled("k", F.lit(64), F.lit(48), F.lit(32), F.lit(24)))
    saved = np.load(io.BytesIO(sinks.npz(k, "view", {"k": [3, 3]}).first()["npz"]))["k"]
    assert saved.tolist() == [[25, 0, 16], [0, 20, 12], [0, 0, 1]]
    poses = spark.createDataFrame([(float(t), [1.0, 2.0, 3.0], [1.0, 0.0, 0.0, 0.0]) for t in (3, 1, 2)], "ts double, position array<double>, rotation array<double>")
    sinks.write_trajectory(poses, f"{tmp_path}/tum", 1)
    lines = [x for p in sorted((tmp_path / "tum").glob("part-*")) for x in p.read_text().splitlines()]
    assert lines == [f"{t}.0 1.0 2.0 3.0 0.0 0.0 0.0 1.0" for t in (1, 2, 3)]
    assert sorted(r["ts"] for r in sinks.read_timestamps(spark, f"{tmp_path}/tum").collect()) == [1, 2, 3]


def test_documents_pools_and_archives(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/doc.json"
    for n in (1, 2):
        sinks.write_document(spark, path, {"n": np.int64(n), "a": np.arange(2)})
    assert sinks.read_document(spark, path) == {"n": 2, "a": [0, 1]} and not (tmp_path / "doc.json.part").exists()
    pool = spark.createDataFrame([("v1", 0.5, [1, 2])], "view_id string, reliability double, faces array<int>")
    sinks.write_pool(spark, pool, f"{tmp_path}/pool.json")
    assert sinks.read_pool(spark, f"{tmp_path}/pool.json", "view_id string, reliability double, faces array<int>").collect() == pool.collect()
    with pytest.raises(ValueError, match="at most"):
        sinks.write_pool(spark, pool.union(pool), f"{tmp_path}/pool.json", most=1)
    (tmp_path / "k.json").write_text(json.dumps({"fx": 5.0, "fy": 4.0, "cx": 3.0, "cy": 2.0, "width": 6, "height": 4}, indent=1))
    assert sinks.read_intrinsics(spark, f"{tmp_path}/k.json").first()["k"] == [5, 0, 3, 0, 4, 2, 0, 0, 1]
    (tmp_path / "t.json").write_text(json.dumps({"w": 6, "h": 4, "fl_x": 5, "fl_y": 4, "cx": 3, "cy": 2, "frames": [{"file_path": "a", "transform_matrix": np.eye(4).tolist()}]}))
    assert sinks.read_transforms(spark, f"{tmp_path}/t.json").first()["c2w"] == np.eye(4).ravel().tolist()
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for n in ("b.png", "a.JPG", "notes.txt"):
            z.writestr(n, n)
    got = sinks.read_archives(spark, f"{tmp_path}/a.zip").orderBy("index").collect()
    assert [(r["name"], bytes(r["content"])) for r in got] == [("a.JPG", b"a.JPG"), ("b.png", b"b.png")]
    assert value(spark, sinks.decoded(F.lit(base64.b64encode(b"xy").decode()))) == b"xy" and value(spark, sinks.decoded(F.lit("?"))) is None
    monkeypatch.setenv("OWN_N", "no number")
    assert sinks.env_number("OWN_N", 7, 3) == 7 and sinks.env_number("OTHER_N", 1, 3) == 3
