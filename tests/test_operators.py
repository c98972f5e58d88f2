"""Operators that SQL cannot express, sources and streams, on small fixtures."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfield.functions import geometry, masks
from lumenfield.operators import alignment, datasets, selection, vectors
from lumenfield.operators.components import connected_components
from lumenfield.plans import scene
from lumenfield.sources import formats, readers
from lumenfield.streaming import tasks


def lit(values):
    return F.array(*[F.lit(float(v)) for v in values])


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("angle,axis", [(0.0, (1, 0, 0)), (90, (1, 0, 0)), (45, (0, 1, 0)), (30, (0, 0, 1)), (200, (0.6, 0.0, 0.8))])
def test_rotations_round_trip(spark, angle, axis):
    half = math.radians(angle) / 2
    q = [math.cos(half), *(math.sin(half) * a for a in axis)]
    m = one(spark, geometry.quaternion_to_matrix(lit(q)))
    back = one(spark, geometry.matrix_to_quaternion(lit(m)))
    assert abs(abs(np.dot(back, q)) - 1) < 1e-9
    same = one(spark, geometry.axis_angle_to_matrix(lit([math.radians(angle) * a for a in axis])))
    assert np.allclose(m, same, atol=1e-9) and back[0] >= 0
    assert one(spark, geometry.rotation_angle(lit(m), geometry.identity(3))) == pytest.approx(min(angle, 360 - angle), abs=1e-5)


def test_slerp(spark):
    a, b = [1.0, 0, 0, 0], [math.cos(math.pi / 4), math.sin(math.pi / 4), 0, 0]
    for t, want in ((0.0, 0.0), (0.5, math.pi / 8), (1.0, math.pi / 4)):
        assert np.allclose(one(spark, geometry.slerp(lit(a), lit([-x for x in b]), F.lit(t))), [math.cos(want), math.sin(want), 0, 0])


def test_poses_and_cameras(spark):
    pose = [0, -1, 0, 1, 1, 0, 0, 2, 0, 0, 1, 3, 0, 0, 0, 1]
    back = lit(one(spark, geometry.invert_pose(lit(pose))))
    both = one(spark, geometry.multiply(lit(pose), back, 4))
    assert np.allclose(both, np.eye(4).ravel())
    assert one(spark, geometry.valid_pose(lit(pose))) and not one(spark, geometry.valid_pose(lit([*pose[:10], 2.0, *pose[11:]])))
    k = [100, 0, 50, 0, 100, 40, 0, 0, 1]
    point = lit(one(spark, geometry.unproject(F.lit(60.0), F.lit(30.0), F.lit(2.0), lit(k), lit(pose))))
    assert np.allclose(one(spark, geometry.project(point, lit(k), back)), [60, 30, 2])
    assert geometry.resize_resolution(1920, 1080) == (658, 364) and geometry.resize_resolution(4032, 3024) == (574, 434)


def test_similarity_alignment_of_known_pairs(spark):
    rows = [(*map(float, s), *(2.0 * np.array(s) + (5, -1, 0.5)).tolist(), 1.0) for s in ((0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1))]
    names = ["sx", "sy", "sz", "tx", "ty", "tz", "w"]
    got = alignment.similarity(spark.createDataFrame(rows, names))
    assert np.allclose(got["rotation"], np.eye(3)) and got["scale"] == pytest.approx(2) and np.allclose(got["translation"], (5, -1, 0.5))
    assert got["rms"] == pytest.approx(0, abs=1e-9)
    with pytest.raises(ValueError):
        alignment.similarity(spark.createDataFrame(rows[:2], names))
    with pytest.raises(ValueError):
        alignment.similarity(spark.createDataFrame([rows[0]] * 4, names))


def test_components_with_hubs_chains_and_loops(spark):
    edges = [(0, k) for k in range(1, 300)] + [(k, k + 1) for k in range(1000, 1100)] + [(7, 7), (None, 3), (2000, 2001), (2001, 2000)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[k] for k in range(300)} == {0} and {got[k] for k in range(1000, 1101)} == {1000} and got[2001] == 2000
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_assignment_is_optimal():
    rng = np.random.default_rng(3)
    for n, m in ((3, 3), (4, 6), (6, 4), (1, 5)):
        worth = rng.random((n, m))
        got = sum(worth[i, j] for i, j in selection.assign(worth))
        small, large = (n, m) if n <= m else (m, n)
        grid = worth if n <= m else worth.T
        assert got == pytest.approx(max(sum(grid[i, p[i]] for i in range(small)) for p in itertools.permutations(range(large), small)))


def test_pool_rules():
    pool = [("a", 1.0, {1, 2, 3}), ("b", 0.5, {3, 4, 5})]
    assert selection.update_pool(pool, ("c", 1.0, {9}), 3) == (pool, False)
    assert selection.update_pool(pool, ("c", 1.0, {2, 3, 4}), 3)[1]
    full, changed = selection.update_pool(pool, ("c", 5.0, {1, 2, 3, 4}), 2)
    assert changed and "c" in {v[0] for v in full} and len(full) == 2
    assert selection.update_pool(pool, ("c", 0.0, {2, 3, 4}), 2) == (pool, False)
    assert selection.greedy_pool([("b", 1.0, {1}), ("a", 1.0, {1}), ("c", 0.9, {2})], 2) == ["a", "c"]


def test_masks(spark):
    rng = np.random.default_rng(4)
    mask = rng.random((7, 5)) > 0.5
    counts = masks.encode(mask)
    assert (masks.decode(counts, 7, 5) == mask).all()
    column = F.array(*[F.lit(c) for c in counts])
    assert one(spark, masks.rle_area(column)) == mask.sum()
    assert one(spark, masks.rle_pixels(column)) == mask.ravel(order="F").astype(int).tolist()
    holed = np.ones((6, 6), bool)
    holed[2, 2] = False
    assert masks.remove_small(holed, 3, holes=True)[0].all()
    dots = np.zeros((6, 6), bool)
    dots[0, 0] = dots[3:5, 3:5] = True
    assert masks.remove_small(dots, 9, holes=False)[0].sum() == 4
    assert masks.remove_small(dots, 2, holes=False)[1] and not masks.remove_small(dots, 1, holes=False)[1]
    empty = np.zeros((3, 3), bool)
    assert not masks.remove_small(empty, 5, holes=False)[0].any() and masks.remove_small(empty, 10, holes=True)[0].all()


def test_scene_objects(spark):
    rng = np.random.default_rng(7)
    rows, words = [], []
    for c, x in enumerate((0.0, 0.5)):
        for k in range(64):
            p = (rng.normal(size=3) * 0.005 + (x, 0, 1)).tolist()
            rows.append((64 * c + k, *p, [1.0 - c, float(c)], 1.0))
            words.append((64 * c + k, *p, [1.0] * 4))
    points = spark.createDataFrame([*rows, (999, float("nan"), 0.0, 0.0, [1.0, 0.0], 1.0)], "point_id long, x double, y double, z double, feature array<double>, confidence double")
    language = spark.createDataFrame(words, "lang_id long, x double, y double, z double, feature array<double>")
    catalog = scene.build_objects(points, language)
    got = catalog.orderBy("object_id").collect()
    assert [r["object_id"] for r in got] == ["object_0001", "object_0002"] and [r["n"] for r in got] == [64, 64]
    assert np.allclose(got[0]["feature"], [0.5] * 4)
    assert scene.search(catalog, [0.5] * 4).count() == 2 and scene.search(catalog, [0.1] * 4).count() == 0
    faces = spark.createDataFrame([(1, 0.0, 0.0, 1.0), (2, 0.5, 0.0, 1.0), (3, 9.0, 9.0, 9.0)], "fid long, x double, y double, z double")
    assert {(r["fid"], r["object_id"]) for r in scene.label_faces(faces, catalog).collect()} == {(1, "object_0001"), (2, "object_0002")}


def test_dataset_algebra(spark):
    rows = spark.range(10).withColumnRenamed("id", "k")
    got = datasets.resize(rows, "k", 25).collect()
    assert sorted(r["position"] for r in got) == list(range(25)) and {r["k"] for r in got} == set(range(10))
    assert datasets.batches(rows, "k", 3, 4, 1).groupBy("batch").agg(F.count("*").alias("n"), F.count_distinct("feature").alias("f")).filter("n = 3 and f = 1").count() == 3
    assert datasets.sample_n(rows.withColumn("g", F.col("k") % 2), ["g"], "k", 2, 5).count() == 4
    assert sorted(r["index"] for r in datasets.global_index(rows, [F.desc("k")]).collect()) == list(range(10))


def test_sensor_files(spark, tmp_path):
    path = tmp_path / "imu.csv"
    path.write_text("timestamp,acc_x,acc_y,acc_z,gyro_x,gyro_y,gyro_z\n20,0,0,9.81,0,0,0\n0,0,0,0,0,0,0\n10,0,0,9.81,0,0,0\n")
    assert [r["timestamp"] for r in readers.read_imu(spark, str(path)).collect()] == [10, 20]
    path.write_text("timestamp,acc_x\n1,2\n")
    with pytest.raises(ValueError, match="missing"):
        readers.read_imu(spark, str(path))
    pose = tmp_path / "ar.csv"
    pose.write_text("timestamp,px,py,pz,qx,qy,qz,qw\n0,0,0,0,0,0,0,1\n10,1,0,0,0,0,0,1\n")
    frames = spark.createDataFrame([(5,), (20,)], "timestamp long")
    assert readers.read_ar_poses(spark, str(pose)).count() == 2
    with pytest.raises(ValueError, match="outside"):
        readers.read_ar_poses(spark, str(pose), frames)
    split = tmp_path / "split.txt"
    split.write_text("2007_1__3\n2007_2__1\n\n")
    assert [tuple(r) for r in readers.read_split(spark, str(split)).collect()] == [("2007_1", 2), ("2007_2", 0)]
    line = tmp_path / "traj.txt"
    line.write_text("# ts\n0 1 2 3 0 0 0 1\n1 2 3 4 0 0 0 1\n2 3 4 5 0 0 0 1\n")
    assert [r["ts"] for r in readers.read_trajectory(spark, str(line), skip=1, stride=1).collect()] == [1.0, 2.0]
    poses = tmp_path / "poses"
    poses.mkdir()
    (poses / "17.txt").write_text(" ".join(map(str, range(16))))
    (poses / "18.txt").write_text("1 2 3")
    assert [r["timestamp"] for r in readers.read_pose_files(spark, str(poses)).collect()] == [17]


def test_binary_formats(spark, tmp_path):
    rng = np.random.default_rng(5)
    for shape in ((3, 4), (3, 4, 2)):
        values = rng.random(shape).astype(np.float32)
        assert (formats.read_array(formats.write_array(values)) == values).all()
    image = rng.random((2, 3)).astype("<f4")
    assert (formats.read_pfm(b"Pf\n3 2\n-1.0\n" + image[::-1].tobytes()) == image).all()
    cameras = [(1, "PINHOLE", 640, 480, [500.0, 501.0, 320.0, 240.0]), (2, "SIMPLE_PINHOLE", 10, 10, [1.0, 2.0, 3.0])]
    raw = formats.write_cameras(cameras)
    assert list(formats.read_cameras(raw)) == cameras
    views = [(7, [1.0, 0.0, 0.0, 0.0], [1.0, 2.0, 3.0], 1, "a.jpg", [[1.0, 2.0, 5]])]
    assert list(formats.read_views(formats.write_views(views))) == views
    (tmp_path / "cameras.bin").write_bytes(raw)
    formats.register(spark)
    assert spark.read.format("sfm_cameras").load(str(tmp_path)).count() == 2


def test_streams_equal_batches(spark, tmp_path):
    rows = [("t1", "NEW", "", None, None, 1), ("t1", "RUN", "fuse", None, None, 2), ("t2", "NEW", "up", None, None, 1), ("t1", "SUCCESS", "", "r", None, 3)]
    frame = spark.createDataFrame(rows, tasks.TASK)
    want = {r["task_id"]: tuple(r) for r in tasks.task_table(frame).collect()}
    for k in range(2):
        spark.createDataFrame(rows[2 * k : 2 * k + 2], tasks.TASK).coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
    stream = tasks.task_stream(spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    run = stream.writeStream.outputMode("update").format("memory").queryName("task_out").trigger(availableNow=True).start()
    run.awaitTermination()
    got: dict = {}
    for r in spark.table("task_out").orderBy("seq").collect():
        got[r["task_id"]] = tuple(r)
    assert got == want and got["t1"][1:3] == ("SUCCESS", "fuse")


def test_pool_stream(spark, tmp_path):
    schema = "scene string, seq long, view_id string, reliability double, members array<long>, has_pose boolean"
    rows = [("s", 1, "a", 1.0, [1, 2, 3], True), ("s", 2, "b", 1.0, [2, 3, 4], True), ("s", 3, "c", 1.0, [2, 3, 4, 5], True), ("s", 4, "d", 1.0, [99], True), ("s", 5, "e", 1.0, [2, 3], False)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = tasks.pool_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    run = stream.writeStream.outputMode("append").format("memory").queryName("pool_out").trigger(availableNow=True).start()
    run.awaitTermination()
    assert [(r["accepted"], r["size"]) for r in spark.table("pool_out").orderBy("seq").collect()] == [(True, 1), (True, 2), (True, 3), (False, 3), (False, 3)]


def test_nearest_within_of_odd_vectors_in_blocks(spark):
    # as SQL's list_zip and list_sum: null components count for nothing, pairs that share none come last, NaN first
    rng = np.random.default_rng(11)
    rows = [(k % 3, k, rng.integers(-2, 3, 4).astype(float).tolist()) for k in range(240)]
    rows += [(0, 300 + k, [1.0, 1.0, 0.0, -0.0]) for k in range(40)]  # copies
    rows += [(0, 400, None), (0, 401, []), (1, 402, [None, 1.0, None, 2.0]), (1, 403, [1.0, 2.0]), (1, 404, [float("nan"), 0.0, 0.0, 0.0]), (2, 405, [float("inf"), 1.0, 0.0, 0.0]), (7, 406, [1.0] * 4), (None, 407, [1.0] * 4)]
    df = spark.createDataFrame(rows, "g int, id long, v array<double>")

    def score(a, b):
        both = [x * y for x, y in zip(a or [], b or [], strict=False) if x is not None and y is not None]
        return sum(both) if both else None

    def order(item):
        s = item[0]
        return (2, 0.0, item[1]) if s is None else (0, 0.0, item[1]) if np.isnan(s) else (1, -s, item[1])

    want = set()
    for g, i, v in rows:
        ranked = sorted(((score(v, w), j) for h, j, w in rows if g is not None and h == g and j != i), key=order)
        want |= {(i, j, n) for n, (_, j) in enumerate(ranked[:5], 1)}
    for block in (16_384, 30):
        got = {(r["left_id"], r["right_id"], r["rank"]) for r in vectors.nearest_within(df, ["g"], "id", "v", 5, block).collect()}
        assert got == want
    # many vectors, of which products by matrix choose
    many = spark.createDataFrame([(0, k, rng.normal(size=8).tolist()) for k in range(700)], "g int, id long, v array<float>")
    v = np.array([r["v"] for r in many.orderBy("id").collect()])
    worth = v @ v.T
    np.fill_diagonal(worth, -np.inf)
    got = vectors.nearest_within(many, ["g"], "id", "v", 3, 250).orderBy("left_id", "rank").collect()
    assert [r["right_id"] for r in got] == np.argsort(-worth, axis=1)[:, :3].ravel().tolist()


def test_assignment_on_a_line_is_optimal(spark):
    rng = np.random.default_rng(5)
    for n, m, spread in ((30, 30, 1.0), (40, 25, 0.3), (25, 60, 3.0), (1, 9, 1.0), (0, 4, 1.0), (50, 50, 0.0)):
        a, b = rng.normal(size=n) * spread, rng.normal(size=m) * spread + 0.1
        if spread == 0.3:
            a, b = np.round(a, 1), np.round(b, 1)
        worth = np.maximum(0.0, 1 - np.abs(a[:, None] - b[None]) * 5)
        got = selection.assign_on_line(a, b, 5.0, band=1, block=7)
        assert len({i for i, _ in got}) == len({j for _, j in got}) == len(got)
        assert sum(worth[i, j] for i, j in got) == pytest.approx(sum(worth[i, j] for i, j in selection.assign(worth)) if n else 0.0, abs=1e-9)
    # all truths before all found ones: as many wait as there are
    assert len(selection.assign_on_line(np.zeros(300), np.full(300, 0.01), 5.0)) == 300
    # 8,000 in one scene, of which pairs would be 16 million rows
    line = spark.range(8000).selectExpr("1 as scene", "id", "if(id = 9, null, id * 0.001) as x").unionByName(spark.sql("select 2 as scene, 2L as id, 0.5 as x"))
    got = selection.matched_on_line(line, "scene", "x", F.col("id") % 2 == 0, 5.0).collect()
    assert [(r["scene"], r["matches"]) for r in got] == [(1, 3999)] and got[0]["miou"] == pytest.approx(0.995, abs=1e-4)


def test_novelty_where_an_element_is_in_many_sets(spark):
    rng = np.random.default_rng(6)
    sets = {f"s{k}": sorted({0, *rng.integers(1, 40, rng.integers(0, 6)).tolist()}) for k in range(150)} | {"none": [], "alone": [99]}
    df = spark.createDataFrame([*sets.items(), (None, [0])], "id string, m array<int>")
    got = selection.novelty(df, df, "id", "m", 20)
    # elements' sets go in arrays: no join or grouping by pairs of sets
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Aggregate [id#" in line and "pid#" in line]
    rows = {r["id"]: (r["connected"], r["novelty"]) for r in got.collect()}
    for name, own in sets.items():
        ious = [selection.iou(set(own), set(m)) for other, m in sets.items() if other != name]
        assert rows[name] == (sum(x >= 0.2 for x in ious), pytest.approx(1 - max(ious)))
    assert rows[None] == (0, 1.0)


def test_views_of_a_scene_are_chosen_by_many_tasks(spark):
    rng = np.random.default_rng(8)
    rows = [(k % 3, k, float(np.round(rng.random(), 1)), rng.integers(0, 12, rng.integers(0, 8)).tolist()) for k in range(90)] + [(9, 1, 0.5, [])]
    df = spark.createDataFrame(rows, "s int, v long, r double, m array<int>")
    got = selection.select_views(df, "s", "v", "r", "m", 6)
    assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().optimizedPlan().toString()
    found = {}
    for r in got.orderBy("scene", "position").collect():
        found.setdefault(r["scene"], []).append(r["view_id"])
    assert found == {s: selection.greedy_pool([(v, r, set(m)) for t, v, r, m in rows if t == s], 6) for s in (0, 1, 2, 9)}
    assert selection.select_views(df.limit(0), "s", "v", "r", "m", 6).count() == 0
