"""Queries of scene operators: neighbours, clusters, quantiles, visibility, surfaces and runs of masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfield.operators import clustering, neighbours, runs, surface, temporal, trajectory, visibility
from lumenfield.plans.queries import _NEAR, _POINT, EVENTS, _points, events, query, r6, table
from lumenfield.plans.scratch import materialize

AXES = ["x", "y", "z"]


@query(
    "core_distances",
    f"""SELECT id, round(d, 6) AS core FROM (SELECT a.vec_id AS id, {_NEAR} AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_NEAR}) AS r
    FROM {_POINT} a CROSS JOIN {_POINT} b) WHERE r = 5""",
)
def core_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distance within which each point has five points, itself included."""
    return neighbours.reach(_points(spark, sf_dir), "vec_id", AXES, 5).select("id", r6("reach").alias("core"))


@query(
    "nearest_any",
    f"""SELECT left_id, right_id, round(d, 6) AS distance, r AS rank FROM (SELECT a.vec_id AS left_id, b.vec_id AS right_id, {_NEAR} AS d,
    row_number() OVER (PARTITION BY a.vec_id ORDER BY {_NEAR}, b.vec_id) AS r FROM {_POINT} a JOIN {_POINT} b ON a.label % 2 = 0 AND b.label % 2 = 1) WHERE r <= 3""",
)
def nearest_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three nearest points of odd labels of each point of an even one, however far."""
    p = _points(spark, sf_dir)
    out = neighbours.nearest(p.filter("label % 2 = 0"), p.filter("label % 2 = 1"), AXES, "vec_id", "vec_id", 3)
    return out.select("left_id", "right_id", r6("distance").alias("distance"), "rank")


@query("hdbscan_objects")
def hdbscan_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, cluster by density and the cluster where those without one take their nearest point's; tests/test_clustering.py has all pairs."""
    p = _points(spark, sf_dir).drop("label")
    found = materialize(p.join(clustering.hdbscan(p, "vec_id", AXES, samples=3, size=5), "vec_id"), "clustered")
    full = clustering.fill(found, "vec_id", AXES).select("vec_id", F.col("label").alias("filled"))
    return found.select("vec_id", "label").join(full, "vec_id")


def _cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A camera for each nation, turned about the vertical."""
    a = F.col("n_nationkey") * 0.251 + 0.1
    zero, one = F.lit(0.0), F.lit(1.0)
    w2c = F.array(F.cos(a), zero, F.sin(a), F.lit(0.05), zero, one, zero, F.lit(-0.02), -F.sin(a), zero, F.cos(a), F.lit(0.31), zero, zero, zero, one)
    return table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("view"), w2c.alias("w2c"), *[F.lit(x).alias(n) for n, x in (("fx", 40.3), ("fy", 40.7), ("cx", 32.1), ("cy", 23.9), ("width", 64), ("height", 48))]
    )


_CAMERAS = "(SELECT n_nationkey AS view, cos(n_nationkey * 0.251 + 0.1) AS c, sin(n_nationkey * 0.251 + 0.1) AS s FROM nation)"


@query(
    "visible_faces",
    f"""WITH p AS (SELECT view, vec_id, c * x + s * z + 0.05 AS px, y - 0.02 AS py, c * z - s * x + 0.31 AS pz FROM {_POINT}, {_CAMERAS})
    SELECT view, vec_id FROM p WHERE pz > 0 AND (40.3 * px + 32.1 * pz) / pz >= 0 AND (40.3 * px + 32.1 * pz) / pz < 64
    AND (40.7 * py + 23.9 * pz) / pz >= 0 AND (40.7 * py + 23.9 * pz) / pz < 48""",
)
def visible_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points that each camera sees."""
    return visibility.visible(_points(spark, sf_dir), _cameras(spark, sf_dir), "vec_id", "view", AXES).select("view", "vec_id")


_PIXELS = """(SELECT l_linenumber AS frame, (l_partkey * 7 + l_orderkey) % 24 AS u, (l_suppkey * 5 + l_orderkey) % 18 AS v, sum(l_quantity) / count(*) / 20.0 AS depth
    FROM lineitem GROUP BY ALL)"""


@query(
    "depth_surface_voxels",
    f"""WITH px AS {_PIXELS},
    cam AS (SELECT frame, cos(frame * 0.317) AS c, sin(frame * 0.317) AS s FROM (SELECT DISTINCT frame FROM px)),
    ray AS (SELECT frame, (u - 12.03) / 21.7 AS rx, (v - 9.01) / 22.3 AS ry, greatest(depth + (i - 1) * 0.3, 0.0) AS z FROM px, range(3) AS steps(i)),
    p AS (SELECT frame, rx * z - 0.013 AS x, ry * z - 0.017 AS y, z - 0.019 AS z FROM ray),
    blocks AS (SELECT DISTINCT frame, floor((c * x - s * z) / 0.8)::BIGINT AS bx, floor(y / 0.8)::BIGINT AS by_, floor((s * x + c * z) / 0.8)::BIGINT AS bz FROM p JOIN cam USING (frame)),
    vox AS (SELECT frame, bx * 4 + i AS vx, by_ * 4 + j AS vy, bz * 4 + k AS vz FROM blocks, range(4) AS a(i), range(4) AS b(j), range(4) AS d(k)),
    at AS (SELECT frame, vx, vy, vz, c * (vx * 0.2) + s * (vz * 0.2) + 0.013 AS x, vy * 0.2 + 0.017 AS y, c * (vz * 0.2) - s * (vx * 0.2) + 0.019 AS z FROM vox JOIN cam USING (frame)),
    uv AS (SELECT *, 21.7 * x / z + 12.03 AS u, 22.3 * y / z + 9.01 AS v FROM at WHERE z > 0),
    seen AS (SELECT uv.vx, uv.vy, uv.vz, px.depth - uv.z AS d FROM uv JOIN px ON px.frame = uv.frame AND px.u = floor(uv.u) AND px.v = floor(uv.v) WHERE uv.u >= 0 AND uv.v >= 0 AND uv.u <= 23 AND uv.v <= 17)
    SELECT vx, vy, vz, round(avg(least(d / 0.3, 1.0)), 6) AS tsdf, count(*)::DOUBLE AS weight FROM seen WHERE d >= -0.3 GROUP BY ALL HAVING count(*) >= 2""".replace("at AS", "placed AS").replace("FROM at ", "FROM placed "),
)
def depth_surface_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voxels of which at least two depth frames give a distance: a frame a line number, its pixels' depths from quantities."""
    u, v = (F.col("l_partkey") * 7 + F.col("l_orderkey")) % 24, (F.col("l_suppkey") * 5 + F.col("l_orderkey")) % 18
    item = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("frame"), u.alias("u"), v.alias("v"), "l_quantity")
    pixels = item.groupBy("frame", "u", "v").agg((F.sum("l_quantity") / F.count(F.lit(1)) / 20.0).alias("depth"))
    a = F.col("frame") * 0.317
    zero, one = F.lit(0.0), F.lit(1.0)
    w2c = F.array(F.cos(a), zero, F.sin(a), F.lit(0.013), zero, one, zero, F.lit(0.017), -F.sin(a), zero, F.cos(a), F.lit(0.019), zero, zero, zero, one)
    size = [F.lit(x).alias(n) for n, x in (("fx", 21.7), ("fy", 22.3), ("cx", 12.03), ("cy", 9.01), ("width", 24), ("height", 18))]
    cameras = pixels.select("frame").distinct().select("frame", w2c.alias("w2c"), *size)
    out = surface.integrate(pixels, cameras, "frame", 0.2, 0.3, least=2.0, block=4)
    return out.select("vx", "vy", "vz", r6("tsdf").alias("tsdf"), "weight")


_ORDERED = "(SELECT user_id, event_id, t, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS n FROM " + EVENTS + ")"


@query(
    "decimate_accumulating",
    f"""WITH RECURSIVE e AS {_ORDERED},
    s AS (SELECT user_id, n, event_id, t AS next_, true AS taken FROM e WHERE n = 1
      UNION ALL
      SELECT e.user_id, e.n, e.event_id, CASE WHEN s.taken THEN s.next_ + 259200000000 ELSE s.next_ END AS next_,
             e.t >= CASE WHEN s.taken THEN s.next_ + 259200000000 ELSE s.next_ END AS taken
      FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1)
    SELECT event_id FROM s WHERE taken""",
)
def decimate_accumulating(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each user at or after a mark that moves on by three days for each one taken."""
    return temporal.decimate_accumulating(events(spark, sf_dir), "user_id", "t", 259_200_000_000, ["event_id"]).select("event_id")


_MASK = "(SELECT DISTINCT l_linenumber AS mask, l_partkey % 97 AS x, (l_orderkey + l_suppkey) % 89 AS y FROM lineitem WHERE l_quantity > 45)"


def _mask_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks of the items of large quantities, one for each line number."""
    item = table(spark, sf_dir, "lineitem").filter("l_quantity > 45")
    pixels = item.select(F.col("l_linenumber").cast("long").alias("mask"), (F.col("l_partkey") % 97).alias("x"), ((F.col("l_orderkey") + F.col("l_suppkey")) % 89).alias("y"))
    return runs.from_pixels(pixels, "mask", "x", "y")


@query(
    "mask_components",
    f"""WITH RECURSIVE p AS {_MASK},
    reach AS (SELECT mask, x, y, x AS x0, y AS y0 FROM p
      UNION
      SELECT p.mask, p.x, p.y, r.x0, r.y0 FROM reach r JOIN p ON p.mask = r.mask AND abs(p.x - r.x) <= 1 AND abs(p.y - r.y) <= 1),
    c AS (SELECT mask, x0, y0, count(*) AS area FROM reach GROUP BY ALL)
    SELECT mask, area, (count(*) // area)::BIGINT AS parts FROM c GROUP BY mask, area""",
)
def mask_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many components of each area each mask has."""
    parts = runs.components(_mask_runs(spark, sf_dir)).select("mask", "component", "area").distinct()
    return parts.groupBy("mask", "area").agg(F.count(F.lit(1)).alias("parts"))


@query(
    "mask_pair_iou",
    f"""WITH b AS (SELECT user_id, value >= 50 AS p, value >= 20 AND value < 70 AS q FROM {EVENTS})
    SELECT user_id, round(coalesce(count(*) FILTER (WHERE p AND q) / nullif(count(*) FILTER (WHERE p OR q), 0), 0), 6) AS iou FROM b GROUP BY user_id""",
)
def mask_pair_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of two masks of each user's events, written as lengths of runs, by way of their compact text."""
    rows = events(spark, sf_dir)
    sides = []
    for name, bit in (("p", F.col("value") >= 50), ("q", (F.col("value") >= 20) & (F.col("value") < 70))):
        own = temporal.run_lengths(rows.withColumn("bit", bit.cast("int")), "user_id", ["t", "event_id"], "bit")
        counts = own.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("run", "bit", F.col("length").cast("long").alias("length")))).alias("r"))
        start = F.when(F.col("r")[0]["bit"] == 1, F.array(F.lit(0).cast("long"))).otherwise(F.array().cast("array<bigint>"))
        sides.append(counts.select("user_id", runs.to_text(F.concat(start, F.col("r.length"))).alias(name)))
    both = sides[0].join(sides[1], "user_id")
    return both.select("user_id", r6(runs.iou(runs.from_text(F.col("p")), runs.from_text(F.col("q")))).alias("iou"))


@query(
    "relative_pose_errors",
    """WITH p AS (SELECT l_suppkey AS k, l_orderkey, l_linenumber, l_tax * 9.0 AS a, l_discount * 8.0 AS b, l_quantity / 10.0 AS x, l_extendedprice / 20000.0 AS y FROM lineitem),
    d AS (SELECT k, a - lag(a) OVER w AS da, b - lag(b) OVER w AS db, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy, lag(a) OVER w AS a0, lag(b) OVER w AS b0
      FROM p WINDOW w AS (PARTITION BY k ORDER BY l_orderkey, l_linenumber, x, y)),
    e AS (SELECT k, CASE WHEN da IS NOT NULL THEN degrees(acos(least(greatest(cos(db - da), -1), 1))) END AS turn, cos(a0) * dx AS tx, -sin(a0) * dx AS ty, cos(b0) * dy AS fx, -sin(b0) * dy AS fy FROM d)
    SELECT k, round(sqrt(avg(turn * turn)), 4) AS rpe_rotation, round(sqrt(avg((fx - tx) ** 2 + (fy - ty) ** 2)), 4) AS rpe_translation, count(turn) AS n FROM e GROUP BY k""",
)
def relative_pose_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of motions from item to item of each supplier: cameras turned about the vertical and moved along x."""
    item = table(spark, sf_dir, "lineitem")

    def pose(angle: Column, x: Column) -> Column:
        zero, one = F.lit(0.0), F.lit(1.0)
        return F.array(F.cos(angle), -F.sin(angle), zero, x, F.sin(angle), F.cos(angle), zero, zero, zero, zero, one, zero, zero, zero, zero, one)

    x, y = (F.col("l_quantity") / 10.0).cast("double"), (F.col("l_extendedprice") / 20000.0).cast("double")
    rows = item.select(F.col("l_suppkey").alias("k"), "l_orderkey", "l_linenumber", x.alias("x"), y.alias("y"), (F.col("l_tax").cast("double") * 9.0).alias("a"), (F.col("l_discount").cast("double") * 8.0).alias("b"))
    out = trajectory.relative_pose_errors(rows, "k", ["l_orderkey", "l_linenumber", "x", "y"], pose(F.col("a"), F.col("x")), pose(F.col("b"), F.col("y")))
    return out.select("k", F.round("rpe_rotation", 4).alias("rpe_rotation"), F.round("rpe_translation", 4).alias("rpe_translation"), "n")
