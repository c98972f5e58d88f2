"""Predicates, trajectories, reductions and frame functions applied to the benchmark tables, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfield.functions import frames
from lumenfield.operators import predicates, reductions, trajectory
from lumenfield.plans.queries import EVENTS, _POINT, _points, events, query, r6, table

COLOURS = "(SELECT event_id, event_id % 256 AS r, user_id % 256 AS g, floor(value)::BIGINT % 256 AS b FROM events)"


@query("dark_frames", "SELECT event_type, count(*) FILTER (WHERE coalesce(value < 10, false)) AS dark FROM events GROUP BY event_type")
def dark_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(predicates.dark("value")).alias("dark"))


@query("foreground_points", f"SELECT event_id FROM {COLOURS} WHERE r + g + b >= 16 AND NOT (r > 240 AND g > 240 AND b > 240)")
def foreground_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 256).alias("r"), (F.col("user_id") % 256).alias("g"), (F.floor("value") % 256).alias("b"))
    return rows.filter(predicates.foreground("r", "g", "b")).select("event_id")


@query(
    "frame_choice",
    """SELECT vec_id FROM (SELECT vec_id, label, CASE WHEN vec_id % 2 = 0 THEN (vec_id % 7)::VARCHAR || ': frame' ELSE 'All' END AS choice FROM embeddings)
    WHERE coalesce(label = TRY_CAST(split_part(choice, ':', 1) AS BIGINT), true)""",
)
def frame_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    choice = F.when(F.col("vec_id") % 2 == 0, F.concat((F.col("vec_id") % 7).cast("string"), F.lit(": frame"))).otherwise("All")
    return table(spark, sf_dir, "embeddings").withColumn("choice", choice).filter(predicates.chosen_frame("label", "choice")).select("vec_id")


@query("sky_masked", "SELECT event_type, round(sum(value * (user_id % 10 / 10.0 > 0.1)::INT), 4) AS kept FROM events GROUP BY event_type")
def sky_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("sky", F.col("user_id") % 10 / 10.0)
    return rows.groupBy("event_type").agg(F.round(F.sum(predicates.masked_confidence("value", "sky")), 4).alias("kept"))


@query("good_masks", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount > 0.05 AND l_tax >= 0.04")
def good_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predicates.good_masks(table(spark, sf_dir, "lineitem"), "l_discount", "l_tax", 0.05, 0.04).select("l_orderkey", "l_linenumber")


@query("kept_columns", "SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def kept_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return predicates.keep_rows(table(spark, sf_dir, "customer"), keep, "c_custkey").select("c_custkey", "c_nationkey")


@query("class_masks", "SELECT event_id, (user_id % 5 = event_id % 4 + 1)::INT AS mask, floor(value / 255)::INT AS boundary FROM events")
def class_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return rows.select("event_id", predicates.binarised(F.col("user_id") % 5, F.col("event_id") % 4).alias("mask"), predicates.boundary("value").alias("boundary"))


@query("no_crowds", "SELECT vec_id FROM embeddings WHERE coalesce(CASE WHEN label % 3 = 0 THEN NULL ELSE label % 2 END, 0) = 0")
def no_crowds(spark: SparkSession, sf_dir: str) -> DataFrame:
    crowd = F.when(F.col("label") % 3 != 0, F.col("label") % 2)
    return table(spark, sf_dir, "embeddings").filter(predicates.not_crowd(crowd)).select("vec_id")


@query(
    "empty_fallback",
    """SELECT e.event_id, CASE WHEN e.value > 50 THEN e.value ELSE f.value END AS value FROM events e,
    (SELECT value FROM events WHERE value > 50 ORDER BY event_id LIMIT 1) f""",
)
def empty_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "value")
    return predicates.or_first(rows, F.col("value") > 50, ["event_id"], ["value"])


@query(
    "safe_assets",
    """SELECT page_id, NOT starts_with(u, '/') AND NOT contains(u, '..') AND lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) IN ('', 'https') AS safe FROM
    (SELECT page_id, CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN 'file:' || url WHEN 2 THEN '../a' WHEN 3 THEN '/abs' ELSE 'models/a.glb' END AS u FROM pages)""",
)
def safe_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id") % 5
    u = F.when(n == 0, F.col("url")).when(n == 1, F.concat(F.lit("file:"), "url")).when(n == 2, "../a").when(n == 3, "/abs").otherwise("models/a.glb")
    return table(spark, sf_dir, "pages").select("page_id", predicates.safe_asset(u).alias("safe"))


@query("pose_gate", "SELECT event_id, CASE WHEN value / 1000 > 0.05 THEN 'rms' WHEN user_id % 10 / 10.0 < 0.5 THEN 'confidence' END AS reason FROM events")
def pose_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", predicates.rejection(F.col("value") / 1000, F.col("user_id") % 10 / 10.0).alias("reason"))


@query("invalid_zeros", "SELECT event_type, round(sum(CASE WHEN value > 20 THEN value ELSE 0 END), 4) AS total, count(*) FILTER (WHERE NOT value > 20) AS invalid FROM events GROUP BY event_type")
def invalid_zeros(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = F.col("value") > 20
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.sum(predicates.invalid_as("value", ok, 0.0)), 4).alias("total"), F.count_if(~ok).alias("invalid"))


# trajectories


@query(
    "frame_pairs",
    """SELECT a.l_orderkey, a.l_linenumber AS l_linenumber_a, b.l_linenumber AS l_linenumber_b, round(abs(a.l_quantity - b.l_quantity), 6) AS error
    FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber""",
)
def frame_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = trajectory.frame_pairs(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", ["l_quantity"])
    return pairs.select("l_orderkey", "l_linenumber_a", "l_linenumber_b", r6(F.abs(F.col("l_quantity_a") - F.col("l_quantity_b"))).alias("error"))


@query(
    "pair_accuracy",
    """SELECT a.l_returnflag, round(avg((abs(a.l_quantity - b.l_quantity) < 5)::INT), 6) AS under_5, round(avg((abs(a.l_quantity - b.l_quantity) < 2)::INT), 6) AS under_2
    FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber GROUP BY 1""",
)
def pair_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = trajectory.frame_pairs(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", ["l_quantity", "l_returnflag"])
    out = trajectory.accuracy_within(pairs.withColumnRenamed("l_returnflag_a", "l_returnflag"), ["l_returnflag"], F.abs(F.col("l_quantity_a") - F.col("l_quantity_b")))
    return out.select("l_returnflag", r6("under_5").alias("under_5"), r6("under_2").alias("under_2"))


@query(
    "associated_tracks",
    f"""WITH e AS {EVENTS}, l AS (SELECT * FROM e WHERE event_type = 'click'), r AS (SELECT user_id, t, min(event_id) AS event_id FROM e WHERE event_type = 'view' GROUP BY 1, 2)
    SELECT event_id, gap FROM (SELECT l.event_id, abs(l.t - r.t) AS gap, row_number() OVER (PARTITION BY l.event_id ORDER BY abs(l.t - r.t), r.t) AS n
    FROM l JOIN r ON l.user_id = r.user_id) WHERE n = 1 AND gap <= 3600000000""",
)
def associated_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    got = trajectory.associate(rows.filter("event_type = 'click'"), rows.filter("event_type = 'view'"), "user_id", "t", ["event_id"], 3_600_000_000)
    return got.select("event_id", F.abs(F.col("t") - F.col("matched_ts")).alias("gap"))


@query(
    "trajectory_rpe",
    """WITH e AS (SELECT l_suppkey AS k, l_orderkey, l_linenumber, l_tax - l_discount AS x, l_quantity / 50 - l_extendedprice / 100000 AS y FROM lineitem),
    d AS (SELECT *, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy FROM e WINDOW w AS (PARTITION BY k ORDER BY l_orderkey, l_linenumber, x, y))
    SELECT k, round(sqrt(avg(x * x + y * y)), 6) AS ate, round(sqrt(coalesce(avg(dx * dx + dy * dy), 0)), 6) AS rpe FROM d GROUP BY k""",
)
def trajectory_rpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    zero = F.lit(0.0)
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("k"), "l_orderkey", "l_linenumber", F.col("l_tax").cast("double").alias("px"), (F.col("l_quantity") / 50).cast("double").alias("py"), zero.alias("pz"),
        F.col("l_discount").cast("double").alias("gx"), (F.col("l_extendedprice") / 100000).cast("double").alias("gy"), zero.alias("gz"),
    )
    rows = rows.withColumn("ex_", F.col("px") - F.col("gx")).withColumn("ey_", F.col("py") - F.col("gy"))
    out = trajectory.trajectory_errors(rows, "k", ["l_orderkey", "l_linenumber", "ex_", "ey_"], align=False)
    return out.select("k", r6("ate").alias("ate"), r6("rpe").alias("rpe"))


@query("aligned_trajectories")
def aligned_trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _points(spark, sf_dir)
    rows = p.select("label", "vec_id", *[F.col(a).alias(f"g{a}") for a in "xyz"], *[(F.col(a) * 2 + 1 + F.col("vec_id") % 7 / 1000).alias(f"p{a}") for a in "xyz"])
    return trajectory.trajectory_errors(rows, "label", ["vec_id"])


@query("mean_of_sequences", "SELECT round(coalesce(avg(value), 0), 6) AS value, round(coalesce(avg(user_id), 0), 6) AS user_id FROM events")
def mean_of_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trajectory.mean_of_sequences(table(spark, sf_dir, "events"), ["value", "user_id"]).select(r6("value").alias("value"), r6("user_id").alias("user_id"))


@query(
    "camera_distance",
    """SELECT a.l_orderkey, round(median(sqrt((a.l_quantity - b.l_quantity) ** 2 + (a.l_tax - b.l_tax) ** 2)), 6) AS distance
    FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber GROUP BY 1""",
)
def camera_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = trajectory.median_camera_distance(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", ["l_quantity", "l_tax"])
    return out.withColumn("distance", r6("distance"))


@query(
    "clamped_targets",
    f"""WITH e AS {EVENTS}, m AS (SELECT user_id, max(t) AS stop FROM e WHERE event_type = 'view' GROUP BY 1)
    SELECT event_id, greatest(e.t - 1000000000, 0) AS t FROM e JOIN m ON e.user_id = m.user_id WHERE e.t - 1000000000 <= m.stop""",
)
def clamped_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    ends = rows.filter("event_type = 'view'").groupBy("user_id").agg(F.max("t").alias("end"))
    return trajectory.clamp_times(rows.withColumn("t", F.col("t") - 1_000_000_000), ends, "user_id", "t")[0].select("event_id", "t")


@query(
    "uncovered_frames",
    f"""WITH e AS {EVENTS}, s AS (SELECT user_id, min(t) AS lo, max(t) AS hi FROM e WHERE event_type = 'view' GROUP BY 1)
    SELECT event_id FROM e LEFT JOIN s ON e.user_id = s.user_id WHERE lo IS NULL OR NOT t BETWEEN lo AND hi""",
)
def uncovered_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    return trajectory.uncovered(rows, rows.filter("event_type = 'view'"), "user_id", "t").select("event_id")


@query(
    "joined_views",
    """SELECT o_orderkey AS stem, c_nationkey, n, coalesce(r, 0.0) AS reliability FROM orders JOIN customer ON o_custkey = c_custkey
    JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey
    LEFT JOIN (SELECT l_orderkey AS k, round(max(l_discount)::DOUBLE, 6) AS r FROM lineitem WHERE l_tax > 0.05 GROUP BY 1) ON o_orderkey = k""",
)
def joined_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer, items = (table(spark, sf_dir, n) for n in ("orders", "customer", "lineitem"))
    images = orders.select(F.col("o_orderkey").alias("stem"), "o_custkey")
    records = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("stem"), "c_nationkey")
    poses = items.groupBy(F.col("l_orderkey").alias("stem")).agg(F.count(F.lit(1)).alias("n"))
    sure = items.filter("l_tax > 0.05").groupBy(F.col("l_orderkey").alias("stem")).agg(r6(F.max("l_discount").cast("double")).alias("reliability"))
    return trajectory.views(images, records, poses, sure, "stem").select("stem", "c_nationkey", "n", "reliability")


# reductions


@query(
    "multi_class_iou",
    """WITH p AS (SELECT l_suppkey % 50 AS img, l_linenumber % 3 AS pred, (l_linenumber + l_quantity::INT) % 3 AS gt FROM lineitem),
    c AS (SELECT img, x.c, x.pred = x.c AND x.gt = x.c AS i FROM (SELECT img, pred, gt, unnest([{'c': pred, 'pred': pred, 'gt': gt}]) AS x FROM p)),
    g AS (SELECT img, k AS class_id FROM (SELECT DISTINCT img FROM p), (SELECT unnest([0, 1, 2]) AS k)),
    n AS (SELECT g.img, class_id, count(*) FILTER (WHERE pred = class_id AND gt = class_id) AS i, count(*) FILTER (WHERE pred = class_id OR gt = class_id) AS u FROM g JOIN p ON g.img = p.img GROUP BY 1, 2)
    SELECT class_id, round(avg(v), 6) AS iou FROM (SELECT class_id, sum(i) OVER w / greatest(sum(u) OVER w, 1) AS v FROM n WINDOW w AS (PARTITION BY class_id ORDER BY img ROWS UNBOUNDED PRECEDING)) GROUP BY 1""",
)
def multi_class_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 50).alias("img"), (F.col("l_linenumber") % 3).cast("int").alias("pred"), ((F.col("l_linenumber") + F.round("l_quantity").cast("int")) % 3).cast("int").alias("gt")
    )
    return reductions.cumulative_class_iou(rows, "img", "pred", "gt", 3).withColumn("iou", r6("iou"))


@query("pixel_accuracy", "SELECT l_returnflag, round(avg((l_linenumber % 3 = l_suppkey % 3)::INT), 6) AS accuracy, count(*) AS pixels FROM lineitem GROUP BY 1")
def pixel_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("p", F.col("l_linenumber") % 3).withColumn("g", F.col("l_suppkey") % 3)
    return reductions.pixel_accuracy(rows, ["l_returnflag"], "p", "g").withColumn("accuracy", r6("accuracy"))


@query(
    "average_meter",
    """SELECT event_id, round(sum(value) OVER w, 4) AS "sum", count(value) OVER w AS "count", round(avg(value) OVER w, 6) AS "avg" FROM events
    WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)""",
)
def average_meter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reductions.average_meter(table(spark, sf_dir, "events"), "user_id", ["event_id"], "value")
    return out.select("event_id", F.round("sum", 4).alias("sum"), "count", r6("avg").alias("avg"))


@query("merged_meters", "SELECT event_type, round(sum(value), 4) AS total, count(value) AS n, round(sum(value) / greatest(count(value), 1), 6) AS global_avg FROM events GROUP BY 1")
def merged_meters(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "events").groupBy("event_type", (F.col("event_id") % 8).alias("worker")).agg(F.sum("value").alias("s"), F.count("value").alias("c"))
    return reductions.merge_meters(parts, ["event_type"], "s", "c").select("event_type", F.round("total", 4).alias("total"), "n", r6("global_avg").alias("global_avg"))


@query("masked_median", "SELECT event_type, round(median(value) FILTER (WHERE user_id % 3 = 0), 6) AS median FROM events GROUP BY 1")
def masked_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reductions.masked_median(table(spark, sf_dir, "events"), ["event_type"], "value", F.col("user_id") % 3 == 0).withColumn("median", r6("median"))


@query("joint_quantile", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS depth FROM events WHERE value > 10 GROUP BY 1")
def joint_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    parts = [rows.filter(F.col("event_id") % 2 == k) for k in (0, 1)]
    return reductions.joint_quantile(parts, ["event_type"], "value", F.col("value") > 10).withColumn("depth", r6("depth"))


@query(
    "mean_distance_scale",
    f"SELECT label, round(least(greatest(sum(sqrt(x * x + y * y + z * z) * (vec_id % 2)) / (sum(vec_id % 2) + 1e-3), 1e-3), 1e3), 6) AS scale FROM {_POINT} GROUP BY 1",
)
def mean_distance_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reductions.mean_distance_scale(_points(spark, sf_dir), ["label"], F.col("vec_id") % 2 == 1).withColumn("scale", r6("scale"))


@query(
    "masks_info",
    """SELECT o_custkey, count(*) AS frames, count(*) FILTER (WHERE n > 0) AS with_masks, sum(n)::BIGINT AS masks, array_to_string(list(n ORDER BY o_orderkey), ',') AS per_frame FROM
    (SELECT o_custkey, o_orderkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS n FROM orders) GROUP BY 1""",
)
def masks_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    masks = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    rows = table(spark, sf_dir, "orders").join(masks, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_custkey", "o_orderkey", F.coalesce("n", F.lit(0)).alias("n"))
    return reductions.masks_info(rows, ["o_custkey"], "o_orderkey", "n").withColumn("per_frame", F.array_join(F.col("per_frame").cast("array<string>"), ","))


@query(
    "cloud_info",
    f"SELECT label, count(*) AS points, round(min(x), 6) AS min_x, round(max(x), 6) AS max_x, round(min(y), 6) AS min_y, round(max(y), 6) AS max_y, round(min(z), 6) AS min_z, round(max(z), 6) AS max_z FROM {_POINT} GROUP BY 1",
)
def cloud_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reductions.cloud_info(_points(spark, sf_dir), ["label"])
    return out.select("label", "points", *[r6(f"{n}_{a}").alias(f"{n}_{a}") for a in "xyz" for n in ("min", "max")])


@query("tile_average", "SELECT user_id, event_type, round(sum(value) / count(value), 6) AS value FROM events GROUP BY 1, 2")
def tile_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reductions.tile_average(table(spark, sf_dir, "events"), ["user_id", "event_type"], "value").withColumn("value", r6("value"))


@query("class_members", "SELECT n_regionkey, array_to_string(list_sort(list(DISTINCT n_nationkey)), ',') AS members FROM nation GROUP BY 1")
def class_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reductions.members(table(spark, sf_dir, "nation"), "n_regionkey", "n_nationkey")
    return out.withColumn("members", F.array_join(F.col("members").cast("array<string>"), ","))


@query("by_directory", "SELECT split_part(url, '/', 3) AS directory, count(*) AS n FROM pages GROUP BY 1")
def by_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reductions.by_directory(table(spark, sf_dir, "pages"), "url", 3).groupBy("directory").agg(F.count("url").alias("n"))


@query("ranked_labels", "SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS rank FROM (SELECT DISTINCT event_type FROM events)")
def ranked_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reductions.ranked_labels(table(spark, sf_dir, "events"), "event_type")


@query("principal_colours")
def principal_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reductions.principal_colours(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding").select("vec_id", "colour")


@query(
    "spaced_neighbours",
    """SELECT user_id, event_id, r FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events) WHERE r <= 12 AND (r - 1) % 3 = 0""",
)
def spaced_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = reductions.top_n(table(spark, sf_dir, "events"), ["user_id"], "value", "event_id", 12).withColumnRenamed("rank", "r")
    return reductions.spaced_neighbours(ranked, "user_id", "r", 12, 4).select("user_id", "event_id", "r")


@query("fifo_pool", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 10")
def fifo_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reductions.last_n(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], 10).select("user_id", "event_id")


@query("fifo_mean", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS pool_mean FROM events")
def fifo_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reductions.fifo_mean(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value", 10).select("event_id", r6("pool_mean").alias("pool_mean"))


@query("anchor_rows", "SELECT l_suppkey, l_orderkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice, l_orderkey) AS r FROM lineitem) WHERE r = 1")
def anchor_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reductions.arg_least(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_orderkey", "l_extendedprice")


@query("best_class", "SELECT l_orderkey, l_linenumber, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber) AS r FROM lineitem) WHERE r = 1")
def best_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reductions.arg_most(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linenumber", "l_quantity")


@query("top_masks", "SELECT l_orderkey, l_linenumber, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS r FROM lineitem) WHERE r <= 3")
def top_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reductions.top_n(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_extendedprice", "l_linenumber", 3).select("l_orderkey", "l_linenumber", "rank")


@query("fetched_rows", "SELECT o_orderkey, c_custkey, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey")
def fetched_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return reductions.fetch(table(spark, sf_dir, "customer"), "c_custkey", wanted).select("o_orderkey", "c_custkey", "c_nationkey")


@query("side_by_side", "SELECT coalesce(c_custkey, s_suppkey) AS k, c_nationkey, s_nationkey FROM customer FULL JOIN supplier ON c_custkey = s_suppkey")
def side_by_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_nationkey")
    return reductions.side_by_side(left, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), "s_nationkey"), "k")


@query(
    "merged_records",
    """SELECT l_orderkey, array_to_string(list(l_partkey ORDER BY n), ',') AS parts, arg_min(l_linestatus, n) AS l_linestatus
    FROM (SELECT *, l_linenumber * 100000000 + l_partkey * 10 + (l_linestatus = 'F')::INT AS n FROM lineitem) GROUP BY 1""",
)
def merged_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber").cast("long") * 100000000 + F.col("l_partkey") * 10 + (F.col("l_linestatus") == "F").cast("int")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", n.alias("n"), F.array("l_partkey").alias("parts"), "l_linestatus")
    out = reductions.merge_records(rows, "l_orderkey", "n", ["parts"], ["l_linestatus"])
    return out.withColumn("parts", F.array_join(F.col("parts").cast("array<string>"), ","))


@query("sorted_union", "SELECT DISTINCT l_partkey AS value FROM lineitem")
def sorted_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("parts"))
    return reductions.sorted_union(lists, "parts")


@query("matching_tensors", "SELECT c_custkey AS name FROM customer WHERE (c_custkey, c_nationkey) IN (SELECT s_suppkey, s_nationkey FROM supplier)")
def matching_tensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("name"), F.col("c_nationkey").alias("shape"))
    model = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("name"), F.col("s_nationkey").alias("shape")).unionByName(own.filter("false"))
    return reductions.matching_tensors(model, own).select("name") if not own.join(model, ["name", "shape"], "left_semi").isEmpty() else own.filter("false").select("name")


@query("latest_version", "SELECT 'run/version_' || max(user_id) AS name, max(user_id) AS version FROM events")
def latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reductions.latest_version(table(spark, sf_dir, "events").select(F.concat(F.lit("run/version_"), F.col("user_id").cast("string")).alias("name")), "name")


@query("min_max", "SELECT event_id, round(coalesce((value - min(value) OVER w) / nullif(max(value) OVER w - min(value) OVER w, 0), 0), 6) AS value FROM events WINDOW w AS (PARTITION BY user_id)")
def min_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reductions.min_max(table(spark, sf_dir, "events").select("event_id", "user_id", "value"), ["user_id"], "value").select("event_id", r6("value").alias("value"))


@query("empty_metrics", "SELECT c_custkey, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def empty_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return reductions.with_empty_metrics(table(spark, sf_dir, "customer").select("c_custkey"), found, "c_custkey", ["n"])


@query("multiples", "SELECT event_id, event_id // 14 * 14 AS down, (event_id + 13) // 14 * 14 AS up FROM events")
def multiples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", reductions.multiple("event_id", 14).alias("down"), reductions.multiple("event_id", 14, up=True).alias("up"))


# columns


@query("ray_depths", "SELECT event_id, round(value / sqrt(((user_id % 64 - 32) / 50.0) ** 2 + ((event_id % 48 - 24) / 40.0) ** 2 + 1), 6) AS depth FROM events")
def ray_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.array(*map(F.lit, (50.0, 0.0, 32.0, 0.0, 40.0, 24.0, 0.0, 0.0, 1.0)))
    return table(spark, sf_dir, "events").select("event_id", r6(frames.ray_to_depth(F.col("value"), F.col("user_id") % 64, F.col("event_id") % 48, k)).alias("depth"))


@query(
    "image_boxes",
    """SELECT vec_id, round((x + 5 + x + 7) / 2, 6) AS cx, round((2 * y + 13) / 2, 6) AS cy, round((x + 5) / 640, 6) AS nx, round(10 + x + 5, 6) AS ux, round(20 + y + 6, 6) AS uy
    FROM """ + _POINT,
)
def image_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = F.array(F.col("x") + 5, F.col("y") + 6, F.col("x") + 7, F.col("y") + 7)
    rows = _points(spark, sf_dir).select("vec_id", box.alias("b"))
    centre, inside, out = frames.centre_size(F.col("b")), frames.normalised(F.col("b"), F.lit(640), F.lit(480)), frames.uncrop(F.col("b"), F.array(F.lit(10.0), F.lit(20.0)))
    return rows.select("vec_id", *[r6(c).alias(n) for n, c in (("cx", centre[0]), ("cy", centre[1]), ("nx", inside[0]), ("ux", out[0]), ("uy", out[1]))])


@query(
    "index_pairs",
    "SELECT event_id, xor(event_id, 1) AS partner, user_id // 32 AS y, user_id % 32 AS x, floor(640.0 * 1024 / greatest(640, user_id + 1) + 0.5)::BIGINT AS w FROM events",
)
def index_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = frames.row_and_column(F.col("user_id"), F.lit(32))
    size = frames.longest_side(F.lit(640.0), F.col("user_id") + 1)
    return table(spark, sf_dir, "events").select("event_id", frames.partner(F.col("event_id")).alias("partner"), at[0].alias("y"), at[1].alias("x"), size[0].alias("w"))


@query("pixel_grid", "SELECT n_nationkey, x, y FROM nation, range(n_nationkey + 1) a(x), range(3) b(y)")
def pixel_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.explode(frames.pixel_grid(F.col("n_nationkey") + 1, F.lit(3).cast("long"))).alias("p"))
    return rows.select("n_nationkey", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))


@query("label_texts", "SELECT p_partkey, trim(split_part(s, ',', 1)) AS a, trim(split_part(s, ',', 2)) AS b FROM (SELECT p_partkey, ' ' || p_brand || ' , ' || p_type || ' ' AS s FROM part)")
def label_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = frames.labels_of(F.concat(F.lit(" "), "p_brand", F.lit(" , "), "p_type", F.lit(" ")))
    return table(spark, sf_dir, "part").select("p_partkey", found[0].alias("a"), found[1].alias("b"))
