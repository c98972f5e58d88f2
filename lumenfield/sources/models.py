"""Sparse models as text: cameras and points, read line by line wherever a file is cut, and which format a folder holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PARTS = ("cameras", "images", "points3D")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """The words of lines that are neither empty nor remarks."""
    rows = spark.read.text(path).select(F.trim("value").alias("line"))
    return rows.filter((F.col("line") != "") & ~F.col("line").startswith("#")).select(F.split("line", r"\s+").alias("c"))


def _checked(rows: DataFrame, good: Column, what: str) -> DataFrame:
    """Rows as they are; one that is none of `what` ends the job with its line."""
    return rows.withColumn("c", F.when(good, F.col("c")).otherwise(F.raise_error(F.concat(F.lit(f"not a line of {what}: "), F.array_join("c", " ")))))


def read_cameras_text(spark: SparkSession, path: str) -> DataFrame:
    """camera_id, model, width, height, params."""
    rows = _checked(_lines(spark, path), F.size("c") >= 5, "cameras")
    numbers = F.transform(F.slice("c", 5, F.size("c")), lambda x: x.cast("double"))
    return rows.select(F.col("c")[0].cast("int").alias("camera_id"), F.col("c")[1].alias("model"), F.col("c")[2].cast("long").alias("width"), F.col("c")[3].cast("long").alias("height"), numbers.alias("params"))


def read_points_text(spark: SparkSession, path: str) -> DataFrame:
    """point_id, xyz, rgb, error and the track: image_ids and the places of the point in them, point2d_idxs."""
    rows = _checked(_lines(spark, path), (F.size("c") >= 8) & (F.size("c") % 2 == 0), "points")
    part = lambda first, n, kind: F.transform(F.slice("c", first, n), lambda x: x.cast(kind))
    track = F.slice("c", 9, F.greatest(F.size("c") - 8, F.lit(0)))
    side = lambda k: F.transform(F.filter(track, lambda _, i: i % 2 == k), lambda x: x.cast("int"))
    return rows.select(F.col("c")[0].cast("long").alias("point_id"), part(2, 3, "double").alias("xyz"), part(5, 3, "int").alias("rgb"), F.col("c")[7].cast("double").alias("error"), side(0).alias("image_ids"), side(1).alias("point2d_idxs"))


def write_points_text(points: DataFrame, path: str) -> None:
    """A folder of text files that read_points_text reads back as they were; written by tasks and committed together."""
    text = lambda c: F.transform(c, lambda x: x.cast("string"))
    track = F.flatten(F.transform(F.arrays_zip(F.col("image_ids").alias("i"), F.col("point2d_idxs").alias("p")), lambda t: F.array(t["i"].cast("string"), t["p"].cast("string"))))
    words = F.concat(F.array(F.col("point_id").cast("string")), text("xyz"), text("rgb"), F.array(F.col("error").cast("string")), track)
    points.select(F.array_join(words, " ").alias("value")).write.text(path)


def write_cameras_text(cameras: DataFrame, path: str) -> None:
    words = F.concat(F.array(*[F.col(c).cast("string") for c in ("camera_id", "model", "width", "height")]), F.transform("params", lambda x: x.cast("string")))
    cameras.select(F.array_join(words, " ").alias("value")).write.text(path)


def model_format(spark: SparkSession, folder: str) -> str | None:
    """".bin" or ".txt", the first of which a folder has all three parts in; None where neither."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    store = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for ending in (".bin", ".txt"):
        if all(store.exists(jvm.org.apache.hadoop.fs.Path(root, part + ending)) for part in PARTS):
            return ending
    return None


def track_lengths(points: DataFrame) -> DataFrame:
    """image_id, n_points, mean_track: of each image its points and how many images these are seen in, on average."""
    rows = points.select(F.size("image_ids").alias("n"), F.explode(F.array_distinct("image_ids")).alias("image_id"))
    return rows.groupBy("image_id").agg(F.count(F.lit(1)).alias("n_points"), F.avg("n").alias("mean_track"))
