"""Readers of sensor logs, poses, trajectories, masks, catalogs and splits, with their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenfield.operators.datasets import global_index

IMU = "timestamp long, acc_x double, acc_y double, acc_z double, gyro_x double, gyro_y double, gyro_z double"
AR_POSE = "timestamp long, px double, py double, pz double, qx double, qy double, qz double, qw double"


def _csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with a header that has at least the schema's columns, in any order; raises otherwise."""
    names = [c.split()[0] for c in schema.split(", ")]
    raw = spark.read.option("header", True).option("mode", "FAILFAST").csv(path)
    missing = [n for n in names if n not in raw.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    kinds = dict(c.split() for c in schema.split(", "))
    return raw.select(*[F.col(n).cast(kinds[n]).alias(n) for n in names])


def read_imu(spark: SparkSession, path: str) -> DataFrame:
    """Inertial samples in order of time, rows at rest in every channel left out; raises if there are none."""
    rows = _csv(spark, path, IMU)
    if rows.isEmpty():
        raise ValueError("no inertial samples")
    size = lambda p: F.sqrt(sum((F.col(f"{p}_{a}") * F.col(f"{p}_{a}") for a in "xyz"), F.lit(0.0)))
    return rows.filter((size("acc") >= 1e-9) | (size("gyro") >= 1e-9)).orderBy("timestamp")


def read_ar_poses(spark: SparkSession, path: str, frames: DataFrame | None = None) -> DataFrame:
    """Poses in order of time. Raises on repeated times and on frames (timestamp) outside their range."""
    rows = _csv(spark, path, AR_POSE)
    span = rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("timestamp").alias("d"), F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi")).first()
    if not span["n"]:
        raise ValueError("no poses")
    if span["n"] != span["d"]:
        raise ValueError("repeated times")
    if frames is not None and not frames.filter(~F.col("timestamp").between(span["lo"], span["hi"])).isEmpty():
        raise ValueError("frames outside the poses' times")
    return rows.orderBy("timestamp")


def read_pose_files(spark: SparkSession, folder: str) -> DataFrame:
    """timestamp, pose of files <timestamp>.txt that hold 16 numbers; others are left out."""
    rows = spark.read.text(folder, wholetext=True, pathGlobFilter="*.txt").select("value", F.col("_metadata.file_name").alias("name"))
    numbers = F.transform(F.filter(F.split("value", r"\s+"), lambda x: x != ""), lambda x: x.try_cast("double"))
    out = rows.select(F.regexp_extract("name", r"(\d+)\.txt$", 1).try_cast("long").alias("timestamp"), numbers.alias("pose"))
    return out.filter((F.size("pose") == 16) & ~F.exists("pose", lambda x: x.isNull()) & F.col("timestamp").isNotNull())


def write_pose_lines(poses: DataFrame, path: str, decimals: int = 8) -> None:
    """One line a row: the timestamp and 16 numbers with fixed decimals."""
    numbers = F.array_join(F.transform("pose", lambda x: F.format_string(f"%.{decimals}f", x)), " ")
    poses.select(F.concat_ws(" ", F.col("timestamp").cast("string"), numbers).alias("value")).write.text(path)


def read_trajectory(spark: SparkSession, path: str, skip: int = 0, stride: int = 1, most: int | None = None) -> DataFrame:
    """idx, ts, position, quaternion (x, y, z, w) of lines of eight numbers, every stride-th from skip on."""
    rows = spark.read.text(path).filter(~F.col("value").startswith("#") & (F.trim("value") != ""))
    cells = F.transform(F.split(F.trim("value"), r"[\s,]+"), lambda x: x.try_cast("double"))
    rows = rows.select(cells.alias("c")).filter(F.size("c") >= 8)
    out = rows.select(F.col("c")[0].alias("ts"), F.slice("c", 2, 3).alias("position"), F.slice("c", 5, 4).alias("quaternion"))
    out = global_index(out, ["ts", "position", "quaternion"], "idx").filter((F.col("idx") >= skip) & (F.pmod(F.col("idx") - skip, F.lit(stride)) == 0))
    return (out.filter(F.col("idx") < skip + stride * most) if most else out).orderBy("idx")


def read_images(spark: SparkSession, folder: str, pattern: str = "*.jpg") -> DataFrame:
    """key (the file's stem), path and content of images."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return rows.select(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("key"), "path", "content")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines without surrounding white space, blank ones left out."""
    return spark.read.text(path).select(F.trim("value").alias("value")).filter("value != ''")


def read_split(spark: SparkSession, path: str) -> DataFrame:
    """name and class (from 0) of lines name__class (from 1)."""
    return read_lines(spark, path).select(F.split("value", "__")[0].alias("name"), (F.split("value", "__")[1].cast("int") - 1).alias("class"))


def read_masklets(spark: SparkSession, path: str) -> DataFrame:
    """frame, mask, size, counts of a JSON document {"masklet": [[{size, counts}, ...], ...]}."""
    rows = spark.read.schema("masklet array<array<struct<size:array<int>,counts:array<int>>>>").json(path, multiLine=True)
    frames = rows.select(F.posexplode("masklet").alias("frame", "masks"))
    return frames.select("frame", F.posexplode("masks").alias("mask", "rle")).select("frame", "mask", "rle.size", "rle.counts")


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Objects of a catalog document; raises if there are none."""
    rows = spark.read.json(path, multiLine=True)
    if "objects" not in rows.columns:
        raise ValueError("no objects")
    out = rows.select(F.explode("objects").alias("o")).select("o.*")
    if out.isEmpty():
        raise ValueError("no objects")
    return out


def read_tsv(spark: SparkSession, path: str, labels: str | None = None) -> DataFrame:
    """key and value of a table; with labels, joined by key, and raises if a key has none."""
    rows = spark.read.option("sep", "\t").csv(path).toDF("key", "value")
    if labels is None:
        return rows
    marks = spark.read.option("sep", "\t").csv(labels).toDF("key", "label")
    if not rows.join(marks, "key", "left_anti").isEmpty():
        raise ValueError("a key has no label")
    return rows.join(marks, "key")


def sequences(files: DataFrame, least: int = 24) -> DataFrame:
    """Manifest rows (sequence, path) with frame_idx by path, of sequences that are long enough."""
    counted = files.withColumn("frame_idx", F.row_number().over(Window.partitionBy("sequence").orderBy("path")) - 1)
    good = files.groupBy("sequence").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select("sequence")
    return counted.join(good, "sequence", "left_semi")


def metric_reports(spark: SparkSession, folder: str) -> DataFrame:
    """name and the three errors of reports *_metric.txt, and nulls where a report lacks one."""
    rows = spark.read.text(folder, wholetext=True, pathGlobFilter="*_metric.txt", recursiveFileLookup=True)
    found = F.regexp_extract_all("value", F.lit(r"rmse\s*[:=]?\s*([0-9.eE+-]+)"), 1)
    number = lambda k: F.try_element_at(found, F.lit(k)).try_cast("double")
    return rows.select(F.col("_metadata.file_name").alias("name"), number(1).alias("ate"), number(2).alias("rpe_translation"), number(3).alias("rpe_rotation"))
