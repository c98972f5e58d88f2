"""Objects of a scene: points that are near and alike are joined into components and summarised."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfield.operators import datasets, vectors
from lumenfield.operators.components import connected_components
from lumenfield.plans.scratch import materialize

POINT = ["x", "y", "z"]


def object_summary(points: DataFrame, key: str) -> DataFrame:
    """key, n, centroid cx cy cz, bounds x0 x1 y0 y1 z0 z1, and the largest distance from the centroid."""
    base = points.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(a).alias(f"c{a}") for a in POINT],
        *[f(a).alias(f"{a}{k}") for a in POINT for k, f in ((0, F.min), (1, F.max))],
    )
    # one row a key: joined back for the second pass
    far = points.join(base.select(key, "cx", "cy", "cz"), key)
    d2 = sum(((F.col(a) - F.col(f"c{a}")) * (F.col(a) - F.col(f"c{a}")) for a in POINT), F.lit(0.0))
    return base.join(far.groupBy(key).agg(F.sqrt(F.max(d2)).alias("radius")), key)


def cluster(points: DataFrame, eps: float = 0.05, alike: float = 0.75, least: int = 50) -> DataFrame:
    """points (point_id, x, y, z, feature, confidence) with component; rows of small components are left out.

    Only finite points with a positive confidence take part. least: the larger of the two size floors.
    """
    good = F.col("confidence") > 0
    for a in POINT:
        good &= F.col(a).isNotNull() & ~F.isnan(a) & (F.abs(a) != float("inf"))
    rows = materialize(points.filter(good), "points")
    pairs = vectors.radius_join(rows.select("point_id", *POINT, "feature"), rows.select("point_id", *POINT, "feature"), POINT, eps)
    pairs = pairs.filter((F.col("point_id") < F.col("point_id_r")) & (vectors.cosine("feature", "feature_r") >= alike))
    parts = connected_components(pairs.select(F.col("point_id").alias("a"), F.col("point_id_r").alias("b")))
    named = rows.join(parts.withColumnRenamed("node", "point_id"), "point_id", "left").withColumn("component", F.coalesce("component", "point_id"))
    return datasets.min_group_size(named, "component", least)


def build_objects(points: DataFrame, language: DataFrame, eps: float = 0.05, alike: float = 0.75, least: int = 50, near: float = 0.05, least_language: int = 10) -> DataFrame:
    """The object catalog of a scene: object_id, n, centroid, bounds, radius, confidence, feature.

    language: (lang_id, x, y, z, feature). Each point takes the nearest language point nearer than `near`;
    objects with too few of them are left out. Ids go by centroid.
    """
    members = materialize(cluster(points, eps, alike, least), "members")
    shape = object_summary(members, "component")
    sure = members.groupBy("component").agg(F.avg("confidence").alias("confidence"))
    left = members.select("point_id", *POINT)
    pairs = vectors.bounded_nearest(left.withColumnRenamed("point_id", "ident"), language.select(F.col("lang_id").alias("ident"), *POINT), POINT, near, "ident", "ident")
    words = pairs.join(language.select(F.col("lang_id").alias("right_id"), "feature"), "right_id")
    words = words.join(members.select(F.col("point_id").alias("left_id"), "component"), "left_id")
    meaning = vectors.mean_feature(words, "component", "feature", least_language).select("component", "feature", F.col("n").alias("associations"))
    distance = words.groupBy("component").agg(F.avg("distance").alias("mean_distance"))
    out = shape.join(sure, "component").join(meaning, "component").join(distance, "component")
    return datasets.renumber(out, ["cx", "cy", "cz", F.desc("n"), "component"]).drop("component")


def search(catalog: DataFrame, query: list[float], gate: float = 0.25, k: int = 5) -> DataFrame:
    """The best objects for a unit query vector; none if the best is under the gate."""
    vector = F.array(*[F.lit(float(x)) for x in query])
    return vectors.top_k(catalog, vector, "feature", ["object_id"], k, gate)


def label_faces(faces: DataFrame, objects: DataFrame, slack: float = 0.05, share: float = 0.6) -> DataFrame:
    """fid and object_id of faces (fid, x, y, z of their centres) near enough to one object.

    An object reaches its radius plus slack. Faces and objects meet in cells as wide as the largest
    reach. A face goes to its closest object if that is clearly closer than the second.
    """
    reach = objects.withColumn("reach", F.col("radius") + slack)
    eps = reach.agg(F.max("reach")).first()[0]
    if eps is None:
        return faces.limit(0).select("fid", F.lit(None).cast("string").alias("object_id"))
    centers = reach.select("object_id", F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("cz").alias("z"), "reach")
    pairs = vectors.radius_join(faces.select("fid", *POINT), centers, POINT, float(eps)).filter(F.col("distance") <= F.col("reach_r"))
    scored = pairs.withColumn("score", 1 - F.col("distance") / F.col("reach_r"))
    top = datasets.first_n(scored, ["fid"], [F.desc("score"), "object_id_r"], 2)
    best = top.groupBy("fid").agg(F.max_by("object_id_r", "score").alias("object_id"), F.max("score").alias("best"), F.when(F.count(F.lit(1)) > 1, F.min("score")).alias("second"))
    return best.filter(F.col("best") >= share * (F.col("best") + F.greatest(F.coalesce("second", F.lit(0.0)), F.lit(0.0)))).select("fid", "object_id")
