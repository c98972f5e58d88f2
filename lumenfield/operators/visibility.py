"""What views see of a scene: points inside camera frustums, by a tree of cells.

A view goes down the cells of the points from the largest: cells outside one of its five planes are
left, those inside all of them go on untested, and only in leaf cells that a plane cuts are points
tested one by one. Steps are equality joins on a cell, so what is compared follows what is in view.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfield.operators.neighbours import SMALL, Cells
from lumenfield.plans.scratch import materialize

#: Points that a leaf cell holds at most, if the cells can be made small enough.
LEAF = 64


def _planes(w2c: Column, fx: Column, fy: Column, cx: Column, cy: Column, width: Column, height: Column) -> list[list[Column]]:
    """The five planes of a view, each a, b, c, d with a x + b y + c z + d at least 0 within; w2c: 16 numbers by rows."""
    row = lambda r: [w2c[4 * r + k] for k in range(4)]
    x, y, z = row(0), row(1), row(2)
    u = [fx * a + cx * c for a, c in zip(x, z, strict=True)]
    v = [fy * b + cy * c for b, c in zip(y, z, strict=True)]
    return [z, u, v, [width * c - a for a, c in zip(u, z, strict=True)], [height * c - b for b, c in zip(v, z, strict=True)]]


def visible(points: DataFrame, views: DataFrame, ident: str, view: str, point: list[str], leaf: int = LEAF) -> DataFrame:
    """view, ident, tested: points in front of a view whose pixel is within its image; tested: whether it took a test of its own.

    views: view, w2c (world to camera, 16 numbers by rows), fx, fy, cx, cy, width, height. Points whose
    coordinates are null or not finite are never seen; nor does a view with such numbers see anything.
    """
    good = F.lit(True)
    for c in point:
        good &= F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) != float("inf"))
    held = materialize(points.filter(good).select(F.col(ident).alias("ident"), *[F.col(c).cast("double").alias(c) for c in point], F.lit(1).cast("long").alias("w_")), "points")
    cells = Cells(held, point, leaf)
    keys = [f"c{k}_" for k in range(3)]
    names = ("fx", "fy", "cx", "cy", "width", "height")
    planes = _planes(F.col("w2c"), *[F.col(c).cast("double") for c in names])
    flat = [x for p in planes for x in p]
    finite = F.array(*flat)
    sound = views.filter((F.size("w2c") == 16) & F.forall(finite, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
    cameras = materialize(sound.select(F.col(view).alias("view"), finite.alias("planes"), "w2c", *[F.col(c).cast("double").alias(c) for c in names]), "views")
    if not cells.n:
        return cameras.limit(0).select(F.col("view").alias(view), F.lit(None).cast(held.schema["ident"].dataType).alias(ident), F.lit(True).alias("tested"))
    levels = cells.boxes(held)

    def seen(rows: DataFrame) -> DataFrame:
        """Rows (view and cell) that are not outside, with whether they are inside."""
        outside, inside = F.lit(False), F.lit(True)
        for n in range(5):
            a = [F.col("planes")[4 * n + k] for k in range(4)]
            most = a[3] + sum((F.greatest(a[k] * F.col(f"lo_{c}"), a[k] * F.col(f"hi_{c}")) for k, c in enumerate(point)), F.lit(0.0))
            least = a[3] + sum((F.least(a[k] * F.col(f"lo_{c}"), a[k] * F.col(f"hi_{c}")) for k, c in enumerate(point)), F.lit(0.0))
            size = F.abs(a[3]) + sum((F.abs(a[k]) * F.greatest(F.abs(F.col(f"lo_{c}")), F.abs(F.col(f"hi_{c}"))) for k, c in enumerate(point)), F.lit(0.0))
            # what rounding can change is tested
            outside |= most < -1e-9 * size
            inside &= least > 1e-9 * size
        return rows.withColumn("inside", F.col("inside") | inside).filter(F.col("inside") | ~outside).select("view", "planes", *keys, "inside")

    # the cells of the first level, 8 at most, are tried by each view
    top = [F.struct(*[F.lit(r[c]).alias(c) for c in levels[1].columns]) for r in levels[1].collect()]
    rows = seen(cameras.select("view", "planes", F.lit(False).alias("inside"), F.explode(F.array(*top)).alias("b")).select("view", "planes", "inside", "b.*"))
    for level in range(2, len(levels)):
        up = levels[level].select(*[F.shiftright(c, 1).alias(f"up_{c}") for c in keys], "*").drop("n_")
        up = up.withColumnsRenamed({k: f"own_{k}" for k in keys}).withColumnsRenamed({f"up_{k}": k for k in keys})
        rows = rows.join(F.broadcast(up) if level <= SMALL else up, keys).drop(*keys).withColumnsRenamed({f"own_{k}": k for k in keys})
        rows = seen(rows)
    placed = held.select("ident", *point, *cells.at(cells.depth))
    pairs = rows.select("view", "inside", *keys).join(placed, keys).join(cameras, "view")
    camera = [sum((F.col("w2c")[4 * r + k] * F.col(c) for k, c in enumerate(point)), F.lit(0.0)) + F.col("w2c")[4 * r + 3] for r in range(3)]
    depth = F.greatest(camera[2], F.lit(1e-12))
    u, v = (F.col("fx") * camera[0] + F.col("cx") * camera[2]) / depth, (F.col("fy") * camera[1] + F.col("cy") * camera[2]) / depth
    hit = (camera[2] > 0) & (u >= 0) & (u < F.col("width")) & (v >= 0) & (v < F.col("height"))
    return pairs.filter(F.col("inside") | hit).select(F.col("view").alias(view), F.col("ident").alias(ident), (~F.col("inside")).alias("tested"))


def shared_faces(seen: DataFrame, view: str, ident: str) -> DataFrame:
    """a, b, shared, iou of pairs of views that see a face in common, from view and ident.

    Faces that many views see make pairs of all these, as their answer does.
    """
    sizes = seen.groupBy(view).agg(F.count(F.lit(1)).alias("n"))
    left, right = (seen.select(F.col(view).alias(n), F.col(ident).alias("face")) for n in "ab")
    both = left.join(right, "face").filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
    for n in "ab":
        both = both.join(sizes.select(F.col(view).alias(n), F.col("n").alias(f"n_{n}")), n)
    return both.select("a", "b", "shared", (F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared"))).alias("iou"))
