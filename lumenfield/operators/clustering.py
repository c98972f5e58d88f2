"""Density clustering by hierarchy (HDBSCAN), with no point set in one task.

Points closer than the distance within which they have `samples` points, themselves included, count
as that far apart. The minimum spanning tree over this distance is built by radii that grow threefold:
at each radius, all pairs up to it between different trees are candidates, and Boruvka rounds join
trees until few edges are left between them, which one task takes by length. Pairs are looked for only in cells about which there are several trees, and
within them only between boxes that can be nearer than some pair of their trees that was seen. The
tree's edges in order of length make the hierarchy of merges; long edge tables are halved, the second
half on what the first has merged, until each part has few edges. From the merges follow the
clusters of at least `size` points by pointer doubling. The choice among them, by stability, is made on
the table of these clusters, one row for at least size points each, in one task.

Equal lengths are taken in order of the points' ids, so results do not depend on partitions.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfield.operators import neighbours
from lumenfield.operators.components import connected_components
from lumenfield.operators.datasets import global_index
from lumenfield.plans.scratch import materialize

#: Edges of the tree that one task merges.
PART = 200_000
GROWTH = 3.0
#: A cell's sides are cut in so many for the boxes in it.
FINE = 4


def _edges_up_to(points: DataFrame, point: list[str], radius: float, low: list[float]) -> DataFrame:
    """ca, cb, w, a, b: for pairs of trees the shortest edge of at most radius. points: id, tree, core and coordinates."""
    axes = point[:3]
    keys = [f"c{k}_" for k in range(len(axes))]
    fine = [f"f{k}_" for k in range(len(axes))]
    cell = {k: F.floor((F.col(c) - F.lit(lo)) / F.lit(radius)) for k, c, lo in zip(keys, axes, low, strict=True)}
    box = {k: F.floor((F.col(c) - F.lit(lo)) / F.lit(radius / FINE)) for k, c, lo in zip(fine, axes, low, strict=True)}
    placed = points.withColumns(cell | box)

    def around(df: DataFrame) -> DataFrame:
        for k in keys:
            df = df.withColumn(k, F.explode(F.array(*[F.col(k) + d for d in (-1, 0, 1)])))
        return df

    # cells that see points of several trees
    seen = around(placed.select("tree", *keys).distinct()).groupBy(*keys).agg(F.min("tree").alias("t0"), F.max("tree").alias("t1"))
    mixed = seen.filter("t0 < t1").select(*keys)
    placed = materialize(placed.join(mixed, keys, "left_semi"), "mixed")
    first = F.min_by(F.struct("core", *point), F.struct("core", "id")).alias("one")
    bounds = [f(c).alias(f"{n}_{c}") for c in point for n, f in (("lo", F.min), ("hi", F.max))]
    boxes = materialize(placed.groupBy("tree", *keys, *fine).agg(F.min("core").alias("core"), first, *bounds), "boxes")
    names = lambda df, p, held: df.select(*[F.col(c).alias(c if c in held else p + c) for c in df.columns])
    pairs = names(around(boxes.withColumn("own", F.struct(*keys))), "l_", keys).join(names(boxes.withColumn("own", F.struct(*keys)), "r_", keys), keys).filter("l_tree < r_tree")
    apart = F.sqrt(sum((F.pow(F.greatest(F.col(f"r_lo_{c}") - F.col(f"l_hi_{c}"), F.col(f"l_lo_{c}") - F.col(f"r_hi_{c}"), F.lit(0.0)), 2) for c in point), F.lit(0.0)))
    straight = F.sqrt(sum((F.pow(F.col(f"l_one.{c}") - F.col(f"r_one.{c}"), 2) for c in point), F.lit(0.0)))
    pairs = pairs.select("l_tree", "r_tree", "l_own", "r_own", *[f"{p}{c}" for p in ("l_", "r_") for c in fine], F.greatest("l_core", "r_core", apart).alias("least"), F.greatest("l_one.core", "r_one.core", straight).alias("most"))
    pairs = materialize(pairs.filter(F.col("least") <= radius), "pairs")
    bound = pairs.groupBy("l_tree", "r_tree").agg(F.min("most").alias("u"))
    open_pairs = pairs.join(bound, ["l_tree", "r_tree"]).filter(F.col("least") <= F.col("u") * (1 + 1e-9))
    side = lambda p: placed.select(F.col("tree").alias(f"{p}tree"), F.struct(*keys).alias(f"{p}own"), *[F.col(c).alias(p + c) for c in (*fine, "id", "core", *point)])
    both = open_pairs.select("l_tree", "r_tree", "l_own", "r_own", *[f"{p}{c}" for p in ("l_", "r_") for c in fine])
    for p in ("l_", "r_"):
        both = both.join(side(p), [f"{p}tree", f"{p}own", *[p + c for c in fine]])
    far = F.greatest("l_core", "r_core", neighbours.distance(point, "l_", "r_"))
    edges = both.select("l_tree", "r_tree", far.alias("w"), F.least("l_id", "r_id").alias("a"), F.greatest("l_id", "r_id").alias("b")).filter(F.col("w") <= radius)
    return edges.groupBy(F.col("l_tree").alias("ca"), F.col("r_tree").alias("cb")).agg(F.min(F.struct("w", "a", "b")).alias("e")).select("ca", "cb", "e.*")


def _kruskal(edges: pd.DataFrame) -> pd.DataFrame:
    """Edges taken (w, a, b) and names of trees (old, new), of few edges between trees."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    taken = []
    for w, a, b, ca, cb in edges.sort_values(["w", "a", "b"])[["w", "a", "b", "ca", "cb"]].itertuples(index=False):
        x, y = find(ca), find(cb)
        if x != y:
            root[max(x, y)] = min(x, y)
            taken.append((w, a, b, None, None))
    return pd.DataFrame(taken + [(None, None, None, x, find(x)) for x in list(root)], columns=["w", "a", "b", "old", "new"])


def _join_trees(edges: DataFrame, part: int) -> tuple[DataFrame | None, DataFrame | None]:
    """The edges taken (w, a, b) of edges between trees, and old and new names of trees; None where there are no edges.

    Boruvka rounds, until at most `part` edges are left between trees; these are taken in one task.
    """
    taken, names = None, None
    left = materialize(edges, "edges")

    def rename(names: DataFrame | None, parts: DataFrame) -> DataFrame:
        """Names where a tree that was joined before and is again goes by its newest name."""
        if names is None:
            return parts
        again = names.join(parts.select(F.col("old").alias("new"), F.col("new").alias("newer")), "new", "left").select("old", F.coalesce("newer", "new").alias("new"))
        return again.unionByName(parts.join(again, "old", "left_anti"))

    while count := left.count():
        if count <= part:
            done = materialize(left.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(_kruskal, "w double, a long, b long, old long, new long"), "kruskal")
            last = done.filter("w is not null").select("w", "a", "b")
            return last if taken is None else taken.unionByName(last), rename(names, done.filter("old is not null").select("old", "new"))
        both = left.select(F.col("ca").alias("t"), "w", "a", "b", "ca", "cb").unionByName(left.select(F.col("cb").alias("t"), "w", "a", "b", "ca", "cb"))
        best = materialize(both.groupBy("t").agg(F.min(F.struct("w", "a", "b", "ca", "cb")).alias("e")).select("e.*").distinct(), "best")
        taken = best.select("w", "a", "b") if taken is None else taken.unionByName(best.select("w", "a", "b"))
        parts = materialize(connected_components(best, "ca", "cb").select(F.col("node").alias("old"), F.col("component").alias("new")), "parts")
        names = rename(names, parts)
        renamed = left
        for c in ("ca", "cb"):
            renamed = renamed.join(parts.select(F.col("old").alias(c), F.col("new").alias("n_")), c, "left").withColumn(c, F.coalesce("n_", c)).drop("n_")
        renamed = renamed.filter("ca != cb").select(F.least("ca", "cb").alias("ca"), F.greatest("ca", "cb").alias("cb"), F.struct("w", "a", "b").alias("e"))
        left = materialize(renamed.groupBy("ca", "cb").agg(F.min("e").alias("e")).select("ca", "cb", "e.*"), "edges")
    return taken, names


def spanning_tree(points: DataFrame, point: list[str], part: int = PART) -> DataFrame:
    """w, a, b: the minimum spanning tree of points (id, core, coordinates) by the greater of cores and distance."""
    row = points.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("core", 0.5, 100).alias("core"), *[f(c).alias(f"{n}{k}") for k, c in enumerate(point) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    edges = points.sparkSession.createDataFrame([], "w double, a long, b long")
    if row["n"] < 2:
        return edges
    low = [float(row[f"lo{k}"]) for k in range(len(point))][:3]
    widest = max(row[f"hi{k}"] - row[f"lo{k}"] for k in range(len(point))) or 1.0
    radius = max(float(row["core"]), widest * 1e-6)
    held = materialize(points.select("id", "core", *point, F.col("id").alias("tree")), "trees")
    while True:
        taken, names = _join_trees(_edges_up_to(held, point, radius, low), part)
        if taken is not None:
            edges = materialize(edges.unionByName(taken), "tree")
            named = held.join(names.withColumnRenamed("old", "tree"), "tree", "left").withColumn("tree", F.coalesce("new", "tree")).drop("new")
            held = materialize(named, "trees")
        if edges.count() == row["n"] - 1:
            return edges
        radius *= GROWTH


def merges(edges: DataFrame, n: int, part: int = PART) -> DataFrame:
    """i, w, left, right, n_left, n_right: the hierarchy of a tree over points 0 to n - 1, one merge an edge, in order of (w, a, b).

    A node is a point or n + i, the merge i that made it.
    """
    order = global_index(edges, ["w", "a", "b"], "i")
    total = order.count()
    rows = order.select("i", "w", "a", "b", F.lit(0).cast("long").alias("seg"), F.col("a").alias("u"), F.col("b").alias("v"))
    # nodes of a part: how many points they are and which node of the hierarchy
    nodes = materialize(rows.select("seg", F.explode(F.array("u", "v")).alias("node")).distinct().select("seg", "node", F.lit(1).cast("long").alias("size"), F.col("node").alias("top")), "nodes")
    rows = materialize(rows, "parts")
    width = 1 << max(0, math.ceil(math.log2(max(1, total))))
    while width > part:
        width //= 2
        # parts are named by their first edge; the second half of one works on what the first has merged
        later = (F.col("i") - F.col("seg")) >= width
        first = rows.filter(~later)
        key = lambda c: F.struct("seg", c)
        named = first.select((F.col("seg") * n + F.col("u")).alias("a"), (F.col("seg") * n + F.col("v")).alias("b"), "i", "seg")
        parts = connected_components(named).select(F.floor(F.col("node") / n).alias("seg"), F.pmod("node", F.lit(n)).alias("node"), F.pmod("component", F.lit(n)).alias("new"))
        joined = materialize(nodes.join(parts, ["seg", "node"], "left").withColumn("new", F.coalesce("new", "node")), "joined")
        sizes = joined.groupBy("seg", "new").agg(F.sum("size").alias("size"), F.max("top").alias("top"))
        made = first.join(joined.select("seg", F.col("node").alias("u"), "new"), ["seg", "u"]).groupBy("seg", "new").agg((F.max("i") + n).alias("made"))
        sizes = sizes.join(made, ["seg", "new"], "left").select("seg", F.col("new").alias("node"), "size", F.coalesce("made", "top").alias("top"))
        second = rows.filter(later)
        for c in ("u", "v"):
            second = second.join(joined.select("seg", F.col("node").alias(c), F.col("new").alias("n_")), ["seg", c]).withColumn(c, F.col("n_")).drop("n_")
        new_nodes = nodes.unionByName(sizes.withColumn("seg", F.col("seg") + width))
        moved = first.unionByName(second.withColumn("seg", F.col("seg") + width).select(first.columns))
        rows = materialize(moved, "parts")
        used = rows.select("seg", F.explode(F.array("u", "v")).alias("node")).distinct()
        nodes = materialize(new_nodes.join(used, ["seg", "node"], "left_semi"), "nodes")
    full = rows
    for c in ("u", "v"):
        full = full.join(nodes.select("seg", F.col("node").alias(c), F.col("size").alias(f"size_{c}"), F.col("top").alias(f"top_{c}")), ["seg", c])

    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("i")
        root: dict[int, int] = {}
        held: dict[int, tuple[int, int]] = {}

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        out = []
        for i, w, u, v, nu, nv, tu, tv in own[["i", "w", "u", "v", "size_u", "size_v", "top_u", "top_v"]].itertuples(index=False):
            for x, size, top in ((u, nu, tu), (v, nv, tv)):
                if x not in root:
                    root[x], held[x] = x, (size, top)
            x, y = find(u), find(v)
            (sx, tx), (sy, ty) = held[x], held[y]
            out.append((i, w, tx, ty, sx, sy))
            root[y], held[x] = x, (sx + sy, n + i)
        return pd.DataFrame(out, columns=["i", "w", "left", "right", "n_left", "n_right"])

    return full.groupBy("seg").applyInPandas(run, "i long, w double, left long, right long, n_left long, n_right long")


def _up(pointers: DataFrame) -> DataFrame:
    """node, at: where each node ends that goes to `at` until a node has no pointer."""
    current = materialize(pointers, "pointers")
    while True:
        for _ in range(3):  # each step doubles how far a pointer goes
            further = current.select(F.col("node").alias("at"), F.col("at").alias("next"))
            current = current.join(further, "at", "left").select("node", F.coalesce("next", "at").alias("at"))
        current = materialize(current, "pointers")
        if not current.join(current.select(F.col("node").alias("at")), "at", "left_semi").limit(1).count():
            return current


def choose(clusters: pd.DataFrame, epsilon: float) -> pd.DataFrame:
    """cluster, label: the chosen cluster that each lies in (-1: none), by excess of mass, never the root.

    clusters: cluster, parent (none: root), length at which it comes off, stability. Chosen clusters that
    come off under epsilon give way to the nearest above that doesn't.
    """
    parent = {int(c): None if pd.isna(p) else int(p) for c, p in zip(clusters["cluster"], clusters["parent"], strict=True)}
    length = dict(zip(clusters["cluster"].astype(int), clusters["length"], strict=True))
    worth = dict(zip(clusters["cluster"].astype(int), clusters["stability"], strict=True))
    below: dict[int, list[int]] = {}
    for c, p in parent.items():
        if p is not None:
            below.setdefault(p, []).append(c)
    down = [c for c, p in parent.items() if p is None]
    for c in down:
        down += below.get(c, [])
    chosen: set[int] = set()
    for c in reversed(down):
        inner = sum(worth[x] for x in below.get(c, []))
        if parent[c] is None or (c in below and inner > worth[c]):
            worth[c] = inner
        else:
            chosen.add(c)
    picked: set[int] = set()
    for c in down:  # from above: what lies in a chosen one is not
        p = parent[c]
        if p is not None and (p in picked or p in chosen):
            picked.add(c)
    chosen -= picked
    if epsilon > 0:
        for c in sorted(chosen, key=down.index):
            while length[c] < epsilon and parent[c] is not None and parent[parent[c]] is not None:
                c = parent[c]
            chosen.add(c)
    label: dict[int, int] = {}
    for c in down:
        p = parent[c]
        label[c] = label[p] if p is not None and label[p] >= 0 else c if c in chosen else -1
    return pd.DataFrame({"cluster": list(label), "label": list(label.values())})


def hdbscan(points: DataFrame, ident: str, point: list[str], samples: int = 5, size: int = 5, epsilon: float = 0.0, part: int = PART) -> DataFrame:
    """ident, label: the cluster of each point, numbered from 0 by size, then first point; -1: none.

    samples: points that make a place dense; size: least points of a cluster; epsilon: clusters that come
    off at less than this are not cut. Points without finite coordinates have label -1. Equal points
    are one place with several points. ident has to be unique.
    """
    spark = points.sparkSession
    good = F.lit(True)
    for c in point:
        good &= F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) != float("inf"))
    everyone = points.select(F.col(ident).alias("ident"))
    rows = materialize(global_index(points.filter(good).select(F.col(ident).alias("ident"), *[F.col(c).cast("double").alias(c) for c in point]), ["ident"], "id"), "points")
    n = rows.count()
    if n < max(2, size, samples):
        return everyone.select(F.col("ident").alias(ident), F.lit(-1).cast("long").alias("label"))
    places = materialize(rows.groupBy(*point).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("many")), "places")
    cores = neighbours.reach(places, "id", point, samples, "many").select("id", F.col("reach").alias("core"))
    cored = materialize(places.join(cores, "id"), "cores")
    tree = spanning_tree(cored.select("id", "core", *point), point, part)
    copies = rows.join(cored.select(*point, F.col("id").alias("first"), "core"), point).filter("id != first").select(F.col("core").alias("w"), F.col("first").alias("a"), F.col("id").alias("b"))
    steps = materialize(merges(tree.unionByName(copies), n, part), "merges")
    big = F.col("n_left") + F.col("n_right") >= size
    kids = materialize(
        steps.select(F.explode(F.array(*[F.struct(F.col(c).alias("node"), F.col(f"n_{c}").alias("n"), F.col(f"n_{d}").alias("other"), (F.col("i") + n).alias("up"), "w", big.alias("big")) for c, d in (("left", "right"), ("right", "left"))])).alias("k")).select("k.*"),
        "kids",
    )
    # a cluster begins at the top, or where both sides of a merge are large enough
    born = kids.filter((F.col("n") >= size) & (F.col("other") >= size))
    inner = _up(kids.filter((F.col("n") >= size) & (F.col("other") < size)).select("node", F.col("up").alias("at")))
    of_node = inner.unionByName(born.select("node", F.col("node").alias("at")).join(inner.select("node"), "node", "left_anti"))
    root = n + steps.count() - 1
    of_node = materialize(of_node.unionByName(spark.createDataFrame([(root, root)], "node long, at long")).distinct(), "clusters")
    # a point leaves at the first merge above it that is large enough
    small = kids.filter(F.col("n") < size)
    climb = _up(small.filter(~F.col("big")).select("node", F.col("up").alias("at")))
    leave = small.filter("big").select(F.col("node").alias("at"), "up", "w")
    whole = rows.select(F.col("id").alias("node")).join(climb, "node", "left").select("node", F.coalesce("at", "node").alias("at"))
    left_at = materialize(whole.join(leave, "at").join(of_node.select(F.col("node").alias("up"), F.col("at").alias("cluster")), "up").select("node", "cluster", "w"), "leaving")
    births = born.join(of_node.select(F.col("node").alias("up"), F.col("at").alias("parent")), "up").select(F.col("node").alias("cluster"), "parent", F.col("w").alias("length"), "n")
    births = materialize(births, "births")
    dense = lambda w: 1 / F.greatest(w, F.lit(1e-300))
    lost = left_at.groupBy("cluster").agg(F.sum(dense(F.col("w"))).alias("s"), F.count(F.lit(1)).alias("m"))
    split = births.groupBy(F.col("parent").alias("cluster")).agg(F.sum(dense(F.col("length")) * F.col("n")).alias("s2"), F.sum("n").alias("m2"))
    known = births.select("cluster", "parent", "length").unionByName(spark.createDataFrame([(root, None, None)], "cluster long, parent long, length double"))
    table = known.join(lost, "cluster", "left").join(split, "cluster", "left").fillna(0, ["s", "m", "s2", "m2"])
    worth = F.when(F.col("length").isNull(), 0.0).otherwise(F.col("s") + F.col("s2") - (F.col("m") + F.col("m2")) * dense(F.col("length")))
    table = table.select("cluster", "parent", "length", worth.alias("stability"), F.lit(0).alias("one"))
    chosen = table.groupBy("one").applyInPandas(lambda own: choose(own, epsilon), "cluster long, label long")
    found = left_at.join(chosen, "cluster").select(F.col("node").alias("id"), "label")
    ranked = found.filter("label >= 0").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    number = ranked.select("label", (F.row_number().over(Window.orderBy(F.desc("n"), "first")) - 1).cast("long").alias("number"))
    named = rows.select("ident", "id").join(found, "id", "left").join(number, "label", "left")
    out = everyone.join(named.select("ident", "number"), "ident", "left")
    return out.select(F.col("ident").alias(ident), F.coalesce("number", F.lit(-1)).cast("long").alias("label"))


def fill(labelled: DataFrame, ident: str, point: list[str]) -> DataFrame:
    """ident, label: points of label -1 take the label of the nearest point that has one, ties by ident; all 0 where none has."""
    have, lack = labelled.filter("label >= 0"), labelled.filter("label < 0")
    near = neighbours.nearest(lack.select(ident, *point), have.select(ident, *point), point, ident, ident)
    taken = near.join(have.select(F.col(ident).alias("right_id"), "label"), "right_id").select(F.col("left_id").alias(ident), F.col("label").alias("taken"))
    out = labelled.select(ident, "label").join(taken, ident, "left")
    return out.select(ident, F.when(F.col("label") >= 0, F.col("label")).otherwise(F.coalesce("taken", F.lit(0))).cast("long").alias("label"))

