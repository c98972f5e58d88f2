"""Nearest neighbours and hierarchical density clustering against plain numpy on all pairs."""

from __future__ import annotations

import numpy as np
import pytest

from lumenfield.operators import clustering, neighbours

AXES = ["x", "y", "z"]


def frame(spark, x: np.ndarray, axes=AXES):
    return spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(x)], "id long, " + ", ".join(f"{a} double" for a in axes))


def brute_labels(x: np.ndarray, samples: int, size: int, epsilon: float) -> list[set[int]]:
    """Clusters as sets of points: all pairs, Kruskal, then the hierarchy walked from its top."""
    n = len(x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    core = np.sort(d, 1)[:, samples - 1]
    far = np.maximum(d, np.maximum(core[:, None], core[None]))
    trees = [{"points": {i}, "kids": None, "w": 0.0} for i in range(n)]
    owner = list(range(n))
    for w, a, b in sorted((far[a, b], a, b) for a in range(n) for b in range(a + 1, n)):
        if owner[a] == owner[b]:
            continue
        one, two = trees[owner[a]], trees[owner[b]]
        trees.append({"points": one["points"] | two["points"], "kids": (one, two), "w": w})
        for p in trees[-1]["points"]:
            owner[p] = len(trees) - 1

    def condense(node, birth):
        """stability, own clusters chosen below, birth: of a cluster that begins at node."""
        begin, mass = (0.0 if birth is None else 1 / birth), 0.0
        at = node
        while True:
            one, two = at["kids"]
            lam = 1 / at["w"]
            large = [k for k in (one, two) if len(k["points"]) >= size]
            for k in (one, two):
                if k not in large or len(large) == 2:
                    mass += len(k["points"]) * (lam - begin)
            if len(large) < 2 and (not large or large[0]["kids"] is None):
                if large:
                    mass += 0
                return {"node": node, "birth": birth, "mass": mass, "kids": []}
            if len(large) == 2:
                return {"node": node, "birth": birth, "mass": mass, "kids": [condense(k, at["w"]) for k in large]}
            at = large[0]

    def pick(c, up):
        below = [y for k in c["kids"] for y in pick(k, [*up, c])]
        c["total"] = sum(k["total"] for k in c["kids"])
        if c["birth"] is None or (c["kids"] and c["total"] > c["mass"]):
            return below
        c["total"] = c["mass"]
        return [(c, up)]

    found = []
    for c, up in pick(condense(trees[-1], None), []):
        while epsilon and c["birth"] < epsilon and len(up) > 1:
            c, up = up[-1], up[:-1]
        found.append(frozenset(c["node"]["points"]))
    return [s for s in set(found) if not any(s < o for o in found)]


def blobs(seed: int, n: int, axes: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    parts = [rng.normal(c, s, (n, axes)) for c, s in ((0, 0.3), (3, 0.1), (3.8, 0.12), (-4, 0.6))]
    return np.concatenate([*parts, rng.uniform(-8, 8, (n // 2, axes)), np.full((1, axes), 40.0)])


@pytest.mark.parametrize(("seed", "samples", "size", "epsilon", "part"), [(2, 3, 5, 0.0, 16), (3, 3, 4, 0.8, 1 << 20)])
def test_clusters_are_those_of_all_pairs(spark, seed, samples, size, epsilon, part):
    x = blobs(seed, 30)
    got = {r["id"]: r["label"] for r in clustering.hdbscan(frame(spark, x), "id", AXES, samples, size, epsilon, part).collect()}
    sets: dict[int, set] = {}
    for i, label in got.items():
        sets.setdefault(label, set()).add(i)
    want = brute_labels(x, samples, size, epsilon)
    assert len(got) == len(x) and len(want) > 1
    assert {frozenset(v) for k, v in sets.items() if k >= 0} == set(want)
    assert [len(sets[k]) for k in range(len(want))] == sorted(map(len, want), reverse=True)


def test_spanning_tree_has_least_length(spark):
    x = blobs(4, 40, 2)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    core = np.sort(d, 1)[:, 2]
    far = np.maximum(d, np.maximum(core[:, None], core[None]))
    inside, total = {0}, 0.0
    best = far[0].copy()
    while len(inside) < len(x):
        best[list(inside)] = np.inf
        k = int(best.argmin())
        total += best[k]
        inside.add(k)
        best = np.minimum(best, far[k])
    points = spark.createDataFrame([(i, float(core[i]), *map(float, x[i])) for i in range(len(x))], "id long, core double, x double, y double")
    edges = clustering.spanning_tree(points, ["x", "y"], 8).collect()
    assert len(edges) == len(x) - 1 and np.isclose(sum(e["w"] for e in edges), total)
    assert all(np.isclose(e["w"], far[e["a"], e["b"]]) for e in edges)


def test_odd_points_and_filling(spark):
    rows = [(0, 0.0), (1, 0.0), (2, 0.0), (3, 0.1), (4, 0.2), (5, 9.0), (6, 9.0), (7, 9.0), (8, 9.1), (9, 30.0), (10, None), (11, float("nan")), (12, 4.0)]
    points = spark.createDataFrame(rows, "id long, x double")
    got = {r["id"]: r["label"] for r in clustering.hdbscan(points, "id", ["x"], 2, 3).collect()}
    assert got[0] == got[1] == got[2] != got[5] == got[6] == got[7] and {got[9], got[10], got[11]} == {-1} and len(got) == len(rows)
    labelled = points.join(spark.createDataFrame(list(got.items()), "id long, label long"), "id")
    full = {r["id"]: r["label"] for r in clustering.fill(labelled, "id", ["x"]).collect()}
    assert full[9] == got[8] or got[8] == -1
    assert full[10] == full[11] == 0 and all(full[i] == got[i] for i in got if got[i] >= 0)
    few = points.limit(1)
    assert [r["label"] for r in clustering.hdbscan(few, "id", ["x"]).collect()] == [-1]
    assert clustering.hdbscan(points.limit(0), "id", ["x"]).count() == 0
    lone = {r["label"] for r in clustering.fill(points.select("id", "x").selectExpr("*", "-1L as label"), "id", ["x"]).collect()}
    assert lone == {0}


@pytest.mark.parametrize("k", [1, 4])
def test_nearest_without_a_radius(spark, k):
    rng = np.random.default_rng(k)
    right = np.concatenate([rng.normal(size=(300, 3)), rng.normal(size=(100, 3)) * 0.01 + 5, np.tile([[7.0, 7, 7]], (3, 1))])
    left = np.concatenate([right[::5] + 0.01, [[1e4, 0, 0], [-50, 60, 3.0], [7, 7, 7]]])
    got: dict[int, list] = {}
    for r in neighbours.nearest(frame(spark, left), frame(spark, right), AXES, "id", "id", k).collect():
        got.setdefault(r["left_id"], []).append((r["rank"], r["right_id"], r["distance"]))
    d = np.sqrt(((left[:, None] - right[None]) ** 2).sum(2))
    want = np.argsort(d, 1, kind="stable")[:, :k]
    for i in range(len(left)):
        own = sorted(got[i])
        assert [r for _, r, _ in own] == want[i].tolist() and np.allclose([x for *_, x in own], d[i, want[i]])
    few = neighbours.nearest(frame(spark, left), frame(spark, right[:2]), AXES, "id", "id", 5)
    assert few.count() == 2 * len(left)
    assert neighbours.nearest(frame(spark, left), frame(spark, right).limit(0), AXES, "id", "id").count() == 0


def test_reach_counts_weights(spark):
    rng = np.random.default_rng(5)
    x, many = np.round(rng.normal(size=(200, 2)), 1), rng.integers(1, 5, 200)
    rows = spark.createDataFrame([(i, float(a), float(b), int(m)) for i, ((a, b), m) in enumerate(zip(x, many, strict=True))], "id long, x double, y double, m int")
    got = {r["id"]: r["reach"] for r in neighbours.reach(rows, "id", ["x", "y"], 9, "m").collect()}
    for i in range(200):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        order = np.argsort(d)
        assert np.isclose(got[i], d[order][np.searchsorted(np.cumsum(many[order]), 9)])
