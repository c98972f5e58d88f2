"""Weighted similarity alignment of point pairs: sums in Spark, a 3 by 3 decomposition on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfield.operators.evaluation import finite

AXES = "xyz"


def similarity(pairs: DataFrame, weight: str = "w") -> dict:
    """Rotation, scale, translation, rms, max_residual and count that map (sx, sy, sz) to (tx, ty, tz).

    Rows with a non-finite value or no positive weight are left out; under 3 rows or without spread it raises.
    Two passes of plain sums: the input may have any size, the driver sees one row of each.
    """
    names = [f"{k}{a}" for k in "st" for a in AXES]
    good = F.col(weight) > 0
    for n in [*names, weight]:
        good &= finite(n)
    rows = pairs.filter(good)
    w = F.col(weight)
    first = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(w).alias("w"), *[(F.sum(w * F.col(n)) / F.sum(w)).alias(n) for n in names]).first()
    if first["n"] < 3:
        raise ValueError("an alignment needs three pairs")
    s = {a: F.col(f"s{a}") - first[f"s{a}"] for a in AXES}
    t = {a: F.col(f"t{a}") - first[f"t{a}"] for a in AXES}
    second = rows.agg(
        *[(F.sum(w * t[a] * s[b]) / first["w"]).alias(a + b) for a in AXES for b in AXES],
        (F.sum(w * (s["x"] * s["x"] + s["y"] * s["y"] + s["z"] * s["z"])) / first["w"]).alias("var"),
    ).first()
    if not second["var"] > 1e-12:
        raise ValueError("the source points coincide")
    u, d, vt = np.linalg.svd(np.array([[second[a + b] for b in AXES] for a in AXES]))
    sign = np.array([1.0, 1.0, np.sign(np.linalg.det(u) * np.linalg.det(vt)) or 1.0])
    rotation = (u * sign) @ vt
    scale = float((d * sign).sum() / second["var"])
    if not scale > 0:
        raise ValueError("the scale is not positive")
    source, target = (np.array([first[f"{k}{a}"] for a in AXES]) for k in "st")
    shift = target - scale * rotation @ source
    r2 = F.lit(0.0)
    for i, a in enumerate(AXES):
        mapped = sum((F.col(f"s{b}") * float(scale * rotation[i, j]) for j, b in enumerate(AXES)), F.lit(float(shift[i])))
        r2 += (F.col(f"t{a}") - mapped) * (F.col(f"t{a}") - mapped)
    left = rows.agg(F.sqrt(F.sum(w * r2) / F.sum(w)).alias("rms"), F.sqrt(F.max(r2)).alias("most")).first()
    return {"rotation": rotation, "scale": scale, "translation": shift, "rms": left["rms"], "max_residual": left["most"], "count": first["n"]}


def confidence(rms: float, mean_weight: float, most: float = 0.05) -> float:
    return float(np.clip(np.exp(-rms / most), 0, 1)) * min(1.0, mean_weight)
