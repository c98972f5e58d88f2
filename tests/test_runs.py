"""Masks as runs against flood fills and pixel arrays; frames at a fixed rate, in batch and as a stream."""

from __future__ import annotations

import random
import tempfile

import numpy as np
from pyspark.sql import functions as F

from lumenfield.functions import masks
from lumenfield.operators import runs, temporal
from lumenfield.streaming.decimate import decimate_stream


def flood(mask: np.ndarray) -> list[set]:
    left, out = set(zip(*np.nonzero(mask), strict=True)), []
    while left:
        todo = [left.pop()]
        own = set(todo)
        while todo:
            y, x = todo.pop()
            near = {(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)} & left
            left -= near
            own |= near
            todo += near
        out.append({(int(y), int(x)) for y, x in own})
    return out


def pixels_of(rows) -> dict:
    out: dict = {}
    for r in rows:
        out.setdefault(r["mask"], set()).update((y, r["x"]) for y in range(r["y0"], r["y1"] + 1))
    return out


def some_masks() -> dict[int, np.ndarray]:
    rng = np.random.default_rng(3)
    out = {k: rng.random((rng.integers(1, 14), rng.integers(1, 14))) < p for k, p in enumerate((0.1, 0.3, 0.5, 0.7, 0.9) * 3)}
    return out | {90: np.zeros((4, 5), bool), 91: np.ones((3, 4), bool), 92: np.eye(6, dtype=bool)}


def test_components_holes_and_islands(spark):
    own = some_masks()
    table = spark.createDataFrame([(k, masks.encode(m), *m.shape) for k, m in own.items()], "id long, counts array<long>, height int, width int")
    sizes = table.select(F.col("id").alias("mask"), "width", "height")
    cut = runs.from_counts(table, "id", "counts", "height")
    assert pixels_of(cut.collect()) == {k: {(int(y), int(x)) for y, x in zip(*np.nonzero(m), strict=True)} for k, m in own.items() if m.any()}
    flat = spark.createDataFrame([(k, int(x), int(y)) for k, m in own.items() for y, x in zip(*np.nonzero(m), strict=True)] * 2, "m long, x long, y long")
    assert pixels_of(runs.from_pixels(flat, "m", "x", "y").collect()) == pixels_of(cut.collect())
    parts: dict = {}
    for r in runs.components(cut).collect():
        parts.setdefault((r["mask"], r["component"], r["area"]), set()).update((y, r["x"]) for y in range(r["y0"], r["y1"] + 1))
    for k, m in own.items():
        got = sorted(sorted(v) for (mask, _, _), v in parts.items() if mask == k)
        assert got == sorted(sorted(s) for s in flood(m))
    assert all(a == len(v) for (_, _, a), v in parts.items())
    kept, changed = runs.drop_islands(cut, 4)
    filled, holes = runs.fill_holes(cut, sizes, 4)
    kept, filled = pixels_of(kept.collect()), pixels_of(filled.collect())
    changed, holes = ({r["mask"]: r["changed"] for r in x.collect()} for x in (changed, holes))
    for k, m in own.items():
        large = [s for s in flood(m) if len(s) >= 4]
        if m.any():
            assert changed[k] == any(len(s) < 4 for s in flood(m))
            if large:
                assert kept[k] == set().union(*large)
            else:
                assert len(kept[k]) == max(map(len, flood(m)))
        small = [s for s in flood(~m) if len(s) < 4]
        want = {(int(y), int(x)) for y, x in zip(*np.nonzero(m), strict=True)}.union(*small)
        assert filled.get(k, set()) == want and holes[k] == bool(small)
    boxes = {r["mask"]: tuple(r)[1:] for r in runs.box(cut, sizes).collect()}
    assert boxes[90] == (5, 4, -1, -1) and boxes[92] == (0, 0, 5, 5)
    assert runs.components(cut.limit(0)).count() == 0


def brute_text(counts: list[int]) -> str:
    out = ""
    for i, n in enumerate(counts):
        x = n - (counts[i - 2] if i > 2 else 0)
        more = True
        while more:
            c = x & 31
            x >>= 5
            more = x != -1 if c & 16 else x != 0
            out += chr((c | 32 if more else c) + 48)
    return out


def test_overlap_and_text(spark):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(120):
        shape = (int(rng.integers(1, 30)), int(rng.integers(1, 30)))
        a, b = (rng.random(shape) < p for p in rng.random(2))
        rows.append((k, masks.encode(a), masks.encode(b), float((a & b).sum() / max(1, (a | b).sum())), brute_text(masks.encode(a))))
    rows += [(200, [0, 10_000_000, 3, 123_456_789, 5], [10], 0.0, brute_text([0, 10_000_000, 3, 123_456_789, 5])), (201, [], [], 0.0, "")]
    table = spark.createDataFrame(rows, "id long, a array<long>, b array<long>, want double, text string")
    got = table.select("*", runs.iou(F.col("a"), F.col("b")).alias("iou"), runs.to_text(F.col("a")).alias("own"), runs.from_text(F.col("text")).alias("back")).collect()
    for r in got:
        assert np.isclose(r["iou"], r["want"]) or r["id"] == 200
        assert r["own"] == r["text"] and r["back"] == r["a"]
    # lengths 6, 1, 40, 4, 5, 4, 5, 4, 21: as the format's authors write it
    published = spark.createDataFrame([([6, 1, 40, 4, 5, 4, 5, 4, 21],)], "c array<long>")
    assert published.select(runs.to_text(F.col("c"))).first()[0] == "61X13mN000`0"


def accumulate(times: list[float], interval: float) -> list[float]:
    out, following = [], times[0]
    for t in times:
        if t >= following:
            out.append(t)
            following += interval
    return out


def test_decimation_in_batch_and_as_a_stream(spark):
    rng = random.Random(5)
    rows = []
    for k in range(12):
        t = float(rng.randint(0, 9))
        for n in range(rng.randint(1, 60)):
            rows.append((k, t, n < k))
            t += rng.choice([0.25, 0.5, 1.0, 1.0, 7.0, 30.0])
    frames = spark.createDataFrame(rows, "clip long, t double, dark boolean")
    want = {k: accumulate([t for c, t, _ in rows if c == k], 2.0) for k in range(12)}
    got: dict = {}
    for r in temporal.decimate_accumulating(frames, "clip", "t", 2.0, ["t"]).orderBy("clip", "t").collect():
        got.setdefault(r["clip"], []).append(r["t"])
    assert got == want
    lit = {k: accumulate(own, 2.0) if (own := [t for i, (t, d) in enumerate((t, d) for c, t, d in rows if c == k) if not d or i >= 5]) else [] for k in range(12)}
    with tempfile.TemporaryDirectory() as root:
        cuts = sorted(t for _, t, _ in rows)
        for n, (lo, hi) in enumerate([(0, 10), (10, 40), (40, 1e9)]):
            frames.filter((F.col("t") >= lo) & (F.col("t") < hi)).coalesce(1).write.parquet(f"{root}/in/{n}")
        assert cuts
        for name, dark in (("plain", None), ("lit", "dark")):
            stream = spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{root}/in/*")
            out = decimate_stream(stream, "clip", "t", 2.0, dark, 5)
            run = out.writeStream.format("memory").queryName(f"taken_{name}").option("checkpointLocation", f"{root}/state-{name}").trigger(availableNow=True).start()
            run.awaitTermination()
            found: dict = {}
            for r in spark.table(f"taken_{name}").orderBy("clip", "t").collect():
                found.setdefault(r["clip"], []).append(r["t"])
            assert found == {k: v for k, v in (want if not dark else lit).items() if v}
