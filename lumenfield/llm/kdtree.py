"""Shards of near equal bytes from a k-d tree over document metadata, in DataFrame operations only.

A node that still holds several shards' bytes is split: along the metadata dimension that is widest
within it, at the weighted median (or at 1/3, 2/5, ... where an odd number of shards is left). A
dimension's value takes the high 20 bits of a 62-bit key, a hash of doc_id the next 30 and a row
number the low 12, so that a value that many rows share, such as a hot source, can be cut anywhere.
The median is found by histograms: the key range of a node is counted in 4,096 bins, then the bin
that the median falls into, until that bin weighs next to nothing. All nodes of a level share each
pass, a pass is one map-side combined aggregation over a narrow table, and the driver sees at most
4,096 rows a node.

Law: "bytes". Equal texts are a group only in that they have one text_crc32: the law is about sizes, so
copies lie wherever their metadata puts them, and a group larger than a shard can be cut. Size is the text's UTF-8 bytes plus 1; null texts have size 1, empty texts too. Null
metadata counts as least. Repeated rows and null doc_ids keep their rows, each in one shard. An
empty table gives no rows. Columns named as metadata but missing are not used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfield.plans.scratch import materialize

BINS = 4096
#: A splitting bin may weigh so much of one shard's bytes.
EXACT = 1e-3
_TOP = (1 << 20) - 1


def _dimension(df: DataFrame, name: str) -> Column:
    """A metadata column as an integer to be scaled: numbers as they are, others by hash."""
    if dict(df.dtypes)[name] in ("tinyint", "smallint", "int", "bigint", "float", "double"):
        value = F.col(name).cast("double")
        # numbers that are none count as null, infinite ones as the ends of the range of whole numbers
        return F.coalesce(F.when(~F.isnan(value), F.least(F.greatest(value, F.lit(-(2.0**62))), F.lit(2.0**62))), F.lit(0.0))
    return F.coalesce(F.crc32(F.col(name).cast("string").cast("binary")).cast("double"), F.lit(0.0))


def _cases(pairs: list[tuple[int, object]], of: Column, otherwise: object) -> Column:
    """A literal lookup over the few nodes of the tree."""
    if not pairs:
        return F.lit(otherwise)
    out = F.when(of == pairs[0][0], F.lit(pairs[0][1]))
    for key, value in pairs[1:]:
        out = out.when(of == key, F.lit(value))
    return out.otherwise(F.lit(otherwise))


def shards(docs: DataFrame, count: int = 16, dimensions: tuple[str, ...] = ("source", "lang", "n_chars", "doc_id"), block_rows: int = 1 << 18) -> DataFrame:
    """doc_id, size, text_crc32, law, shard (0 to count - 1), slot (gapless from 0), grown_shard (null)."""
    present = [d for d in dimensions if d in docs.columns]
    base = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        *[_dimension(docs, d).alias(f"m{k}") for k, d in enumerate(present)],
    ).withColumn("rid", F.monotonically_increasing_id())
    base = materialize(base, "sizes")
    bounds = base.agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("size").alias("total"),
        *[f(f"m{k}").alias(f"{n}{k}") for k in range(len(present)) for n, f in (("lo", F.min), ("hi", F.max))],
    ).first()
    total = bounds["total"] or 0
    tie = F.shiftleft(F.xxhash64("doc_id").bitwiseAND((1 << 30) - 1), 12).bitwiseOR(F.xxhash64("rid").bitwiseAND(4095))
    scaled = []
    for k in range(len(present)):
        lo, hi = bounds[f"lo{k}"], bounds[f"hi{k}"]
        whole = F.lit(0).cast("long") if not total or hi <= lo else F.floor((F.col(f"m{k}") - lo) * (_TOP / (hi - lo)))
        scaled.append(F.least(whole.cast("long"), F.lit(_TOP).cast("long")).alias(f"d{k}"))
    rows = base.select("doc_id", "size", "text_crc32", tie.alias("tie"), *(scaled or [F.lit(0).cast("long").alias("d0")]))
    width = max(1, len(scaled))
    key = [F.shiftleft(F.col(f"d{k}"), 42).bitwiseOR(F.col("tie")) for k in range(width)]

    # nodes are (first shard, shards); each level's rows are written with their node, narrow as they are
    rows = materialize(rows.withColumn("node", F.lit(0)), "level")
    node = F.col("node")
    open_nodes = [(0, count)] if total else []
    while any(n > 1 for _, n in open_nodes):
        active = [(s, n) for s, n in open_nodes if n > 1]
        placed = rows.filter(node.isin([s for s, _ in active]))
        spans = {
            r["node"]: r
            for r in placed.groupBy("node")
            .agg(F.sum("size").alias("w"), *[f(f"d{k}").alias(f"{n}{k}") for k in range(width) for n, f in (("lo", F.min), ("hi", F.max))])
            .collect()
        }
        state = {}
        for s, n in active:
            if s not in spans:
                continue
            r = spans[s]
            axis = max(range(width), key=lambda k: (r[f"hi{k}"] - r[f"lo{k}"], -k))
            low, high = r[f"lo{axis}"] << 42, (r[f"hi{axis}"] + 1) << 42
            state[s] = {"axis": axis, "low": low, "high": high, "goal": r["w"] * (n // 2) / n, "below": 0, "tiny": r["w"] / n * EXACT, "cut": None}
        while any(x["cut"] is None for x in state.values()):
            todo = [(s, x) for s, x in state.items() if x["cut"] is None]
            own = _cases([(s, x["axis"]) for s, x in todo], F.col("node"), 0)
            value = F.when(own == 0, key[0])
            for k in range(1, width):
                value = value.when(own == k, key[k])
            low = _cases([(s, x["low"]) for s, x in todo], F.col("node"), 0)
            high = _cases([(s, x["high"]) for s, x in todo], F.col("node"), 0)
            step = _cases([(s, max(1, -(-(x["high"] - x["low"]) // BINS))) for s, x in todo], F.col("node"), 1)
            seen = placed.filter(F.col("node").isin([s for s, _ in todo])).select("node", "size", value.alias("key"), low.alias("low"), high.alias("high"), step.alias("step"))
            seen = seen.filter("key >= low and key < high").groupBy("node", F.expr("(key - low) div step").alias("bin"))
            bins: dict[int, list[tuple[int, int]]] = {}
            for r in seen.agg(F.sum("size").alias("w")).collect():
                bins.setdefault(r["node"], []).append((r["bin"], r["w"]))
            for s, x in todo:
                step_of, sum_below = max(1, -(-(x["high"] - x["low"]) // BINS)), x["below"]
                for b, w in sorted(bins[s]):
                    if sum_below + w >= x["goal"]:
                        break
                    sum_below += w
                start = x["low"] + b * step_of
                if w <= x["tiny"] or step_of == 1:
                    # the cut goes to whichever end of the bin is nearer to the goal
                    x["cut"] = start if x["goal"] - sum_below < sum_below + w - x["goal"] else start + step_of
                else:
                    x["low"], x["high"], x["below"] = start, min(x["high"], start + step_of), sum_below
        moved = F.when(F.lit(False), F.lit(0))
        for s, n in active:
            open_nodes.remove((s, n))
            open_nodes += [(s, n // 2), (s + n // 2, n - n // 2)]
            if s in state:
                moved = moved.when((node == s) & (key[state[s]["axis"]] >= state[s]["cut"]), F.lit(s + n // 2))
        rows = materialize(rows.withColumn("node", F.coalesce(moved, node)), "level")
    # as many blocks as the rows ask for, and then some, so that tasks stay of one size
    blocks = max(16, -(-bounds["rows"] // (count * block_rows)))
    # slots: numbers within blocks of a shard, after the blocks before; one row for every block_rows documents is broadcast
    placed = rows.select("doc_id", "size", "text_crc32", node.alias("shard"), F.pmod(F.xxhash64("tie", "doc_id"), F.lit(blocks)).alias("block"), "tie")
    sizes = placed.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select(
        "shard",
        "block",
        F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
    )
    within = F.row_number().over(Window.partitionBy("shard", "block").orderBy("doc_id", "text_crc32", "tie"))
    return (
        placed.withColumn("within", within)
        .join(F.broadcast(before), ["shard", "block"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            F.col("shard").cast("int").alias("shard"),
            (F.col("before") + F.col("within") - 1).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
