"""SimHash near-duplicates through deletion-variant signatures.

A fingerprint has 64 bits and two link at 2 or fewer differing bits. It is cut into two segments of
32 bits (classical blocking for 2 bits would need three exact ones): of any linked pair, one
segment differs in at most one bit. Each segment is indexed under its 32 variants, one bit position
wildcarded in each, so the pair meets under the variant that hides that bit. Meeting is an
equality on one long key; fingerprints that meet are verified.

Skew: equal fingerprints are collapsed before the index is built, so copies never meet. A segment
value that more than `hot` distinct fingerprints share would make large variant groups. Those
groups are keyed more finely, by the variant and a second wildcard in the other segment (or two
wildcards there): all members of such a group agree in 62 bits, so they are linked with no check
and a chain through them is enough. Both ways are exact, and their rows are linear in the input.

Nulls and empty texts have fingerprint zero and link like any other. Rows with a null doc_id are
kept; they never give a component its id unless all of its ids are null. Repeated rows each return
one row. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfield.llm.tables import pieces, salted
from lumenfield.operators.components import connected_components
from lumenfield.plans.scratch import materialize
from lumenfield.session import ship_package

SEED = 42
SHINGLE = 3
#: Distinct fingerprints that may share a segment before its variants are keyed more finely.
HOT = 512


def fingerprint(text: str | None, width: int = SHINGLE, block: int = 1 << 16) -> int:
    """The SimHash of a text as an unsigned integer; words split on ASCII white space, A-Z lowered."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) >= width:
        starts, ends = starts[: len(words) - width + 1], ends[width - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_digest
    ones, total = np.zeros(64, np.int64), len(starts)
    for at in range(0, total, block):
        spans = zip(starts[at : at + block].tolist(), ends[at : at + block].tolist(), strict=True)
        raw = np.frombuffer(b"".join([digest(joined[s:e], SEED) for s, e in spans]), np.uint8).reshape(-1, 8)
        ones += np.unpackbits(raw, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > total).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, 512):
            found = np.array([fingerprint(t) for t in part.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _runs(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[list[np.ndarray]]:
    """Columns of a stream sorted by its first one, regrouped so that no key is cut in two."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        cols = [batch.column(n).to_numpy(zero_copy_only=False) for n in names]
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
        if not len(cols[0]):
            continue
        cut = int(np.searchsorted(cols[0], cols[0][-1]))
        held = [c[cut:] for c in cols]
        if cut:
            yield [c[:cut] for c in cols]
    if held is not None:
        yield held


def _forest(pairs: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of the links within one group, those that keep it connected."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    keep = []
    for k, (i, j) in enumerate(zip(pairs[0].tolist(), pairs[1].tolist(), strict=True)):
        a, b = find(i), find(j)
        if a != b:
            root[b] = a
            keep.append(k)
    return pairs[0][keep], pairs[1][keep]


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp) sorted by key to links (a, b) of fingerprints within 2 bits.

    key: 38 bits of segment number, wildcard position and masked segment. A pair is taken only
    under its canonical key, so that it comes out once however many variants it shares.
    """
    for key, fp in _runs(batches, ("key", "fp")):
        order = np.lexsort((fp, key))
        key, fp = key[order], fp[order].view(np.uint64)
        left, right = [], []
        step = 1
        while True:  # neighbours at distance 1, 2, ... within their group: as many steps as the largest group has rows
            same = np.flatnonzero(key[step:] == key[:-step]) if step < len(key) else ()
            if not len(same):
                break
            x = fp[same] ^ fp[same + step]
            near = _popcount(x) <= 2
            i, x, k = same[near], x[near], key[same[near]]
            segment, wild = k >> 37, ((k >> 32) & 31).astype(np.uint64)
            high, low = x >> np.uint64(32), x & np.uint64(0xFFFFFFFF)
            own, other = np.where(segment == 0, high, low), np.where(segment == 0, low, high)
            first = np.where(own == 0, wild == 0, (own >> wild) & np.uint64(1) == 1)
            first &= (segment == 0) | (_popcount(other) == 2)
            left.append(i[first])
            right.append(i[first] + step)
            step += 1
        if left:
            a, b = np.concatenate(left), np.concatenate(right)
            if len(a):
                if len(a) > 64:
                    group = np.argsort(key[a], kind="stable")
                    a, b = a[group], b[group]
                    cuts = np.flatnonzero(np.diff(key[a])) + 1
                    kept = [_forest(p) for p in zip(np.split(a, cuts), np.split(b, cuts), strict=True)]
                    a, b = (np.concatenate(x) for x in zip(*kept, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(fp[a].view(np.int64)), pa.array(fp[b].view(np.int64))], ["a", "b"])


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp) sorted by key: each to the one before it under the same key."""
    last = None
    for batch in batches:
        cols = [batch.column(n).to_numpy(zero_copy_only=False) for n in ("k1", "k2", "fp")]
        if last is not None:
            cols = [np.concatenate(([v], c)) for v, c in zip(last, cols, strict=True)]
        if not len(cols[0]):
            continue
        last = [c[-1] for c in cols]
        same = np.flatnonzero((cols[0][1:] == cols[0][:-1]) & (cols[1][1:] == cols[1][:-1]) & (cols[2][1:] != cols[2][:-1]))
        if len(same):
            yield pa.RecordBatch.from_arrays([pa.array(cols[2][same + 1]), pa.array(cols[2][same])], ["a", "b"])


def links(fps: DataFrame, hot: int = HOT) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp), enough of them to connect all that are connected."""
    spark = fps.sparkSession
    mask = F.lit(0xFFFFFFFF)
    segments = fps.select(
        "fp",
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("seg"), F.shiftrightunsigned("fp", 32).alias("own"), F.col("fp").bitwiseAND(mask).alias("rest")),
                F.struct(F.lit(1).alias("seg"), F.col("fp").bitwiseAND(mask).alias("own"), F.shiftrightunsigned("fp", 32).alias("rest")),
            )
        ).alias("s"),
    ).select("fp", "s.*")
    crowded = segments.groupBy("seg", "own").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot).select("seg", "own")
    crowded = materialize(crowded, "crowded")
    bits = [1 << p for p in range(32)]
    if crowded.isEmpty():
        plain = segments.withColumn("fine", F.lit(0).cast("long"))
        finer = None
    else:
        # a variant is crowded if a crowded value is one of the two that it covers
        near = crowded.select(
            "seg",
            F.explode(
                F.array(
                    F.struct("own", F.lit(0xFFFFFFFF).alias("fine")),
                    *[F.struct(F.col("own").bitwiseXOR(F.lit(b)).alias("own"), F.lit(b).cast("long").alias("fine")) for b in bits],
                )
            ).alias("x"),
        ).select("seg", "x.*")
        near = near.groupBy("seg", "own").agg(F.bit_or("fine").alias("fine"))
        plain = segments.join(near, ["seg", "own"], "left").withColumn("fine", F.coalesce("fine", F.lit(0).cast("long")))
        plain = materialize(plain, "segments")
        finer = plain.filter("fine != 0")
    keyed = plain.select(
        "fp",
        F.explode(
            F.array(
                *[
                    F.when(
                        F.col("fine").bitwiseAND(F.lit(b)) == 0,
                        F.shiftleft(F.col("seg").cast("long"), 37)
                        .bitwiseOR(F.lit(p << 32))
                        .bitwiseOR(F.col("own").bitwiseAND(F.lit(0xFFFFFFFF ^ b))),
                    )
                    for p, b in enumerate(bits)
                ]
            )
        ).alias("key"),
    ).filter("key is not null")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = keyed.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_verify, "a long, b long")
    if finer is None:
        return found
    one = F.explode(F.sequence(F.lit(0), F.lit(31)))
    wild = finer.withColumn("p", one).filter("shiftrightunsigned(fine, p) & 1 = 1")
    cross = wild.withColumn("q", one).select(
        "fp",
        F.expr("(cast(seg as long) << 42) | (cast(p as long) << 37) | (own & ~shiftleft(1L, p))").alias("k1"),
        F.expr("(cast(q as long) << 37) | (rest & ~shiftleft(1L, q))").alias("k2"),
    )
    within = (
        # pairs that share the value itself meet under wildcard 0; neighbours of a crowded value may have lost it too
        finer.filter("fine & 1 = 1")
        .withColumn("p", one)
        .withColumn("q", one)
        .filter("p < q")
        .select(
            "fp",
            F.expr("(1L << 44) | (cast(seg as long) << 42) | own").alias("k1"),
            F.expr("(cast(p as long) << 37) | (cast(q as long) << 42) | (rest & ~shiftleft(1L, p) & ~shiftleft(1L, q))").alias("k2"),
        )
    )
    fine = cross.unionByName(within).repartition(parts, "k1", "k2").sortWithinPartitions("k1", "k2", "fp")
    return found.unionByName(fine.mapInArrow(_chain, "a long, b long"))


def near_duplicates(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(doc_id, fingerprint, component_id, fp): every row of docs with its fingerprint and its component's smallest doc_id."""
    ship_package(docs.sparkSession)
    prints = materialize(docs.select("doc_id", "text").mapInArrow(_fingerprints, "doc_id long, fp long"), "prints")
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    pairs = links(classes.select("fp"), hot)
    nodes = materialize(connected_components(pairs), "components")
    linked = classes.join(nodes, classes["fp"] == nodes["node"])
    best = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    merged = linked.join(best, "component").select("fp", "component_id")
    named = (
        classes.join(merged, "fp", "left")
        .select("fp", F.coalesce("component_id", "least").alias("component_id"))
    )
    return salted(prints, named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "fp"
    )
