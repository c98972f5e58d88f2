"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of passages.

Words are the runs of a text that are left when ASCII punctuation and white space are taken away
and A-Z are lowered. Every SEED consecutive words of a test item are a seed. Documents are scanned
for seeds whole, and a seed is rare if at most a share RARE of all documents, or FEW documents, hold
it, or if it is in the rarer half of an item's seeds, so that a passage that very many documents
hold is found in all of them. Where a document holds rare seeds of
an item, the passage around them, with as many words before and after as an alignment of the least
score can have, is aligned to the item
by Smith-Waterman on words: MATCH for equal words, MISMATCH and GAP otherwise. The passage around
other, common seeds is aligned too unless its words and the item's show that no alignment in it can
reach the least score asked for, so commonness hides no contaminated document; only scores under that
may be missing. An item's score in a document is the best alignment's score over that of the item with itself, between 0 and 1. A document
is contaminated if an item reaches LEAST. Items of SEED to 4 words have to be there word for word: half
of so few words is no copy. Items with fewer words than a seed are compared as one seed of their own
length; their score is then 1 if found.

The scan emits rows only for seeds, each carrying its positions; passages travel only for those. Test items are
broadcast, after their words are counted and found to be MAX_WORDS or fewer; a larger benchmark is
handled in parts of so many words, one scan for each. No rows are dropped: a group of hits is one
document's, and a document's hits are grouped where they are found, in its own task.

Null and empty texts hold nothing. Repeated rows and null doc_ids each return their own row. Items
that are null, empty or repeated are harmless: equal items share a score and the smallest item_id is
named; a null item_id is -1. Other columns are ignored. An empty benchmark leaves every document clean.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfield.llm.tables import pieces
from lumenfield.plans.scratch import materialize
from lumenfield.session import ship_package

SEED, RARE, FEW = 3, 0.002, 20
MATCH, MISMATCH, GAP = 2, -1, -1
#: Items of so many words or fewer count only where they are found whole.
SHORT = 4
LEAST, MAX_WORDS = 0.5, 2_000_000

_PLAIN = bytes(
    32 if b < 128 and not chr(b).isalnum() else b + 32 if 65 <= b <= 90 else b for b in range(256)
)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_PLAIN).split()


class Items:
    """Test items as rows of word numbers, and their seeds."""

    def __init__(self, texts: list[tuple[int, str]], seed: int = SEED):
        self.number: dict[bytes, int] = {}
        self.ids, self.rows = [], []
        known = set()
        for item, text in sorted(texts):
            row = [self.number.setdefault(w, len(self.number) + 1) for w in words(text)]
            if row and tuple(row) not in known:
                known.add(tuple(row))
                self.ids.append(item)
                self.rows.append(np.array(row, np.int64))
        self.seed, self.base = seed, len(self.number) + 1
        if self.base**seed >= 2**63:
            raise ValueError("too many words for seeds of this length")
        found: dict[int, list[tuple[int, int]]] = {}
        for k, row in enumerate(self.rows):
            for at, key in enumerate(self.keys(row).tolist()):
                found.setdefault(key, []).append((k, at))
        self.seeds = np.array(sorted(found), np.int64)
        self.places = [found[key] for key in self.seeds.tolist()]
        self.short = [k for k, row in enumerate(self.rows) if len(row) < seed]

    def keys(self, row: np.ndarray) -> np.ndarray:
        """Each place's seed as a number; negative where a word is in no item."""
        n = len(row) - self.seed + 1
        if n < 1:
            return np.zeros(0, np.int64)
        key, bad = np.zeros(n, np.int64), np.zeros(n, bool)
        for k in range(self.seed):
            part = row[k : k + n]
            key = key * self.base + part
            bad |= part == 0
        key[bad] = -1
        return key

    def rare(self, frequency: np.ndarray, most: int) -> np.ndarray:
        """Whether a seed's passages are aligned in any case: if it is rare, or in the rarer half of some item's seeds."""
        usable = frequency <= most
        for row in self.rows:
            own = np.searchsorted(self.seeds, self.keys(row))
            if len(own):
                usable[own] |= frequency[own] <= np.median(frequency[own])
        return usable

    def scan(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The text's words as numbers (0: in no item), places of seeds, and which seeds."""
        own = words(text)
        row = np.fromiter(map(self.number.get, own, [0] * len(own)), np.int64, len(own))
        key = self.keys(row)
        at = np.flatnonzero(key >= 0)
        if not len(at) or not len(self.seeds):
            return row, at[:0], at[:0]
        slot = np.minimum(np.searchsorted(self.seeds, key[at]), len(self.seeds) - 1)
        hit = self.seeds[slot] == key[at]
        return row, at[hit], slot[hit]


def smith_waterman(passages: list[np.ndarray], items: list[np.ndarray]) -> np.ndarray:
    """Best local alignment score of each passage with its item, all together.

    One step a word of the items. A gap in the item depends on the row itself; since a gap costs
    the same for every word, the best start of one is a running maximum.
    """
    wide, tall = max(map(len, passages)), max(map(len, items))
    p = np.full((len(passages), wide), -1, np.int64)
    q = np.full((len(items), tall), -2, np.int64)
    for k, (a, b) in enumerate(zip(passages, items, strict=True)):
        p[k, : len(a)], q[k, : len(b)] = a, b
    # words in no item differ from everything
    p[p == 0] = -1
    row = np.zeros((len(p), wide + 1), np.int32)
    best = np.zeros(len(p), np.int32)
    slope = np.arange(wide + 1, dtype=np.int32) * -GAP
    for i in range(tall):
        fresh = np.zeros_like(row)
        fresh[:, 1:] = np.maximum(row[:, :-1] + np.where(p == q[:, i : i + 1], MATCH, MISMATCH), row[:, 1:] + GAP)
        np.maximum(fresh, 0, out=fresh)
        fresh = np.maximum.accumulate(fresh + slope, axis=1) - slope
        row = np.where((q[:, i] >= 0)[:, None], fresh, row).astype(np.int32)
        np.maximum(best, row.max(1), out=best)
    return best


def _most(own: np.ndarray) -> int:
    """The highest sum of a stretch of words, where a word counts MATCH or, if it has no equal, the least cost."""
    total = np.cumsum(np.where(own, MATCH, max(MISMATCH, GAP)))
    return int((total - np.minimum.accumulate(np.concatenate(([0], total)))[:-1]).max(initial=0))


def _could(passage: np.ndarray, item: np.ndarray, known: np.ndarray, need: float) -> bool:
    """Whether an alignment might score `need`: a word on either side matches only if the other side has it.

    known is scratch space, false for every word number.
    """
    known[item] = True
    some = _most(known[passage]) >= need
    known[item] = False
    if some:
        known[passage] = True
        known[0] = False
        some = _most(known[item]) >= need
        known[passage] = False
    return some


def _regions(places: np.ndarray, length: int, end: int, least: float) -> list[tuple[int, int]]:
    """Passages of a document around an item's seeds; those that overlap are one, split when long.

    An alignment that scores `least` has at most 2 length (1 - least) words more than the item: each costs
    GAP, and all matches together are worth MATCH length.
    """
    length += math.ceil(MATCH * length * max(0.0, 1 - least) / -GAP)
    spans: list[list[int]] = []
    for at in places.tolist():
        lo, hi = max(0, at - length), min(end, at + length + SEED)
        if spans and lo <= spans[-1][1] and hi - spans[-1][0] <= 8 * length + 64:
            spans[-1][1] = hi
        else:
            spans.append([lo, hi])
    return [(a, b) for a, b in spans]


def _hits(docs: DataFrame, sent: object, rows: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            for part in pieces(batch, rows):
                rids, seeds, places, lines = [], [], [], []
                for rid, text in zip(part.column("rid").to_pylist(), part.column("text").to_pylist(), strict=True):
                    row, at, slot = own.scan(text)
                    short = [k for k in own.short if _holds(row, own.rows[k])]
                    if len(at) or short:
                        rids.append(rid)
                        seeds.append(np.concatenate((slot, -1 - np.array(short, np.int64))).astype(np.int64))
                        places.append(at.astype(np.int64))
                        lines.append(row.astype(np.int32))
                if rids:
                    arrays = [pa.array(rids, pa.int64()), *(pa.array(x, pa.list_(t)) for x, t in ((seeds, pa.int64()), (places, pa.int64()), (lines, pa.int32())))]
                    yield pa.RecordBatch.from_arrays(arrays, ["rid", "seeds", "places", "row"])

    return docs.select("rid", "text").mapInArrow(run, "rid long, seeds array<long>, places array<long>, row array<int>")


def _holds(row: np.ndarray, item: np.ndarray) -> bool:
    n = len(row) - len(item) + 1
    return n > 0 and bool(np.logical_and.reduce([row[k : k + n] == w for k, w in enumerate(item)]).any())


def _aligned(hits: DataFrame, items: object, rare: object, least: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, usable = items.value, rare.value
        known = np.zeros(own.base, bool)
        for batch in batches:
            out: dict[tuple[int, int], float] = {}
            jobs = []
            for rid, seeds, places, row in zip(*(batch.column(n) for n in ("rid", "seeds", "places", "row")), strict=True):
                rid = rid.as_py()
                seeds, places, row = (np.array(x.values) for x in (seeds, places, row))
                for k in (-1 - seeds[seeds < 0]).tolist():
                    out[rid, k] = 1.0
                at: dict[int, tuple[list[int], list[int]]] = {}
                for seed, place in zip(seeds.tolist(), places.tolist(), strict=False):
                    for k, _ in own.places[seed]:
                        at.setdefault(k, ([], []))[0 if usable[seed] else 1].append(place)
                for k, found in at.items():
                    item = own.rows[k]
                    sure, more = (_regions(np.array(x, np.int64), len(item), len(row), least) for x in found)
                    jobs += [(rid, k, row[a:b]) for a, b in sure]
                    for a, b in more:
                        if not any(lo <= a and b <= hi for lo, hi in sure) and _could(row[a:b], item, known, least * MATCH * len(item)):
                            jobs.append((rid, k, row[a:b]))
            jobs.sort(key=lambda x: (len(x[2]), len(own.rows[x[1]])))
            for first in range(0, len(jobs), 256):
                some = jobs[first : first + 256]
                score = smith_waterman([x[2] for x in some], [own.rows[x[1]] for x in some])
                for (rid, k, _), s in zip(some, score.tolist(), strict=True):
                    out[rid, k] = max(out.get((rid, k), 0.0), s / (MATCH * len(own.rows[k])))
            if out:
                rid, k = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rid, pa.int64()), pa.array([own.ids[x] for x in k], pa.int64()), pa.array([len(own.rows[x]) for x in k], pa.int32()), pa.array(list(out.values()), pa.float64())],
                    ["rid", "item_id", "n_words", "score"],
                )

    return hits.mapInArrow(run, "rid long, item_id long, n_words int, score double")


def _parts(benchmark: DataFrame, most: int) -> Iterator[list[tuple[int, str]]]:
    """Test items in parts of at most so many words, of bounded size each; one at least."""
    held, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null")
    for row in rows.orderBy(F.col("item_id").asc_nulls_last(), "text").toLocalIterator():
        n = len(words(row["text"]))
        if held and size + n > most:
            yield held
            held, size = [], 0
        held.append((-1 if row["item_id"] is None else row["item_id"], row["text"]))
        size += n
    yield held


def scores(docs: DataFrame, benchmark: DataFrame, max_words: int = MAX_WORDS, rows: int = 512, least: float = LEAST) -> DataFrame:
    """(rid, item_id, n_words, score): items that documents (columns rid, text) hold passages of; all scores of `least` or more."""
    spark = docs.sparkSession
    total = docs.count()
    most = max(FEW, int(RARE * total))
    found = None
    for texts in _parts(benchmark, max_words):
        items = Items(texts)
        sent = spark.sparkContext.broadcast(items)
        hits = materialize(_hits(docs, sent, rows), "hits")
        held = hits.select(F.explode(F.array_distinct("seeds")).alias("seed")).groupBy("seed").agg(F.count(F.lit(1)).alias("n"))
        frequency = np.zeros(max(1, len(items.seeds)), np.int64)
        # at most as many rows as the items have seeds
        for row in held.filter((F.col("n") > most) & (F.col("seed") >= 0)).toLocalIterator():
            frequency[row["seed"]] = row["n"]
        usable = items.rare(frequency, most)
        some = _aligned(hits, sent, spark.sparkContext.broadcast(usable), least)
        found = some if found is None else found.unionByName(some)
    return found


def decontaminate(docs: DataFrame, benchmark: DataFrame, least: float = LEAST, max_words: int = MAX_WORDS) -> DataFrame:
    """docs (all columns) with contaminated, and contaminating_item and contamination of the best item.

    Columns of these names are replaced.
    """
    ship_package(docs.sparkSession)
    docs = docs.drop("contaminated", "contaminating_item", "contamination")
    names = docs.columns
    numbered = docs.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("row"), F.col("text"), F.monotonically_increasing_id().alias("rid"))
    numbered = materialize(numbered, "numbered")
    found = scores(numbered.select("rid", "text"), benchmark, max_words, least=least).filter((F.col("n_words") > SHORT) | (F.col("score") >= 1))
    best = found.groupBy("rid").agg(F.max(F.struct("score", (-F.col("item_id")).alias("item"))).alias("b"))
    best = best.select(F.col("rid").alias("hit"), F.col("b.score").alias("best_score"), (-F.col("b.item")).alias("best_item"))
    return numbered.join(best, F.col("rid") == F.col("hit"), "left").select(
        "row.*",
        (F.coalesce("best_score", F.lit(0.0)) >= least).alias("contaminated"),
        F.col("best_item").alias("contaminating_item"),
        F.coalesce("best_score", F.lit(0.0)).alias("contamination"),
    )
