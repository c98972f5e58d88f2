"""Phrases whose words stand together more often than their parts would by chance.

A phrase is 2 to DEPTH words next to each other within a piece of text; all counts are per lang. The
words of each shard (a block of the texts of one lang, read in one task) become a count trie, one
level a pass. A level of a shard is serialised sorted, in ranges of prefixes: one row a range holds
the range's nodes and counts, packed. The rows of a range from all shards are merged, frequent nodes
get a number, and each shard is told which of its nodes stay and their numbers. A node is the pair of
two nodes one level up that stay and stand one word apart: its parent, the phrase without the last
word, and its suffix link, the phrase without the first. So no phrase is counted whose first or last
part is rare, and such can't be frequent. What a shard keeps of its text are the numbers of nodes
that stay, word by word. Walking up a frequent phrase's parents gives the counts of its left parts,
following its suffix links those of its right parts; each is one join with the level before.

Only packed counts of shards are shuffled, never single occurrences, so a word that is everywhere is
as cheap as any other. A range is the prefixes with parents of one range, cut in SLICES by the suffix
link, so that not even the phrases of one first word have to be in one task; there are more ranges in
larger tables.

Upper-case A-Z count as lower-case. Null texts are empty; a null lang is "und". Rows are counted as
often as they are there; doc_id and other columns are ignored. Empty tables, and those in which
nothing is frequent, give no rows. A text longer than a block is cut between pieces; what a task holds
is bounded by a block or the longest piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfield.llm.tables import pieces
from lumenfield.plans.scratch import drop_path, materialize, materialize_at
from lumenfield.session import ship_package

DEPTH, LEAST, TOP = 5, 100, 2000
#: A longer phrase with so many hundredths of a phrase's occurrences takes its place.
COVERED = 100
#: Bytes of text of one lang in a block.
BLOCK = 1 << 23
#: Ranges of a level (for a lang): at least RANGES, and one for so many words; each range of parents is cut in SLICES.
RANGES, SLICES, WORDS = 64, 8, 1 << 24
#: What shards write: rows of a range's nodes (range at least 0), and one with what the shard keeps of its text (range -1).
SHARD = "shard string, lang string, range int, size long, words long, data binary, more binary"
#: What merging writes: frequent nodes (id), and what a shard is told of a range (shard).
MERGED = "lang string, range int, id long, parent long, link long, word string, f long, shard string, data binary, more binary"

_END = b"\xff"
_ENDS = bytes.maketrans(b".,;:!?\x0a\x0b\x0c\x0d", _END * 10)
_ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
_SHARD, _MERGED = (pa.schema([(c.split()[0], _ARROW[c.split()[1]]) for c in x.split(", ")]) for x in (SHARD, MERGED))


def _pack(values: np.ndarray, kind: str) -> bytes:
    """Numbers of one width, their bytes of one weight together, compressed, after their count."""
    raw = np.ascontiguousarray(values.astype(kind)).view(np.uint8).reshape(len(values), np.dtype(kind).itemsize).T.tobytes()
    return len(values).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(data: bytes, kind: str) -> np.ndarray:
    n, width = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    raw = pa.decompress(data[8:], decompressed_size=n * width, codec="zstd", asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, n).T).view(kind).reshape(n).astype(np.int64)


def _pack_pairs(parent: np.ndarray, link: np.ndarray) -> bytes:
    """Pairs sorted by parent: how much these grow, and the links."""
    first = _pack(np.diff(parent, prepend=0), "<i8")
    return len(first).to_bytes(8, "little") + first + _pack(link, "<i8")


def _unpack_pairs(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    size = 8 + int.from_bytes(data[:8], "little")
    return np.cumsum(_unpack(data[8:size], "<i8")), _unpack(data[size:], "<i8")


def _rows(schema: pa.Schema, columns: dict[str, list | pa.Array], n: int) -> pa.Table:
    return pa.Table.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


def _shard_rows(shard: str, lang: str, words: int, kept: tuple[bytes, bytes, int], ranges: list[tuple[int, int, bytes, bytes]]) -> pa.Table:
    """The row of what the shard keeps, and those of its ranges (range, nodes, keys, counts)."""
    n = 1 + len(ranges)
    columns = {"shard": [shard] * n, "lang": [lang] * n, "range": [-1, *(r[0] for r in ranges)], "size": [kept[2], *(r[1] for r in ranges)]}
    return _rows(_SHARD, columns | {"words": [words] + [0] * (n - 1), "data": [kept[0], *(r[2] for r in ranges)], "more": [kept[1], *(r[3] for r in ranges)]}, n)


def _cuts(of: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, first, end) of each run of a sorted array."""
    first = np.flatnonzero(np.diff(of, prepend=-1))
    return list(zip(of[first].tolist(), first.tolist(), np.append(first, len(of))[1:].tolist(), strict=True))


def first_level(shard: str, lang: str, text: bytes, ranges: int) -> pa.Table:
    """A shard's words, from lower-case text whose pieces end with _END; a word's range is by its hash."""
    coded = pa.array(text.replace(_END, b" " + _END + b" ").split(), pa.binary()).dictionary_encode()
    words = coded.dictionary.to_pylist()
    own = np.array([-1 if w == _END else zlib.crc32(w) % ranges for w in words], np.int64)
    by_word = np.empty(len(words), np.int64)
    by_word[pc.array_sort_indices(coded.dictionary).to_numpy()] = np.arange(len(words))
    order = np.lexsort((by_word, own))
    number = np.empty(len(words), np.int64)
    ends = int((own < 0).sum())  # the end of a piece is number 0, nodes are 1, 2, ...
    number[order] = np.arange(len(words)) + 1 - ends
    stream = number[coded.indices.to_numpy(zero_copy_only=False)]
    order = order[ends:]
    counts = np.bincount(stream, minlength=len(order) + 1)[1:]
    found = [(r, b - a, _END.join([words[k] for k in order[a:b]]), _pack(counts[a:b], "<i4")) for r, a, b in _cuts(own[order])]
    return _shard_rows(shard, lang, int(counts.sum()), (_pack(stream, "<i4"), b"", len(order)), found)


def _pairs(stream: np.ndarray, ids: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a stream of 1, 2, ... (numbers of ids) and 0: nodes one word longer, as a stream, and their ranges, parents, links and counts.

    Nodes are sorted by range, parent and link.
    """
    parent, link = stream[:-1], stream[1:]
    both = (parent > 0) & (link > 0)
    codes, place, counts = np.unique(parent[both] * (len(ids) + 1) + link[both], return_inverse=True, return_counts=True)
    a, b = np.divmod(codes, len(ids) + 1)
    a, b = ids[a - 1], ids[b - 1]
    # the range of the parent's number, and the slice of the link's
    own = (a >> 32) % ranges // SLICES * SLICES + ((b.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) % SLICES
    order = np.argsort(own, kind="stable")
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(1, len(order) + 1)
    longer = np.zeros(len(parent), np.int64)
    longer[both] = number[place]
    return longer, own[order], a[order], b[order], counts[order]


def next_level(told: pa.Table, kept: pa.Table, ranges: int, deep: bool) -> pa.Table:
    """A shard's nodes one word longer than those it was told of, and what it keeps for them; deep: what is kept are pairs."""
    if not told.num_rows or not kept.num_rows:
        return _SHARD.empty_table()
    row = kept.slice(0, 1).to_pylist()[0]
    stream, size = _unpack(row["data"], "<i4"), row["size"]
    if deep:
        stream, own, *_ = _pairs(stream, np.cumsum(_unpack(row["more"], "<i8")), ranges)
        start, size = {r: a for r, a, _ in _cuts(own)}, len(own)
    ids, at = np.zeros(size + 1, np.int64), 1
    for r in sorted(told.select(["range", "data", "more"]).to_pylist(), key=lambda r: r["range"]):
        stay = np.unpackbits(np.frombuffer(r["data"][8:], np.uint8), count=int.from_bytes(r["data"][:8], "little")).astype(bool)
        at = 1 + start[r["range"]] if deep else at
        ids[at : at + len(stay)][stay] = (r["range"] << 32) + np.cumsum(_unpack(r["more"], "<i4"))
        at += len(stay)
    stream = ids[stream]
    # of a run of words without a node one is enough
    stream = stream[(stream > 0) | (np.append(0, stream[:-1]) > 0)]
    ids = np.unique(ids[ids > 0])
    stream = np.where(stream > 0, np.searchsorted(ids, stream) + 1, 0)
    _, own, a, b, counts = _pairs(stream, ids, ranges)
    found = [(r, y - x, _pack_pairs(a[x:y], b[x:y]), _pack(counts[x:y], "<i4")) for r, x, y in _cuts(own)]
    return _shard_rows(row["shard"], row["lang"], 0, (_pack(stream, "<i4"), _pack(np.diff(ids, prepend=0), "<i8"), len(ids)), found)


def merge(rows: pa.Table, least: int, deep: bool) -> pa.Table:
    """One range of a level from all its shards: the nodes with `least` occurrences, numbered in order, and each shard's share of them.

    A shard is told of all ranges that it has, also where nothing stays.
    """
    lang, number = rows.column("lang")[0].as_py(), rows.column("range")[0].as_py()
    shards, sizes = rows.column("shard").to_pylist(), np.array(rows.column("size").to_pylist(), np.int64)
    counts = np.concatenate([_unpack(x, "<i4") for x in rows.column("more").to_pylist()])
    if deep:
        a, b = (np.concatenate(x) for x in zip(*map(_unpack_pairs, rows.column("data").to_pylist()), strict=True))
        order = np.lexsort((b, a))
        new = np.append(True, (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0))
    else:
        words = pa.array([w for x in rows.column("data").to_pylist() for w in x.split(_END)], pa.binary()).dictionary_encode()
        by_word = np.empty(len(words.dictionary), np.int64)
        by_word[pc.array_sort_indices(words.dictionary).to_numpy()] = np.arange(len(by_word))
        a = by_word[words.indices.to_numpy(zero_copy_only=False)]
        order = np.argsort(a, kind="stable")
        new = np.append(True, np.diff(a[order]) != 0)
    first = np.flatnonzero(new)
    total = np.add.reduceat(counts[order], first)
    stays = total >= least
    rank = np.where(stays, np.cumsum(stays), 0)
    own = np.empty(len(order), np.int64)
    own[order] = rank[np.cumsum(new) - 1]
    some = order[first[stays]]
    n = len(some)
    nodes = {"lang": [lang] * n, "range": [number] * n, "id": (number << 32) + np.arange(1, n + 1), "f": total[stays]}
    nodes |= {"parent": a[some], "link": b[some]} if deep else {"word": words.take(pa.array(some)).dictionary_decode().cast(pa.string())}
    told: list[tuple[bytes, bytes]] = []
    for end, size in zip(np.cumsum(sizes).tolist(), sizes.tolist(), strict=True):
        has = own[end - size : end]
        told.append((size.to_bytes(8, "little") + np.packbits(has > 0).tobytes(), _pack(np.diff(has[has > 0], prepend=0), "<i4")))
    m = len(told)
    told_rows = {"lang": [lang] * m, "range": [number] * m, "shard": shards, "data": [x for x, _ in told], "more": [x for _, x in told]}
    return pa.concat_tables([_rows(_MERGED, nodes, n), _rows(_MERGED, told_rows, m)])


def _shards(docs: DataFrame, block: int, ranges: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}
        task, made = TaskContext.get().partitionId(), 0

        def flush(lang: str) -> Iterator[pa.RecordBatch]:
            nonlocal made
            made += 1
            size[lang] = 0
            yield from first_level(f"{task}-{made}", lang, _END.join(held.pop(lang)), ranges).to_batches()

        for batch in batches:
            for part in pieces(batch, 256):
                langs = part.column("lang").to_pylist()
                for lang, text in zip(langs, part.column("text").cast(pa.binary()).to_pylist(), strict=True):
                    for own in _stretches((text or b"").lower().translate(_ENDS), block):
                        held.setdefault(lang, []).append(own)
                        size[lang] = size.get(lang, 0) + len(own)
                        if size[lang] >= block:
                            yield from flush(lang)
        for lang in list(held):
            yield from flush(lang)

    return docs.select("text", F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang")).mapInArrow(run, SHARD)


def _stretches(text: bytes, most: int) -> Iterator[bytes]:
    """The text in stretches of whole pieces, of about `most` bytes where pieces are shorter."""
    at = 0
    while len(text) - at > most:
        cut = text.rfind(_END, at, at + most)
        cut = cut if cut >= 0 else text.find(_END, at + most)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut + 1
    yield text[at:]


def frequent(docs: DataFrame, depth: int = DEPTH, least: int = LEAST, block: int = BLOCK) -> tuple[list[DataFrame], DataFrame]:
    """For 1, 2, ... words a table of lang, id, parent, link, path, last, f, lefts, rights; and lang, n: the number of words of each.

    path: the phrase's words with spaces; lefts and rights: counts of its first k words and of the rest,
    for k = 1, 2, ...
    """
    ship_package(docs.sparkSession)
    spark = docs.sparkSession
    # about six bytes a word; more ranges in larger tables keep what is merged in one task of one size
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(RANGES, -(-size // (6 * WORDS * SLICES)) * SLICES)
    level, path = materialize_at(_shards(docs, block, ranges), "trie")
    words = materialize(level.filter("range = -1").groupBy("lang").agg(F.sum("words").alias("n")), "words")
    tables: list[DataFrame] = []
    while True:
        deep = bool(tables)
        nodes = level.filter("range >= 0").select("lang", "range", "shard", "size", "data", "more")
        merged = nodes.groupBy("lang", "range").applyInArrow(lambda rows: merge(rows, least, deep), MERGED)  # noqa: B023
        merged, merged_path = materialize_at(merged, "merged")
        found = merged.filter("id is not null").select("lang", "id", "parent", "link", "word", "f")
        if deep:
            before = tables[-1]
            up = before.select("lang", F.col("id").alias("parent"), F.col("path").alias("head"), F.col("f").alias("pf"), F.col("lefts").alias("pl"))
            link = before.select("lang", F.col("id").alias("link"), "last", F.col("f").alias("sf"), F.col("rights").alias("sr"))
            found = found.join(up, ["lang", "parent"]).join(link, ["lang", "link"])
            path_of, last, lefts, rights = F.concat("head", F.lit(" "), "last"), F.col("last"), F.concat("pl", F.array("pf")), F.concat(F.array("sf"), "sr")
        else:
            path_of, last, lefts = F.col("word"), F.col("word"), F.expr("cast(array() as array<bigint>)")
            rights = lefts
        found = found.select("lang", "id", "parent", "link", path_of.alias("path"), last.alias("last"), "f", lefts.alias("lefts"), rights.alias("rights"))
        tables.append(materialize(found, "phrases"))
        if len(tables) == depth or not tables[-1].limit(1).count():
            break
        told = merged.filter("shard is not null").select(F.col("shard").alias("told"), "range", "data", "more")
        kept = level.filter("range = -1").select("shard", "lang", "size", "data", "more")
        longer = kept.groupBy("shard").cogroup(told.groupBy("told")).applyInArrow(lambda kept, told: next_level(told, kept, ranges, deep), SHARD)  # noqa: B023
        (level, new_path), gone = materialize_at(longer, "trie"), (path, merged_path)
        path = new_path
        for old in gone:
            drop_path(spark, old)
    for old in (path, merged_path):
        drop_path(spark, old)
    return tables, words


def collocations(docs: DataFrame, depth: int = DEPTH, least: int = LEAST, covered: int = COVERED, top: int = TOP, block: int = BLOCK) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: of each lang the first `top` phrases by score, descending.

    A phrase's score is the least of its cuts', floor(1000 * a * n / (l * r)); the first cut with it counts.
    A phrase within a longer one that has `covered` hundredths of its occurrences is left out: as counts
    only fall from a phrase to a longer one, those one word longer tell.
    """
    tables, words = frequent(docs, depth, least, block)
    spark, found = docs.sparkSession, []
    whole = lambda c: F.col(c).cast("decimal(20,0)")
    for k, own in enumerate(tables[1:], 2):
        if k < len(tables):
            # of a longer phrase its first words, its parent, and its last ones, its suffix link
            near = [tables[k].select("lang", F.col(way).alias("id"), F.col("f").alias("g")) for way in ("parent", "link")]
            near = near[0].unionByName(near[1]).groupBy("lang", "id").agg(F.max("g").alias("g"))
            own = own.join(near, ["lang", "id"], "left").filter(F.col("g").isNull() | (F.col("g") * 100 < F.col("f") * covered))
        found.append(own.select("lang", "path", "f", "lefts", "rights"))
    if not found:
        return spark.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    cuts = out.join(words, "lang").select("lang", "path", "f", "n", F.posexplode(F.arrays_zip("lefts", "rights")).alias("k", "cut"))
    cuts = cuts.select("lang", F.col("path").alias("phrase"), F.col("f").alias("a"), "n", "k", F.col("cut.lefts").alias("l"), F.col("cut.rights").alias("r"))
    # counts of up to 20 digits; the quotient is a whole number
    cuts = cuts.withColumns({"up": whole("a") * whole("n") * F.lit(1000).cast("decimal(4,0)"), "down": whole("l") * whole("r")})
    cuts = cuts.withColumn("score", F.expr("up div down"))
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    best = best.select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
