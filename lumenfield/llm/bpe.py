"""Byte-level BPE in numpy, equal to the tiktoken library's ordinary encoding, and its decoding.

Texts are cut at single spaces into units (a word with the space before it); a unit's tokens depend
on nothing outside it, which makes units good cache keys. Units that the cache of a Python worker
lacks are cut by the pattern into pieces, and their pieces are merged together: bucketed by length into padded matrices of token
ids, every row merges its leftmost pair of least rank each round. The ranks of all pairs come from
an open-addressing hash table; a round takes one cell out of every row, so dropping those cells
compacts the matrix, and rows with no pair left leave it.

A piece of more than LONG bytes is a matrix of one wide row. Its rounds merge all pairs of the least
rank that the single merges would take one after the other.

Null texts are empty; an empty text has no ids. Rows, repeated or with null doc_id, each return one
row. Other columns are ignored. Memory is bounded by the cache limits and one slice of texts.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lumenfield.llm.cache import Cache, gather, unit, units
from lumenfield.llm.tables import pieces
from lumenfield.session import ship_package

LONG = 1024
#: Cells of a matrix at most.
CELLS = 1 << 20
_WIDTHS = (4, 6, 8, 10, 12, 16, 24, 32, 64, 128, 256, 512, LONG)
_BUCKET = [min(w for w in _WIDTHS if w >= n) for n in range(LONG + 1)]
_NONE = np.int32(2**31 - 1)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class PairTable:
    """Hash table from a pair of token ids to the rank of their concatenation."""

    def __init__(self, ranks: dict[bytes, int]):
        left, right, rank = [], [], []
        for token, r in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    rank.append(r)
        keys = (np.array(left, np.int64) << 32) | np.array(right, np.int64)
        self.bits = max(4, int(len(keys) * 4 - 1).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, _NONE, np.int32)
        value = np.array(rank, np.int32)
        slot, self.probes = self._slot(keys), 1
        todo = np.arange(len(keys))
        while len(todo):  # one round for each place that a key may be further on
            at = (slot[todo] + self.probes - 1) & (len(self.keys) - 1)
            free = self.keys[at] == -1
            _, first = np.unique(at[free], return_index=True)
            took = np.flatnonzero(free)[first]
            self.keys[at[took]], self.values[at[took]] = keys[todo[took]], value[todo[took]]
            todo = np.delete(todo, took)
            self.probes += bool(len(todo))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; 2**31 - 1 where it is none or an id is negative."""
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        slot = self._slot(keys)
        out = np.where(self.keys[slot] == keys, self.values[slot], _NONE)
        todo = np.flatnonzero((self.keys[slot] != keys) & (self.keys[slot] != -1))
        for step in range(1, self.probes):
            if not len(todo):
                break
            at = (slot[todo] + step) & (len(self.keys) - 1)
            seen = self.keys[at]
            hit = seen == keys[todo]
            out[todo[hit]] = self.values[at[hit]]
            todo = todo[~hit & (seen != -1)]
        out[(left < 0) | (right < 0)] = _NONE
        return out


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.table = PairTable(ranks)
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        size = max(ranks.values()) + 1
        self.tokens = [b""] * size
        for token, r in ranks.items():
            self.tokens[r] = token
        self.cache = Cache(self.encode_units)

    def _matrix(self, raws: list[bytes], out: dict[bytes, bytes]) -> None:
        """Merge pieces of like length together."""
        width = max(map(len, raws))
        length = np.array([len(x) for x in raws])
        ids = np.full((len(raws), width), -1, np.int32)
        ids[np.arange(width) < length[:, None]] = self.of_byte[np.frombuffer(b"".join(raws), np.uint8)]
        rows = np.arange(len(raws))
        ranks = self.table.rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(raws), -1)
        while True:
            at = ranks.argmin(1) if ranks.shape[1] else np.zeros(len(rows), np.int64)
            least = ranks[np.arange(len(rows)), at] if ranks.shape[1] else np.full(len(rows), _NONE)
            ended = least == _NONE
            if ended.any():
                done = ids[ended]
                ends = np.cumsum((done >= 0).sum(1)) * 4
                flat = done[done >= 0].astype("<u4").tobytes()
                for k, a, b in zip(rows[ended].tolist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                    out[raws[k]] = flat[a:b]
                go = ~ended
                if not go.any():
                    return
                rows, ids, ranks, at, least = rows[go], ids[go], ranks[go], at[go], least[go]
            n, width = ids.shape
            line = np.arange(n)
            ids[line, at] = least
            keep = np.ones((n, width), bool)
            keep[line, at + 1] = False
            ids = ids[keep].reshape(n, width - 1)
            keep = keep[:, 1:]  # pair j stands between cells j and j + 1; the pair that merged goes
            ranks = ranks[keep].reshape(n, width - 2)
            width -= 1
            for shift in (-1, 0):  # the pairs on either side of the merged cell
                j = at + shift
                ok = np.flatnonzero((j >= 0) & (j + 1 < width))
                if len(ok):
                    ranks[ok, j[ok]] = self.table.rank(ids[ok, j[ok]], ids[ok, j[ok] + 1])

    def _wide(self, raw: bytes) -> bytes:
        """Ids of a piece that is a matrix of one wide row: a round takes the leftmost pair of least rank and its like.

        Further pairs of that rank would be the leftmost ones of the rounds that follow, unless a merge
        before them makes a pair of lower rank; the round ends at the first merge that does.
        """
        ids = self.of_byte[np.frombuffer(raw, np.uint8)]
        ranks = self.table.rank(ids[:-1], ids[1:])
        while len(ranks) and (least := ranks.min()) != _NONE:
            at = np.flatnonzero(ranks == least)
            # of pairs that overlap in a run of like ones, every second is taken
            fresh = np.concatenate(([True], np.diff(at) > 1))
            at = at[(np.arange(len(at)) - np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))) % 2 == 0]
            padded = np.concatenate(([-1], ids, [-1])).astype(np.int32)
            left, right, own = padded[at], padded[at + 3], np.full(len(at), least, np.int32)
            left[1:][np.diff(at) == 2] = least
            lower = np.flatnonzero(np.minimum(self.table.rank(left, own), self.table.rank(own, right)) < least)
            if len(lower):
                at = at[: lower[0] + 1]
            ids[at] = least
            ids, ranks = np.delete(ids, at + 1), np.delete(ranks, at)
            at -= np.arange(len(at))
            near = np.unique(np.concatenate((at - 1, at)))
            near = near[(near >= 0) & (near < len(ranks))]
            ranks[near] = self.table.rank(ids[near], ids[near + 1])
        return ids.astype("<u4").tobytes()

    def merge(self, raws: set[bytes]) -> dict[bytes, bytes]:
        """Ids of each piece, as little-endian 32-bit integers."""
        out: dict[bytes, bytes] = {}
        buckets: dict[int, list[bytes]] = {}
        for raw in raws:
            if (whole := self.ranks.get(raw)) is not None:
                out[raw] = whole.to_bytes(4, "little")
            elif len(raw) > LONG:
                out[raw] = self._wide(raw)
            else:
                buckets.setdefault(_BUCKET[len(raw)], []).append(raw)
        for width, group in buckets.items():
            step = max(1, CELLS // width)
            for at in range(0, len(group), step):
                self._matrix(group[at : at + step], out)
        return out

    def encode_units(self, keys: list[str]) -> list[bytes]:
        cut = [list(map(str.encode, self.pattern.findall(unit(k)))) for k in keys]
        made = self.merge({p for ps in cut for p in ps})
        return [b"".join([made[p] for p in ps]) for ps in cut]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, as little-endian 32-bit integers."""
        keys, count = units(texts)
        ids, count = gather(*self.cache.of(keys), count, "<u4")
        return np.split(ids, np.cumsum(count)[:-1]) if len(count) else []

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(load_ranks(path), pattern)


def encode(docs: DataFrame, path: str, pattern: str, decode: bool = True, rows: int = 512) -> DataFrame:
    """docs' doc_id with ids (binary, little-endian unsigned 32-bit) and, if asked, decoded (binary)."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with_decoded = ["decoded"] if decode else []
        own = codec(path, pattern)
        for batch in batches:
            for part in pieces(batch, rows):
                ids = own.encode_all([t or "" for t in part.column("text").to_pylist()])
                cols = [part.column("doc_id"), pa.array([x.tobytes() for x in ids], pa.binary())]
                cols += [pa.array(map(own.decode, ids), pa.binary())] if decode else []
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "ids", *with_decoded])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary" + ", decoded binary" * decode)


def digests(docs: DataFrame, path: str, pattern: str, rows: int = 512) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: the ids and the texts decoded from them as digests."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        sha = hashlib.sha256
        for batch in batches:
            for part in pieces(batch, rows):
                ids = own.encode_all([t or "" for t in part.column("text").to_pylist()])
                cols = [
                    part.column("doc_id"),
                    pa.array(list(map(len, ids)), pa.int64()),
                    pa.array([sha(x.tobytes()).hexdigest() for x in ids]),
                    pa.array([sha(own.decode(x)).hexdigest() for x in ids]),
                ]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", "text").mapInArrow(run, schema)
