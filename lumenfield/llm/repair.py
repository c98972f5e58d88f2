"""Token ids of a corpus as Re-Pair grammars: written in blocks, read back, decoded at random.

Documents are put into ascending doc_id order (nulls first) by a range shuffle, encoded with the
tokenizers library (a special token that a text spells out is that token), closed with an end id and gathered into blocks of about BLOCK ids. Each block is
one grammar: its frequent pairs of symbols are replaced by new symbols, many pairs a round, until
no pair is frequent or symbols of 16 bits run out; no pair crosses the end of a document. A block
holds the rules, the length that each rule expands to, where each document starts among the
symbols, and the symbols. A document, or a part of one, can be decoded alone.

The blocks are rows of a Parquet table, so the store, its commit and the retries are Spark's.
Null texts are empty (one end id). Repeated doc_ids each keep their row, ordered by text. Other
columns are ignored. A worker holds one block and one slice of texts.
"""

from __future__ import annotations

import codecs
import json
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenfield.llm.cache import Cache, gather, unit, units
from lumenfield.llm.tables import pieces
from lumenfield.session import ship_package

BLOCK = 1 << 20
#: Rules a round, and occurrences a pair needs.
RULES, LEAST = 3000, 6
#: Slots of the table of a round's pairs, in bits.
_BITS = 18
_HEAD = struct.Struct("<4sIIIIQ")
_MAGIC = b"RPG1"


def _shown() -> dict[int, str]:
    """The visible character that byte-level vocabularies show each byte as."""
    plain = [b for b in range(256) if 33 <= b <= 126 or (b >= 161 and b != 173)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


_SHOWN = _shown()
#: The same as a table for charmap decoding.
_TABLE = "".join(_SHOWN[b] for b in range(256))
#: Words that the library's model takes in one call.
_JOINED = 64
#: A token with a space or a line end inside it, beside something else.
_CROSSES = re.compile(f"[^{_SHOWN[32]}]{_SHOWN[32]}|{_SHOWN[10]}[^{_SHOWN[10]}]|[^{_SHOWN[10]}]{_SHOWN[10]}")
#: Kinds of bytes: letters, digits and signs, which are always cut from each other, but nothing is cut after an apostrophe.
_LETTER, _DIGIT, _SIGN, _APOSTROPHE, _SPACE, _LINE, _WHITE, _LATIN, _HIGH, _NOT_SURE = range(1, 11)


def _kind(b: int) -> int:
    c = chr(b)
    if b < 128:
        if c in " \n'":
            return {" ": _SPACE, "\n": _LINE, "'": _APOSTROPHE}[c]
        return _LETTER if c.isalpha() else _DIGIT if c.isdigit() else _SIGN if 32 < b < 127 else _WHITE
    # C3 to C5 begin letters of Latin (and two signs); C2 and E1 to E3 may begin white space
    return _LATIN if 0xC3 <= b <= 0xC5 else _NOT_SURE if b == 0xC2 or 0xE1 <= b <= 0xE3 else _HIGH


_KINDS = bytes(map(_kind, range(256)))
_SEEN = np.isin(np.arange(16), (_LETTER, _DIGIT, _SIGN, _APOSTROPHE, _LATIN, _HIGH))
#: By the kinds before and after a place, as 16 of the one and one of the other.
_CHANGES = np.zeros(256, bool)
_CHANGES[[16 * a + b for a in (_LETTER, _DIGIT, _SIGN) for b in (_LETTER, _DIGIT, _SIGN, _APOSTROPHE) if a != b and (a, b) != (_SIGN, _APOSTROPHE)]] = True


def stretches(texts: pa.Array, whole: np.ndarray | None = None) -> tuple[pa.Array, np.ndarray]:
    """Parts of texts (large strings, no null) that the byte-level cut can take alone, in one array, and each text's number of them.

    A part begins at a space that stands alone between visible characters, at a line end that does
    so and after it, and where letters, digits and ASCII signs change. The cut's pattern always has
    a border there and looks no further. Texts marked in `whole` are cut at spaces alone.
    """
    if not len(texts):
        return texts, np.zeros(0, np.int64)
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    first, n = int(ends[0]), int(ends[-1] - ends[0])
    ends = ends - first
    if not n:
        return pa.array([], pa.large_string()), np.zeros(len(texts), np.int64)
    data = texts.buffers()[2].slice(first, n)
    # two bytes of white space on either side
    raw = np.frombuffer(b"\t\t" + memoryview(data) + b"\t\t", np.uint8)
    kind = np.frombuffer(raw.tobytes().translate(_KINDS), np.uint8)
    before, last, here, after = kind[:-4], kind[1:-3], kind[2:-2], kind[3:-1]
    # by the character that ends before each byte: a letter, or one that is surely visible
    latin = (before == _LATIN) & (raw[1:-3] != 0x97) & (raw[1:-3] != 0xB7)
    old = last.copy()
    high = np.flatnonzero(last == _HIGH)
    two = raw[high]
    old[high] = np.where(latin[high], _LETTER, np.where((two == 0xC2) | (two == 0x80) | (two == 0x81) | (two == 0x9A), _NOT_SURE, _HIGH))
    # by the one that begins there
    new = here.copy()
    at = np.flatnonzero(here == _LATIN)
    new[at] = np.where((raw[at + 3] != 0x97) & (raw[at + 3] != 0xB7), _LETTER, _HIGH)
    seen = _SEEN[old] & _SEEN[after]
    lone = (here == _LINE) & seen
    cut = _CHANGES[old * np.uint8(16) + new]
    cut |= lone
    cut[1:] |= lone[:-1]
    if whole is not None and whole.any():
        cut &= ~np.repeat(whole, np.diff(ends))
    cut |= (here == _SPACE) & seen
    # texts are cut from each other, and what is beside an end is no part of the text
    starts = ends[:-1][np.diff(ends) > 0]
    cut[starts] = True
    at = np.append(np.flatnonzero(cut), n)
    count = np.diff(np.searchsorted(at, ends))
    return pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int64)), data), count


def _between_words(token: str) -> bool:
    """Whether a token of a byte-level vocabulary could come from the end of a word of letters and what follows it."""
    if not _CROSSES.search(token):
        return False
    try:
        text = bytes(_TABLE.index(c) for c in token).decode()
    except ValueError:
        return True
    return any(c not in " \n" for c in text) and all(c in " \n" or c.isalpha() for c in text)


class Encoder:
    def __init__(self, path: str):
        # a worker has one core; the library's own threads would only wait for each other
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        if self.size > 1 << 16:
            raise ValueError("the format holds ids of 16 bits")
        # a word of letters, and the ASCII punctuation after it, are pieces of the byte-level cut: the library's model can take them directly
        state = json.loads(self.tokenizer.to_str())
        cut = state["pre_tokenizer"] or {}
        self.by_word = bool(not state["normalizer"] and cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space"))
        # words are merged many at a time: merges must be all there is to it, no token may lie across two words, and those that begin one tell where it begins
        model, vocabulary = state["model"], self.tokenizer.get_vocab()
        self.added = [x["content"] for x in state["added_tokens"]]
        others = ("dropout", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix")
        self.by_word = self.by_word and model["type"] == "BPE" and not any(map(model.get, others)) and not any(x.strip().isalpha() for x in self.added)
        self.by_word = self.by_word and all(c in vocabulary for c in _TABLE) and not any(map(_between_words, vocabulary))
        self.begins = np.zeros(1 << 16, bool)
        self.begins[[k for token, k in vocabulary.items() if token[:1] in (_SHOWN[32], _SHOWN[10])]] = True
        self.cache = Cache(self._encode)

    def _encode(self, keys: list[str]) -> list[bytes]:
        if not self.by_word:
            return self._library([unit(key) for key in keys])
        # words of letters go to the model; what follows no space is read after a line end, whose id is dropped
        asked = [key[1:] if key[0] == " " else "\n" + key for key in keys]
        words = [k for k, key in enumerate(keys) if (asked[k] if key[0] == " " else key).isalpha()]
        out: list[bytes | None] = [None] * len(keys)
        for k, ids in zip(words, self._words([asked[k] for k in words]), strict=True):
            out[k] = ids if keys[k][0] == " " else ids[2:]
        rest = [k for k, ids in enumerate(out) if ids is None]
        for k, ids in zip(rest, self._library([keys[k] for k in rest]), strict=True):
            out[k] = ids
        return out

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u2").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words, each with the space before it or with the line end that it begins with."""
        tokenize, ids = self.tokenizer.model.tokenize, array("H")
        for k in range(0, len(words), _JOINED):
            raw = "".join([word if word[0] == "\n" else " " + word for word in words[k : k + _JOINED]]).encode()
            ids.extend([token.id for token in tokenize(codecs.charmap_decode(raw, "strict", _TABLE)[0])])
        flat = np.frombuffer(ids, np.uint16)
        at = (2 * np.flatnonzero(self.begins[flat])).tolist()
        raw = flat.astype("<u2").tobytes()
        return [raw[a:b] for a, b in zip(at, [*at[1:], len(raw)], strict=True)] if at else []

    def encode_all(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, one after the other, and each text's number of them."""
        if self.by_word:
            column = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())).cast(pa.large_string()).fill_null("")
            keys, count = stretches(column, self._special(column))
        else:
            keys, count = units([t or "" for t in (texts.to_pylist() if isinstance(texts, pa.Array) else texts)])
        return gather(*self.cache.of(keys), count, "<u2")

    def _special(self, texts: pa.Array) -> np.ndarray:
        """Which texts hold an added token, that the library takes out before it cuts them."""
        found = np.zeros(len(texts), bool)
        for content in self.added:
            found |= pc.match_substring(texts, content).to_numpy(zero_copy_only=False)
        return found


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _hash(pairs: np.ndarray) -> np.ndarray:
    return (pairs * np.uint32(2654435761)) >> np.uint32(32 - _BITS)


def _frequent(pairs: np.ndarray, most: int, least: int) -> np.ndarray:
    """The most frequent values, at least so often, in ascending order."""
    if not len(pairs):
        return pairs
    pairs = np.sort(pairs)
    at = np.flatnonzero(np.concatenate(([True], pairs[1:] != pairs[:-1])))
    count = np.diff(np.append(at, len(pairs)))
    good = np.flatnonzero(count >= least)
    if len(good) > most:
        good = np.sort(good[np.argsort(-count[good], kind="stable")[:most]])
    return pairs[at[good]]


def compress(ids: np.ndarray, lengths: np.ndarray, base: int) -> bytes:
    """A block: ids (below base) of documents with these lengths, as a grammar."""
    symbols = ids.astype(np.uint32)
    last = np.zeros(len(symbols), bool)
    last[np.cumsum(lengths) - 1] = True
    left, right, spans = [], [], [np.ones(base, np.uint32)]
    rules, size = 0, np.ones(base, np.uint32)
    while True:
        room = min(RULES, (1 << 16) - base - rules)
        if room <= 0 or len(symbols) < 2:
            break
        pairs = (symbols[:-1] << np.uint32(16)) | symbols[1:]
        inside = ~last[:-1]
        chosen = _frequent(pairs[inside], room, LEAST)
        if not len(chosen):
            break
        # pairs are looked up in a table by hash; of those that fall together one waits for another round
        table = np.zeros(1 << _BITS, np.uint16)
        table[_hash(chosen)] = np.arange(len(chosen))
        chosen = chosen[np.unique(table[_hash(chosen)])]
        table[:] = len(chosen)
        table[_hash(chosen)] = np.arange(len(chosen))
        slot = table.take(_hash(pairs))
        at = np.flatnonzero((slot < len(chosen)) & inside)
        slot = slot.take(at)
        hit = chosen.take(slot) == pairs.take(at)
        at, slot = at[hit], slot[hit]
        # of hits in a row every second is taken, from the first on
        begin = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1] + 1)))
        odd = (np.arange(len(at)) - np.repeat(begin, np.diff(begin, append=len(at)))) & 1
        at, slot = at[odd == 0], slot[odd == 0]
        symbols[at] = base + rules + slot.astype(np.uint32)
        last[at] |= last[at + 1]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        symbols, last = symbols[keep], last[keep]
        a, b = chosen >> np.uint32(16), chosen & np.uint32(0xFFFF)
        left.append(a)
        right.append(b)
        size = np.concatenate((size, size[a] + size[b]))
        rules += len(chosen)
    starts = np.concatenate(([0], np.flatnonzero(last) + 1))
    pack = lambda x, kind: np.asarray(x).astype(kind).tobytes()
    return b"".join(
        [
            _HEAD.pack(_MAGIC, base, rules, len(lengths), len(symbols), len(ids)),
            *(pack(np.concatenate(x) if x else [], "<u2") for x in (left, right)),
            pack(size[base:], "<u4"),
            pack(starts, "<u4"),
            pack(symbols, "<u2"),
        ]
    )


class Block:
    """A block opened for reading."""

    def __init__(self, raw: bytes):
        magic, self.base, rules, self.docs, count, self.total = _HEAD.unpack_from(raw)
        if magic != _MAGIC:
            raise ValueError("this is no block of token ids")
        at = _HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(raw, kind, n, at)
            at += found.nbytes
            return found

        self.left, self.right = take("<u2", rules), take("<u2", rules)
        self.size = np.concatenate((np.ones(self.base, np.int64), take("<u4", rules)))
        self.starts = take("<u4", self.docs + 1)
        self.symbols = take("<u2", count)

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        while True:
            new = symbols >= self.base
            if not new.any():
                return symbols
            at = np.cumsum(new) - new + np.arange(len(symbols))
            out = np.empty(len(symbols) + int(new.sum()), np.uint16)
            out[at] = np.where(new, 0, symbols)
            rule = symbols[new].astype(np.int64) - self.base
            out[at[new]], out[at[new] + 1] = self.left[rule], self.right[rule]
            symbols = out

    def document(self, k: int, begin: int = 0, end: int | None = None) -> np.ndarray:
        """Ids begin to end of a document; only the symbols that cover them are expanded."""
        own = self.symbols[self.starts[k] : self.starts[k + 1]]
        ends = np.cumsum(self.size[own])
        end = int(ends[-1]) if end is None else min(end, int(ends[-1]))
        if begin >= end:
            return own[:0]
        first, final = np.searchsorted(ends, begin, "right"), np.searchsorted(ends, end, "left")
        skip = int(ends[first] - self.size[own[first]])
        return self.expand(own[first : final + 1])[begin - skip : end - skip]

    def documents(self) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and each document's number of them."""
        size = self.size[self.symbols]
        ends = np.cumsum(size)
        lengths = np.add.reduceat(size, self.starts[:-1])
        # each rule is expanded once, and its ids are copied to wherever it is used
        rules = np.arange(self.base, len(self.size), dtype=np.uint16)
        flat = np.concatenate((np.arange(self.base, dtype=np.uint16), self.expand(rules)))
        begin = np.cumsum(self.size) - self.size
        return flat.take(np.arange(self.total) + np.repeat(begin[self.symbols] - (ends - size), size)), lengths


_SCHEMA = "part int, block int, first long, n_docs int, n_ids long, doc_ids array<long>, grammar binary"


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, block: int = BLOCK, rows: int = 1024) -> None:
    """Write docs' ids to path, in ascending doc_id order over part and block."""
    spark = docs.sparkSession
    ship_package(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part = encoder(tokenizer), TaskContext.get().partitionId()
        end, names = np.array([end_id], "<u2"), [x.split()[0] for x in _SCHEMA.split(", ")]
        held, ids, kept, number, first = [], [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal number, first, kept
            lengths = np.array([len(x) + 1 for x in ids[::2]], np.int64)
            grammar = compress(np.concatenate(ids), lengths, own.size)
            cols = [pa.array([x], t) for x, t in ((part, pa.int32()), (number, pa.int32()), (first, pa.int64()), (len(held), pa.int32()), (kept, pa.int64()), (held, pa.list_(pa.int64())), (grammar, pa.binary()))]
            number, first, kept = number + 1, first + kept, 0
            out = pa.RecordBatch.from_arrays(cols, names)
            held.clear()
            ids.clear()
            return out

        for batch in batches:
            for piece in pieces(batch, rows):
                flat, count = own.encode_all(piece.column("text"))
                for doc, x in zip(piece.column("doc_id").to_pylist(), np.split(flat, np.cumsum(count)[:-1]), strict=True):
                    held.append(doc)
                    ids += [x, end]
                    kept += len(x) + 1
                    if kept >= block:
                        yield flush()
        if ids:
            yield flush()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # rows of one doc_id, null above all, are cut anywhere by their place in the input; texts are not read to find the ranges
    ordered = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("key")).repartitionByRange(parts, "doc_id", "key")
    ordered = ordered.sortWithinPartitions("doc_id", "text").drop("key")
    ordered.mapInArrow(run, _SCHEMA).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32."""
    ship_package(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                block = Block(row.column("grammar")[0].as_py())
                ids, lengths = block.documents()
                ends = np.cumsum(lengths)
                raw = memoryview(ids.astype("<u4").tobytes())
                starts = ends - lengths
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                n = len(ends)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, row.column("part")[0].as_py(), np.int32)),
                        row.column("doc_ids")[0].values,
                        pa.array(starts + row.column("first")[0].as_py()),
                        pa.array(lengths),
                        pa.array(crc, pa.int64()),
                    ],
                    ["part", "doc_id", "within", "n_tokens", "ids_crc32"],
                )

    files = spark.read.parquet(path)
    # one row per part of the files: as many as the writing had tasks, whatever the corpus
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = totals.select(
        "part",
        F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
    )
    docs = files.select("part", "first", "doc_ids", "grammar").mapInArrow(
        run, "part int, doc_id long, within long, n_tokens long, ids_crc32 long"
    )
    return docs.join(F.broadcast(before), "part").select(
        "doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32"
    )
