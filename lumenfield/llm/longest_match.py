"""Token counts by greedy longest match, in linear time, without building the pieces.

A word is a maximal run of characters that str.split() keeps. It is read as the bytes of a space,
the mark of a word's start in the vocabulary, and the word. Its pieces are taken greedily: always
the longest token of the vocabulary that the rest begins with.

The automaton is the vocabulary's trie with failure links. Where a state has no edge for the next
byte, the longest tokens at the start of its string are popped: pops[state] says how many, and
fail[state] is the state of what then remains. At the end of a word, rest[state] says how many
pieces its string still makes. Counting takes sums of these and never looks at a piece.

A worker reads the new words of a slice of texts together: all take one byte each step, edges are
found by binary search, and those that fail follow links until they have an edge. Counts of words
seen twice are kept up to a number of words.

Null and empty texts have no words and no tokens. Repeated rows and null doc_ids each keep their
row. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lumenfield.llm.bpe import load_ranks
from lumenfield.llm.cache import Cache
from lumenfield.llm.tables import pieces
from lumenfield.session import ship_package


class Automaton:
    """vocabulary: byte strings with all 256 single bytes among them, so that every word can be cut."""

    def __init__(self, vocabulary: list[bytes]):
        children: list[dict[int, int]] = [{}]
        token, depth, text = [False], [0], [b""]
        for word in vocabulary:
            state = 0
            for at, byte in enumerate(word):
                following = children[state].get(byte)
                if following is None:
                    following = len(children)
                    children[state][byte] = following
                    children.append({})
                    token.append(False)
                    depth.append(at + 1)
                    text.append(word[: at + 1])
                state = following
            token[state] = True
        if len(children[0]) < 256 or not all(token[s] for s in children[0].values()):
            raise ValueError("every single byte has to be a token")
        count = len(children)
        self.pops, self.fail, self.rest = np.zeros(count, np.int64), np.zeros(count, np.int64), np.zeros(count, np.int64)
        by_text = {t: s for s, t in enumerate(text)}
        for state in sorted(range(1, count), key=depth.__getitem__):
            if token[state]:
                self.pops[state], self.rest[state] = 1, 1
                continue
            # the parent's string pops first; what remains of it is followed by this state's last byte
            parent, byte = by_text[text[state][:-1]], text[state][-1]
            popped, at = int(self.pops[parent]), int(self.fail[parent])
            while byte not in children[at]:
                popped, at = popped + int(self.pops[at]), int(self.fail[at])
            to = children[at][byte]
            self.pops[state], self.fail[state] = popped, to
            self.rest[state] = popped + self.rest[to]
        edges = sorted((s << 8 | b, to) for s, own in enumerate(children) for b, to in own.items())
        self.edges = np.array([e for e, _ in edges], np.int64)
        self.to = np.array([t for _, t in edges], np.int64)

    def count(self, words: list[bytes]) -> np.ndarray:
        """Number of pieces of each byte string."""
        order = np.argsort([-len(w) for w in words], kind="stable")
        length = np.array([len(words[k]) for k in order])
        flat = np.frombuffer(b"".join([words[k] for k in order]), np.uint8).astype(np.int64)
        start = np.cumsum(length) - length
        state, total = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        for at in range(int(length[0]) if len(words) else 0):
            live = int(np.searchsorted(-length, -at, "left"))  # words longer than at
            byte = flat[start[:live] + at]
            todo = np.arange(live)
            while len(todo):
                key = state[todo] << 8 | byte[todo]
                slot = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
                hit = self.edges[slot] == key
                state[todo[hit]] = self.to[slot[hit]]
                todo = todo[~hit]
                total[todo] += self.pops[state[todo]]
                state[todo] = self.fail[state[todo]]
        out = np.empty(len(words), np.int64)
        out[order] = total + self.rest[state]
        return out


class Counter:
    def __init__(self, path: str):
        self.automaton = Automaton(list(load_ranks(path)))
        self.cache = Cache(lambda words: self.automaton.count([b" " + w.encode() for w in words]).tolist())

    def counts(self, texts: list[str | None]) -> tuple[list[int], list[int]]:
        words = [(t or "").split() for t in texts]
        number = np.array(list(map(len, words)), np.int64)
        values, index = self.cache.of(pa.array([w for own in words for w in own], pa.large_string()))
        pieces_of = np.array(values, np.int64)[index] if values else np.zeros(0, np.int64)
        total = np.concatenate(([0], np.cumsum(pieces_of)))[np.cumsum(number)]
        return number.tolist(), np.diff(total, prepend=0).tolist()


@lru_cache(maxsize=1)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, path: str, rows: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_words, n_tokens of every row; path: a file of token ranks."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            for part in pieces(batch, rows):
                texts = part.column("text").to_pylist()
                words, tokens = own.counts(texts)
                size = [len((t or "").encode()) for t in texts]
                cols = [part.column("doc_id"), *(pa.array(x, pa.int64()) for x in (size, words, tokens))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_bytes", "n_words", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_words long, n_tokens long")
