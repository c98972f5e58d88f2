"""What short strings come to: looked up by distinct string, and kept by each Python worker within bounds."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A space next to other white space, or a character that marks keys.
_AFTER, _BEFORE = re.compile(r" \s|\0"), re.compile(r" (?<=\s )")
_CUT = re.compile(r"(?<=\S)(?= \S)")


def units(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """Keys of the stretches of texts between their single spaces, all in one array, and each text's number of them.

    A cut is made before a space that stands alone between two visible characters. Byte-level
    patterns always cut there, and what they do on either side depends on nothing beyond. See unit().
    """
    plain, others = [], {}
    for k, text in enumerate(texts):
        if text and (text[0].isspace() or text[-1].isspace() or _AFTER.search(text) or _BEFORE.search(text)):
            others[k] = [u[1:] if len(u) > 1 and u[0] == " " and not u[1].isspace() and u[1] != "\0" else "\0" + u for u in _CUT.split(text)]
            plain.append(None)
        else:
            plain.append("\0" + text)
    cut = pc.split_pattern(pa.array(plain, pa.large_string()), " ")
    count = np.nan_to_num(cut.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64)
    flat = cut.flatten()
    if not others:
        return flat, count
    # the texts cut one by one go back to their places
    parts, at = [], 0
    ends = np.cumsum(count)
    for k, own in others.items():
        parts += [flat.slice(at, int(ends[k]) - at), pa.array(own, pa.large_string())]
        at = int(ends[k])
        count[k] = len(own)
    return pa.concat_arrays([*parts, flat.slice(at)]), count


def unit(key: str) -> str:
    """The stretch of text that a key stands for: most start with the space that the key leaves out."""
    return key[1:] if key.startswith("\0") else " " + key


def gather(values: list[bytes], index: np.ndarray, count: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The numbers that texts' strings come to, one after the other, and each text's number of them.

    values: little-endian numbers of each distinct string; index: which one each string is; count:
    each text's number of strings.
    """
    flat = np.frombuffer(b"".join(values), kind)
    size = np.fromiter(map(len, values), np.int64, len(values)) // np.dtype(kind).itemsize
    start = np.cumsum(size) - size
    each = size[index]
    ends = np.cumsum(each)
    places = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start[index] - (ends - each), each)
    total = np.concatenate(([0], ends))[np.cumsum(count)]
    return flat[places], np.diff(total, prepend=0)


class Cache:
    """Keeps the values of the keys asked for lately, in two generations of at most half of `most` keys each.

    A key that is asked for again moves to the younger generation; when that is full it becomes the
    older one, whose keys are forgotten. What is not kept is computed anew for each call, once for
    all that the call holds; results never depend on what is kept.
    """

    def __init__(self, compute: Callable[[list[str]], list[Any]], most: int = 600_000, longest: int = 64):
        self.compute, self.half, self.longest = compute, most // 2, longest
        self.young: dict[str, Any] = {}
        self.old: dict[str, Any] = {}

    def peek(self, key: str) -> Any:
        """The value of a key if it is kept."""
        return self.young.get(key) or self.old.get(key)

    def values(self, keys: list[str]) -> list[Any]:
        """The value of each of some distinct keys; values may not be None."""
        found = list(map(self.young.get, keys))
        absent = [i for i, v in enumerate(found) if v is None]
        if absent:
            names = [keys[i] for i in absent]
            fresh = list(map(self.old.get, names))
            lost = [i for i, v in enumerate(fresh) if v is None]
            if lost:
                for i, v in zip(lost, self.compute([names[i] for i in lost]), strict=True):
                    fresh[i] = v
            for i, v in zip(absent, fresh, strict=True):
                found[i] = v
            if len(self.young) + len(fresh) > self.half:
                self.old, self.young = self.young, {}
            self.young.update([(k, v) for k, v in zip(names, fresh, strict=True) if len(k) <= self.longest][: self.half])
        return found

    def of(self, keys: pa.Array) -> tuple[list[Any], np.ndarray]:
        """Values of the distinct keys, and which of them each key has."""
        coded = keys.dictionary_encode()
        return self.values(_strings(coded.dictionary)), coded.indices.to_numpy(zero_copy_only=False)


def _strings(column: pa.Array) -> list[str]:
    """A column of strings (no null) as Python's, decoded at once and cut by numbers of characters."""
    ends = np.cumsum(pc.utf8_length(column).to_numpy(zero_copy_only=False)).tolist()
    offsets = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_string(column.type) else np.int32)
    first, last = int(offsets[column.offset]), int(offsets[column.offset + len(column)])
    raw = column.buffers()[2]
    whole = raw[first:last].to_pybytes().decode() if raw is not None else ""
    return [whole[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] if ends else []
