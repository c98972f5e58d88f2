"""Toxicity by a support vector machine on a gap-tolerant string kernel with Nystroem landmarks.

Kernel of two strings: how far one is inside the other. All runs of ORDER characters of the one are
looked for in the other as subsequences, within SPAN characters, weighted by DECAY for every
character that is skipped; their mean is the share that is inside, and the larger share of both
directions counts (that of a string in a longer landmark times its part of the length). What is
over FLOOR, brought to 1 for equal strings, is raised to POWER. So characters put between an
insult's own, before or behind it take little away, wherever they stand and whatever they are. A
letter left out or put in another's place takes much.

Strings are a text's lower-cased words, their letters and digits alone, so that punctuation within
a word hides nothing; runs of single characters, as in a spaced-out word, are one string, and those
over CUT characters are read in overlapping windows, of which the nearest counts.

Kernel of two sentences: the sum over all pairs of their strings; a text is the bag of its sentences
and is looked at in two ways (multiple-instance learning). One machine sees the mean over a text's
strings, or over FEW where it has less. The other sees passages of PASSAGE strings, one every half of
that, and takes a text for as toxic as its strongest one: what a passage holds is a sum, so that an
insult counts the same in a text of ten words and of ten thousand. It starts from the first machine;
each of its ROUNDS sees the passage of each text that was found strongest before.

The kernel is approximated by landmarks: strings that the labelled texts hold. They are drawn from
both classes: strings that more toxic texts hold than chance would explain, alone or with strings like
them, and the clean texts' strings that are most like those. Languages are never looked at; a string
of a rare language needs no more texts than one of a common language. Margins become probabilities on
the margins of labelled texts that the model that scored them, one of FOLDS, had not seen; the larger
one is the score. Where labels follow the share of insults and not their presence, the second
machine's bar is raised until it costs nothing of the first one's F1.

Training reads at most SAMPLE labelled texts of each class, those with the least hashes of their
ids, whole; copies of a text count once. At most CANDIDATES strings, the most telling ones, are
weighed as landmarks. Scoring reads all texts whole; the scores of strings are kept by each worker
up to a number of them.

Null and empty texts score as a text with a harmless string. Where there is nothing to learn from,
all scores are 0. Each row of the table returns one row, repeated rows and null doc_ids too. Rows
with repeated labels count as toxic if one label says so. Other columns are ignored.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfield.llm.cache import Cache
from lumenfield.llm.tables import least_keys, pieces
from lumenfield.plans.scratch import materialize
from lumenfield.session import ship_package

ORDER, SPAN, DECAY, FLOOR, POWER, CUT = 3, 6, 0.99, 0.5, 3, 24
FEW, PASSAGE, ROUNDS = 40, 32, 3
SAMPLE, LANDMARKS, CANDIDATES, FOLDS = 4000, 512, 1500, 6
#: Toxic texts that a landmark's string has to be in, and how far beyond chance (in nats) they have to be.
SUPPORT, BEYOND = 3, 4.0
#: What a mean over strings is multiplied by, and the ridges of the machines of means and of passages.
SCALE, RIDGES = 40.0, (1e-3, 2e-2)
LEAST = 0.7
#: Odd numbers that make one number of a subsequence; two different ones are the same in one case of 2**32.
_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
_BITS = 22
_JUNK = re.compile(r"[^\w\s]+|_+")
_SPACED = re.compile(r"(?<!\S)\w(?:\s\w){2,}(?!\S)")


def strings(texts: list[str | None]) -> tuple[pa.Array, np.ndarray]:
    """The strings of texts, all in one array, and each text's number of them (1 for none: the empty one)."""
    plain = [_JUNK.sub("", (t or "").lower()) for t in texts]
    plain = [_SPACED.sub(_joined, t) if _SPACED.search(t) else t for t in plain]
    cut = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pa.array(plain, pa.large_string())))
    return cut.flatten(), cut.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def _joined(run: re.Match) -> str:
    return "".join(run[0].split())


def windows(word: str) -> list[str]:
    return [word[at : at + CUT] for at in range(0, max(1, len(word) - CUT // 2), CUT // 2)]


@lru_cache(maxsize=CUT + 1)
def _places(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the subsequences of a string of some length, runs first and the widest last, and their weights."""
    inner = sorted(itertools.combinations(range(1, SPAN), ORDER - 1), key=lambda rest: rest[-1])
    places = np.array([(at, *(at + k for k in rest)) for rest in inner for at in range(length - rest[-1])], np.int64).reshape(-1, ORDER)
    return places, DECAY ** (places[:, -1] - places[:, 0] + 1.0 - ORDER) if len(places) else np.zeros(0)


def _by_length(words: list[str], step: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(numbers of words of one length, their subsequences' cells, weights of those, how many are runs), in bounded blocks."""
    length = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(length[length <= CUT]).tolist():
        places, weight = _places(n)
        own = np.flatnonzero(length == n)
        size = max(1, step // max(1, len(places)))
        for at in range(0, len(own) if len(places) else 0, size):
            some = own[at : at + size]
            code = np.frombuffer("".join([words[k] for k in some]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, n)
            cells = (code * _MIX[0])[:, places[:, 0]]
            for k in range(1, ORDER):
                cells += (code * _MIX[k])[:, places[:, k]]
            yield some, cells, weight, n - ORDER + 1


def _distinct(row: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """Where each (row, cell) is first."""
    return np.unique(row.astype(np.uint64) << np.uint64(32) | cell.astype(np.uint64), return_index=True)[1]


class _Lists:
    """Landmarks, with weights, by cell."""

    def __init__(self, owner: np.ndarray, cell: np.ndarray, weight: np.ndarray):
        first = _distinct(owner, cell)
        first = first[np.argsort(cell[first], kind="stable")]
        self.owner, self.weight = owner[first], weight[first]
        self.cells, self.start = np.unique(cell[first], return_index=True)
        self.size = np.diff(np.append(self.start, len(first)))
        self.known = np.zeros(1 << _BITS, bool)
        self.known[(self.cells >> np.uint32(32 - _BITS)).astype(np.int64)] = True

    def meet(self, cells: np.ndarray, weight: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """(row * most + landmark, sum of both sides' weights' products) of all that meet in a cell; a row's cell counts once, its first."""
        row, col = np.nonzero(self.known[(cells >> np.uint32(32 - _BITS)).astype(np.int64)])
        own = cells[row, col]
        slot = np.minimum(np.searchsorted(self.cells, own), max(0, len(self.cells) - 1))
        real = np.flatnonzero(self.cells[slot] == own) if len(row) else np.zeros(0, np.int64)
        real = real[_distinct(row[real], own[real])]
        row, slot, w = row[real], slot[real], weight[col[real]]
        each = self.size[slot]
        at = np.arange(int(each.sum())) + np.repeat(self.start[slot] - (np.cumsum(each) - each), each)
        key, place = np.unique(np.repeat(row, each) * most + self.owner[at], return_inverse=True)
        return key, np.bincount(place, np.repeat(w, each) * self.weight[at], len(key))


class Kernel:
    """The kernel with some landmarks: lists of landmarks by run, and by subsequence."""

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        self.length = np.fromiter(map(len, landmarks), np.int64, len(landmarks))
        inside = [(np.repeat(some, c.shape[1]), c.ravel(), np.tile(w, len(some))) for some, c, w, _ in _by_length(landmarks)]
        runs = [(np.repeat(some, n), c[:, :n].ravel(), np.ones(n * len(some))) for some, c, w, n in _by_length(landmarks)]
        none = (np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0))
        self.inside, self.runs = (_Lists(*map(np.concatenate, zip(*own, none, strict=True))) for own in (inside, runs))
        self.own_runs = np.bincount(self.runs.owner, minlength=len(landmarks))

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(numbers of words, of landmarks, their kernels) wherever these are over 0."""
        most = max(1, len(self.landmarks))
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for some, cells, weight, n in _by_length(words):
            key, held = self.runs.meet(cells, weight, most)
            held = held / self.own_runs[key % most]
            back, within = self.inside.meet(cells[:, :n], weight[:n], most)
            many = np.sort(cells[:, :n], 1)
            many = 1 + (many[:, 1:] != many[:, :-1]).sum(1)
            within = within / many[back // most] * np.minimum(1, (n + ORDER - 1) / self.length[back % most])
            keep, also = held > FLOOR, within > FLOOR
            key, place = np.unique(np.concatenate((key[keep], back[also])), return_inverse=True)
            value = np.zeros(len(key))
            np.maximum.at(value, place, np.concatenate((held[keep], within[also])))
            found.append((some[key // most], key % most, ((np.minimum(value, 1) - FLOOR) / (1 - FLOOR)) ** POWER))
        return tuple(map(np.concatenate, zip(*found, strict=True)))

    def whole(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for strings of any length: the nearest of a string's windows counts."""
        cut = [windows(w) for w in words]
        number, mark, value = self([c for own in cut for c in own])
        word = np.repeat(np.arange(len(words)), [len(own) for own in cut])[number]
        order = np.lexsort((-value, mark, word))
        word, mark, value = word[order], mark[order], value[order]
        first = np.ones(len(word), bool)
        first[1:] = (word[1:] != word[:-1]) | (mark[1:] != mark[:-1])
        return word[first], mark[first], value[first]

    def square(self) -> np.ndarray:
        """The landmarks' kernels with one another."""
        number, mark, value = self(self.landmarks)
        full = np.zeros((len(self.landmarks), len(self.landmarks)), np.float32)
        full[number, mark] = value
        return np.sqrt(full * full.T)


def strongest(values: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, end, sum) of the strongest passage of each text, of all texts' strings' values in order; the earlier of equal ones."""
    total = np.concatenate(([0.0], np.cumsum(values)))
    end = np.cumsum(count)
    step = PASSAGE // 2
    many = 1 + np.maximum(0, -(-(count - PASSAGE) // step))
    text = np.repeat(np.arange(len(count)), many)
    at = (end - count)[text] + step * (np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many))
    stop = np.minimum(at + PASSAGE, end[text])
    sums = total[stop] - total[at]
    best = np.lexsort((at, -sums, text))[np.cumsum(many) - many] if len(text) else text
    return at[best], stop[best], sums[best]


class Texts:
    """Labelled texts as their strings' numbers, in order."""

    def __init__(self, rows: Iterable[tuple[str, int]]):
        number: dict[str, int] = {}
        parts, label = [], []
        seen: dict[int, list[int]] = {}
        for text, toxic in rows:
            flat, _ = strings([text])
            coded = flat.dictionary_encode()
            place = np.array([number.setdefault(w, len(number)) for w in coded.dictionary.to_pylist()], np.int32)
            ids = place[coded.indices.to_numpy()]
            if self._copy(np.sort(place).astype(np.int64), toxic, seen, len(label)):
                continue
            parts.append(ids)
            label.append(int(toxic))
        self.names, self.label = list(number), np.array(label, np.int64)
        self.lengths = np.array([len(k) for k in parts], np.int64)
        self.flat = np.concatenate([*parts, np.zeros(0, np.int32)])
        self.ids = np.split(self.flat, np.cumsum(self.lengths)[:-1]) if parts else []
        self.text = np.repeat(np.arange(len(label), dtype=np.int32), self.lengths)

    @staticmethod
    def _copy(ids: np.ndarray, toxic: int, seen: dict[int, list[int]], mine: int) -> bool:
        """Whether a text is much like one before: half of eight least hashes of its strings are the same."""
        least = np.sort((ids + 1) * 0x9E3779B1 % 2**31)[:8].tolist()
        like = Counter(k for h in least for k in seen.get(h * 2 + toxic, ()))
        if like and like.most_common(1)[0][1] * 2 > len(least):
            return True
        for h in least:
            seen.setdefault(h * 2 + toxic, []).append(mine)
        return False

    def held(self, which: np.ndarray) -> np.ndarray:
        """In how many of some texts each string is."""
        return np.bincount(np.concatenate([*(np.unique(self.ids[k]) for k in which), np.zeros(0, np.int64)]), minlength=len(self.names))

    def kernels(self, kernel: Kernel, step: int = 16_384) -> Sparse:
        """The kernels of all strings with the landmarks; strings are taken `step` at a time."""
        found = [((n + at).astype(np.int32), m.astype(np.int32), v.astype(np.float32)) for at in range(0, len(self.names), step) for n, m, v in [kernel.whole(self.names[at : at + step])]]
        return Sparse(*map(np.concatenate, zip(*found, strict=True)), len(self.names), len(kernel.landmarks))

    def means(self, like: Sparse) -> np.ndarray:
        """Each text's mean kernels, times SCALE."""
        return like.summed(self.flat, self.text, len(self.label)) * (SCALE / np.maximum(self.lengths, FEW))[:, None]

    def passages(self, like: Sparse, scores: np.ndarray) -> np.ndarray:
        """The sums of kernels of each text's strongest passage."""
        first, end, _ = strongest(scores[self.flat], self.lengths)
        inside = np.zeros(len(self.flat) + 1, np.int32)
        np.add.at(inside, first, 1)
        np.add.at(inside, end, -1)
        own = np.cumsum(inside)[:-1] > 0
        return like.summed(self.flat[own], self.text[own], len(self.label))


class Sparse:
    """Kernels of strings with landmarks, those over 0."""

    def __init__(self, row: np.ndarray, mark: np.ndarray, value: np.ndarray, rows: int, marks: int):
        # rows are in order
        self.row, self.mark, self.value, self.marks = row, mark, value, marks
        self.start = np.searchsorted(self.row, np.arange(rows + 1))

    def of(self, marks: list[int]) -> Sparse:
        """Some landmarks alone, in the order given."""
        place = np.full(self.marks, -1, np.int32)
        place[marks] = np.arange(len(marks), dtype=np.int32)
        own = place[self.mark] >= 0
        return Sparse(self.row[own], place[self.mark[own]], self.value[own], len(self.start) - 1, len(marks))

    def scores(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * weights[self.mark], len(self.start) - 1)

    def summed(self, ids: np.ndarray, group: np.ndarray, groups: int, step: int = 1 << 17) -> np.ndarray:
        """The sums of strings' kernels by group; groups are in order, and `step` strings are taken at a time."""
        out = np.zeros((groups, self.marks))
        for k in range(0, len(ids), step):
            own, of = ids[k : k + step], group[k : k + step].astype(np.int64)
            low, high = int(of[0]), int(of[-1]) + 1
            each = self.start[own + 1] - self.start[own]
            at = np.arange(int(each.sum())) + np.repeat(self.start[own] - (np.cumsum(each) - each), each)
            key = np.repeat(of - low, each) * self.marks + self.mark[at]
            out[low:high] += np.bincount(key, self.value[at], (high - low) * self.marks).reshape(-1, self.marks)
        return out


def beyond(toxic: np.ndarray, clean: np.ndarray, texts: tuple[int, int]) -> np.ndarray:
    """How much better a rate of its own in toxic texts explains a string than one rate for all, in nats; 0 if it is lower."""
    share = texts[0] / (texts[0] + texts[1])
    both = toxic + clean
    p = toxic / np.maximum(both, 1e-12)
    gain = toxic * np.log(np.maximum(p, 1e-12) / share) + clean * np.log(np.maximum(1 - p, 1e-12) / (1 - share))
    return np.where(p > share, gain, 0.0)


def choose(texts: Texts, toxic: np.ndarray, clean: np.ndarray, most: int = LANDMARKS) -> list[str]:
    """Landmarks, from both classes."""
    in_toxic, in_clean, sizes = texts.held(toxic), texts.held(clean), (len(toxic), len(clean))
    length = np.fromiter(map(len, texts.names), np.int64, len(texts.names))
    gain = beyond(in_toxic, in_clean, sizes) * ((length >= ORDER) & (length <= CUT))
    first = np.flatnonzero((in_toxic >= SUPPORT) & (gain > 0))
    first = first[np.lexsort((first, -gain[first]))][:CANDIDATES]
    if not len(first):
        return []
    names = [texts.names[k] for k in first.tolist()]
    full = Kernel(names).square()
    # strings like one another speak for each other
    joint = beyond(full @ in_toxic[first], full @ in_clean[first], sizes)
    total = np.maximum(joint, gain[first])
    good = np.flatnonzero(total >= BEYOND)
    marks = [names[k] for k in good[np.lexsort((good, -total[good]))][: most * 3 // 4].tolist()]
    if not marks:
        return []
    own = np.flatnonzero((in_clean > in_toxic) & (length >= ORDER) & (length <= CUT))
    kernel, near = Kernel(marks), np.zeros(len(own))
    for at in range(0, len(own), 16_384):
        number, _, like = kernel.whole([texts.names[k] for k in own[at : at + 16_384].tolist()])
        np.maximum.at(near, at + number, like * np.log1p(in_clean[own[at + number]]))
    chosen = np.lexsort((own, -near))[: most // 4]
    return marks + [texts.names[k] for k in own[chosen[near[chosen] > 0]].tolist()]


class Model:
    def __init__(self, landmarks: list[str]):
        self.landmarks, self.slope, self.shift = landmarks, np.ones(2), np.zeros(2)
        self.weights, self.bias = np.zeros((len(landmarks), 2)), -np.ones(2)
        self.kernel = Kernel(landmarks)
        value, vector = np.linalg.eigh(self.kernel.square().astype(np.float64))
        good = value > 1e-3 * max(value.max(), 1e-12)
        self.whiten = vector[:, good] / np.sqrt(value[good])

    def __getstate__(self) -> dict:
        return {k: getattr(self, k) for k in ("landmarks", "weights", "bias", "slope", "shift")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.kernel = Kernel(self.landmarks)

    def string_scores(self, words: list[str]) -> list[complex]:
        """What each string adds to its text's sum (the real part) and to its passages' sums (the imaginary part)."""
        number, mark, value = self.kernel.whole(words)
        mean, local = (np.bincount(number, value * w[mark], len(words)) for w in self.weights.T)
        return (mean + 1j * local).tolist()

    def margins(self, values: list[complex], index: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Texts' margins by both machines, from distinct strings' scores, each string's place among them, and texts' numbers of strings."""
        flat = np.array(values, np.complex128)[index]
        return both(flat.real, flat.imag, np.asarray(count, np.int64)) + self.bias

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return (1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -40, 40)))).max(1)

    def train(self, which: int, features: np.ndarray, label: np.ndarray, rounds: int = 100) -> Model:
        """Primal SVM with squared hinge loss by Newton steps on the examples within the margin; both classes weigh the same."""
        y = np.where(label > 0, 1.0, -1.0)
        weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
        z = np.empty((len(y), self.whiten.shape[1] + 1))
        z[:, :-1], z[:, -1] = features @ self.whiten, 1
        w, penalty, before = np.zeros(z.shape[1]), np.eye(z.shape[1]) * RIDGES[which], None
        penalty[-1, -1] = 1e-9
        for _ in range(rounds):
            active = y * (z @ w) < 1
            if before is not None and (active == before).all():
                break
            before = active
            a = z[active] * weight[active, None]
            w = np.linalg.solve(a.T @ z[active] + penalty, a.T @ y[active])
        self.weights[:, which], self.bias[which] = self.whiten @ w[:-1], w[-1]
        return self

    def calibrate(self, margin: np.ndarray, label: np.ndarray) -> None:
        """A slope by Platt's logistic fit for both machines; LEAST is where the labels are told apart best."""
        first, second = margin.T
        toxic = label > 0
        edge, told = best_edge(first, toxic)
        other, _ = best_edge(second, toxic)
        # all bars of the second machine from its own best one upwards, beside the first one's
        rest = np.flatnonzero((first < edge) & (second >= other))
        rest = rest[np.argsort(second[rest], kind="stable")]
        left = np.cumsum(toxic[rest][::-1])[::-1]
        already = first >= edge
        f1 = 2 * (toxic[already].sum() + left) / (already.sum() + toxic.sum() + np.arange(len(rest), 0, -1))
        good = np.flatnonzero(f1 >= told)
        if not len(rest) or (len(good) and not good[0]):
            bar = other
        else:
            bar = second[rest[good[0]]] if len(good) else second[rest[-1]] + 1e-6
        self.slope = np.array([platt(m, label) for m in (first, second)])
        self.shift = np.log(LEAST / (1 - LEAST)) - self.slope * np.array([edge, bar])


def both(mean: np.ndarray, local: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The means over texts and the sums of their strongest passages, from all their strings' scores in order."""
    total = np.concatenate(([0.0], np.cumsum(mean)))
    ends = np.concatenate(([0], np.cumsum(count)))
    return np.stack((SCALE * np.diff(total[ends]) / np.maximum(count, FEW), strongest(local, count)[2]), 1)


def best_edge(margin: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """The margin that tells labels apart best, and the F1 there."""
    order = np.argsort(-margin, kind="stable")
    f1 = 2 * np.cumsum(toxic[order]) / (np.arange(1, len(order) + 1) + toxic.sum())
    best = int(np.argmax(f1))
    return float(margin[order[best : best + 2]].mean()), float(f1[best])


def platt(margin: np.ndarray, label: np.ndarray) -> float:
    """The slope of a logistic fit of labels on margins, with smoothed targets."""
    pos, neg = (label > 0).sum(), (label <= 0).sum()
    target = np.where(label > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -40, 40)))
        g = np.array([((p - target) * margin).sum(), (p - target).sum()])
        r = p * (1 - p)
        h = np.array([[(r * margin * margin).sum(), (r * margin).sum()], [(r * margin).sum(), r.sum()]]) + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return a if a > 0 else 1.0


def fit(rows: Iterable[tuple[str, int]], folds: int = FOLDS) -> Model | None:
    """A model of labelled texts (text, 1 or 0)."""
    texts = Texts(rows)
    every = np.arange(len(texts.label))
    parts = [every] + [every[every % folds != k] for k in range(folds)]
    chosen = [choose(texts, *(p[texts.label[p] == k] for k in (1, 0))) if len(set(texts.label[p].tolist())) == 2 else [] for p in parts]
    if not chosen[0]:
        return None
    # all parts' landmarks together, so that the texts' strings are read once
    union = list(dict.fromkeys(x for own in chosen for x in own))
    place = {x: k for k, x in enumerate(union)}
    like = texts.kernels(Kernel(union))
    models, margins, seen = [], [], []
    for k, (part, own) in enumerate(zip(parts, chosen, strict=True)):
        if not own:
            continue
        mine = like.of([place[x] for x in own])
        model = Model(own).train(0, texts.means(mine)[part], texts.label[part])
        model.weights[:, 1] = model.weights[:, 0]
        for _ in range(ROUNDS):
            model.train(1, texts.passages(mine, mine.scores(model.weights[:, 1]))[part], texts.label[part])
        models.append(model)
        if k:
            rest = every[every % folds == k - 1]
            scores = (mine.scores(w)[texts.flat] for w in model.weights.T)
            margins.append((both(*scores, texts.lengths) + model.bias)[rest])
            seen.append(rest)
    if seen:
        models[0].calibrate(np.concatenate(margins), texts.label[np.concatenate(seen)])
    return models[0]


def labelled(docs: DataFrame, labels: DataFrame, fold: Column, out: int, sample: int = SAMPLE) -> Iterator[tuple[str, int]]:
    """A bounded sample of labelled texts of the folds to learn from, one after the other."""
    marks = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg((F.max(F.col("toxic").cast("int")) > 0).cast("int").alias("toxic"))
    pool = docs.filter(F.col("text").isNotNull() & (fold != out)).select("doc_id").distinct().join(marks, "doc_id")
    pool = materialize(pool.withColumn("key", F.xxhash64("doc_id")), "labelled")
    sizes = {r["toxic"]: r["count"] for r in pool.groupBy("toxic").count().collect()}
    # ids and marks are joined and cut to the sample first; texts are then fetched for it alone
    some = [least_keys(pool.filter(F.col("toxic") == k), "key", sample, sizes.get(k, 0), "doc_id") for k in (0, 1)]
    chosen = materialize(some[0].unionByName(some[1]), "sample")
    texts = docs.filter(F.col("text").isNotNull()).select("doc_id", "text")
    # at most twice the sample's rows are broadcast
    rows = texts.join(F.broadcast(chosen), "doc_id").orderBy("key", "text").select("text", "toxic").toLocalIterator()
    left = [sample, sample]
    for r in rows:
        if left[r["toxic"]]:
            left[r["toxic"]] -= 1
            yield r["text"], r["toxic"]


def score(docs: DataFrame, model: Model | None, rows: int = 512) -> DataFrame:
    """docs (all columns) with toxicity, between 0 and 1; a column of that name is replaced."""
    spark = docs.sparkSession
    ship_package(spark)
    docs = docs.drop("toxicity")
    if model is None:
        return docs.withColumn("toxicity", F.lit(0.0))
    sent = spark.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField("toxicity", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        cache = Cache(own.string_scores)
        for batch in batches:
            for part in pieces(batch, rows):
                keys, count = strings(part.column("text").to_pylist())
                margin = own.margins(*cache.of(keys), count)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(own.probability(margin))], schema.names)

    return docs.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, folds: int = 3, out: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted of every row, learned outside the held-out fold."""
    ship_package(docs.sparkSession)
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds, F.lit(-1))
    model = fit(labelled(docs, labels, fold, out))
    held = docs.select("doc_id", (fold == out).alias("held_out"), "text")
    return score(held, model).select("doc_id", "held_out", F.col("toxicity").alias("score"), (F.col("toxicity") >= LEAST).cast("int").alias("predicted"))
