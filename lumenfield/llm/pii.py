"""Personal data by patterns, and by a character-level bidirectional LSTM with CRF transitions.

Base spans follow fixed patterns for email, ip, card and phone, found in linear time in whole texts.
A bidirectional LSTM over characters with a linear-chain CRF on top is trained here in numpy, on
labelled spans: the base spans of a bounded sample of documents, as they are and in altered forms
that the patterns miss (an email with its signs spelled out or in brackets, a phone without its plus,
a card or an ip with other separators), FORMS of each, each labelled with its kind. It reads overlapping windows of
the whole text; every window is decoded by the CRF, and the spans of all windows are reconciled for
the text as a whole: those cut by a window's inner edge are left to the window that has them whole;
what may be too long for that is read again in a window of its own, whole up to LONGEST characters.
A span that cuts a word grows over it.
Of spans that overlap, the set with the highest total confidence stays. Base spans always stay, and
what the network adds has to touch none of them, to have the parts of its kind and to be sure.

The network computes in single precision. A window that no span with the parts of its kind can come
from, with no sign for at and too few digits in it or near it, is not computed: all that the network
could say there would be dropped, so the result is that of all windows. A window whose characters all lie so far on the side of
"no span" that no path of tags can win is "no span" throughout, without the sums of the CRF.

Offsets are code points, ends exclusive. Null texts are empty; empty texts have no spans. Repeated
rows and null doc_ids each keep their row. Other columns are ignored. Where the sample has no span at
all, only the patterns apply.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfield.llm.tables import least_keys, pieces
from lumenfield.session import ship_package

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, str]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
#: What stands between an address' parts, as a sign or spelled out.
_AT = re.compile(r"@|[\[(]\s*at\s*[\])]|\sat\s", re.IGNORECASE)
_DOT = re.compile(r"\.|[\[(]\s*dot\s*[\])]|\sdot\s", re.IGNORECASE)
_NUMBER = re.compile(r"[0-9]+")


def emails(text: str) -> list[Span]:
    """Matches of the email pattern. From each @ sign back over the local part, which holds none."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end(), "email"))
        # no local part reaches back over this sign or over a match
        end = found.end() if found else at + 1
        at = text.find("@", end)
    return out


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """All base spans, by start, then kind as listed."""
    out = emails(text) if "@" in text else []
    if _DIGITS.search(text):
        for m in _IP.finditer(text):
            if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
                out.append((*m.span(), "ip"))
        for m in _CARD.finditer(text):
            if 14 <= m.end() - m.start() <= 40 and 14 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and _luhn(d):
                out.append((*m.span(), "card"))
        for m in _PHONE.finditer(text) if "+" in text else ():
            if 10 <= len(_DIGITS.findall(m[0])) <= 15:
                out.append((*m.span(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


# --- the network -------------------------------------------------------------------------------------

TAGS = 1 + 2 * len(KINDS)
EMBED, HIDDEN, WINDOW, STRIDE = 12, 12, 384, 336
SAMPLE, EPOCHS, BATCH, RATE, SEED = 500, 20, 64, 0.015, 7
#: Altered forms of each span that training sees.
FORMS = 6
#: Characters of a training window, and of what windows are filled up to.
SHORT = FILL = 64
#: Least probability, over its characters, that a span is what the network says.
SURE = 0.9
#: A span this near to a window's inner edge is taken from the next window.
EDGE = 4
#: Characters of all windows of a block that are scored at once: what they need stays in a core's cache.
AT_ONCE = 8
#: Characters up to which a span is sure to be read whole: the longest address there may be.
LONGEST = 254


def codes(text: str) -> np.ndarray:
    """Characters as numbers: ASCII as it is, then other letters, other digits and the rest."""
    raw = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    out = np.minimum(raw, 130).astype(np.int64)
    high = np.flatnonzero(raw >= 128)
    if len(high):
        seen, place = np.unique(raw[high], return_inverse=True)
        out[high] = np.array([128 if (c := chr(x)).isalpha() else 129 if c.isdigit() else 130 for x in seen.tolist()])[place]
    return out


class Tagger:
    def __init__(self) -> None:
        rng = np.random.default_rng(SEED)
        scale = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
        self.p = {"embed": rng.normal(0, 0.5, (131, EMBED))}
        for d in "fb":
            self.p |= {f"x{d}": scale(EMBED, 4 * HIDDEN), f"h{d}": scale(HIDDEN, 4 * HIDDEN), f"c{d}": np.zeros(4 * HIDDEN)}
            self.p[f"c{d}"][HIDDEN : 2 * HIDDEN] = 1  # keep at first
        self.p |= {"out": scale(2 * HIDDEN, TAGS), "bias": np.zeros(TAGS), "step": np.zeros((TAGS, TAGS))}

    @staticmethod
    def allowed() -> np.ndarray:
        """Whether a tag (column) may follow another (row): an inner tag only its own kind's."""
        ok = np.ones((TAGS, TAGS), bool)
        for k in range(len(KINDS)):
            ok[:, 2 + 2 * k] = False
            ok[1 + 2 * k, 2 + 2 * k] = ok[2 + 2 * k, 2 + 2 * k] = True
        return ok

    def steps(self) -> np.ndarray:
        return np.where(self.allowed(), self.p["step"], -1e4)

    def _both(self, name: str) -> np.ndarray:
        """A parameter of the forward and the backward direction, one on the other."""
        return np.stack((self.p[f"{name}f"], self.p[f"{name}b"]))

    def emissions(self, x: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Scores of tags, time x rows x tags, for rows of character numbers; both directions step together."""
        e = self.p["embed"][x.T]
        n, rows = e.shape[:2]
        z = np.stack((e, e[::-1]), 1) @ self._both("x") + self._both("c")[:, None]
        again, h, c = self._both("h"), np.zeros((2, rows, HIDDEN), z.dtype), np.zeros((2, rows, HIDDEN), z.dtype)
        out, cells, tanh = (np.empty((n, 2, rows, HIDDEN), z.dtype) for _ in range(3))
        for t in range(n):
            own = z[t]
            own += h @ again
            gates = own[..., : 3 * HIDDEN]
            gates *= 0.5
            np.tanh(own, out=own)
            gates *= 0.5
            gates += 0.5
            i, f, o, g = own.reshape(2, rows, 4, HIDDEN).transpose(2, 0, 1, 3)
            c = np.multiply(f, c, out=cells[t])
            c += i * g
            h = np.multiply(o, np.tanh(c, out=tanh[t]), out=out[t])
        if keep is not None:
            keep |= {"e": e, "out": out, "cells": cells, "tanh": tanh, "z": z.reshape(n, 2, rows, 4, HIDDEN)}
        return np.concatenate((out[:, 0], out[::-1, 1]), axis=2) @ self.p["out"] + self.p["bias"]

    def _forward_backward(self, em: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities of tags given what is before; factors of what follows; rows' logarithms of all paths; times' weights of tags.

        The first two multiply to the tags' probabilities.
        """
        step = np.exp(self.steps())
        top = em.max(2, keepdims=True)
        own = np.exp(em - top, dtype=np.float64)
        fwd, bwd, size = np.empty_like(own), np.ones_like(own), np.empty((*own.shape[:2], 1))
        for t in range(len(own)):
            np.multiply(own[t], fwd[t - 1] @ step if t else 1.0, out=fwd[t])
            size[t] = fwd[t].sum(1, keepdims=True)
            fwd[t] /= size[t]
        own /= size
        for t in range(len(own) - 2, -1, -1):
            np.matmul(own[t + 1] * bwd[t + 1], step.T, out=bwd[t])
        return fwd, bwd, (np.log(size) + top).sum((0, 2)), own

    def marginals(self, em: np.ndarray) -> np.ndarray:
        fwd, bwd, *_ = self._forward_backward(em)
        return fwd * bwd

    def viterbi(self, em: np.ndarray) -> np.ndarray:
        """Best tags, rows x time."""
        step, score, back = self.steps(), em[0], []
        for t in range(1, len(em)):
            all_ = score[:, :, None] + step[None]
            back.append(all_.argmax(1))
            score = all_.max(1) + em[t]
        tags = [score.argmax(1)]
        for b in reversed(back):
            tags.append(b[np.arange(len(b)), tags[-1]])
        return np.stack(tags[::-1], 1)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean negative log likelihood of tags y."""
        keep: dict = {}
        em = self.emissions(x, keep)
        n, rows = em.shape[:2]
        fwd, bwd, _, own = self._forward_backward(em)
        d = fwd * bwd
        np.put_along_axis(d, y.T[:, :, None], np.take_along_axis(d, y.T[:, :, None], 2) - 1, 2)
        d = (d / (rows * 8)).astype(em.dtype)
        g = {"step": (fwd[:-1].reshape(-1, TAGS).T @ (own[1:] * bwd[1:]).reshape(-1, TAGS)) * np.exp(self.steps())}
        np.add.at(g["step"], (y[:, :-1].ravel(), y[:, 1:].ravel()), -1)
        g["step"] *= self.allowed() / (rows * 8)
        out, cells, tanh, z = keep["out"], keep["cells"], keep["tanh"], keep["z"]
        both = np.concatenate((out[:, 0], out[::-1, 1]), axis=2)
        g["out"], g["bias"] = both.reshape(n * rows, -1).T @ d.reshape(n * rows, -1), d.sum((0, 1))
        dh_all = d @ self.p["out"].T
        dh_all = np.stack((dh_all[..., :HIDDEN], dh_all[::-1, :, HIDDEN:]), 1)
        i, f, o, new = (z[..., k, :] for k in range(4))
        before = np.zeros_like(cells)
        before[1:] = cells[:-1]
        # what the cell (and for the third gate the output) gives to each gate's input
        give = np.stack((new * i * (1 - i), before * f * (1 - f), tanh * o * (1 - o), i * (1 - new * new)), 3)
        to_cell, again = o * (1 - tanh * tanh), self._both("h").transpose(0, 2, 1)
        dz, dh, dc = np.empty_like(give), np.zeros_like(out[0]), np.zeros_like(out[0])
        for t in range(n - 1, -1, -1):
            dh = dh + dh_all[t]
            dc = dc + dh * to_cell[t]
            np.multiply(give[t], dc[:, :, None], out=dz[t])
            np.multiply(give[t, :, :, 2], dh, out=dz[t, :, :, 2])
            dh = dz[t].reshape(2, rows, -1) @ again
            dc *= f[t]
        de = np.zeros_like(keep["e"])
        for k, way in enumerate("fb"):
            own_dz, e = dz[:, k].reshape(n, rows, -1), keep["e"][:: 1 - 2 * k]
            g[f"h{way}"] = out[:-1, k].reshape(-1, HIDDEN).T @ own_dz[1:].reshape(-1, 4 * HIDDEN)
            g[f"x{way}"], g[f"c{way}"] = e.reshape(-1, EMBED).T @ own_dz.reshape(-1, 4 * HIDDEN), own_dz.sum((0, 1))
            de += (own_dz @ self.p[f"x{way}"].T)[:: 1 - 2 * k]
        g["embed"] = np.zeros_like(self.p["embed"])
        np.add.at(g["embed"], x.T, de)
        return g

    def train(self, x: np.ndarray, y: np.ndarray) -> Tagger:
        rng = np.random.default_rng(SEED)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(q) for k, q in self.p.items()}
        t, order = 0, np.arange(len(x))
        for epoch in range(EPOCHS):
            rng.shuffle(order)
            for at in range(0, len(order), BATCH):
                own, t = order[at : at + BATCH], t + 1
                g = self.gradients(x[own], y[own])
                norm = np.sqrt(sum(float((q * q).sum()) for q in g.values()))
                rate = RATE * (1 - epoch / EPOCHS) * np.sqrt(1 - 0.999**t) / (1 - 0.9**t) * min(1, 5 / max(norm, 1e-9))
                for k, q in g.items():
                    m[k] += 0.1 * (q - m[k])
                    v[k] += 0.001 * (q * q - v[k])
                    self.p[k] -= rate * m[k] / (np.sqrt(v[k]) + 1e-8)
        return self


class Reader:
    """A trained tagger for reading: the same network in single precision, all windows of a block at once."""

    def __init__(self, model: Tagger):
        self.model, p = model, {k: v.astype(np.float32) for k, v in model.p.items()}
        # what a step reads, half the state before it, the character's embedding and a 1, to the gates, with z turned about: a gate
        # is 1 / (1 + exp(z)), and the new cell's tanh 2 / (1 + exp(z)) - 1
        sign = np.repeat(np.float32([-1, -1, -1, -2]), HIDDEN)[:, None]
        self.gates = np.stack([np.concatenate((2 * p[f"h{d}"], p[f"x{d}"], p[f"c{d}"][None])).T * sign for d in "fb"])
        self.embed = p["embed"]
        self.out = 2 * np.stack((p["out"][:HIDDEN].T, p["out"][HIDDEN:].T))
        self.bias = p["bias"][:, None]
        self.held = np.empty(0, np.float32)

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """Scores of tags, time x tags x rows, for rows of character numbers; both directions step together."""
        rows, n = x.shape
        x = np.ascontiguousarray(x.T, np.intp)
        shape = (n + 1, 2, self.gates.shape[2], rows)
        if self.held.size < np.prod(shape):
            self.held = np.empty(np.prod(shape), np.float32)
        held = self.held[: np.prod(shape)].reshape(shape)
        held[0, :, :HIDDEN], held[:-1, :, -1] = 0, 1
        held[:-1, 0, HIDDEN:-1] = self.embed.take(x, axis=0).transpose(0, 2, 1)
        held[:-1, 1, HIDDEN:-1] = held[-2::-1, 0, HIDDEN:-1]
        z = np.empty((2, 4 * HIDDEN, rows), np.float32)
        i, f, o, new = (z[:, k * HIDDEN : (k + 1) * HIDDEN] for k in range(4))
        # minus twice the cell, whose tanh is 2 / (1 + exp(c)) - 1
        c, tanh = np.zeros_like(new), np.empty_like(new)
        with np.errstate(over="ignore"):  # the gate is 0 then
            for t in range(n):
                np.matmul(self.gates, held[t], out=z)
                np.exp(z, out=z)
                np.add(z, 1, out=z)
                np.divide(1, z[:, : 3 * HIDDEN], out=z[:, : 3 * HIDDEN])
                np.divide(-4, new, out=new)
                np.add(new, 2, out=new)
                np.multiply(c, f, out=c)
                np.multiply(new, i, out=new)
                np.add(c, new, out=c)
                np.exp(c, out=tanh)
                np.add(tanh, 1, out=tanh)
                np.divide(1, tanh, out=tanh)
                np.subtract(tanh, 0.5, out=tanh)
                np.multiply(o, tanh, out=held[t + 1, :, :HIDDEN])
        em = np.empty((n, TAGS, rows), np.float32)
        ahead, back = held[1:, 0, :HIDDEN], held[:0:-1, 1, :HIDDEN]
        for t in range(0, n, AT_ONCE):
            own = em[t : t + AT_ONCE]
            np.matmul(self.out[0], ahead[t : t + AT_ONCE], out=own)
            own += np.matmul(self.out[1], back[t : t + AT_ONCE])
            own += self.bias
        return em

    def open_rows(self, em: np.ndarray) -> np.ndarray:
        """Rows in which some path with a span might beat the one without any.

        Against that one, a span gains its characters' scores and steps. Each span of a path gains at
        most what the best one does that is entered from any tag and left at no cost, or better.
        """
        step = self.model.steps()
        first, inner = np.arange(1, TAGS, 2), np.arange(2, TAGS, 2)
        enter = (step[:, first].max(0) - step[0, 0]).astype(np.float32)[:, None]
        begin = (step[first, inner] - step[0, 0]).astype(np.float32)[:, None]
        go = (step[inner, inner] - step[0, 0]).astype(np.float32)[:, None]
        leave = max(0.0, float(step[1:, 0].max() - step[0, 0]))
        b, i = np.full((2, len(KINDS), em.shape[2]), -1e9, np.float32)
        best = np.full((len(KINDS), em.shape[2]), -1e9, np.float32)
        for t in range(0, len(em), AT_ONCE):
            gain = em[t : t + AT_ONCE, 1:] - em[t : t + AT_ONCE, :1]
            for own in gain:
                np.add(b, begin, out=b)
                np.add(i, go, out=i)
                np.maximum(b, i, out=i)
                np.add(i, own[1::2], out=i)
                np.add(enter, own[::2], out=b)
                np.maximum(best, b, out=best)
                np.maximum(best, i, out=best)
        return np.flatnonzero(best.max(0) + leave > -1e-3)


# --- labelled spans ------------------------------------------------------------------------------------


def altered(value: str, kind: str, rng: np.random.Generator) -> str:
    """A form of a value that the base patterns miss or cut short."""
    pick = lambda *x: x[int(rng.integers(len(x)))]
    if kind == "email":
        name, _, host = value.partition("@")
        sign = pick(" @ ", "(@)", "[@]", " (at) ", " [at] ", " at ")
        return name + sign + (host.replace(".", pick(" dot ", ".")) if sign == " at " else host)
    if kind == "phone":
        return value.replace("+", pick("", "00"), 1).replace(" ", pick(" ", "-", ".", " "))
    if kind == "card":
        digits = re.sub("[^0-9]", "", value)
        return pick(".", "/", "_", "  ").join(digits[k : k + 4] for k in range(0, len(digits), 4))
    return value.replace(".", pick(" . ", "[.]", "(.)"))


def examples(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Windows of texts around spans and around other digits, as they are and altered, with their tags."""
    rng = np.random.default_rng(SEED)
    xs, ys = [], []

    def add(text: str, spans: list[Span], middle: int) -> None:
        start = max(0, middle - int(rng.integers(4, SHORT - 28)))
        part = text[start : start + SHORT].ljust(SHORT)
        tags = np.zeros(SHORT, np.int64)
        for a, b, kind in spans:
            lo, hi, tag = max(a - start, 0), min(b - start, SHORT), 1 + 2 * KINDS.index(kind)
            if lo < hi:
                tags[lo:hi] = tag + 1
                tags[lo] = tag
        xs.append(codes(part))
        ys.append(tags)

    for text in texts:
        spans: list[Span] = []
        for s in base_spans(text):
            if not spans or s[0] >= spans[-1][1]:
                spans.append(s)
        for a, b, kind in spans:
            add(text, spans, a)
            around = text[max(0, a - WINDOW) : a]
            near = [(x - a + len(around), y - a + len(around), k) for x, y, k in spans if y <= a and x >= a - len(around)]
            for _ in range(FORMS):
                new = altered(text[a:b], kind, rng)
                add(around + new + text[b : b + WINDOW].split("@")[0], [*near, (len(around), len(around) + len(new), kind)], len(around))
        inside = {k for a, b, _ in spans for k in range(a, b)}
        others = [m.start() for m in re.finditer("[0-9@]", text) if m.start() not in inside]
        for at in others[:: max(1, len(others) // 3)][:3]:
            add(text, spans, at)
        for _ in range(3):
            add(text, spans, int(rng.integers(len(text))))
    return np.array(xs).reshape(-1, SHORT), np.array(ys).reshape(-1, SHORT)


def fit(docs: DataFrame, sample: int = SAMPLE, around: int = 4000) -> Tagger | None:
    """Trained on at most `sample` documents with a digit or @ sign, those of least hash: on the stretch of `around` characters about the first one."""
    start = F.greatest(F.regexp_instr("text", F.lit("[0-9@]")) - around // 2, F.lit(1))
    some = docs.filter(F.col("text").rlike("[0-9@]"))
    keyed = some.select(F.col("text").substr(start, F.lit(around)).alias("part"), F.xxhash64("doc_id", "text").alias("key"))
    rows = least_keys(keyed, "key", sample, some.count(), "part").collect()
    x, y = examples(list(dict.fromkeys(r["part"] for r in rows)))
    return Tagger().train(x, y) if (y > 0).any() else None


# --- reading texts -------------------------------------------------------------------------------------


def _plausible(value: str, kind: str) -> bool:
    digits = len(_DIGITS.findall(value))
    if kind == "email":
        at = _AT.search(value)
        return bool(at) and at.start() > 0 and bool(_DOT.search(value, at.end())) and len(value) >= 7
    if kind == "ip":
        parts = _NUMBER.findall(value)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 14 <= digits <= 19 and _luhn(re.sub("[^0-9]", "", value))
    return 10 <= digits <= 15


def _whole_words(text: str, a: int, b: int) -> tuple[int, int]:
    """A span grown over the words that it cuts, none further than LONGEST characters; what fills a window up is no part of it."""
    a, b = min(a, len(text)), min(b, len(text))
    if a == b:
        return a, b
    least, most = max(0, a - LONGEST), min(len(text), b + LONGEST)
    while a > least and text[a].isalnum() and text[a - 1].isalnum():
        a -= 1
    while b < most and text[b - 1].isalnum() and text[b].isalnum():
        b += 1
    return a, b


def _best(spans: list[tuple[int, int, str, float]]) -> list[Span]:
    """Spans that don't overlap, with the highest total confidence."""
    spans = sorted(set(spans), key=lambda s: (s[1], s[0], s[2]))
    ends = [s[1] for s in spans]
    total, take = [0.0], []
    for a, _, _, sure in spans:
        fits = int(np.searchsorted(ends, a, "right"))
        take.append((total[fits] + sure > total[-1], fits))
        total.append(max(total[-1], total[fits] + sure))
    out, k = [], len(spans)
    while k:
        chosen, fits = take[k - 1]
        if chosen:
            out.append(spans[k - 1][:3])
        k = fits if chosen else k - 1
    return out[::-1]


def _read(texts: list[str], reader: Reader, jobs: list[tuple[int, int]], wide: int, step: int) -> Iterator[tuple[int, int, int, int, str, float]]:
    """Spans in windows (text, start): text, start, the span's begin and end in the window, kind, confidence.

    The last window of a text is filled up to a multiple of FILL; windows of one width are read together.
    """
    by_width: dict[int, list[tuple[int, int]]] = {}
    for k, a in jobs:
        by_width.setdefault(min(wide, -(-(len(texts[k]) - a) // FILL) * FILL), []).append((k, a))
    for width, own_jobs in by_width.items():
        held, names = [], []
        for at in range(0, len(own_jobs), step):
            some = own_jobs[at : at + step]
            em = reader.emissions(codes("".join([texts[k][a : a + width].ljust(width) for k, a in some])).reshape(len(some), width))
            rows = reader.open_rows(em)
            if len(rows):
                held.append(em[:, :, rows])
                names += [some[n] for n in rows.tolist()]
            # few rows are open: those of several blocks are decoded together
            if names and (len(names) >= step or at + step >= len(own_jobs)):
                yield from _decode(reader.model, np.concatenate(held, 2).transpose(0, 2, 1).astype(np.float64, "C"), names)
                held, names = [], []


def _decode(model: Tagger, em: np.ndarray, names: list[tuple[int, int]]) -> Iterator[tuple[int, int, int, int, str, float]]:
    """Spans of the best tags in windows of one width, and their characters' mean probability."""
    tags = model.viterbi(em)
    rows = np.flatnonzero(tags.any(1))
    sure = model.marginals(em[:, rows]) if len(rows) else None
    for r, row in enumerate(rows.tolist()):
        (k, a), own, t = names[row], tags[row], 0
        while t < len(own):
            if own[t] == 0 or own[t] % 2 == 0:
                t += 1
                continue
            end = t + 1
            while end < len(own) and own[end] == own[t] + 1:
                end += 1
            yield k, a, t, end, KINDS[(own[t] - 1) // 2], float(sure[np.arange(t, end), r, own[t:end]].mean())
            t = end


def windows(text: str) -> list[int]:
    """Starts of the windows of a text that a plausible span can come from; every other span would be dropped by _plausible.

    What a window can lead to, by itself or by what is read again for it and grows over the words that it cuts,
    lies within 2 * LONGEST + EDGE characters about it. A plausible span has a sign for at, written or
    spelled out, or four digits at least.
    """
    raw = np.frombuffer(f"\0{text}\0\0".encode("utf-32-le"), np.uint32)
    lower = raw | np.uint32(32)
    digit = raw - np.uint32(48) < 10
    word = digit | (lower - np.uint32(97) < 26)
    spelled = (lower[1:-2] == ord("a")) & (lower[2:-1] == ord("t")) & ~word[:-3] & ~word[3:]
    signs, digits = np.flatnonzero(spelled | (raw[1:-2] == ord("@"))), np.flatnonzero(digit[1:-2])
    # until one reaches the end
    starts = np.arange(0, max(1, len(text) - WINDOW + STRIDE), STRIDE)
    reach = 2 * LONGEST + EDGE
    inside = lambda at: np.searchsorted(at, starts + WINDOW + reach) - np.searchsorted(at, starts - reach)
    return starts[(inside(signs) > 0) | (inside(digits) >= 4)].tolist()


def network_spans(texts: list[str], reader: Reader, step: int = 512) -> list[list[Span]]:
    """What the network finds in each text, all windows reconciled."""
    jobs = [(k, a) for k, text in enumerate(texts) if text for a in windows(text)]
    found: list[list[tuple[int, int, str, float]]] = [[] for _ in texts]
    again: set[tuple[int, int]] = set()

    def take(k: int, a: int, b: int, kind: str, p: float) -> None:
        a, b = _whole_words(texts[k], a, b)
        if p >= SURE and _plausible(texts[k][a:b], kind):
            found[k].append((a, b, kind, p))

    for k, a, t, end, kind, p in _read(texts, reader, jobs, WINDOW, step):
        left, right = t < EDGE and a > 0, end > WINDOW - EDGE and a + WINDOW < len(texts[k])
        if (right and t < STRIDE + EDGE) or (left and end > WINDOW - EDGE - STRIDE):
            # the windows beside this one need not have it whole either
            again.add((k, max(0, a + t - LONGEST - EDGE)))
        if not (left or right):
            take(k, a + t, a + end, kind, p)
    wide = 2 * (LONGEST + EDGE)
    for k, a, t, end, kind, p in _read(texts, reader, sorted(again), wide, max(1, step * WINDOW // wide)):
        whole = (t >= EDGE or a == 0) and (end <= wide - EDGE or a + wide >= len(texts[k]))
        # shorter ones were read before
        if whole and end - t > WINDOW - 2 * EDGE - STRIDE:
            take(k, a + t, a + end, kind, p)
    return [_best(f) for f in found]


def spans(texts: list[str], reader: Reader | None) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text."""
    base = [base_spans(t) for t in texts]
    added = network_spans(texts, reader) if reader else [[] for _ in texts]
    out = []
    for own, more in zip(base, added, strict=True):
        held = sorted((a, b) for a, b, _ in own)
        starts, reach = [a for a, _ in held], list(np.maximum.accumulate([b for _, b in held])) if held else []
        free = []
        for s in more:
            k = int(np.searchsorted(starts, s[1], "left"))
            if not k or reach[k - 1] <= s[0]:
                free.append(s)
        out.append((own, sorted([*own, *free], key=lambda s: (s[0], KINDS.index(s[2]), s[1]))))
    return out


def _join(some: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in some)


def redacted(text: str, some: list[Span]) -> str:
    """The text with each span, or each run of overlapping ones, replaced by its first kind in brackets."""
    out, at = [], 0
    for a, b, kind in some:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def find(docs: DataFrame, model: Tagger | None, rows: int = 1024) -> DataFrame:
    """doc_id; n_email, n_ip, n_card, n_phone of base spans; base_sha256; spans; n_added."""
    ship_package(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = sent.value and Reader(sent.value)
        for batch in batches:
            for part in pieces(batch, rows):
                got = spans([t or "" for t in part.column("text").to_pylist()], reader)
                cols = [part.column("doc_id")]
                cols += [pa.array([sum(s[2] == k for s in b) for b, _ in got], pa.int64()) for k in KINDS]
                cols += [pa.array([hashlib.sha256(_join(b).encode()).hexdigest() for b, _ in got])]
                cols += [pa.array([_join(s) for _, s in got]), pa.array([len(s) - len(b) for b, s in got], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names)

    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, {counts}, base_sha256 string, spans string, n_added long")


def redact(docs: DataFrame, model: Tagger | None, rows: int = 1024) -> DataFrame:
    """docs (all columns), texts with their spans replaced; null texts stay null."""
    ship_package(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType(list(docs.schema.fields))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = sent.value and Reader(sent.value)
        for batch in batches:
            for part in pieces(batch, rows):
                texts = part.column(at).to_pylist()
                got = spans([t or "" for t in texts], reader)
                new = [t and redacted(t, s) for t, (_, s) in zip(texts, got, strict=True)]
                cols = list(part.columns)
                cols[at] = pa.array(new, part.column(at).type)
                yield pa.RecordBatch.from_arrays(cols, names=part.schema.names)

    return docs.mapInArrow(run, schema)
