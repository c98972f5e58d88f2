"""Secrets by patterns, and by a linear-chain conditional random field over tokens.

Base spans follow three patterns (assign: a key word, a sign and a value; access: an access key id;
hex: a long run of hexadecimal digits), found in linear time in whole texts. The field is trained here
in numpy on labelled spans: the base spans of a bounded sample of documents, and written forms of the
three kinds in their places that the patterns miss (other key words and signs, capitals, groups). Its
tags are outside, and begin and inside of each kind. A token is a word or a single sign. What speaks
for a tag: the token's and its four neighbours' word, shape, length, characters and vowels, and three
features of the file: how much of it is signs, how many of these are = or :, how long its lines are.

Texts are decoded whole by Viterbi, never in windows. A bound on what a span can gain over "outside"
shows which tokens no winning span can hold; the chain is decoded in the stretches between these, and
the result is that of decoding all tokens (test: the same tags without the bound).

Base spans always stay; what the field adds touches none of them, has what its kind must have, and is
sure. Offsets are code points, ends exclusive. Null texts are empty; empty texts have no spans.
Repeated rows and null doc_ids each keep their row. Other columns are ignored. Where the sample has no
base span, only the patterns apply.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfield.llm.cache import Cache
from lumenfield.llm.pii import redacted
from lumenfield.llm.tables import least_keys, pieces
from lumenfield.plans.scratch import materialize
from lumenfield.session import ship_package

KINDS = ("assign", "access", "hex")
Span = tuple[int, int, str]

_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_FIRST = ("passw", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
#: What a document must hold to be of use for training, as a JVM pattern.
_LIKELY = r"AKIA[A-Z0-9]{12}|[0-9a-f]{32}|(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"
#: A word, with the signs that keys and values have inside, or a single sign.
_TOKEN = re.compile(r"\w+(?:[+/-]\w+)*|[^\s\w]")

TAGS = 1 + 2 * len(KINDS)
ROLES, BITS, FEATURES, FILE = 5, 14, 6, 24
BUCKETS = 1 << BITS
#: Documents that training looks at: so many with something like a secret, and so many others.
SAMPLE, OTHERS, FORMS = 400, 200, 8
WIDTH, ROUNDS, RATE, DECAY, SEED = 48, 120, 0.1, 1e-4, 11
#: Least mean probability of a span's tags.
SURE = 0.6
#: Tokens between two texts of a batch, which are outside.
GAP, CLOSED = 2, -1e4


def base_spans(text: str) -> list[Span]:
    """All base spans, by start, then kind as listed."""
    low = text.lower()
    out = [(*m.span(), "assign") for m in _ASSIGN.finditer(text) if len(m[1]) >= 8] if any(k in low for k in _FIRST) else []
    out += [(*m.span(), "access") for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [(*m.span(), "hex") for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


# --- features ------------------------------------------------------------------------------------------


#: Characters of a token that its features look at.
_SEEN = 24
_CLASS = np.array([1 if chr(k).isupper() else 2 if chr(k).islower() else 3 if chr(k).isdigit() else 4 for k in range(128)] + [5], np.uint64)
_CLASS[0] = 0  # no character
_IS_HEX, _IS_VOWEL = (np.array([chr(k).lower() in some for k in range(128)] + [False]) for some in ("0123456789abcdef", "aeiou"))


def _features(tokens: list[str]) -> np.ndarray:
    """Bucket numbers of what is to be seen of tokens: word, shape, length, characters, vowels, and all in one; tokens x FEATURES."""
    code = np.array(tokens, f"<U{_SEEN}").view(np.uint32).reshape(len(tokens), _SEEN)
    n = np.fromiter(map(len, tokens), np.int64, len(tokens))
    small = np.minimum(code, 128)
    kind = _CLASS[small]
    used = np.maximum((kind > 0).sum(1), 1)
    digits, capitals = (kind == 3).sum(1), (kind == 1).sum(1)
    letters = np.where((kind == 5).any(1), 2, (_IS_HEX[small] | (kind == 0)).all(1))
    word = (code + 32 * (kind == 1)).astype(np.uint64)
    powers = np.cumprod(np.full(_SEEN, 1_000_003, np.uint64))
    word = np.where(n <= 12, (word * powers).sum(1), 1)
    # runs of one class, the first eight of them
    new = kind != np.concatenate((np.zeros((len(tokens), 1), np.uint64), kind[:, :-1]), 1)
    run = np.cumsum(new, 1)
    shape = (np.where(new & (run <= 8), kind, 0) * np.uint64(6) ** np.minimum(run, 8).astype(np.uint64)).sum(1)
    length = np.where(n < 8, n, 8 + (2 * np.log2(np.clip(n, 8, 256))).astype(np.int64))
    long = (n >= 16).astype(np.int64) + (n >= 32)
    all_capital = (capitals > 0) & ~(kind == 2).any(1)
    vowels = _IS_VOWEL[small].sum(1) * 4 // used
    share = digits * 4 // used
    values = [word, shape, length, letters * 8 + share, (vowels * 2 + (digits > 0)) * 2 + (n >= 12), ((letters * 4 + long) * 2 + all_capital) * 2 + (digits > 0)]
    keys = np.stack([v.astype(np.uint64) for v in values], 1) * np.uint64(8) + np.arange(FEATURES, dtype=np.uint64)
    return (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)).astype(np.int64)


def _file_features(text: str, tokens: int) -> tuple[int, int, int]:
    """Bucket numbers of a text as a whole."""
    if not text:
        return 0, 8, 16
    marks = text.count("=") + text.count(":")
    lines = len(text) / (1 + text.count("\n"))
    level = lambda x: min(7, int(math.log2(1 + max(0, x))))
    return level(200 * tokens / len(text) - 20), 8 + level(2000 * marks / len(text)), 16 + level(lines / 20)


# --- the field -----------------------------------------------------------------------------------------


def allowed() -> np.ndarray:
    """Whether a tag (column) may follow another (row): an inner one only its own kind's."""
    ok = np.ones((TAGS, TAGS), bool)
    for k in range(len(KINDS)):
        ok[:, 2 + 2 * k] = False
        ok[1 + 2 * k, 2 + 2 * k] = ok[2 + 2 * k, 2 + 2 * k] = True
    return ok


class Field:
    """weights: roles x buckets x tags; file: buckets x tags; step: tags x tags. A chain starts and ends beside an outer tag."""

    def __init__(self) -> None:
        self.weights = np.zeros((ROLES, BUCKETS, TAGS), np.float32)
        self.file = np.zeros((FILE, TAGS), np.float32)
        self.step = np.zeros((TAGS, TAGS), np.float32)

    def steps(self) -> np.ndarray:
        return np.where(allowed(), self.step.astype(np.float64), CLOSED)

    def rows(self, tokens: list[str]) -> list[bytes]:
        """What each token gives to the tags in each role."""
        if not tokens:
            return []
        found = _features(tokens)
        total = self.weights[:, found[:, 0]]
        for k in range(1, FEATURES):
            total += self.weights[:, found[:, k]]
        size = 4 * ROLES * TAGS
        flat = np.ascontiguousarray(total.transpose(1, 0, 2)).tobytes()
        return [flat[a : a + size] for a in range(0, len(flat), size)]

    def _chain(self, em: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of scores time x rows x tags: what is before, what follows, each time's weights and the logarithm of all paths' sum."""
        step = np.exp(self.steps())
        top = em.max(2, keepdims=True)
        own = np.exp(em - top, dtype=np.float64)
        fwd, bwd, size = np.empty_like(own), np.empty_like(own), np.empty((*own.shape[:2], 1))
        for t in range(len(own)):
            np.multiply(own[t], fwd[t - 1] @ step if t else step[0], out=fwd[t])
            size[t] = fwd[t].sum(1, keepdims=True)
            fwd[t] /= size[t]
        own /= size
        last = fwd[-1] @ step[:, 0]
        bwd[-1] = step[:, 0] / last[:, None]
        for t in range(len(own) - 2, -1, -1):
            np.matmul(own[t + 1] * bwd[t + 1], step.T, out=bwd[t])
        return fwd, bwd, own, (np.log(size) + top).sum((0, 2)) + np.log(last)

    def marginals(self, em: np.ndarray) -> np.ndarray:
        fwd, bwd, *_ = self._chain(em)
        return fwd * bwd

    def viterbi(self, em: np.ndarray) -> np.ndarray:
        """Best tags, time x rows."""
        step, back = self.steps(), []
        score = em[0] + step[0]
        for t in range(1, len(em)):
            all_ = score[:, :, None] + step[None]
            back.append(all_.argmax(1))
            score = all_.max(1) + em[t]
        tags = [(score + step[:, 0]).argmax(1)]
        for b in reversed(back):
            tags.append(b[np.arange(len(b)), tags[-1]])
        return np.stack(tags[::-1])

    def gradient(self, em: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Of the negative log likelihood of tags y (time x rows): by scores, by steps; and that itself."""
        fwd, bwd, own, total = self._chain(em)
        d = fwd * bwd
        steps = self.steps()
        g = (fwd[:-1].reshape(-1, TAGS).T @ (own[1:] * bwd[1:]).reshape(-1, TAGS)) * np.exp(steps)
        g[0] += d[0].sum(0)
        g[:, 0] += d[-1].sum(0)
        padded = np.vstack((np.zeros((1, y.shape[1]), y.dtype), y, np.zeros((1, y.shape[1]), y.dtype)))
        loss = float(total.sum() - np.take_along_axis(em, y[:, :, None], 2).sum() - steps[padded[:-1], padded[1:]].sum())
        np.add.at(g, (padded[:-1].ravel(), padded[1:].ravel()), -1)
        np.put_along_axis(d, y[:, :, None], np.take_along_axis(d, y[:, :, None], 2) - 1, 2)
        return d, g * allowed(), loss

    def train(self, windows: list[tuple[list[str], list[int], tuple[int, int, int]]]) -> Field:
        """Adam over windows of tokens, WIDTH + 4 of them, tags of the WIDTH inner ones, and file features; all windows a round."""
        number: dict[str, int] = {}
        x = np.array([[number.setdefault(t, len(number)) for t in w] for w, _, _ in windows]).T
        y, file = np.array([t for _, t, _ in windows]).T, np.array([f for *_, f in windows])
        blank = number.get("", -1)  # places outside a text give nothing
        seen = _features([t or " " for t in number])
        buckets, place = np.unique(seen, return_inverse=True)
        place = place.reshape(seen.shape)
        p = [np.zeros((ROLES, len(buckets), TAGS)), np.zeros((FILE, TAGS)), np.zeros((TAGS, TAGS))]
        m, v = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p]
        for t in range(1, ROUNDS + 1):
            self.step = p[2]
            of_token = p[0][:, place].sum(2)
            if blank >= 0:
                of_token[:, blank] = 0
            em = sum(of_token[r][x[r : r + WIDTH]] for r in range(ROLES)) + p[1][file].sum(1)
            d, g_step, _ = self.gradient(em, y)
            own = np.empty((ROLES, len(number), TAGS))
            flat = d.reshape(-1, TAGS)
            for r in range(ROLES):
                at = x[r : r + WIDTH].ravel()
                own[r] = np.stack([np.bincount(at, flat[:, k], len(number)) for k in range(TAGS)], 1)
            if blank >= 0:
                own[:, blank] = 0
            g_w = np.zeros_like(p[0])
            for r in range(ROLES):
                for k in range(TAGS):
                    g_w[r, :, k] = np.bincount(place.ravel(), np.repeat(own[r, :, k], FEATURES), len(buckets))
            g_file = np.zeros_like(p[1])
            np.add.at(g_file, file.ravel(), np.repeat(d.sum(0), file.shape[1], 0))
            for q, g, mq, vq in zip(p, (g_w, g_file, g_step), m, v, strict=True):
                g = g / len(windows) + DECAY * q
                mq += 0.1 * (g - mq)
                vq += 0.01 * (g * g - vq)
                q -= RATE * (mq / (1 - 0.9**t)) / (np.sqrt(vq / (1 - 0.99**t)) + 1e-8)
        self.weights[:, buckets] = p[0]
        self.file, self.step = p[1].astype(np.float32), p[2].astype(np.float32)
        return self


# --- labelled spans ------------------------------------------------------------------------------------

_KEYS = ("pwd", "pass", "passphrase", "auth", "bearer", "credential", "private_key", "access_key", "signing_key", "pin_code", "login")
_SIGNS = (" is ", " -> ", " => ", " := ", "=", ": ", " = ", " : ", "='", ' = "', " ")
_BASE62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def written(kind: str, value: str, rng: np.random.Generator) -> str:
    """A secret of a kind in a form that the patterns miss or cut short; value: the characters of one as it is."""
    pick = lambda *x: x[int(rng.integers(len(x)))]
    drawn = lambda letters, n: "".join(letters[int(k)] for k in rng.integers(len(letters), size=n))
    if kind == "assign":
        secret = pick(value, value.upper(), drawn(_BASE62, int(rng.integers(12, 41))), drawn(_BASE62 + "+/-_", int(rng.integers(16, 41))))
        if pick(0, 0, 1):
            return pick("password", "secret", "token", "api_key", "API key", "passwd") + pick(" is ", " -> ", " => ", " := ", " ") + secret
        key = pick(*_KEYS)
        return pick(key, key.upper(), key.capitalize()) + pick(*_SIGNS) + secret
    if kind == "access":
        body = drawn("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16)
        form = pick("lower", "dash", "space", "other")
        if form == "lower":
            return "akia" + body.lower()
        if form == "other":
            return pick("ASIA", "AROA", "AIDA") + body
        return ("-" if form == "dash" else " ").join(("AKIA" + body)[k : k + 4] for k in range(0, 20, 4))
    digits = drawn("0123456789abcdef", pick(32, 40, 64))
    form = pick("upper", "groups", "prefix")
    if form == "upper":
        return digits.upper()
    size = pick(2, 4, 8) if form == "groups" else len(digits)
    return ("0x" if form == "prefix" else "") + pick(":", "-", " ").join(digits[k : k + size] for k in range(0, len(digits), size)).upper()


def _apart(spans: list[Span]) -> list[Span]:
    """Of spans that overlap the first."""
    out: list[Span] = []
    for s in spans:
        if not out or s[0] >= out[-1][1]:
            out.append(s)
    return out


def windows_of(texts: list[str]) -> list[tuple[list[str], list[int], tuple[int, int, int]]]:
    """Windows of tokens with their tags: about spans as they are and as written otherwise, about other numbers, and anywhere."""
    rng = np.random.default_rng(SEED)
    out = []

    def add(text: str, spans: list[Span], tokens: list[tuple[int, int]], middle: int, file: tuple[int, int, int]) -> None:
        first = middle - int(rng.integers(4, WIDTH - 12))
        words, tags = [], []
        for k in range(first - 2, first + WIDTH + 2):
            inside = 0 <= k < len(tokens)
            words.append(text[slice(*tokens[k])] if inside else "")
            tag = 0
            for a, b, kind in spans if inside else ():
                if tokens[k][0] < b and tokens[k][1] > a:
                    new = k == 0 or tokens[k - 1][1] <= a
                    tag = (1 if new else 2) + 2 * KINDS.index(kind)
            tags.append(tag)
        out.append((words, tags[2:-2], file))

    for text in texts:
        spans = _apart(base_spans(text))
        tokens = [m.span() for m in _TOKEN.finditer(text)]
        if not tokens:
            continue
        file = _file_features(text, len(tokens))
        starts = [a for a, _ in tokens]
        at = lambda place: int(np.searchsorted(starts, place))  # noqa: E731, B023
        for a, _, _ in spans[:8]:
            add(text, spans, tokens, at(a), file)
        free = [tokens[int(k)][0] for k in rng.integers(len(tokens), size=0 if spans else 2)]
        # in the places of spans, or in any two of a text without
        for a, b in [(a, b) for a, b, _ in spans[:8]] or [(a, a) for a in free]:
            value = re.search(r"[A-Za-z0-9+/_-]{8,}", text[a:b])
            for _ in range(FORMS if spans else FORMS // 2):
                kind = KINDS[int(rng.choice(3, p=[0.5, 0.25, 0.25]))]
                before, after = text[max(0, a - 400) : a].rstrip(" \"'"), text[b : b + 400].lstrip(" \"'")
                new = written(kind, value[0] if value else rng.bytes(20).hex(), rng)
                part = f"{before} {new} {after}"
                own = [s for s in _apart(base_spans(before))] + [(len(before) + 1, len(before) + 1 + len(new), kind)]
                own += [(x + len(before) + len(new) + 2, y + len(before) + len(new) + 2, k) for x, y, k in _apart(base_spans(after))]
                some = [m.span() for m in _TOKEN.finditer(part)]
                add(part, own, some, int(np.searchsorted([x for x, _ in some], len(before) + 1)), file)
        inside = lambda k: any(tokens[k][0] < b and tokens[k][1] > a for a, b, _ in spans)  # noqa: E731, B023
        others = [k for k, (a, b) in enumerate(tokens) if b - a > 5 and any(c.isdigit() for c in text[a:b]) and not inside(k)]
        for k in others[:: max(1, len(others) // 3)][:3]:
            add(text, spans, tokens, k, file)
        for _ in range(3):
            add(text, spans, tokens, int(rng.integers(len(tokens))), file)
    return out


def fit(docs: DataFrame, sample: int = SAMPLE, others: int = OTHERS) -> Field | None:
    """Trained on at most `sample` documents with something like a secret and `others` without, those of least hash.

    Of a long document, stretches of 4,000 characters about its first secret, or its start, come to the driver.
    """
    start = F.greatest(F.regexp_instr("text", F.lit(_LIKELY)) - 2000, F.lit(1))
    key = F.xxhash64("doc_id", "text").alias("key")
    rows = docs.filter(F.length("text") > 0)
    # texts are looked through once; then those of few keys are read
    keyed = materialize(rows.select(key, F.col("text").rlike(_LIKELY).alias("likely")), "keys")
    counts = {r["likely"]: r["count"] for r in keyed.groupBy("likely").count().collect()}
    texts: list[str] = []
    for likely, most in ((True, sample), (False, others)):
        if counts.get(likely):
            chosen = [r["key"] for r in least_keys(keyed.filter(F.col("likely") == likely), "key", most, counts[likely]).collect()]
            some = rows.withColumn("key", key).filter(F.col("key") <= max(chosen)).filter(F.col("key").isin(chosen))
            some = some.select("key", F.col("text").substr(start, F.lit(4000)).alias("part"))
            texts += [r["part"] for r in some.distinct().orderBy("key", "part").limit(most).collect()]
    windows = windows_of(list(dict.fromkeys(texts)))
    return Field().train(windows) if any(any(y) for _, y, _ in windows) else None


# --- reading texts -------------------------------------------------------------------------------------


def _plausible(value: str, kind: str) -> bool:
    joined = re.sub(r"[\s:.-]", "", value)
    if kind == "assign":
        return any(len(p) >= 8 and any(c.isdigit() for c in p) for p in re.findall(r"[A-Za-z0-9+/_.=-]+", value)) and len(joined) >= 12
    if kind == "access":
        return 16 <= len(joined) <= 40 and joined.isalnum() and joined.isascii() and joined[:1] in "Aa" and any(c.isdigit() for c in joined)
    return len(re.findall("[0-9a-fA-F]", value)) >= 32 and not re.search("[g-wyzG-WYZ]", value) and any(c.isdigit() for c in value)


class Reader:
    """A trained field for reading; what distinct tokens give to the tags is kept within bounds."""

    def __init__(self, field: Field, bound: bool = True):
        self.field, self.bound = field, bound
        self.cache = Cache(field.rows, most=200_000, longest=32)

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores of tags of all texts' tokens, GAP closed places before each text and after the last; and where each text's tokens start."""
        words = [_TOKEN.findall(t) for t in texts]
        count = np.array(list(map(len, words)), np.int64)
        values, index = self.cache.of(pa.array([w for own in words for w in own], pa.large_string()))
        rows = np.frombuffer(b"".join(values), np.float32).reshape(-1, ROLES, TAGS)
        rows = np.concatenate((rows, np.zeros((1, ROLES, TAGS), np.float32)))  # the place between texts
        starts = GAP + np.cumsum(count + GAP) - (count + GAP)
        token = np.full(int(count.sum()) + GAP * (len(texts) + 1), len(rows) - 1)
        inner = np.repeat(starts - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        token[inner] = index
        padded = np.concatenate((np.full(2, len(rows) - 1), token, np.full(2, len(rows) - 1)))
        em = np.zeros((len(token), TAGS), np.float32)
        for r in range(ROLES):
            em += np.ascontiguousarray(rows[:, r])[padded[r : r + len(token)]]
        file = np.array([self.field.file[list(_file_features(t, n))].sum(0) for t, n in zip(texts, count.tolist(), strict=True)], np.float32)
        em[inner] += np.repeat(file.reshape(-1, TAGS), count, 0)
        closed = np.ones(len(token), bool)
        closed[inner] = False
        em[closed] = CLOSED
        em[closed, 0] = 0
        return em, starts

    def stretches(self, em: np.ndarray) -> list[tuple[int, int]]:
        """Stretches of places outside which no best path has a span.

        A span of the best path gains over the outer tags, else these would be better. Each place of a
        span gains at most its best tag with the best step into it; leaving one adds at most `leave`.
        """
        if not self.bound:
            return [(0, len(em))] if len(em) else []
        step = self.field.steps()
        into = step[:, 1:].max(0) - step[0, 0]
        leave = max(0.0, float(step[1:, 0].max() - step[0, 0]))
        gain = np.append(0.0, np.cumsum(((em[:, 1:] - em[:, :1]) + into.astype(np.float32)).max(1), dtype=np.float64))
        # the most that a stretch with this place can gain: from the lowest sum before to the highest after
        most = np.maximum.accumulate(gain[:0:-1])[::-1] - np.minimum.accumulate(gain[:-1])
        held = np.flatnonzero(most > -leave - 1e-3)
        if not len(held):
            return []
        cut = np.flatnonzero(np.diff(held) > 1)
        return list(zip(held[np.append(0, cut + 1)].tolist(), (held[np.append(cut, len(held) - 1)] + 1).tolist(), strict=True))

    def found(self, texts: list[str]) -> list[list[tuple[int, int, str, float]]]:
        """What the field finds in each text: start, end, kind, confidence."""
        out: list[list[tuple[int, int, str, float]]] = [[] for _ in texts]
        em, starts = self.scores(texts)
        held = sorted(self.stretches(em), key=lambda s: s[1] - s[0])
        places: dict[int, list[tuple[int, int]]] = {}
        at = 0
        while at < len(held):
            # stretches of near length together, within a number of places
            some = held[at : at + 256]
            while len(some) > 1 and (some[-1][1] - some[-1][0]) * len(some) > 1 << 18:
                some = some[: len(some) // 2]
            at += len(some)
            size = some[-1][1] - some[-1][0]
            own = np.full((size, len(some), TAGS), CLOSED)
            own[:, :, 0] = 0
            for k, (a, b) in enumerate(some):
                own[: b - a, k] = em[a:b]
            tags = self.field.viterbi(own)
            if not tags.any():
                continue
            sure = self.field.marginals(own)
            for k, (a, _) in enumerate(some):
                t, line = 0, tags[:, k]
                while t < size:
                    if line[t] == 0:
                        t += 1
                        continue
                    end = t + 1
                    while end < size and line[end] == line[t] + 1:
                        end += 1
                    p = float(sure[np.arange(t, end), k, line[t:end]].mean())
                    own_text = int(np.searchsorted(starts, a + t, "right")) - 1
                    if p >= SURE:
                        if own_text not in places:
                            places[own_text] = [m.span() for m in _TOKEN.finditer(texts[own_text])]
                        first = a + t - int(starts[own_text])
                        out[own_text].append((places[own_text][first][0], places[own_text][first + end - t - 1][1], KINDS[(int(line[t]) - 1) // 2], p))
                    t = end
        return out


#: Signs at the end of a value that are tokens of their own.
_REST = re.compile(r"[A-Za-z0-9+/_=-]*")


def _whole(text: str, a: int, b: int, kind: str) -> tuple[int, int]:
    """A value goes on to its last character."""
    return (a, _REST.match(text, b).end()) if kind == "assign" else (a, b)


def spans(texts: list[str], reader: Reader | None) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text."""
    base = [base_spans(t) for t in texts]
    added = reader.found(texts) if reader else [[] for _ in texts]
    out = []
    for text, own, more in zip(texts, base, added, strict=True):
        held = sorted((a, b) for a, b, _ in own)
        starts, reach = [a for a, _ in held], np.maximum.accumulate([b for _, b in held]).tolist() if held else []
        free = []
        for a, b, kind, _ in more:
            a, b = _whole(text, a, b, kind)
            k = int(np.searchsorted(starts, b, "left"))
            if (not k or reach[k - 1] <= a) and _plausible(text[a:b], kind):
                free.append((a, b, kind))
        out.append((own, sorted([*own, *free], key=lambda s: (s[0], KINDS.index(s[2]), s[1]))))
    return out


def _join(some: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in some)


def find(docs: DataFrame, field: Field | None, rows: int = 256) -> DataFrame:
    """doc_id; n_assign, n_access, n_hex of base spans; base_sha256; spans; n_added."""
    ship_package(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(field)
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = sent.value and Reader(sent.value)
        for batch in batches:
            for part in pieces(batch, rows):
                got = spans([t or "" for t in part.column("text").to_pylist()], reader)
                cols = [part.column("doc_id")]
                cols += [pa.array([sum(s[2] == k for s in b) for b, _ in got], pa.int64()) for k in KINDS]
                cols += [pa.array([hashlib.sha256(_join(b).encode()).hexdigest() for b, _ in got], pa.string())]
                cols += [pa.array([_join(s) for _, s in got], pa.string()), pa.array([len(s) - len(b) for b, s in got], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names)

    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, {counts}, base_sha256 string, spans string, n_added long")


def redact(docs: DataFrame, field: Field | None, rows: int = 256) -> DataFrame:
    """docs (all columns), each secret in the texts replaced by its kind in brackets; null texts stay null."""
    ship_package(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(field)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = sent.value and Reader(sent.value)
        for batch in batches:
            for part in pieces(batch, rows):
                texts = part.column(at).to_pylist()
                new = [t and redacted(t, s) for t, (_, s) in zip(texts, spans([t or "" for t in texts], reader), strict=True)]
                cols = list(part.columns)
                cols[at] = pa.array(new, part.column(at).type)
                yield pa.RecordBatch.from_arrays(cols, names=part.schema.names)

    return docs.mapInArrow(run, T.StructType(list(docs.schema.fields)))
