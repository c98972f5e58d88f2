"""Language identification by a convolutional network over bytes, trained here in numpy.

A window of WINDOW bytes is embedded, convolved with filters of several widths, max-pooled over the
window and put through a softmax. A text's languages' probabilities are the means over all its
windows, weighted by their bytes; the highest is the prediction. Training takes one window each of at
most SAMPLE labelled rows, those with the least hashes of their ids, for a fixed number of epochs
from a fixed seed.

For prediction, embedding and filters are multiplied out into tables over pairs of bytes, so that a
convolution is a sum of few table rows. Windows are computed STEP at a time.

Null texts and texts with no letter are "und" with score 0; so is all where no labelled row has a
letter. Texts of any length are read whole. Each row of the table returns one row, repeated rows
and null doc_ids too. Null languages are not learned from. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfield.llm.tables import least_keys, pieces
from lumenfield.session import ship_package

WINDOW, EMBED, WIDTHS, FILTERS = 256, 12, (2, 3, 4), 24
SAMPLE, EPOCHS, BATCH, RATE, SEED, STEP = 6000, 8, 64, 0.01, 5, 128
_LETTER = regex.compile(r"\p{L}")


class ByteCnn:
    def __init__(self, classes: list[str]):
        rng = np.random.default_rng(SEED)
        self.classes = classes
        self.params = {
            "embed": rng.normal(0, 0.5, (256, EMBED)),
            **{f"w{w}": rng.normal(0, 1 / np.sqrt(w * EMBED), (w, EMBED, FILTERS)) for w in WIDTHS},
            "bias": np.zeros(FILTERS * len(WIDTHS)),
            "out": rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(classes))),
            "out_bias": np.zeros(len(classes)),
        }

    def _tables(self) -> list[tuple[int, list[tuple[int, np.ndarray, bool]]]]:
        """For each width: (offset, table, over pairs of bytes) whose rows sum to its convolution."""
        p, out = self.params, []
        for w in WIDTHS:
            single = np.einsum("be,wef->wbf", p["embed"], p[f"w{w}"]).astype(np.float32)
            parts, at = [], 0
            while at < w:
                if at + 1 < w:
                    parts.append((at, (single[at][:, None, :] + single[at + 1][None, :, :]).reshape(65536, FILTERS), True))
                    at += 2
                else:
                    parts.append((at, single[at], False))
                    at += 1
            out.append((w, parts))
        return out

    def freeze(self) -> ByteCnn:
        self.tables = self._tables()
        self.head = {k: self.params[k].astype(np.float32) for k in ("bias", "out", "out_bias")}
        return self

    def predict(self, windows: np.ndarray) -> np.ndarray:
        """Probabilities of each window (rows of WINDOW bytes)."""
        out = []
        for at in range(0, len(windows), STEP):
            x = windows[at : at + STEP].astype(np.int64)
            pair = x[:, :-1] * 256 + x[:, 1:]
            pooled = []
            for w, parts in self.tables:
                n = WINDOW - w + 1
                total = None
                for offset, table, double in parts:
                    rows = table[(pair if double else x)[:, offset : offset + n]]
                    total = rows if total is None else total.__iadd__(rows)
                pooled.append(total.max(1))
            hidden = np.maximum(np.concatenate(pooled, 1) + self.head["bias"], 0)
            z = hidden @ self.head["out"] + self.head["out_bias"]
            z = np.exp(z - z.max(1, keepdims=True))
            out.append(z / z.sum(1, keepdims=True))
        return np.concatenate(out) if out else np.zeros((0, len(self.classes)), np.float32)

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, line = self.params, np.arange(len(x))[:, None]
        e = p["embed"][x]
        pooled, best = [], []
        for w in WIDTHS:
            n = WINDOW - w + 1
            conv = sum(e[:, j : j + n] @ p[f"w{w}"][j] for j in range(w))
            at = conv.argmax(1)
            best.append(at)
            pooled.append(np.take_along_axis(conv, at[:, None, :], 1)[:, 0])
        raw = np.concatenate(pooled, 1) + p["bias"]
        hidden = np.maximum(raw, 0)
        z = hidden @ p["out"] + p["out_bias"]
        z = np.exp(z - z.max(1, keepdims=True))
        d = z / z.sum(1, keepdims=True)
        d[np.arange(len(x)), y] -= 1
        d /= len(x)
        g = {"out": hidden.T @ d, "out_bias": d.sum(0), "embed": np.zeros_like(p["embed"])}
        dh = (d @ p["out"].T) * (raw > 0)
        g["bias"] = dh.sum(0)
        for k, w in enumerate(WIDTHS):
            own, at = dh[:, k * FILTERS : (k + 1) * FILTERS], best[k]
            gw = np.zeros_like(p[f"w{w}"])
            for j in range(w):
                byte = x[line, at + j]  # rows x filters
                gw[j] = np.einsum("bfe,bf->ef", p["embed"][byte], own)
                np.add.at(g["embed"], byte.ravel(), (own[:, :, None] * p[f"w{w}"][j].T[None]).reshape(-1, EMBED))
            g[f"w{w}"] = gw
        return g

    def train(self, x: np.ndarray, y: np.ndarray) -> ByteCnn:
        """Adam on the cross entropy; rarer classes are drawn as often as the largest up to four times."""
        rng = np.random.default_rng(SEED)
        count = np.bincount(y, minlength=len(self.classes))
        order = np.concatenate([np.repeat(np.flatnonzero(y == c), max(1, min(4, round(count.max() / n)))) for c, n in enumerate(count) if n])
        m = {k: np.zeros_like(v) for k, v in self.params.items()}
        v = {k: np.zeros_like(q) for k, q in self.params.items()}
        t = 0
        for epoch in range(EPOCHS):
            rng.shuffle(order)
            for at in range(0, len(order), BATCH):
                own = order[at : at + BATCH]
                t += 1
                rate = RATE * (1 - epoch / EPOCHS) * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
                for k, g in self._gradients(x[own], y[own]).items():
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.001 * (g * g - v[k])
                    self.params[k] -= rate * m[k] / (np.sqrt(v[k]) + 1e-8)
        return self


def windows(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of some texts (the last of each filled up with zeros), their text's number, their bytes."""
    length = np.array([len(r) for r in raws], np.int64)
    count = -(-length // WINDOW)
    owner = np.repeat(np.arange(len(raws)), count)
    padded = b"".join([r + bytes(-len(r) % WINDOW) for r in raws])
    size = np.full(len(owner), WINDOW)
    full = count > 0
    size[np.cumsum(count)[full] - 1] = (length - (count - 1) * WINDOW)[full]
    return np.frombuffer(padded, np.uint8).reshape(-1, WINDOW), owner, size


def fit(docs: DataFrame, label: str = "lang", sample: int = SAMPLE) -> ByteCnn | None:
    """Trained on windows of the rows with a text and a label; None where there are none."""
    length = F.length("text")
    key = F.xxhash64("doc_id", "text")
    start = F.pmod(F.xxhash64(key, F.lit(1)), F.greatest(length - WINDOW + 1, F.lit(1))).cast("int") + 1
    known = docs.filter(F.col("text").isNotNull() & F.col(label).isNotNull())
    total = known.count()
    parts = known.select(F.col("text").substr(start, F.lit(WINDOW)).alias("part"), F.col(label).cast("string").alias("label"), key.alias("key"))
    rows = least_keys(parts, "key", sample, total, "part", "label").collect()
    rows = [r for r in rows if _LETTER.search(r["part"])]
    if not rows:
        return None
    classes = sorted({r["label"] for r in rows})
    x = np.stack([np.frombuffer(r["part"].encode()[:WINDOW].ljust(WINDOW, b"\0"), np.uint8) for r in rows]).astype(np.int64)
    y = np.array([classes.index(r["label"]) for r in rows])
    return ByteCnn(classes).train(x, y).freeze()


def predict(docs: DataFrame, model: ByteCnn | None, held_out: Column, rows: int = 256) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    spark = docs.sparkSession
    ship_package(spark)
    ids = docs.select("doc_id", held_out.alias("held_out"), "text")
    if model is None:
        return ids.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    sent = spark.sparkContext.broadcast({"classes": model.classes, "params": model.params})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ByteCnn(sent.value["classes"])
        own.params = sent.value["params"]
        own.freeze()
        for batch in batches:
            for part in pieces(batch, rows):
                texts = [t or "" for t in part.column("text").to_pylist()]
                x, owner, size = windows([t.encode() for t in texts])
                total = np.zeros((len(texts), len(own.classes)))
                np.add.at(total, owner, own.predict(x) * size[:, None])
                total /= np.maximum(total.sum(1, keepdims=True), 1e-12)
                best = total.argmax(1)
                known = [bool(_LETTER.search(t)) for t in texts]
                cols = [
                    part.column("doc_id"),
                    part.column("held_out"),
                    pa.array([own.classes[b] if k else "und" for b, k in zip(best.tolist(), known, strict=True)]),
                    pa.array(np.where(known, np.clip(total[np.arange(len(texts)), best], 0, 1), 0.0)),
                ]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "lang_pred", "score"])

    return ids.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, folds: int = 5, out: int = 0) -> DataFrame:
    """Fitted on the rows outside the held-out fold, by crc32 of doc_id as text, and applied to all."""
    ship_package(docs.sparkSession)
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds, F.lit(-1))
    return predict(docs, fit(docs.filter(fold != out)), fold == out)
