"""Language identification: a byte convolutional network over fixed-length windows.

Filters of several widths slide over the bytes of a window, their largest responses go through a rectifier into one
softmax layer. It is trained in numpy on the driver, on a bounded sample of labelled rows, and applied to windows of
whole texts in batches. A convolution over one-hot bytes is a sum of table rows, so that inference is a few gathers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_remainder, small_batches

WINDOW = 192
WIDTHS = (2, 3, 4)
FILTERS = 16
#: Most labelled documents that are learned from, in all languages together (expected number: they are drawn by hash).
SAMPLE = 3000
#: Probability of its likeliest language below which a text is in none that was learned.
LEAST_SCORE = 0.4
#: Windows of each sampled document, evenly spaced.
SAMPLE_WINDOWS = 4
EPOCHS = 4
BATCH = 64
SEED = 7
UNKNOWN = "und"


def windows(text: bytes) -> np.ndarray:
    """All windows of a text, one after the other; the last one is padded with zeros."""
    n = max(1, -(-len(text) // WINDOW))
    out = np.zeros(n * WINDOW, np.uint8)
    out[: len(text)] = np.frombuffer(text, np.uint8)
    return out.reshape(n, WINDOW)


@dataclass
class ByteNet:
    labels: list[str]
    tables: list[np.ndarray]  # one for each width: (width, 256, FILTERS)
    bias: np.ndarray
    dense: np.ndarray
    offset: np.ndarray

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Largest response of each filter in each window, and where."""
        best, where = [], []
        for table in self.tables:
            last = x.shape[1] - len(table) + 1
            y = table[0][x[:, :last]]
            for j in range(1, len(table)):
                y += table[j][x[:, j : last + j]]
            at = y.argmax(1)
            where.append(at)
            best.append(np.take_along_axis(y, at[:, None, :], 1)[:, 0])
        return np.concatenate(best, 1) + self.bias, where

    def largest(self, x: np.ndarray) -> np.ndarray:
        best = []
        for table in self.tables:
            last = x.shape[1] - len(table) + 1
            y = table[0].take(x[:, :last], 0)
            for j in range(1, len(table)):
                y += table[j].take(x[:, j : last + j], 0)
            best.append(y.max(1))
        return np.concatenate(best, 1) + self.bias

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        out = []
        for i in range(0, len(x), 64):
            z = np.maximum(self.largest(x[i : i + 64]), 0) @ self.dense + self.offset
            z = np.exp(z - z.max(1, keepdims=True))
            out.append(z / z.sum(1, keepdims=True))
        return np.concatenate(out)


def train(x: np.ndarray, y: np.ndarray, labels: list[str], epochs: int = EPOCHS, seed: int = SEED) -> ByteNet:
    """Adam on the mean cross-entropy; each class weighs the same. The gradient of a pooled filter reaches only the bytes
    under its largest response."""
    rng = np.random.default_rng(seed)
    net = ByteNet(
        labels,
        [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS],
        np.zeros(FILTERS * len(WIDTHS), np.float32),
        rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(labels))).astype(np.float32),
        np.zeros(len(labels), np.float32),
    )
    parameters = [*net.tables, net.bias, net.dense, net.offset]
    means = [np.zeros_like(p) for p in parameters]
    squares = [np.zeros_like(p) for p in parameters]
    weight = (len(y) / (len(labels) * np.maximum(1, np.bincount(y, minlength=len(labels))))).astype(np.float32)
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(y), BATCH):
            step += 1
            b = order[i : i + BATCH]
            best, where = net.pooled(x[b])
            h = np.maximum(best, 0)
            z = h @ net.dense + net.offset
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(b)), y[b]] -= 1
            p *= weight[y[b]][:, None] / len(b)
            back = (p @ net.dense.T) * (best > 0)
            gradients = []
            for k, table in enumerate(net.tables):
                g = np.zeros_like(table)
                part = back[:, k * FILTERS : (k + 1) * FILTERS]
                for j in range(len(table)):
                    under = np.take_along_axis(x[b], where[k] + j, 1)
                    np.add.at(g[j], (under, np.arange(FILTERS)[None, :]), part)
                gradients.append(g)
            gradients += [back.sum(0), h.T @ p, p.sum(0)]
            for p_, g, m, s in zip(parameters, gradients, means, squares, strict=True):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                p_ -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return net


def fit(docs: DataFrame, learn: Column, sample: int = SAMPLE) -> ByteNet | None:
    """Learn from rows of `docs` (text, lang, doc_id) for which `learn` holds and lang is not null. At most about `sample`
    documents are drawn, by a hash of id and length, as many from each language; None if there is nothing to learn."""
    known = docs.select("doc_id", "text", "lang").filter(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(sample).collect()}
    if not counts:
        return None
    quota = max(1, sample // len(counts))
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, quota / n))) for k, n in counts.items()])
    drawn = F.pmod(F.xxhash64(F.col("doc_id"), F.length("text"), F.lit(SEED)), F.lit(1 << 30)) < share * (1 << 30)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                w = windows(text.lower().encode())
                for i in np.unique(np.linspace(0, len(w) - 1, min(len(w), SAMPLE_WINDOWS)).astype(int)):
                    rows.append((w[i].tobytes(), lang))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], ["window", "lang"])

    rows = sorted((r["lang"], bytes(r["window"])) for r in known.filter(drawn).select("text", "lang").mapInArrow(cut, "window binary, lang string").collect())
    if not rows:
        return None
    labels = sorted({r[0] for r in rows})
    x = np.frombuffer(b"".join(r[1] for r in rows), np.uint8).reshape(-1, WINDOW)
    return train(x, np.array([labels.index(r[0]) for r in rows]), labels)


def judge(net: ByteNet | None, texts: list[str | None]) -> list[tuple[str, float]]:
    """(language, score) of whole texts: the mean of the windows' probabilities, weighted by their letters. `und` with
    score 0 for texts that are null or have no letter, and for all where there was nothing to learn from."""
    out: list[tuple[str, float]] = []
    for text in texts:
        if net is None or not text or not any(map(str.isalpha, text)):
            out.append((UNKNOWN, 0.0))
            continue
        w = windows(text.lower().encode())
        letters = (((w >= 97) & (w <= 122)) | (w >= 128)).sum(1)
        some = letters > 0
        p = letters[some].astype(float) @ net.probabilities(w[some]) / letters.sum() if some.any() else np.zeros(len(net.labels))
        k = int(p.argmax())
        out.append((net.labels[k], float(min(1.0, p[k]))))
    return out


def identify(docs: DataFrame, net: ByteNet | None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row of `docs`; only `text` decides. Repeated rows give repeated rows,
    an empty table none; other columns are ignored. A null id is not held out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = judge(net, b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    kind = dict(docs.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(id_remainder(doc_id, 3) == 1, F.lit(False))


def in_a_language(docs: DataFrame, net: ByteNet | None, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of `docs`, with all their columns, whose text the network puts in a learned language with a probability of
    `least` at least; texts without a letter (null and empty ones too) go. Where there was nothing to learn from, all texts
    with a letter stay. Repeated rows are judged alike; very long texts are read whole; an empty table gives no rows."""
    small_batches(docs.sparkSession)
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).to_pylist()
            stay = [any(map(str.isalpha, t or "")) for t in texts] if net is None else [lang != UNKNOWN and p >= least for lang, p in judge(net, texts)]
            yield b.filter(pa.array(stay, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
