"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One weight for each hashed feature of the text is shared by all grades; ordered thresholds cut the score into grades:
P(grade >= k) = sigmoid(score - threshold_k). It gives the expected grade and the tail probabilities that a selection
needs. It is fitted in numpy on the driver, on a bounded sample of rated rows, by adaptive gradient steps with an L1
penalty, so that words without bearing on the grade weigh nothing; whole texts are scored in batches on the executors.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, small_side

BUCKETS = 1 << 18
#: Rated documents that are learned from at most (expected number: they are drawn by hash).
SAMPLE = 8_000
#: Characters of the rated texts that are learned from at most (expected number).
SAMPLE_CHARACTERS = 200_000_000
#: Sampled documents in which a word's bucket must occur to be learned.
LEAST_DOCS = 5
STEPS = 400
L1 = 1e-3
SEED = 5
WORDS_KEPT = 300_000
NUMERIC = ("bias", "long words", "distinct words", "repeated lines", "letters", "short text")

_CORE = re.compile(r"^(\W*)(.*?)(\W*)$", re.S)


class Features:
    """Hashed features of a text: presence of each word, shares of word shapes, and a few shares of the whole text."""

    def __init__(self):
        self.known: dict[str, tuple[int, int]] = {}

    @staticmethod
    def bucket(name: str) -> int:
        return len(NUMERIC) + xxhash.xxh64_intdigest(name) % (BUCKETS - len(NUMERIC))

    def of_word(self, word: str) -> tuple[int, int]:
        if (found := self.known.get(word)) is None:
            if len(self.known) >= WORDS_KEPT:
                self.known.clear()
            before, core, after = _CORE.match(word).groups()
            case = "upper" if len(core) > 1 and core.isupper() else "digits" if core.isdigit() else "word" if core else "none"
            # runs of odd signs count, usual punctuation does not
            signs = "".join(sorted(set(before + after) - set(".,;:'\"()?")))
            found = self.bucket("w:" + core.lower()), self.bucket(f"s:{case}:{signs[:4]}")
            self.known[word] = found
        return found

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        text = text or ""
        counts = Counter(text.split())
        n = sum(counts.values())
        words: set[int] = set()
        shapes: Counter[int] = Counter()
        for w, c in counts.items():
            word, shape = self.of_word(w)
            words.add(word)
            shapes[shape] += c
        lines = [x for x in text.split("\n") if x.strip()]
        numeric = [1.0, min(4.0, sum(len(w) * c for w, c in counts.items()) / max(1, n) / 5), len(counts) / max(1, n), 1 - len(set(lines)) / max(1, len(lines)), len(re.findall(r"[^\W\d_]", text)) / max(1, len(text)), 1.0 if n < 20 else 0.0]
        index = [*range(len(NUMERIC)), *words, *shapes]
        value = [*numeric, *[1.0] * len(words), *[4.0 * c / n for c in shapes.values()]]
        return np.array(index, np.int64), np.array(value, np.float32)


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..."""
        return 1 / (1 + np.exp(-np.clip(scores[:, None] - self.thresholds[None, :], -60, 60)))


def fit_ordinal(rows: np.ndarray, index: np.ndarray, value: np.ndarray, grades: np.ndarray, n_grades: int, steps: int = STEPS, l1: float = L1) -> OrdinalModel:
    """Maximise the weighted log likelihood of the grades; each grade weighs the same. rows, index, value: the entries of
    the sparse feature matrix."""
    n = len(grades)
    weight = n / (n_grades * np.maximum(1, np.bincount(grades, minlength=n_grades)))[grades]
    weight = np.minimum(weight, 20.0) / n
    used, at = np.unique(index, return_inverse=True)
    w, seen = np.zeros(len(used)), np.full(len(used), 1e-8)
    first, gaps = -0.5 * (n_grades - 1), np.zeros(max(0, n_grades - 2))  # thresholds: first, then + exp(gap)
    free = used < len(NUMERIC)
    seen_t = np.full(1 + len(gaps), 1e-8)
    for _ in range(steps):
        cuts = first + np.concatenate(([0.0], np.cumsum(np.exp(gaps))))
        s = np.bincount(rows, w[at] * value, n)
        edges = np.concatenate(([-np.inf], cuts, [np.inf]))
        with np.errstate(over="ignore"):
            a, b = (1 / (1 + np.exp(edges[grades + k] - s)) for k in (0, 1))
        p = np.maximum(a - b, 1e-9)
        g = np.bincount(at, (-(1 - a - b) * weight)[rows] * value, len(used))
        seen += g * g
        rate = 0.3 / np.sqrt(seen)
        w -= rate * g
        w = np.where(free, w, np.sign(w) * np.maximum(0, np.abs(w) - rate * l1))
        g_cut = np.zeros(len(cuts) + 2)
        np.add.at(g_cut, grades, weight * a * (1 - a) / p)
        np.add.at(g_cut, grades + 1, -weight * b * (1 - b) / p)
        g_cut = g_cut[1:-1]
        tail = np.cumsum(g_cut[::-1])[::-1]
        g_t = np.concatenate(([tail[0]], tail[1:] * np.exp(gaps)))
        seen_t += g_t * g_t
        change = 0.1 * g_t / np.sqrt(seen_t)
        first -= change[0]
        gaps -= change[1:]
    weights = np.zeros(BUCKETS, np.float32)
    weights[used] = w
    return OrdinalModel(weights, first + np.concatenate(([0.0], np.cumsum(np.exp(gaps)))))


def fit(docs: DataFrame, ratings: DataFrame, n_grades: int, sample: int = SAMPLE, characters: int = SAMPLE_CHARACTERS) -> OrdinalModel | None:
    """Learn from the texts of `docs` (doc_id, text) that `ratings` (doc_id, grade: 0 to n_grades - 1) covers; grades that
    are null or outside and ids without a document are left out. About `sample` ids are drawn by hash, as many of each
    grade as there are or as its equal part allows, and their texts are read where they lie: only ids travel. Should the
    drawn texts hold more than `characters` or the ids repeat (more than twice `sample` rows), rows are thinned once more;
    a single text is never cut, however long, and its features are at most BUCKETS. Without a rated text the model is None."""
    known = ratings.select("doc_id", F.col("grade").cast("int").alias("grade")).filter(F.col("grade").between(0, n_grades - 1) & F.col("doc_id").isNotNull())
    counts = {r["grade"]: r["count"] for r in known.groupBy("grade").count().collect()}
    if not counts:
        return None
    share = F.coalesce(*[F.when(F.col("grade") == g, F.lit(min(1.0, sample / len(counts) / n))) for g, n in counts.items()])
    ids = small_side(checkpointed(known.filter(F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(1 << 30)) < share * (1 << 30))), 4 * sample)
    drawn = docs.select("doc_id", "text").withColumn("place", F.monotonically_increasing_id()).join(ids, "doc_id")
    size = drawn.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("characters")).first()
    rest = min(1.0, 2 * sample / max(1, size["rows"]), characters / max(1, size["characters"]))
    if rest < 1:
        drawn = drawn.filter(F.pmod(F.xxhash64(F.lit(SEED + 1), "place"), F.lit(1 << 30)) < int(rest * (1 << 30)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for b in batches:
            found = [features(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([i.astype("<i4").tobytes() for i, _ in found], pa.binary()), pa.array([v.astype("<f4").tobytes() for _, v in found], pa.binary())], ["grade", "index", "value"])

    rows = sorted((r.grade, bytes(r["index"]), bytes(r["value"])) for r in drawn.select("text", "grade").mapInArrow(run, "grade int, index binary, value binary").toLocalIterator())
    if not rows:
        return None
    lengths = [len(r[1]) // 4 for r in rows]
    row = np.repeat(np.arange(len(rows)), lengths)
    index = np.frombuffer(b"".join(r[1] for r in rows), "<i4")
    value = np.frombuffer(b"".join(r[2] for r in rows), "<f4")
    often = np.bincount(index, minlength=BUCKETS) >= min(LEAST_DOCS, len(rows))
    often[: len(NUMERIC)] = True
    keep = often[index]
    return fit_ordinal(row[keep], index[keep], value[keep], np.array([r[0] for r in rows]), n_grades)


def grade(docs: DataFrame, model: OrdinalModel | None, n_grades: int, least: float = 0.5) -> DataFrame:
    """doc_id, expected_grade, p_ge_1 ... p_ge_{n_grades - 1} and keep (P(grade >= 1) >= `least`) of each row of `docs`;
    only `text` decides. Null texts count as empty; texts of any length are read whole; repeated rows give repeated rows; an empty table gives none; without a
    model (nothing to learn from) the columns are null and all rows are kept; other columns are ignored."""
    tails = [f"p_ge_{k}" for k in range(1, n_grades)]
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, expected_grade double, {', '.join(f'{t} double' for t in tails)}, keep boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for b in batches:
            if model is None:
                p = [pa.nulls(b.num_rows, pa.float64())] * n_grades
                keep = pa.array([True] * b.num_rows, pa.bool_())
            else:
                found = (features(t) for t in b.column(1).to_pylist())
                tail = model.tails(np.array([float(model.weights[i] @ v) for i, v in found]))
                p = [pa.array(tail.sum(1)), *(pa.array(tail[:, k]) for k in range(n_grades - 1))]
                keep = pa.array(tail[:, 0] >= least)
            yield pa.RecordBatch.from_arrays([b.column(0), *p, keep], ["doc_id", "expected_grade", *tails, "keep"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def graded_labels(labels: DataFrame) -> DataFrame:
    """Ratings (doc_id, grade) from labels (doc_id, quality, toxic): 0 toxic, 1 neither toxic nor good, 2 good. Labels that
    are null count as 0; an id that is labelled more than once takes its lowest grade."""
    one = F.when(F.col("toxic") > 0, 0).when(F.col("quality") > 0, 2).otherwise(1)
    return labels.groupBy("doc_id").agg(F.min(one).alias("grade"))
