import math
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tracemill.llm import quality as Q


def corpus(rng, n):
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(n):
        g = i % 3
        text = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        if g == 1:
            text = [w.upper() + "!!" for w in text]
        if g == 0:
            for _ in range(3):
                text.insert(rng.randrange(len(text)), rng.choice(["clot", "oaf", "dolt"]))
        rows.append((i, " ".join(text), g))
    return rows


def test_held_out_grades_and_edges(spark):
    rng = random.Random(3)
    rows = corpus(rng, 900)
    schema = "doc_id long, text string, grade int"
    train = spark.createDataFrame([*rows[:600], (None, None, None), (5, "x", 7)], schema)
    model = Q.fit(train, train, 3)
    assert np.all(np.diff(model.thresholds) > 0)
    edge = [(None, None, None), (9000, "", None), (9001, "a b " * 100000, None), (9001, "a b " * 100000, None)]
    got = Q.grade(spark.createDataFrame(rows[600:] + edge, schema).withColumn("keep", F.lit("x")), model, 3).collect()
    truth = {i: g for i, _, g in rows}
    assert len(got) == 304
    right = [r.keep == (truth[r.doc_id] > 0) for r in got if r.doc_id in truth]
    assert np.mean(right) > 0.97
    means = [np.mean([r.expected_grade for r in got if truth.get(r.doc_id) == g]) for g in range(3)]
    assert means[0] < 0.6 < means[1] < 1.5 < means[2]
    for r in got:
        assert 0 <= r.p_ge_2 <= r.p_ge_1 <= 1 and abs(r.expected_grade - r.p_ge_1 - r.p_ge_2) < 1e-9


def test_fit_is_a_maximum_of_the_weighted_likelihood():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 3))
    grades = np.clip((x[:, 0] * 1.5 + rng.logistic(size=300) * 0.3 + 1.5).astype(int), 0, 2)
    rows, cols = np.nonzero(np.ones_like(x))
    model = Q.fit_ordinal(rows, cols + 10, x.ravel().astype(np.float32), grades, 3, steps=3000, l1=0.0)

    def likelihood(w, cuts):
        t = 1 / (1 + np.exp(-((x @ w)[:, None] - cuts[None, :])))
        p = np.stack([1 - t[:, 0], t[:, 0] - t[:, 1], t[:, 1]], 1)[np.arange(300), grades]
        return np.sum(np.log(p) / np.bincount(grades)[grades])

    w, cuts = model.weights[10:13].astype(float), model.thresholds
    best = likelihood(w, cuts)
    for i in range(3):
        for d in (-0.2, 0.2):
            assert likelihood(w + d * np.eye(3)[i], cuts) < best
            if i < 2:
                assert likelihood(w, cuts + d * np.eye(2)[i]) < best
    assert w[0] > 5 * abs(w[1])


def plain_grade(text, model):
    """P(grade >= 1), P(grade >= 2) of one text, feature by feature in plain Python."""
    at, words, f = lambda name: len(Q.NUMERIC) + xxhash.xxh64_intdigest(name) % (Q.BUCKETS - len(Q.NUMERIC)), text.split(), {}
    n = len(words)
    lines = [x for x in text.split("\n") if x.strip()]
    numeric = [1.0, min(4.0, sum(map(len, words)) / max(1, n) / 5), len(set(words)) / max(1, n), 1 - len(set(lines)) / max(1, len(lines)), sum(c.isalpha() for c in text) / max(1, len(text)), float(n < 20)]
    score = sum(v * float(model.weights[i]) for i, v in enumerate(numeric))
    for w in words:
        core = w.strip("!.")
        f[at("w:" + core.lower())] = 1.0
    for w in words:
        core = w.strip("!.")
        case = "upper" if len(core) > 1 and core.isupper() else "digits" if core.isdigit() else "word" if core else "none"
        place = at(f"s:{case}:{'!' if '!' in w else ''}")
        f[("shape", place)] = f.get(("shape", place), 0.0) + 4.0 / n
    score += sum(v * float(model.weights[i[1] if isinstance(i, tuple) else i]) for i, v in f.items())
    return [1 / (1 + math.exp(t - score)) for t in model.thresholds]


def test_grades_equal_brute_force(spark):
    """Words w0... have no accents, so that `letters` is a count of letters."""
    rng = random.Random(8)
    rows = corpus(rng, 300)
    docs = spark.createDataFrame(rows, "doc_id long, text string, grade int")
    model = Q.fit(docs, docs, 3)
    more = [(1000, "", 0), (1001, "DOLT!!! oaf.\n\noaf.\n w1 w2 12 !", 0)]
    for r in Q.grade(spark.createDataFrame(rows + more, "doc_id long, text string, grade int"), model, 3).collect():
        text = next(t for i, t, _ in rows + more if i == r.doc_id)
        assert [r.p_ge_1, r.p_ge_2] == pytest.approx(plain_grade(text, model), abs=1e-5)
        assert r.keep == (r.p_ge_1 >= 0.5) and r.expected_grade == pytest.approx(r.p_ge_1 + r.p_ge_2)


def test_sample_is_bounded(spark, monkeypatch):
    """Ids that repeat and long texts are thinned; what is drawn comes from all grades."""
    drawn = []
    monkeypatch.setattr(Q, "fit_ordinal", lambda row, index, value, grades, n: drawn.append(np.bincount(grades, minlength=n)))
    docs = spark.range(6000).select((F.col("id") % 600).alias("doc_id"), F.lit("a b c d").alias("text"))
    ratings = spark.range(600).select(F.col("id").alias("doc_id"), (F.col("id") % 3).alias("grade"))
    Q.fit(docs, ratings, 3, sample=300)
    Q.fit(docs, ratings, 3, sample=300, characters=7 * 100)
    assert 450 < drawn[0].sum() < 750 and drawn[0].min() > 100 and 60 < drawn[1].sum() < 140


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (2, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert sorted((tuple(r) for r in Q.graded_labels(labels).collect()), key=str) == [(1, 0), (2, 1), (None, 2)]
    assert Q.fit(docs, Q.graded_labels(labels.limit(0)), 3) is None
    assert Q.fit(docs.limit(0), Q.graded_labels(labels), 3) is None
    assert [(r.expected_grade, r.keep) for r in Q.grade(docs, None, 3).collect()] == [(None, True)]
    assert Q.grade(docs.limit(0), None, 3).collect() == []
