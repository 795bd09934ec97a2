import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tracemill.llm import mixing as M


def filled(sizes, weights, total, most):
    """Reshare the excess by weight until no source is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped, left = {}, total * sum(sizes.values())
    while True:
        free = [s for s in names if s not in capped]
        share = {s: left * w[s] / sum(w[t] for t in free) for s in free}
        above = [s for s in free if share[s] > most * sizes[s]]
        if not above:
            return capped | share
        for s in above:
            capped[s] = most * sizes[s]
            left -= capped[s]


def corpus(rng):
    rows = []
    for s, n in ((None, 30), ("a", 400), ("b", 60), ("Z", 900), ("ä", 5), ("empty", 3)):
        rows += [(len(rows) + i, s, "" if s == "empty" else None if i == 1 else " ".join(["w"] * rng.choice([1, 5, 30, 200]))) for i in range(n)]
    rows += [(5000, "Z", "w " * 9000), (5001, "Z", "w\tw"), (5001, "Z", "w\tw"), (None, "a", "x y")]
    rng.shuffle(rows)
    return rows


def test_targets_quotas_and_repeats(spark):
    rows = corpus(random.Random(1))
    docs = spark.createDataFrame([(i, s, t, "c") for i, s, t in rows], "doc_id long, source string, text string, size string")
    got = M.mix_report(docs).collect()
    assert len(got) == len(rows)
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    by_id = {i: (s, len((t or "").split())) for i, s, t in rows}
    for r in got:
        s, size = by_id[r.doc_id]
        assert r["size"] == size and 0 <= r.taken <= 2 * size and r.taken == size * len(r.shards)
        sizes[s] += size
        taken[s] += r.taken
        target[s] = r.target
        assert all(0 <= x < M.SHARDS for x in r.shards)
    expected = filled(sizes, M.WEIGHTS, M.TOTAL, M.MOST)
    for s in sizes:
        assert math.isclose(target[s], expected[s], abs_tol=1e-6)
        assert abs(taken[s] - target[s]) <= max(200, 0.01 * sizes[s])
    again = M.mix_report(docs.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    out = M.mixed(docs)
    assert out.columns == docs.columns
    assert out.agg(F.sum(F.regexp_count("text", F.lit(M.WORD)))).first()[0] == sum(taken.values())


def test_empty_table_and_no_words(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, text string")
    assert M.mix_report(docs).collect() == [] and M.mixed(docs).collect() == []
    docs = spark.createDataFrame([(1, "a", " "), (2, None, None)], "doc_id long, source string, text string")
    assert sorted((r.doc_id, r.target, r.taken) for r in M.mix_report(docs).collect()) == [(1, 0.0, 0), (2, 0.0, 0)]


def test_split_keeps_quotas_and_is_hypergeometric(spark):
    quotas = spark.createDataFrame([(0, 300), (1, 1), (2, 0), (3, 4000)], "number int, quota long")
    rows = M.split_quotas(quotas, 8).collect()
    assert len(rows) == 32
    total = defaultdict(int)
    for r in rows:
        total[r.number] += r.quota
    assert dict(total) == {0: 300, 1: 1, 2: 0, 3: 4000}
    per_shard = [sum(r.quota for r in rows if r.shard == k) for k in range(8)]
    assert max(per_shard) - min(per_shard) <= 3
    df = spark.range(4000).selectExpr("30L as n", "12L as k", "10L as d", "(id + 0.5D) / 4000 as u")
    drawn = df.withColumnRenamed("k", "m").select(F.expr(M.hypergeometric("n", "m", "d", "u")).alias("x"))
    counts = {r.x: r["count"] for r in drawn.groupBy("x").count().collect()}
    for x in range(11):
        p = math.comb(12, x) * math.comb(18, 10 - x) / math.comb(30, 10)
        assert counts.get(x, 0) == pytest.approx(4000 * p, abs=1.5)
