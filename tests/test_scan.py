"""Scans in segments against plain loops, with keys that span many tasks."""

import random

from pyspark.sql import functions as F

from tracemill.operators import scan


def plain(rows):
    out, state = [], {}
    for key, at, v, word in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        n, total, mixed, low, last, word_before = state.get(key, (0, 0, 0, None, None, None))
        state[key] = (n + 1, total + (v or 0), mixed ^ (v or 0), (v or 0) if low is None else min(low, v or 0), word if word is not None else last, word)
        out.append((key, at, *state[key][:5], word_before))
    return sorted(out, key=str)


def test_running_values(spark):
    rng = random.Random(3)
    keys = ["long"] * 3000 + ["other"] * 700 + [None] * 40 + [f"k{i % 200}" for i in range(500)]
    rows = [(k, i, rng.choice([None, -5, 7, 1 << 40]), rng.choice([None] * 30 + ["x", "y", "z"])) for i, k in enumerate(keys)]
    shuffled = rng.sample(rows, len(rows))
    table = spark.createDataFrame([(*r, "c") for r in shuffled], "key string, at long, v long, word string, part string").withColumn("w", F.coalesce("v", F.lit(0)))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
        got = scan.running(table, ["key"], [F.col("at")], "n", sums={"total": "v"}, xors={"mixed": "v"}, mins={"low": "w"}, lasts={"latest": "word"}, lags={"behind": "word"})
        assert got.columns == ["key", "at", "v", "word", "part", "w", "n", "total", "mixed", "low", "latest", "behind"]
        assert sorted(((r.key, r["at"], r.n, r.total, r.mixed, r.low, r.latest, r.behind) for r in got.collect()), key=str) == plain(rows)
        assert scan.running(table.limit(0), ["key"], [F.col("at")], "n").collect() == []
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_a_long_key_is_spread_over_tasks(spark):
    table = spark.range(20000).selectExpr("1 as key", "id as at")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    dealt = table.repartitionByRange("key", "at").groupBy(F.spark_partition_id()).count().collect()
    assert len(dealt) == 4 and max(r["count"] for r in dealt) < 10000
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert scan.running(table, ["key"], [F.col("at")], "n").filter("n <> at + 1").count() == 0
