"""Operators on rows written by hand."""

import os
import random

from pyspark.sql import functions as F

from tracemill.operators import intervals, pricing, search, sessions
from tracemill.streaming import ingest


def test_union_and_concurrency_across_slices(spark):
    rng = random.Random(1)
    rows = [(d, a := rng.randint(0, 40) * 100_000_000, a + rng.randint(1, 15) * 100_000_000) for d in ("x", "y") for _ in range(60)]
    df = spark.createDataFrame(rows, "day string, start_us long, end_us long")
    for d in ("x", "y"):
        want = []
        for a, b in sorted((a, b) for day, a, b in rows if day == d):
            if want and a <= want[-1][1]:
                want[-1][1] = max(want[-1][1], b)
            else:
                want.append([a, b])
        got = sorted([r.start_us, r.end_us] for r in intervals.union(df, ["day"]).filter(F.col("day") == d).collect())
        assert got == want
        peak = max(sum(a <= t <= b for day, a, b in rows if day == d) for t in {a for day, a, _ in rows if day == d})
        assert intervals.peak(df, ["day"]).filter(F.col("day") == d).first().peak == peak


def test_price_changes_that_overlap_are_left_out(spark):
    schema = "model string, input_price double, from_date string, to_date string"
    prices = spark.createDataFrame([("a", 1.0, "2024-01-01", "2024-02-01"), ("a", 2.0, "2024-02-01", None), ("b", 5.0, "2024-01-01", None)], schema)
    change = spark.createDataFrame([("a", 9.0, "2024-01-15", None), ("b", 6.0, "2024-03-01", None), ("c", 7.0, "2024-01-01", None)], schema)
    got = sorted(map(tuple, pricing.upsert(prices, change).collect()), key=str)
    assert got == [("a", 1.0, "2024-01-01", "2024-02-01"), ("a", 2.0, "2024-02-01", None), ("b", 5.0, "2024-01-01", "2024-03-01"), ("b", 6.0, "2024-03-01", None), ("c", 7.0, "2024-01-01", None)]
    assert pricing.overlaps(pricing.upsert(prices, change)).collect() == []


def test_search_terms(spark):
    texts = ["Łódź and Őrség", "naïve café", "red blue green", "blue red"]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, content string")
    found = lambda q: sorted(r.n for r in search.search(df, q).collect())
    assert found("orseg") == [0] and found("cafe naive") == [1] and found('"red blue"') == [2] and found("blu*") == [2, 3]
    assert found("red NOT green") == [3] and found("cafe OR green NOT naive") == [1, 2] and found("green NOT blue OR cafe") == [1] and found("!!") == []


def test_display_and_parents(spark):
    messages = spark.createDataFrame(
        [("s", 1, 0, "user", "<system-reminder>x</system-reminder>", "t0", 1, 1, None), ("s", 1, 1, "user", '[{"type": "text", "text": "Fix it. Now"}]', "t1", 2, 2, "m"), ("w", 1, 0, "user", "<command-name>a</command-name>", "t0", 0, 0, None), ("p", 1, 0, "user", "see agent-ab.jsonl", "t9", 0, 0, None)],
        "session_id string, project_id long, seq int, type string, content string, ts_raw string, tokens_in long, tokens_out long, model string",
    )
    usage = spark.createDataFrame([], "session_id string, project_id long, model string, input_tokens long, output_tokens long, cache_creation_tokens long, cache_read_tokens long")
    calls = spark.createDataFrame([], "session_id string, project_id long, family string, tool string, skill_name string, subagent_type string")
    got = {r.session_id: r for r in sessions.aggregated(messages, usage, calls).collect()}
    assert (got["s"].display, got["s"].summary, got["s"].total_tokens, got["s"].model, got["s"].tools_used) == ("Fix it. Now", "Fix it.", 6, "m", [])
    assert got["w"].display == "<command-name>a</command-name>"
    tree = spark.createDataFrame([("x", 1, "ab", None), ("y", 1, "ab", "q"), ("z", 1, None, None)], "session_id string, project_id long, agent_id string, parent_session_id string")
    assert {r.session_id: r.parent_session_id for r in sessions.with_parents(tree, sessions.mentioned_parents(messages)).collect()} == {"x": "p", "y": "q", "z": None}


def test_windows_over_a_stream_with_late_rows(spark, tmp_path):
    """A row that comes after the watermark has passed its window is not counted; one within the delay is."""
    source = tmp_path / "in"
    source.mkdir()

    def write(name, rows):
        (source / name).write_text("\n".join('{"k": "a", "ts": "2024-01-01T%s"}' % t for t in rows))
        os.utime(source / name, (1_700_000_000 + 60 * int(name[0]),) * 2)  # files are read in the order of their times

    write("0.json", ["00:10:00", "00:20:00", "02:30:00"])
    write("1.json", ["01:50:00", "05:00:00"])
    write("2.json", ["00:30:00", "09:00:00"])
    stream = lambda: ingest.events(spark, str(source), "k string, ts timestamp", files_per_trigger=1)
    for name, build in (("windows", lambda s: ingest.counted_by_window(s, ["k"], "1 hour")), ("sessions", lambda s: ingest.sessionised(s, ["k"], "15 minutes"))):
        ingest.append(build(stream()), str(tmp_path / name), str(tmp_path / f"{name}-state")).awaitTermination()
    windows = {str(r.start)[11:16]: r["count"] for r in spark.read.parquet(str(tmp_path / "windows")).collect()}
    assert windows == {"00:00": 2, "01:00": 1, "02:00": 1, "05:00": 1}
    islands = sorted((str(r.start)[11:16], str(r.end)[11:16], r.events) for r in spark.read.parquet(str(tmp_path / "sessions")).collect())
    assert islands == [("00:10", "00:20", 2), ("01:50", "01:50", 1), ("02:30", "02:30", 1), ("05:00", "05:00", 1)]


def test_replies_in_one_long_session_take_linear_time(spark):
    """200,000 events of one session; a frame that is evaluated anew for each row would take hours."""
    import time

    events = spark.range(200_000).selectExpr("'d' AS day", "'s' AS session_id", "id", "id * 1000000 AS us", "CASE WHEN id % 1000 = 999 THEN 'assistant' ELSE 'user' END AS type")
    start = time.perf_counter()
    rows = intervals.reply_intervals(events, ["day", "session_id"], cap=10**12)
    total = rows.agg(F.count("*"), F.sum(F.col("end_us") - F.col("start_us"))).first()
    assert total[0] == 199_800 and total[1] == 200 * sum(range(1, 1000)) * 1_000_000
    assert time.perf_counter() - start < 60


def test_user_detail_scans_each_fact_once(spark):
    from tracemill.operators import reports

    sessions_ = spark.createDataFrame([("a", 1, 7, 1, 5), ("b", 1, 8, 1, 6), ("a", 2, None, 1, 1)], "session_id string, user_id long, project_id long, host_id long, total_tokens long")
    usage = spark.createDataFrame([(1, "m", "2024-01-07T05:00:00Z", 1, 2), (1, None, "2024-01-07T05:30:00Z", 3, 4)], "user_id long, model string, ts_raw string, input_tokens long, output_tokens long")
    got = reports.user_detail(sessions_, usage)
    rows = sorted((tuple(r) for r in got.select("user_id", "section", "project_id", "host_id", "model", "day", "hour", "sessions", "calls", "tokens").collect()), key=str)
    assert rows == sorted([
        (1, "projects", 7, None, None, None, None, 1, None, 5), (1, "projects", 8, None, None, None, None, 1, None, 6), (2, "projects", None, None, None, None, None, 1, None, 1), (1, "hosts", None, 1, None, None, None, 2, None, 11), (2, "hosts", None, 1, None, None, None, 1, None, 1),
        (1, "models", None, None, "m", None, None, None, 1, 3), (1, "models", None, None, None, None, None, None, 1, 7), (1, "heatmap", None, None, None, 0, 5, None, 2, None)], key=str)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 2
