"""Guarded swaps: sessions that the new reading covers, sessions whose logs have gone, and a second run."""

from pyspark.sql import functions as F

from tracemill.operators import migration as M

KEYS = {"messages": ["uuid"], "calls": ["ts_raw", "name"]}


def tables(spark, messages, calls, sessions):
    return {"messages": spark.createDataFrame(messages, "session_id string, uuid string, content string"), "calls": spark.createDataFrame(calls, "session_id string, ts_raw string, name string"), "sessions": spark.createDataFrame(sessions, "session_id string, project string")}


def content(t):
    return {k: sorted(map(str, df.collect())) for k, df in t.items()}


def test_guarded_swap(spark):
    old = tables(spark,
        [("cw:full", f"u{i}", "old") for i in range(19)] + [("cw:full", None, "old")] + [("cw:short", f"u{i}", "old") for i in range(10)] + [("cli", "u", "old")],
        [("cw:full", "t", "Read"), ("cw:short", "t", None)], [("cw:full", "wrong"), ("cw:short", "wrong"), ("cli", "mine")])
    new = tables(spark,
        [("cw:full", f"u{i}", "new") for i in range(19)] + [("cw:full", "more", "new")] + [("cw:short", f"u{i}", "new") for i in range(9)] + [("cw:new", "u", "new"), ("cli", "u", "new")],
        [("cw:full", "t", "Read"), ("cw:full", "t2", "Edit"), ("cw:short", "t", None)], [("cw:full", "right"), ("cw:short", "right"), ("cw:new", "right"), ("cli", "theirs")])
    scope = F.startswith("session_id", F.lit("cw:"))
    after, decided = M.guarded_swap(old, new, KEYS, scope)
    # 20 of 21 rows are covered (one message without a uuid is lost); 10 of 11 are too few
    assert sorted(map(tuple, decided.collect())) == [("cw:full", 21, 1, True), ("cw:short", 11, 1, False)]
    got = content(after)
    assert got["sessions"] == sorted(map(str, spark.createDataFrame([("cw:full", "right"), ("cw:short", "wrong"), ("cw:new", "right"), ("cli", "mine")], "session_id string, project string").collect()))
    assert after["messages"].groupBy("session_id", "content").count().orderBy("session_id").collect() == [("cli", "old", 1), ("cw:full", "new", 20), ("cw:new", "new", 1), ("cw:short", "old", 10)]
    assert after["calls"].filter("session_id = 'cw:full'").count() == 2 and after["calls"].filter("session_id = 'cw:short'").count() == 1
    # again: nothing changes
    again, _ = M.guarded_swap(after, new, KEYS, scope)
    assert content(again) == got
    # with a lower bound the short one goes, too
    low, _ = M.guarded_swap(old, new, KEYS, scope, covered=0.9)
    assert low["messages"].filter("session_id = 'cw:short' and content = 'new'").count() == 9
    empty = tables(spark, [], [], [])
    assert content(M.guarded_swap(empty, new, KEYS, scope)[0])["messages"] == sorted(map(str, new["messages"].filter(scope).collect()))
    assert content(M.guarded_swap(old, empty, KEYS, scope)[0]) == content(old)
