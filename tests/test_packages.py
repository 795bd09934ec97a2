"""Packages of other hosts: ids, children, healed outcomes, totals, sources, cursor; a second merge changes nothing."""

import glob
import os

from tracemill.operators import packages, tables

ID = "session_id string, project_id long, user_id long, host_id long"
SCHEMAS = {
    "hosts": "id long, name string, last_seen string", "users": "id long, name string, last_seen string", "projects": "id long, name string, last_seen string",
    "messages": f"{ID}, uuid string, type string, content string, ts_raw string", "token_usage": f"{ID}, ts_raw string, model string, input_tokens long, output_tokens long, cache_creation_tokens long, cache_read_tokens long",
    "tool_calls": f"{ID}, ts_raw string, family string, name string, command string, cmd_name string, server_name string, kind string, is_error int, error_text string, call_key string",
    "sessions": f"{ID}, ts_raw string, summary string, total_tokens long, message_count long, parent_session_id string", "session_sources": "session_id string, project_id long, source string", "state": "key string, host_id long, value string",
}
PACKAGE = """session_id string, project string, ts_raw string, summary string, total_tokens long, message_count long, client_source string,
  messages array<struct<uuid:string,type:string,content:string,ts_raw:string>>, token_usage array<struct<ts_raw:string,model:string,input_tokens:long,output_tokens:long,cache_creation_tokens:long,cache_read_tokens:long>>,
  tool_calls array<struct<ts_raw:string,family:string,name:string,command:string,cmd_name:string,server_name:string,is_error:int,error_text:string>>, at long"""


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_package(spark, tmp_path):
    call = ("t1", "bash", "Bash", "cd x && npm test", "wrong", None, None, None)
    existing = {
        "hosts": [(1, "here", "t0")], "users": [], "projects": [(7, "app", "t0")], "messages": [("s1", 7, 5, 1, "m1", "user", "hi", "t1")], "token_usage": [("s1", 7, 5, 1, "t1", "m", 1, 1, 0, 0)],
        "tool_calls": [("s1", 7, 5, 1, "t1", "bash", "Bash", "cd x && npm test", "npm", None, None, None, None, None)],
        "sessions": [("s1", 7, 5, 1, "t1", "mine", 999, 999, None), ("s0", 7, 5, 1, "t0", "untouched", 888, 888, None)], "session_sources": [("s1", 7, "codex_cli"), ("s0", 7, "claude_ai")], "state": [],
    }
    frames = {t: spark.createDataFrame(r, SCHEMAS[t]) for t, r in existing.items()}
    frames["tool_calls"] = packages.keyed_calls(frames["tool_calls"].drop("call_key"))
    package = spark.createDataFrame([
        ("s1", "app", "t1", "theirs", 5, 5, "codex_vscode", [("m1", "user", "hi", "t1"), ("m2", "assistant", "yo", "t2"), (None, "user", "x", "t3"), (None, "user", "x", "t3")], [("t1", "m", 9, 9, 9, 9), ("t2", "m", 2, 3, 4, 5)], [(*call[:6], 1, "boom"), ("t4", "mcp", "do", None, None, "srv", 0, None)], 1),
        ("s2", "", "t5", "new", 3, 1, "codex_desktop", None, [], None, 2), ("s2", None, "t6", "again", 4, 1, "cli", None, None, None, 3), ("s0", "app", "t0", "x", 0, 0, "codex_vscode", [], None, None, 4),
        (None, "app", "t9", "", 0, 0, "", None, None, None, 5), ("s1::agent-acompact-1", "app", "t9", "", 0, 0, "", [("m9", "user", "noise", "t9")], None, None, 6),
    ], PACKAGE)
    got = packages.merged(frames, package, "there.local", "ann")
    host = next(r.id for r in got["hosts"].collect() if r.name == "there")
    assert {r.name for r in got["projects"].collect()} == {"app", "unknown"} and {r.name for r in got["users"].collect()} == {"ann"}
    assert [r[0] for r in rows(got["messages"], "content", "session_id")] == ["hi", "x", "yo"]
    assert rows(got["token_usage"], "ts_raw", "input_tokens") == [("t1", 1), ("t2", 2)]
    assert rows(got["tool_calls"], "family", "cmd_name", "kind", "is_error", "error_text", "host_id") == sorted([("bash", "npm", None, 1, "boom", 1), ("mcp", None, "mcp", 0, None, host)], key=str)
    assert rows(got["sessions"], "session_id", "summary", "total_tokens", "message_count") == [("s0", "untouched", 888, 888), ("s1", "mine", 16, 3), ("s2", "new", 3, 1)]
    assert rows(got["session_sources"], "session_id", "source") == [("s0", "claude_ai"), ("s1", "codex_vscode"), ("s2", "codex_desktop")]
    assert rows(got["state"], "key", "host_id", "value") == [("pull_cursor", host, "t6")]
    # the same in place, twice
    for t, df in frames.items():
        tables.create(df, str(tmp_path / t), packages.KEYS[t], buckets=4)
    before = {t: tables.read(spark, str(tmp_path / t), like=df) for t, df in frames.items()}
    new = packages.changes(before, package, "there.local", "ann")
    for t, k in packages.KEYS.items():
        tables.upsert(str(tmp_path / t), new[t], k, buckets=4)
    for t, df in got.items():
        assert rows(tables.read(spark, str(tmp_path / t)), *df.columns) == rows(df, *df.columns), t
    files = set(glob.glob(f"{tmp_path}/*/bucket=*/*.parquet"))
    assert packages.applied(str(tmp_path), package, "there.local", "ann", buckets=4) == dict.fromkeys(packages.KEYS, 0)
    assert set(glob.glob(f"{tmp_path}/*/bucket=*/*.parquet")) == files and os.path.isdir(tmp_path)


def test_a_second_merge_reads_tables(spark, monkeypatch):
    """Each merge reads its tables several times: what the first one made must not be computed anew each time."""
    from tracemill.operators import packages
    from tracemill.plans import registry

    seen, real = [], packages.merged
    monkeypatch.setattr(packages, "merged", lambda existing, *rest: (seen.append(existing), real(existing, *rest))[1])
    registry.QUERIES["rpl_ingest_sources"](spark, "/root/testdata/sf0.001")
    assert len(seen) == 2
    assert not [t for existing in seen for t, df in existing.items() if "Join" in df._jdf.queryExecution().optimizedPlan().toString()]
