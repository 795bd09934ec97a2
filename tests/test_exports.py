"""Readers of exports and audit logs against rows written by hand."""

import json

from pyspark.sql import functions as F

from tracemill.sources import exports as E
from tracemill.sources import transcripts


def node(parent, role, parts=None, id_=None, at=0.0, name=None, **content):
    return {"parent": parent, "message": {"id": id_, "author": {"role": role, "name": name}, "create_time": at, "content": {"content_type": "text", "parts": parts, **content}, "metadata": {"model_slug": None}}}


def test_chat_export(spark, tmp_path):
    mapping = {
        "r": {"parent": None, "message": None}, "s": node("r", "system", ["hidden"]), "u": node("s", "user", ["hello", '{"text": "pic"}'], "m1", 1704067200.5), "old": node("u", "assistant", ["first try"], "m2"),
        "new": node("u", "assistant", None, "m3", 1704067201.0, content_type="thoughts", thoughts=[{"summary": "Plan", "content": "do it"}, {"summary": "", "content": "then"}]), "t": node("new", "tool", ["out"], "m4", name="web"),
        "c": node("t", "assistant", None, "m5", content_type="code", text="x = 1", language="py"), "other": node("u", "tool", ["x"], name="search"),
    }
    loop = {"a": node("b", "user", ["a"], "a"), "b": node("a", "assistant", ["b"], "b")}
    rows = [
        {"conversation_id": "c1", "title": "T", "create_time": 1.0, "update_time": 10.0, "default_model_slug": "m", "gizmo_type": "snorlax", "gizmo_id": "g1", "current_node": "c", "mapping": mapping},
        {"conversation_id": "c2", "update_time": 20.0, "current_node": "a", "mapping": loop}, {"conversation_id": "c3", "update_time": 30.0, "current_node": None, "mapping": {}}, {"conversation_id": "", "update_time": 40.0},
    ]
    (tmp_path / "conversations.json").write_text(json.dumps(rows))
    chats = E.chats(spark, str(tmp_path))
    assert sorted((r.session_id, r.project) for r in chats.select("session_id", "project").collect()) == [("chatgpt:c1", "chatgpt:g1"), ("chatgpt:c2", "chatgpt"), ("chatgpt:c3", "chatgpt")]
    got = [(r.session_id, r.type, r.content, r.ts_raw, r.uuid) for r in E.chat_turns(chats).orderBy("session_id", "seq").collect()]
    assert got == [
        ("chatgpt:c1", "user", "hello\npic", "2024-01-01T00:00:00.500Z", "m1"), ("chatgpt:c1", "assistant", "**Plan**\ndo it\n\nthen", "2024-01-01T00:00:01.000Z", "m3"), ("chatgpt:c1", "assistant", "out", "", "m4"),
        ("chatgpt:c1", "assistant", "```py\nx = 1\n```", "", "m5"), ("chatgpt:c2", "assistant", "b", "", "b"), ("chatgpt:c2", "user", "a", "", "a"),
    ]
    assert {r.session_id: r.tools for r in E.chat_tools(chats).collect()}["chatgpt:c1"] == ["search", "web"]
    assert E.chats(spark, str(tmp_path), updated_after=15.0).count() == 2


def test_audit_logs(spark, tmp_path):
    def write(folder, events):
        d = tmp_path / folder
        d.mkdir()
        (d / "audit.jsonl").write_text("\n".join(json.dumps(e) for e in events))

    say = lambda sid, kind, text, n: {"type": kind, "session_id": sid, "_audit_timestamp": f"2026-01-01T00:00:0{n}.000Z", "uuid": f"{sid}{n}", "message": {"role": kind, "content": text}}
    work = json.dumps([{"type": "tool_use", "id": "1", "name": "Write", "input": {"file_path": "/Users/me/OneDrive/plans/a.md"}}])
    write("local_A", [say("A", "user", "Make a plan. Now", 0), say("in", "user", "seed", 1), say("in", "assistant", work, 2), {**say("in", "assistant", "done", 3), "cwd": "/sessions/x/mnt/roadmap"}])
    write("local_B", [say("B", "user", "only the shell", 0), {"type": "user", "session_id": "B"}])
    records = transcripts.lines(spark, str(tmp_path), E.AUDIT_RECORD)
    got = sorted((r.session_id, r.project, r.title, r.uuid) for r in E.audited(records).collect())
    assert got == [("cowork:A", "plans", "Make a plan.", "in1"), ("cowork:A", "plans", "Make a plan.", "in2"), ("cowork:A", "plans", "Make a plan.", "in3"), ("cowork:B", "cowork_default", "only the shell", "B0")]


def test_rollout_calls(spark, tmp_path):
    call = lambda n, name, arguments: {"timestamp": f"2026-07-12T09:30:0{n}.000Z", "type": "response_item", "payload": {"type": "function_call", "name": name, "arguments": arguments}}
    patch = "*** Begin Patch\n*** Add File: a/new.py\n+x\n*** Update File: b.py\n*** Move to: c.py\n  *** Delete File: d.py\n*** Update File:  \n*** End Patch"
    events = [
        {"timestamp": "2026-07-12T09:30:00.000Z", "type": "session_meta", "payload": {"id": "s1", "cwd": "/w", "originator": "codex_vscode"}},
        call(1, "shell_command", json.dumps({"command": "ls -la", "workdir": "/w"})), call(2, "read_mcp_resource", json.dumps({"server": "docs"})), call(3, "apply_patch", json.dumps({"patch": patch})), call(4, "apply_patch", patch), call(5, "shell_command", "not json"), call(6, "shell_command", ""),
    ]
    (tmp_path / "rollout.jsonl").write_text("\n".join(json.dumps(e) for e in events))
    filled = transcripts.rollout(transcripts.lines(spark, str(tmp_path), transcripts.ROLLOUT_RECORD))
    got = E.rollout_calls(filled).orderBy("line_no", "file_path").collect()
    files = [("Write", "a/new.py"), ("Edit", "b.py"), ("Edit", "c.py"), ("Edit", "d.py")]
    assert [(r.family, r.name, r.command, r.server_name) for r in got if r.family != "file"] == [("bash", "Bash", "ls -la", None), ("mcp", "read_mcp_resource", None, "docs")]
    assert [(r.name, r.file_path) for r in got if r.family == "file"] == sorted(files, key=lambda f: f[1]) * 2
    assert {(r.session_id, r.source, r.is_error) for r in got} == {("s1", "codex_vscode", None)}
    raw = [None, "", "x y", '{"a": 1}', "[1]", "{broken"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "i int, x string")
    assert [r[0] for r in df.orderBy("i").select(E.call_arguments(F.col("x"))).collect()] == ["{}", "{}", '{"_raw":"x y"}', '{"a": 1}', '{"_raw":"[1]"}', '{"_raw":"{broken"}']
