"""Logs that arrive over time: grown logs, old times in new files, agents' logs, and runs that change nothing."""

import glob
import json

from tracemill.streaming import incremental as I


def record(i, minute, kind="user", session="s1"):
    return json.dumps({"type": kind, "sessionId": session, "timestamp": f"2026-01-01T00:{minute:02d}:00.000Z", "uuid": i, "message": {"role": kind, "content": f"text {i}"}})


def test_incremental(spark, tmp_path):
    logs, folder = tmp_path / "logs", str(tmp_path / "tables")
    (logs / "app" / "s1" / "subagents" / "workflows" / "wf_1").mkdir(parents=True)
    I.create(spark, folder, buckets=4)
    put = lambda name, *rows: (logs / name).write_text("\n".join(rows) + "\n")
    run = lambda **more: I.ingest(spark, str(logs), folder, str(tmp_path / "checkpoint"), "cli", "h", buckets=4, **more)
    have = lambda: {(r.session_id, r.uuid) for r in I.table(spark, folder, "messages").collect()}
    marks = lambda: {(r.project, r.source, r.host): r.value[14:16] for r in I.table(spark, folder, "state").collect()}
    files = lambda: set(glob.glob(f"{folder}/*/bucket=*/*.parquet"))

    put("app/s1.jsonl", record("a", 1), record("b", 10, "assistant"), "", "{broken", json.dumps({"type": "summary", "summary": "x"}))
    run()
    assert have() == {("s1", "a"), ("s1", "b")} and marks() == {("app", "cli", "h"): "10"}
    before = files()
    run()
    assert files() == before

    # an ordinary log with an old row (behind the watermark), a row that is here already, and a new one; two agents' logs, all old
    put("app/s1-more.jsonl", record("old", 5), record("b", 10, "assistant"), record("c", 20))
    put("app/s1/subagents/agent-a1f.jsonl", record("d", 2))
    put("app/s1/subagents/workflows/wf_1/agent-b2.jsonl", record("e", 3), record("e", 3))
    put("app/s1/subagents/agent-acompact-1.jsonl", record("noise", 30))
    run()
    assert have() == {("s1", "a"), ("s1", "b"), ("s1", "c"), ("s1::agent-a1f", "d"), ("s1::agent-b2", "e")}
    assert marks() == {("app", "cli", "h"): "20"}
    agent = next(r for r in I.table(spark, folder, "messages").collect() if r.uuid == "d")
    assert (agent.project, agent.agent_id, agent.parent_session_id) == ("app", "a1f", "s1")

    # an earlier bound lets old rows of a new file in, and does not move the watermark back; another project starts its own
    put("app/late.jsonl", record("late", 4))
    (logs / "web").mkdir()
    put("web/s9.jsonl", record("w", 6, session="s9"))
    run(since="2026-01-01T00:03:00.000Z")
    assert {("s1", "late"), ("s9", "w")} <= have() and marks() == {("app", "cli", "h"): "20", ("web", "cli", "h"): "06"}

    # a batch that is run again changes nothing
    before = files()
    lines = spark.read.option("recursiveFileLookup", "true").text(str(logs)).selectExpr("_metadata.file_path AS file", "value")
    assert I.merge_batch(lines.filter("file like '%agent%' or file like '%s1.jsonl'"), folder, "cli", "h", buckets=4) == {"messages": 0, "state": 0}
    assert files() == before
