import json
import os

from tracemill.sources import transcripts as T
from tracemill.streaming import ingest


def _write(folder, name, records):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in records) + "\n")
    return str(folder)


def test_session_log(spark, tmp_path):
    use = [{"type": "text", "text": "hi"}, {"type": "tool_use", "id": "t1", "name": "Bash", "input": {"command": "cat -n a.py"}}, {"type": "tool_use", "id": "t2", "name": "mcp__srv__do__it", "input": {}}, {"type": "tool_use", "id": "t3", "name": "Read", "input": {}}]
    said = {"role": "assistant", "model": "m", "id": "api", "content": use, "usage": {"input_tokens": 3, "output_tokens": 4}}
    path = _write(tmp_path / "a", "s.jsonl", [
        {"type": "user", "sessionId": "s", "timestamp": "2026-01-01T00:00:00.000Z", "uuid": "u1", "message": {"role": "user", "content": "what is this"}}, "", "{not json",
        {"type": "summary", "sessionId": "s", "summary": "old"}, {"type": "ai-title", "sessionId": "s", "aiTitle": "made"},
        *[{"type": "assistant", "sessionId": "s", "timestamp": f"2026-01-01T00:00:0{i}.000Z", "uuid": f"a{i}", "message": said} for i in (1, 2)],
    ])
    records = T.lines(spark, path, T.SESSION_RECORD)
    got = {r.uuid: (r.type, r.tokens_in) for r in T.session_messages(records).collect()}
    assert got == {"u1": ("user", 0), "a1": ("assistant", 3), "a2": ("assistant", 0)}
    assert T.session_titles(records).collect()[0].title == "made"
    assert T.session_usage(records).count() == 2
    calls = T.session_calls(records)
    found = sorted({(r.family, r.name, r.file_path or "", r.server_name) for r in calls.collect()})
    assert found == [("bash", "Bash", "", ""), ("file", "BashRead", "a.py", ""), ("mcp", "do__it", "", "srv")]


def test_rollout(spark, tmp_path):
    total = lambda i, c, o: {"timestamp": f"t{i}{c}{o}", "type": "event_msg", "payload": {"type": "token_count", "info": {"total_token_usage": {"input_tokens": i, "cached_input_tokens": c, "output_tokens": o}}}}
    path = _write(tmp_path / "b", "r.jsonl", [
        {"timestamp": "t0", "type": "session_meta", "payload": {"id": "x", "originator": "codex_vscode", "cwd": "/w"}}, {"timestamp": "t1", "type": "turn_context", "payload": {"model": "m1"}},
        {"timestamp": "t2", "type": "response_item", "payload": {"type": "message", "role": "developer", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}}, total(10, 4, 1), total(15, 6, 2), total(3, 0, 1), total(3, 0, 1),
    ])
    filled = T.rollout(T.lines(spark, path, T.ROLLOUT_RECORD))
    assert [(r.session_id, r.source, r.type, r.content, r.model) for r in T.rollout_messages(filled).collect()] == [("x", "codex_vscode", "user", "a\nb", "m1")]
    assert sorted((r.input_tokens, r.cache_read_tokens, r.output_tokens) for r in T.rollout_usage(filled).collect()) == [(3, 0, 1), (3, 2, 1), (6, 4, 1)]


def test_chat_export(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps([{"uuid": "k", "name": "n", "chat_messages": [{"uuid": "1", "sender": "human", "created_at": "t", "text": "flat", "content": []}, {"uuid": "2", "sender": "assistant", "created_at": "t", "text": "", "content": [{"type": "text", "text": "rich"}]}]}]))
    assert [(r.session_id, r.type, r.content) for r in T.chat_messages(spark, str(tmp_path / "c.json")).orderBy("seq").collect()] == [("claudeai:k", "user", "flat"), ("claudeai:k", "assistant", "rich")]


def test_stream(spark, tmp_path):
    rows = [{"id": 1, "ts": "2026-01-01T00:00:00Z", "kind": "a"}, {"id": 1, "ts": "2026-01-01T00:00:00Z", "kind": "a"}, {"id": 2, "ts": "2026-01-01T05:00:00Z", "kind": "a"}]
    path = _write(tmp_path / "d", "e.json", rows)
    stream = ingest.deduplicated(ingest.events(spark, path, "id long, ts timestamp, kind string"), ["id"])
    ingest.append(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2]


def test_rollout_of_many_splits(spark, tmp_path):
    """Numbers and carried values as in one split, and token counts as from a loop over the file."""
    import random

    rng = random.Random(7)
    records, totals = [], {"input_tokens": 0, "cached_input_tokens": 0, "output_tokens": 0, "reasoning_output_tokens": 0}
    for i in range(900):
        kind, ts = rng.random(), f"t{i // 2 if rng.random() < 0.1 else i:05d}"
        if i == 0 or kind < 0.02:
            records.append({"timestamp": ts, "type": "session_meta", "payload": {"id": f"s{i}", "originator": "codex_vscode", "cwd": f"/w{i}"}})
        elif kind < 0.06:
            records.append({"timestamp": ts, "type": "turn_context", "payload": {"model": rng.choice(["m1", "m2", ""])}})
        elif kind < 0.1:
            records.append("{broken")
        elif kind < 0.4:
            info = {}
            if rng.random() < 0.6:
                totals = {k: v + rng.randint(0, 9) for k, v in totals.items()} if rng.random() < 0.7 else dict(totals) if rng.random() < 0.7 else {k: rng.randint(0, v) for k, v in totals.items()}
                info["total_token_usage"] = dict(totals)
            if rng.random() < 0.6:
                info["last_token_usage"] = {"input_tokens": rng.randint(0, 2), "output_tokens": rng.choice([0, 5])}
            records.append({"timestamp": ts, "type": "event_msg", "payload": {"type": "token_count", "info": info or None}})
        else:
            records.append({"timestamp": ts, "type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"type": "text", "text": "x" * rng.randint(0, 80)}]}})
    path = _write(tmp_path / "many", "r.jsonl", records)

    held, previous, last, expected = {}, None, None, {}
    for r in (r for r in records if r != "{broken"):
        p = r["payload"]
        if r["type"] == "session_meta":
            held |= {"session": p["id"], "cwd": p["cwd"]}
        if r["type"] == "turn_context":
            held["model"] = p["model"]
        info = p.get("info") or {} if r["type"] == "event_msg" else {}
        if t := info.get("total_token_usage"):
            usage = {k: v - (previous or {}).get(k, 0) for k, v in t.items()}
            usage, previous = (t if min(usage.values()) < 0 else usage), t
            if max(usage.values()) <= 0:
                continue
        elif usage := info.get("last_token_usage"):
            if usage == last:
                continue
            last = usage
        else:
            continue
        key, cached = (held["session"], r["timestamp"]), usage.get("cached_input_tokens", 0)
        row = expected.setdefault(key, [held.get("model") or None, held["cwd"], max(0, usage.get("input_tokens", 0) - cached), cached, usage.get("output_tokens", 0)])
        row[0] = row[0] or held.get("model") or None

    def read():
        rows = T.lines(spark, path, T.ROLLOUT_RECORD)
        filled = T.rollout(rows)
        usage = {(r.session_id, r.ts_raw): [r.model, r.cwd, r.input_tokens, r.cache_read_tokens, r.output_tokens] for r in T.rollout_usage(filled).collect()}
        return rows.select("block").distinct().count(), sorted((r.line_no, r.session_id, r.model or "", r.cwd) for r in filled.collect()), usage

    whole = read()
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        cut = read()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert whole[0] == 1 and cut[0] > 20
    assert cut[1:] == whole[1:]
    assert [n for n, *_ in whole[1]] == [i + 1 for i, r in enumerate(records) if r != "{broken"]
    assert cut[2] == expected


def test_packs_read_like_single_files(spark, tmp_path):
    """Logs in packs that are read in many splits: the same lines, numbers and carried values as from one file each."""
    rows = []
    for user in range(40):
        rows.append((user, 0, '{"type": "session_meta", "payload": {"id": "u%d"}}' % user))
        for k in range(1, 5 + user * 7 % 90):
            rows.append((user, k, "" if k % 11 == 5 else "no record" if k % 13 == 7 else '{"type": "turn_context", "payload": {"model": "m%d"}}' % k if k % 17 == 3 else '{"type": "event_msg", "timestamp": "%d"}' % k))
    logs = spark.createDataFrame(rows, "user long, at long, value string")
    T.packed(logs.repartition(5), "user", ["at"], str(tmp_path / "packs"))
    packs = list((tmp_path / "packs").glob("*.txt"))
    assert len(packs) <= 8
    for user in range(40):
        (tmp_path / f"{user}.jsonl").write_text("".join(f"{v}\n" for u, _, v in rows if u == user))
    wanted = T.rollout(T.lines(spark, str(tmp_path), T.ROLLOUT_RECORD)).select("session_id", "line_no", "type", "timestamp", "model").collect()
    for size in (700, 5_000, 1_000_000):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            got = T.rollout(T.packed_lines(spark, str(tmp_path / "packs"), T.ROLLOUT_RECORD)).select("session_id", "line_no", "type", "timestamp", "model").collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert sorted(map(str, got)) == sorted(map(str, wanted))


def test_many_small_logs_cost_few_files(spark, tmp_path):
    from tracemill.plans import ingest_catalogue

    logs = spark.range(3000).selectExpr("id % 1000 AS user", "id AS at", "'{}' AS value")
    folder = ingest_catalogue._logs(logs, "user", ["at"]).removeprefix("file:")
    assert sum(len([n for n in names if not n.startswith((".", "_"))]) for _, _, names in os.walk(folder)) <= 8
