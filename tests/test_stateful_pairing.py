"""Calls and results as streams: results before calls, late rows, and a restart from the checkpoint."""

import json

from tracemill.streaming import ingest, pairing

USE, RESULT = "session_id string, tool_call_id string, ts timestamp, name string", "session_id string, tool_call_id string, ts timestamp, is_error int"


def at(minute):
    return f"2026-01-01T{minute // 60:02d}:{minute % 60:02d}:00Z"


class Run:
    def __init__(self, spark, folder):
        self.spark, self.folder, self.n = spark, folder, 0
        for d in ("uses", "results"):
            (folder / d).mkdir()

    def more(self, uses, results):
        self.n += 1
        for d, rows in (("uses", uses), ("results", results)):
            (self.folder / d / f"{self.n}.json").write_text("\n".join(map(json.dumps, rows)) + "\n")
        stream = pairing.paired_calls(ingest.events(self.spark, str(self.folder / "uses"), USE), ingest.events(self.spark, str(self.folder / "results"), RESULT), wait="1 hour", delay="10 minutes")
        # a new query each time: it goes on from the checkpoint
        ingest.append(stream, str(self.folder / "out"), str(self.folder / "checkpoint")).awaitTermination()
        rows = self.spark.read.parquet(str(self.folder / "out")).collect()
        return sorted((r.tool_call_id, r.status, r.name, r.is_error) for r in rows)


def use(i, minute, name="Bash"):
    return {"session_id": "s", "tool_call_id": i, "ts": at(minute), "name": name}


def result(i, minute, error=0):
    return {"session_id": "s", "tool_call_id": i, "ts": at(minute), "is_error": error}


def test_pairing(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    pairing.state_store(spark)
    try:
        run = Run(spark, tmp_path)
        # one batch: a pair, a result that is ahead of its call, a call that stays open
        assert run.more([use("a", 1), use("c", 3, "Read"), use(None, 3)], [result("a", 2, 1), result("b", 2)]) == [("a", "paired", "Bash", 1)]
        # after a restart the call of b comes late, c is answered, a's rows are repeated; d waits
        assert run.more([use("b", 1, "Grep"), use("a", 1), use("d", 9)], [result("c", 8), result("a", 2, 1), result("lost", 9)]) == [("a", "paired", "Bash", 1), ("b", "paired", "Grep", 0), ("c", "paired", "Read", 0)]
        # time passes: the watermark leaves d and the lost result behind
        run.more([use("e", 200)], [])
        done = run.more([use("f", 201)], [])
        assert ("d", "unanswered", "Bash", None) in done and ("lost", "orphan", None, 0) in done
        # what comes after the watermark has passed is not taken up again, and e still pairs
        done = run.more([use("d", 9)], [result("e", 203), result("d", 10)])
        assert [x for x in done if x[0] == "d"] == [("d", "unanswered", "Bash", None)] and ("e", "paired", "Bash", 0) in done
        assert len(done) == len({x[0] for x in done}) == 6
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
