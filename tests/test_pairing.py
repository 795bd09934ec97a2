"""Queue matching against a plain queue on random logs where results outnumber calls."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from tracemill.operators import pairing


def plain(rows):
    queues, answers, lost = {}, {}, {}
    for name, at, kind, status in sorted(rows, key=lambda r: r[1]):
        q = queues.setdefault(name, deque())
        lost.setdefault(name, 0)
        if kind == "use":
            answers[at] = None
            q.append(at)
        elif q:
            answers[q.popleft()] = status
        else:
            lost[name] += 1
    return answers, lost


@pytest.mark.parametrize("share", [0.3, 0.5, 0.7])
def test_queue(spark, share):
    rng = random.Random(int(share * 10))
    names = ["a"] * 8 + ["b", "c", None]
    rows = [(rng.choice(names), i, "use" if rng.random() < share else "result", rng.choice(["ok", "error", None])) for i in range(3000)]
    table = spark.createDataFrame(rng.sample(rows, len(rows)), "name string, at long, kind string, status string")
    answers, lost = plain(rows)
    got = pairing.fifo_paired(table, ["name"], [F.col("at")], F.col("kind") == "use", ["status", "at"])
    assert {r["at"]: r.result_status for r in got.collect()} == answers
    assert all(r.answered == (r.result_at is not None) and (r.result_at is None or r.result_at > r["at"]) for r in got.collect())
    found = pairing.orphans(table, ["name"], [F.col("at")], F.col("kind") == "use")
    assert {r.name: r.orphans for r in found.collect()} == lost
    assert pairing.fifo_paired(table.limit(0), ["name"], [F.col("at")], F.col("kind") == "use", ["status"]).collect() == []
