import hashlib
import heapq
import random
import zlib

import pytest

from tracemill.llm import repair as R

WHITE = " \t\n\x0b\x0c\r"


def damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        kept = out.setdefault(conv, [])
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        kept += [((turn is not None, turn or 0), role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return {c: sorted(v) for c, v in out.items()}


def cheapest(turns):
    """Uniform-cost search over (turns read, grammar state, audit): the first end that comes out is the least."""
    heap = [(0, "", 0, "0", ())]
    while heap:
        cost, audit, i, state, lines = heapq.heappop(heap)
        if i == len(turns) and state in "0A":
            return cost, audit, lines
        if audit[-3:] == "III":
            continue
        after = {"0": "U", "S": "U", "U": "A", "A": "U"}[state]
        made = "user" if after == "U" else "assistant"
        heapq.heappush(heap, (cost + 5, audit + "I", i, after, (*lines, made + ":")))
        if i < len(turns):
            role, text, fault = turns[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, state, lines))
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                heapq.heappush(heap, (cost + 1 + more, audit + "R", i + 1, after, (*lines, f"{made}:{text}")))
                kept = {"0s": "S", "0u": "U", "Su": "U", "Ua": "A", "Au": "U"}.get(state + role[:1])
                if kept and role:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, kept, (*lines, f"{role}:{text}")))
    return None


def slow(rows):
    out = []
    for conv, v in damage(rows).items():
        seen, turns, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in v:
            trimmed = text.rstrip(WHITE)
            fault = "blank" if not trimmed else "duplicate" if (role, text) in seen else "truncated" if trimmed[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            turns.append((role, text, fault))
        numbers = [t for (known, t), _, _ in v if known]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        initials = [r[:1] for r, _, _ in turns]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        cost, audit, lines = cheapest(turns)
        out.append((conv, gaps, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, c string, seg int")


def report(spark, rows):
    return sorted((tuple(r) for r in R.repair_report(table(spark, rows)).collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_search(spark, seed):
    rng = random.Random(seed)
    rows = []
    for conv in [None, *range(-20, 150)]:
        for turn in range(rng.randint(1, 9)):
            text = rng.choice(["Yes.", "No!", "So", "a. b", " ", None, f"t{turn}?", f"u{turn}. \n", "é" * 5 + "."])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 2, None]), rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None]), text))
    rng.shuffle(rows)
    assert report(spark, rows) == slow(rows)


def test_segments_of_long_conversations(spark, monkeypatch):
    """Against the same with one segment a conversation."""
    rng = random.Random(3)
    rows = [(conv, t, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["x", f"{t}.", f"{t}!", "."])) for conv in range(4) for t in range(150)] + [(9, 0, "user", "a.")]
    cut = report(spark, rows)
    monkeypatch.setattr(R, "SEGMENT", 7)
    monkeypatch.setattr(R, "BATCH", 20)
    assert report(spark, rows) == cut
    monkeypatch.setattr(R, "SEGMENT", 1 << 40)
    monkeypatch.setattr(R, "BATCH", 1 << 20)
    assert report(spark, rows) == cut


def test_small_tables(spark):
    assert report(spark, []) == []
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert report(spark, [(gone, 0, "user", "x.")]) == [(gone, 0, 0, 0, 0, 0, 0, "", R.EMPTY_SHA256)]
    rows = [(1, 0, "user", "y" * 300000 + "."), (1, 1, "assistant", "z" * 300000 + "!"), (2, None, None, None), (3, 5, "user", "q?"), (3, 5, "user", "q?")]
    assert report(spark, rows) == slow(rows)


def test_moves_cover_the_grammar():
    assert R.closing("0") == "" and R.closing("S") == "II" and R.closing("U") == "I" and R.closing("A") == ""
    kept = {(s, i, n) for s, i, letters, n, _, _ in R.moves() if letters == "K"}
    assert kept == {("0", "s", "S"), ("0", "u", "U"), ("S", "u", "U"), ("U", "a", "A"), ("A", "u", "U")}


def test_joins_that_are_split_for_skew(spark):
    """Adaptive execution may split a skewed partition; no conversation may come apart."""
    rows = [(conv, t, ("user", "assistant")[t % 2], f"{conv} {t} " + "x" * (3000 if conv < 5 else 5) + ".") for conv in range(60) for t in range(6)]
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        assert report(spark, rows) == slow(rows)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
