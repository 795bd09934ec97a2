"""Conversation structure repair: the cheapest edits that make the roles of a conversation alternate.

Turns are checked for faults (blank, duplicate, truncated) and edited: kept, given another role, deleted, or joined by new
empty turns, so that the roles' initials read `(s?(ua)+)?`. What is left to choose after some turns depends on one of four
grammar states, so the cheapest edits are found turn by turn.

Conversations are cut into segments of `SEGMENT` turns, dealt out by hash. Each task hands batches of segments to DuckDB,
whose recursive query advances one turn of all of them with each recursion and keeps, for each grammar state, the least
cost and among equal costs the least audit. Segments after the first are solved for each state that they may begin in;
a fold over a conversation's segments then picks the way through, so that a conversation of any length is spread over tasks.

Edits with equal cost are never prefixes of each other within one state (the longer one would hold inserted turns more,
which cost), so the least audit of a whole is made of least audits of its parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.operators import scan
from tracemill.operators.storage import written

#: Turns of a segment; turns that a batch hands to DuckDB.
SEGMENT, BATCH = 64, 32768
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}
TRUNCATED_COST = 5
#: Grammar states: nothing yet, a system turn, a user turn, an assistant turn. By state, what may come, and the state then.
GRAMMAR = {"0": {"s": "S", "u": "U"}, "S": {"u": "U"}, "U": {"a": "A"}, "A": {"u": "U"}}
ENDS = ("0", "A")
#: What an inserted or re-roled turn is in each state.
NEXT = {"0": "u", "S": "u", "U": "a", "A": "u"}
ROLE = {"u": "user", "a": "assistant"}
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
SPACE = " \t\n\x0b\x0c\r"
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def moves() -> list[tuple[str, str, str, str, int, bool]]:
    """(state, initial, letters, next state, cost, keeps the turn) of one turn and of up to two turns inserted before it;
    more inserted turns would come back to a state at a cost."""
    out = []
    for start in GRAMMAR:
        state, inserts = start, ""
        for _ in range(3):
            for initial in ("s", "u", "a", ""):
                base = COST[INSERT] * len(inserts)
                out.append((start, initial, inserts + DELETE, state, base + COST[DELETE], False))
                out.append((start, initial, inserts + REROLE, GRAMMAR[state][NEXT[state]], base + COST[REROLE], True))
                if initial in GRAMMAR[state]:
                    out.append((start, initial, inserts + KEEP, GRAMMAR[state][initial], base + COST[KEEP], True))
            state, inserts = GRAMMAR[state][NEXT[state]], inserts + INSERT
    return out


def closing(state: str) -> str:
    """The turns to insert behind the last one."""
    letters = ""
    while state not in ENDS:
        state, letters = GRAMMAR[state][NEXT[state]], letters + INSERT
    return letters


_MOVES = ", ".join(f"('{s}', '{i}', '{letters}', '{n}', {c}, {k})" for s, i, letters, n, c, k in moves())
#: turns: seg, k (from 0 in each), initial, fault; segs: seg, size, first.
SOLVE = f"""
WITH RECURSIVE moves(state, initial, letters, next, cost, keeps) AS (VALUES {_MOVES}),
step AS (
  SELECT seg, s.start, s.start AS state, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS cost, '' AS audit FROM segs, (VALUES ('0'), ('S'), ('U'), ('A')) AS s(start) WHERE s.start = '0' OR NOT first
  UNION ALL
  SELECT seg, start, state, k, best.cost, best.audit FROM (
    SELECT p.seg, p.start, m.next AS state, p.k + 1 AS k,
      min(struct_pack(cost := p.cost + m.cost + CASE WHEN m.keeps AND t.fault = {TRUNCATED} THEN {TRUNCATED_COST} ELSE 0 END, audit := p.audit || m.letters)) AS best
    FROM step p JOIN turns t ON t.seg = p.seg AND t.k = p.k JOIN moves m ON m.state = p.state AND m.initial = t.initial
    WHERE NOT (m.keeps AND t.fault IN ({BLANK}, {DUPLICATE})) GROUP BY p.seg, p.start, m.next, p.k))
SELECT seg, start, state, cost, audit FROM step JOIN segs USING (seg) WHERE k = size ORDER BY seg, start, state"""


def damaged(conversations: DataFrame) -> DataFrame:
    """c, turn, role, text after damage by crc32(`conv_id:turn`) % 20: 0 drops a row, 1 empties its text, 2 removes its [.!?], 3 repeats
    it, 4 makes it a user's. Null ids, turns (in that key), roles and texts are one space; c is the id as text."""
    space = F.lit(" ")
    rows = conversations.select(F.coalesce(F.col("conv_id").cast("string"), space).alias("c"), "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    kind = F.crc32(F.concat("c", F.lit(":"), F.coalesce(F.col("turn").cast("string"), space)).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.withColumn("kind", kind).filter("kind <> 0").select("c", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def numbered(turns: DataFrame) -> DataFrame:
    """c, turn, role, text with seg and k: the turns of each c by turn (nulls first; of one turn by role and text)."""
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    rows = scan.running(turns.select("c", "turn", "role", "text"), ["c"], order, "pos")
    return rows.withColumns({"seg": F.floor((F.col("pos") - 1) / SEGMENT), "k": (F.col("pos") - 1) % SEGMENT})


def with_faults(turns: DataFrame) -> DataFrame:
    """`numbered` turns as c, seg, k, turn, initial of the role and first fault (0: none); texts stay behind."""
    ha, hb = F.xxhash64(F.lit("a"), "role", "text"), F.xxhash64(F.lit("b"), "text", "role")
    trimmed = F.rtrim(F.col("text"), F.lit(SPACE))
    own = F.when(trimmed == "", BLANK).when(~F.substring(trimmed, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(0)
    rows = turns.select("c", "seg", "k", "pos", "turn", F.substring("role", 1, 1).alias("initial"), own.alias("own"), ha.alias("ha"), hb.alias("hb"))
    # the first of equal turns, found by what is aggregated before the shuffle; at most SEGMENT of them in a segment
    firsts = rows.groupBy("c", "ha", "hb").agg(F.min("pos").alias("pos"))
    firsts = firsts.groupBy("c", F.floor((F.col("pos") - 1) / SEGMENT).alias("seg")).agg(F.collect_list((F.col("pos") - 1) % SEGMENT).alias("new"))
    again = ~F.coalesce(F.array_contains("new", F.col("k")), F.lit(False))
    fault = F.when(F.col("own") == BLANK, BLANK).when(again, DUPLICATE).otherwise(F.col("own"))
    return rows.join(firsts, ["c", "seg"], "left").select("c", "seg", "k", "turn", "initial", fault.alias("fault"))


_SOLVED = "c string, seg long, start string, state string, cost long, audit string, illegal long, head string, tail string"


def solved(turns: DataFrame) -> DataFrame:
    """For each segment, and each state that it may begin and end in: the least cost and audit. illegal counts neighbours
    within the segment; head and tail are the initials it begins and ends with."""
    names = ["c", "seg", "k", "initial", "fault"]
    legal = np.array(["su", "ua", "au"])

    def answer(con: duckdb.DuckDBPyConnection, table: pa.Table) -> pa.RecordBatch:
        c, seg = table.column("c"), table.column("seg").to_numpy()
        ids = c.combine_chunks().dictionary_encode().indices.to_numpy()
        begins = np.flatnonzero(np.r_[True, (np.diff(ids) != 0) | (np.diff(seg) != 0)])
        sizes = np.diff(np.r_[begins, len(seg)])
        which = np.repeat(np.arange(len(begins)), sizes)
        initial = np.array(table.column("initial").to_pylist(), "U1")
        pairs = np.char.add(initial[:-1], initial[1:])
        bad = np.add.reduceat(np.r_[~np.isin(pairs, legal), True].astype(np.int64), begins)
        bad -= np.r_[~np.isin(pairs, legal), True][begins + sizes - 1]  # the last turn's neighbour is in another segment
        known = np.where(np.isin(initial, list("sua")), initial, "")
        turns = pa.table({"seg": which, "k": np.arange(len(seg)) - begins[which], "initial": pa.array(known.tolist(), pa.string()), "fault": table.column("fault")})  # noqa: F841
        segs = pa.table({"seg": np.arange(len(begins)), "size": sizes, "first": seg[begins] == 0})  # noqa: F841
        con.register("turns", turns)
        con.register("segs", segs)
        out = con.sql(SOLVE).to_arrow_table()
        con.unregister("turns")
        con.unregister("segs")
        at = out.column("seg").to_numpy()
        columns = [c.take(pa.array(begins[at])), pa.array(seg[begins][at]), *[out.column(n).cast(t) for n, t in (("start", pa.string()), ("state", pa.string()), ("cost", pa.int64()), ("audit", pa.string()))]]
        columns += [pa.array(bad[at]), pa.array(initial[begins][at].tolist(), pa.string()), pa.array(initial[begins + sizes - 1][at].tolist(), pa.string())]
        return pa.table(columns, names=["c", "seg", "start", "state", "cost", "audit", "illegal", "head", "tail"]).combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            while b.num_rows:
                if size < BATCH:
                    held.append(b.slice(0, BATCH - size))
                    size += held[-1].num_rows
                    b = b.slice(held[-1].num_rows)
                    continue
                # full: it ends where the segment of its last turn ends
                last = held[-1].slice(held[-1].num_rows - 1).to_pylist()[0]
                tail = b.slice(0, SEGMENT).to_pylist()
                cut = next((i for i, r in enumerate(tail) if (r["c"], r["seg"]) != (last["c"], last["seg"])), len(tail))
                if cut:
                    held.append(b.slice(0, cut))
                    b = b.slice(cut)
                if b.num_rows:
                    yield answer(con, pa.Table.from_batches(held))
                    held, size = [], 0
        if held:
            yield answer(con, pa.Table.from_batches(held))
        con.close()

    # little to read and much to do: not to be joined into few tasks by size
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return turns.select(*names).repartition(n, "c", "seg").sortWithinPartitions("c", "seg", "k").mapInArrow(run, _SOLVED)


_CHOSEN = "c string, seg long, start string, part string, cost long, audit string, illegal long"


def chosen(segments: DataFrame) -> DataFrame:
    """The way through the segments of each conversation: for each segment the state it begins in and its part of the audit;
    with the first one, the conversation's cost, whole audit and number of illegal neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        now, seg, ways, illegal, tail = None, None, {}, 0, ""
        options: dict[str, list[tuple]] = {}

        def advanced(seg_ways: dict, seg_options: dict) -> dict:
            new: dict[str, tuple] = {}
            for start, (cost, audit, path) in seg_ways.items():
                for state, c, part in seg_options.get(start, ()):
                    found = (cost + c, audit + part)
                    if state not in new or found < new[state][:2]:
                        new[state] = (*found, (path, start, part))
            return new

        def close() -> None:
            final = advanced(ways, options)
            cost, audit, path, rest = min((c + COST[INSERT] * len(closing(s)), a + closing(s), p, closing(s)) for s, (c, a, p) in final.items())
            parts = []
            while path is not None:
                path, start, part = path
                parts.append((start, part))
            parts[0] = (parts[0][0], parts[0][1] + rest)
            for i, (start, part) in enumerate(reversed(parts)):
                out.append((now, i, start, part, *((cost, audit, illegal) if i == 0 else (None, None, None))))

        def flushed() -> pa.RecordBatch:
            types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            columns = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names=["c", "seg", "start", "part", "cost", "audit", "illegal"])

        for b in batches:
            for c, s, start, state, cost, audit, bad, head, end in zip(*(b.column(i).to_pylist() for i in range(9)), strict=True):
                if c != now:
                    if now is not None:
                        close()
                    now, seg, ways, options, illegal, tail = c, s, {"0": (0, "", None)}, {}, bad, end
                elif s != seg:
                    ways, seg, options = advanced(ways, options), s, {}
                    illegal += bad + (tail + head not in ("su", "ua", "au"))
                    tail = end
                options.setdefault(start, []).append((state, cost, audit))
            if out:
                yield flushed()
        if now is not None:
            close()
            yield flushed()

    return segments.repartition("c").sortWithinPartitions("c", "seg", "start", "state").mapInArrow(run, _CHOSEN)


def repaired(turns: DataFrame, ways: DataFrame) -> DataFrame:
    """c, seg and the segment's turns after repair (edit, role, text), in order; segments left without turns are not listed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("c", pa.string()), ("seg", pa.int64()), ("turns", pa.list_(pa.struct([("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])))])
        now, letters, state, lines = None, iter(()), "0", []
        out: list[dict] = []

        def add(edit: str, role: str | None, text: str) -> None:
            nonlocal state
            initial = role[:1] if edit == KEEP else NEXT[state]
            lines.append({"edit": edit, "role": role if edit == KEEP else ROLE[initial], "text": text})
            state = GRAMMAR[state][initial]

        def close() -> None:
            for letter in letters:  # only inserted turns are left
                add(letter, None, "")
            if lines:
                out.append({"c": now[0], "seg": now[1], "turns": lines})

        for b in batches:
            for c, seg, k, role, text, start, part in zip(*(b.column(i).to_pylist() for i in range(7)), strict=True):
                if k < 0:
                    if now is not None:
                        close()
                    now, letters, state, lines = (c, seg), iter(part), start, []
                    continue
                while (letter := next(letters)) == INSERT:
                    add(INSERT, None, "")
                if letter != DELETE:
                    add(letter, role, text)
                if len(out) >= 256:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out = []
        if now is not None:
            close()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    # a segment's way comes before its turns: one shuffle, and no join whose partitions might be split
    none = F.lit(None).cast("string")
    rows = turns.select("c", "seg", "k", "role", "text", none.alias("start"), none.alias("part"))
    rows = rows.unionByName(ways.select("c", "seg", F.lit(-1).cast("long").alias("k"), none.alias("role"), none.alias("text"), "start", "part"))
    return rows.repartition("c", "seg").sortWithinPartitions("c", "seg", "k").mapInArrow(run, "c string, seg long, turns array<struct<edit:string,role:string,text:string>>")


def _digests(segments: DataFrame) -> DataFrame:
    """sha256 of the `role:text` of all turns of each c, joined by line breaks: segments stream through in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        out: list[tuple] = []
        for b in batches:
            for c, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if c != now:
                    if now is not None:
                        out.append((now, state.hexdigest()))
                    now, state = c, hashlib.sha256(text.encode())
                else:
                    state.update(b"\n" + text.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*out, strict=True)], names=["c", "repaired_sha256"])
                out.clear()
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([state.hexdigest()])], names=["c", "repaired_sha256"])

    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    return segments.select("c", "seg", joined.alias("text")).repartition("c").sortWithinPartitions("c", "seg").select("c", "text").mapInArrow(run, "c string, repaired_sha256 string")


def repair_report(conversations: DataFrame) -> DataFrame:
    """Damage `conversations` (conv_id, turn, role, text), find the faults, repair. One row for each original conv_id (a null one too):
    gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256. Repeated rows are turns of their own (and
    duplicates); no turns after damage are zeros, an empty audit and the digest of nothing; other columns are ignored."""
    kind = dict(conversations.dtypes)["conv_id"]
    turns = numbered(damaged(conversations))
    faulty = written(with_faults(turns), "repair-faults")
    ways = written(chosen(solved(faulty)), "repair-ways")
    count = lambda fault: F.count(F.when(F.col("fault") == fault, 1))
    faults = faulty.groupBy("c").agg(count(BLANK).alias("blank"), count(DUPLICATE).alias("duplicate"), count(TRUNCATED).alias("truncated"))
    seen = faulty.filter("turn is not null").groupBy("c", "turn").agg(F.lit(1).alias("one")).groupBy("c").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).cast("long").alias("gaps"))
    all_ = conversations.select(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("c")).distinct()
    out = all_.join(seen, "c", "left").join(faults, "c", "left").join(ways.filter("seg = 0").select("c", "illegal", "cost", "audit"), "c", "left").join(_digests(repaired(turns, ways)), "c", "left")
    zeros = [F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.when(F.col("c") != " ", F.col("c")).cast(kind).alias("conv_id"), *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(EMPTY_SHA256)).alias("repaired_sha256"))
