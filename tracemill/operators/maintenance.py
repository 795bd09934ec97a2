"""Repairs of stored rows, each a rewrite that changes nothing when run again, and the ingest of packages of other hosts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions import commands
from tracemill.functions.text import markers, tool_kind

from .merge import paired_by_rank

KEYS = ["session_id", "project_id"]
#: Before this day all agents were spawned by one tool.
SPAWN_DAY = "2026-03-01"


def _empty(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) == ""


def with_command_names(calls: DataFrame) -> DataFrame:
    """Names of commands where there is none yet."""
    return calls.withColumn("cmd_name", F.when(_empty("cmd_name") & ~_empty("command"), commands.cmd_name(F.col("command"))).otherwise(F.col("cmd_name")))


def with_kinds(calls: DataFrame) -> DataFrame:
    """Kinds of tool calls anew from session, server and tool."""
    return calls.withColumn("kind", tool_kind(F.col("session_id"), F.col("server_name"), F.col("name")))


def with_spawn_tools(calls: DataFrame) -> DataFrame:
    """Old spawn rows without a tool are of the only one there was."""
    old = (F.col("family") == "subagent") & _empty("spawn_tool") & (F.col("ts_raw") < SPAWN_DAY)
    return calls.withColumn("spawn_tool", F.when(old, "Task").otherwise(F.col("spawn_tool")))


def stamped(calls: DataFrame, uses: DataFrame) -> DataFrame:
    """Stored calls without an id get that of the use of the same time, session, family and input (null inputs are equal);
    ids that are there stay. uses: keys, ts_raw, family, input, tool_call_id. Of several uses the smallest id is taken."""
    one = uses.filter("tool_call_id <> ''").groupBy(*KEYS, "ts_raw", "family", "input").agg(F.min("tool_call_id").alias("found")).alias("u")
    c = calls.alias("c")
    on = (F.col("c.input").eqNullSafe(F.col("u.input"))) & (F.col("c.ts_raw") == F.col("u.ts_raw")) & (F.col("c.family") == F.col("u.family"))
    for k in KEYS:
        on = on & (F.col(f"c.{k}") == F.col(f"u.{k}"))
    joined = c.join(one, on, "left")
    return joined.select([F.coalesce(F.nullif(F.col("c.tool_call_id"), F.lit("")), F.col("u.found")).alias(n) if n == "tool_call_id" else F.col(f"c.{n}") for n in calls.columns])


def with_outcomes(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Outcomes of stored calls from the results of their ids (the last one counts); outcomes that are there stay."""
    last = results.groupBy(*KEYS, "tool_call_id").agg(F.max_by(F.struct("is_error", "error_text"), "seq").alias("r"))
    joined = calls.join(last, [*KEYS, "tool_call_id"], "left")
    fresh = F.col("is_error").isNull() & F.col("r").isNotNull()
    changed = {"is_error": F.when(fresh, F.col("r.is_error")).otherwise(F.col("is_error")), "error_text": F.when(fresh & (F.col("r.is_error") == 1), F.substring("r.error_text", 1, 2000)).otherwise(F.col("error_text"))}
    return joined.select([changed[c].alias(c) if c in changed else F.col(c) for c in calls.columns])


def marker_outcomes(messages: DataFrame) -> DataFrame:
    """Outcomes of an exported chat's tools from its marker lines: session_id, project_id, name, k (the k-th use of that
    tool in the session), is_error (null if no result came). Uses and results of a tool pair in their order."""
    rows = messages.select(*KEYS, "seq", F.posexplode(markers(F.col("content"))).alias("at", "m")).select(*KEYS, F.struct("seq", "at").alias("place"), "m.*")
    uses = rows.filter("kind = 'use'").select(*KEYS, "name", F.col("place").alias("seq"))
    results = rows.filter("kind = 'result'").select(*KEYS, "name", F.col("place").alias("seq"), F.when(F.col("result") == "error", 1).when(F.col("result") == "ok", 0).alias("is_error"))
    paired = paired_by_rank(uses, results, [*KEYS, "name"])
    found = results.select(*KEYS, "name", F.col("seq").alias("result_seq"), "is_error")
    return paired.join(found, [*KEYS, "name", "result_seq"], "left").select(*KEYS, "name", "k", "is_error")


def moved_projects(sessions: DataFrame, paths: DataFrame, infer: Callable[[Column], Column]) -> DataFrame:
    """session_id, project of the sessions whose stored paths (session_id, place, path) tell another project: the first path
    that tells one decides for the whole session."""
    told = paths.withColumn("found", infer(F.col("path"))).filter("found is not null").groupBy("session_id").agg(F.min_by("found", "place").alias("found"))
    return sessions.join(told, "session_id").filter(~F.col("found").eqNullSafe(F.col("project"))).select("session_id", F.col("found").alias("project"))


# packages of other hosts


def translated(rows: DataFrame, theirs: DataFrame, ours: DataFrame, key: str) -> DataFrame:
    """Rows with their `key` replaced by our id of the same name; rows of names that we do not know are left out."""
    ids = theirs.select(F.col("id").alias(key), "name").join(ours.select(F.col("id").alias("our_id"), "name"), "name").select(key, "our_id")
    return rows.join(ids, key).select([F.col("our_id").alias(c) if c == key else F.col(c) for c in rows.columns])


def ingested(existing: DataFrame, package: DataFrame, keys: list[str], fill: tuple[str, ...] = ()) -> DataFrame:
    """Existing rows and those of a package that are new by `keys`; existing rows take from the package only the columns in
    `fill` that they lack. Within a package the first row of a key counts, by its other columns."""
    others = [c for c in existing.columns if c not in keys]
    first = package.groupBy(*keys).agg(F.min(F.struct(*others)).alias("p"))
    joined = existing.withColumn("here", F.lit(True)).join(first, keys, "full_outer")
    here = F.coalesce("here", F.lit(False))
    pick = lambda c: F.when(here, F.coalesce(F.col(c), F.col(f"p.{c}")) if c in fill else F.col(c)).otherwise(F.col(f"p.{c}")).alias(c)
    return joined.select([F.col(c) if c in keys else pick(c) for c in existing.columns])


def gate(stored: Column, since: Column) -> Column:
    """From when on is read: the older of the stored watermark and a given bound. What is stored is never lowered by it."""
    return F.least(stored, since)
