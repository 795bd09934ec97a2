"""Merging packages of sessions that other hosts send into the tables of this one.

A package holds one row for each session with its child rows as arrays (`merge.export_package` makes them). Ids are ours: names
of the host, the user and the projects are translated first. Children merge by natural keys; a call that is here already
takes only the outcome that it lacks. What can be derived is derived here, whatever the package says. Totals are counted
again for sessions that got rows, and for no others. The cursor moves last.

`changes` says which rows are new or different, so that merging a package twice changes nothing; `applied` writes them to
tables in place (`tables`)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions import commands
from tracemill.functions.identity import hostname
from tracemill.functions.text import tool_kind

from . import merge, sessions, tables
from .storage import written

SESSION = ["session_id", "project_id"]
#: Keys of each table, in the order in which they are written.
KEYS = {
    "hosts": ["name"], "users": ["name"], "projects": ["name"], "messages": [*SESSION, "uuid"], "token_usage": [*SESSION, "ts_raw"], "tool_calls": ["call_key"],
    "sessions": SESSION, "session_sources": SESSION, "state": ["key", "host_id"],
}
OUTCOME = ("is_error", "duration_ms", "error_text", "exit_code")
_CALL = ("session_id", "project_id", "ts_raw", "family", "name", "tool", "file_path", "command", "pattern", "skill_name", "subagent_type", "server_name")
# Sources that a host may name once it knows better, and those that give way to them.
RECOGNISED, STALE = ("chatgpt_work_desktop", "codex_desktop", "codex_vscode", "codex_cli"), ("codex_cli", "codex_local")


def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def keyed_calls(calls: DataFrame) -> DataFrame:
    """Calls with a key of what was called, when and where; absent columns count as empty."""
    return calls.withColumn("call_key", F.sha2(F.concat_ws("\x1f", *[_text(c) if c in calls.columns else F.lit("") for c in _CALL]), 256))


def keyed_messages(messages: DataFrame) -> DataFrame:
    """Messages without a uuid get one of their time, type and content, so that they, too, come in once."""
    made = F.sha1(F.concat_ws("\x1f", *[_text(c) for c in ("ts_raw", "type", "content")]))
    return messages.withColumn("uuid", F.coalesce(F.nullif("uuid", F.lit("")), made))


def _conformed(rows: DataFrame, like: DataFrame, *extra: str) -> DataFrame:
    """The columns of `like`, null where `rows` has none."""
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in like.schema.fields], *extra)


def _fresh(existing: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The first row (by `at`) of each key that `existing` does not hold."""
    cells = F.struct(*[c for c in existing.columns if c not in keys])
    first = rows.groupBy(*keys).agg(F.min_by(cells, "at").alias("r")).select(*keys, "r.*").select(existing.columns)
    return first.join(existing.select(*keys), keys, "left_anti")


def _dimension(existing: DataFrame, names: DataFrame) -> DataFrame:
    """Rows of a dimension (id, name, last_seen) that are new or were seen later."""
    after = sessions.dimension(existing, names)
    old = existing.select("name", F.col("last_seen").alias("before"), F.lit(True).alias("here"))
    return after.join(old, "name", "left").filter(F.col("here").isNull() | ~F.col("last_seen").eqNullSafe(F.col("before"))).select(existing.columns)


def changes(existing: dict[str, DataFrame], package: DataFrame, host: str | None, user: str | None) -> dict[str, DataFrame]:
    """For each table of KEYS the rows that are new or differ. package: session_id, project (a name), client_source, other columns of
    sessions, and arrays messages, token_usage and tool_calls; nulls and empty arrays are nothing, rows without a session id
    and agents' logs that are no agents are left out; of several rows for one session their order of arrival (`at`, if there
    is such a column) decides."""
    if "at" not in package.columns:
        package = package.withColumn("at", F.monotonically_increasing_id())
    rows = sessions.without_phantoms(package.filter("coalesce(session_id, '') <> ''"))
    rows = written(rows.withColumns({"project": F.coalesce(F.nullif("project", F.lit("")), F.lit("unknown")), "host": F.coalesce(hostname(F.lit(host)), F.lit("unknown")), "user": F.coalesce(F.nullif(F.lit(user), F.lit("")), F.lit("unknown"))}), "package")

    out = {}
    for table, key, name in (("hosts", "host_id", "host"), ("users", "user_id", "user"), ("projects", "project_id", "project")):
        out[table] = written(_dimension(existing[table], rows.groupBy(F.col(name).alias("name")).agg(F.max("ts_raw").alias("seen"))), table)
        known = existing[table].join(out[table].select("name"), "name", "left_anti").select("id", "name").unionByName(out[table].select("id", "name"))
        rows = rows.join(known.select(F.col("id").alias(key), F.col("name").alias(name)), name)
    rows = written(rows, "translated")

    ids = ["session_id", "project_id", "user_id", "host_id"]

    def children(name: str) -> DataFrame:
        each = rows.select(*ids, "at", F.posexplode(name).alias("place", "r"))
        fields = [f for f in rows.schema[name].dataType.elementType.names if f not in ids]
        return each.select(*ids, F.struct("at", "place").alias("at"), *[F.col(f"r.{f}").alias(f) for f in fields])

    out["messages"] = written(_fresh(existing["messages"], _conformed(keyed_messages(children("messages")), existing["messages"], "at"), KEYS["messages"]), "messages")
    out["token_usage"] = written(_fresh(existing["token_usage"], _conformed(children("token_usage"), existing["token_usage"], "at"), KEYS["token_usage"]), "token_usage")

    calls = _conformed(children("tool_calls"), existing["tool_calls"].drop("call_key"), "at")
    derived = {"cmd_name": F.when(F.col("family") == "bash", commands.cmd_name(F.coalesce("command", F.lit("")))), "kind": F.when(F.col("family") == "mcp", tool_kind(F.col("session_id"), F.col("server_name"), F.col("name")))}
    calls = keyed_calls(calls.withColumns({c: v for c, v in derived.items() if c in calls.columns}))
    calls = written(calls.select(*existing["tool_calls"].columns, "at"), "calls")
    outcome = [c for c in OUTCOME if c in existing["tool_calls"].columns]
    seen = calls.groupBy("call_key").agg(*[F.min_by(c, F.when(F.col("is_error").isNotNull(), F.col("at"))).alias(c) for c in outcome])
    open_ = existing["tool_calls"].filter("is_error is null").join(seen.filter("is_error is not null").select("call_key"), "call_key", "left_semi")
    healed = merge.fill_only(open_.select(existing["tool_calls"].columns), seen, ["call_key"], outcome)
    out["tool_calls"] = written(_fresh(existing["tool_calls"], calls, ["call_key"]).unionByName(healed), "tool_calls")

    touched = out["messages"].select(*SESSION).union(out["token_usage"].select(*SESSION)).distinct()
    new = _fresh(existing["sessions"], _conformed(rows, existing["sessions"], "at"), SESSION)
    concerned = existing["sessions"].join(touched, SESSION, "left_semi").select(existing["sessions"].columns).unionByName(new)
    counts = existing["messages"].join(touched, SESSION, "left_semi").select(*SESSION).unionByName(out["messages"].select(*SESSION)).groupBy(*SESSION).agg(F.count("*").alias("counted"))
    tokens = F.col("input_tokens") + F.col("output_tokens") + F.col("cache_creation_tokens") + F.col("cache_read_tokens")
    spent = existing["token_usage"].join(touched, SESSION, "left_semi").select(*SESSION, tokens.alias("t")).unionByName(out["token_usage"].select(*SESSION, tokens.alias("t"))).groupBy(*SESSION).agg(F.sum("t").alias("spent"))
    recounted = concerned.join(touched.withColumn("touched", F.lit(True)), SESSION, "left").join(counts, SESSION, "left").join(spent, SESSION, "left")
    totals = {"message_count": F.coalesce("counted", F.lit(0)), "total_tokens": F.coalesce("spent", F.lit(0))}
    out["sessions"] = written(recounted.select([F.when(F.col("touched"), totals[c]).otherwise(F.col(c)).alias(c) if c in totals else F.col(c) for c in existing["sessions"].columns]), "sessions")

    named = _fresh(existing["session_sources"], _conformed(rows.withColumn("source", F.coalesce(F.nullif("client_source", F.lit("")), F.lit("unknown"))), existing["session_sources"], "at"), SESSION)
    better = rows.filter(F.col("client_source").isin(*RECOGNISED)).groupBy(*SESSION).agg(F.min_by("client_source", "at").alias("better"))
    stale = existing["session_sources"].filter(F.col("source").isin(*STALE)).join(better, SESSION).filter("source <> better")
    out["session_sources"] = named.unionByName(stale.withColumn("source", F.col("better")).select(existing["session_sources"].columns))

    # calls that were healed may be of other hosts, whose cursors stay
    theirs = rows.select("host_id").distinct()
    reached = [out[t].join(theirs, "host_id", "left_semi").groupBy("host_id").agg(F.max("ts_raw").alias("value")) for t in ("messages", "token_usage", "tool_calls")] + [rows.groupBy("host_id").agg(F.max("ts_raw").alias("value"))]
    cursor = reached[0].unionByName(reached[1]).unionByName(reached[2]).unionByName(reached[3]).groupBy("host_id").agg(F.max("value").alias("value")).filter("value is not null").select(F.lit("pull_cursor").alias("key"), "host_id", "value")
    ahead = cursor.join(existing["state"].select("key", "host_id", F.col("value").alias("before")), ["key", "host_id"], "left").filter("before is null or value > before")
    out["state"] = ahead.select(existing["state"].columns)
    return {t: out[t] for t in KEYS}


def merged(existing: dict[str, DataFrame], package: DataFrame, host: str | None, user: str | None) -> dict[str, DataFrame]:
    """The tables after the package."""
    new = changes(existing, package, host, user)
    return {t: existing[t].join(new[t].select(*k), k, "left_anti").select(existing[t].columns).unionByName(new[t]) for t, k in KEYS.items()}


def applied(folder: str, package: DataFrame, host: str | None, user: str | None, buckets: int = 64) -> dict[str, int]:
    """Merge a package into the tables below `folder` (made by `tables.create` with KEYS), the cursor last; returns how many buckets
    of each were rewritten."""
    spark = package.sparkSession
    existing = {t: tables.read(spark, f"{folder}/{t}") for t in KEYS}
    new = {t: written(rows, t) for t, rows in changes(existing, package, host, user).items()}
    return {t: tables.upsert(f"{folder}/{t}", new[t], k, buckets=buckets)["changed"] for t, k in KEYS.items()}
