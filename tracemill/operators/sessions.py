"""The session table and what keeps it whole: aggregation, agents and their parents, sources, lists and details."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions.identity import is_agent_id
from tracemill.functions.text import json_blocks, smart_title, strip_system_tags

from .graph import descendants, top_level
from .pricing import priced

KEYS = ["session_id", "project_id"]
#: User messages of a session among which a title is looked for.
TITLE_SCAN = 10


def tools_used(calls: DataFrame) -> DataFrame:
    """session_id, project_id, tools_used: file tools, skills and types of agents, each once, sorted."""
    name = F.when(F.col("family") == "file", F.col("tool")).when(F.col("family") == "skill", F.col("skill_name")).when(F.col("family") == "subagent", F.col("subagent_type"))
    some = calls.select(*KEYS, name.alias("name")).filter("name <> ''").distinct()
    return some.groupBy(*KEYS).agg(F.array_sort(F.collect_list("name")).alias("tools_used"))


def displays(messages: DataFrame) -> DataFrame:
    """session_id, project_id, display: the first words of a user that are more than wrappers, among the first TITLE_SCAN
    messages; else the first words at all."""
    first = F.row_number().over(Window.partitionBy(*KEYS).orderBy("ts_raw", "seq"))
    users = messages.filter("type = 'user'").withColumn("place", first).filter(F.col("place") <= TITLE_SCAN)
    words = users.select(*KEYS, "place", F.posexplode(F.filter(json_blocks(F.col("content")), lambda b: b["type"] == "text")).alias("at", "block")).select(*KEYS, "place", "at", F.col("block.text").alias("raw")).filter("raw <> ''")
    words = words.withColumn("clean", strip_system_tags(F.col("raw")))
    order = F.struct("place", "at")
    return words.groupBy(*KEYS).agg(F.coalesce(F.min_by(F.when(F.col("clean") != "", F.col("clean")), F.when(F.col("clean") != "", order)), F.min_by("raw", order)).alias("display"))


def aggregated(messages: DataFrame, usage: DataFrame, calls: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """One row for each session that has a message: times, counts, tokens (of usage with its caches; of messages where no
    usage was recorded), model, display, summary (a given title, else made of the display) and tools."""
    base = messages.groupBy(*KEYS).agg(F.min("ts_raw").alias("ts_raw"), F.count("*").alias("message_count"), F.sum(F.col("tokens_in") + F.col("tokens_out")).alias("own_tokens"), F.max("model").alias("own_model"))
    spent = usage.groupBy(*KEYS).agg(F.sum(F.col("input_tokens") + F.col("output_tokens") + F.col("cache_creation_tokens") + F.col("cache_read_tokens")).alias("used_tokens"), F.max("model").alias("used_model"))
    out = base.join(spent, KEYS, "left").join(displays(messages), KEYS, "left").join(tools_used(calls), KEYS, "left")
    title = F.lit(None).cast("string")
    if titles is not None:
        out, title = out.join(titles.select(*KEYS, F.col("title").alias("given")), KEYS, "left"), F.nullif("given", F.lit(""))
    return out.select(
        *KEYS, "ts_raw", "message_count", F.coalesce("used_tokens", "own_tokens", F.lit(0)).alias("total_tokens"), F.coalesce(F.nullif("own_model", F.lit("")), "used_model").alias("model"), F.substring(F.coalesce("display", F.lit("")), 1, 200).alias("display"),
        F.coalesce(title, F.when(F.coalesce("display", F.lit("")) != "", smart_title(F.col("display")))).alias("summary"), F.coalesce("tools_used", F.array().cast("array<string>")).alias("tools_used"),
    )


def without_phantoms(rows: DataFrame) -> DataFrame:
    """Rows of all sessions but those of agents' logs that are no agents (compactions, suggestions)."""
    return rows.filter(~F.contains("session_id", F.lit("::agent-")) | is_agent_id(F.substring_index("session_id", "::agent-", -1)))


def healed(sessions: DataFrame, messages: DataFrame, usage: DataFrame) -> DataFrame:
    """Sessions that took on an agent's identity of their own child lose it, and are counted anew from what is theirs."""
    child = sessions.select(F.col("project_id"), F.col("parent_session_id").alias("session_id"), "agent_id").filter("agent_id is not null").distinct().withColumn("husk", F.lit(True))
    counts = messages.groupBy(*KEYS).agg(F.count("*").alias("counted"))
    spent = usage.groupBy(*KEYS).agg(F.sum(F.col("input_tokens") + F.col("output_tokens") + F.col("cache_creation_tokens") + F.col("cache_read_tokens")).alias("spent"))
    out = sessions.join(child, ["project_id", "session_id", "agent_id"], "left").join(counts, KEYS, "left").join(spent, KEYS, "left")
    husk = F.coalesce("husk", F.lit(False)) & ~F.contains("session_id", F.lit("::agent-"))
    changed = {"agent_id": F.lit(None), "parent_session_id": F.lit(None), "message_count": F.coalesce("counted", F.lit(0)), "total_tokens": F.coalesce("spent", F.lit(0))}
    return out.select([F.when(husk, changed[c]).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in sessions.columns])


def mentioned_parents(messages: DataFrame) -> DataFrame:
    """project_id, agent_id, parent: of the sessions whose messages name an agent's log, the one of the first message."""
    found = messages.select("project_id", "session_id", "seq", "ts_raw", F.explode(F.regexp_extract_all("content", F.lit(r"agent-([a-f0-9]+)\.jsonl"), F.lit(1))).alias("agent_id"))
    return found.groupBy("project_id", "agent_id").agg(F.min_by("session_id", F.struct("ts_raw", "session_id", "seq")).alias("parent"))


def with_parents(sessions: DataFrame, parents: DataFrame) -> DataFrame:
    """Sessions of agents without a parent (or with themselves as parent) get the one that was found."""
    open_ = F.col("parent_session_id").isNull() | (F.col("parent_session_id") == F.col("session_id"))
    joined = sessions.join(parents.select("project_id", "agent_id", "parent"), ["project_id", "agent_id"], "left")
    return joined.select([F.when(open_, F.coalesce("parent", "parent_session_id")).otherwise(F.col(c)).alias(c) if c == "parent_session_id" else F.col(c) for c in sessions.columns])


def dimension(existing: DataFrame, names: DataFrame) -> DataFrame:
    """id, name, last_seen of a dimension after new sightings (name, seen): ids are hashes of names, so that tasks need no
    common counter; existing ids stay."""
    new = names.filter("name <> ''").groupBy("name").agg(F.max("seen").alias("seen"))
    both = existing.join(new, "name", "full_outer")
    return both.select(F.coalesce("id", F.xxhash64("name")).alias("id"), "name", F.greatest("last_seen", "seen").alias("last_seen"))


def upsert_sources(existing: DataFrame, new: DataFrame, override: tuple[str, ...] = ()) -> DataFrame:
    """Sources of sessions (keys, source, client_version, meta_json): what is known stays, gaps are filled by the first
    arrival (`at`); a source in `override` gives way to another one, with its meta."""
    first = lambda c: F.min_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col("at")))
    fresh = new.filter("source <> ''").groupBy(*KEYS).agg(first("source").alias("n_source"), first("client_version").alias("n_version"), first("meta_json").alias("n_meta"))
    both = existing.join(fresh, KEYS, "full_outer")
    stale = F.col("source").isin(*override) & (F.col("n_source") != F.col("source")) if override else F.lit(False)
    kept = lambda old, n: F.coalesce(F.nullif(F.col(old), F.lit("")), F.col(n))
    return both.select(*KEYS, F.when(stale, F.col("n_source")).otherwise(kept("source", "n_source")).alias("source"), kept("client_version", "n_version").alias("client_version"), F.when(stale, F.coalesce("n_meta", "meta_json")).otherwise(F.coalesce("meta_json", "n_meta")).alias("meta_json"))


def stamped_workflows(spawns: DataFrame, found: DataFrame) -> DataFrame:
    """Spawn rows with the workflow that their result announced; only where none is known."""
    new = found.filter("workflow_id <> '' and tool_call_id <> ''").groupBy(*KEYS, "tool_call_id").agg(F.min("workflow_id").alias("announced"))
    joined = spawns.join(new, [*KEYS, "tool_call_id"], "left")
    return joined.select([F.coalesce(F.nullif("workflow_id", F.lit("")), "announced", F.lit("")).alias(c) if c == "workflow_id" else F.col(c) for c in spawns.columns])


# lists and details


def starred(sessions: DataFrame, sources: DataFrame, metadata: DataFrame, projects: DataFrame, users: DataFrame, hosts: DataFrame) -> DataFrame:
    """Sessions with the names of what they refer to; unknown ones are null, an unknown source is `unknown`."""
    out = sessions.join(sources.select(*KEYS, F.col("source").alias("known_source")), KEYS, "left")
    out = out.join(metadata.select(*KEYS, F.col("classification").alias("meta_classification"), F.col("data_sensitivity").alias("meta_sensitivity")), KEYS, "left")
    for dim, key, name in ((projects, "project_id", "project_name"), (users, "user_id", "username"), (hosts, "host_id", "hostname")):
        out = out.join(dim.select(F.col("id").alias(key), F.col("name").alias(name)), key, "left")
    return out.withColumn("client_source", F.coalesce("known_source", F.lit("unknown"))).drop("known_source")


def is_id(search: str) -> bool:
    """Whether a search looks like the beginning of a session's id."""
    import re

    return re.match(r"^[0-9a-f]{8}-[0-9a-f]{4}-", search, re.IGNORECASE) is not None


def matching(sessions: DataFrame, found: DataFrame, grouped: bool) -> DataFrame:
    """Sessions that are in `found` (session_id), or, grouped, that have a child there."""
    ids = found.select("session_id").distinct()
    if grouped:
        up = sessions.filter("parent_session_id is not null").join(ids, "session_id", "left_semi").select(F.col("parent_session_id").alias("session_id"))
        ids = ids.union(up).distinct()
    return sessions.join(ids, "session_id", "left_semi")


def with_metadata(sessions: DataFrame, metadata: DataFrame, classification: str | None = None, sensitivity: str | None = None) -> DataFrame:
    """Sessions whose metadata has the given values; those without metadata match none."""
    wanted = metadata
    if classification:
        wanted = wanted.filter(F.col("classification") == classification)
    if sensitivity:
        wanted = wanted.filter(F.col("data_sensitivity") == sensitivity)
    return sessions.join(wanted.select(*KEYS).distinct(), KEYS, "left_semi") if classification or sensitivity else sessions


def listed(sessions: DataFrame, usage: DataFrame, prices: DataFrame, grouped: bool = True) -> DataFrame:
    """Sessions with their cost; grouped: masters only, with the number, tokens and cost of all that hangs below them."""
    cost = priced(usage, prices).groupBy(*KEYS).agg(F.round(F.sum("cost"), 4).alias("cost_usd"))
    rows = sessions.join(cost, KEYS, "left").withColumn("cost_usd", F.coalesce("cost_usd", F.lit(0.0)))
    if not grouped:
        return rows.withColumn("derived_count", F.lit(0).cast("long"))
    masters = top_level(rows)
    below = descendants(sessions, masters).join(rows.select(*KEYS, "total_tokens", "cost_usd"), KEYS)
    sums = below.groupBy(F.col("master").alias("session_id")).agg(F.count("*").alias("derived"), F.sum("total_tokens").alias("t"), F.sum("cost_usd").alias("c"))
    out = masters.join(sums, "session_id", "left")
    changed = {"total_tokens": F.col("total_tokens") + F.coalesce("t", F.lit(0)), "cost_usd": F.round(F.col("cost_usd") + F.coalesce("c", F.lit(0.0)), 4)}
    return out.select([changed[c].alias(c) if c in changed else F.col(c) for c in rows.columns] + [F.coalesce("derived", F.lit(0)).alias("derived_count")])


def page(rows: DataFrame, limit: int, offset: int, *order: Column) -> tuple[DataFrame, int]:
    """A page of rows and how many there are in all."""
    return rows.orderBy(*order).offset(offset).limit(limit), rows.count()


def truncated(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """The first n rows, each with whether there are more: one row beyond tells."""
    head = df.orderBy(*order).limit(n + 1)
    return head.orderBy(*order).limit(n).withColumn("truncated", F.lit(head.count() > n))
