"""Session trees: masters, roll-up of descendants, nearest preceding parent."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Frontiers of a walk that are kept apart before they are put together.
FRONTIERS = 16


def top_level(sessions: DataFrame) -> DataFrame:
    """Sessions without a parent, with themselves as parent, or whose parent does not exist in any project."""
    known = sessions.select(F.col("session_id").alias("parent_known")).distinct()
    joined = sessions.join(known, F.col("parent_session_id") == F.col("parent_known"), "left")
    return joined.filter(F.col("parent_session_id").isNull() | (F.col("parent_session_id") == F.col("session_id")) | F.col("parent_known").isNull()).drop("parent_known")


def children(sessions: DataFrame, session_id: str) -> DataFrame:
    return sessions.filter(F.col("parent_session_id") == session_id).orderBy("ts_raw", "session_id")


def descendants(sessions: DataFrame, masters: DataFrame) -> DataFrame:
    """(master, session_id, project_id, depth): all sessions below the masters at any depth, each counted once for a master.
    Sessions that reach each other in a circle end where they come back; parents are looked up in all projects.

    A round joins the frontier with the children and takes off what was found before; each frontier is written to the shared
    checkpoint folder, so that lineage and recovery stay short."""
    from .storage import checkpointed

    edges = sessions.filter("parent_session_id is not null and parent_session_id <> session_id").select(F.col("parent_session_id").alias("up"), "session_id", "project_id")
    first = masters.select(F.col("session_id").alias("master"), "session_id", F.col("project_id").cast("long").alias("project_id"), F.lit(0).alias("depth"))
    frontier, found, depth = first, [], 0
    while True:
        depth += 1
        step = frontier.select("master", F.col("session_id").alias("up")).join(edges, "up").select("master", "session_id", F.col("project_id").cast("long").alias("project_id"), F.lit(depth).alias("depth")).distinct()
        for old in (first, *found):
            step = step.join(old, ["master", "session_id", "project_id"], "left_anti")
        frontier = checkpointed(step)
        if frontier.isEmpty():
            return reduce(DataFrame.unionByName, found) if found else frontier
        found.append(frontier)
        if len(found) == FRONTIERS:
            # rows are rewritten once in so many rounds, not in each
            found = [checkpointed(reduce(DataFrame.unionByName, found))]


def rolled_up(sessions: DataFrame, value: str) -> DataFrame:
    """Masters with the number of their descendants and `value` summed over the tree."""
    masters = top_level(sessions)
    below = descendants(sessions, masters).join(sessions.select("session_id", "project_id", value), ["session_id", "project_id"])
    sums = below.groupBy("master").agg(F.count("*").alias("derived_count"), F.sum(value).alias("below"))
    out = masters.join(sums, masters.session_id == sums.master, "left")
    return out.select("session_id", "project_id", F.coalesce("derived_count", F.lit(0)).alias("derived_count"), (F.col(value) + F.coalesce("below", F.lit(0))).alias(f"{value}_rolled"))


def nearest_before(events: DataFrame, calls: DataFrame, within_us: int = 120_000_000, event: str = "event_id", call: str = "call_id", key: str = "user_id") -> DataFrame:
    """As-of join: each event with the nearest call of its key at most `within_us` before it (ties: the first call) that is
    not of its own session.

    Both sides are dealt into slices of time of that width; an event looks into its own and the one before, so that the join
    is an equi-join on (key, slice) however long the history is."""
    slot = lambda c: F.floor(F.col(c) / within_us)
    left = events.select(event, key, F.col("session_id"), "us", F.explode(F.array(slot("us"), slot("us") - 1)).alias("slot"))
    right = calls.select(F.col(call), F.col(key), F.col("session_id").alias("call_session"), F.col("us").alias("call_us"), slot("us").alias("slot"))
    near = left.join(right, [key, "slot"]).filter((F.col("us") - F.col("call_us")).between(0, within_us - 1) & (F.col("session_id") != F.col("call_session")))
    best = near.groupBy(event).agg(F.min(F.struct((F.col("us") - F.col("call_us")).alias("gap"), call, "call_session")).alias("best"))
    return best.select(event, F.col(f"best.{call}").alias(call), F.col("best.call_session").alias("parent"), F.col("best.gap").alias("gap_us"))


def paged(sessions: DataFrame, limit: int, offset: int, *order) -> DataFrame:
    if limit < 0 or offset < 0:
        raise ValueError("limit and offset are not negative")
    return sessions.orderBy(*order).offset(offset).limit(limit)


def ranked(df: DataFrame, n: int, by: list[str], *order) -> DataFrame:
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("place") <= n)
