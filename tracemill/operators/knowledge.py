"""The knowledge base as a table of points (session_id, payload columns), and classification as data work: which sessions,
what is read of them, what becomes of a reply. The model that replies is a column function of the caller's."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .merge import upsert

KEYS = ["session_id", "project_id"]
# Classes of sessions and levels of sensitivity, with what unknown ones become.
CLASSIFICATIONS = ("development", "meeting", "analysis", "brainstorm", "support", "learning", "content_production", "marketing")
SENSITIVITIES = ("public", "internal", "confidential", "restricted")
DEFAULT_CLASS, DEFAULT_SENSITIVITY, MOST_TOPICS = "development", "internal", 5
_LISTS = ("topics", "people", "clients", "sensitive_data_types")


def sanitized(rows: DataFrame) -> DataFrame:
    """Classifier results with valid values: unknown classes and levels become the defaults, at most five topics, and who
    names people is not public."""
    lists = {c: F.coalesce(c, F.array().cast("array<string>")) for c in _LISTS if c in rows.columns}
    level = F.when(F.col("data_sensitivity").isin(*SENSITIVITIES), F.col("data_sensitivity")).otherwise(DEFAULT_SENSITIVITY)
    named = F.size(lists.get("people", F.array())) > 0
    return rows.withColumns({**lists, "classification": F.when(F.col("classification").isin(*CLASSIFICATIONS), F.col("classification")).otherwise(DEFAULT_CLASS), "data_sensitivity": F.when(named & (level == "public"), DEFAULT_SENSITIVITY).otherwise(level), "topics": F.slice(lists["topics"], 1, MOST_TOPICS)})


def candidates(sessions: DataFrame, metadata: DataFrame, full: bool = False, meta_since: str = "", meta_model: str = "", min_messages: int = 0, since: str = "", host: str = "", limit: int = 0) -> DataFrame:
    """Sessions to classify, the newest first: those without metadata; all with `full`; or, to classify again, those whose
    metadata are as new as `meta_since` or by a model like `meta_model`. `host`: part of a name."""
    out = sessions
    if meta_since or meta_model:
        wanted = metadata
        if meta_since:
            wanted = wanted.filter(F.col("updated_at") >= meta_since)
        if meta_model:
            wanted = wanted.filter(F.col("model_used").ilike(meta_model))
        out = out.join(wanted.select(*KEYS).distinct(), KEYS, "left_semi")
    elif not full:
        out = out.join(metadata.select(*KEYS), KEYS, "left_anti")
    if min_messages:
        out = out.filter(F.col("message_count") >= min_messages)
    if since:
        out = out.filter(F.col("ts_raw") >= since)
    if host:
        out = out.filter(F.col("hostname").ilike(f"%{host}%"))
    return out.orderBy(F.desc("ts_raw"), *KEYS).limit(limit) if limit else out


def classified(texts: DataFrame, classify: Callable[[Column], Column]) -> DataFrame:
    """Sanitized results of `classify` (text to a struct of the result's columns) for rows (keys, text)."""
    return sanitized(texts.select(*[c for c in texts.columns if c != "text"], classify(F.col("text")).alias("r")).select("*", "r.*").drop("r"))


def upserted(metadata: DataFrame, results: DataFrame) -> DataFrame:
    """Metadata with new results; when a row was made stays."""
    return upsert(metadata, results, KEYS, preserve=("created_at",))


# points of the knowledge base


def payloads(sessions: DataFrame, metadata: DataFrame, tools: DataFrame, points: DataFrame | None = None) -> DataFrame:
    """What the base keeps of each session: valid metadata, tools without their server, the tags that were given by hand."""
    meta = sanitized(metadata.select("session_id", "classification", "data_sensitivity", "topics"))
    used = tools.groupBy("session_id").agg(F.array_sort(F.collect_set(F.element_at(F.split("tool", "__"), -1))).alias("tools_used"))
    out = sessions.select("session_id", "ts_raw", "message_count").join(meta, "session_id", "left").join(used, "session_id", "left")
    tags = F.array().cast("array<string>")
    if points is not None:
        out = out.join(points.select("session_id", F.col("tags").alias("kept")), "session_id", "left")
        tags = F.coalesce("kept", tags)
    empty = F.array().cast("array<string>")
    return out.select("session_id", "ts_raw", "message_count", F.coalesce("classification", F.lit(DEFAULT_CLASS)).alias("classification"), F.coalesce("data_sensitivity", F.lit(DEFAULT_SENSITIVITY)).alias("data_sensitivity"), F.coalesce("topics", empty).alias("topics"), F.coalesce("tools_used", empty).alias("tools_used"), tags.alias("tags"))


def put(points: DataFrame, new: DataFrame) -> DataFrame:
    return upsert(points, new, ["session_id"])


def removed(points: DataFrame, sessions: DataFrame) -> DataFrame:
    return points.join(sessions.select("session_id"), "session_id", "left_anti")


def retagged(points: DataFrame, tags: DataFrame) -> DataFrame:
    """Points with new tags (session_id, tags); all else stays."""
    joined = points.join(tags.select("session_id", F.col("tags").alias("new")), "session_id", "left")
    return joined.select([F.coalesce("new", "tags").alias(c) if c == "tags" else F.col(c) for c in points.columns])


def not_indexed(sessions: DataFrame, points: DataFrame) -> DataFrame:
    return sessions.join(points.select("session_id"), "session_id", "left_anti")


def tag_counts(points: DataFrame) -> DataFrame:
    return points.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("count"))


def where(points: DataFrame, **equal: str | list[str]) -> DataFrame:
    """Points whose columns hold the given values: equal, one of a list, or, for array columns, any of them."""
    arrays = {n for n, t in points.dtypes if t.startswith("array")}
    for name, value in equal.items():
        values = value if isinstance(value, list) else [value]
        points = points.filter(F.arrays_overlap(name, F.array(*map(F.lit, values))) if name in arrays else F.col(name).isin(*values))
    return points
