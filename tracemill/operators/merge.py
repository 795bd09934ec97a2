"""Keyed merges of new rows into a table, as joins; each returns the new content of the table.

Keys compare null-safely only where said so: a row with a null in a key never conflicts with another, and is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _first(df: DataFrame, keys: list[str], *order) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    complete = F.lit(True)
    for k in keys:
        complete = complete & F.col(k).isNotNull()
    return df.withColumn("__n", F.row_number().over(w)).filter((F.col("__n") == 1) | ~complete).drop("__n")


def keep_first(existing: DataFrame, new: DataFrame, keys: list[str], *order) -> DataFrame:
    """Insert or ignore."""
    return existing.unionByName(_first(new, keys, *order).join(existing.select(*keys), keys, "left_anti"))


def keep_last(existing: DataFrame, new: DataFrame, keys: list[str], *order) -> DataFrame:
    """Insert or replace; `order` ranks the new rows of a key, the last one stays (descending expressions come first)."""
    fresh = _first(new, keys, *order)
    return existing.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh)


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], preserve: tuple[str, ...] = ()) -> DataFrame:
    """Insert, or update all columns but those in `preserve` (kept from the existing row)."""
    e, n = existing.alias("e"), new.alias("n")
    on = [F.col(f"e.{k}") == F.col(f"n.{k}") for k in keys]
    joined = e.join(n.withColumn("__new", F.lit(1)), on, "full_outer")
    fresh = F.col("__new").isNotNull()
    columns = [F.when(fresh, F.coalesce(F.col(f"e.{c}"), F.col(f"n.{c}")) if c in preserve else F.col(f"n.{c}")).otherwise(F.col(f"e.{c}")).alias(c) for c in existing.columns]
    return joined.select(columns)


def fill_only(existing: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Existing values stand; nulls take the new row's values."""
    n = new.select(*keys, *[F.col(c).alias(f"__{c}") for c in columns])
    joined = existing.join(n, keys, "left")
    return joined.select([F.coalesce(F.col(c), F.col(f"__{c}")).alias(c) if c in columns else F.col(c) for c in existing.columns])


def delete_scope(existing: DataFrame, scope: DataFrame, keys: list[str]) -> DataFrame:
    return existing.join(scope.select(*keys).distinct(), keys, "left_anti")


def attach_outcomes(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Tool calls with the outcome of their last result, whatever the order in which they arrived; calls without a result
    keep null outcomes. results: session_id, project_id, tool_call_id, seq, is_error, error_text, exit_code, ts."""
    last = results.groupBy("session_id", "project_id", "tool_call_id").agg(F.max_by(F.struct("is_error", "error_text", "exit_code", "ts"), "seq").alias("r"))
    return calls.join(last, ["session_id", "project_id", "tool_call_id"], "left").select(calls["*"], F.col("r.is_error").alias("is_error"), F.when(F.col("r.is_error") == 1, F.substring("r.error_text", 1, 2000)).alias("error_text"), F.col("r.exit_code").alias("exit_code"), F.col("r.ts").alias("result_ts"))


def paired_by_rank(uses: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """The k-th result of a key belongs to its k-th use."""
    w = Window.partitionBy(*keys).orderBy("seq")
    a = uses.withColumn("k", F.row_number().over(w))
    b = results.withColumn("k", F.row_number().over(w)).select(*keys, "k", F.col("seq").alias("result_seq"))
    return a.join(b, [*keys, "k"], "left")


def export_package(sessions: DataFrame, children: dict[str, DataFrame], since: str, limit: int = 1000) -> DataFrame:
    """Sessions with activity after `since`, oldest first, each with its newer child rows as arrays."""
    keys = ["session_id", "project_id"]
    newest = children["messages"].groupBy(*keys).agg(F.max("ts_raw").alias("active_at"))
    out = sessions.join(newest, keys, "left").withColumn("active_at", F.coalesce("active_at", "ts_raw")).filter(F.col("active_at") > since).orderBy("active_at", *keys).limit(limit)
    for name, rows in children.items():
        fresh = rows.filter(F.col("ts_raw") > since).join(out.select(*keys), keys, "left_semi")
        out = out.join(fresh.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ts_raw", *[c for c in rows.columns if c not in (*keys, "ts_raw")]))).alias(name)), keys, "left")
    return out


def advance(state: DataFrame, seen: DataFrame, keys: list[str], force: bool = False) -> DataFrame:
    """Watermarks (keys, value) that only move forward, unless forced."""
    both = state.withColumn("__old", F.lit(0)).unionByName(seen.withColumn("__old", F.lit(1)))
    value = F.max_by("value", "__old") if force else F.max("value")
    return both.groupBy(*keys).agg(value.alias("value"))


def counter_deltas(events: DataFrame, by: list[str]) -> DataFrame:
    """Increments of a running total; a total that falls has begun anew; increments of nothing are dropped."""
    w = Window.partitionBy(*by).orderBy("seq")
    step = F.col("total") - F.coalesce(F.lag("total").over(w), F.lit(0))
    return events.withColumn("delta", F.when(step < 0, F.col("total")).otherwise(step)).filter("delta > 0")


def first_credit(blocks: DataFrame) -> DataFrame:
    """Only the first block of an API message that carries tokens keeps them."""
    w = Window.partitionBy("session_id", "project_id", "api_message_id").orderBy((F.col("tokens") > 0).cast("int").desc(), "seq")
    first = (F.row_number().over(w) == 1) | F.col("api_message_id").isNull()
    return blocks.withColumn("tokens", F.when(first, F.col("tokens")).otherwise(0))


def filled_forward(lines: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})
