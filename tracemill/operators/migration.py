"""Replacing sessions by what a new reading of their logs gives, only where nothing would be lost."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SESSION = ["session_id"]
#: Share of a session's old rows that the new reading must hold.
COVERED = 0.95


def coverage(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """session_id, old_rows and missing: how many distinct keys of a session's old rows the new reading lacks. Nulls in keys count
    as equal."""
    cells = [F.struct(*keys).alias("cell")]
    had, has = (df.select("session_id", *cells).distinct() for df in (old, new))
    lost = had.join(has.withColumn("found", F.lit(True)), (had["session_id"] == has["session_id"]) & had["cell"].eqNullSafe(has["cell"]), "left").select(had["session_id"], "found")
    return lost.groupBy("session_id").agg(F.count("*").alias("old_rows"), F.count_if(F.col("found").isNull()).alias("missing"))


def plan(existing: dict[str, DataFrame], reparsed: dict[str, DataFrame], keys: dict[str, list[str]], in_scope: Column, covered: float = COVERED) -> DataFrame:
    """session_id, old_rows, missing, swap: the sessions of the scope that have rows in any table of `keys`; `swap` where the new
    reading holds at least the share `covered` of their rows, over all tables."""
    parts = [coverage(existing[t].filter(in_scope), reparsed[t].filter(in_scope), k) for t, k in keys.items()]
    total = reduce(DataFrame.unionByName, parts).groupBy("session_id").agg(F.sum("old_rows").alias("old_rows"), F.sum("missing").alias("missing"))
    return total.withColumn("swap", F.col("old_rows") - F.col("missing") >= F.col("old_rows") * covered)


def guarded_swap(existing: dict[str, DataFrame], reparsed: dict[str, DataFrame], keys: dict[str, list[str]], in_scope: Column, covered: float = COVERED) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables after the swap, and the plan. Sessions of the scope that are covered, or that are new, come from the new
    reading; the others, and all outside the scope, stay as they are. `existing` and `reparsed` hold the same tables; each has
    a session_id; `keys` names the tables that count and what identifies their rows within a session. Doing it again with the
    same reading changes nothing."""
    decided = plan(existing, reparsed, keys, in_scope, covered)
    gone = decided.filter("swap").select("session_id")
    held = decided.filter("not swap").select("session_id")
    out = {}
    for t, old in existing.items():
        fresh = reparsed[t].filter(in_scope).join(held, SESSION, "left_anti").select(old.columns)
        out[t] = old.join(gone, SESSION, "left_anti").select(old.columns).unionByName(fresh) if t in keys else _with_rows(old, fresh, gone)
    return out, decided


def _with_rows(old: DataFrame, fresh: DataFrame, gone: DataFrame) -> DataFrame:
    """Tables that do not count towards the coverage: sessions that are swapped or new take the new rows, old ones go."""
    replaced = gone.union(fresh.select("session_id")).distinct()
    return old.join(replaced, SESSION, "left_anti").select(old.columns).unionByName(fresh)
