"""Pairing results with the calls they answer, in the order of a queue.

A result goes to the oldest open call of its key; one that finds none open is an orphan. Nothing is queued here: with u calls
and r results seen so far, u - r falls below its least value so far exactly at an orphan, so the least value counts the
orphans; the n-th result that is no orphan answers the n-th call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import running


def _numbered(events: DataFrame, keys: list[str], order: list[Column], is_use: Column) -> DataFrame:
    """Events with `uses` and `results` seen so far, and `floor`: minus the orphans among them."""
    flagged = events.withColumns({"use": F.when(is_use, 1).otherwise(0).cast("long"), "balance": F.when(is_use, 1).otherwise(-1).cast("long")})
    first = running(flagged, keys, order, "place", sums={"uses": "use", "level": "balance"})
    return running(first, keys, [F.col("place")], "again", mins={"lowest": "level"}).withColumn("floor", F.least("lowest", F.lit(0))).drop("again", "lowest", "balance")


def fifo_paired(events: DataFrame, keys: list[str], order: list[Column], is_use: Column, outcome: list[str]) -> DataFrame:
    """The calls of `events` with the `outcome` columns of the results that answer them, prefixed by `result_`, and `answered`.

    `is_use` tells calls from results; of rows that tie in `order` any may come first; null keys are a key of their own; calls
    without a result are kept with nulls. A key of any number of rows is spread over tasks."""
    n = _numbered(events, keys, order, F.coalesce(is_use, F.lit(False)))
    uses = n.filter("use = 1").withColumn("nth", F.col("uses")).select(*events.columns, "nth")
    w = n.filter("use = 0").withColumn("seen", F.col("uses") - F.col("level"))
    # an orphan is where the floor falls: its number among those answered is that of the result before it
    fell = (F.col("level") == F.col("floor")) & (F.col("level") < 0)
    at_floor = w.groupBy(*keys, "floor").agg(F.min(F.when(fell, F.col("place"))).alias("orphan_place"))
    r, o = w.alias("r"), at_floor.alias("o")
    same = (F.col("r.floor") == F.col("o.floor")) & (F.col("r.place") == F.col("o.orphan_place"))
    for k in keys:
        same = same & F.col(f"r.{k}").eqNullSafe(F.col(f"o.{k}"))
    answers = r.join(o, same, "left_anti").select(*[F.col(k).alias(f"_{k}") for k in keys], (F.col("seen") + F.col("floor")).alias("_nth"), *[F.col(c).alias(f"result_{c}") for c in outcome])
    on = F.col("nth") == F.col("_nth")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return uses.join(answers, on, "left").withColumn("answered", F.col("_nth").isNotNull()).drop("nth", "_nth", *[f"_{k}" for k in keys])


def orphans(events: DataFrame, keys: list[str], order: list[Column], is_use: Column) -> DataFrame:
    """keys, uses, results and orphans (results that found no open call)."""
    n = _numbered(events, keys, order, F.coalesce(is_use, F.lit(False)))
    return n.groupBy(*keys).agg(F.max("uses").alias("uses"), (F.count("*") - F.max("uses")).alias("results"), (-F.min("floor")).alias("orphans"))
