"""Interval algebra by windows: islands of activity, unions of intervals, concurrency.

All work is partitioned by day (or whatever `by` names) and, within it, by slices of time, so that a busy day is not one task's."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GAP_US, CAP_US = 300 * 1_000_000, 600 * 1_000_000
#: Width of the slices of time in which a key's intervals are handled apart.
SLICE_US = 600 * 1_000_000


def islands(events: DataFrame, by: list[str], gap: int = GAP_US) -> DataFrame:
    """Runs of events of a key whose gaps are `gap` at most: by, start_us, end_us, events."""
    w = Window.partitionBy(*by).orderBy("us", "id")
    fresh = F.when(F.col("us") - F.lag("us").over(w) <= gap, 0).otherwise(1)
    numbered = events.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*by, "island").agg(F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.count("*").alias("events")).drop("island")


def reply_intervals(events: DataFrame, by: list[str], cap: int = CAP_US) -> DataFrame:
    """From each user message to the next assistant message of its key, at most `cap` long."""
    # backwards, so that the frame only grows and each event is looked at once
    w = Window.partitionBy(*by).orderBy(F.desc("us"), F.desc("id")).rowsBetween(Window.unboundedPreceding, -1)
    reply = F.last(F.when(F.col("type") == "assistant", F.col("us")), ignorenulls=True).over(w)
    found = events.withColumn("reply", reply).filter((F.col("type") == "user") & F.col("reply").isNotNull())
    return found.select(*by, F.col("us").alias("start_us"), F.least("reply", F.col("us") + cap).alias("end_us"))


def union(intervals: DataFrame, by: list[str]) -> DataFrame:
    """Overlapping and touching intervals of a key merged. Those that start in one slice of time are merged first, so that
    a key with very many intervals is not one task's; what is left of each slice is little."""
    parts = _merged(intervals.withColumn("slice", F.floor(F.col("start_us") / SLICE_US)), [*by, "slice"])
    return _merged(parts.drop("slice"), by)


def _merged(intervals: DataFrame, by: list[str]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy("start_us", "end_us")
    reach = F.max("end_us").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(F.col("start_us") <= F.col("reach"), 0).otherwise(1)
    numbered = intervals.withColumn("reach", reach).withColumn("fresh", fresh).withColumn("n", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*by, "n").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us")).drop("n")


def seconds(intervals: DataFrame, by: list[str], name: str) -> DataFrame:
    return union(intervals, by).groupBy(*by).agg(F.round(F.sum(F.col("end_us") - F.col("start_us")) / 1e6, 2).alias(name))


def concurrency(intervals: DataFrame, by: list[str]) -> DataFrame:
    """The curve of open intervals: us, delta and how many are open after it; starts come before ends at the same time."""
    edges = F.explode(F.array(F.struct(F.col("start_us").alias("us"), F.lit(1).alias("delta")), F.struct(F.col("end_us").alias("us"), F.lit(-1).alias("delta"))))
    steps = intervals.select(*by, edges.alias("e")).select(*by, "e.us", "e.delta").groupBy(*by, "us", "delta").agg(F.sum("delta").alias("change")).withColumn("slice", F.floor(F.col("us") / SLICE_US))
    # what is open when a slice of time begins, from the sums of the slices before it
    slices = steps.groupBy(*by, "slice").agg(F.sum("change").alias("total"))
    before = F.coalesce(F.sum("total").over(Window.partitionBy(*by).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    w = Window.partitionBy(*by, "slice").orderBy("us", F.desc("delta")).rowsBetween(Window.unboundedPreceding, 0)
    joined = steps.join(slices.withColumn("before", before).drop("total"), [*by, "slice"])
    return joined.withColumn("open", F.col("before") + F.sum("change").over(w)).drop("slice", "before")


def peak(intervals: DataFrame, by: list[str]) -> DataFrame:
    """The most intervals open at once, and when first."""
    return concurrency(intervals, by).groupBy(*by).agg(F.max("open").alias("peak"), F.min_by("us", F.struct(-F.col("open"), F.col("us"))).alias("peak_us"))


def day_report(events: DataFrame) -> DataFrame:
    """For each day: sessions, messages, active and assistant wall-clock seconds, and peak concurrency."""
    keys = ["day", "session_id"]
    active = islands(events, keys)
    base = events.groupBy("day").agg(F.count_distinct("session_id").alias("sessions"), F.count_if(F.col("type") == "user").alias("questions"), F.count("*").alias("events"))
    spans = events.groupBy(*keys).agg(F.min("us").alias("start_us"), F.max("us").alias("end_us"))
    out = base.join(seconds(active, ["day"], "active_seconds"), "day", "left").join(seconds(reply_intervals(events, keys), ["day"], "assistant_seconds"), "day", "left")
    return out.join(peak(spans, ["day"]), "day", "left").na.fill(0.0, ["assistant_seconds"])


def gantt(events: DataFrame) -> DataFrame:
    spans = events.groupBy("day", "session_id", "project_id").agg(F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.count("*").alias("events"))
    return spans.withColumn("duration_min", F.round((F.col("end_us") - F.col("start_us")) / 6e7, 2))


def day_projects(events: DataFrame, colours: int = 8) -> DataFrame:
    """Projects of a day by total time, each with a colour's number."""
    by = gantt(events).groupBy("day", "project_id").agg(F.count("*").alias("session_count"), F.round(F.sum("duration_min"), 2).alias("total_min"))
    return by.withColumn("colour", (F.row_number().over(Window.partitionBy("day").orderBy(F.desc("total_min"), "project_id")) - 1) % colours)
