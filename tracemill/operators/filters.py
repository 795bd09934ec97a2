"""The filter that all reports share: project, user, host, source and a range of days."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Filters:
    """Ids are compared for equality. `end` is compared as text, so that events within the last second of that day do not
    count (as in stored results); with `inclusive_end` the whole day does. A name that is not known selects nothing."""

    project_id: int | None = None
    user_id: int | None = None
    host_id: int | None = None
    start: str | None = None
    end: str | None = None
    source: str | None = None
    inclusive_end: bool = False


def apply_filters(df: DataFrame, filters: Filters, sources: DataFrame | None = None) -> DataFrame:
    for name in ("project_id", "user_id", "host_id"):
        if (value := getattr(filters, name)) is not None:
            df = df.filter(F.col(name) == value)
    if filters.start:
        df = df.filter(F.col("ts_raw") >= filters.start)
    if filters.end:
        df = df.filter(F.col("ts_raw") < F.lit(filters.end + "U") if filters.inclusive_end else F.col("ts_raw") <= filters.end + "T23:59:59")
    if filters.source:
        # an equality on the outer side turns the outer join into an inner one; as no column of it is kept, a semi join does
        df = df.join(sources.filter(F.col("source") == filters.source), ["session_id", "project_id"], "left_semi")
    return df


def ids_of(dimension: DataFrame, name: str) -> DataFrame:
    """Rows of a (id, name) dimension by name: none for an unknown name."""
    return dimension.filter(F.col("name") == name).select("id")


def like(column: str, needle: str):
    """Substring search that folds case; `%` and `_` in the needle are wildcards."""
    return F.col(column).ilike(f"%{needle}%")
