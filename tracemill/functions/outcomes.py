"""Outcome of tool calls: three-valued errors, an ordered error taxonomy, and the aggregates built on them.

`is_error` is 1 (failed), 0 (succeeded) or null (never measured); null is never counted as success."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Substrings of error texts, in the order in which they are tried, by class.
ERROR_MARKERS = (
    ("sibling", ("Sibling tool call errored", "Cancelled: parallel tool call")),
    ("denied", (
        "doesn't want to", "Permission to use", "Permission for this", "auto-denied", "was denied by the", "was blocked", "Blocked:",
        "requires approval", "require approval", "require explicit approval", "For security, Claude Code",
    )),
    ("interrupted", ("Tool permission request failed", "Request interrupted", "AbortError", "auto mode cannot determine")),
    ("rejected", ("InputValidationError", "Failed to parse command", "No such tool available")),
)
UNKNOWN, FAILED = "unknown", "failed"
NEVER_EXECUTED = tuple(c for c, _ in ERROR_MARKERS)


def error_class(is_error: Column, text: Column) -> Column:
    """Class of a failed call; null unless is_error is 1."""
    out = F.lit(FAILED)
    out = F.when(F.coalesce(text, F.lit("")) == "", UNKNOWN).otherwise(out)
    for name, markers in reversed(ERROR_MARKERS):
        out = F.when(reduce(Column.__or__, [F.contains(text, F.lit(m)) for m in markers]), name).otherwise(out)
    return F.when(is_error == 1, out)


def outcome_aggregates(is_error: str = "is_error") -> list[Column]:
    """errors, measured and error_rate (4 digits; null if nothing was measured)."""
    errors, measured = F.count_if(F.col(is_error) == 1), F.count(is_error)
    return [errors.alias("errors"), measured.alias("measured"), rate(errors, measured).alias("error_rate")]


def never_executed_aggregates() -> list[Column]:
    """Failed calls that never ran, and failed calls without a text to tell."""
    kind = error_class(F.col("is_error"), F.col("error_text"))
    return [F.count_if(kind.isin(*NEVER_EXECUTED)).alias("never_executed"), F.count_if(kind == UNKNOWN).alias("errors_unclassified")]


def rate(errors: Column, measured: Column) -> Column:
    return F.when(measured > 0, F.round(errors / measured, 4))


def real_error_rate() -> Column:
    """Errors among the calls that ran, over the columns errors, measured and never_executed."""
    ran = F.col("measured") - F.col("never_executed")
    return F.when(ran > 0, F.round((F.col("errors") - F.col("never_executed")) / ran, 4))


def clean_flag(raw: Column) -> Column:
    """A result's error flag as it was written: absent or falsey words are 0, all else is 1."""
    return F.when(raw.isNull() | F.lower(F.trim(raw)).isin("", "false", "0", "no", "none", "null"), 0).otherwise(1)


def exit_code(text: Column) -> Column:
    """The number behind `Exit code` at the very start of a text."""
    return F.regexp_extract(text, r"^\s*Exit code (\d+)", 1).try_cast("int")


def duration_ms(start: Column, end: Column) -> Column:
    """Milliseconds between two timestamps; null if either is missing, negative or over seven days."""
    ms = F.unix_millis(end) - F.unix_millis(start)
    return F.when(ms.between(0, 7 * 86_400_000), ms)
