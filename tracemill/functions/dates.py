"""Timestamps as text and back, independent of the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_OFFSET = r"(Z|[+-]\d{2}:?\d{2})$"


def _instant(text: Column, zone: str = "UTC") -> Column:
    """The instant of an ISO text; without an offset it is read in `zone`; null if it is no timestamp."""
    text = F.regexp_replace(F.trim(text), r"^(\d{4}-\d{2}-\d{2})$", "$1T00:00:00")
    aware = F.rlike(text, F.lit(_OFFSET))
    shape = F.rlike(text, F.lit(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})?$"))
    local = text.try_cast("timestamp_ntz")
    here = F.convert_timezone(F.lit(zone), F.current_timezone(), local).try_cast("timestamp")
    return F.when(shape, F.when(aware, text.try_cast("timestamp")).otherwise(here))


def iso(instant: Column) -> Column:
    """YYYY-MM-DDTHH:MM:SS.mmmZ, which sorts as time does up to the year 9999; later years have more digits, but no sign."""
    utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), instant.cast("timestamp_ntz"))
    return F.ltrim(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit("+"))


def since(text: Column) -> Column:
    """struct(text, epoch) of a lower bound of time: a day or an ISO timestamp; without an offset it is UTC."""
    at = _instant(text)
    return F.when(at.isNotNull(), F.struct(iso(at).alias("text"), (F.unix_millis(at) / 1000).alias("epoch")))


def event_time(text: Column) -> Column:
    """An event's instant; without an offset it is UTC."""
    return _instant(text)


def watermark_time(text: Column, zone: str) -> Column:
    """A stored watermark's instant; old ones have no offset and are in the local `zone`."""
    return _instant(text, zone)


def epoch_iso(epoch: Column) -> Column:
    """Seconds since 1970 as ISO text in UTC; empty for none or zero."""
    return F.coalesce(F.when(epoch != 0, iso(F.timestamp_millis((epoch * 1000).cast("long")))), F.lit(""))


def duration_minutes(first: Column, last: Column) -> Column:
    """Minutes between two timestamps of any fraction, by their seconds, to one digit; 0 if one is missing."""
    at = lambda c: F.unix_seconds(_instant(F.concat(F.substring(c, 1, 19), F.lit("Z"))))
    return F.coalesce(F.round((at(last) - at(first)) / 60, 1), F.lit(0.0))
