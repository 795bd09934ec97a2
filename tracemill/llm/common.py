"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.operators.storage import shared_folder

#: Rows and bytes of texts that a Python worker is given at once.
TEXT_ROWS, TEXT_BYTES = 1000, 4 << 20
#: Bytes that separate words: space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and read it from there, so that a lost executor costs only its running tasks."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def small_batches(spark: SparkSession) -> None:
    """From now on the session hands rows to Python in batches of at most TEXT_ROWS and TEXT_BYTES, unless it has smaller ones:
    whole texts in Spark's batches of 10,000 rows and 64 MB are held several times over, in Arrow's buffers on both sides, as
    Python strings and as what they become. Results do not depend on it."""
    for name, most in (("maxRecordsPerBatch", TEXT_ROWS), ("maxBytesPerBatch", TEXT_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = int(re.sub(r"\D", "", said)) if not (said := spark.conf.get(key)).startswith("-") else 0
        plain = name == "maxRecordsPerBatch" or re.fullmatch(r"\d+b?", said)
        if now <= 0 or not plain or now > most:
            spark.conf.set(key, str(most))


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names made of `names` that `df` does not have, whatever its own are called."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def id_remainder(doc_id: Column, n: int) -> Column:
    """crc32(doc_id as text) mod n; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def fits_broadcast(df: DataFrame, rows: int) -> bool:
    """Whether `df` has at most `rows` rows (it reads no more than one row beyond)."""
    return df.limit(rows + 1).count() <= rows


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """Hint a broadcast if `df` is proven to have at most `rows` rows; else leave the join to Spark (sort-merge with
    AQE's skew handling)."""
    return F.broadcast(df) if fits_broadcast(df, rows) else df
