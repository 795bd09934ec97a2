"""Keyed tables that are changed in place: Parquet folders partitioned by a hash of the key, copied on write.

A change reads and rewrites only the buckets that hold keys of the change, and of these only those in which a row really
differs, so that doing it again changes nothing and leaves all files as they are. New content is first written beside the
table (the shared folder); then Spark's dynamic partition overwrite swaps the buckets in. A job that dies between buckets is
mended by running it again, as all changes are idempotent. One writer at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import merge
from .storage import written

BUCKET = "bucket"


def _bucket(keys: list[str], n: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int").alias(BUCKET)


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def create(df: DataFrame, path: str, keys: list[str], buckets: int = 64) -> None:
    """A table of the rows of `df`. `keys` identify a row; the number of buckets stays as it is. No column may be named `bucket`."""
    if BUCKET in (c.lower() for c in df.columns):
        raise ValueError("a column is named bucket")
    df.withColumn(BUCKET, _bucket(keys, buckets)).repartition(BUCKET).sortWithinPartitions(*keys).write.partitionBy(BUCKET).parquet(path)


def read(spark: SparkSession, path: str, like: DataFrame | None = None) -> DataFrame:
    """The rows of a table; of an emptied one if `like` tells its columns."""
    if like is not None:
        return spark.read.schema(like.drop(BUCKET).withColumn(BUCKET, F.lit(0)).schema).parquet(path).drop(BUCKET)
    return spark.read.parquet(path).drop(BUCKET)


def _swap(before: DataFrame, after: DataFrame, path: str, keys: list[str]) -> dict[str, int]:
    """Write the buckets of `after` that differ from `before`; both hold all rows of the buckets concerned."""
    spark = before.sparkSession
    columns = [c for c in before.columns if c != BUCKET]
    after = written(after.select(*columns, BUCKET), "merged")
    # a bucket differs if any row occurs more often on one side
    sides = before.select(BUCKET, F.struct(*columns).alias("row"), F.lit(1).alias("n")).unionByName(after.select(BUCKET, F.struct(*columns).alias("row"), F.lit(-1).alias("n")))
    uneven = sides.groupBy(BUCKET, F.to_json("row", {"ignoreNullFields": "false"}).alias("row")).agg(F.sum("n").alias("n")).filter("n <> 0")
    # at most one row for each bucket comes to the driver, and there is a fixed number of them
    changed = [r[0] for r in uneven.select(BUCKET).distinct().collect()]
    kept = {r[0] for r in after.filter(F.col(BUCKET).isin(changed)).select(BUCKET).distinct().collect()} if changed else set()
    if kept:
        part = after.filter(F.col(BUCKET).isin(sorted(kept))).repartition(BUCKET).sortWithinPartitions(*keys)
        part.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)
    for b in set(changed) - kept:  # overwriting leaves buckets alone that are empty now
        fs, at = _file_system(spark, f"{path}/{BUCKET}={b}")
        fs.delete(at, True)
    return {"changed": len(changed), "emptied": len(set(changed) - kept)}


def _with_new(path: str, new: DataFrame, keys: list[str], buckets: int, merged) -> dict[str, int]:
    spark = new.sparkSession
    fresh = written(new.withColumn(BUCKET, _bucket(keys, buckets)), "fresh")
    touched = [r[0] for r in fresh.select(BUCKET).distinct().collect()]
    if not touched:
        return {"changed": 0, "emptied": 0}
    before = spark.read.schema(fresh.schema).parquet(path).filter(F.col(BUCKET).isin(touched))
    return _swap(before, merged(before, fresh.select(before.columns)), path, keys)


def upsert(path: str, new: DataFrame, keys: list[str], preserve: tuple[str, ...] = (), buckets: int = 64) -> dict[str, int]:
    """Insert, or update all columns but those in `preserve`, of which values that are not null stay. `new` has one row a key and
    the columns of the table; a null in a key never meets another row and is added each time, as in `merge`."""
    return _with_new(path, new, keys, buckets, lambda old, fresh: merge.upsert(old, fresh, keys, preserve))


def replace(path: str, new: DataFrame, keys: list[str], *order: Column, buckets: int = 64) -> dict[str, int]:
    """Insert or replace; of several new rows of a key the one that is first by `order` stays."""
    return _with_new(path, new, keys, buckets, lambda old, fresh: merge.keep_last(old, fresh, keys, *(order or [F.lit(0)])))


def insert_new(path: str, new: DataFrame, keys: list[str], *order: Column, buckets: int = 64) -> dict[str, int]:
    """Insert or ignore."""
    return _with_new(path, new, keys, buckets, lambda old, fresh: merge.keep_first(old, fresh, keys, *(order or [F.lit(0)])))


def delete_scope(path: str, scope: DataFrame, by: list[str], keys: list[str]) -> dict[str, int]:
    """Delete the rows whose `by` columns are in `scope`; buckets without such rows are not written."""
    spark = scope.sparkSession
    table = spark.read.parquet(path)
    doomed = written(table.join(scope.select(*by).distinct(), by, "left_semi").select(BUCKET).distinct(), "doomed")
    touched = [r[0] for r in doomed.collect()]
    if not touched:
        return {"changed": 0, "emptied": 0}
    before = table.filter(F.col(BUCKET).isin(touched))
    return _swap(before, merge.delete_scope(before, scope, by).select(before.columns), path, keys)
