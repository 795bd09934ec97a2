"""A persisted inverted index of messages: postings with positions, by ranges of terms.

`<path>/postings` holds one row for each term of a document, with the places where it stands, in folders by batch and by the
term's first letter, sorted by term within files: a word reads one folder and, by the statistics of the files, the row
groups that may hold it; a prefix reads a range of terms. `<path>/documents` holds the keys of the documents of each batch; a
batch counts once its documents are there, so that an addition that dies half-way leaves nothing behind that is seen.

Queries are those of `search`: words, phrases by joining positions, prefixes by ranges, AND, OR and NOT."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .search import parsed, tokens

_POSTINGS, _DOCUMENTS = "postings", "documents"


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def documents(spark: SparkSession, path: str) -> DataFrame:
    """Keys of all documents in the index, and the batch they came with."""
    return spark.read.parquet(f"{path}/{_DOCUMENTS}")


def _postings(spark: SparkSession, path: str) -> DataFrame:
    batches = [r[0] for r in documents(spark, path).select("batch").distinct().collect()]  # one for each addition
    return spark.read.parquet(f"{path}/{_POSTINGS}").filter(F.col("batch").isin(batches))


def add(messages: DataFrame, path: str, keys: list[str], text: str = "content") -> int:
    """Add the documents that are not in the index yet; returns their number. `keys` identify a document and are not null; of
    several rows with one key any one is taken."""
    spark = messages.sparkSession
    fresh = messages.select(*keys, F.col(text).alias("text")).dropDuplicates(keys)
    if _exists(spark, f"{path}/{_DOCUMENTS}"):
        fresh = fresh.join(documents(spark, path).select(*keys), keys, "left_anti")
    batch = uuid.uuid4().hex
    here = f"{path}/staged/{batch}"
    fresh.write.parquet(here)  # one placement and one choice among equal keys for both tables
    fresh = spark.read.schema(fresh.schema).parquet(here)
    added = fresh.count()
    if added:
        words = fresh.select(*keys, F.posexplode(tokens(F.col("text"))).alias("place", "term"))
        rows = words.groupBy("term", *keys).agg(F.array_sort(F.collect_list("place")).alias("places"))
        rows = rows.withColumns({"batch": F.lit(batch), "head": F.substring("term", 1, 1)})
        rows.repartitionByRange("head", "term").sortWithinPartitions("head", "term", *keys).write.mode("append").partitionBy("batch", "head").parquet(f"{path}/{_POSTINGS}")
        fresh.select(*keys).withColumn("batch", F.lit(batch)).write.mode("append").partitionBy("batch").parquet(f"{path}/{_DOCUMENTS}")
    staged = spark._jvm.org.apache.hadoop.fs.Path(here)
    staged.getFileSystem(spark._jsc.hadoopConfiguration()).delete(staged, True)
    return added


def _term(postings: DataFrame, word: str) -> DataFrame:
    return postings.filter((F.col("head") == word[0]) & (F.col("term") == word))


def _moved(by: int) -> Column:
    return F.transform("places", lambda p: p - by)


def _holding(postings: DataFrame, keys: list[str], kind: str, words: list[str]) -> DataFrame:
    """Keys of the documents that hold a term of the query, each once."""
    if kind == "prefix":
        return postings.filter((F.col("head") == words[0][0]) & F.startswith(F.col("term"), F.lit(words[0]))).select(*keys).distinct()
    found = _term(postings, words[0]).select(*keys, "places")
    for i, word in enumerate(words[1:], 1):
        # where the phrase may begin for its i-th word to stand where it does
        begins = _moved(i).alias("begins")
        here = F.array_intersect("places", "begins")
        found = found.join(_term(postings, word).select(*keys, begins), keys).select(*keys, here.alias("places")).filter(F.size("places") > 0)
    return found.select(*keys)


def find(spark: SparkSession, path: str, query: str, keys: list[str]) -> DataFrame:
    """Keys of the documents that meet `query`; an empty query meets none."""
    postings, everything = _postings(spark, path), documents(spark, path).select(*keys)
    groups = []
    for group in parsed(query):
        wanted = [_holding(postings, keys, kind, words) for negated, kind, words in group if not negated]
        rows = reduce(lambda a, b: a.join(b, keys, "left_semi"), wanted) if wanted else everything
        for negated, kind, words in group:
            if negated:
                rows = rows.join(_holding(postings, keys, kind, words), keys, "left_anti")
        groups.append(rows)
    if not groups:
        return everything.limit(0)
    return reduce(DataFrame.unionByName, groups).distinct() if len(groups) > 1 else groups[0]


def search_indexed(messages: DataFrame, path: str, query: str, keys: list[str]) -> DataFrame:
    """The rows of `messages` whose documents meet `query`."""
    return messages.join(find(messages.sparkSession, path, query, keys), keys, "left_semi")
