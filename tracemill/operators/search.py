"""Text and vector search."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def _folds() -> tuple[str, str]:
    """Lower-case Latin letters with diacritics, and the letters that they stand on."""
    letters = [chr(c) for block in (range(0xC0, 0x250), range(0x1E00, 0x1F00)) for c in block]
    pairs = [(x, unicodedata.normalize("NFD", x)[0]) for x in letters if x == x.lower() and len(unicodedata.normalize("NFD", x)) > 1]
    return "".join(x for x, _ in pairs), "".join(y for _, y in pairs)


_FOLD = _folds()


def tokens(text: Column) -> Column:
    """Words in lower case without diacritics; all else separates."""
    folded = F.translate(F.lower(F.coalesce(text, F.lit(""))), *_FOLD)
    return F.filter(F.split(folded, r"[^\p{L}\p{N}]+"), lambda t: t != "")


def _fold(word: str) -> str:
    return word.lower().translate(str.maketrans(*_FOLD))


def _any_begins(words: Column, prefix: str) -> Column:
    return F.exists(words, lambda t: F.startswith(t, F.lit(prefix)))


def parsed(query: str) -> list[list[tuple[bool, str, list[str]]]]:
    """A query as alternatives, each a list of (negated, kind, words) that must all hold. Terms are joined by AND unless OR or NOT
    stands between them; kinds are `word`, `phrase` and `prefix` (`"a phrase"`, `prefix*`)."""
    either: list[list[tuple[bool, str, list[str]]]] = [[]]
    negate = False
    for phrase, word in re.findall(r'"([^"]*)"|(\S+)', query):
        if word == "OR":
            either.append([])
        elif word == "NOT":
            negate = True
        elif word != "AND" and (items := [_fold(t) for t in re.findall(r"[^\W_]+", phrase or word)]):
            either[-1].append((negate, "prefix", items[:1]) if word.endswith("*") else (negate, "word" if len(items) == 1 else "phrase", items))
            negate = False
    return [group for group in either if group]


def matches(words: Column, query: str) -> Column:
    """Whether a text of these words meets the query."""

    def holds(kind: str, items: list[str]) -> Column:
        if kind == "prefix":
            return _any_begins(words, items[0])
        if kind == "word":
            return F.array_contains(words, items[0])
        return F.contains(F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")), F.lit(" " + " ".join(items) + " "))

    groups = [reduce(Column.__and__, [~holds(kind, items) if negated else holds(kind, items) for negated, kind, items in g]) for g in parsed(query)]
    return reduce(Column.__or__, groups) if groups else F.lit(False)


def search(messages: DataFrame, query: str, text: str = "content") -> DataFrame:
    return messages.filter(matches(tokens(F.col(text)), query))


def sessions_like(messages: DataFrame, needle: str, width: int = 200) -> DataFrame:
    """One row for each session with a message that holds `needle` in any case: the first one's start."""
    hits = messages.filter(F.col("content").ilike(f"%{needle}%"))
    return hits.groupBy("session_id", "project_id").agg(F.substring(F.min_by("content", "seq"), 1, width).alias("snippet"), F.count("*").alias("hits"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def nearest(vectors: DataFrame, query: list[float], k: int, **must) -> DataFrame:
    """The k rows of the highest cosine similarity to `query` that meet all filters: a scalar matches, a list matches any."""
    for name, value in must.items():
        vectors = vectors.filter(F.col(name).isin(*value) if isinstance(value, (list, tuple, set)) else F.col(name) == value)
    q = F.array(*[F.lit(float(x)) for x in query])
    length = F.sqrt(_dot(F.col("embedding"), F.col("embedding")) * _dot(q, q))
    score = F.when(length > 0, _dot(F.col("embedding"), q) / length).otherwise(0.0)
    return vectors.withColumn("score", score).orderBy(F.desc("score"), "vec_id").limit(k)


def point_id(session_id: Column) -> Column:
    """The number that 15 hex digits of the id's MD5 spell."""
    return F.conv(F.substring(F.md5(session_id), 1, 15), 16, 10).cast("long")


def hashed_embedding(text: Column, width: int = 64) -> Column:
    """An offline stand-in for an embedding service: word counts in hashed buckets."""
    buckets = F.transform(tokens(text), lambda t: F.pmod(F.xxhash64(t), F.lit(width)))
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.size(F.filter(buckets, lambda b: b == i)).cast("float"))


def tag_counts(points: DataFrame) -> DataFrame:
    return points.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "tag")
