"""Exact top-k inner products by aggregation without random access.

Candidates and queries are dealt into blocks; each pair of a candidate block and a query block is one task's work, of
bounded size. There every dimension is a list of the block's candidates sorted by their value, made once a block. A query
reads the lists of its non-zero dimensions in step, from the top where its own value is positive and from the bottom where
it is negative, so that partial scores come in falling order, in rounds of growing depth. What was read of a candidate
bounds its score: the unread rest is at most the product of the lengths of both unread rests (entries carry their vector's
squared length), and a candidate that no list has shown yet gains at most the last values read. A candidate whose upper
bound is below the k-th best lower bound is out and no longer followed. When few are left, each list is read on only until it
has shown them all, so that they have their final scores. A block reports k candidates a query; the last step
merges blocks. On vectors without structure (many dimensions, all alike) hardly anything is ruled out early: the search is
exact, and then costs a full read of the lists.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

SCALE = 256
CANDIDATE_BLOCK = 8192
QUERY_BLOCK = 4096
#: Reading in step ends when at most so many times k candidates are left.
FEW = 20
#: Queries that read a block's lists in step.
TOGETHER = 64


@dataclass
class Lists:
    """For each dimension the positions and values of all candidates by ascending value, and each candidate's place there;
    the vectors, ids and squared lengths."""

    at: np.ndarray
    value: np.ndarray
    place: np.ndarray
    vectors: np.ndarray
    ids: np.ndarray
    squares: np.ndarray

    @classmethod
    def of(cls, ids: np.ndarray, vectors: np.ndarray) -> Lists:
        columns = np.ascontiguousarray(vectors.T)
        at = np.argsort(columns, axis=1, kind="stable").astype(np.int32)
        place = np.empty(vectors.shape, np.int32)
        place[at, np.arange(len(at))[:, None]] = np.arange(len(vectors))
        return cls(at, np.take_along_axis(columns, at, 1), place, vectors, ids, (vectors.astype(float) ** 2).sum(1))

    def best(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
        """For each query (they read in step) positions and scores of the k best candidates of other ids, ties to the
        smaller id, and the entries read.

        The entries that all lists have shown down to a depth are those whose place is within it, so that what is known of
        the candidates is a sum over just these; entries that were not read have no part in it."""
        n, m = len(self.ids), len(queries)
        up, down = np.where(queries > 0, queries, 0).T, np.where(queries < 0, queries, 0).T
        sides = [(w, (w != 0).astype(np.float32), (w.astype(np.float32)) ** 2) for w in (up, down)]
        whole, lists = (queries.astype(float) ** 2).sum(1), np.count_nonzero(queries, axis=1)
        alive = self.ids[:, None] != query_ids[None]
        partial = np.zeros((n, m), self.value.dtype)
        # squares are summed in single precision: their bounds get as much room
        slack = 0.5 + 1e-9 * np.sqrt(whole * self.squares.max(initial=0))
        depth, busy, read = 0, lists > 0, np.zeros(m, np.int64)
        while depth < n and busy.any():
            read += (min(n, max(2 * depth, 64, n // 8)) - depth) * lists * busy
            depth = min(n, max(2 * depth, 64, n // 8))
            partial[:] = 0
            unread, weight = np.repeat(self.squares[:, None], m, 1), np.repeat(whole[None], n, 0)
            met, outsiders = np.zeros((n, m), np.float32), np.zeros(m)
            for (w, on, square), shown, last in zip(sides, (self.place >= n - depth, self.place < depth), (self.value[:, n - depth], self.value[:, depth - 1]), strict=True):
                x = np.where(shown, self.vectors, 0)
                partial += x @ w
                unread -= np.square(x, dtype=np.float32) @ on
                weight -= shown.astype(np.float32) @ square
                met += shown.astype(np.float32) @ on
                outsiders += (w * last[:, None]).sum(0)
            unread, weight = np.maximum(unread, 0) + 1e-5 * self.squares[:, None], np.maximum(weight, 0) + 1e-5 * whole
            rest = np.where(met >= lists, 0.0, np.sqrt(unread * weight))
            low = np.where(alive, partial - rest, -np.inf)
            floor = np.partition(low, n - k, axis=0)[n - k] if n > k else np.full(m, -np.inf)
            most = np.where(met > 0, partial + rest, np.minimum(rest, outsiders))
            alive &= most >= floor - slack
            busy &= (alive.sum(0) > FEW * k) & (alive & (met < lists)).any(0)
        return [self._finish(queries[i], alive[:, i], partial[:, i].copy(), depth, k, int(read[i])) for i in range(m)]

    def _finish(self, q: np.ndarray, alive: np.ndarray, partial: np.ndarray, depth: int, k: int, read: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Read each list on until it has shown all that are left."""
        n, left = len(self.ids), int(alive.sum())
        for d in np.flatnonzero(q).tolist() if depth < n else []:
            at, missing = depth, left - int(alive[self._entries(d, q[d], 0, depth)[0]].sum())
            while missing and at < n:
                stop = min(n, at + max(64, n // 64))
                places, values, _ = self._entries(d, q[d], at, stop)
                read += stop - at
                keep = alive[places]
                partial[places[keep]] += values[keep] * q[d]
                missing -= int(keep.sum())
                at = stop
        found = np.flatnonzero(alive)
        order = np.lexsort((self.ids[found], -partial[found]))[:k]
        return found[order], partial[found[order]], read

    def _entries(self, d: int, weight: float, start: int, stop: int) -> tuple[np.ndarray, np.ndarray, float]:
        """Entries start to stop of a list, from the end that is better for the query, and the worst value among them."""
        n = len(self.ids)
        part = slice(n - stop, n - start) if weight > 0 else slice(start, stop)
        values = self.value[d, part]
        return self.at[d, part], values, values[0 if weight > 0 else -1] if len(values) else 0.0


def _matrix(vectors: pd.Series) -> np.ndarray:
    """Rows of equal length: shorter vectors are padded with zeros."""
    width = max((len(v) for v in vectors), default=0)
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _search(k: int):
    def run(key, queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(candidates):
            return pd.DataFrame({"query_id": [], "query": [], "vec_id": [], "score": []}).astype("int64")
        q, x = _matrix(queries["vector"]), _matrix(candidates["vector"])
        width = max(q.shape[1], x.shape[1])
        q, x = (np.pad(a, ((0, 0), (0, width - a.shape[1]))) for a in (q, x))
        # sums in floating point are exact below 2**53 and faster
        exact = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, width) < 2**53
        kind = np.float64 if exact else np.int64
        lists = Lists.of(candidates["vec_id"].to_numpy(), x.astype(kind))
        number, query_ids, q = queries["query"].to_numpy(), queries["vec_id"].to_numpy(), q.astype(kind)
        out = []
        for i in range(0, len(q), TOGETHER):
            found = lists.best(query_ids[i : i + TOGETHER], q[i : i + TOGETHER], k)
            for j, (at, score, _) in enumerate(found, i):
                out.append(pd.DataFrame({"query_id": query_ids[j], "query": number[j], "vec_id": lists.ids[at], "score": score.astype(np.int64)}))
        return pd.concat(out)

    return run


def integer_vectors(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and floor(scale * x) of each component, as long. Rows without id, null vectors and those that hold a null or
    non-finite component take no part; rows that repeat an id and a vector count once."""
    doubles = F.transform("embedding", lambda x: x.cast("double"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = embeddings.select("vec_id", doubles.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("v", lambda x: F.floor(x * scale)).alias("vector")).dropDuplicates()


def top_k(vectors: DataFrame, is_query, k: int = 5, candidate_block: int = CANDIDATE_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row of `vectors` (vec_id, vector) for which `is_query` holds, the k
    rows of other ids with the highest inner product, fewer if there are fewer; ties to the smaller vec_id. Shorter vectors
    are padded with zeros. Two different vectors under one id are two candidates and two queries. No vectors, no rows."""
    rows = checkpointed(vectors.withColumn("query", F.xxhash64("vec_id", "vector")))
    queries = rows.filter(is_query)
    n, m = rows.count(), queries.count()
    n_blocks, m_blocks = max(1, -(-n // candidate_block)), max(1, -(-m // query_block))
    deal = F.pmod(F.xxhash64(F.lit(1), "vec_id", "query"), F.lit(n_blocks)).cast("int")
    deal_query = F.pmod(F.xxhash64(F.lit(2), "vec_id", "query"), F.lit(m_blocks)).cast("int")
    # a query meets each block of candidates once, a candidate each block of queries once
    left = queries.select("vec_id", "query", "vector", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("c"), deal_query.alias("q"))
    right = rows.select("vec_id", "vector", deal.alias("c"), F.explode(F.sequence(F.lit(0), F.lit(m_blocks - 1))).alias("q"))
    found = left.groupBy("c", "q").cogroup(right.groupBy("c", "q")).applyInPandas(_search(k), "query_id long, query long, vec_id long, score long")
    order = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
