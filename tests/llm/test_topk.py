import random

import numpy as np
import pytest

from tracemill.llm import topk as K


def slow(rows, k=5):
    vectors = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in dict.fromkeys((i, tuple(v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v))]
    out = []
    for i, q in vectors:
        if i % 50 == 0:
            ranked = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in vectors if j != i)  # noqa: B905
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(ranked[:k])]
    return sorted(out)


@pytest.mark.parametrize("blocks", [(8192, 512), (13, 2)])
def test_matches_brute_force(spark, blocks):
    rng = random.Random(6)
    rows = [(i, [float(np.float32(rng.gauss(0, 1))) for _ in range(9)]) for i in range(220)]
    rows += [(1000 + i, [0.5] * 9) for i in range(90)] + [(2000 + i, [rng.choice([-0.25, 0.25])] * 9) for i in range(40)]
    rows += [(50, rows[50][1]), (None, [1.0] * 9), (3000, None), (3001, [None] * 9), (3002, [float("nan")] * 9), (3003, [float("inf")] * 9), (3050, [2.0]), (3100, []), (3150, [1e6] * 9)]
    table = spark.createDataFrame([(i, v, 0, 1) for i, v in rows], "vec_id long, embedding array<double>, query int, label int")
    vectors = K.integer_vectors(table)
    got = K.top_k(vectors, vectors.vec_id % 50 == 0, candidate_block=blocks[0], query_block=blocks[1]).collect()
    assert sorted(map(tuple, got)) == slow(rows)


def test_few_rows(spark):
    table = spark.createDataFrame([(50, [1.0]), (51, [2.0])], "vec_id long, embedding array<float>")
    vectors = K.integer_vectors(table)
    assert [tuple(r) for r in K.top_k(vectors, vectors.vec_id % 50 == 0).collect()] == [(50, 1, 51, 131072)]
    vectors = K.integer_vectors(table.limit(0))
    assert K.top_k(vectors, vectors.vec_id % 50 == 0).collect() == []


def plain(ids, x, i, q, k):
    ranked = sorted((-int(x[j] @ q), int(ids[j]), j) for j in range(len(ids)) if ids[j] != i)[:k]
    return [j for _, _, j in ranked]


def test_lists_are_read_in_part():
    """A few dimensions tell most: candidates are ruled out before the lists end. No entry is counted twice."""
    rng = np.random.default_rng(1)
    x = np.floor(rng.normal(size=(4000, 16)) * 300 * 0.5 ** np.arange(16))
    ids = rng.permutation(4000)
    lists = K.Lists.of(ids, x)
    found = lists.best(ids[:20], x[:20], 5)
    for i, (at, score, _) in enumerate(found):
        assert at.tolist() == plain(ids, x, ids[i], x[i], 5) and score.tolist() == (x[at] @ x[i]).tolist()
    assert np.mean([read for _, _, read in found]) < 0.9 * x.size and max(read for _, _, read in found) <= x.size
    few = lists.best(ids[:1], np.where(np.arange(16) < 2, x[:1], 0), 5)[0]
    assert few[2] < 0.2 * x.size


@pytest.mark.parametrize("kind", [np.float64, np.int64])
def test_lists_with_ties_and_odd_vectors(kind):
    rng = np.random.default_rng(2)
    x = rng.integers(-2, 3, (300, 6)).astype(kind)
    x[:100] = x[0]
    ids = rng.permutation(300) // 2
    lists = K.Lists.of(ids, x)
    queries = np.array([*x[:5], *x[150:160], np.zeros(6), [0, 0, 1, 0, 0, 0]], kind)
    for q, (at, _, read) in zip(queries, lists.best(np.full(len(queries), 3), queries, 5), strict=True):
        got = [(-int(x[j] @ q), int(ids[j])) for j in at]
        want = sorted((-int(x[j] @ q), int(ids[j])) for j in range(300) if ids[j] != 3)[:5]
        assert got == want and read <= x.size


def test_ties_at_the_last_place_in_two_blocks(spark):
    """A repeated id, and more candidates of the same score than there are places, dealt over many blocks."""
    rows = [(50, [1.0, 0.0]), (50, [1.0, 0.0]), (7, [2.0, 0.0]), (7, [2.0, 0.0]), (8, [2.0, 1.0]), *((i, [1.0, float(i)]) for i in range(200, 240)), (7, [2.0, 5.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    vectors = K.integer_vectors(table)
    got = sorted(tuple(r) for r in K.top_k(vectors, vectors.vec_id == 50, candidate_block=3, query_block=1).collect())
    assert [r[1:] for r in got] == [(1, 7, 2 * 65536), (2, 7, 2 * 65536), (3, 8, 2 * 65536), (4, 200, 65536), (5, 201, 65536)]
