import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracemill.llm import trie as T


def slow(rows):
    """Nodes of the rebuilt conversations, from plain dictionaries."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [r[2:] for r in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = tuple(own.get(c - int(np.fmod(c, 5)), [])[:h] + turns[h:])
    members = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    children, out = {}, []
    for path in members:
        if path:
            children.setdefault(path[:-1], []).append(path)
    sums = {}
    for path in sorted(members, key=len, reverse=True):
        below = [sums[c] for c in children.get(path, [])]
        here = (len(members[path]) - 1) * len(path[-1][1].encode()) if path else 0
        sums[path] = (sum(b[0] for b in below) or 1, here + sum(b[1] for b in below))
    for path, cs in members.items():
        ids = ",".join(map(str, sorted(c for c in cs if len(rebuilt[c]) == len(path))))
        out.append((min(cs), len(path), min(members[path[:-1]]) if path else None, len(cs), len(children.get(path, [])), *sums[path], hashlib.sha256(ids.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(rng, n, words):
    rows = []
    for conv in rng.sample(range(-n, 2 * n), n):
        for turn in range(rng.choice([0, 1, 2, 3, 6, 12])):
            rows.append((conv, rng.choice([turn, turn, None]), rng.choice(["user", "user", "assistant", None]), rng.choice(words)))
    return rows


@pytest.mark.parametrize("seed,shard", [(1, 1), (2, 7), (3, 60), (4, T.SHARD)])
def test_against_dictionaries(spark, seed, shard):
    rng = random.Random(seed)
    rows = conversations(rng, 120, ["a", "b", "", None, "é" * 9])
    rows += [(7 * i + 1000, t, "user", "same") for i in range(60) for t in range(9)]  # copies throughout
    rows += [(5000, t, "user", f"{t % 3}") for t in range(700)] + [(5001, t, "user", f"{t % 3}") for t in range(650)]
    rows += [(None, 0, "user", "x"), (5000, 3, "user", "0")]
    rng.shuffle(rows)
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, pa string")
    got = sorted((tuple(r) for r in T.prefix_trie(table, shard).collect()), key=str)
    assert got == slow(rows)


def test_small_tables(spark):
    table = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert T.prefix_trie(table).collect() == []
    # a conversation whose turns are all replaced by those of an absent one has none: the root alone
    lone = next(c for c in range(1, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9)
    table = spark.createDataFrame([(lone, None, None, None)], "conv_id long, turn long, role string, text string")
    assert [tuple(r) for r in T.prefix_trie(table).collect()] == [(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]


def test_long_texts_and_long_lists_of_members(spark):
    rows = [(5 * i, 0, "user", "x" * 100000) for i in range(3)] + [(5 * i + 100000, 0, None, None) for i in range(9000)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sorted((tuple(r) for r in T.prefix_trie(table, 3).collect()), key=str) == slow(rows)


def test_louds_round_trip():
    rng = np.random.default_rng(5)
    for units, n in ((1, 1), (3, 3), (2, 40), (5, 400)):
        parents = np.r_[np.full(units, -1), np.sort(rng.integers(0, units, n - units))] if n > units else np.full(units, -1)
        for i in range(units, n):  # any breadth-first order: parents ascend and come before their children
            parents[i] = min(i - 1, max(parents[i - 1], 0) + int(rng.integers(0, 3)))
        bits, degrees = T.louds_bits(parents, units)
        assert len(bits) == 2 * n + 1 and bits.sum() == n
        back, again = T.louds_parents(np.packbits(bits, bitorder="little").tobytes(), n)
        assert back.tolist() == parents.tolist() and again.tolist() == degrees.tolist() == [int((parents == i).sum()) for i in range(n)]


def test_shards_are_bounded(spark):
    rows = [(5 * i, t, "user", "hello" if t == 0 else f"{i % 40}-{t}") for i in range(400) for t in range(4)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    trie = T.build(*T.borrowed_heads(T.turn_rows(table)), shard=50)
    assert trie.images.agg(F.max("n_nodes")).first()[0] <= 100 and trie.images.count() > 1
    assert {(r.depth, r.n_convs) for r in trie.upper.collect()} == {(0, 400), (1, 400)}
