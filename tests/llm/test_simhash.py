import random

import numpy as np
import pytest
import xxhash

from tracemill.llm import simhash as S
from tracemill.llm.components import connected_components


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(rows):
    prints = [slow_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    out = []
    for i in range(len(rows)):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((rows[i][0], f"{prints[i]:016x}", min(ids, default=None)))
    return sorted(out, key=str)


def test_fingerprint_matches_plain_loop():
    for text in (None, "", " \n", "a", "A b", "a b c d", "é B c d e f g " * 40):
        assert S.fingerprint(None if text is None else text.encode()) == slow_fingerprint(text)


def test_two_prints_within_two_bits_of_a_half_share_an_anchor():
    rng = random.Random(1)
    for _ in range(400):
        x = rng.getrandbits(32)
        y = x
        for b in rng.sample(range(32), rng.randint(0, 2)):
            y ^= 1 << b
        ours = [set(S.anchors_of(np.array([v], np.int64))[1].tolist()) for v in (x, y)]
        assert ours[0] & ours[1]
        assert all((a ^ x).bit_count() <= 2 for a in ours[0])


@pytest.mark.parametrize("block", [32768, 7])
def test_components_match_brute_force(spark, block):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(500)]
    rows = [(None, "null id"), (None, "null id"), (7, None), (8, ""), (9, " "), (3, "one"), (3, "one")]
    for group in range(6):
        base = [rng.choice(vocabulary) for _ in range(150)]
        for k in range(20):
            words = list(base)
            for _ in range(k % 4):
                words[rng.randrange(150)] = rng.choice(vocabulary)
            rows.append((100 * (group + 1) + k, " ".join(words)))
    rows += [(2000 + i, " ".join(rng.choice(vocabulary) for _ in range(50))) for i in range(60)]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, fp string, root int")
    got = S.near_duplicates(docs, block=block).collect()
    assert sorted([tuple(r) for r in got], key=str) == slow_components(rows)
    kept = S.drop_near_duplicates(docs, block=block)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({c for _, _, c in slow_components(rows) if c is not None})
    assert kept.filter("doc_id is null").count() == 1


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert S.near_duplicates(docs).collect() == []
    assert S.drop_near_duplicates(docs).collect() == []


def test_components_of_a_long_path_and_a_star(spark):
    rows = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(50)] + [(5, 5)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(301)}, **{1000 + i: 1000 for i in range(50)}}


def test_no_side_of_a_join_is_built_on_the_driver(spark, monkeypatch):
    """Sides that grow with the corpus fit a broadcast here, and would on a driver that has no room for them."""
    plans = []

    def noted(df):
        out = df.checkpoint()
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(S, "checkpointed", noted)
    monkeypatch.setattr("tracemill.llm.components.checkpointed", noted)
    words = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(i, " ".join(words[: 30 + i % 3] + [f"v{i % 7}"])) for i in range(40)], "doc_id long, text string")
    noted(S.near_duplicates(docs))
    noted(S.drop_near_duplicates(docs))
    assert sum("SortMergeJoin" in p for p in plans) >= 6
    assert not [p for p in plans if "Broadcast" in p]
