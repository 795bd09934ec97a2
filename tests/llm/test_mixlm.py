import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tracemill.llm import mixlm as M


def tokens(text):
    return [*(text or "").encode().lower().split(), b""]


def left_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


def corpus():
    """Two languages of words made of syllables; some texts stand there twice."""
    rng = random.Random(2)
    tongues = [["th", "er", "on", "ing", "a"], ["que", "le", "ou", "re", "i"]]
    words = [["".join(rng.choice(t) for _ in range(rng.randint(1, 4))) for _ in range(300)] for t in tongues]
    rows = [(i, " ".join(words[i % 2][min(299, int(rng.expovariate(0.02)))] for _ in range(rng.randint(0, 200)))) for i in range(200)]
    return [*rows, (None, "null Id"), (500, None), (501, ""), (502, "zzz É zzz"), (503, "Th " * 30000), (7, rows[7][1]), *((600 + i, rows[i][1]) for i in range(8, 60))]


@pytest.mark.parametrize("head", [M.HEAD, 20])
def test_scores(spark, head, monkeypatch):
    monkeypatch.setattr(M, "HEAD", head)
    monkeypatch.setattr(M, "BATCH", 3000)
    monkeypatch.setattr(M, "RANGE", 10_000)
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, learned long, leaves string")
    out = M.score(docs).collect()
    assert len(out) == len(rows)
    counts = Counter(x for i, t in rows if not left_out(i) for x in tokens(t))
    n, v = sum(counts.values()), len(counts)
    by_key = Counter()
    for r in out:
        by_key[r.doc_id] += 1
        t = next(t for i, t in rows if i == r.doc_id)
        x = tokens(t)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (left_out(r.doc_id), len(x), sum(counts[y] > 0 for y in x), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[y] + 0.5) / (n + 0.5 * (v + 1))) for y in x), rel=1e-9)
        assert r.score < 0
    assert by_key[7] == 2
    held = [r for r in out if r.held_out]
    assert len(held) > 20 and sum(r.score for r in held) > sum(r.base_score for r in held)
    twice, once = ([r.bits_per_byte for r in out if r.n_tokens > 50 and r.doc_id in ids] for ids in (range(600, 660), range(60, 200)))
    assert np.median(twice) < 0.85 * np.median(once)


def test_scores_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held = M.score(docs).filter("held_out").collect()
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def plain_replies(texts, learned, kept):
    """The reply on each token of each text, event by event in plain Python. `kept` tells whether a context is one."""
    seen, events = defaultdict(Counter), []
    for i, t in enumerate(texts):
        for j in range(len(t)):
            key, chain = tuple(t[j - k] if j >= k else -k for k in (1, 2)), (*t[j : j + M.CHAIN], *[None] * (j + M.CHAIN - len(t)))
            if kept[i][j]:
                events.append((i, j, key, chain))
                seen[key][chain] += learned[i]
    out = [[0] * len(t) for t in texts]
    proposed = [[M.CHAIN] * len(t) for t in texts]
    for i, j, key, chain in events:
        counts = Counter(seen[key])
        counts[chain] -= learned[i]
        c = max(counts.values())
        if c <= 0:
            continue
        ranked = [x for x in counts if counts[x] == c]
        best = min(ranked, key=number_of)
        sure = sum(c >= x for x in (2, 3, 6)) * 2 + (c == sum(counts.values()))
        for k in range(M.CHAIN):
            if j + k >= len(texts[i]):
                break
            if k < proposed[i][j + k]:
                out[i][j + k], proposed[i][j + k] = 1 + (best[k] == chain[k]) + 2 * (sure * 2 + (k > 0)), k
            if best[k] != chain[k]:
                break
    return [x for t in out for x in t]


CODE = M.Code.of([(b"", 9), (b"a", 5), (b"b", 2)], 3, np.zeros(257, np.int64))


def number_of(chain):
    """How ties between chains are settled: by a hash."""
    name = lambda w: CODE.index.get(w, zlib.crc32(w) | 1 << 31)
    packed = 0
    for w in chain:
        packed = packed << 16 | (0 if w is None else int(M._mixed(np.array([name(w)], np.uint64), 7)[0]) >> 48)
    return int(M._hash32(np.array([packed], np.uint64))[0])


@pytest.mark.parametrize("n_ranges", [1, 3])
def test_answers_on_successors_equal_brute_force(n_ranges, monkeypatch):
    rng = random.Random(4)
    texts = [[bytes([97 + min(4, int(rng.expovariate(1)))]) for _ in range(rng.randint(0, 40))] + [b""] for _ in range(80)]
    learned = np.array([rng.random() < 0.7 for _ in texts])
    for sparse in (1, 3):
        monkeypatch.setattr(M, "SPARSE", sparse)
        t = M.Texts.of(CODE, [x[:-1] for x in texts])
        ranges, two, chains, counts, at, back = M.events_of(t, CODE, learned, n_ranges)
        assert (np.diff(ranges) >= 0).all() and len(np.unique(ranges)) >= min(2, n_ranges) and len(ranges) < len(back)
        said = np.concatenate([M.answers(*(x[ranges == r] for x in (two, chains, counts))) for r in np.unique(ranges)])
        flat = np.zeros(int(t.lengths.sum()), bool)
        flat[at] = True
        kept = np.split(flat, np.cumsum(t.lengths)[:-1])
        assert M.replies_of(said[back], at, t.lengths).tolist() == plain_replies(texts, learned, kept)


def test_repeats_within_a_text():
    words = b"a b c a b c a b d".split()
    code = M.Code.of([(b"", 9)], 3, np.zeros(257, np.int64))
    t = M.Texts.of(code, [words, words[:5]])
    names = t.names(code)
    got = M.repeats(names, M.contexts_of(names, t.places()), t.lengths).tolist()
    #       a  b  c  a  b  c  a  b  d  end
    assert got == [0, 0, 0, 0, 0, 2, 2, 2, 1, 0, 0, 0, 0, 0, 0, 1]


def some_model(seed=1):
    code = M.Code.of([(b"", 5), (b"a", 300), (b"b", 100), (b"c", 9)], 20, np.arange(257))
    rng = np.random.default_rng(seed)
    slots = rng.integers(0, 1 << 16, 1 << M.BITS).astype(np.uint16)
    return M.Model(code, slots, rng.normal(size=(1 + M.ORDERS, M.GATES)).astype(np.float32) * 0.1, rng.normal(size=3 * M.BUCKETS).astype(np.float32) * 0.1)


def test_probabilities_of_the_next_token_sum_to_one():
    """All tokens after a short text: leaves of the tree, and the escape, whose spellings sum to one by their own tree."""
    model = some_model()
    code = model.code
    none = np.zeros(1, np.uint8)
    total = 0.0
    for leaf in range(len(code.index) + 1):
        t = M.Texts(np.array([leaf], np.int32), [b"q"] if leaf == len(code.index) else [], np.array([1]))
        c = M.decisions(code, t, none)
        tree = c.of_runs(c.kinds) == M.TREE
        part = M.Coded(c.bits[tree], c.nodes[tree], c.slots[:, tree], np.array([0]), np.array([0]), np.array([M.TREE]), np.array([0, 1]), c.static)
        total += 10 ** model.scores(part, np.zeros(1, bool))[0]
    assert total == pytest.approx(1, abs=1e-5)
    paths = [range(code.offsets[s], code.offsets[s + 1]) for s in range(len(code.offsets) - 1 - 4 - 257, len(code.offsets) - 1 - 4)]
    assert sum(2.0 ** -len(p) for p in paths) == pytest.approx(1)


def plain_score(model, c):
    """log10 probability of the only text of `c`, which is not learned from: one decision after the other."""
    own = defaultdict(float)
    ends = [*c.begins, len(c.bits)]
    total = float(c.static[0])
    for low, high in zip(c.cuts, c.cuts[1:], strict=False):
        changes = defaultdict(float)
        for run in range(low, high):
            kind, size = int(c.kinds[run]), ends[run + 1] - ends[run]
            for i in range(ends[run], ends[run + 1]):
                counts = [(int(M._LEVELS[x >> 8]), int(M._LEVELS[x & 255])) for x in (int(model.slots[s]) for s in c.slots[:, i])]
                x = [float(model.code.prior[c.nodes[i]]), *(math.log((b + 0.4) / (a + 0.4)) for a, b in counts)]
                gate = kind
                for a, b in counts:
                    gate = gate * 4 + sum(a + b >= y for y in M.SEEN)
                z = sum((float(model.weights[k, gate]) + own[kind, k]) * v for k, v in enumerate(x)) + own[kind, "constant"]
                z += float(model.shifts[kind * M.BUCKETS + M.BUCKETS // 2 + int(np.rint(min(16, max(-16, 1.5 * z))))])
                z = min(16, max(-16, z))
                p = 1 / (1 + math.exp(-z))
                total += math.log(p if c.bits[i] else 1 - p)
                for k, v in [*enumerate(x), ("constant", 1.0)]:
                    changes[kind, k] += M.RATE / math.sqrt(size) * (c.bits[i] - p) * v
        for key, change in changes.items():
            own[key] += change
    return total / math.log(10)


def test_score_of_a_text_equals_brute_force():
    model = some_model(3)
    texts = [b"a b a b zq a a c b zq a b".split() * 20, [], b"c a".split(), b"xyz a b a".split() * 9]
    t = M.Texts.of(model.code, texts)
    replies = np.random.default_rng(2).integers(0, 33, int(t.lengths.sum())).astype(np.uint8)
    together = model.scores(M.decisions(model.code, t, replies), np.zeros(4, bool))
    at = 0
    for i, words in enumerate(texts):
        n = int(t.lengths[i])
        alone = M.decisions(model.code, M.Texts.of(model.code, [words]), replies[at : at + n])
        assert together[i] == pytest.approx(plain_score(model, alone), rel=2e-3, abs=1e-3)
        at += n


def test_weights_are_refined_within_texts():
    model = M.Model.fresh(some_model().code, np.zeros(1 << M.BITS, np.uint16))
    words = [b"xyz%d" % (i % 7) for i in range(400)]

    def bits(n):
        t = M.Texts.of(model.code, [words[:n]])
        return model.scores(M.decisions(model.code, t, np.zeros(n + 1, np.uint8)), np.zeros(1, bool))[0]

    assert bits(16) > 2.5 * bits(8) and bits(400) > 40 * bits(8)


def test_counts_in_bytes():
    counts = np.array([[0, 0], [31, 1], [1000, 100_000], [4_000_000_000, 2]])
    out = M.packed(counts)
    zeros, ones = M._LEVELS[out >> 8], M._LEVELS[out & 255]
    assert np.allclose(np.stack([zeros, ones], 1), counts, rtol=0.05)
    taken = M._STRETCHED.view(np.float32).reshape(3, -1)[:, out[1]]
    assert taken == pytest.approx([math.log(1.4 / 31.4), math.log(1.4 / 30.4), math.log(0.4 / 31.4)], rel=1e-4)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    from pyspark.sql import functions as F

    rows = M.score(docs, F.lit(False)).collect()
    assert [(r.n_known, r.train_tokens) for r in rows] == [(0, 0)] * 2 and all(r.score < 0 for r in rows)
    assert M.score(docs.limit(0)).collect() == []


def test_every_context_is_counted():
    t = M.Texts.of(CODE, [(b"a", b"b", b"q%d" % (i % 9), b"a")[: i % 5] for i in range(60)])
    *_, counts, at, back = M.events_of(t, CODE, np.ones(60, bool), 1)
    assert at.tolist() == list(range(len(t.leaves)))
    assert counts.sum() == len(back) == len(t.leaves)


def test_words_are_those_of_plain_python():
    texts = [None, "", " ", "\t a  B\x0bÉ é\u2003z \x1cq\x85 ", "x", "End\n", *("%d b %d" % (i, i % 3) for i in range(40))]
    array = pa.array(texts)
    for low, n in ((0, 46), (1, 5), (3, 30), (4, 0)):  # slices too
        w = M.Words.of(array.slice(low, n))
        found = np.split(np.array([*w.distinct, None], object)[w.numbers], np.cumsum(w.sizes))[:-1]
        assert [list(x) for x in found] == [tokens(x)[:-1] for x in texts[low : low + n]]
        plain, read = M.Texts.of(CODE, [tokens(x)[:-1] for x in texts[low : low + n]]), M.Texts.read(CODE, w)
        assert (plain.leaves.tolist(), plain.spelt, plain.lengths.tolist()) == (read.leaves.tolist(), read.spelt, read.lengths.tolist())
        parts = [part for _, part in read.cut(len(CODE.index), 4)]
        assert [x for p in parts for x in p.spelt] == read.spelt and np.concatenate([p.leaves for p in parts] or [read.leaves]).tolist() == read.leaves.tolist()


def test_decisions_of_a_token_lie_in_few_lines_of_slots():
    words = [b"w%d" % i for i in range(600)]
    code = M.Code.of([(b"", 9), *((w, 10) for w in words)], 20, np.zeros(257, np.int64))
    t = M.Texts.of(code, [words])
    c = M.decisions(code, t, np.zeros(601, np.uint8))
    assert set(c.kinds.tolist()) == {M.TREE}
    at = 0
    for leaf in t.leaves:
        cell = code.cell[leaf]
        size = int(code.offsets[cell + 1] - code.offsets[cell])
        for slots in c.slots[:, at : at + size]:
            assert len(np.unique(slots)) == size > 6 and len(np.unique(slots >> 3)) <= -(-size // 3)
        at += size
    assert at == len(c.bits)


def test_tokens_are_counted_across_sums_within_tasks(spark, monkeypatch):
    monkeypatch.setattr(M, "COUNTED", 50)
    monkeypatch.setattr(M, "READ", 3)
    texts = [t for _, t in corpus()]
    found = M.count_tokens(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)).collect()
    assert {bytes(r.token): r.n for r in found} == Counter(x for t in texts for x in tokens(t)) and len(found) > 200


def test_leaves_are_found_by_hash_and_compared(monkeypatch):
    head = [b"", b"a", b"ab", b"ba", b"\xff\x00", b"aa" * 500]
    code = M.Code.of([(w, 3) for w in head], 3, np.zeros(257, np.int64))
    words = [b"zz", *head[::-1], b"b", b"\x00", b"aa"]
    for array in (pa.array(words, pa.large_binary()), pa.array([b"first", *words], pa.large_binary()).slice(1)):
        assert code.leaves_of(array).tolist() == [code.index.get(w, 6) for w in words]
    assert code.leaves_of(pa.array([], pa.large_binary())).tolist() == []
    monkeypatch.setattr(M, "_hashes", lambda x: np.zeros(len(x), np.uint64))  # all collide
    other = M.Code.of([(w, 3) for w in head], 3, np.zeros(257, np.int64))
    assert other.leaves_of(pa.array(words, pa.large_binary())).tolist() == [code.index.get(w, 6) for w in words]
