"""Language-model scoring by online logistic context mixing.

A text is a sequence of tokens, each coded by binary decisions:

1. whether it is the one that followed the same two tokens before in this text, and then whether it is the one that
   followed them most often in the training texts (all contexts are kept; with SPARSE above one only those of one in SPARSE,
   by hash, and with CHAIN above one each would propose so many tokens, until one of them is wrong);
2. if none is right, its path in a balanced tree over the sorted training tokens, down to a cell of about 1/CELLS of all
   tokens, and its share of the cell;
3. tokens outside the tree are an escape, and their bytes along a Huffman code, learned from tokens that are as rare.

Every decision is predicted from its node's own counts and from two hashed contexts, whose counts come from all training
texts. The predictions are combined in the logistic domain by weights that are gated by the kind of decision and by how much
its contexts have seen, and a last stage corrects the outcome by what came of alike predictions. Weights and corrections are
learned online over all training texts; from there each text refines its own weights, first after 8 tokens. Successors are all
kept, on the cluster: events of a batch of texts are counted, sent to the range of their context's hash and answered there
by one byte each, so that this grows with the corpus and no context's events meet unless counted. Counts of tokens are exact
and stay on the cluster too. What goes to every task is of fixed size: tokens that have a leaf, and 2**BITS slots.

The score of a training text is that of a model without the decision at hand: the decision's own count and its own event are
taken out, so that texts which were learned from and others are measured alike.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, id_remainder

#: Most tokens that have a leaf; those that occur once have none, so that escape and speller are learned from novel tokens.
HEAD = 262_144
CELLS = 256
#: Slots of hashed contexts, and levels of a tree that lie side by side in them.
BITS, LEVELS = 22, 3
ORDERS = 2
#: Tokens that are tried first: the one after the same two before in the text, and the one after them in training.
CANDIDATES = 2
#: One of SPARSE contexts (by hash) is kept with what follows it, CHAIN tokens at once: all contexts, with the next token.
SPARSE, CHAIN = 1, 1
#: Tokens that one task encodes together, and training events of one range of contexts.
BATCH, RANGE = 800_000, 1_000_000
#: Rows whose words are told apart at once: the distinct ones of many more leave the cache.
READ = 1600
#: Decisions between two steps of a task while the weights are learned, and tokens whose decisions are held at once.
LEARN, HELD = 8192, 40_000
RATE = 0.02
COUNTED = 500_000
CHUNK = 1 << 14
END = b""
#: Symbols of spelt bytes: 0-255, and the end of the token.
SPELT_END = 256
TREE, SPELL, MATCH = 0, 1, 2
BUCKETS = 33
#: Counts of a slot at which it counts as seen, as seen more, as seen often.
SEEN = (1, 4, 64)
GATES = 3 * 4**ORDERS
_U = np.uint64
_CODEC = pa.Codec("zstd", 1)


@dataclass
class Words:
    """The words of some texts, end to end: how many each text has, the number of each word, and the words by number."""

    sizes: np.ndarray
    numbers: np.ndarray
    dictionary: pa.Array

    @property
    def distinct(self) -> list[bytes]:
        return self.dictionary.to_numpy(zero_copy_only=False).tolist()

    @classmethod
    def of(cls, texts: pa.Array) -> Words:
        whole = texts.take(pa.array(np.arange(len(texts))))  # pyarrow's ascii_lower is wrong on slices
        lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(whole.cast(pa.large_string()), "")))
        words = lists.flatten()
        there = pc.greater(pc.binary_length(words), 0)  # white space at an end leaves an empty word
        owner = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        coded = words.filter(there).dictionary_encode()
        sizes = np.bincount(owner[there.to_numpy(zero_copy_only=False)], minlength=len(lists))
        return cls(sizes, coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.cast(pa.large_binary()))

    def counts(self) -> pa.Table:
        return _counted(self.dictionary, np.bincount(self.numbers, minlength=len(self.dictionary)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(id_remainder(doc_id, 5) == 1, F.lit(False))


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x + _U(salt << 50)) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(31))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(29))


def _hashes(words: pa.Array) -> np.ndarray:
    """64 bits of each of `words` (large_binary, without nulls)."""
    if not len(words):
        return np.zeros(0, _U)
    _, offsets, data = words.buffers()
    ends = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1]
    sizes = np.diff(ends)
    bytes_ = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if ends[-1] else np.zeros(0, np.uint8)
    powers = np.cumprod(np.full(int(sizes.max()) + 1, 0x9E3779B97F4A7C15, _U))
    inside = np.arange(len(bytes_)) - np.repeat(ends[:-1] - ends[0], sizes)
    sums = np.concatenate((np.zeros(1, _U), np.cumsum((bytes_.astype(_U) + _U(1)) * powers[inside], dtype=_U)))
    return _mixed(sums[ends[1:] - ends[0]] - sums[ends[:-1] - ends[0]], 3)


def _huffman(counts: list[int]) -> tuple[list[list[tuple[int, int]]], np.ndarray]:
    """The path (node, bit) of each symbol in a Huffman tree, and (zeros, ones) below each inner node."""
    n = len(counts)
    heap = [(c, i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    parent, below = {}, []
    while len(heap) > 1:
        (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
        node = len(below)
        parent[x], parent[y] = (node, 0), (node, 1)
        below.append((a, b))
        heapq.heappush(heap, (a + b, n + node))
    paths = []
    for i in range(n):
        path, at = [], i
        while at in parent:
            path.append(parent[at])
            at = n + parent[at][0]
        paths.append(path[::-1])
    return paths, np.array(below, float).reshape(-1, 2)


def _cells(weights: np.ndarray, cells: int) -> tuple[np.ndarray, list[list[tuple[int, int]]], np.ndarray]:
    """(cell of each leaf, path of each cell, (left, right) below each inner node) of a balanced tree over the leaves in
    their order. Nodes of less than 1/cells of all weight are not split."""
    total = np.concatenate(([0.0], np.cumsum(weights)))
    cell, paths, below = np.zeros(len(weights), np.int32), [], []
    stack: list[tuple[int, int, list[tuple[int, int]]]] = [(0, len(weights), [])]
    while stack:
        low, high, path = stack.pop()
        if high - low == 1 or total[high] - total[low] < total[-1] / cells:
            cell[low:high] = len(paths)
            paths.append(path)
            continue
        half = (total[low] + total[high]) / 2
        at = min(max(int(np.searchsorted(total, half)), low + 1), high - 1)
        if at - 1 > low and half - total[at - 1] < total[at] - half:
            at -= 1
        node = len(below)
        below.append((total[at] - total[low], total[high] - total[at]))
        stack += [(at, high, [*path, (node, 1)]), (low, at, [*path, (node, 0)])]
    return cell, paths, np.array(below, float).reshape(-1, 2)


def _lines(paths: list[list[tuple[int, int]]], n_nodes: int) -> tuple[np.ndarray, np.ndarray]:
    """(salt, place) of each node: LEVELS levels of a tree below one node share its salt and so a line of 2**LEVELS slots, in
    which each has a place. A token's decisions then meet a few lines of memory, not one for each decision."""
    tops, places = np.zeros(n_nodes, np.uint32), np.zeros(n_nodes, np.uint32)
    for path in paths:
        for at in range(0, len(path), LEVELS):
            place = 1
            for node, bit in path[at : at + LEVELS]:
                tops[node], places[node] = path[at][0], place
                place = 2 * place + bit
    return tops * np.uint32(0x9E3779B1), places


@dataclass
class Coded:
    """Decisions of some texts: outcome, node and slot in each context. They stand in runs of one step, text and kind: where
    each run begins, its text and its kind; of the runs where each step begins; and the log probability of what is coded
    without contexts, by text."""

    bits: np.ndarray
    nodes: np.ndarray
    slots: np.ndarray
    begins: np.ndarray
    texts: np.ndarray
    kinds: np.ndarray
    cuts: np.ndarray
    static: np.ndarray

    def of_runs(self, x: np.ndarray) -> np.ndarray:
        """A value of each run for each of its decisions."""
        return np.repeat(x, np.diff(np.concatenate((self.begins, [len(self.bits)]))))


@dataclass
class Code:
    """Symbols: cells, then bytes and the end of a spelt token, then a miss and a hit of each of three candidates."""

    index: dict[bytes, int]  # leaves: head tokens in sorted order; the escape is the last leaf
    ranks: np.ndarray  # of each leaf by count, the commonest first
    cell: np.ndarray
    share: np.ndarray  # log of the leaf's share of its cell
    offsets: np.ndarray
    nodes: np.ndarray
    bits: np.ndarray
    prior: np.ndarray  # stretched probability of a one, for each node
    first_spelt: int  # nodes of the speller start here, those of candidates at first_match
    first_match: int
    by_rank: np.ndarray  # leaves, the escape and then the commonest first
    salts: np.ndarray  # of each step of the paths, see `_lines`
    places: np.ndarray

    @classmethod
    def of(cls, head: list[tuple[bytes, int]], rest: int, spelt: np.ndarray, cells: int = CELLS) -> Code:
        head = sorted(head)
        weights = np.array([c for _, c in head] + [max(1, rest)], float)
        cell, paths, below = _cells(weights, cells)
        spelling, spelt_below = _huffman((spelt + 1).tolist())
        one = len(below)
        two = one + len(spelt_below)
        paths = paths + [[(n + one, b) for n, b in p] for p in spelling] + [[(two + k, b)] for k in range(CANDIDATES) for b in (0, 1)]
        below = np.concatenate((below, spelt_below, np.ones((CANDIDATES, 2))))
        flat = [x for p in paths for x in p]
        nodes = np.array([n for n, _ in flat], np.int32)
        salts, places = _lines(paths, len(below))
        order = np.argsort(-weights[:-1], kind="stable")
        ranks = np.full(len(weights), len(weights), np.int32)
        ranks[order] = np.arange(len(order))
        return cls(
            {w: i for i, (w, _) in enumerate(head)}, ranks, cell,
            np.log(weights / np.bincount(cell, weights)[cell]),
            np.concatenate(([0], np.cumsum([len(p) for p in paths]))).astype(np.int32), nodes, np.array([b for _, b in flat], np.int8),
            np.log((below[:, 1] + 0.4) / (below[:, 0] + 0.4)).astype(np.float32), one, two, np.concatenate(([len(head)], order)).astype(np.int32), salts[nodes], places[nodes],
        )

    def leaves(self, words: list[bytes]) -> np.ndarray:
        """Leaves of a text's tokens and its end."""
        escape, get = len(self.index), self.index.get
        out = np.empty(len(words) + 1, np.int32)
        out[:-1] = np.fromiter(map(get, words, repeat(escape)), np.int32, len(words))
        out[-1] = get(END, escape)
        return out

    @cached_property
    def hashed(self) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The leaves' tokens and their hashes, in the order of the hashes, and the leaf of each."""
        tokens, leaves = pa.array(self.index, pa.large_binary()), np.fromiter(self.index.values(), np.int32, len(self.index))
        hashes = _hashes(tokens)
        order = np.argsort(hashes)
        return tokens.take(pa.array(order)), hashes[order], leaves[order]

    def leaves_of(self, words: pa.Array) -> np.ndarray:
        """Leaves of many tokens at once: found by their hashes, and then compared."""
        escape = len(self.index)
        tokens, hashes, leaves = self.hashed
        if not escape or (hashes[1:] == hashes[:-1]).any():
            return np.fromiter(map(self.index.get, words.to_pylist(), repeat(escape)), np.int32, len(words))
        at = np.minimum(np.searchsorted(hashes, _hashes(words)), escape - 1)
        same = pc.equal(words, tokens.take(pa.array(at))).to_numpy(zero_copy_only=False)
        return np.where(same, leaves[at], np.int32(escape))


@dataclass
class Texts:
    """Some texts, end to end: the leaf of each token, the spellings of those that escape, and the number of tokens of each."""

    leaves: np.ndarray
    spelt: list[bytes]
    lengths: np.ndarray

    @classmethod
    def of(cls, code: Code, texts: list[list[bytes]]) -> Texts:
        leaves = [code.leaves(w) for w in texts]
        escape = len(code.index)
        spelt = [w[i] if i < len(w) else END for w, t in zip(texts, leaves, strict=True) for i in np.flatnonzero(t == escape).tolist()]
        return cls(np.concatenate(leaves) if leaves else np.zeros(0, np.int32), spelt, np.array([len(t) for t in leaves], np.int64))

    @classmethod
    def read(cls, code: Code, words: Words) -> Texts:
        escape, distinct = len(code.index), pa.concat_arrays([words.dictionary, pa.array([END], pa.large_binary())])
        leaf = code.leaves_of(distinct)
        lengths = words.sizes + 1
        numbers = np.full(int(lengths.sum()), len(distinct) - 1)
        inner = np.ones(len(numbers), bool)
        inner[np.cumsum(lengths) - 1] = False
        numbers[inner] = words.numbers
        leaves = leaf[numbers]
        return cls(leaves, distinct.take(pa.array(numbers[leaves == escape])).to_numpy(zero_copy_only=False).tolist(), lengths)

    def cut(self, escape: int, size: int) -> Iterator[tuple[slice, Texts]]:
        """Texts from the first on, as many at once as have about `size` tokens; one at least."""
        ends = np.cumsum(self.lengths)
        escapes = np.concatenate(([0], np.cumsum(self.leaves == escape)))
        a = 0
        while a < len(ends):
            low = int(ends[a] - self.lengths[a])
            z = min(int(np.searchsorted(ends, low + size)) + 1, len(ends))
            high = int(ends[z - 1])
            yield slice(a, z), Texts(self.leaves[low:high], self.spelt[escapes[low] : escapes[high]], self.lengths[a:z])
            a = z

    def places(self) -> np.ndarray:
        return np.arange(len(self.leaves)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)

    def names(self, code: Code) -> np.ndarray:
        """A number for each token: its leaf, or a hash of its spelling above all leaves."""
        out = self.leaves.astype(np.uint32)
        if self.spelt:
            out[self.leaves == len(code.index)] = np.fromiter(map(zlib.crc32, self.spelt), np.uint32, len(self.spelt)) | np.uint32(1 << 31)
        return out


def _before(x: np.ndarray, places: np.ndarray, k: int, none: int) -> np.ndarray:
    """x of k tokens before; `none` where the text has no such token."""
    out = np.full(len(x), none, x.dtype)
    out[k:] = x[:-k] if len(x) > k else x[:0]
    out[places < k] = none
    return out


def contexts_of(names: np.ndarray, places: np.ndarray) -> np.ndarray:
    """For each token a hash of the two tokens before it."""
    wide = names.astype(_U)
    p1, p2 = (_before(wide, places, k, (1 << 33) + k) for k in (1, 2))
    return _mixed(p1 * _U(0x9E3779B97F4A7C15) + p2, 2)


def repeats(names: np.ndarray, two: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each token: 0 if its last two tokens are new in its text, 2 if it is the one that followed them last time, else 1."""
    n = len(two)
    key = (two + np.repeat(np.arange(len(lengths), dtype=_U), lengths)) * _U(0xD6E8FEB86659FD93)
    # sorted by key and then by place, which stands in the lowest bits
    width = _U(max(1, n - 1).bit_length())
    order = (np.sort((key >> width << width) | np.arange(n, dtype=_U)) & ((_U(1) << width) - _U(1))).astype(np.int64)
    again = key[order[1:]] == key[order[:-1]]
    out = np.zeros(n, np.uint8)
    out[order[1:]] = np.where(again, 1 + (names[order[1:]] == names[order[:-1]]), 0)
    return out


def decisions(code: Code, texts: Texts, replies: np.ndarray) -> Coded:
    """All decisions of `texts`; replies: the answer on the successor of each token's context, see `replies_of`."""
    places = texts.places()
    names = texts.names(code)
    n, escape, spell = len(places), len(code.index), len(code.offsets) - 1 - 2 * CANDIDATES - 257
    local = repeats(names, contexts_of(names, places), texts.lengths)
    asked = [local > 0, (replies > 0) & (local != 2)]
    hits = [local == 2, asked[1] & (replies % 2 == 0)]
    hit = hits[0] | hits[1]
    # symbols of each token: candidates, cell, spelling
    spelt = (texts.leaves == escape) & ~hit
    flat = np.zeros(0, np.int64)
    sizes = np.zeros(n, np.int64)
    if texts.spelt:
        words = list(compress(texts.spelt, spelt[texts.leaves == escape].tolist()))
        flat = np.frombuffer(b"\x00".join([*words, b""]), np.uint8).astype(np.int64)
        sizes[spelt] = np.fromiter(map(len, words), np.int64, len(words)) + 1
    many = asked[0].astype(np.int64) + asked[1] + ~hit + sizes
    ends = np.cumsum(many)
    at = ends - many
    symbols = np.zeros(int(ends[-1]) if n else 0, np.int64)
    contexts = np.zeros((ORDERS, len(symbols)), _U)
    kinds = np.full(len(symbols), MATCH, np.int8)
    cells = np.where(texts.leaves == escape, -2, code.cell[texts.leaves])
    p1, p2 = (_before(cells, places, k, -1).astype(_U) for k in (1, 2))
    # the commonest of the last eight tokens tells the language or the matter
    ranks = code.ranks[texts.leaves]
    topic = np.full(n, 1 << 30, np.int32)
    for k in range(1, 9):
        np.minimum(topic, _before(ranks, places, k, 1 << 30), out=topic)
    topic = topic.astype(_U)
    # how many tokens before this one were candidates, at most 3
    streak = np.zeros(n, np.uint8)
    run = np.ones(n, bool)
    for k in range(1, 4):
        run &= _before(hit, places, k, False)
        streak += run
    for k in range(CANDIDATES):
        on = asked[k]
        where, sure = at[on], np.zeros(int(on.sum()), _U) if k == 0 else ((replies[on] - 1) >> 1).astype(_U)
        symbols[where] = spell + 257 + 2 * k + hits[k][on]
        # what was asked before in vain, how well candidates did of late, and how sure this one is
        known = ((asked[0][on].astype(_U) * _U(2) + _U(k)) * _U(4) + streak[on]) * _U(64) + sure
        contexts[0, where], contexts[1, where] = known, topic[on] * _U(1024) + known
        at = at + on
    where = at[~hit]
    symbols[where], kinds[where] = code.cell[texts.leaves[~hit]], TREE
    contexts[0, where], contexts[1, where] = _mixed(topic[~hit], 1), _mixed(p1[~hit] * _U(1 << 10) + p2[~hit] // _U(32), 2)
    if len(flat):
        lengths = sizes[spelt]
        last = np.cumsum(lengths)
        inside = np.arange(len(flat)) - np.repeat(last - lengths, lengths)
        flat[last - 1] = SPELT_END
        where = np.repeat(at[spelt] + 1, lengths) + inside
        symbols[where], kinds[where] = spell + flat, SPELL
        padded = np.concatenate((np.zeros(6, _U), flat.astype(_U)))
        b = [np.where(inside >= k, padded[6 - k : len(padded) - k], _U(300)) for k in range(1, 6)]
        three = (b[0] * _U(512) + b[1]) * _U(512) + b[2]
        contexts[0, where], contexts[1, where] = _mixed(three, 5), _mixed((three * _U(512) + b[3]) * _U(512) + b[4], 6)
    # by step, text and kind
    step = steps_of(places)
    n_steps = int(step.max(initial=-1)) + 1
    text_of = np.repeat(np.arange(len(texts.lengths)), texts.lengths)
    group = np.repeat((step * np.int64(len(texts.lengths)) + text_of) * 3, many) + kinds
    # sorted with the place in the lowest bits
    width = max(1, len(group) - 1).bit_length()
    order = np.sort(group << width | np.arange(len(group))) & ((1 << width) - 1)
    symbols = symbols[order]
    starts = code.offsets.take(symbols).astype(np.int64)
    sizes = code.offsets.take(symbols + 1) - starts
    ends = np.cumsum(sizes)
    path = np.repeat(starts - (ends - sizes), sizes)
    path += np.arange(len(path))
    nodes, salt, place = (x.take(path, mode="clip") for x in (code.nodes, code.salts, code.places))
    slots = np.empty((ORDERS, len(nodes)), np.int64)
    for k in range(ORDERS):
        mixed = np.repeat((contexts[k] * _U(0xD6E8FEB86659FD93 + 2 * k) >> _U(32)).astype(np.uint32)[order], sizes)
        mixed ^= salt
        mixed *= np.uint32(0x85EBCA6B)
        # the line, and in it the place in an order of its own
        mixed >>= np.uint32(32 - BITS)
        np.bitwise_xor(mixed, place, out=slots[k], casting="unsafe")
    static = np.bincount(text_of, np.where(hit, 0.0, code.share[texts.leaves]), len(texts.lengths))
    group = group[order]
    first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))[: len(group)])
    begins = np.concatenate(([0], ends))[first]
    owner, kind = np.divmod(group[first], 3)
    cuts = np.searchsorted(owner // max(1, len(texts.lengths)), np.arange(n_steps + 1))
    return Coded(code.bits.take(path, mode="clip"), nodes, slots, begins, (owner % max(1, len(texts.lengths))).astype(np.int64), kind, cuts, static)


def steps_of(places: np.ndarray) -> np.ndarray:
    """Steps between which a text refines its weights: they end after 8, 16, 32, 64 tokens and then after every 64."""
    return np.where(places < 64, np.searchsorted(np.array([8, 16, 32]), places, side="right"), 3 + places // 64).astype(np.int32)


# Counts are kept in a byte: as they are up to 31, then eight steps for each doubling.
_LEVELS = np.concatenate((np.arange(32), np.round(32 * 2 ** (np.arange(1, 225) / 8)))).astype(np.int64)


def _looked_up() -> np.ndarray:
    """For two such bytes (zeros, ones) the stretched probability of a one, as it is, without one zero and without one one;
    the two lowest bits of the number tell how much was seen."""
    out = np.empty((3, 1 << 16), np.uint32)
    zeros, ones = np.repeat(_LEVELS, 256), np.tile(_LEVELS, 256)
    for k, (a, b) in enumerate(((zeros, ones), (np.maximum(0, zeros - 1), ones), (zeros, np.maximum(0, ones - 1)))):
        seen = np.searchsorted(np.array(SEEN), a + b, side="right").astype(np.uint32)
        out[k] = (np.log((b + 0.4) / (a + 0.4)).astype(np.float32).view(np.uint32) & ~np.uint32(3)) | seen
    return out.ravel()


_STRETCHED = _looked_up()


def packed(counts: np.ndarray) -> np.ndarray:
    """(slots, 2) counts of zeros and ones as two bytes a slot."""
    level = np.searchsorted((_LEVELS[1:] + _LEVELS[:-1]) / 2, counts, side="right").astype(np.uint16)
    return level[:, 0] << np.uint16(8) | level[:, 1]


@dataclass
class Model:
    code: Code
    slots: np.ndarray
    weights: np.ndarray  # (1 + ORDERS, gates)
    shifts: np.ndarray  # corrections: (kinds * BUCKETS)

    @classmethod
    def fresh(cls, code: Code, slots: np.ndarray) -> Model:
        return cls(code, slots, np.repeat(np.array([[0.25]] + [[0.35]] * ORDERS, np.float32), GATES, 1), np.zeros(3 * BUCKETS, np.float32))

    def inputs(self, c: Coded, learned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(inputs, gates) of decisions; where their text was learned from, without the decision itself."""
        x = np.empty((1 + ORDERS, len(c.bits)), np.float32)
        np.take(self.code.prior, c.nodes, out=x[0], mode="clip")
        gate = c.of_runs(c.kinds.astype(np.int8))
        without = c.of_runs(np.where(learned[c.texts], 1 << 16, 0))
        without *= c.bits + np.int8(1)
        for k in range(ORDERS):
            found = x[k + 1].view(np.uint32)
            np.take(_STRETCHED, self.slots.take(c.slots[k], mode="clip") + without, out=found, mode="clip")
            gate *= 4
            gate += (found & np.uint32(3)).view(np.int8)[::4]
        return x, gate

    def scores(self, c: Coded, learned: np.ndarray) -> np.ndarray:
        """log10 probability of each text. The texts are read in step. Each has changes of its own to the weights of each
        kind of decision, and to a constant, which it refines by its errors after each step."""
        n_texts = len(learned)
        x, gate = self.inputs(c, learned)
        own = np.zeros((2 + ORDERS, n_texts * 3), np.float32)
        ends = np.concatenate((c.begins, [len(c.bits)]))
        sizes, runs = np.diff(ends), c.texts * 3 + c.kinds
        pace = (RATE / np.sqrt(sizes)).astype(np.float32)
        # weights stand by kind: those of one run are its kind's and its own changes
        of_kind = self.weights.reshape(1 + ORDERS, 3, -1)
        gate -= c.of_runs((c.kinds * of_kind.shape[2]).astype(np.int8))
        sign, first = 1 - 2 * c.bits.astype(np.float32), _first_buckets(c.kinds)
        losses = np.empty(len(c.bits), np.float32)
        for s in range(len(c.cuts) - 1):
            here = slice(c.cuts[s], c.cuts[s + 1])
            low, high = ends[here.start], ends[here.stop]
            part, run, many, at = slice(low, high), runs[here], sizes[here], ends[here] - low
            xs, signs = x[:, part], sign[part]
            mine = own[:, run]
            weights = (of_kind[:, c.kinds[here]] + mine[:-1, :, None]).reshape(1 + ORDERS, -1)
            index = np.repeat(np.arange(0, weights.shape[1], of_kind.shape[2]), many)
            index += gate[part]
            z, _ = _mix(weights, self.shifts, xs, index, np.repeat(first[here], many), np.repeat(mine[-1], many))
            z *= signs
            odds = np.exp(z, out=z)  # of the other outcome
            whole = odds + np.float32(1)
            np.log(whole, out=losses[part])
            if s + 2 < len(c.cuts):
                error = np.divide(odds, whole, out=whole)
                error *= signs
                for k in range(1 + ORDERS):
                    own[k, run] = mine[k] - pace[here] * np.add.reduceat(np.multiply(error, xs[k], out=odds), at)
                own[-1, run] = mine[-1] - pace[here] * np.add.reduceat(error, at)
        out = -np.bincount(c.texts, np.add.reduceat(losses, c.begins, dtype=float), n_texts) if len(c.begins) else np.zeros(n_texts)
        return (out + c.static) / np.log(10)


_LEAST, _MOST = np.float32(-(BUCKETS // 2)), np.float32(BUCKETS // 2)


def _first_buckets(kinds: np.ndarray) -> np.ndarray:
    """Middle of the buckets of each kind."""
    return (kinds * BUCKETS + BUCKETS // 2).astype(np.float32)


def _mix(weights: np.ndarray, shifts: np.ndarray, x: np.ndarray, gate: np.ndarray, first: np.ndarray, constant: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(stretched probability, bucket of its correction) of decisions; weights[:, gate] are theirs."""
    z = np.zeros(len(gate), np.float32) if constant is None else constant
    for k in range(1 + ORDERS):
        w = weights[k].take(gate, mode="clip")
        w *= x[k]
        z += w
    near = z * np.float32(1.5)
    np.clip(near, _LEAST, _MOST, out=near)
    np.rint(near, out=near)
    near += first
    bucket = near.astype(np.int64)
    z += shifts.take(bucket, mode="clip")
    return np.clip(z, _LEAST, _MOST, out=z), bucket


class Gathered:
    """What a task gathers from training texts, online: each lot of decisions is predicted from the counts so far, weights
    and corrections are refined by the errors after every LEARN of them, and then the lot is counted."""

    def __init__(self, code: Code):
        self.model = Model.fresh(code, np.zeros(0, np.uint16))
        self.pairs = np.zeros(1 << BITS, np.int64)  # of each slot the zeros in the lower half, the ones in the upper half
        self.memory, self.met, self.hits = np.full(self.model.weights.shape, 1e-6), np.zeros(GATES), np.zeros(3 * BUCKETS)

    def add(self, c: Coded) -> None:
        m = self.model
        x = np.empty((1 + ORDERS, len(c.bits)), np.float32)
        np.take(m.code.prior, c.nodes, out=x[0], mode="clip")
        gate, buckets = c.of_runs(c.kinds.astype(np.int8)), c.of_runs(_first_buckets(c.kinds))
        for k in range(ORDERS):
            pair = self.pairs.take(c.slots[k], mode="clip").view(np.uint32).astype(np.float32)
            zeros, ones = pair[::2], pair[1::2]
            seen = zeros + ones
            gate *= 4
            for least in SEEN:
                gate += (seen >= least).view(np.int8)
            pair += np.float32(0.4)
            np.log(np.divide(ones, zeros, out=seen), out=x[k + 1])
        for at in range(0, len(c.bits), LEARN):
            part = slice(at, at + LEARN)
            g, xs = gate[part].astype(np.int64), x[:, part]
            z, bucket = _mix(m.weights, m.shifts, xs, g, buckets[part])
            p = 1 / (1 + np.exp(-z))
            error = c.bits[part] - p
            much = np.bincount(g, minlength=GATES)
            slope = np.stack([np.bincount(g, error * v, GATES) for v in xs]) / np.maximum(1, much)
            self.memory += slope * slope
            m.weights += (0.2 * slope / np.sqrt(self.memory)).astype(np.float32)
            m.shifts += (np.bincount(bucket, error, 3 * BUCKETS) / (np.bincount(bucket, p - p * p, 3 * BUCKETS) + 500)).astype(np.float32)
            self.met += much
            self.hits += np.bincount(bucket, minlength=3 * BUCKETS)
        one = np.array([1, 1 << 32]).take(c.bits)
        for k in range(ORDERS):
            np.add.at(self.pairs, c.slots[k], one)

    @property
    def counts(self) -> np.ndarray:
        """(slots, 2): zeros and ones."""
        return self.pairs.view(np.uint32).reshape(-1, 2)


def events_of(texts: Texts, code: Code, learned: np.ndarray, n_ranges: int) -> tuple[np.ndarray, ...]:
    """(ranges, contexts, chains, training counts, places of the kept contexts, event of each): the distinct events of a
    batch in the order of their contexts. A chain is CHAIN tokens from the context on, 16 bits of a hash for each. Events of
    training texts and of others are told apart by their count, which is zero for the latter. Contexts have 40 bits."""
    names = texts.names(code)
    places = texts.places()
    two = contexts_of(names, places)
    at = np.flatnonzero(two % _U(SPARSE) == 0)
    short = (_mixed(names.astype(_U), 7) >> _U(48)).astype(_U)
    left = np.repeat(texts.lengths, texts.lengths) - places
    padded = np.concatenate((short, np.zeros(CHAIN, _U)))
    chain = np.zeros(len(at), _U)
    for k in range(CHAIN):
        chain = chain << _U(16) | np.where(left[at] > k, padded[at + k], _U(0))
    two, train = two[at], np.repeat(learned, texts.lengths)[at]
    # 40 bits of the context come first; the rest of the number only brings equal events together
    rest = _mixed(chain + train, 5)
    order = np.argsort((two >> _U(24) << _U(24)) | rest >> _U(40))
    two, chain, train = (two >> _U(24))[order], chain[order], train[order]
    new = np.ones(len(order), bool)
    new[1:] = (two[1:] != two[:-1]) | (chain[1:] != chain[:-1]) | (train[1:] != train[:-1])
    start = np.flatnonzero(new)
    back = np.empty(len(order), np.int64)
    back[order] = np.cumsum(new) - 1
    count = np.diff(np.concatenate((start, [len(order)])))
    ranges = (two[start] * _U(n_ranges) >> _U(40)).astype(np.int64)
    return ranges, two[start], chain[start], np.where(train[start], count, 0).astype(np.uint32), at, back


def replies_of(said: np.ndarray, at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each token what is known of its candidate: 0 if there is none, else 1 + hit + 2 * (how sure, and how far behind
    its context). said: the answers on the contexts at the places `at`. A chain serves tokens up to the first one that
    differs; that of the nearest context goes first."""
    out = np.zeros(int(lengths.sum()) + CHAIN, np.uint8)
    some = said > 0
    agree, sure, where = (said[some] - 1) % (CHAIN + 1), (said[some] - 1) // (CHAIN + 1), at[some]
    ends = np.repeat(np.cumsum(lengths), lengths)[where]
    for k in reversed(range(CHAIN)):
        on = (agree >= k) & (where + k < ends)
        out[where[on] + k] = 1 + (agree[on] > k) + 2 * (sure[on] * 2 + (k > 0))
    return out[: len(out) - CHAIN]


def _planes(x: np.ndarray, width: int = 0) -> bytes:
    """The `width` low bytes of all numbers (0: all), most significant ones first, so that runs of equal bytes compress."""
    bytes_ = x[:, None].view(np.uint8).T[::-1]
    return np.ascontiguousarray(bytes_[-width:] if width else bytes_).tobytes()


def _unplanes(data: bytes | np.ndarray, dtype: type, n: int) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(-1, n) if n and isinstance(data, bytes) else data if n else np.zeros((1, 0), np.uint8)
    out = np.zeros((n, np.dtype(dtype).itemsize), np.uint8)
    out[:, : len(planes)] = planes[::-1].T
    return out.view(dtype).ravel()


def _shrunk(data: bytes) -> bytes:
    return _CODEC.compress(data, asbytes=True)


def _grown(data: bytes, size: int) -> bytes:
    return _CODEC.decompress(data, size, asbytes=True)


def _hash32(x: np.ndarray) -> np.ndarray:
    return _mixed(x, 4) >> _U(32)


def answers(two: np.ndarray, chains: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One byte for each event (context, chain, training count; zero: not learned from): 0 if its context has no other chain
    in training, else 1 + tokens of the commonest one that agree from the first on + (CHAIN + 1) * (how sure: by count, and
    whether there is no other). The event itself is taken out of its own count. Ties go to the smaller hash."""
    key = _hash32(two) << _U(32) | _hash32(chains)
    order = np.argsort(key)
    key, own, chain = key[order], counts[order] > 0, chains[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    first = np.flatnonzero(new)
    if not len(first):
        return np.zeros(0, np.uint8)
    pair_n, pair, pair_chain = np.add.reduceat(counts[order].astype(np.int64), first), key[first], chain[first]
    new_group = np.ones(len(pair), bool)
    new_group[1:] = (pair[1:] ^ pair[:-1]) >> _U(32) != 0
    starts, group = np.flatnonzero(new_group), np.cumsum(new_group) - 1
    # count and hash in one number: the largest is the commonest chain, with ties to the smaller hash
    value = np.minimum(pair_n, (1 << 31) - 1).astype(_U) << _U(32) | (pair & _U(0xFFFFFFFF)) ^ _U(0xFFFFFFFF)
    best = np.maximum.reduceat(value, starts)
    at_best = np.flatnonzero(value == best[group])
    value[at_best] = 0
    second = np.maximum.reduceat(value, starts)
    at_second = starts.copy()
    is_second = np.flatnonzero(value == second[group])
    at_second[group[is_second]] = is_second
    total = np.add.reduceat(pair_n, starts)
    mine = np.cumsum(new) - 1
    of = group[mine]
    left = np.where(own & (at_best[of] == mine), best[of] - _U(1 << 32), best[of])
    other = second[of] > left
    n = (np.maximum(left, second[of]) >> _U(32)).astype(np.int64)
    differs = pair_chain[np.where(other, at_second[of], at_best[of])] ^ chain
    agree = sum((differs >> _U(16 * k) == 0).astype(np.int64) for k in range(CHAIN))
    sure = np.array([0, 0, 2, 4, 4, 4, 6])[np.minimum(n, 6)] + (n == total[of] - own)
    out = np.empty(len(key), np.uint8)
    out[order] = np.where(n > 0, 1 + agree + (CHAIN + 1) * sure, 0)
    return out


def count_tokens(train: DataFrame) -> DataFrame:
    """(token, n) of all tokens of `train` (text), ends included as the empty token. Counted within tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        schema = pa.schema([("token", pa.binary()), ("n", pa.int64())])
        for b in batches:
            for at in range(0, b.num_rows, READ):
                texts = b.column(0).slice(at, READ)
                held += [Words.of(texts).counts(), _counted(pa.array([END], pa.large_binary()), [len(texts)])]
                if sum(x.num_rows for x in held) >= COUNTED:
                    held = [_summed(held)]
                    if held[0].num_rows >= COUNTED // 2:
                        yield from held.pop().cast(schema).to_batches()
        if held:
            yield from _summed(held).cast(schema).to_batches()

    return train.select("text").mapInArrow(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


def _counted(tokens: pa.Array, counts: np.ndarray | list[int]) -> pa.Table:
    return pa.table({"token": tokens, "n": pa.array(counts, pa.int64())})


def _summed(counts: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(counts).group_by("token", use_threads=False).aggregate([("n", "sum")]).rename_columns(["token", "n"])


def _batches(batches: Iterator[pa.RecordBatch], text: int, code: Code) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Rows with the tokens of their texts, about BATCH tokens at once; a batch holds a row at least."""
    for b in batches:
        for at in range(0, b.num_rows, READ):
            part = b.slice(at, READ)
            for rows, texts in Texts.read(code, Words.of(part.column(text))).cut(len(code.index), BATCH):
                yield part.slice(rows.start, rows.stop - rows.start), texts


def encoded(docs: DataFrame, code: Code, n_ranges: int) -> DataFrame:
    """doc_id, held_out, learned, bytes, tokens, leaves, spelt and replies of each row of docs (doc_id, held_out, learned, text):
    what scoring needs. A task sends the events of its batches, which are answered by range; the answers meet the batches'
    texts. Batches are known by their partition and number, which are the same whenever a task is run again."""
    shared = docs.sparkSession.sparkContext.broadcast(code)
    kind = dict(docs.dtypes)["doc_id"]

    def events(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, first = shared.value, TaskContext.get().partitionId() << 32
        for i, (rows, these) in enumerate(_batches(batches, 3, known)):
            ranges, two, chains, counts, *_ = events_of(these, known, np.array(rows.column(2).to_pylist(), bool), n_ranges)
            numbers, starts = np.unique(ranges, return_index=True)
            edges = [*starts, len(ranges)]
            parts = [slice(a, b) for a, b in zip(edges, edges[1:])]
            packs = [_planes(np.diff(two[p], prepend=_U(0)), 5) + _planes(chains[p], 2 * CHAIN) for p in parts]
            yield pa.RecordBatch.from_arrays([pa.array(numbers), pa.array([first + i] * len(parts), pa.int64()), pa.array(packs, pa.binary()), pa.array([_planes(counts[p]) for p in parts], pa.binary())], ["range", "batch", "events", "counts"])

    def answer(group: pa.Table) -> pa.Table:
        blobs = group.column("counts").to_pylist()
        sizes = [len(x) // 4 for x in blobs]
        counts = np.concatenate([_unplanes(x, np.uint32, n) for x, n in zip(blobs, sizes, strict=True)])
        packs = group.column("events").to_pylist()
        two = np.concatenate([np.cumsum(_unplanes(x[: 5 * n], _U, n), dtype=_U) for x, n in zip(packs, sizes, strict=True)])
        chains = np.concatenate([_unplanes(x[5 * n :], _U, n) for x, n in zip(packs, sizes, strict=True)])
        found = answers(two, chains, counts)
        cuts = np.concatenate(([0], np.cumsum(sizes)))
        return pa.table({"batch": group.column("batch"), "range": group.column("range"), "replies": pa.array([zlib.compress(found[x:y].tobytes(), 1) for x, y in zip(cuts, cuts[1:])], pa.binary())})

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, first = shared.value, TaskContext.get().partitionId() << 32
        names = ["batch", "place", "doc_id", "held_out", "learned", "bytes", "tokens", "leaves", "spelt"]
        seldom = np.argsort(known.by_rank).astype(np.int32)
        for i, (rows, these) in enumerate(_batches(batches, 3, known)):
            n = rows.num_rows
            ranks = seldom[these.leaves]
            cuts = np.concatenate(([0], np.cumsum(these.lengths)))
            escapes = np.concatenate(([0], np.cumsum(these.leaves == len(known.index))))[cuts]
            leaves = [_shrunk(_planes(ranks[a:b], 3)) for a, b in zip(cuts, cuts[1:])]
            spelt = [zlib.compress(b" ".join(these.spelt[a:b]), 1) for a, b in zip(escapes, escapes[1:])]
            sizes = pc.fill_null(pc.binary_length(rows.column(3)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([first + i] * n, pa.int64()), pa.array(range(n), pa.int32()), rows.column(0), rows.column(1), rows.column(2), sizes, pa.array(these.lengths, pa.int64()), pa.array(leaves, pa.binary()), pa.array(spelt, pa.binary())], names)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        known = shared.value
        left, right = left.sort_by("place"), right.sort_by("range")
        these = _texts(known, left)
        *_, at, back = events_of(these, known, np.array(left.column("learned").to_pylist(), bool), n_ranges)
        said = [np.frombuffer(zlib.decompress(x), np.uint8) for x in right.column("replies").to_pylist()]
        replies = replies_of(np.concatenate(said)[back] if said else np.zeros(0, np.uint8), at, these.lengths)
        cuts = np.concatenate(([0], np.cumsum(these.lengths)))
        packs = [_shrunk(replies[x:y].tobytes()) for x, y in zip(cuts, cuts[1:])]
        batch = np.array(left.column("batch"))
        numbers = batch >> 32 << 40 | (batch & 0xFFFFFFFF) << 20 | np.array(left.column("place"))
        return left.select(["doc_id", "held_out", "learned", "bytes", "tokens", "leaves", "spelt"]).append_column("replies", pa.array(packs, pa.binary())).append_column("row", pa.array(numbers, pa.int64()))

    asked = docs.mapInArrow(events, "range long, batch long, events binary, counts binary")
    replied = asked.groupBy("range").applyInArrow(answer, "batch long, range long, replies binary")
    rows = docs.mapInArrow(texts, f"batch long, place int, doc_id {kind}, held_out boolean, learned boolean, bytes long, tokens long, leaves binary, spelt binary")
    return rows.groupBy("batch").cogroup(replied.groupBy("batch")).applyInArrow(meet, f"doc_id {kind}, held_out boolean, learned boolean, bytes long, tokens long, leaves binary, spelt binary, replies binary, row long")


def _texts(code: Code, rows: pa.Table | pa.RecordBatch) -> Texts:
    """Texts of rows of `encoded`."""
    lengths = np.array(rows.column("tokens").to_pylist(), np.int64)
    blobs = [_grown(x, 3 * n) for x, n in zip(rows.column("leaves").to_pylist(), lengths.tolist(), strict=True)]
    ranks = _unplanes(np.concatenate([np.frombuffer(x, np.uint8).reshape(3, -1) for x in blobs], 1), np.int32, int(lengths.sum())) if blobs else np.zeros(0, np.int32)
    leaves = code.by_rank[ranks]
    spelt: list[bytes] = []
    escapes = np.bincount(np.repeat(np.arange(len(lengths)), lengths), leaves == len(code.index), len(lengths))
    for x in compress(rows.column("spelt").to_pylist(), escapes.tolist()):
        spelt += zlib.decompress(x).split(b" ")
    return Texts(leaves, spelt, lengths)


def _some(code: Code, rows: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, Texts, Coded]]:
    """Rows of `encoded` with their texts and decisions, about HELD tokens at once."""
    sizes = rows.column("tokens").to_pylist()
    start, held = 0, 0
    for i, size in enumerate(sizes):
        held += size
        if held >= HELD or i + 1 == len(sizes):
            part = rows.slice(start, i + 1 - start)
            texts = _texts(code, part)
            replies = np.concatenate([np.frombuffer(_grown(x, n), np.uint8) for x, n in zip(part.column("replies").to_pylist(), sizes[start : i + 1], strict=True)])
            yield part, texts, decisions(code, texts, replies)
            start, held = i + 1, 0


def _model(train: DataFrame, code: Code) -> Model:
    """Slots, weights and corrections from all of `train`, in one online pass. Tasks send their counts in chunks, which are
    summed in three steps of 64 at most; the driver gets the finished chunks. Of each gate's weights and each bucket's
    correction the mean of the tasks is taken, by how many decisions they met; those that none met stay as they are."""
    size = 1 << BITS
    shared = train.sparkSession.sparkContext.broadcast(code)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = Gathered(shared.value)
        for b in batches:
            for _, _, c in _some(mine.model.code, b):
                mine.add(c)
        chunks = mine.counts.reshape(-1, 2 * CHUNK)
        part = TaskContext.get().partitionId() // 64
        for i in np.flatnonzero(chunks.any(1)).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([part], pa.int32()), pa.array([zlib.compress(_planes(chunks[i]), 1)], pa.binary())], ["chunk", "part", "sums"])
        if mine.met.any():
            learned = np.concatenate((mine.met, mine.hits, (mine.model.weights * mine.met).ravel(), mine.model.shifts * mine.hits))
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([part], pa.int32()), pa.array([learned.tobytes()], pa.binary())], ["chunk", "part", "sums"])

    def add(group: pa.Table) -> pa.Table:
        blobs = group.column("sums").to_pylist()
        if group.column("chunk")[0].as_py() < 0:
            total = np.sum([np.frombuffer(x) for x in blobs], 0).tobytes()
        else:
            counts = np.zeros(2 * CHUNK, np.int64)
            for x in blobs:
                counts += _unplanes(zlib.decompress(x), np.uint32, 2 * CHUNK)
            total = zlib.compress(_planes(np.minimum(counts, 2**32 - 1).astype(np.uint32)), 1)
        return pa.table({"chunk": group.column("chunk").slice(0, 1), "part": pa.array([group.column("part")[0].as_py() // 64], pa.int32()), "sums": pa.array([total], pa.binary())})

    parts = train.mapInArrow(run, "chunk int, part int, sums binary")
    for keys in (("chunk", "part"), ("chunk", "part"), ("chunk",)):
        parts = parts.groupBy(*keys).applyInArrow(add, parts.schema)
    model = Model.fresh(code, np.zeros(size, np.uint16))
    for row in parts.toLocalIterator():
        if row.chunk >= 0:
            model.slots[row.chunk * CHUNK : (row.chunk + 1) * CHUNK] = packed(_unplanes(zlib.decompress(bytes(row.sums)), np.uint32, 2 * CHUNK).reshape(-1, 2))
            continue
        met, hits, weights, shifts = np.split(np.frombuffer(bytes(row.sums)), np.cumsum([GATES, 3 * BUCKETS, GATES * (1 + ORDERS)]))
        model.weights = np.where(met > 0, weights.reshape(1 + ORDERS, GATES) / np.maximum(1, met), model.weights).astype(np.float32)
        model.shifts = np.where(hits > 0, shifts / np.maximum(1, hits), model.shifts).astype(np.float32)
    return model


def score(docs: DataFrame, learn_from: Column | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte of each row of `docs`.

    `learn_from` (default: not held out) chooses the training rows. base_score adds up log10((c + 0.5) / (N + 0.5 (V + 1)))
    over the text's tokens, its end included; score is the model's log10 probability of the text. Null texts are empty and
    have their end alone; very long texts are read whole, by one task; repeated rows count as often as they stand there;
    rows of null id are trained on; an empty table gives no rows; other columns are ignored. With nothing to learn from, all
    counts are zero."""
    learn = ~held_out(F.col("doc_id")) if learn_from is None else F.coalesce(learn_from, F.lit(False))
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), learn.alias("learned"), "text")
    counts = checkpointed(count_tokens(rows.filter("learned")))
    said = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("*").alias("distinct")).first()
    total, distinct = said["total"], said["distinct"]
    # the least count of 2 or more at which no more than HEAD tokens are left, from a histogram of magnitudes
    level = F.floor(F.log2("n") * 4)
    levels = {r["level"]: r["count"] for r in counts.filter("n > 1").groupBy(level.alias("level")).count().collect()}
    kept, least = 0, 1 << 62
    for k in sorted(levels, reverse=True):
        kept += levels[k]
        if kept > HEAD:
            break
        least = k
    frequent = ((level >= least) & (F.col("n") > 1)) | (F.length("token") == 0)
    found = counts.filter(frequent).select("token", "n").toArrow()
    head = sorted(zip(found.column("token").to_pylist(), found.column("n").to_pylist(), strict=True))
    del found
    rare = counts.filter(~frequent)

    def byte_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(257, np.int64)
        for b in batches:
            words = b.column(0).to_pylist()
            seen[:256] += np.bincount(np.frombuffer(b"".join(words), np.uint8), minlength=256)
            seen[SPELT_END] += len(words)
        yield pa.RecordBatch.from_arrays([pa.array([seen.tolist()], pa.list_(pa.int64()))], ["seen"])

    spelt = np.zeros(257, np.int64)
    for r in rare.select("token").mapInArrow(byte_counts, "seen array<long>").toLocalIterator():
        spelt += np.array(r.seen)
    code = Code.of(head, total - sum(n for _, n in head), spelt)
    coded = checkpointed(encoded(rows, code, 1 + total // RANGE))
    return _scored(coded, _model(coded.filter("learned"), code), dict(head), rare, total, distinct)


def _scored(coded: DataFrame, model: Model, head: dict[bytes, int], rare: DataFrame, total: int, distinct: int) -> DataFrame:
    logs = np.zeros(len(model.code.index) + 1)
    for w, i in model.code.index.items():
        logs[i] = np.log10(head[w] + 0.5)
    shared = coded.sparkSession.sparkContext.broadcast((model, logs))
    kind = dict(coded.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lm, log_of = shared.value
        escape = len(log_of) - 1
        for b in batches:
            for part, texts, c in _some(lm.code, b):
                found = lm.scores(c, np.array(part.column("learned").to_pylist(), bool))
                of = np.repeat(np.arange(len(texts.lengths)), texts.lengths)
                known = np.bincount(of, texts.leaves != escape, len(texts.lengths)).astype(np.int64)
                sums = np.bincount(of, log_of[texts.leaves], len(texts.lengths))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(texts.lengths), pa.array(known), pa.array(sums), pa.array(found), part.column("bytes"), part.column("row")],
                    ["doc_id", "held_out", "n_tokens", "head_known", "head_sum", "score", "bytes", "row"],
                )

    first = coded.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, head_known long, head_sum double, score double, bytes long, row long")
    # rare and unknown tokens meet their counts by a shuffle; those of one text are added up before they come back
    def spellings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            numbers, words, times = [], [], []
            for row, spelt in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                counts = Counter(w for w in zlib.decompress(spelt).split(b" ") if w)
                numbers += [row] * len(counts)
                words += counts.keys()
                times += counts.values()
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(words, pa.binary()), pa.array(times, pa.int64())], ["row", "token", "times"])

    met = coded.select("row", "spelt").mapInArrow(spellings, "row long, token binary, times long").join(rare, "token", "left")
    sums = met.groupBy("row").agg(F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.5))).alias("tail_sum"), F.coalesce(F.sum(F.when(F.col("n").isNotNull(), F.col("times"))), F.lit(0)).alias("tail_known"), F.sum("times").alias("tail_tokens"))
    rows = first.join(sums, "row", "left")
    # an end that was never learned is the only token that is neither in the head nor in the tail
    lost = F.col("n_tokens") - F.col("head_known") - F.coalesce("tail_tokens", F.lit(0))
    base = F.col("head_sum") + F.coalesce("tail_sum", F.lit(0.0)) + lost * float(np.log10(0.5)) - F.col("n_tokens") * float(np.log10(total + 0.5 * (distinct + 1)))
    return rows.select(
        "doc_id", "held_out", "n_tokens", (F.col("head_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), "score",
        F.when(F.col("bytes") > 0, -F.col("score") * float(np.log2(10)) / F.col("bytes")).alias("bits_per_byte"),
    )
