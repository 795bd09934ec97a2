"""Benchmark decontamination by template canonicalisation.

Numbers, units and names are replaced by typed placeholders; windows of five template words of the benchmark are looked
up in the documents' windows by a hash join. Matching windows keep the values in their slots. Of an occurrence (windows at
one offset between document and item) those count that hold the item's own values, and those whose names and units go to
the values that they have throughout the occurrence: so a question with other numbers or names is caught, and so is a copy
with one name edited, while templates that merely look alike are not.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, small_batches, unused

WINDOW = 5
SHARE = 0.8
#: The filters of benchmark windows and of pieces that go to every task have about 16 bits for each, 2**20 at least and 2**28 (32 MB) at most.
LEAST_BITS, MOST_BITS = 20, 28
#: Distinct words, and characters in them, that a worker remembers before it starts anew.
WORDS_KEPT, CHARACTERS_KEPT = 100_000, 4_000_000

# Units of measure and currency signs, as they are written after or before numbers.
UNITS = frozenset("""
% ° $ € £ ¥ mm cm m km in ft yd mi mile miles inch inches foot feet yard yards meter meters metre metres kilometer
kilometers mg g kg t lb lbs oz gram grams kilogram kilograms ton tons pound pounds ounce ounces ml cl l liter liters
litre litres gallon gallons s sec secs min mins h hr hrs second seconds minute minutes hour hours day days week weeks
month months year years km/h mph m/s hz khz mhz ghz w kw mw wh kwh v a j kj cal kcal pa kpa bar psi b kb mb gb tb
dollar dollars euro euros cent cents usd eur gbp percent degree degrees celsius fahrenheit
""".split())  # fmt: skip

_PIECE = re.compile(r"[+-]?\d+(?:[.,:/]\d+)*|[^\W\d_]+(?:['’/-][^\W\d_]+)*|[%°$€£¥]")
_END = re.compile(r"[.!?:;|\n][\"')\]]*$")
_NUMBER, _UNIT, _NAME = "\x00number", "\x00unit", "\x00name"


def canonical(word: str, starts: bool, after_number: bool) -> list[tuple[str, str]]:
    """The template pieces of a word between spaces, each with its value. A capitalised piece is a name unless it starts a
    sentence or the whole word is in capitals; a unit counts as one only next to a number."""
    pieces = _PIECE.findall(word)
    numbers = [p[-1].isdigit() for p in pieces]
    out = []
    for i, p in enumerate(pieces):
        lower = p.lower()
        if numbers[i]:
            out.append((_NUMBER, p))
        elif lower in UNITS and (len(lower) == 1 and not lower.isalpha() or (numbers[i - 1] if i else after_number)):
            out.append((_UNIT, lower))
        elif p[0].isupper() and not starts and not (len(p) > 1 and p.isupper()):
            out.append((_NAME, lower))
        else:
            out.append((lower, ""))
        starts = False
    return out


MID, START, AFTER_NUMBER = 0, 1, 2
_NAME_HASH = xxhash.xxh64_intdigest(_NAME)
_LINE = "\x00"


class Words(dict):
    """Word -> number. For each number: the hash of its first piece in each context (the only one that a context changes),
    its other pieces' hashes, and what it does to the next word's context. Kept from one task to the next."""

    def __init__(self):
        super().__init__()
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.firsts = np.zeros((0, 3), np.uint64)
        self.flags = np.zeros((0, 3), np.int64)  # pieces, ends a sentence, ends in a number
        self.offsets = np.zeros(0, np.int64)
        self.others = np.zeros(0, np.uint64)
        self.n_others = 0
        self.new: list[tuple] = []
        self.new_others: list[int] = []
        self.characters = 0
        self[_LINE] = 0
        self.new.append((0, 0, 0, 0, 1, 0, 0))

    def __missing__(self, word: str) -> int:
        number = len(self)
        self.characters += len(word)
        core = word.rstrip(".,;:!?")
        if core.isalpha() and (lower := core.lower()) not in UNITS:
            # most words: one piece of letters, as `canonical` would find it
            own = xxhash.xxh64_intdigest(lower)
            mid = _NAME_HASH if core[0].isupper() and not (len(core) > 1 and core.isupper()) else own
            self.new.append((mid, own, mid, 1, len(core) < len(word) and word[-1] != ",", 0, 0))
            self[word] = number
            return number
        found = canonical(word, False, False)
        if found:
            mid = xxhash.xxh64_intdigest(found[0][0])
            variants = [mid, mid, mid]
            if found[0][0] == _NAME or found[0][0].isalpha():
                for context in (START, AFTER_NUMBER):
                    kind = canonical(word, context == START, context == AFTER_NUMBER)[0][0]
                    variants[context] = mid if kind == found[0][0] else xxhash.xxh64_intdigest(kind)
            at = self.n_others + len(self.new_others)
            self.new_others += [xxhash.xxh64_intdigest(t) for t, _ in found[1:]]
            self.new.append((*variants, len(found), bool(_END.search(word)), found[-1][0] == _NUMBER, at))
        else:
            self.new.append((0, 0, 0, 0, bool(_END.search(word)), 0, 0))
        self[word] = number
        return number

    def settle(self) -> None:
        """Move what was learned into the arrays, which grow by doubling."""
        if self.new:
            n = len(self)
            if n > len(self.firsts):
                self.firsts, self.flags, self.offsets = (np.resize(x, (2 * n, *x.shape[1:])) if len(x) else np.zeros((2 * n, *x.shape[1:]), x.dtype) for x in (self.firsts, self.flags, self.offsets))
            rows = slice(n - len(self.new), n)
            self.firsts[rows] = np.array([r[:3] for r in self.new], np.uint64)
            self.flags[rows] = np.array([r[3:6] for r in self.new], np.int64)
            self.offsets[rows] = np.array([r[6] for r in self.new], np.int64)
            self.new = []
        if self.new_others:
            end = self.n_others + len(self.new_others)
            if end > len(self.others):
                self.others = np.concatenate((self.others, np.zeros(end, np.uint64)))
            self.others[self.n_others : end] = self.new_others
            self.n_others, self.new_others = end, []


_WORDS: list[Words] = []


class Templates:
    """Window hashes of texts. Positions in a text count template pieces."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.words = _WORDS[0] if _WORDS else Words()
        _WORDS[:] = [self.words]
        self.powers = np.array([pow(0x9E3779B97F4A7C15, i, 1 << 64) for i in range(window)], np.uint64)

    def read(self, texts: list[str | None], starts: bool = True) -> list[tuple[list[str], np.ndarray, np.ndarray]]:
        """For each text its words, their contexts, and the hashes of its pieces. `starts`: whether it begins a sentence."""
        split = [(t or "").replace("\n", f" {_LINE} ").split() for t in texts]
        if len(self.words) > WORDS_KEPT or self.words.characters > CHARACTERS_KEPT:
            self.words.reset()
        get = self.words.__getitem__
        numbers = [np.fromiter(map(get, w), np.int64, len(w)) for w in split]
        w = self.words
        w.settle()
        out = []
        for words, n in zip(split, numbers, strict=True):
            pieces, ends, number = w.flags[n].T
            context = np.zeros(len(n), np.int64)
            context[1:] = np.where(ends[:-1] == 1, START, np.where(number[:-1] == 1, AFTER_NUMBER, MID))
            if len(n) and starts:
                context[0] = START
            first = w.firsts[n, context]
            if len(n) and pieces.max() > 1:
                total = np.cumsum(pieces)
                h = np.zeros(int(total[-1]), np.uint64)
                heads = (total - pieces)[pieces > 0]
                h[heads] = first[pieces > 0]
                many = np.flatnonzero(pieces > 1)
                rest = pieces[many] - 1
                ramp = np.arange(int(rest.sum())) - np.repeat(np.cumsum(rest) - rest, rest)
                h[np.repeat((total - pieces)[many] + 1, rest) + ramp] = w.others[np.repeat(w.offsets[n[many]], rest) + ramp]
            else:
                h = first[pieces > 0]
            out.append((words, context, h))
        return out

    def windows(self, h: np.ndarray) -> np.ndarray:
        """One hash for each window; a text of fewer pieces is one window, one without pieces has none."""
        if not len(h):
            return h
        k = min(self.window, len(h))
        out = np.zeros(len(h) - k + 1, np.uint64)
        for i in range(k):
            out += h[i : i + len(out)] * self.powers[i]
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        return out ^ (out >> np.uint64(32)) ^ np.uint64(k)

    def hashes(self, text: str | None, starts: bool = True) -> np.ndarray:
        return self.windows(self.read([text], starts)[0][2])

    def slots(self, words: list[str], context: np.ndarray, positions: list[int]) -> list[list[str]]:
        """The values of the pieces of each window, empty for literal words."""
        pieces = self.words.flags[[self.words[x] for x in words], 0]
        owner = np.repeat(np.arange(len(words)), pieces)
        firsts = np.cumsum(pieces) - pieces
        known: dict[int, list[str]] = {}
        out = []
        for p in positions:
            values = []
            for i in range(p, min(p + self.window, len(owner))):
                k = int(owner[i])
                if k not in known:
                    known[k] = [v for _, v in canonical(words[k], context[k] == START, context[k] == AFTER_NUMBER)]
                values.append(known[k][i - firsts[k]])
            out.append(values)
        return out


# Bytes of UTF-8 by what they can be in a template. Letters are those of ASCII and of Latin-1 (0xC3 and what follows it);
# what stands in no set, like other leading bytes, may be anything.
_SPACES, _LOW, _STOPS = b"\t\n\v\f\r\x1c\x1d\x1e\x1f ", bytes(range(97, 123)), b".,;:!?"
_LATIN, _LATIN_CAPITALS = bytes([0xC3, *range(0x9F, 0xB7), *range(0xB8, 0xC0)]), bytes([*range(0x80, 0x97), *range(0x98, 0x9F)])


_STOP, _CAPITAL, _ODD, _LETTER, _DIGIT, _ONE = (1 << i for i in range(6))
#: Letters and digits begin a piece where none of their kind goes before; what is _ONE is a piece or less by itself.
_KINDS = np.zeros(256, np.uint8)
for _kind, _members in (
    (_STOP, _STOPS), (_CAPITAL, _LOW.upper() + _LATIN_CAPITALS), (_LETTER, _LOW + _LOW.upper() + _LATIN + _LATIN_CAPITALS), (_DIGIT, b"0123456789"),
    (_ONE, b"%$" + bytes(range(0xC0, 0xC3)) + bytes(range(0xC4, 0x100))), (_ODD, bytes(set(range(256)).difference(_SPACES, _STOPS, _LOW, _LOW.upper(), _LATIN, _LATIN_CAPITALS))),
):
    _KINDS[list(_members)] |= _kind
_KINDS = _KINDS.tobytes()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _keys(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Hashes of words: of their first and last eight bytes and their length. `data` has eight bytes more than the words."""
    eight = np.ndarray(len(data) - 7, "<u8", data, 0, (1,))
    short = np.minimum(lengths, 8).astype(np.uint64)
    head = eight[starts] << (np.uint64(64) - np.uint64(8) * np.maximum(short, np.uint64(1)))
    tail = eight[starts + np.maximum(lengths - 8, 0)]
    return _mixed(_mixed(head) + np.where(lengths > 8, tail, np.uint64(0)) * np.uint64(0x9E3779B97F4A7C15) + lengths.astype(np.uint64))


def _pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _mixed(a * np.uint64(0xD6E8FEB86659FD93) + b)


def _row_keys(keys: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """A hash of as many neighbouring pieces as a window has, from each start."""
    out = np.full(len(starts), 7, np.uint64)
    for i in range(window):
        out = _pair_keys(out, keys[starts + i])
    return out


def _keys_of(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    lengths = np.fromiter(map(len, raw), np.int64, len(raw))
    return _keys(np.frombuffer(b"".join(raw) + bytes(8), np.uint8), np.cumsum(lengths) - lengths, lengths)


_UNIT_KEYS = np.zeros(1 << 16, bool)
_UNIT_KEYS[(_keys_of(sorted(UNITS)) >> np.uint64(48)).astype(np.int64)] = True


def _has(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the filter may have each hash."""
    top = hashes >> np.uint64(61 - (len(bits) - 1).bit_length())
    return (bits[(top >> np.uint64(3)).astype(np.int64)] >> (top & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def sieve(texts: pa.Array, known: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Numbers of the texts that may have a window of the benchmark; `known` is the filter of its literal pieces and of the
    pairs of neighbours among them. A word of small letters with stops behind it is one literal piece, unless it is a unit behind
    a number; so is one with capitals that begins a sentence or is all capitals, and else it is a name. No window goes over a literal
    piece that is not known, or over two neighbours that are no known pair. What lies between such places needs as many
    pieces as a window has, or must be the whole text; the pieces of other words are counted so that there are no more."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    low, size = int(offsets[0]), int(offsets[-1] - offsets[0])
    at = offsets - low
    data = np.zeros(size + 8, np.uint8)
    data[:size] = np.frombuffer(texts.buffers()[2], np.uint8)[low : low + size] if size else 0
    kinds = np.frombuffer(data[:size].tobytes().translate(_KINDS), np.uint8)
    word = kinds != 0
    border = np.zeros(size + 1, bool)
    border[at] = True
    inside = word[1:] & word[:-1] & ~border[1:-1]  # whether a word goes on
    starts, ends = word.copy(), word.copy()
    starts[1:] &= ~inside
    ends[:-1] &= ~inside
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    if not len(starts):
        return np.zeros(0, np.int64)
    per_word = lambda x: np.add.reduceat(x, starts, dtype=np.int32)  # noqa: E731  blanks between words count nothing
    stop, capital = kinds & _STOP, kinds & _CAPITAL
    odd = (kinds & _ODD).astype(bool)
    odd[:-1] |= inside & stop[:-1].astype(bool) & ~stop[1:].astype(bool)
    lengths = ends - starts - per_word(stop.astype(bool))
    simple = (per_word(odd) == 0) & (lengths > 0)
    text = np.searchsorted(at, starts, "right") - 1
    new = np.concatenate(([True], text[1:] != text[:-1]))
    # what a simple word with capitals is, or a unit, is sure if the word before is simple or there is none in its line
    capitals = per_word(capitals_of := capital.astype(bool))
    lines = np.concatenate(([0], np.cumsum(data[:size] == 10, dtype=np.int32)))[starts]
    last = data[ends - 1]
    opens = np.concatenate(([True], (last[:-1] != 44) & (kinds[ends[:-1] - 1] & _STOP > 0) | (lines[1:] > lines[:-1]))) | new
    sure = new | np.concatenate(([True], simple[:-1])) | np.concatenate(([True], lines[1:] > lines[:-1]))
    letters = lengths - per_word(data[:size] == 0xC3)
    shouted = (capitals == letters) & (letters > 1)
    literal = simple & ((capitals == 0) | shouted | opens & sure)
    data[:size][capitals_of] += 32
    keys = _keys(data, starts, np.where(literal, lengths, 1))
    literal &= sure | ~_UNIT_KEYS[(keys >> np.uint64(48)).astype(np.int64)]
    begun = (kinds & (_LETTER | _DIGIT)).astype(np.uint8)
    begun[1:] &= ~np.where(inside, begun[:-1], 0).astype(np.uint8)
    pieces = np.where(simple, 1, per_word((begun | kinds & _ONE) > 0))
    # words without pieces are as if they were not there
    some = pieces > 0
    if not some.any():
        return np.zeros(0, np.int64)
    literal, keys, pieces, text = literal[some], keys[some], pieces[some], text[some]
    new = np.concatenate(([True], text[1:] != text[:-1]))
    dead = literal & ~_has(known, keys)
    broken = np.concatenate(([False], dead[1:] | dead[:-1] | literal[1:] & literal[:-1] & ~_has(known, _pair_keys(keys[:-1], keys[1:]))))
    broken &= ~new
    begins = np.flatnonzero(new | broken)
    out = np.zeros(len(texts), bool)
    out[text] = True
    out[text[broken | dead]] = False
    sums = np.add.reduceat(pieces, begins)
    # a window of literal pieces alone must be known as a whole
    where = np.flatnonzero(np.repeat(sums >= window, np.diff(begins, append=len(text))))
    if len(where):
        run = np.repeat(np.arange(len(begins)), np.diff(begins, append=len(text)))[where]
        upto = np.cumsum(pieces[where])
        end = np.searchsorted(upto, upto - pieces[where] + window)
        fits = end < len(where)
        fits[fits] = run[end[fits]] == run[fits]
        lit = np.concatenate(([0], np.cumsum(literal[where])))
        alone = np.flatnonzero(fits)
        alone = alone[lit[end[alone] + 1] - lit[alone] == end[alone] + 1 - alone]
        fits[alone] = _has(known, _row_keys(keys[where], alone, window))
        out[text[where[fits]]] = True
    return np.flatnonzero(out)


def _known(window: int):
    """Hashes of the literal pieces of texts (column 0), of pairs of neighbours among them and of windows of nothing else,
    however the texts begin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = Templates(window)
        for b in batches:
            for text in b.column(0).to_pylist():
                found = []
                for starts in (True, False):
                    words, context, _ = templates.read([text], starts)[0]
                    pieces = [p for w, c in zip(words, context.tolist(), strict=True) for p, _ in canonical(w, c == START, c == AFTER_NUMBER)]
                    keys, literal = _keys_of(pieces), np.array([p[0] != "\x00" for p in pieces], bool)
                    upto = np.concatenate(([0], np.cumsum(literal)))
                    full = np.flatnonzero(upto[window:] - upto[:-window] == window)
                    found += [keys[literal], _pair_keys(keys[:-1], keys[1:])[literal[1:] & literal[:-1]], _row_keys(keys, full, window)]
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(found)).view(np.int64))], ["hash"])

    return run


def _filter_of(hashes: list[int], width: int) -> np.ndarray:
    bits = np.zeros(1 << (width - 3), np.uint8)
    h = np.array(hashes, np.int64).view(np.uint64) >> np.uint64(64 - width)
    np.bitwise_or.at(bits, (h >> np.uint64(3)).astype(np.int64), (1 << (h & np.uint64(7))).astype(np.uint8))
    return bits


def _windows(window: int, bits: np.ndarray | None, id_name: str, known: np.ndarray | None = None):
    """Rows (id, row, hash, position, n_windows, slots) of the windows that pass the filter; only texts that pass the sieve
    are read. Without a filter (for the benchmark), also the windows that result if the text is quoted within a
    sentence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = Templates(window)
        for b in batches:
            ids, keys, hashes, positions, totals, slots = [], [], [], [], [], []
            for start in range(0, b.num_rows, 64):  # few texts at once: they may be very long
                some = b.slice(start, 64)
                if known is not None:
                    some = some.take(pa.array(sieve(some.column(2), known, window)))
                docs, names, texts = (some.column(i).to_pylist() for i in range(3))
                for starts in (True, False) if bits is None else (True,):
                    for doc, key, (words, context, pieces) in zip(docs, names, templates.read(texts, starts), strict=True):
                        h = templates.windows(pieces)
                        at = np.arange(len(h))
                        if bits is not None:
                            at = np.flatnonzero(_has(bits, h))
                        if not len(at):
                            continue
                        ids += [doc] * len(at)
                        keys += [key] * len(at)
                        hashes.append(h[at].view(np.int64))
                        positions += at.tolist()
                        totals += [len(h)] * len(at)
                        slots += templates.slots(words, context, at.tolist())
                if len(ids) > 20_000:
                    yield _batch(ids, keys, hashes, positions, totals, slots, id_name, b.schema.field(0).type)
                    ids, keys, hashes, positions, totals, slots = [], [], [], [], [], []
            if ids:
                yield _batch(ids, keys, hashes, positions, totals, slots, id_name, b.schema.field(0).type)

    return run


def _batch(ids, keys, hashes, positions, totals, slots, id_name, kind) -> pa.RecordBatch:
    arrays = [pa.array(ids, kind), pa.array(keys, pa.int64()), pa.array(np.concatenate(hashes)), pa.array(positions, pa.int64()), pa.array(totals, pa.int64()), pa.array(slots, pa.list_(pa.string()))]
    return pa.RecordBatch.from_arrays(arrays, [id_name, "row", "hash", "position", "windows", "slots"])


def _row_key(id_name: str):
    return F.xxhash64(F.col(id_name), F.col("text"))


def _filter_bits(items: DataFrame) -> np.ndarray:
    """The union of the tasks' filters; each has the same size, which follows the number of windows."""

    hashes = items.select("hash").distinct()
    width = min(MOST_BITS, max(LEAST_BITS, hashes.count().bit_length() + 4))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << (width - 3), np.uint8)
        for b in batches:
            bits |= _filter_of(b.column(0).to_pylist(), width)
        yield pa.RecordBatch.from_arrays([pa.array([bits.tobytes()])], ["bits"])

    merged = np.zeros(1 << (width - 3), np.uint8)
    for row in hashes.coalesce(8).mapInArrow(run, "bits binary").toLocalIterator():
        merged |= np.frombuffer(row.bits, np.uint8)
    return merged


def counted(found: list[tuple[int, int, list[str], list[str]]]) -> tuple[list[int], bool]:
    """(positions that count, whether all of them are literal) of the windows (item's position, offset, item's values,
    document's values) of one occurrence. Windows with the item's own values always count. In the others each name or unit
    must go to the value that it has at most of its places, at all offsets of the occurrence (ties: its own, then the
    smallest), and no two of them to one value (the one with fewer places loses it); numbers are slots of their own, so
    that equal ones may change apart."""
    places: dict[tuple[int, int, str], str] = {}
    for position, offset, ours, theirs in found:
        for i, (a, b) in enumerate(zip(ours, theirs, strict=True)):
            if a and not a[-1].isdigit():
                places[position + i, offset, a] = b
    votes: dict[str, dict[str, int]] = {}
    for (_, _, a), b in places.items():
        of = votes.setdefault(a, {})
        of[b] = of.get(b, 0) + 1
    chosen: dict[str, str] = {}
    for n, _, a, b in sorted((-n, b != a, a, b) for a, of in votes.items() for b, n in of.items()):
        if a not in chosen and b not in chosen.values():
            chosen[a] = b
    positions, own = set(), True
    for position, _, ours, theirs in found:
        literal = ours == theirs
        if literal or all(not a or a[-1].isdigit() or chosen.get(a) == b for a, b in zip(ours, theirs, strict=True)):
            positions.add(position)
            own = own and literal
    return sorted(positions), own


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        at = b.num_columns - 1
        got = [counted([(w["item_position"], w["offset"], w["item_slots"], w["slots"]) for w in found]) for found in b.column(at).to_pylist()]
        columns = [*b.columns[:at], pa.array([p for p, _ in got], pa.list_(pa.int64())), pa.array([own for _, own in got], pa.bool_())]
        yield pa.RecordBatch.from_arrays(columns, [*b.schema.names[:at], "positions", "own"])


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE) -> DataFrame:
    """One row for each pair of document text and benchmark item of which at least `share` of the item's template windows
    occur in the document with slots that agree (see `counted`): doc_id, row (hash of id and text), item_id, matched, item_windows,
    containment, and kind: `exact` if all matched slots hold the item's own values, else `reparameterised`.

    Null, empty and blank texts, and items without any letter or digit, match nothing. Items of fewer than `window` pieces
    match documents that consist of that template alone. Very long texts are read whole; a window that repeats in a
    text counts once for each place of an item and way to fill its slots. Repeated documents give one row; repeated items do not count
    twice; two texts under one id are two rows; empty tables give no rows; other columns are ignored."""
    small_batches(docs.sparkSession)
    raw = benchmark.select(F.col("item_id"), _row_key("item_id").alias("key"), "text").filter("text is not null").dropDuplicates(["item_id", "key"])
    schema = "{0} {1}, row long, hash long, position long, windows long, slots array<string>"
    items = checkpointed(raw.mapInArrow(_windows(window, None, "item_id"), schema.format("item_id", dict(benchmark.dtypes)["item_id"])))
    bits, known = _filter_bits(items), _filter_bits(checkpointed(raw.select("text").mapInArrow(_known(window), "hash long")))
    rows = docs.select(F.col("doc_id"), _row_key("doc_id").alias("key"), "text").filter("text is not null")
    found = rows.mapInArrow(_windows(window, bits, "doc_id", known), schema.format("doc_id", dict(docs.dtypes)["doc_id"]))
    theirs = items.select("item_id", F.col("row").alias("item"), "hash", F.col("position").alias("item_position"), F.col("windows").alias("item_windows"), F.col("slots").alias("item_slots"))
    # a short text is a single window that only equals another short text's
    keys = ["doc_id", "row", "item_id", "item"]
    hits = found.join(theirs, "hash").withColumn("offset", F.col("position") - F.col("item_position")).withColumn("changed", F.col("item_slots") != F.col("slots"))
    # an occurrence spans as many offsets as the item has windows; one of two grids of twice that width holds it whole. Only
    # grid cells with a changed window need a look; a cell holds a number of windows that the item bounds
    grid = lambda shift: F.floor((F.col("offset") + shift * F.col("item_windows")) / (2 * F.col("item_windows")))
    cells = hits.select("*", F.explode(F.array(F.struct(F.lit(0).alias("grid"), grid(0).alias("cell")), F.struct(F.lit(1).alias("grid"), grid(1).alias("cell")))).alias("at"))
    window_of = F.struct("item_position", "offset", "item_slots", "slots")
    # the texts are read once: what was found is small, and both uses of it start from there
    one = checkpointed(cells.groupBy(*keys, "at").agg(F.collect_set(window_of).alias("found"), F.max("item_windows").alias("item_windows"), F.bool_or("changed").alias("changed")))
    kinds = [f"{name} {dict(one.dtypes)[name]}" for name in (*keys, "item_windows")]
    settled = one.filter("changed").select(*keys, "item_windows", "found").mapInArrow(_settle, ", ".join([*kinds, "positions array<long>", "own boolean"]))
    changed = settled.select(*keys, "item_windows", F.lit(None).cast("array<long>").alias("literal"), "positions", "own")
    literal = F.transform(F.filter("found", lambda w: w["item_slots"] == w["slots"]), lambda w: w["item_position"])
    parts = one.select(*keys, "item_windows", literal.alias("literal"), F.lit(None).cast("array<long>").alias("positions"), F.lit(True).alias("own")).unionByName(changed)
    # the best occurrence of a pair adds to what is literal anywhere in the text
    both = parts.groupBy(*keys).agg(F.max("item_windows").alias("item_windows"), F.array_distinct(F.flatten(F.collect_list("literal"))).alias("literal"), F.collect_list(F.struct("positions", "own")).alias("cells"))
    total = F.transform(F.filter("cells", lambda c: c["positions"].isNotNull()), lambda c: F.struct(F.size(F.array_union("literal", c["positions"])).alias("matched"), F.when(c["own"], 1).otherwise(0).alias("own")))
    most = F.coalesce(F.array_max(total), F.struct(F.size("literal").alias("matched"), F.lit(1).alias("own")))
    best = both.select(*keys, "item_windows", most.alias("most")).select(*keys, "item_windows", "most.matched", "most.own")
    needed = F.ceil(F.col("item_windows") * F.lit(share) - F.lit(1e-9))
    kind = F.when(F.col("own") == 1, "exact").otherwise("reparameterised")
    return best.filter(F.col("matched") >= needed).select("doc_id", "row", "item_id", "matched", "item_windows", (F.col("matched") / F.col("item_windows")).alias("containment"), kind.alias("kind"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE) -> DataFrame:
    """The rows of `docs`, with all their columns, that hold no benchmark item."""
    row, bad = unused(docs, "row_of_text", "row_to_drop")
    found = contaminated(docs, benchmark, window, share).select(F.col("row").alias(bad)).distinct()
    return docs.withColumn(row, _row_key("doc_id")).join(found, F.col(row) == F.col(bad), "left_anti").drop(row)
