"""Byte-level BPE as a finite-state transducer that is determinised as texts ask for it, and decoding by a UTF-8 machine.

Encoding. The ranks of a vocabulary define which bytes merge. Four facts turn them into a transducer that reads each byte
once. (1) The tokens of a prefix of a piece are those of a shorter prefix and one last token; which one is decided by
whether it stands beside the token before it, that is, whether merging the bytes of both gives just these two. (2) What
comes later can only join bytes from a *live* boundary on: one after which all bytes read so far begin some token. (3)
The last boundary that lies on the paths of all live boundaries is final: tokens before it are emitted. (4) No merge crosses a
final boundary, so what follows merges as if the piece began there. A state is therefore the few bytes behind the last
final boundary; its moves are worked out from the merges when first taken and kept. Lookahead is bounded by the
vocabulary, not by the piece, so a piece of a million letters takes linear time.

Decoding. Tokens may end within a character. A state is the bytes of a character that has begun; reading a token in a state
gives text and the next state, worked out byte by byte when first met. Texts come out as tokens come in.
"""

from __future__ import annotations

import base64
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Moves of the transducer that a worker keeps before it starts anew, and pieces of text whose ids it remembers.
MOVES_KEPT = 600_000
PIECES_KEPT = 400_000
#: Rows that are worked on at once.
ROWS = 256
# Fixed value: the pattern of this kind of rank files, which texts of Latin-1 characters are cut by with these classes.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LETTER, _NUMBER, _SPACE = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", r" \t\n\x0b\x0c\r\x85\xa0"
_LATIN = re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_SPACE}{_LETTER}{_NUMBER}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+").findall
REPLACEMENT = "\N{REPLACEMENT CHARACTER}"


@cache
def ranks(path: str) -> dict[bytes, int]:
    """A file of lines `base64 rank` as a map of tokens to ids."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Transducer:
    """Encodes one piece of bytes at a time; every single byte must be a token. A state is numbered; it stands for the bytes
    behind the last boundary that is final, and for each boundary in them the last token before it (none where the path does
    not come from that final boundary)."""

    def __init__(self, vocabulary: dict[bytes, int], moves_kept: int = MOVES_KEPT):
        self.ids = vocabulary
        self.begins = {token[:n] for token in vocabulary for n in range(1, len(token) + 1)}
        self.beside: dict[tuple[bytes | None, bytes], bool] = {}
        self.spines: dict[tuple[bytes, bool], list[bytes] | None] = {}
        self.moves_kept = moves_kept
        self._restart()

    def _restart(self) -> None:
        self.states: list[tuple[tuple[bytes | None, ...], bytes]] = []
        self.numbers: dict[bytes, int] = {}
        self.moves: dict[int, int] = {}  # by state and byte
        self.emits: dict[int, bytes] = {}  # likewise, where a move emits: ids as little-endian 32-bit numbers
        self.rests: dict[int, bytes] = {}  # what a state emits if the piece ends in it
        self._state((None,), b"")

    def _state(self, lasts: tuple[bytes | None, ...], open_: bytes) -> int:
        number = self.numbers.get(open_)
        if number is None:
            number = self.numbers[open_] = len(self.states)
            self.states.append((lasts, open_))
        return number

    def merged(self, data: bytes) -> list[bytes]:
        """The merges as they are defined: the pair of lowest rank first, of equal ones the leftmost."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            pairs = [self.ids.get(a + b, sys.maxsize) for a, b in zip(parts, parts[1:])]  # noqa: B905
            rank = min(pairs)
            if rank == sys.maxsize:
                break
            at = pairs.index(rank)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _spine(self, token: bytes, right: bool) -> list[bytes] | None:
        """What stands at one end of a token while its bytes merge, up to the token; None if they do not merge into it, or not
        in ascending order of rank."""
        key = (token, right)
        if key not in self.spines:
            parts = [token[i : i + 1] for i in range(len(token))]
            at = -1 if right else 0
            spine, latest = [parts[at]], -1
            while len(parts) > 1:
                pairs = [self.ids.get(a + b, sys.maxsize) for a, b in zip(parts, parts[1:])]  # noqa: B905
                rank = min(pairs)
                if rank == sys.maxsize or rank < latest:
                    break
                i, latest = pairs.index(rank), rank
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                if parts[at] != spine[-1]:
                    spine.append(parts[at])
            self.spines[key] = spine if len(parts) == 1 else None
        return self.spines[key]

    def _stands(self, left: bytes | None, token: bytes) -> bool:
        """Whether `token` is what the bytes behind `left` merge into; at the beginning of a piece `left` is None."""
        key = (left, token)
        known = self.beside.get(key)
        if known is None:
            if len(self.beside) >= self.moves_kept:
                self.beside.clear()
            known = self.beside[key] = self._compared(left, token)
        return known

    def _compared(self, left: bytes | None, token: bytes) -> bool:
        if left is None:
            return self.merged(token) == [token]
        before, after = self._spine(left, True), self._spine(token, False)
        if before is None or after is None:
            return self.merged(left + token) == [left, token]
        # both sides merge by rank; a merge across comes first if its rank is lower than that of the next on either side,
        # or equal to the right one's (the leftmost of equal ones comes first)
        i, j, ids = 0, 0, self.ids
        while True:
            across = ids.get(before[i] + after[j], sys.maxsize)
            next_left = ids[before[i + 1]] if i + 1 < len(before) else sys.maxsize
            next_right = ids[after[j + 1]] if j + 1 < len(after) else sys.maxsize
            if across < next_left and across <= next_right:
                return across == sys.maxsize
            if next_left == next_right == sys.maxsize:
                return True
            if next_left <= next_right:
                i += 1
            else:
                j += 1

    def _emitted(self, lasts: tuple[bytes | None, ...], end: int) -> bytes:
        tokens = []
        while end:
            tokens.append(lasts[end])
            end -= len(lasts[end])
        return b"".join([self.ids[t].to_bytes(4, "little") for t in reversed(tokens)])

    def _move(self, key: int) -> int:
        lasts, open_ = self.states[key >> 8]
        data = open_ + bytes((key & 255,))
        end = len(data)
        for begin in range(end):
            token = data[begin:]
            if token in self.ids and (not begin or lasts[begin] is not None) and self._stands(lasts[begin], token):
                lasts = (*lasts, token)
                break
        # the last boundary on the paths of all live ones
        cut = end
        for live in range(end - 1, -1, -1):
            if data[live:] in self.begins and (not live or lasts[live] is not None):
                while cut != live:
                    if cut > live:
                        cut -= len(lasts[cut])
                    else:
                        live -= len(lasts[live])
        if cut:
            self.emits[key] = self._emitted(lasts, cut)
            kept: list[bytes | None] = [None]
            for b in range(cut + 1, end + 1):
                begin = -1 if lasts[b] is None else b - len(lasts[b]) - cut
                kept.append(lasts[b] if begin == 0 or (begin > 0 and kept[begin] is not None) else None)
            lasts, data = tuple(kept), data[cut:]
        self.moves[key] = number = self._state(lasts, data)
        return number

    def steps(self, piece: bytes) -> Iterator[tuple[int, bytes]]:
        """The state after each byte, and what is emitted on the way to it."""
        state = 0
        for byte in piece:
            key = state << 8 | byte
            state = self.moves.get(key, -1)
            if state < 0:
                state = self._move(key)
            yield state, self.emits.get(key, b"")

    def __call__(self, piece: bytes) -> bytes:
        if len(self.moves) >= self.moves_kept:
            self._restart()
        state, out = 0, []
        moves, emits = self.moves, self.emits
        for byte in piece:  # as in `steps`
            key = state << 8 | byte
            state = moves.get(key, -1)
            if state < 0:
                state = self._move(key)
            if key in emits:
                out.append(emits[key])
        rest = self.rests.get(state)
        if rest is None:
            lasts, open_ = self.states[state]
            rest = self.rests[state] = self._emitted(lasts, len(open_))
        out.append(rest)
        return b"".join(out)


class Splitter:
    """Cuts texts as the tiktoken library does. Its tables of letters and numbers and those of the `regex` module may be of
    different versions of Unicode; code points that Python's own tables do not know are classed by the library itself."""

    def __init__(self, pattern: str):
        self.pattern, self.find = pattern, regex.compile(pattern)
        self.known: set[str] = set()  # characters that were met and are in Python's tables
        self.likes: dict[str, str] = {}
        self.probe = None

    def _like(self, char: str) -> str:
        """A letter, a number or a sign that the library treats as it does `char`."""
        if char not in self.likes:
            if self.probe is None:
                import tiktoken

                # pairs of a last byte and a letter, number or sign: they merge only within a piece
                pairs = {bytes([b]): b for b in range(256)}
                for b in range(128, 192):
                    for x in b"a1!":
                        pairs[bytes([b, x])] = len(pairs)
                self.probe = tiktoken.Encoding("probe", pat_str=self.pattern, mergeable_ranks=pairs, special_tokens={})
            size = len(char.encode())
            self.likes[char] = next((x for x in "a1" if len(self.probe.encode_ordinary(char + x)) == size), "!")
        return self.likes[char]

    def __call__(self, text: str) -> list[str]:
        latin = text.isascii()
        if not latin:
            chars = set(text)
            latin, new = max(chars) <= "\xff", chars - self.known
            unknown = {c for c in new if unicodedata.category(c) == "Cn"}
            self.known |= new - unknown
            if unknown:
                stand_in = text.translate({ord(c): self._like(c) for c in unknown})
                return [text[m.start() : m.end()] for m in self.find.finditer(stand_in)]
        return _LATIN(text) if latin and self.pattern == PATTERN else self.find.findall(text)


class Encoder(dict):
    """Ids of whole texts, as little-endian 32-bit numbers. It is itself the memory of the pieces it has met; a piece that
    is a token is that token."""

    def __init__(self, vocabulary: dict[bytes, int], pattern: str):
        super().__init__()
        self.ids, self.split, self.transducer = vocabulary, Splitter(pattern), Transducer(vocabulary)
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        out = self.older.get(piece)
        if out is None:
            data = piece.encode()
            known = self.ids.get(data)
            out = self.transducer(data) if known is None else known.to_bytes(4, "little")
        if len(piece) <= 64:
            self[piece] = out
        return out

    def encode(self, text: str) -> bytes:
        if len(self) > PIECES_KEPT:  # what is used often comes back from the older half
            self.older = dict(self)
            self.clear()
        return b"".join(map(self.__getitem__, self.split(text)))


def utf8_step(begun: bytes, byte: int) -> tuple[str, bytes]:
    """The machine: text that `byte` completes after the `begun` bytes of a character, and the bytes begun after it. Bytes
    that cannot be part of a character become replacement characters, one for each longest beginning of a character."""
    if not begun:
        if byte < 0x80:
            return chr(byte), b""
        return ("", bytes([byte])) if 0xC2 <= byte <= 0xF4 else (REPLACEMENT, b"")
    low, high = 0x80, 0xBF
    if len(begun) == 1:  # no overlong forms, no surrogates, nothing above the last code point
        low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(begun[0], (low, high))
    if not low <= byte <= high:
        text, begun = utf8_step(b"", byte)
        return REPLACEMENT + text, begun
    begun += bytes([byte])
    size = 2 if begun[0] < 0xE0 else 3 if begun[0] < 0xF0 else 4
    return (begun.decode(), b"") if len(begun) == size else ("", begun)


class Decoder:
    """Texts of ids; `begun` states are the keys of the outer table. An id that is no token is a replacement character."""

    def __init__(self, vocabulary: dict[bytes, int]):
        self.tokens = {i: token for token, i in vocabulary.items()}
        self.moves: dict[bytes, dict[int, tuple[str, bytes]]] = {}

    def _move(self, begun: bytes, i: int) -> tuple[str, bytes]:
        parts: list[str] = []
        for byte in self.tokens.get(i, b"\xff"):
            text, begun = utf8_step(begun, byte)
            parts.append(text)
        return "".join(parts), begun

    def stream(self, ids: Iterator[int]) -> Iterator[str]:
        """Text as soon as its last byte is known."""
        begun = b""
        moves = self.moves.setdefault(begun, {})
        for i in ids:
            move = moves.get(i)
            if move is None:
                move = moves[i] = self._move(begun, i)
            text, after = move
            if after != begun:
                begun = after
                moves = self.moves.setdefault(begun, {})
            if text:
                yield text
        if begun:
            yield REPLACEMENT


@cache
def _encoder(path: str, pattern: str) -> Encoder:
    return Encoder(ranks(path), pattern)


@cache
def _decoder(path: str) -> Decoder:
    return Decoder(ranks(path))


def _encoding(vocabulary: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary, pattern)
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                rows = b.slice(at, ROWS)
                found = [encoder.encode(t) if t else b"" for t in rows.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, found)], dtype=np.int64) // 4
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(found), "<i4")))
                yield pa.RecordBatch.from_arrays([rows.column(0), ids], names=["doc_id", "ids"])

    return run


def _decoding(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _decoder(vocabulary)
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                rows = b.slice(at, ROWS)
                texts = [None if ids is None else "".join(decoder.stream(ids)) for ids in rows.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    return run


def _texts(docs: DataFrame) -> tuple[DataFrame, str]:
    return docs.select("doc_id", F.col("text").cast("string").alias("text")), docs.schema["doc_id"].dataType.simpleString()


def encoded(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id and `ids` (array of int) of the whole `text` of every row, without special tokens: what the tiktoken library
    gives for the rank file `vocabulary` and `pattern`.

    Null texts are empty and have no ids; doc_id may be null, repeated and of any type; other columns are ignored; an empty
    table gives no rows. No row meets another: there is no shuffle."""
    rows, kind = _texts(docs)
    return rows.mapInArrow(_encoding(vocabulary, pattern), f"doc_id {kind}, ids array<int>")


def decoded(tokens: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, ids and the `text` that the ids stand for. Ids that are null or no tokens, and bytes that are not UTF-8, give
    replacement characters; a null array has a null text."""
    kind = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.select("doc_id", "ids").mapInArrow(_decoding(vocabulary), f"doc_id {kind}, ids array<int>, text string")


def round_trip(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """`decoded` after `encoded`, in one pass of one worker."""
    encode, decode = _encoding(vocabulary, pattern), _decoding(vocabulary)
    rows, kind = _texts(docs)
    return rows.mapInArrow(lambda batches: decode(encode(batches)), f"doc_id {kind}, ids array<int>, text string")


def round_trip_digest(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """Encode, decode, digest: doc_id, n_tokens, ids_sha256 (of decimal ids joined by commas), decoded_sha256."""
    back = round_trip(docs, vocabulary, pattern)
    written = F.array_join(F.col("ids").cast("array<string>"), ",")
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(written.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
