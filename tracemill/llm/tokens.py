"""Token ids in a binary format whose document boundaries are Elias-Fano encoded.

Documents are dealt out by ranges of doc_id and sorted, encoded in one pass and packed into images of bounded size. An
image is self-contained: a header, the concatenated ids, the Elias-Fano coded ends of its documents with select samples,
and the documents' ids. Images are written through Spark's file committer as the binary column of a Parquet folder, so
that any store that Spark writes to will do and a lost task leaves no partial file; `seq` and `part` order them.

Layout of an image, little-endian: magic `EFTOK001`, then as unsigned 64-bit numbers: bytes of an id (2 or 4), documents,
documents whose doc_id is null (they come first), ids, low bits of an end, bytes of low bits, bytes of high bits, select
samples. Then the ids; low bits of all ends, packed; high bits: bit (end >> low) + i is set for end i; for each 256th set
bit its position, as unsigned 64-bit numbers; doc_id as signed 64-bit numbers.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_folder, small_batches

MAGIC = b"EFTOK001"
HEADER = struct.Struct("<8s8Q")
SAMPLE = 256
#: An image is closed when it holds as many ids.
IMAGE_IDS = 1 << 21
#: Distinct pieces of words whose ids a worker remembers before it starts anew; longer ones than PIECE_BYTES are not remembered.
#: An executor has more workers than cores for a while, as those of an earlier step live on.
PIECES_KEPT, PIECE_BYTES = 400_000, 64

# The normaliser and pre-tokeniser, as in tokenizer files, of the kind that is encoded by piece.
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": PIECE}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}

# The same pieces in Latin-1 bytes, where letters and numbers are these. Controls, no-break space and soft hyphen are odd.
_LETTER, _DIGIT = rb"a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", rb"0-9\xb2\xb3\xb9\xbc-\xbe"
_LATIN_PIECE = re.compile(rb"[" + _LETTER + rb"]+|'(?:s|t|re|ve|m|ll|d)|[" + _DIGIT + rb"]|[^\s" + _LETTER + _DIGIT + rb"]+").findall
_LOWER = bytes.maketrans(bytes([*range(65, 91), *range(0xC0, 0xD7), *range(0xD8, 0xDF)]), bytes([*range(97, 123), *range(0xE0, 0xF7), *range(0xF8, 0xFF)]))
_ODD = bytes([*range(9), *range(14, 32), *range(127, 161), 0xAD])


class EliasFano:
    """A non-decreasing sequence below or at `universe` in about 2 + log2(universe / n) bits a number."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: bytes):
        self.n, self.low_bits = n, low_bits
        self.low, self.high = np.frombuffer(low, np.uint8), np.frombuffer(high, np.uint8)
        self.samples = np.frombuffer(samples, "<u8")

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.int64)
        n = len(values)
        top = int(values[-1]) if n else 0
        k = max(0, (top // n).bit_length() - 1) if n else 0
        low = np.packbits(((values[:, None] >> np.arange(k)) & 1).astype(np.uint8).ravel(), bitorder="little")
        at = (values >> k) + np.arange(n)
        bits = np.zeros(int(at[-1]) + 1 if n else 0, np.uint8)
        bits[at] = 1
        return cls(n, k, low.tobytes(), np.packbits(bits, bitorder="little").tobytes(), at[::SAMPLE].astype("<u8").tobytes())

    def _low(self, i: int) -> int:
        a, z = i * self.low_bits, (i + 1) * self.low_bits
        word = int.from_bytes(self.low[a // 8 : (z + 7) // 8].tobytes(), "little")
        return (word >> (a % 8)) & ((1 << self.low_bits) - 1)

    def __getitem__(self, i: int) -> int:
        """Select: from the nearest sample before the i-th set bit, count set bits byte by byte."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        position = int(self.samples[i // SAMPLE])
        left = i % SAMPLE
        byte = position // 8
        word = int(self.high[byte]) >> (position % 8) << (position % 8)
        while (here := word.bit_count()) <= left:
            left -= here
            byte += 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        return ((8 * byte + (word & -word).bit_length() - 1 - i) << self.low_bits) | self._low(i)

    def all(self) -> np.ndarray:
        at = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        low = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits).astype(np.int64)
        return ((at - np.arange(self.n)) << self.low_bits) + low @ (1 << np.arange(self.low_bits, dtype=np.int64))


def pack(ids: bytes, width: int, ends: np.ndarray, doc_ids: list[int | None]) -> bytes:
    ef = EliasFano.of(ends)
    nulls = sum(x is None for x in doc_ids)
    samples = ef.samples.tobytes()
    header = HEADER.pack(MAGIC, width, len(doc_ids), nulls, len(ids) // width, ef.low_bits, len(ef.low), len(ef.high), len(ef.samples))
    return b"".join([header, ids, ef.low.tobytes(), ef.high.tobytes(), samples, np.array([x or 0 for x in doc_ids], "<i8").tobytes()])


def unpack(image: bytes) -> tuple[np.ndarray, EliasFano, list[int | None]]:
    """The concatenated ids, the ends of the documents, and their doc_ids."""
    magic, width, n, nulls, n_ids, low_bits, n_low, n_high, n_samples = HEADER.unpack_from(image)
    if magic != MAGIC:
        raise ValueError("not a token image")
    view, at = memoryview(image), HEADER.size
    parts = []
    for length in (n_ids * width, n_low, n_high, 8 * n_samples, 8 * n):
        parts.append(view[at : at + length])
        at += length
    doc_ids: list[int | None] = np.frombuffer(parts[4], "<i8").tolist()
    doc_ids[:nulls] = [None] * nulls
    return np.frombuffer(parts[0], f"<u{width}"), EliasFano(n, low_bits, parts[1], parts[2], parts[3]), doc_ids


class Encoder:
    """Encodes whole texts. For tokenizers of the kind below, which treat each piece of a word by itself, pieces of plain
    Latin texts are found here and remembered, and only new pieces run the merges; other texts, and all texts of other
    tokenizers, are encoded as they are. The ids are those of the whole text either way."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(vocabulary, encoding="utf-8") as f:
            said = json.load(f)
        self.tokenizer = Tokenizer.from_str(json.dumps(said))
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        special = [t["content"] for t in said["added_tokens"]]
        self.by_piece = said["normalizer"] == NORMALIZER and said["pre_tokenizer"] == PRE_TOKENIZER and all(x.startswith("<|") for x in special)
        bare = said | {"normalizer": None, "pre_tokenizer": PRE_TOKENIZER["pretokenizers"][1], "added_tokens": []}
        self.bare = Tokenizer.from_str(json.dumps(bare)) if self.by_piece else None
        self.known: dict[bytes, bytes] = {}

    def __call__(self, texts: list[str]) -> list[bytes]:
        found = [self._pieces(t) for t in texts] if self.by_piece else [None] * len(texts)
        new = set(chain.from_iterable(p for p in found if p)).difference(self.known)
        if len(self.known) + len(new) > PIECES_KEPT:
            self.known.clear()
            new = set(chain.from_iterable(p for p in found if p))
        order = list(new)
        self.known.update(zip(order, self._encoded(self.bare, [p.decode("latin-1") for p in order]), strict=True))
        whole = iter(self._encoded(self.tokenizer, [t for t, p in zip(texts, found, strict=True) if p is None]))
        get = self.known.__getitem__
        out = [next(whole) if p is None else b"".join(map(get, p)) for p in found]
        for p in order:
            if len(p) > PIECE_BYTES:
                del self.known[p]
        return out

    @staticmethod
    def _pieces(text: str) -> list[bytes] | None:
        """The lower-cased pieces that the tokenizer finds in a text; None unless all of it is plain Latin-1."""
        try:
            raw = text.encode("latin-1")
        except UnicodeEncodeError:
            return None
        if len(raw.translate(None, _ODD)) != len(raw) or b"<|" in raw:
            return None
        return _LATIN_PIECE(raw.translate(_LOWER))

    def _encoded(self, tokenizer, texts: list[str]) -> list[bytes]:
        kind = "H" if self.width == 2 else "I"
        out = []
        for i in range(0, len(texts), 4096):
            out += [array(kind, e.ids).tobytes() for e in tokenizer.encode_batch_fast(texts[i : i + 4096], add_special_tokens=False)]
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder_of(vocabulary: str) -> Encoder:
    """One encoder for each worker, which remembers from one task to the next."""
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = Encoder(vocabulary)
    return _ENCODERS[vocabulary]


def _packing(vocabulary: str, end_id: int, image_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(vocabulary)
        end = end_id.to_bytes(encoder.width, "little")
        part, seq = TaskContext.get().partitionId(), 0
        ids, sizes, docs, held = [], [], [], 0

        def image() -> pa.RecordBatch:
            nonlocal ids, sizes, docs, held, seq
            ends = np.cumsum(np.array(sizes, np.int64))
            row = [part, seq, len(docs), int(ends[-1]), pack(b"".join(ids), encoder.width, ends, docs)]
            ids, sizes, docs, held, seq = [], [], [], 0, seq + 1
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=["part", "seq", "n_docs", "n_ids", "image"])

        for b in batches:
            for at in range(0, b.num_rows, 128):  # few texts at once: they may be very long
                rows = b.slice(at, 128)
                for doc, encoded in zip(rows.column(0).to_pylist(), encoder([t or "" for t in rows.column(1).to_pylist()]), strict=True):
                    ids += [encoded, end]
                    sizes.append(len(encoded) // encoder.width + 1)
                    docs.append(doc)
                    held += sizes[-1]
                    if held >= image_ids:
                        yield image()
        if docs:
            yield image()

    return run


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int = 1, image_ids: int = IMAGE_IDS) -> None:
    """Encode the whole `text` of every row, append `end_id`, and write images under `path` in ascending doc_id order.

    Null texts are empty (the end id alone); rows of null id come first; rows of equal id follow each other, ordered by a
    hash of the text; an empty table writes a folder without images; other columns are ignored. doc_id is an integer."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    tie = F.xxhash64("text")
    # dealt out before encoding, so that finding the ranges does not encode twice
    placed = rows.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)
    packed = placed.mapInArrow(_packing(vocabulary, end_id, image_ids), "part long, seq long, n_docs long, n_ids long, image binary")
    packed.write.option("compression", "zstd").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """One row for each document in the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of the
    ids as little-endian unsigned 32-bit numbers)."""
    images = spark.read.schema("part long, seq long, n_docs long, n_ids long, image binary").parquet(path)
    # one number for each range of ids comes to the driver; within a range a window adds up its few images
    totals = sorted((r["part"], r["n"]) for r in images.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    base, before = {}, 0
    for part, n in totals:
        base[part], before = before, before + n
    bases = spark.createDataFrame(sorted(base.items()), "part long, base long")
    earlier = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    offsets = images.select("part", "seq", "n_ids").join(bases, "part").select("part", "seq", (F.col("base") + F.coalesce(F.sum("n_ids").over(earlier), F.lit(0))).alias("offset"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, seq, image in zip(*(b.column(i) for i in range(3)), strict=True):
                ids, ef, docs = unpack(image.as_py())
                ends = ef.all()
                starts = np.concatenate(([0], ends[:-1]))
                for i in range(0, len(docs), 4096):  # widened a piece at a time
                    a, z = starts[i : i + 4096], ends[i : i + 4096]
                    raw = memoryview(ids[a[0] : z[-1]].astype("<u4")).cast("B")
                    crc = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip((a - a[0]).tolist(), (z - a[0]).tolist(), strict=True)]
                    n = len(a)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part.as_py()] * n), pa.array([seq.as_py()] * n), pa.array(docs[i : i + n], pa.int64()), pa.array(a), pa.array(z - a), pa.array(crc, pa.int64())],
                        ["part", "seq", "doc_id", "local", "n_tokens", "ids_crc32"],
                    )

    rows = images.select("part", "seq", "image").mapInArrow(run, "part long, seq long, doc_id long, local long, n_tokens long, ids_crc32 long")
    return rows.join(F.broadcast(offsets) if len(totals) <= 10_000 else offsets, ["part", "seq"]).select("doc_id", (F.col("offset") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def tokenized(docs: DataFrame, vocabulary: str, end_id: int = 1, image_ids: int = IMAGE_IDS) -> DataFrame:
    """Write `docs` to a new folder below the session's checkpoint folder and read it back."""
    spark = docs.sparkSession
    path = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, vocabulary, end_id, image_ids)
    return read_tokens(spark, path)
