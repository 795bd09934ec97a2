"""SimHash near-duplicate groups by anchor-point covering.

A 64-bit fingerprint is cut into two halves of 32 bits. Two fingerprints that differ in at most four bits differ in at
most two bits of one half (else each half would differ in three or more). In each half the anchors are the codewords of
a covering code of radius one: the [31,26] Hamming code and one free bit, 2**27 anchors. If two halves x and y differ in
at most two bits, some z lies within one bit of both; the anchor that covers z is within 1 + 1 = 2 bits of x and of y.
So it is enough to replicate each fingerprint to every anchor within the covering radius plus the half of the threshold
(each of the two fingerprints goes half of the way): 16.5 anchors a half on average. Fingerprints are compared per
anchor, and each anchor only reports a spanning forest of its links, never all pairs.

All joins are told to merge: their sides grow with the corpus, and a side that Spark broadcasts is built on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, small_batches, unused
from .components import connected_components

SHINGLE = 4
THRESHOLD = 4
SEED = 42
#: Most fingerprints of one anchor that are compared in one piece; larger anchors are cut into pairs of such blocks.
BLOCK = 32768
#: Parts in which a group's smallest id meets its fingerprints.
SALTS = 32


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of the XXH64 hashes of all word shingles, repeats included; 0 without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    k = min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 65536):
        ones += np.unpackbits(h[i : i + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def with_fingerprint(docs: DataFrame, text: str, name: str, keep: list[str], shingle: int = SHINGLE) -> DataFrame:
    """The columns `keep` and the fingerprint of `text` as a long called `name`."""
    small_batches(docs.sparkSession)
    schema = docs.select(*[F.col(f"`{c}`") for c in keep], F.lit(0).cast("long").alias(name)).schema
    raw = f"{name}_text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(raw)
            prints = pa.array([_signed(fingerprint(t.as_py(), shingle)) for t in b.column(at)], pa.int64())
            columns = [b.column(i) for i in range(b.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*columns, prints], [*keep, name])

    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text).cast("binary").alias(raw)).mapInArrow(run, schema)


def _syndromes(x: np.ndarray) -> np.ndarray:
    """Hamming syndrome of the low 31 bits: the exclusive or of the numbers (from 1) of the bits that are set."""
    s = np.zeros(x.shape, np.int64)
    for i in range(31):
        s ^= np.where((x >> i) & 1, i + 1, 0)
    return s


def anchors_of(half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All codewords within two bits of each 32-bit value: (index of the value, codeword)."""
    half = half.astype(np.int64)
    syndrome = _syndromes(half)
    index = np.arange(len(half))
    top = np.int64(1) << 31
    at, codes = [], []
    exact = syndrome == 0
    # values that are codewords: themselves, and with the free bit flipped (no other codeword is nearer than three bits)
    at += [index[exact], index[exact]]
    codes += [half[exact], half[exact] ^ top]
    # others: the codeword one bit away, also with the free bit flipped, and those reached by two flips i, j with i ^ j = s
    rest, s = index[~exact], syndrome[~exact]
    near = half[~exact] ^ (np.int64(1) << (s - 1))
    at += [rest, rest]
    codes += [near, near ^ top]
    for i in range(1, 32):
        j = i ^ s
        two = (j > i) & (j <= 31)
        at.append(rest[two])
        codes.append(half[~exact][two] ^ (np.int64(1) << (i - 1)) ^ (np.int64(1) << (j[two] - 1)))
    return np.concatenate(at), np.concatenate(codes)


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for part in range(0, b.num_rows, 20000):
            fp = b.column(0).slice(part, 20000).to_numpy(zero_copy_only=False).astype(np.int64)
            bits = fp.view(np.uint64)
            for half, values in ((0, bits & np.uint64(0xFFFFFFFF)), (1, bits >> np.uint64(32))):
                at, codes = anchors_of(values)
                yield pa.RecordBatch.from_arrays([pa.array(codes | (half << 32)), pa.array(fp[at])], ["anchor", "fp"])


def spanning_links(left: np.ndarray, right: np.ndarray | None, threshold: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within `left`, or between `left` and `right`. A fingerprint that is reached leaves
    the set still to be searched, so dense groups cost about one comparison for each fingerprint."""
    links: list[tuple[int, int]] = []
    pools = [left.view(np.uint64), left.view(np.uint64) if right is None else right.view(np.uint64)]
    same = right is None
    while len(pools[0]) and len(pools[1]):
        seed, pools[0] = pools[0][:1], pools[0][1:]
        if same:
            pools[1] = pools[0]
        frontier = [(int(seed[0]), 0)]
        while frontier:
            x, side = frontier.pop()
            other = 1 - side
            pool = pools[0] if same else pools[other]
            near = np.bitwise_count(pool ^ np.uint64(x)) <= threshold
            if near.any():
                found = pool[near].tolist()
                links += [(_signed(x), _signed(y)) for y in found]
                frontier += [(y, other) for y in found]
                if same:
                    pools[0] = pools[1] = pool[~near]
                else:
                    pools[other] = pool[~near]
    return links


def _compare(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by cell and side; a cell is an anchor, or a pair of blocks of a large one."""
        key, kept, sides = None, [], []
        out: list[tuple[int, int]] = []

        def close() -> None:
            if kept:
                fp, side = np.concatenate(kept), np.concatenate(sides)
                if len(fp) > 1:
                    two = side.min() != side.max()
                    out.extend(spanning_links(fp[side == 0], fp[side == 1], threshold) if two else spanning_links(fp, None, threshold) if side[0] == 0 else [])

        for b in batches:
            keys = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)], 1)
            fp, side = (b.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            cuts = np.concatenate(([0], np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, [len(keys)]))
            for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if a == z:
                    continue
                if (now := (int(keys[a, 0]), int(keys[a, 1]))) != key:
                    close()
                    key, kept, sides = now, [], []
                kept.append(fp[a:z])
                sides.append(side[a:z])
            if out:
                yield _links(out)
                out = []
        close()
        if out:
            yield _links(out)

    return run


def _links(out: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])


def links(prints: DataFrame, threshold: int = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between the distinct fingerprints `fp` of `prints` that keep every component connected."""
    if threshold > THRESHOLD:
        raise ValueError(f"this covering holds for thresholds up to {THRESHOLD}")
    spread = prints.select("fp").distinct().mapInArrow(_replicate, "anchor long, fp long")
    # anchors with one fingerprint have nothing to compare; those beyond a block are cut into pairs of blocks
    sizes = spread.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1")
    sized = spread.join(sizes.hint("merge"), "anchor").withColumn("blocks", F.ceil(F.col("n") / block))
    own = F.pmod(F.xxhash64("fp"), "blocks")
    cells = sized.select("anchor", "fp", "blocks", own.alias("own")).withColumn(
        "pair", F.explode(F.expr("transform(sequence(0L, blocks - 1), o -> struct(least(o, own) * blocks + greatest(o, own) as cell, if(own > o, 1, 0) as side))"))
    )
    cells = cells.select("anchor", F.col("pair.cell").alias("cell"), "fp", F.col("pair.side").alias("side"))
    # the sort is within partitions and spills; a cell holds at most two blocks
    return cells.repartition("anchor", "cell").sortWithinPartitions("anchor", "cell").mapInArrow(_compare(threshold), "a long, b long")


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD, shingle: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """One row for each row of `docs` (doc_id, text): doc_id, fingerprint (16 hex digits), component_id.

    Component: all documents reachable over links of at most `threshold` differing bits, named by its smallest doc_id.
    Null, empty and blank texts have the fingerprint zero and are linked like any other; texts of fewer than `shingle`
    words are one shingle; repeated rows give repeated rows; a component whose ids are all null has a null component_id;
    an empty table gives no rows; other columns are ignored, whatever their names.
    """
    prints, roots = grouped(docs, threshold, shingle, block)
    return _with_roots(prints, roots).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def grouped(docs: DataFrame, threshold: int, shingle: int, block: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp) of each row, and for each distinct fp: its root fp and the smallest doc_id of its component."""
    prints = checkpointed(with_fingerprint(docs, "text", "fp", ["doc_id"], shingle))
    firsts = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    members = checkpointed(connected_components(links(prints, threshold, block)))  # node, root: only linked fingerprints
    linked = firsts.join(members.withColumnRenamed("node", "fp").hint("merge"), "fp")
    # a linked group may hold a third of all fingerprints: its smallest id comes back in SALTS parts
    least = linked.groupBy("root").agg(F.min("first").alias("component_id")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = linked.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int")).join(least.hint("merge"), ["root", "salt"])
    alone = firsts.join(members.select(F.col("node").alias("fp")).hint("merge"), "fp", "left_anti")
    roots = salted.select("fp", "root", "component_id").unionByName(alone.select("fp", F.col("fp").alias("root"), F.col("first").alias("component_id")))
    return prints, checkpointed(roots)


def _with_roots(prints: DataFrame, roots: DataFrame) -> DataFrame:
    return prints.join(roots.hint("merge"), "fp")


def drop_near_duplicates(docs: DataFrame, threshold: int = THRESHOLD, shingle: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """`docs` with one row of each near-duplicate group: that of the smallest doc_id (ids that are null come last; of rows
    with equal id, the one of the smallest fingerprint). All columns are kept as they are. Among rows that agree in doc_id
    and fingerprint any one stays."""
    prints, roots = grouped(docs, threshold, shingle, block)
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp")
    best = _with_roots(prints, roots).groupBy("root").agg(F.min(rank).alias("best"), F.count("*").alias("size")).select("best.doc_id", "best.fp")
    names = docs.columns
    fp, mine, id_, text = unused(docs, "fp_of_row", "fp_again", "id_that_stays", "text_again")
    stay = best.select(F.col("doc_id").alias(id_), F.col("fp").alias(mine))
    on = lambda df: F.col("doc_id").eqNullSafe(F.col(id_)) & (df[fp] == F.col(mine))
    full = with_fingerprint(docs.withColumn(text, F.col("text")), text, fp, names, shingle)
    kept = full.join(stay.hint("merge"), on(full), "left_semi")
    # repeated rows: several rows with the winner's id and fingerprint; only those need a second look
    again = prints.groupBy(F.col("doc_id").alias("other"), F.col("fp").alias("other_fp")).count().filter("count > 1")
    repeated = stay.join(again.hint("merge"), F.col("other").eqNullSafe(F.col(id_)) & (F.col("other_fp") == F.col(mine)), "left_semi")
    if repeated.isEmpty():
        return kept.select(*[F.col(f"`{c}`") for c in names])
    once = kept.join(repeated.hint("merge"), on(kept), "left_anti")
    many = kept.join(repeated.hint("merge"), on(kept), "left_semi").dropDuplicates(["doc_id", fp])
    return once.unionByName(many).select(*[F.col(f"`{c}`") for c in names])
