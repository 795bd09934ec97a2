"""A trie of conversation prefixes, as succinct level-order shards.

A node is a distinct sequence of first turns (role, text). Turns are known by 128-bit hashes, prefixes by the XOR of the
hashes of their turns with their places, which a scan in segments gives for conversations of any length.

1. Conversations that are equal throughout are one from here on (their ids are kept for the digests of ends).
2. *Upper* nodes are those with more than `SHARD` turns below them, the root always. The part of a conversation below its
   last upper node belongs to the shard of its first lower node. So a shard holds a bounded number of turns, however
   common a first turn is.
3. Each task builds forests of shards in numpy, level by level: a LOUDS bitvector (for each node in breadth-first order as many
   ones as it has children, then a zero), the labels in the same order, and sums over subtrees by going through the levels
   backwards with `add.at`. An image of them is one row of a table.
4. Upper levels are merged apart: each node of theirs, and each shard, is owned by its smallest member; running sums along
   the members' own paths from the deep end, grouped by node, are the sums over subtrees, without walking the tree.

Every node is known by its smallest member and its depth.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.operators import scan
from tracemill.operators.storage import written

from .common import small_side

#: Turns of distinct conversations below a node, up to which its subtree is one shard.
SHARD = 1 << 16
#: Upper nodes that are broadcast to the tops of shards; beyond, the join is shuffled.
UPPER_BROADCAST = 200_000
#: Ids of a block of a long list of members.
MEMBERS = 4096
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()

_IMAGE = "n_units int, n_nodes int, louds binary, labels binary, conv_ids binary, n_convs binary, n_leaves binary, saved binary, tops array<struct<depth:long,a:long,b:long>>, ends array<struct<node:int,digest:string>>"
_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, top boolean, above_a long, above_b long"


@dataclass(frozen=True)
class Trie:
    """`images`: the shards; `upper`: one row for each upper node; both tables in the shared folder."""

    images: DataFrame
    upper: DataFrame


def turn_rows(conversations: DataFrame) -> DataFrame:
    """conv_id, depth (from 1), a, b (hash of role and text), n_bytes of the text, for rows of conv_id, turn, role, text.

    Turns are ordered by turn (nulls first); of one turn by role and text. Null roles and texts are empty; rows of null
    conv_id take no part; repeated rows are turns of their own; other columns are ignored."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"), F.xxhash64(F.lit("a"), role, text).alias("a"), F.xxhash64(F.lit("b"), text, role).alias("b"), F.octet_length(text).cast("long").alias("n_bytes")
    )
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    return scan.running(rows, ["conv_id"], order, "depth", drop=("turn", "role", "text"))


def borrowed_heads(turns: DataFrame, every: int = 5, longest: int = 8) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin like others: each c takes the first h turns of c - c % every, h = crc32(c in decimal) % (longest + 1),
    and goes on with its own turns after its first h. Returns the turns, and all conversations (conv_id), also those left
    without turns."""
    every_, h = F.lit(every), F.crc32(F.col("conv_id").cast("string").cast("binary")) % (longest + 1)
    heads = turns.filter((F.col("conv_id") % every_ == 0) & (F.col("depth") <= longest)).withColumnRenamed("conv_id", "base")
    convs = turns.filter("depth = 1").select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % every_).alias("base"))
    sizes = heads.groupBy("base").agg(F.count("*").alias("size"))
    known = convs.join(sizes, "base", "left").withColumn("lent", F.least("h", F.coalesce("size", F.lit(0))))
    lent = known.join(heads, "base").filter("depth <= h").select("conv_id", "depth", "a", "b", "n_bytes")
    own = turns.join(known.select("conv_id", "h", "lent"), "conv_id").filter("depth > h")
    return lent.unionByName(own.withColumn("depth", F.col("depth") - F.col("h") + F.col("lent")).drop("h", "lent")), convs.select("conv_id")


def _member_digests(ends: DataFrame) -> DataFrame:
    """size, a, b of each whole sequence, with the smallest conv_id, the number of conversations and the digest of their
    ids in ascending order. Ids are joined in blocks first, so that a sequence of very many conversations is read as few rows."""
    keys = ["size", "a", "b"]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            size, a, c, ids = (np.asarray(b.column(i)) for i in range(4))
            change = np.flatnonzero((np.diff(size) != 0) | (np.diff(a) != 0) | (np.diff(c) != 0)) + 1
            cuts = [0, *change.tolist(), n] if n else []
            # a block is at most MEMBERS ids of one sequence within a batch
            spans = [(x, min(x + MEMBERS, z)) for s, z in zip(cuts, cuts[1:], strict=False) for x in range(s, z, MEMBERS)]
            texts = [str(ids[x]) if z - x == 1 else ",".join(map(str, ids[x:z].tolist())) for x, z in spans]
            at = np.array([x for x, _ in spans], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(v[at]) for v in (size, a, c, ids)] + [pa.array([z - x for x, z in spans], pa.int64()), pa.array(texts, pa.string())], names=[*keys, "first", "n", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first, n, state = None, 0, 0, None
        out: list[tuple] = []

        def flushed() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[*keys, "conv_id", "n", "digest"])

        for b in batches:
            for size, x, y, begin, count, ids in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                if now != (size, x, y):
                    if now is not None:
                        out.append((*now, first, n, state.hexdigest()))
                    now, first, n, state = (size, x, y), begin, 0, hashlib.sha256()
                    state.update(ids.encode())
                else:
                    state.update(b"," + ids.encode())
                n += count
            if out:
                yield flushed()
        if now is not None:
            out.append((*now, first, n, state.hexdigest()))
            yield flushed()

    rows = ends.select(*keys, "conv_id")
    joined = rows.repartitionByRange(*keys, "conv_id").sortWithinPartitions(*keys, "conv_id").mapInArrow(blocks, "size long, a long, b long, first long, n long, ids string")
    return joined.repartition(*keys).sortWithinPartitions(*keys, "first").mapInArrow(digests, "size long, a long, b long, conv_id long, n long, digest string")


def louds_bits(parents: np.ndarray, n_units: int) -> tuple[np.ndarray, np.ndarray]:
    """The bitvector of a forest, and the number of children of each node. `parents` are in breadth-first order, -1 for the
    tops; the block of a root above all tops comes first."""
    degrees = np.bincount(parents + 1, minlength=len(parents) + 1)
    bits = np.ones(int(degrees.sum()) + len(degrees), np.uint8)
    bits[np.cumsum(degrees) + np.arange(len(degrees))] = 0
    return bits, degrees[1:]


def louds_parents(louds: bytes, n_nodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Parents (-1 for tops) and numbers of children, from the bits alone: the i-th one is node i, and the zeros before it
    tell whose block it stands in."""
    bits = np.unpackbits(np.frombuffer(louds, np.uint8), bitorder="little")[: 2 * n_nodes + 1]
    parents = np.flatnonzero(bits) - np.arange(n_nodes) - 1
    zeros = np.flatnonzero(bits == 0)
    return parents, np.diff(zeros) - 1


def _levels(parents: np.ndarray, n_units: int) -> list[int]:
    """Where each level begins, and the end."""
    cuts = [0, n_units]
    while cuts[-1] < len(parents):
        cuts.append(int(np.searchsorted(parents, cuts[-1])))
    return cuts


def forest(unit: np.ndarray, conv: np.ndarray, a: np.ndarray, b: np.ndarray, n_bytes: np.ndarray, n: np.ndarray, digest: list[str | None], tops: list[dict]) -> dict:
    """The image of some shards. Rows are turns ordered by unit (from 0), conversation and depth."""
    begins = np.flatnonzero(np.r_[True, (np.diff(unit) != 0) | (np.diff(conv) != 0)])
    sizes = np.diff(np.r_[begins, len(unit)])
    parts: dict[str, list[np.ndarray]] = {k: [] for k in ("parent", "a", "b", "conv", "n", "bytes")}
    ends: list[dict] = []
    active, above, made, level = np.arange(len(begins)), np.full(len(begins), -1), 0, 0
    while len(active):
        row = begins[active] + level
        key = (unit[row],) if level == 0 else (b[row], a[row], above[active])
        order = np.lexsort(key)
        active, row = active[order], row[order]
        differs = np.zeros(len(row), bool)
        for k in key:
            differs[1:] |= np.diff(k[order]) != 0
        differs[0] = True
        node, head = made + np.cumsum(differs) - 1, np.flatnonzero(differs)
        parts["parent"].append(above[active][head])
        parts["a"].append(a[row][head])
        parts["b"].append(b[row][head])
        parts["bytes"].append(n_bytes[row][head])
        parts["conv"].append(np.minimum.reduceat(conv[row], head))
        parts["n"].append(np.add.reduceat(n[row], head))
        above[active] = node
        last = sizes[active] == level + 1
        ends += [{"node": int(i), "digest": digest[r]} for i, r in zip(node[last], row[last], strict=True)]
        active, made, level = active[~last], made + len(head), level + 1
    got = {k: np.concatenate(v) for k, v in parts.items()}
    bits, degrees = louds_bits(got["parent"], len(tops))
    leaves, saved = (degrees == 0).astype(np.int64), (got["n"] - 1) * got["bytes"]
    cuts = _levels(got["parent"], len(tops))
    for start, stop in zip(cuts[-2:0:-1], cuts[:1:-1], strict=True):  # from the deepest level to the second
        np.add.at(leaves, got["parent"][start:stop], leaves[start:stop])
        np.add.at(saved, got["parent"][start:stop], saved[start:stop])
    return {
        "n_units": len(tops), "n_nodes": made, "louds": np.packbits(bits, bitorder="little").tobytes(), "labels": np.stack([got["a"], got["b"]], 1).astype("<i8").tobytes(),
        "conv_ids": got["conv"].astype("<i8").tobytes(), "n_convs": got["n"].astype("<i8").tobytes(), "n_leaves": leaves.astype("<i8").tobytes(), "saved": saved.astype("<i8").tobytes(), "tops": tops, "ends": ends,
    }


def _built(rows_kept: int):
    fields = ["ua", "ub", "conv_id", "depth", "a", "b", "pa", "pb", "n_bytes", "n", "digest"]
    types = pa.schema([("n_units", pa.int32()), ("n_nodes", pa.int32())] + [(c, pa.binary()) for c in ("louds", "labels", "conv_ids", "n_convs", "n_leaves", "saved")] + [("tops", pa.list_(pa.struct([("depth", pa.int64()), ("a", pa.int64()), ("b", pa.int64())]))), ("ends", pa.list_(pa.struct([("node", pa.int32()), ("digest", pa.string())])))])

    def image(table: pa.Table) -> pa.RecordBatch:
        v = {c: table.column(c).to_numpy() for c in fields if c != "digest"}
        new = np.r_[True, (np.diff(v["ua"]) != 0) | (np.diff(v["ub"]) != 0)]
        first = np.flatnonzero(new)
        # the node above a top: its depth, and its prefix without the top's own turn
        tops = [{"depth": int(v["depth"][i]), "a": int(v["pa"][i] ^ v["a"][i]), "b": int(v["pb"][i] ^ v["b"][i])} for i in first]
        row = forest(np.cumsum(new) - 1, v["conv_id"], v["a"], v["b"], v["n_bytes"], v["n"], table.column("digest").to_pylist(), tops)
        return pa.RecordBatch.from_pylist([row], schema=types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            while b.num_rows:
                if size < rows_kept:
                    cut = min(b.num_rows, rows_kept - size)
                    held.append(b.slice(0, cut))
                    size += cut
                    b = b.slice(cut)
                    continue
                # full: the forest ends where the unit of its last row ends
                last = (held[-1].column(0)[-1].as_py(), held[-1].column(1)[-1].as_py())
                other = (np.asarray(b.column(0)) != last[0]) | (np.asarray(b.column(1)) != last[1])
                cut = int(other.argmax()) if other.any() else b.num_rows
                held.append(b.slice(0, cut))
                size += cut
                b = b.slice(cut)
                if b.num_rows:
                    yield image(pa.Table.from_batches(held))
                    held, size = [], 0
        if held:
            yield image(pa.Table.from_batches(held))

    return run, fields


def build(turns: DataFrame, conversations: DataFrame, shard: int = SHARD) -> Trie:
    """The trie of `turns` (conv_id, depth from 1 without gaps, a, b, n_bytes) of `conversations` (distinct conv_id, those without turns
    too). No conversations, no nodes."""
    # a turn's hash with its place, so that a prefix is the XOR of its turns
    placed = turns.select("conv_id", "depth", F.xxhash64("depth", "a", "b").alias("a"), F.xxhash64(F.lit("b"), "depth", "b", "a").alias("b"), "n_bytes")
    paths = scan.running(placed.withColumnRenamed("depth", "place"), ["conv_id"], [F.col("place")], "depth", xors={"pa": "a", "pb": "b"}).drop("place")
    tails = paths.groupBy("conv_id").agg(F.max("depth").alias("size"), F.max_by(F.struct("pa", "pb"), "depth").alias("p"))
    ends = conversations.join(tails, "conv_id", "left").select("conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(n) for c, n in (("size", "size"), ("p.pa", "a"), ("p.pb", "b"))])
    distinct = written(_member_digests(ends), "trie-distinct")
    kept = paths.join(distinct.select("conv_id", "size", "n", "digest"), "conv_id")
    kept = written(kept.withColumn("digest", F.when(F.col("depth") == F.col("size"), F.col("digest"))), "trie-turns")

    node = ["depth", "pa", "pb"]
    heavy = kept.groupBy(*node).agg(F.sum(F.col("size") - F.col("depth") + 1).alias("below")).filter(F.col("below") > shard).select(*node, F.lit(True).alias("heavy"))
    marked = kept.join(small_side(written(heavy, "trie-heavy"), UPPER_BROADCAST), node, "left").withColumn("heavy", F.col("heavy").isNotNull())
    # prefixes get lighter with depth: the first light node on a conversation's path is the top of its shard
    unit = F.min(F.when(~F.col("heavy"), F.struct("depth", "pa", "pb"))).over(Window.partitionBy("conv_id"))
    marked = written(marked.withColumn("unit", unit), "trie-marked")

    run, fields = _built(shard)
    light = marked.filter(~F.col("heavy")).withColumns({"ua": F.col("unit.pa"), "ub": F.col("unit.pb")}).select(*fields)
    images = written(light.repartition("ua", "ub").sortWithinPartitions("ua", "ub", "conv_id", "depth").mapInArrow(run, _IMAGE), "trie-images")

    root = distinct.select("conv_id", *[F.lit(0).cast("long").alias(c) for c in ("depth", "pa", "pb", "n_bytes", "a", "b")], "n", F.when(F.col("size") == 0, F.col("digest")).alias("digest"))
    members = root.unionByName(marked.filter("heavy").select(root.columns))
    return Trie(images, written(_merged_upper(members, image_nodes(images).filter("top")), "trie-upper"))


def _merged_upper(members: DataFrame, tops: DataFrame) -> DataFrame:
    """Upper nodes from the paths of their members and the tops of the shards below them."""
    node = ["depth", "pa", "pb"]
    found = members.groupBy(*node).agg(
        F.min("conv_id").alias("conv_id"), F.sum("n").alias("n_convs"), F.max("n_bytes").alias("n_bytes"), F.max("digest").alias("digest"), F.max(F.col("pa").bitwiseXOR(F.col("a"))).alias("above_a"), F.max(F.col("pb").bitwiseXOR(F.col("b"))).alias("above_b")
    )
    below = found.filter("depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("above_a").alias("pa"), F.col("above_b").alias("pb")).unionByName(tops.select((F.col("depth") - 1).alias("depth"), F.col("above_a").alias("pa"), F.col("above_b").alias("pb")))
    found = written(found.join(below.groupBy(*node).agg(F.count("*").alias("n_children")), node, "left").fillna(0, ["n_children"]), "trie-upper-nodes")

    own = found.select("conv_id", "depth", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved"))
    own = own.unionByName(tops.select("conv_id", "depth", F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved")))
    none = F.lit(None).cast("long")
    rows = own.withColumns({"pa": none, "pb": none, "asks": F.lit(0)}).unionByName(members.select("conv_id", "depth", F.lit(0).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"), "pa", "pb", F.lit(1).alias("asks")))
    sums = scan.running(rows, ["conv_id"], [F.desc("depth"), F.col("asks")], "nth", sums={"n_leaves": "leaves", "saved_tokens": "saved"})
    rolled = sums.filter("asks = 1").groupBy(*node).agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    up = found.select((F.col("depth") + 1).alias("depth"), F.col("pa").alias("above_a"), F.col("pb").alias("above_b"), F.col("conv_id").alias("parent_conv_id"))
    return found.join(rolled, node).join(up, ["depth", "above_a", "above_b"], "left").drop("above_a", "above_b")


def image_nodes(images: DataFrame) -> DataFrame:
    """The nodes of shards, read from their images. A top's parent is an upper node: its prefix is above_a, above_b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                n, units = row["n_nodes"], row["n_units"]
                parents, degrees = louds_parents(row["louds"], n)
                convs, counts, leaves, saved = (np.frombuffer(row[c], "<i8") for c in ("conv_ids", "n_convs", "n_leaves", "saved"))
                top = np.array([[t["depth"], t["a"], t["b"]] for t in row["tops"]], np.int64)
                unit = np.r_[np.arange(units), np.zeros(n - units, np.int64)]
                depth = np.r_[top[:, 0], np.zeros(n - units, np.int64)]
                cuts = _levels(parents, units)
                for start, stop in zip(cuts[1:], cuts[2:], strict=False):
                    unit[start:stop], depth[start:stop] = unit[parents[start:stop]], depth[parents[start:stop]] + 1
                is_top = parents < 0
                digests = np.full(n, None, object)
                for e in row["ends"]:
                    digests[e["node"]] = e["digest"]
                columns = [pa.array(convs), pa.array(depth), pa.array(convs[np.maximum(parents, 0)], mask=is_top), pa.array(counts), pa.array(degrees), pa.array(leaves), pa.array(saved), pa.array(digests, pa.string()), pa.array(is_top)]
                columns += [pa.array(np.where(is_top, top[unit, k], 0)) for k in (1, 2)]
                yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "top", "above_a", "above_b"])

    return images.mapInArrow(run, _NODE)


def nodes(trie: Trie) -> DataFrame:
    """All nodes: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 (null where no
    conversation ends)."""
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    above = trie.upper.select((F.col("depth") + 1).alias("depth"), F.col("pa").alias("above_a"), F.col("pb").alias("above_b"), F.col("conv_id").alias("above"), F.lit(True).alias("top"))
    lower = image_nodes(trie.images).join(small_side(above, UPPER_BROADCAST), ["depth", "above_a", "above_b", "top"], "left")
    return lower.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above")).select(columns).unionByName(trie.upper.withColumnRenamed("digest", "ends_sha256").select(columns))


def prefix_trie(conversations: DataFrame, shard: int = SHARD) -> DataFrame:
    """Nodes of the trie of conversations that begin with borrowed heads; no end has the digest of nothing."""
    turns, convs = borrowed_heads(turn_rows(conversations))
    return nodes(build(turns, convs, shard)).withColumn("ends_sha256", _or_empty(F.col("ends_sha256")))


def _or_empty(digest: Column) -> Column:
    return F.coalesce(digest, F.lit(EMPTY_SHA256))
