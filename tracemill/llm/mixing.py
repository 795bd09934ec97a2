"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree. DataFrame and SQL functions only.

Each source's documents are dealt into blocks by hash (documents of over 1/1024 of their source are blocks of their own).
A source's target fixes how often its blocks are drawn: every block as often as the target holds the source whole, and
once more for enough permuted blocks to reach the rest; the last block is drawn in part. These exact quotas are split
among the output shards by a binary tree: at each node the left half of the shards receives a multivariate
hypergeometric draw from the node's quotas, source by source. Each shard then takes its own, disjoint range of every
source's permuted draws, and its documents are shuffled within the shard.

Everything drawn is a hash of (seed, ...), so that reruns agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, checkpointed, small_side

WEIGHTS = (3.0, 1.0, 2.0)
TOTAL = 1.5
MOST = 2
SHARDS = 16
SEED = 11
#: Blocks of a source at most; also the share of its source above which a document is a block of its own.
BLOCKS = 1024
#: Rows of the tables of sources and blocks up to which they are broadcast; beyond, Spark joins by shuffle.
SMALL_ROWS = 200_000


def sized(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, source, size (words; 0 for null) and a permuting key of each row."""
    return docs.select(F.col("doc_id").alias("doc_id"), *_sized_columns(seed))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, total: float = TOTAL, most: int = MOST) -> DataFrame:
    """One row for each source: number (from 0, by code point, null last), source, source_size, docs, target.

    Water filling: sources are capped in the order of cap / weight; with the first k capped, the others share what is
    left by weight. The first k at which the next source stays below its cap is the answer. The windows hold one row for
    each source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    given = F.array(*[F.lit(float(w)) for w in weights])
    numbered = per.withColumn("number", F.row_number().over(order) - 1).withColumn("weight", F.element_at(given, (F.col("number") % len(weights) + 1).cast("int")))
    by_cap = Window.orderBy(F.col("source_size") / F.col("weight"), "number")
    before, every = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.lit(total) * F.sum("source_size").over(every) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    level = left / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    below = level * F.col("weight") <= most * F.col("source_size")
    filled = numbered.withColumn("level", level).withColumn("fits", below).withColumn("capped", F.row_number().over(by_cap))
    first = F.min(F.when(F.col("fits"), F.struct("capped", "level"))).over(Window.partitionBy())
    chosen = first["level"]
    cap = F.col("source_size") * F.lit(float(most))
    return filled.withColumn("target", F.coalesce(F.least(cap, chosen * F.col("weight")), cap)).select("number", "source", "source_size", "docs", "target")


def _log_factorial(x: str) -> str:
    """SQL for ln(x!): exact below 16, Stirling's series (error below 1e-10) from there."""
    exact = ", ".join(f"{math.lgamma(i + 1)!r}D" for i in range(16))
    return f"if({x} < 16, element_at(array({exact}), cast({x} as int) + 1), {x} * ln({x}) - {x} + 0.5D * ln(6.283185307179586D * {x}) + 1D / (12D * {x}) - 1D / (360D * power({x}, 3)))"


def hypergeometric(population: str, marked: str, drawn: str, uniform: str) -> str:
    """SQL for the number of `marked` ones among `drawn` of `population`, by inversion at `uniform` in (0, 1). Only the
    range within 12 standard deviations of the mean is summed; outside it the probability is below 1e-30."""

    def choose(n: str, k: str) -> str:
        return f"({_log_factorial(n)} - {_log_factorial(k)} - {_log_factorial(f'({n} - {k})')})"

    lo, hi = f"greatest(0L, {drawn} - ({population} - {marked}))", f"least({marked}, {drawn})"
    mean = f"(1D * {drawn} * {marked} / {population})"
    spread = f"(12D * sqrt({mean}) + 12)"
    span = f"sequence(greatest({lo}, cast(floor({mean} - {spread}) as bigint)), least({hi}, cast(ceil({mean} + {spread}) as bigint)))"
    p = f"exp({choose(marked, 'k')} + {choose(f'({population} - {marked})', f'({drawn} - k)')} - {choose(population, drawn)})"
    start = f"named_struct('sum', 0D, 'x', {lo})"
    step = f"(s, k) -> if(s.sum >= {uniform}, s, named_struct('sum', s.sum + {p}, 'x', k))"
    return f"if({marked} = 0 or {drawn} = 0, 0L, if({drawn} = {population}, {marked}, aggregate({span}, {start}, {step}, s -> s.x)))"


def split_quotas(quotas: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(shard, number, quota) from (number, quota): the splitting tree, one level after the other. A node is one row with
    an array of its sources' quotas; its left half gets half of the draws."""
    levels = max(0, shards - 1).bit_length()
    if 1 << levels != shards:
        raise ValueError("the number of shards is a power of two")
    draws = F.array_sort(F.collect_list(F.struct("number", F.col("quota").cast("long").alias("quota"))))
    nodes = quotas.agg(draws.alias("quotas")).select(F.lit(0).cast("long").alias("node"), "quotas")
    for level in range(levels):
        uniform = f"((pmod(xxhash64({seed}, {level}, node, q.number), 4503599627370496) + 0.5D) / 4503599627370496D)"
        got = hypergeometric("a.rest", "q.quota", "a.drawn", uniform)
        # the draw is bound to a variable by a one-element transform, so that it is made once
        step = f"""(a, q) -> element_at(transform(array({got}), x -> named_struct('rest', a.rest - q.quota, 'drawn', a.drawn - x,
            'left', concat(a.left, array(named_struct('number', q.number, 'quota', x))))), 1)"""
        total = "aggregate(quotas, 0L, (t, q) -> t + q.quota)"
        start = f"named_struct('rest', {total}, 'drawn', {total} div 2, 'left', cast(array() as array<struct<number:int,quota:bigint>>))"
        split = nodes.withColumn("left", F.expr(f"aggregate(quotas, {start}, {step}, a -> a.left)"))
        right = F.expr("zip_with(quotas, left, (q, l) -> named_struct('number', q.number, 'quota', q.quota - l.quota))")
        halves = F.array(F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("quotas")), F.struct((F.col("node") * 2 + 1).alias("node"), right.alias("quotas")))
        nodes = split.select(F.explode(halves).alias("half")).select("half.node", "half.quotas")
    return nodes.select(F.col("node").alias("shard"), F.explode("quotas").alias("q")).select("shard", "q.number", "q.quota")


def plan(sizes: DataFrame, weights=WEIGHTS, total: float = TOTAL, most: int = MOST, shards: int = SHARDS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Sources (see `targets`, with the number of whole copies `base`), and blocks: number, large, block, cut (documents
    of a block drawn in part take its last copy up to this key) and the shards of the block's copies."""
    sources = targets(sizes, weights, total, most).withColumn("base", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
    sources = checkpointed(sources.withColumn("extra", F.when(F.col("source_size") > 0, F.greatest(F.lit(0.0), F.col("target") - F.col("base") * F.col("source_size"))).otherwise(0.0)))
    placed = checkpointed(place(sizes, sources).select("number", "large", "block", "size", "key"))
    units = placed.groupBy("number", "large", "block").agg(F.sum("size").alias("size")).join(small_side(sources.select("number", "source_size", "base", "extra"), SMALL_ROWS), "number")
    # large documents: a permuted prefix that comes nearest to their share of the rest
    permuted = F.xxhash64(F.lit(seed + 1), "number", "block")
    one = Window.partitionBy("number").orderBy(permuted, "block").rowsBetween(Window.unboundedPreceding, 0)
    big = units.filter("large").withColumn("sum", F.sum("size").over(one)).withColumn("all", F.sum("size").over(Window.partitionBy("number")))
    big = big.withColumn("full", F.col("sum") - F.col("size") / 2 < F.col("extra") * F.col("all") / F.col("source_size"))
    taken = big.filter("full").groupBy("number").agg(F.sum("size").alias("by_large"))
    # blocks of the others: whole ones while they fit what is left, then one in part
    small = units.filter("not large").join(taken, "number", "left").withColumn("rest", F.col("extra") - F.coalesce("by_large", F.lit(0))).withColumn("sum", F.sum("size").over(one))
    small = small.withColumn("full", F.col("sum") <= F.col("rest")).withColumn("room", F.col("rest") - (F.col("sum") - F.col("size")))
    part = small.filter((~F.col("full")) & (F.col("room") > 0)).select("number", "block", "room")
    within = Window.partitionBy("number", "block").orderBy("key").rangeBetween(Window.unboundedPreceding, 0)
    inside = placed.filter("not large").join(small_side(part, SMALL_ROWS), ["number", "block"]).withColumn("sum", F.sum("size").over(within))
    cuts = inside.filter(F.col("sum") - F.col("size") / 2 <= F.col("room")).groupBy("number", "block").agg(F.max("key").alias("cut"))
    drawn = big.select("number", "large", "block", "base", "full", F.lit(None).cast("long").alias("cut"))
    drawn = drawn.unionByName(small.join(cuts, ["number", "block"], "left").select("number", "large", "block", "base", "full", "cut"))
    copies = F.col("base") + F.when(F.col("full") | F.col("cut").isNotNull(), 1).otherwise(0)
    drawn = checkpointed(drawn.select("number", "large", "block", "cut", copies.alias("copies")).filter("copies > 0"))
    quotas = drawn.groupBy("number").agg(F.sum("copies").alias("quota"))
    # each shard's range of the permuted draws of each source
    share = Window.partitionBy("number").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    ranges = split_quotas(quotas, shards, seed).withColumn("end", F.sum("quota").over(share)).filter("quota > 0")
    slots = ranges.select("number", "shard", F.explode(F.sequence(F.col("end") - F.col("quota") + 1, F.col("end"))).alias("rank"))
    draws = drawn.select("number", "large", "block", "cut", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    rank = F.row_number().over(Window.partitionBy("number").orderBy(F.xxhash64(F.lit(seed + 2), "number", "block", "copy"), "block", "copy")).cast("long")
    mixed = draws.withColumn("rank", rank).join(slots, ["number", "rank"])
    order = F.array_sort(F.collect_list(F.struct("copy", F.col("shard").cast("int").alias("shard"))))
    blocks = mixed.groupBy("number", "large", "block").agg(F.first("cut").alias("cut"), order.alias("copies"))
    return sources, checkpointed(blocks.select("number", "large", "block", "cut", F.col("copies.shard").alias("shards")))


def place(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """`sizes` with its source's columns and the block of each row."""
    small = small_side(sources, SMALL_ROWS)
    joined = sizes.join(small.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    large = F.col("size") * BLOCKS > F.col("source_size")
    blocks = F.least(F.lit(BLOCKS), F.greatest(F.lit(1), F.expr("docs div 16")))
    return joined.withColumn("large", large).withColumn("block", F.when(large, F.col("key")).otherwise(F.pmod(F.xxhash64("key"), blocks)))


def _drawn(placed: DataFrame, blocks: DataFrame) -> DataFrame:
    """Adds `shards`: the output shard of each copy that is taken of a row (empty: not taken)."""
    marked = blocks.select(F.col("number").alias("__n"), F.col("large").alias("__l"), F.col("block").alias("__b"), F.col("cut").alias("__cut"), F.col("shards").alias("__shards"))
    on = (F.col("number") == F.col("__n")) & (F.col("large") == F.col("__l")) & (F.col("block") == F.col("__b"))
    joined = placed.join(small_side(marked, SMALL_ROWS), on, "left")
    beyond = F.col("__cut").isNotNull() & (F.col("key") > F.col("__cut"))
    shards = F.when(F.col("__shards").isNull(), F.array().cast("array<int>")).when(beyond, F.slice("__shards", 1, F.size("__shards") - 1)).otherwise(F.col("__shards"))
    return joined.withColumn("shards", shards).drop("__n", "__l", "__b", "__cut", "__shards")


def mix_report(docs: DataFrame, seed: int = SEED, **settings) -> DataFrame:
    """One row for each row of `docs`: doc_id, size, source_size, target, taken and the shards of its copies.

    A null source is a source of its own, sorted last; null texts have size 0; rows that repeat are drawn together; a
    source without words has target 0 and none of its rows is taken; an empty table gives no rows; other columns are
    ignored. No row is taken more often than `most` times."""
    sizes = checkpointed(sized(docs, seed))
    sources, blocks = plan(sizes, seed=seed, **settings)
    rows = _drawn(place(sizes, sources), blocks)
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("shards")).alias("taken"), "shards")


def mixed(docs: DataFrame, seed: int = SEED, **settings) -> DataFrame:
    """The mix itself: rows of `docs` with all their columns, each as often as it is taken, brought together by shard and
    shuffled within. Only this last step moves texts."""
    names = docs.columns
    sizes = checkpointed(sized(docs, seed))
    sources, blocks = plan(sizes, seed=seed, **settings)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"), *_sized_columns(seed))
    rows = _drawn(place(whole, sources), blocks).select("__row", "key", F.posexplode("shards").alias("copy", "shard"))
    shuffled = F.xxhash64(F.lit(seed + 3), "key", "copy")
    # a shard may be large: it is cut into permuted pieces, each shuffled within
    return rows.repartition("shard", F.pmod(shuffled, F.lit(64))).sortWithinPartitions("shard", shuffled).select("__row.*")


def _sized_columns(seed: int) -> tuple[Column, ...]:
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return F.col("source").cast("string").alias("source"), words.alias("size"), F.xxhash64(F.lit(seed), F.col("doc_id"), F.length("text")).alias("key")
