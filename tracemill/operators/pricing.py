"""Prices with history: cost of usage by the price valid at its time, and maintenance of the history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KINDS = (("input_tokens", "input_price"), ("output_tokens", "output_price"), ("cache_creation_tokens", "cache_write_price"), ("cache_read_tokens", "cache_read_price"))
#: Price rows up to which the table is broadcast.
SMALL_PRICES = 50_000


def priced(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Each usage row with the price row of its model that is valid at its time (from_date included, to_date not; open if
    null), and its cost. An equi-join on the model with the range as residual; unpriced rows stay, at cost 0."""
    small = prices.limit(SMALL_PRICES + 1).count() <= SMALL_PRICES
    p = prices.select(F.col("model").alias("p_model"), *[F.col(price) for _, price in KINDS], "from_date", "to_date")
    on = (F.col("model") == F.col("p_model")) & (F.col("ts_raw") >= F.col("from_date")) & (F.col("to_date").isNull() | (F.col("ts_raw") < F.col("to_date")))
    return usage.join(F.broadcast(p) if small else p, on, "left").withColumn("cost", cost())


def part(tokens: str, price: str) -> Column:
    return F.coalesce(F.col(tokens), F.lit(0)) * F.coalesce(F.col(price), F.lit(0.0)) / F.lit(1e6)


def cost() -> Column:
    a, b, c, d = (part(*k) for k in KINDS)
    return a + b + c + d


def overlaps(prices: DataFrame) -> DataFrame:
    """Models with price rows whose ranges overlap, and with more than one open row."""
    w = Window.partitionBy("model").orderBy("from_date")
    following = F.lead("from_date").over(w)
    bad = prices.withColumn("next", following).filter(F.col("next").isNotNull() & (F.col("to_date").isNull() | (F.col("to_date") > F.col("next"))))
    return bad.groupBy("model").agg(F.count("*").alias("overlaps"))


def seed(prices: DataFrame, defaults: DataFrame) -> DataFrame:
    """`prices` and those defaults whose model has no row at all."""
    return prices.unionByName(defaults.join(prices.select("model").distinct(), "model", "left_anti").select(prices.columns))


def conflicts(prices: DataFrame, change: DataFrame) -> DataFrame:
    """Rows of `change` whose range overlaps a price of its model that they neither end (an open earlier one) nor replace
    (one of the same from_date)."""
    p = prices.select("model", F.col("from_date").alias("p_from"), F.col("to_date").alias("p_to"))
    ended = F.col("p_to").isNull() & (F.col("p_from") < F.col("from_date"))
    apart = (F.col("p_to") <= F.col("from_date")) | (F.col("to_date") <= F.col("p_from"))
    bad = (F.col("p_from") != F.col("from_date")) & ~ended & ~F.coalesce(apart, F.lit(False))
    return change.join(p, "model").filter(bad).select("model", "from_date").distinct()


def upsert(prices: DataFrame, change: DataFrame) -> DataFrame:
    """`change` (one row for a model: its new price from from_date on) ends the open earlier row, and replaces one of the
    same from_date. Rows that would overlap others (see `conflicts`) are left out."""
    change = change.join(conflicts(prices, change), ["model", "from_date"], "left_anti")
    new = change.select(F.col("model").alias("c_model"), F.col("from_date").alias("c_from"))
    kept = prices.join(new, F.col("model") == F.col("c_model"), "left").filter(F.col("c_from").isNull() | (F.col("from_date") != F.col("c_from")))
    ends = F.col("c_from").isNotNull() & F.col("to_date").isNull() & (F.col("from_date") < F.col("c_from"))
    kept = kept.withColumn("to_date", F.when(ends, F.col("c_from")).otherwise(F.col("to_date")))
    return kept.select(prices.columns).unionByName(change.select(prices.columns))


def listed(prices: DataFrame, model: str | None = None, active: bool = False) -> DataFrame:
    out = prices if model is None else prices.filter(F.col("model") == model)
    return out.filter("to_date is null") if active else out
