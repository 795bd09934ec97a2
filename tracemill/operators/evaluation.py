"""Scores of a classifier against gold labels (columns gold, pred)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("gold", "pred").agg(F.count("*").alias("n"))


def per_class(pairs: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of each class that occurs on either side; 0 where undefined."""
    cells = confusion(pairs)
    sides = cells.select(F.explode(F.array(F.struct(F.col("gold").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"), F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0).alias("hit")), F.struct(F.col("pred").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("long").alias("hit")))).alias("s")).select("s.*")
    by = sides.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hit")])
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r = ratio(F.col("hit"), F.col("predicted")), ratio(F.col("hit"), F.col("support"))
    return by.select("label", "support", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(ratio(2 * p * r, p + r), 4).alias("f1"))


def summary(pairs: DataFrame) -> DataFrame:
    """Macro F1 over the classes with support, and accuracy."""
    macro = per_class(pairs).filter("support > 0").agg(F.round(F.avg("f1"), 4).alias("macro_f1"))
    whole = pairs.agg(F.round(F.avg((F.col("gold") == F.col("pred")).cast("double")), 4).alias("accuracy"), F.count("*").alias("n"))
    # both are single rows
    return macro.join(F.broadcast(whole), F.lit(True))


def directions(pairs: DataFrame, rank: dict[str, int]) -> DataFrame:
    """Under- and over-estimates on ordered levels; severe: under by two or more."""
    order = F.create_map(*[x for k, v in rank.items() for x in (F.lit(k), F.lit(v))])
    gap = order[F.col("pred")] - order[F.col("gold")]
    return pairs.agg(F.count_if(gap < 0).alias("under"), F.count_if(gap > 0).alias("over"), F.count_if(gap == 0).alias("correct"), F.count_if(gap <= -2).alias("severe"))


def gold_label(gold: Column, given: Column) -> Column:
    """The annotator's label if there is one, else the given one."""
    return F.coalesce(F.nullif(F.trim(gold), F.lit("")), given)
