"""Running values over long groups: a scan in segments.

A window by key puts all rows of a key into one task. Here rows are dealt out by ranges of (key, order), so that a long key
is cut into segments; each task scans its own rows, and only what each segment ends with meets across tasks. At most one
key of a task goes on from an earlier one, so that what is handed over has at most a row for each task."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .storage import written


def _free(df: DataFrame, name: str) -> str:
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _begins(batch: pa.RecordBatch, keys: list[str], before: list | None) -> np.ndarray:
    """Whether each row has another key than the row before it."""
    out = np.zeros(batch.num_rows, bool)
    for i, k in enumerate(keys):
        column = batch.column(batch.schema.get_field_index(k))
        null = column.is_null()
        here, last = column.slice(1), column.slice(0, batch.num_rows - 1)
        differs = pc.fill_null(pc.not_equal(here, last), False)
        out[1:] |= np.asarray(pc.or_(differs, pc.xor(null.slice(1), null.slice(0, batch.num_rows - 1))))
        out[0] |= before is None or column[0].as_py() != before[i]
    return out


def running(df: DataFrame, keys: list[str], order: list[Column], number: str, sums: Mapping[str, str] | None = None, xors: Mapping[str, str] | None = None, mins: Mapping[str, str] | None = None, lasts: Mapping[str, str] | None = None, lags: Mapping[str, str] | None = None, drop: tuple[str, ...] = ()) -> DataFrame:
    """`df`, without the columns `drop` that only `order` needs, with columns that run along each key's rows in `order`, the row itself included: `number` counts rows from 1; for
    each (new: old) `sums` adds up and `xors` combines a column of longs (nulls count as 0), `mins` holds the least of a column of longs
    without nulls, `lasts` the last value that is not null, and `lags` (the only one without the row itself) the value of the
    row before.

    Null keys are a key of their own; rows that tie in `order` follow each other in any one order, the same for all columns;
    the result is a table in the shared folder. `keys` are columns that compare with =, of a type that Arrow compares."""
    sums, xors, mins, lasts, lags = (dict(x or {}) for x in (sums, xors, mins, lasts, lags))
    dealt = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).drop(*drop)
    df = df.drop(*drop)
    part = _free(df, "part")
    news = [StructField(c, LongType()) for c in (number, *sums, *xors, *mins)] + [StructField(new, df.schema[old].dataType) for new, old in (*lasts.items(), *lags.items())]
    schema = StructType([*df.schema.fields, StructField(part, LongType()), *news])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        me = TaskContext.get().partitionId()
        before: list | None = None
        count, totals, held = 0, dict.fromkeys((*sums, *xors, *mins), 0), dict.fromkeys((*lasts, *lags))
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            begins, at = _begins(b, keys, before), np.arange(n)
            first = np.maximum.accumulate(np.where(begins, at, 0))  # of the row's key in this batch
            goes_on = np.logical_not(np.maximum.accumulate(begins))  # rows of the key that the batch before ended with
            out = [at - first + 1 + np.where(goes_on, count, 0)]
            count = int(out[0][-1])
            for new, old in (*sums.items(), *xors.items(), *mins.items()):
                v = np.asarray(b.column(b.schema.get_field_index(old)).cast(pa.int64()).fill_null(0))
                if new in sums:
                    c = np.cumsum(v)
                    c = c - (c - v)[first] + np.where(goes_on, totals[new], 0)
                elif new in mins:  # each key of the batch lies lower than those before it
                    lower = np.cumsum(begins) * (int(v.max()) - int(v.min()) + 1)
                    c = np.minimum.accumulate(v - lower) + lower
                    c = np.where(goes_on, np.minimum(c, totals[new]), c)
                else:
                    c = np.bitwise_xor.accumulate(v)
                    c = c ^ (c ^ v)[first] ^ np.where(goes_on, totals[new], 0)
                totals[new] = int(c[-1])
                out.append(c)
            arrays = [pa.array(c, pa.int64()) for c in out]
            for new, old in lasts.items():
                column = b.column(b.schema.get_field_index(old))
                last = np.maximum.accumulate(np.where(np.asarray(column.is_valid()), at, -1))
                inside = last >= first
                taken = column.take(pa.array(np.where(inside, last, 0), pa.int64(), mask=~inside))
                carried = goes_on & ~inside
                if held[new] is not None and held[new].is_valid and carried.any():
                    k = int(carried.sum())  # they are the first rows
                    taken = pa.concat_arrays([pa.repeat(held[new], k), taken.slice(k)])
                held[new] = taken[n - 1]
                arrays.append(taken)
            for new, old in lags.items():
                column = b.column(b.schema.get_field_index(old))
                behind = column.take(pa.array(np.maximum(at - 1, 0), pa.int64(), mask=at == first))
                if goes_on[0] and held[new].is_valid:
                    behind = pa.concat_arrays([pa.repeat(held[new], 1), behind.slice(1)])
                held[new] = column[n - 1]
                arrays.append(behind)
            before = [b.column(b.schema.get_field_index(k))[n - 1].as_py() for k in keys]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(n, me)), *arrays], names=[*b.schema.names, part, *[f.name for f in news]])

    # range bounds come from a sample: the rows are kept, so that all that follows sees one placement
    rows = written(dealt.mapInArrow(run, schema), "scan")
    ends = rows.groupBy(*keys, part).agg(F.max_by(F.struct(*[f.name for f in news], *[F.col(old).alias(f"of {new}") for new, old in lags.items()]), number).alias("e"))
    earlier = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    combined = [F.sum(f"e.{c}").over(earlier).alias(c) for c in (number, *sums)] + [F.expr(f"bit_xor(e.`{c}`)").over(earlier).alias(c) for c in xors] + [F.min(f"e.{c}").over(earlier).alias(c) for c in mins]
    combined += [F.last(f"e.{c}", ignorenulls=True).over(earlier).alias(c) for c in lasts] + [F.last(f"e.`of {c}`").over(earlier).alias(c) for c in lags]
    given = ends.select(*keys, part, *combined).filter(F.col(number).isNotNull())
    r, g = rows.alias("r"), F.broadcast(given.alias("g"))  # at most one row for each task
    same = F.col(f"r.{part}") == F.col(f"g.{part}")
    for k in keys:
        same = same & F.col(f"r.{k}").eqNullSafe(F.col(f"g.{k}"))
    col = lambda side, c: F.col(f"{side}.`{c}`")
    final = [(col("r", c) + F.coalesce(col("g", c), F.lit(0))).alias(c) for c in (number, *sums)]
    final += [col("r", c).bitwiseXOR(F.coalesce(col("g", c), F.lit(0))).alias(c) for c in xors]
    final += [F.least(col("r", c), col("g", c)).alias(c) for c in mins]
    final += [F.coalesce(col("r", c), col("g", c)).alias(c) for c in lasts]
    final += [F.when(col("r", number) == 1, col("g", c)).otherwise(col("r", c)).alias(c) for c in lags]
    return r.join(g, same, "left").select(*[col("r", c).alias(c) for c in df.columns], *final)
