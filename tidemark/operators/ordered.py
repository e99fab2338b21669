"""Ordered per-key computations that keep working when one key holds most of the rows.

A plain ``Window.partitionBy(key)`` sorts a whole key in one task.  The caller says what a key is.  A
key that is small by nature (an event, a trace, an account) is a plain window.  For one that can be
heavy (a tenant, a cloud, a series) the caller gives a slice length: every timeline is cut at its
multiples, row-level windows run per (key, slice), a summary with one row per (key, slice) is built by
ordinary partial aggregation, and what a slice inherits from the earlier ones (an offset, the last
value, the last break) is found by a window over that summary.  A key has at most ``time span / slice
length`` summary rows, and the join back uses the same (key, slice) partitioning as the row-level
window, so the rows are shuffled once.  Nothing is counted to find out which keys are heavy.

Keys and times must not be null, and (time, tie) must be unique within a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# With five minutes, a key that holds a third of 100 TB spread over a month has about 4 GB per
# slice, and no key has more than 8928 summary rows per month.
SLICE_MS = 300_000
SLICE = "_slice"


def time_slice(df: DataFrame, ts: str, slice_ms: int = SLICE_MS) -> DataFrame:
    """Cut every key by an epoch-millis column; a chain of steps does it once and shares one shuffle."""
    return df.withColumn(SLICE, F.floor(F.col(ts) / F.lit(slice_ms)))


def _whole(df: DataFrame, slice_ms: int | None) -> bool:
    """No slices were asked for: the key is small by nature."""
    return slice_ms is None and SLICE not in df.columns


def _sliced(df: DataFrame, ts: str, slice_ms: int | None) -> tuple[DataFrame, list[str]]:
    """The sliced input and the helper column to drop afterwards."""
    return (df, []) if SLICE in df.columns else (time_slice(df, ts, slice_ms), [SLICE])


def _running(keys: list[str], order: list[str], upto: int = 0) -> Window:
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, upto)


def slice_window(keys: list[str], order: list[str]) -> Window:
    return Window.partitionBy(*keys, SLICE).orderBy(*order)


def carry(df: DataFrame, keys: list[str], summary: dict[str, Column],
          carried: dict[str, tuple], forward: bool = True) -> DataFrame:
    """Join to every row what its slice inherits from the earlier (or later) slices of its key.

    ``summary`` names aggregates per (key, slice); ``carried`` maps an output column to
    ``(function, summary column)`` evaluated over the preceding slices (the following ones when
    ``forward`` is false).
    """
    per_slice = df.groupBy(*keys, SLICE).agg(*[c.alias(n) for n, c in summary.items()])
    order = Window.partitionBy(*keys).orderBy(F.col(SLICE) if forward else F.col(SLICE).desc())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    inherited = per_slice.select(
        *keys, SLICE, *[fn(F.col(c)).over(before).alias(n) for n, (fn, c) in carried.items()])
    return df.join(inherited, [*keys, SLICE], "left").select(*df.columns, *carried)


def _last(c: Column) -> Column:
    return F.last(c, ignorenulls=True)


def with_ordinal(df: DataFrame, keys: list[str], ts: str, tie: str, out: str,
                 slice_ms: int | None = None) -> DataFrame:
    """1-based position of each row in its key, ordered by (ts, tie)."""
    if _whole(df, slice_ms):
        return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(ts, tie)).cast("bigint"))
    sliced, own = _sliced(df, ts, slice_ms)
    joined = carry(sliced, keys, {"_n": F.count(F.lit(1))}, {"_offset": (F.sum, "_n")})
    position = F.row_number().over(slice_window(keys, [ts, tie]))
    return (joined.withColumn(out, (F.coalesce("_offset", F.lit(0)) + position).cast("bigint"))
            .drop("_offset", *own))


def with_previous(df: DataFrame, keys: list[str], ts: str, tie: str, values: dict[str, str],
                  slice_ms: int | None = None) -> DataFrame:
    """``lag`` of several columns: ``values`` maps output name to column."""
    if _whole(df, slice_ms):
        w = Window.partitionBy(*keys).orderBy(ts, tie)
        return df.select("*", *[F.lag(c).over(w).alias(n) for n, c in values.items()])
    sliced, own = _sliced(df, ts, slice_ms)
    packed = F.struct(*[F.col(c).alias(n) for n, c in values.items()])
    joined = carry(sliced, keys, {"_tail": F.max_by(packed, F.struct(ts, tie))},
                   {"_prev": (_last, "_tail")})
    w = slice_window(keys, [ts, tie])
    joined = joined.withColumn("_prev", F.coalesce(F.lag(packed).over(w), F.col("_prev")))
    return joined.select("*", *[F.col("_prev")[n].alias(n) for n in values]).drop("_prev", *own)


def with_next(df: DataFrame, keys: list[str], ts: str, tie: str, values: dict[str, str],
              slice_ms: int | None = None) -> DataFrame:
    """``lead`` of several columns."""
    if _whole(df, slice_ms):
        w = Window.partitionBy(*keys).orderBy(ts, tie)
        return df.select("*", *[F.lead(c).over(w).alias(n) for n, c in values.items()])
    sliced, own = _sliced(df, ts, slice_ms)
    packed = F.struct(*[F.col(c).alias(n) for n, c in values.items()])
    joined = carry(sliced, keys, {"_head": F.min_by(packed, F.struct(ts, tie))},
                   {"_next": (_last, "_head")}, forward=False)
    w = slice_window(keys, [ts, tie])
    joined = joined.withColumn("_next", F.coalesce(F.lead(packed).over(w), F.col("_next")))
    return joined.select("*", *[F.col("_next")[n].alias(n) for n in values]).drop("_next", *own)


def with_last_break(df: DataFrame, keys: list[str], ts: str, tie: str, is_break: Column,
                    out: str, slice_ms: int | None = None) -> DataFrame:
    """Position ``struct(ts, tie)`` of the latest break row before each row.

    Rows of one uninterrupted run share it, so (key, out) identifies the run and a plain
    ``groupBy`` with partial aggregation measures it.
    """
    at = F.when(is_break, F.struct(F.col(ts).alias("ts"), F.col(tie).alias("tie")))
    if _whole(df, slice_ms):
        return df.withColumn(out, F.max(at).over(_running(keys, [ts, tie], -1)))
    sliced, own = _sliced(df, ts, slice_ms)
    sliced = sliced.withColumn("_at", at)
    joined = carry(sliced, keys, {"_max": F.max("_at")}, {"_carried": (F.max, "_max")})
    w = slice_window(keys, [ts, tie]).rowsBetween(Window.unboundedPreceding, -1)
    within = F.max("_at").over(w)
    return (joined.withColumn(out, F.coalesce(within, F.col("_carried")))
            .drop("_at", "_carried", *own))


def with_running_sum(df: DataFrame, keys: list[str], ts: str, tie: str, value: Column, out: str,
                     slice_ms: int | None = None) -> DataFrame:
    """Inclusive running sum of an integer expression."""
    if _whole(df, slice_ms):
        return df.withColumn(out, F.sum(value).over(_running(keys, [ts, tie])))
    sliced, own = _sliced(df, ts, slice_ms)
    sliced = sliced.withColumn("_v", value)
    joined = carry(sliced, keys, {"_s": F.sum("_v")}, {"_before": (F.sum, "_s")})
    w = slice_window(keys, [ts, tie]).rowsBetween(Window.unboundedPreceding, 0)
    return (joined.withColumn(out, F.coalesce("_before", F.lit(0)) + F.sum("_v").over(w))
            .drop("_v", "_before", *own))


def with_running_max(df: DataFrame, keys: list[str], ts: str, tie: str, value: Column, out: str,
                     slice_ms: int | None = None) -> DataFrame:
    """Running maximum of the earlier rows and the row itself."""
    if _whole(df, slice_ms):
        return df.withColumn(out, F.max(value).over(_running(keys, [ts, tie])))
    sliced, own = _sliced(df, ts, slice_ms)
    sliced = sliced.withColumn("_v", value)
    joined = carry(sliced, keys, {"_m": F.max("_v")}, {"_before": (F.max, "_m")})
    w = slice_window(keys, [ts, tie]).rowsBetween(Window.unboundedPreceding, 0)
    return (joined.withColumn(out, F.greatest("_before", F.max("_v").over(w)))
            .drop("_v", "_before", *own))
