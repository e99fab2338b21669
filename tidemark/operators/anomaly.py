"""Burst anomaly scores against an exponentially weighted baseline, in event time.

For a tenant, ``c_i`` is its number of CONFIDENTIAL and RESTRICTED events in window i (0 for an
empty window), ``e_first = c_first`` and ``e_i = 0.3 c_i + 0.7 e_(i-1)``.  The baseline of window i
is ``e_(i-1)``.  An event's score is its ordinal in the window over three times the baseline, at
most 1, and 0 while the baseline is below 1; from 0.8 on it is an anomaly.

Sums of powers of 0.7 differ in their last bits with the order of adding, so baseline and score are
rounded to ``DIGITS`` places before they are compared, in the batch, the stream and the SQL alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import events as E
from tidemark.operators import ordered as O

ALPHA = 0.3
SPIKE = 3.0
THRESHOLD = 0.8
DIGITS = 9
WINDOW_MS = 300_000
# Windows are numbered in blocks, inside which 0.7**-r stays far from overflow.  Over a whole block
# the weight falls to 0.7**256 < 1e-39, so the previous non-empty block is all the history needed.
BLOCK = 256


def score(ordinal: Column, baseline: Column) -> Column:
    base = F.round(baseline, DIGITS)
    return (F.when(base >= 1.0, F.least(F.round(ordinal / (base * SPIKE), DIGITS), F.lit(1.0)))
            .otherwise(F.lit(0.0)))


def score_of(ordinal: int, baseline: float | None) -> float:
    """``score`` for one value, as the stream's processor needs it."""
    base = None if baseline is None else round(baseline, DIGITS)
    return min(round(ordinal / (base * SPIKE), DIGITS), 1.0) if base is not None and base >= 1.0 else 0.0


def _decay(windows: Column) -> Column:
    return F.pow(F.lit(1.0 - ALPHA), windows)


def baselines(counts: DataFrame, window_ms: int = WINDOW_MS) -> DataFrame:
    """Add ``baseline`` to one row per (tenantId, windowStart, n) of non-empty windows.

    The average before window i is ``sum(w_j c_j 0.7**(i - 1 - j))`` over the earlier windows j,
    with w = 1 for the tenant's first window and 0.3 for the others.  With r the position in the
    block that is ``0.7**(r - 1)`` times a running sum of ``w_j c_j 0.7**-r_j``, plus what the
    previous non-empty block has left.  Idle windows add nothing and are never generated.
    """
    tenant = Window.partitionBy("tenantId")
    block = Window.partitionBy("tenantId", "_b").orderBy("_r")
    weight = F.when(F.col("_i") == F.min("_i").over(tenant), 1.0).otherwise(ALPHA)
    numbered = counts.withColumn("_i", (F.col("windowStart") / window_ms).cast("bigint")).withColumns(
        {"_b": F.floor(F.col("_i") / BLOCK), "_r": F.pmod(F.col("_i"), F.lit(BLOCK))})
    summed = (numbered.withColumn("_u", weight * F.col("n") * _decay(-F.col("_r")))
              .withColumns({"_p": F.sum("_u").over(block.rowsBetween(Window.unboundedPreceding, 0)),
                            "_q": F.sum("_u").over(block.rowsBetween(Window.unboundedPreceding, -1))}))
    # The largest running sum of a block is its total.
    earlier = Window.partitionBy("tenantId").orderBy("_b").rangeBetween(Window.unboundedPreceding, -1)
    prev = F.col("_prev")
    own = F.coalesce(F.col("_q") * _decay(F.col("_r") - 1), F.lit(0.0))
    rest = prev["_p"] * _decay(F.lit(BLOCK - 1) + F.col("_r") + (F.col("_b") - prev["_b"] - 1) * BLOCK)
    has_past = F.col("_i") > F.min("_i").over(tenant)
    return (summed.withColumn("_prev", F.max(F.struct("_b", "_p")).over(earlier))
            .withColumn("baseline", F.when(has_past, own + F.coalesce(rest, F.lit(0.0))))
            .drop("_i", "_b", "_r", "_u", "_p", "_q", "_prev"))


def window_scores(events: DataFrame, window_ms: int = WINDOW_MS) -> DataFrame:
    """Per tenant and window: events, baseline and the score of the window's last event."""
    counts = (events.where(E.is_enriched("classification"))
              .withColumn("windowStart", E.window_start("createdAt", window_ms))
              .groupBy("tenantId", "windowStart").agg(F.count(F.lit(1)).alias("n")))
    s = score(F.col("n"), F.col("baseline"))
    return (baselines(counts, window_ms)
            .withColumns({"anomalyScore": s, "anomalyDetected": s >= THRESHOLD}))


def score_events(events: DataFrame, window_ms: int = WINDOW_MS, slices: int = 8,
                 id_col: str = "id") -> DataFrame:
    """Every CONFIDENTIAL or RESTRICTED event with its ordinal in the window, score and verdict.

    Windows are cut into ``slices`` so that a heavy tenant's bursts spread over tasks.  Slice
    offsets and the baseline come from one aggregate with a row per window and its at most
    ``slices + 1`` slice counts, and reach the events in a single join on the partitioning the
    ordinal needs anyway.
    """
    slice_ms = max(window_ms // slices, 1)
    keys = ["tenantId", "windowStart"]
    ev = O.time_slice(events.where(E.is_enriched("classification"))
                      .withColumn("windowStart", E.window_start("createdAt", window_ms)), "createdAt", slice_ms)
    per_window = (ev.groupBy(*keys, O.SLICE).agg(F.count(F.lit(1)).alias("n")).groupBy(*keys)
                  .agg(F.sum("n").alias("n"), F.collect_list(F.struct(F.col(O.SLICE).alias("s"), "n")).alias("_parts")))
    earlier = lambda part: F.aggregate(F.filter("_parts", lambda p: p["s"] < part["s"]), F.lit(0).cast("bigint"),
                                       lambda acc, p: acc + p["n"])
    small = baselines(per_window, window_ms).select(*keys, "baseline", F.inline(F.transform(
        "_parts", lambda p: F.struct(p["s"].alias(O.SLICE), earlier(p).alias("_offset")))))
    ordinal = F.col("_offset") + F.row_number().over(O.slice_window(keys, ["createdAt", id_col]))
    s = score(F.col("windowedEventCount"), F.col("baseline"))
    return (ev.join(small, [*keys, O.SLICE])
            .withColumn("windowedEventCount", ordinal.cast("bigint"))
            .withColumns({"anomalyScore": s, "anomalyDetected": s >= THRESHOLD})
            .drop("_offset", O.SLICE))


def anomalies(scored: DataFrame) -> DataFrame:
    """The events worth forwarding to the other copy at once."""
    return scored.where("anomalyDetected")


def running_tenant_count(events: DataFrame, window_ms: int = WINDOW_MS, id_col: str = "id") -> DataFrame:
    """Position of each enrichment-path event within its tenant's window."""
    ev = (events.where(E.is_enriched("classification"))
          .withColumn("windowStart", E.window_start("createdAt", window_ms)))
    return O.with_ordinal(ev, ["tenantId", "windowStart"], "createdAt", id_col, "windowedEventCount",
                          max(window_ms // 8, 1))
