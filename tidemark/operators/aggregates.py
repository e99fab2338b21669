"""Grouped aggregates.

Each is a ``groupBy`` with map-side partial aggregation, so a tenant that holds most of the rows
costs one small partial row per map task, not a hot reducer.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from tidemark import schema as S
from tidemark.functions import events as E
from tidemark.operators import rollups as RU

FIVE_MINUTES_MS = 300_000


COUNT_KEYS = ["tenantId", "classification", "eventType", "schemaVersion", "date"]


def _counted(groups: GroupedData, *more: Column) -> DataFrame:
    return groups.agg(
        F.count(F.lit(1)).alias("eventCount"), F.sum("payloadSizeBytes").alias("totalPayloadBytes"),
        E.count_if(F.col("anomalyDetected")).alias("anomalyCount"),
        F.min("createdAt").alias("firstEventAt"), F.max("createdAt").alias("lastEventAt"), *more)


def _with_average(counts: DataFrame) -> DataFrame:
    return counts.withColumn("avgPayloadBytes", F.col("totalPayloadBytes") / F.col("eventCount"))


def event_counts(df: DataFrame) -> DataFrame:
    """Counts, bytes, anomalies and the time span per tenant, class, type, version and day."""
    return _with_average(_counted(df.groupBy(*COUNT_KEYS)))


def base_counts(df: DataFrame) -> DataFrame:
    """The finest grouping that the daily counts, the hourly rate and the type ranks are all sums of.

    With a sketch of the latencies, whose merges give the percentiles of any wider group.
    """
    latency = "enrichmentLatencyMs"
    return _counted(df.groupBy(*COUNT_KEYS, "hour"), F.count(F.lit(1)).alias("sampleCount"), F.max(latency).alias("maxLatencyMs"),
                    RU.sketch(latency).alias("sketch"))


def daily_base(df: DataFrame) -> DataFrame:
    """What the daily outputs are sums of, from one pass: the finest counts, and each day's latencies by value.

    Rows with ``ofLatency`` are the latter; both kinds are as many as there are groups, not events.
    """
    latency = "enrichmentLatencyMs"
    finest = [*COUNT_KEYS, "hour"]
    sets = df.groupingSets([finest, ["tenantId", "date", latency]], *finest, latency)
    return _counted(sets, (F.grouping("hour") == 1).alias("ofLatency"))


def latency_stats_of(base: DataFrame) -> DataFrame:
    """``latency_stats`` from ``daily_base``."""
    counts = base.where("ofLatency").select("tenantId", "date", "enrichmentLatencyMs", F.col("eventCount").alias("_n"))
    return _latency_stats(counts, ("tenantId", "date"))


def event_counts_of(base: DataFrame) -> DataFrame:
    """``event_counts`` from ``base_counts``."""
    return _with_average(base.groupBy(*COUNT_KEYS).agg(
        F.sum("eventCount").alias("eventCount"), F.sum("totalPayloadBytes").alias("totalPayloadBytes"),
        F.sum("anomalyCount").alias("anomalyCount"), F.min("firstEventAt").alias("firstEventAt"),
        F.max("lastEventAt").alias("lastEventAt")))


def hourly_rate_of(base: DataFrame) -> DataFrame:
    """``hourly_rate`` from ``base_counts``."""
    return base.groupBy("tenantId", "date", "hour").agg(F.sum("eventCount").alias("eventCount"))


def ranked(counts: DataFrame, keys: tuple, value: str, n: str) -> DataFrame:
    """Beside the ``n`` rows of each distinct value of a group: how many values are at or below it, and how many there are.

    A group's distinct values are sorted, not its rows; nulls are no values.
    """
    group = Window.partitionBy(*keys)
    upto = group.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = F.when(F.col(value).isNotNull(), F.col(n)).otherwise(0)
    return counts.withColumns({"_upto": F.sum(own).over(upto), "_all": F.sum(own).over(group)})


def percentile(value: str, fraction: float) -> Column:
    """The least value at or below which lies ``fraction`` of the group, exactly; an aggregate over ``ranked`` rows."""
    share = Fraction(str(fraction))
    return F.min(F.when(F.col("_upto") * share.denominator >= F.col("_all") * share.numerator, F.col(value)))


def _latency_stats(counts: DataFrame, keys: tuple) -> DataFrame:
    value = "enrichmentLatencyMs"
    return (ranked(counts, keys, value, "_n").groupBy(*keys)
            .agg(F.sum("_n").alias("sampleCount"), F.max(value).alias("maxLatencyMs"), percentile(value, 0.50).alias("p50LatencyMs"),
                 percentile(value, 0.95).alias("p95LatencyMs"), percentile(value, 0.99).alias("p99LatencyMs")))


def latency_stats(df: DataFrame, keys: tuple = ("tenantId", "date")) -> DataFrame:
    """Samples, maximum and exact percentiles of the latencies per group."""
    return _latency_stats(df.groupBy(*keys, "enrichmentLatencyMs").agg(F.count(F.lit(1)).alias("_n")), keys)


def hourly_rate(df: DataFrame) -> DataFrame:
    return df.groupBy("tenantId", "date", "hour").agg(F.count(F.lit(1)).alias("eventCount"))


def tenant_daily_summary(counts: DataFrame) -> DataFrame:
    """One row per tenant and day from ``event_counts`` output."""
    return (counts.groupBy("tenantId", "date")
            .agg(F.sum("eventCount").alias("totalEvents"),
                 (F.sum("totalPayloadBytes") / F.lit(1_048_576)).alias("totalPayloadMb"),
                 F.sum("anomalyCount").alias("totalAnomalies"),
                 F.count_distinct("eventType").alias("uniqueEventTypes"),
                 F.count_distinct("classification").alias("activeClassifications"))
            .withColumn("anomalyRate", F.col("totalAnomalies") / F.col("totalEvents")))


def windowed_event_agg(df: DataFrame, window_ms: int = FIVE_MINUTES_MS) -> DataFrame:
    """Per-tenant tumbling window totals with counts by classification and by event type.

    ``df`` carries every record with its ``route``; dead letters only feed ``dlqCount``.
    Classifications are a fixed list, so their counts are plain conditional aggregates; event
    types are open-ended and are counted on (window, tenant, type) before they become a map.
    """
    windowed = df.withColumn("windowStart", E.window_start("createdAt", window_ms))
    kept = F.col("route").isin("FAST", "ENRICHMENT")
    one = lambda cond: E.count_if(kept & cond)
    by_class = F.map_filter(
        F.create_map(*[x for cls in S.CLASSIFICATIONS for x in (F.lit(cls), F.col(f"_{cls}"))]),
        lambda _k, n: n > 0)
    latency = F.when(kept, F.col("enrichmentLatencyMs"))
    keys = ("tenantId", "windowStart")
    sums = ["totalEventCount", "totalPayloadBytes", "anomalyCount", "dlqCount", *[f"_{cls}" for cls in S.CLASSIFICATIONS]]
    counts = windowed.withColumn("_lat", latency).groupBy(*keys, "_lat").agg(
        one(F.lit(True)).alias("totalEventCount"),
        F.coalesce(F.sum(F.when(kept, F.col("payloadSizeBytes"))), F.lit(0)).alias("totalPayloadBytes"),
        one(F.col("anomalyDetected")).alias("anomalyCount"),
        E.count_if(~kept).alias("dlqCount"),
        *[one(F.col("classification") == cls).alias(f"_{cls}") for cls in S.CLASSIFICATIONS])
    totals = (ranked(counts, keys, "_lat", "totalEventCount").groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in sums], percentile("_lat", 0.50).alias("p50LatencyMs"), percentile("_lat", 0.99).alias("p99LatencyMs"))
        .select("tenantId", "windowStart", (F.col("windowStart") + window_ms).alias("windowEnd"),
                F.lit(window_ms).cast("bigint").alias("windowDurationMs"), "totalEventCount",
                by_class.alias("countByClassification"), "totalPayloadBytes", "anomalyCount", "dlqCount",
                "p50LatencyMs", "p99LatencyMs"))
    by_type = (windowed.where(kept).groupBy("tenantId", "windowStart", "eventType")
               .agg(F.count(F.lit(1)).alias("n"))
               .groupBy("tenantId", "windowStart")
               .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("eventType", "n"))))
                    .alias("countByEventType")))
    return totals.join(by_type, ["tenantId", "windowStart"], "left")


def stream_window_counts(df: DataFrame, window: str = "5 minutes") -> DataFrame:
    """Tumbling counts on ``ingestionTs``; the same expression serves batch and streaming."""
    return (df.groupBy(F.window("ingestionTs", window).alias("w"), "tenantId", "classification", "processingPath")
            .agg(F.count(F.lit(1)).alias("eventCount"), F.sum("payloadSizeBytes").alias("totalBytes"),
                 E.count_if(F.col("anomalyDetected")).alias("anomalyCount"),
                 F.avg("enrichmentLatencyMs").alias("avgLatencyMs"))
            .select("tenantId", "classification", "processingPath", "eventCount", "totalBytes",
                    "anomalyCount", "avgLatencyMs", F.col("w.start").alias("windowStart"),
                    F.col("w.end").alias("windowEnd")))


def count_by(df: DataFrame, *keys: str, out: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(out))


def reason_counts(df: DataFrame, col: str = "reason", total: str = "TOTAL") -> DataFrame:
    """Count per value plus one total row."""
    return (df.rollup(col).agg(F.count(F.lit(1)).alias("n"), F.grouping(col).alias("_g"))
            .select(F.when(F.col("_g") == 1, total).otherwise(F.col(col)).alias(col), "n"))


def metric_rollup(samples: DataFrame, keys: tuple, value: str, ts: str = "ts", window_ms: int = 60_000) -> DataFrame:
    """Sum, count and exact tail percentiles of a metric per window and tag set."""
    keys = (*keys, "windowStart")
    counts = (samples.withColumn("windowStart", E.window_start(ts, window_ms)).groupBy(*keys, value)
              .agg(F.count(F.lit(1)).alias("_n"), F.sum(value).alias("_sum")))
    return ranked(counts, keys, value, "_n").groupBy(*keys).agg(
        F.sum("_n").alias("n"), F.sum("_sum").alias("total"), percentile(value, 0.50).alias("p50"),
        percentile(value, 0.95).alias("p95"), percentile(value, 0.99).alias("p99"))


def audit_rollup(audit: DataFrame) -> DataFrame:
    """Audit events by type, outcome, tenant and actor; a blank request id falls back to the context's."""
    request = F.when(~E.blank("requestId"), F.col("requestId")).otherwise(F.col("contextRequestId"))
    return (audit.withColumn("_r", request).groupBy("eventType", "outcome", "tenantId", "actor")
            .agg(F.count(F.lit(1)).alias("n"), F.min("_r").alias("firstRequestId"),
                 F.max("_r").alias("lastRequestId"), F.max("timestamp").alias("lastAt")))
