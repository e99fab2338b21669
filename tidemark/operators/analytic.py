"""Ranks, dominance, growth, running counts, streaks and intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import events as E
from tidemark.operators import ordered as O
from tidemark.operators import routing as R

# Lockout rule.
MAX_FAILED_LOGINS = 5
LOCK_MS = 15 * 60_000


def top_event_types(df: DataFrame, k: int = 10) -> DataFrame:
    """Event types ranked within tenant and day, ties kept.

    The rank runs on already counted types, and ``rank <= k`` becomes a window group limit that
    drops losers before the shuffle.
    """
    return _ranked(df.groupBy("tenantId", "date", "eventType").agg(F.count(F.lit(1)).alias("typeCount")), k)


def top_event_types_of(base: DataFrame, k: int = 10) -> DataFrame:
    """``top_event_types`` from ``aggregates.base_counts``."""
    return _ranked(base.groupBy("tenantId", "date", "eventType").agg(F.sum("eventCount").alias("typeCount")), k)


def _ranked(counts: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("tenantId", "date").orderBy(F.col("typeCount").desc())
    return counts.withColumn("rank", F.rank().over(w)).where(F.col("rank") <= k)


def dominant_classification(counts: DataFrame) -> DataFrame:
    """The class with most events per tenant and day; ties go to the first name."""
    per_class = counts.groupBy("tenantId", "date", "classification").agg(F.sum("eventCount").alias("n"))
    return (per_class.groupBy("tenantId", "date")
            .agg(F.min_by("classification", F.struct(-F.col("n"), "classification"))
                 .alias("dominantClassification")))


def growth(daily: DataFrame) -> DataFrame:
    """Day-on-day and week-on-week growth of ``totalEvents`` in percent.

    One window over the daily rows replaces two self-joins: a RANGE frame of exactly one earlier
    day gives that day's total, or null when the day is absent.
    """
    w = Window.partitionBy("tenantId").orderBy("_day")
    prev = lambda days: F.sum("totalEvents").over(w.rangeBetween(-days, -days))
    pct = lambda p: F.when(F.col(p) > 0, (F.col("totalEvents") - F.col(p)) / F.col(p) * 100)
    return (daily.withColumn("_day", F.unix_date(F.to_date("date")))
            .withColumns({"prevDayEvents": prev(1), "prevWeekEvents": prev(7)})
            .withColumns({"dayOnDayGrowthPct": pct("prevDayEvents"),
                          "weekOnWeekGrowthPct": pct("prevWeekEvents")})
            .drop("_day"))


def tenant_metrics(counts: DataFrame, latency: DataFrame) -> DataFrame:
    """The daily tenant row: totals, latency percentiles, dominant class and growth.

    All inputs are aggregates keyed by (tenant, day), far smaller than the events.
    """
    from tidemark.operators.aggregates import tenant_daily_summary

    keys = ["tenantId", "date"]
    stats = latency.select(*keys, "p50LatencyMs", "p95LatencyMs", "p99LatencyMs")
    return (growth(tenant_daily_summary(counts))
            .join(stats, keys, "left").join(dominant_classification(counts), keys, "left"))


def growth_on(counts: DataFrame, day: str) -> DataFrame:
    """Growth for one day from the three partitions it needs, in a single pruned scan."""
    d = F.lit(day).cast("date")
    on = lambda days: F.col("date").cast("date") == F.date_sub(d, days)
    total = lambda days: F.sum(F.when(on(days), F.col("eventCount")))
    pct = lambda p: F.when(F.col(p) > 0, (F.col("totalEvents") - F.col(p)) / F.col(p) * 100)
    return (counts.where(on(0) | on(1) | on(7)).groupBy("tenantId")
            .agg(total(0).alias("totalEvents"), total(1).alias("prevDayEvents"), total(7).alias("prevWeekEvents"))
            .where(F.col("totalEvents").isNotNull())
            .withColumns({"dayOnDayGrowthPct": pct("prevDayEvents"),
                          "weekOnWeekGrowthPct": pct("prevWeekEvents")}))


def failed_login_streaks(logins: DataFrame, slice_ms: int | None = None) -> DataFrame:
    """Runs of failures without a success in between; the fifth failure locks the account.

    Every further failure of the run renews the lock.  An account is a small key; give a slice length
    where one may hold much of the table.
    """
    keys = ["username"]
    known = logins.where(F.col("username").isNotNull() & F.col("at").isNotNull())
    runs = known if slice_ms is None else O.time_slice(known, "at", slice_ms)
    runs = O.with_running_sum(runs, keys, "at", "seq", F.col("failed").cast("bigint"), "_f")
    runs = O.with_running_max(runs, keys, "at", "seq", F.when(~F.col("failed"), F.col("_f")), "_base")
    base = F.coalesce("_base", F.lit(0))
    failures = runs.where("failed").withColumns({"_base": base, "streak": F.col("_f") - base})
    return (failures.groupBy("username", "_base")
            .agg(F.count(F.lit(1)).alias("failures"), F.min("at").alias("firstAt"), F.max("at").alias("lastAt"),
                 F.min(F.when(F.col("streak") >= MAX_FAILED_LOGINS, F.col("at"))).alias("lockedAt"))
            .where(F.col("lockedAt").isNotNull())
            .withColumn("lockedUntil", F.col("lastAt") + LOCK_MS).drop("_base"))


def held_intervals(samples: DataFrame, keys: list[str], ts: str, tie: str, holds: Column,
                   extra: dict | None = None, slice_ms: int = O.SLICE_MS, max_gap: int | None = None) -> DataFrame:
    """Maximal runs of samples for which ``holds`` is true, per key: start, end and sample count.

    With ``max_gap`` a longer silence between two samples ends a run: nothing is known to hold then.
    """
    marked = O.time_slice(samples.withColumn("_h", F.coalesce(holds, F.lit(False))), ts, slice_ms)
    is_break = ~F.col("_h")
    if max_gap is None:
        marked = O.with_last_break(marked, keys, ts, tie, is_break, "_run").withColumn("_run", F.struct("_run"))
    else:
        marked = O.with_previous(marked, keys, ts, tie, {"_sampled": ts})
        marked = O.with_last_break(marked, keys, ts, tie, is_break, "_run")
        silent = F.coalesce(F.col(ts) - F.col("_sampled") > max_gap, F.lit(False))
        marked = O.with_running_sum(marked, keys, ts, tie, silent.cast("bigint"), "_silences")
        marked = marked.withColumn("_run", F.struct("_run", "_silences"))
    aggs = [F.min(ts).alias("startAt"), F.max(ts).alias("endAt"), F.count(F.lit(1)).alias("samples")]
    aggs += [v.alias(k) for k, v in (extra or {}).items()]
    return marked.where("_h").groupBy(*keys, "_run").agg(*aggs).drop("_run")


def degraded_intervals(probes: DataFrame, min_seconds: int = 60) -> DataFrame:
    """Times a cloud stayed degraded for at least ``min_seconds``."""
    runs = held_intervals(probes, ["cloudProvider"], "checkedAt", "seq", R.is_degraded())
    return runs.where(F.col("endAt") - F.col("startAt") >= min_seconds * 1000)
