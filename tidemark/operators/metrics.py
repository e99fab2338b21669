"""Alert and alarm rules over metric samples, evaluated as table operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import events as E
from tidemark.operators import analytic as W
from tidemark.operators import ordered as O

# Threshold alerts as (name, metric, comparison, threshold, held seconds, severity).
ALERTS = [
    ("dr_not_healthy", "dr_state", ">", 0.0, 120, "critical"),
    ("replication_lag_high", "replication_lag_seconds", ">", 60.0, 300, "warning"),
    ("rpo_breach", "replication_lag_seconds", ">", 300.0, 60, "critical"),
    ("dlq_exhausted", "dlq_exhausted_total", ">", 0.0, 0, "warning"),
    ("circuit_breaker_open", "circuitbreaker_open", "==", 1.0, 60, "warning"),
    ("consumer_lag_high", "consumer_group_lag", ">", 10000.0, 600, "warning"),
]

# Ratio alerts as (name, comparison, threshold, held seconds, severity).
RATIO_ALERTS = [
    ("ingestion_error_rate_high", ">", 0.01, 300, "warning"),
    ("bulkhead_saturation", "<", 0.1, 120, "warning"),
    ("heap_high", ">", 0.85, 300, "warning"),
    ("gc_pause_high", ">", 0.1, 300, "warning"),
]
SAGA_FAILURES_PER_SECOND = 0.05
P99_LIMIT_SECONDS = 2.0

# Alarms as (name, metric, statistic, period seconds, comparison, threshold, periods).
ALARMS = [
    ("rds_cpu", "CPUUtilization", "Average", 300, ">", 80.0, 3),
    ("rds_freeable_memory", "FreeableMemory", "Average", 300, "<", 536870912.0, 2),
    ("rds_storage_space", "FreeStorageSpace", "Minimum", 3600, "<", 10737418240.0, 1),
    ("rds_replication_lag", "ReplicaLag", "Maximum", 60, ">", 30.0, 2),
    ("node_cpu", "node_cpu_usage_total", "Average", 300, ">", 85.0, 3),
    ("ingestion_errors", "events.rejected", "Sum", 300, ">", 50.0, 2),
    ("sync_errors", "sync.errors", "Sum", 300, ">", 10.0, 1),
    ("kms_throttling", "ThrottledRequests", "Sum", 60, ">", 5.0, 1),
    ("document_ru_high", "NormalizedRUConsumption", "Maximum", 300, ">", 80.0, 1),
    ("document_replication_lag", "ReplicationLatency", "Average", 300, ">", 5000.0, 1),
    ("document_availability", "ServiceAvailability", "Average", 300, "<", 99.9, 1),
]


def _compare(op: Column, value: Column, threshold: Column) -> Column:
    return F.when(op == ">", value > threshold).when(op == "<", value < threshold).otherwise(value == threshold)


def with_rules(samples: DataFrame, rules: list[tuple], names: list[str], match: str = "metric") -> DataFrame:
    """Each sample beside the rules of its metric.

    The rule list is configuration written in code, so it is a literal map from metric to its rules
    that is looked up per row: no join, nothing broadcast.
    """
    at = names.index(match)
    entry = lambda rule: F.struct(*[F.lit(v).alias(n) for n, v in zip(names, rule)])
    table = F.create_map(*[x for key in dict.fromkeys(r[at] for r in rules)
                           for x in (F.lit(key), F.array(*[entry(r) for r in rules if r[at] == key]))])
    return samples.withColumn("_rule", F.explode(F.try_element_at(table, F.col(match)))).select(
        *samples.columns, *[F.col(f"_rule.{n}").alias(n) for n in names if n != match])


def threshold_alerts(samples: DataFrame, rules: list[tuple] = ALERTS, max_gap: int | None = None) -> DataFrame:
    """Alerts whose condition held without a break for the rule's time.

    ``samples`` is (metric, series, ts, seq, value).  An alert is pending from its first sample
    and fires once it has held long enough.  A silence beyond ``max_gap`` milliseconds is a break.
    """
    ruled = with_rules(samples, rules, ["alert", "metric", "op", "threshold", "heldSeconds", "severity"])
    breach = _compare(F.col("op"), F.col("value"), F.col("threshold"))
    held = W.held_intervals(ruled, ["alert", "severity", "heldSeconds", "series"], "ts", "seq", breach,
                            {"peak": F.max("value")}, max_gap=max_gap)
    wait = F.col("heldSeconds") * 1000
    return (held.where(F.col("endAt") - F.col("startAt") >= wait)
            .withColumn("firedAt", F.col("startAt") + wait).drop("heldSeconds"))


def breaching(samples: DataFrame, rules: list[tuple] = ALERTS) -> DataFrame:
    """Each sample beside the rules of its metric, with ``breach``; samples without a series or a time are none."""
    ruled = with_rules(samples.where(F.col("series").isNotNull() & F.col("ts").isNotNull()), rules, ["alert", "metric", "op", "threshold", "heldSeconds", "severity"])
    return ruled.withColumn("breach", F.coalesce(_compare(F.col("op"), F.col("value"), F.col("threshold")), F.lit(False)))


def alert_changes(samples: DataFrame, rules: list[tuple] = ALERTS, lookback_ms: int = 300_000) -> DataFrame:
    """When alerts become PENDING, FIRING and RESOLVED: alert, severity, series, state, at, value.

    A sample stands for the time until the next one, and for ``lookback_ms`` at most: what breaches with
    the latest sample is on after that much silence no more.  An alert fires at the moment it has held for
    the rule's time and still holds, also between two samples; one that never fired has nothing to resolve.
    ``value`` is that of the sample that makes the change, null where time does.
    """
    keys = ["alert", "severity", "heldSeconds", "series"]
    marked = O.with_next(breaching(samples, rules), keys, "ts", "seq", {"_after": "ts", "_afterValue": "value"}, max(lookback_ms, O.SLICE_MS))
    silent = F.col("_after").isNull() | (F.col("_after") > F.col("ts") + lookback_ms)
    marked = marked.withColumns({"_until": F.when(silent, F.col("ts") + lookback_ms).otherwise(F.col("_after")),
                                 "_endValue": F.when(~silent, F.col("_afterValue"))})
    at = F.struct("ts", "seq")
    runs = W.held_intervals(marked, keys, "ts", "seq", F.col("breach"),
                            {"first": F.min_by("value", at), "end": F.max_by(F.struct("_until", "_endValue"), at)}, max_gap=lookback_ms)
    wait, none = F.col("heldSeconds").cast("bigint") * 1000, F.lit(None).cast("double")
    fired = (wait == 0) | (F.col("end._until") > F.col("startAt") + wait)
    change = lambda state, when, value: F.struct(F.lit(state).alias("state"), when.alias("at"), value.alias("value"))
    rows = F.array(change("PENDING", F.col("startAt"), F.col("first")), F.when(fired, change("FIRING", F.col("startAt") + wait, none)),
                   F.when(fired, change("RESOLVED", F.col("end._until"), F.col("end._endValue"))))
    return runs.select("alert", "severity", "series", F.inline(F.filter(rows, lambda r: r.isNotNull())))


def counter_rate(samples: DataFrame, keys: list[str], window_ms: int, value: str = "value",
                 ts: str = "ts", tie: str = "seq") -> DataFrame:
    """Increase per second in each window; a counter that fell was reset and counts from zero."""
    prev = O.with_previous(samples, keys, ts, tie, {"_p": value}, max(window_ms, O.SLICE_MS))
    v, p = F.col(value), F.col("_p")
    delta = F.when(p.isNull(), 0.0).when(v >= p, v - p).otherwise(v)
    return (prev.withColumn("windowStart", E.window_start(ts, window_ms)).groupBy(*keys, "windowStart")
            .agg(F.sum(delta).alias("increase"))
            .withColumn("rate", F.col("increase") / F.lit(window_ms / 1000.0)))


def counter_rate_sliding(samples: DataFrame, keys: list[str], range_ms: int, step_ms: int, value: str = "value",
                         ts: str = "ts", tie: str = "seq") -> DataFrame:
    """Increase per second over the ``range_ms`` before each evaluation time, for times that are multiples of ``step_ms``.

    A time t sees the samples after t - range and up to t.  A fall inside that span is a reset and adds what
    was lost.  The increase between the first and the last sample is stretched towards the edges of the span:
    to an edge that is within 1.1 times the mean distance of the samples, else by half that distance, and never
    to before the counter would have been zero.  Times with less than two distinct sample times have no rate.

    Every sample goes to the ``range / step`` times that see it, and all of it is one partial aggregate per
    (key, time), so a series with most of the samples is many groups.
    """
    prev = O.with_previous(samples, keys, ts, tie, {"_p": value, "_pt": ts}, max(range_ms, O.SLICE_MS))
    first = F.ceil(F.col(ts) / F.lit(step_ms)) * step_ms
    seen = prev.withColumn("evalTs", F.explode(F.sequence(first, F.col(ts) + range_ms, F.lit(step_ms).cast("bigint")))).where(
        F.col("evalTs") < F.col(ts) + range_ms)
    fell = (F.col(value) < F.col("_p")) & (F.col("_pt") > F.col("evalTs") - range_ms)
    at = F.struct(ts, tie)
    spans = seen.groupBy(*keys, "evalTs").agg(
        F.count(F.lit(1)).alias("samples"), F.min(ts).alias("_from"), F.max(ts).alias("_to"), F.min_by(value, at).alias("_first"),
        F.max_by(value, at).alias("_last"), F.sum(F.when(fell, F.col("_p")).otherwise(0.0)).alias("_lost")).where("_to > _from")
    seconds = lambda a, b: (b - a) / F.lit(1000.0)
    spans = spans.withColumns({
        "increase": F.col("_last") - F.col("_first") + F.col("_lost"), "_sampled": seconds(F.col("_from"), F.col("_to"))}).withColumn(
        "_mean", F.col("_sampled") / (F.col("samples") - 1))
    edge = lambda gap: F.when(gap < F.col("_mean") * 1.1, gap).otherwise(F.col("_mean") / 2)
    before = edge(seconds(F.col("evalTs") - range_ms, F.col("_from")))
    to_zero = F.when((F.col("increase") > 0) & (F.col("_first") >= 0), F.col("_sampled") * F.try_divide("_first", "increase"))
    covered = F.col("_sampled") + F.least(before, F.coalesce(to_zero, before)) + edge(seconds(F.col("_to"), F.col("evalTs")))
    rate = F.col("increase") * (covered / F.col("_sampled")) / F.lit(range_ms / 1000.0)
    return spans.select(*keys, "evalTs", "samples", "increase", rate.alias("rate"))


def ratio(numerator: DataFrame, denominator: DataFrame, keys: list[str], value: str = "rate") -> DataFrame:
    """Quotient of two rates or gauges on equal labels; null where the denominator is zero."""
    den = denominator.select(*keys, F.col(value).alias("_d"))
    return (numerator.select(*keys, F.col(value).alias("_n")).join(den, keys)
            .withColumn("ratio", F.try_divide("_n", "_d")).drop("_n", "_d"))


def ratio_alerts(ratios: DataFrame, series: list[str], rule: tuple, window_ms: int, ts: str = "windowStart") -> DataFrame:
    """Alerts on a ratio per window of ``window_ms``: a window holds until its end, a missing one is a break."""
    name, op, threshold, held_seconds, severity = rule
    breach = _compare(F.lit(op), F.col("ratio"), F.lit(threshold))
    worst = F.min("ratio") if op == "<" else F.max("ratio")
    held = W.held_intervals(ratios, series, ts, ts, breach, {"peak": worst}, max_gap=window_ms).withColumn(
        "endAt", F.col("endAt") + window_ms)
    wait = held_seconds * 1000
    return (held.where(F.col("endAt") - F.col("startAt") >= wait)
            .withColumns({"alert": F.lit(name), "severity": F.lit(severity), "firedAt": F.col("startAt") + wait}))


def to_buckets(df: DataFrame, keys: list[str], value: str, bounds: list[float]) -> DataFrame:
    """Cumulative ``le`` buckets per key: one aggregate with a count per bound, then unpivoted."""
    counts = df.groupBy(*keys).agg(*[E.count_if(F.col(value) <= b).alias(f"_b{i}") for i, b in enumerate(bounds)],
                                   F.count(value).alias("_inf"))
    buckets = [F.struct(F.lit(float(b)).alias("le"), F.col(f"_b{i}").cast("double").alias("cumulative"))
               for i, b in enumerate(bounds)]
    buckets.append(F.struct(F.lit(float("inf")).alias("le"), F.col("_inf").cast("double").alias("cumulative")))
    return counts.select(*keys, F.inline(F.array(*buckets)))


def histogram_quantile(buckets: DataFrame, keys: list[str], q: float) -> DataFrame:
    """Quantile from cumulative buckets, interpolated linearly inside the bucket it falls into.

    A quantile in the last, unbounded bucket is the highest finite bound.
    """
    order = Window.partitionBy(*keys).orderBy("le")
    whole = Window.partitionBy(*keys)
    prev = lambda c, default: F.coalesce(F.lag(c).over(order), F.lit(default))
    at = buckets.withColumns({"_lo": prev("le", 0.0), "_below": prev("cumulative", 0.0),
                              "_rank": F.max("cumulative").over(whole) * q})
    hit = at.where((F.col("cumulative") >= F.col("_rank")) & (F.col("_rank") > 0))
    inside = F.when(F.col("le") == float("inf"), F.col("_lo")).otherwise(
        F.col("_lo") + (F.col("le") - F.col("_lo")) * F.try_divide(
            F.col("_rank") - F.col("_below"), F.col("cumulative") - F.col("_below")))
    return hit.groupBy(*keys).agg(F.min_by(inside, "le").alias("quantile"))


def alarm_states(samples: DataFrame, alarms: list[tuple] = ALARMS) -> DataFrame:
    """State of each alarm in every period that has data, and in the first one without after an alarm.

    A period breaches when its statistic does; the alarm is on when the period and the ones right
    before it breach, as many as the alarm asks for.  A period without data does not breach, which
    a RANGE frame over period numbers expresses without generating empty periods.  Where an alarm
    is on and no data follows, a row without a value shows that it goes off.
    """
    names = ["alarm", "metric", "statistic", "periodSeconds", "op", "threshold", "periods"]
    ruled = with_rules(samples, alarms, names)
    period = F.floor(F.col("ts") / (F.col("periodSeconds") * 1000))
    stat = F.col("statistic")
    value = (F.when(stat == "Sum", F.col("_sum")).when(stat == "Average", F.col("_avg"))
             .when(stat == "Minimum", F.col("_min")).otherwise(F.col("_max")))
    per = (ruled.withColumn("_period", period)
           .groupBy("alarm", "statistic", "periodSeconds", "op", "threshold", "periods", "series", "_period")
           .agg(F.sum("value").alias("_sum"), F.avg("value").alias("_avg"), F.min("value").alias("_min"),
                F.max("value").alias("_max"))
           .withColumn("value", value)
           .withColumn("breaching", _compare(F.col("op"), F.col("value"), F.col("threshold"))))
    w = Window.partitionBy("alarm", "series").orderBy("_period")
    in_alarm = F.lit(False)
    for n in sorted({a[6] for a in alarms}):
        held = F.sum(F.col("breaching").cast("int")).over(w.rangeBetween(-(n - 1), 0)) == n
        in_alarm = F.when(F.col("periods") == n, held).otherwise(in_alarm)
    state = per.withColumns({"_on": in_alarm, "_next": F.lead("_period").over(w)})
    ends = F.col("_on") & (F.col("_next").isNull() | (F.col("_next") > F.col("_period") + 1))
    row = lambda period, value, breaching, on: F.struct(
        period.alias("p"), value.alias("value"), breaching.alias("breaching"), on.alias("inAlarm"))
    rows = F.array(row(F.col("_period"), F.col("value"), F.col("breaching"), F.col("_on")),
                   F.when(ends, row(F.col("_period") + 1, F.lit(None).cast("double"), F.lit(False), F.lit(False))))
    shown = state.select("alarm", "series", "periodSeconds", F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("r"))
    return shown.select("alarm", "series", (F.col("r.p") * F.col("periodSeconds") * 1000).alias("periodStart"),
                        "r.value", "r.breaching", "r.inAlarm")
