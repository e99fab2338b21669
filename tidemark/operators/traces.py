"""Trace spans: attribute actions, noise filter and tail sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.skew import with_group_totals

# Sampling policy.
QUIET_URLS = ["/actuator/health"]
QUIET_ROUTES = ["/health", "/metrics"]
SLOW_TRACE_MS = 2000
SAMPLE_PERCENT = 10


def drop_noise(spans: DataFrame) -> DataFrame:
    attr = F.col("attributes")
    quiet = (F.coalesce(F.try_element_at(attr, F.lit("http.url")).isin(QUIET_URLS), F.lit(False))
             | F.coalesce(F.try_element_at(attr, F.lit("http.route")).isin(QUIET_ROUTES), F.lit(False)))
    return spans.where(~quiet)


def span_attributes(spans: DataFrame, namespace: str, environment: str) -> DataFrame:
    """Overwrite the service namespace; set the environment only where it is absent."""
    attr = F.coalesce("attributes", F.create_map().cast("map<string,string>"))
    without = F.map_filter(attr, lambda k, _v: k != "service.namespace")
    upserted = F.map_concat(without, F.create_map(F.lit("service.namespace"), F.lit(namespace)))
    inserted = F.map_concat(upserted, F.create_map(F.lit("deployment.environment"), F.lit(environment)))
    return spans.withColumn("attributes", F.when(F.map_contains_key(attr, "deployment.environment"), upserted)
                            .otherwise(inserted))


def tail_sample(spans: DataFrame, bucket: Column | None = None) -> DataFrame:
    """All spans of kept traces: any error, slow from first start to last end, or in the sampled share.

    ``bucket`` is the trace's number in 0..99; by default a hash of its id.  The decision is one
    partial aggregate per (trace, salt), so a giant trace is no single task.
    """
    share = F.pmod(F.xxhash64("traceId"), F.lit(100)) if bucket is None else bucket
    heard = drop_noise(spans)
    whole = with_group_totals(
        heard.where(F.col("traceId").isNotNull()), ["traceId"], ["spanId"],
        {"_e": F.bool_or(F.col("statusCode") == "ERROR"), "_s": F.min("startMs"), "_t": F.max("endMs")},
        {"_err": (F.bool_or, "_e"), "_from": (F.min, "_s"), "_to": (F.max, "_t")})
    slow = F.col("_to") - F.col("_from") >= SLOW_TRACE_MS
    return whole.where(F.col("_err") | slow | (share < SAMPLE_PERCENT)).select(*heard.columns)
