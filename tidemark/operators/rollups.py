"""Daily figures that merge: quantile sketches and exact distinct counts over any range of days.

A percentile or a distinct count cannot be added up from finished daily numbers.  What is stored instead is a sketch per
hour, whose merges give days and weeks without a second look at the events, and per day a bitmap of the names seen, over
a dictionary that gives every name a small number for good.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SKETCH_K = 400  # rank error below 1 %


def sketch(column: str | Column, k: int = SKETCH_K) -> Column:
    return F.kll_sketch_agg_bigint(F.col(column) if isinstance(column, str) else column, F.lit(k))


def latency_sketches(events: DataFrame, keys: tuple = ("tenantId", "date", "hour"), value: str = "enrichmentLatencyMs") -> DataFrame:
    """Per group the number of samples, their maximum and a sketch; a group without a value has no row."""
    return (events.where(F.col(value).isNotNull()).groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("sampleCount"), F.max(value).alias("maxLatencyMs"), sketch(value).alias("sketch")))


def merged_sketches(sketches: DataFrame, keys: tuple) -> DataFrame:
    """Sketches of wider groups."""
    return sketches.groupBy(*keys).agg(F.sum("sampleCount").alias("sampleCount"), F.max("maxLatencyMs").alias("maxLatencyMs"),
                                       F.kll_merge_agg_bigint("sketch").alias("sketch"))


def latency_stats_of(sketches: DataFrame, keys: tuple = ("tenantId", "date")) -> DataFrame:
    """``aggregates.latency_stats`` from stored sketches."""
    at = lambda q: F.when(F.col("maxLatencyMs").isNotNull(), F.kll_sketch_get_quantile_bigint("sketch", F.lit(q)))
    return merged_sketches(sketches, keys).select(
        *keys, "sampleCount", "maxLatencyMs", at(0.50).alias("p50LatencyMs"), at(0.95).alias("p95LatencyMs"), at(0.99).alias("p99LatencyMs"))


def extended_dictionary(known: DataFrame, names: DataFrame, column: str) -> DataFrame:
    """The dictionary ``(name, number)`` with the new values of ``column``; old numbers stay.

    Only names that are new are numbered, in one task: a name is a type or a class, not a record.
    """
    new = names.select(F.col(column).alias("name")).where(F.col(column).isNotNull()).distinct().join(known, "name", "left_anti")
    both = known.select(F.lit(None).cast(new.schema["name"].dataType).alias("name"), "number").unionByName(
        new.select("name", F.lit(None).cast("bigint").alias("number")))
    listed = both.agg(F.array_sort(F.collect_list("name")).alias("_names"), F.coalesce(F.max("number") + 1, F.lit(0)).cast("bigint").alias("_from"))
    numbered = listed.select("_from", F.posexplode("_names").alias("_n", "name")).select("name", (F.col("_from") + F.col("_n")).alias("number"))
    return known.select("name", "number").unionByName(numbered)


def name_bitmaps(rows: DataFrame, dictionary: DataFrame, column: str, keys: tuple = ("tenantId", "date")) -> DataFrame:
    """Per group and bitmap bucket the names that occur."""
    seen = rows.select(*keys, F.col(column).alias("name")).distinct().join(dictionary, "name")
    return (seen.groupBy(*keys, F.bitmap_bucket_number("number").alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits")))


def distinct_names(bitmaps: DataFrame, keys: tuple) -> DataFrame:
    """Exact distinct counts of wider groups."""
    return (bitmaps.groupBy(*keys, "bucket").agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("n"))
            .groupBy(*keys).agg(F.sum("n").alias("distinctNames")))
