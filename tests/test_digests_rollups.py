"""Digest trees, mergeable figures and sliding rates against plain versions."""

import random
import re

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidemark.operators import aggregates as A
from tidemark.operators import digests as DG
from tidemark.operators import metrics as M
from tidemark.operators import reconcile as R
from tidemark.operators import rollups as RU
from tidemark.session import shared_dir

COPY = "tenantId string, aggregateId string, payload binary"


def made_copies(spark, n=3000, seed=1):
    rng = random.Random(seed)
    left = {(f"t{i % 3}", f"a{i}"): bytes([rng.randrange(256)]) for i in range(n)}
    right = dict(left)
    for key in rng.sample(sorted(left), 4):
        right[key] = b"other"
    gone = rng.sample(sorted(set(right) - {k for k in left if left[k] != right[k]}), 3)
    for key in gone:
        del right[key]
    right[("t9", "new")] = None
    frame = lambda d: spark.createDataFrame([(*k, v) for k, v in d.items()], COPY)
    asked = spark.createDataFrame([*left, ("t9", "new"), ("t0", "nowhere"), ("none", "nowhere")], "tenantId string, aggregateId string")
    return frame(left), frame(right), asked


@pytest.mark.parametrize("bits,fan", [(6, 2), (5, 3)])
def test_tree_verdicts_equal_the_join(spark, bits, fan):
    left, right, asked = made_copies(spark, 900, bits)
    path = shared_dir(spark, "copies")
    DG.write_copy(left, f"{path}/l", bits, fan)
    DG.write_copy(right, f"{path}/r", bits, fan)
    got = DG.compare_copies(asked, f"{path}/l", f"{path}/r", bits, fan)
    assert rows(got) == rows(R.verdicts(asked, left, right))


def test_equal_ranges_are_not_read(spark):
    left, right, asked = made_copies(spark)
    path = shared_dir(spark, "copies")
    DG.write_copy(left, f"{path}/l")
    DG.write_copy(right, f"{path}/r")
    open_ = DG.differing_ranges(spark.read.parquet(f"{path}/l/tree"), spark.read.parquet(f"{path}/r/tree"))
    numbers = sorted(r["range"] for r in open_.select("range").distinct().collect())
    assert 5 <= len(numbers) <= 8
    plan = DG.compare_copies(asked, f"{path}/l", f"{path}/r")._jdf.queryExecution().toString()
    found = re.findall(r"PartitionFilters: \[isnotnull\(range#\d+\), range#\d+ IN \(([\d,]+)\)", plan.split("== Physical Plan ==")[1]) or re.findall(
        r"PartitionFilters: \[range#\d+ IN \(([\d,]+)\)", plan.split("== Physical Plan ==")[1])
    assert len(found) >= 2 and all([int(x) for x in f.split(",")] == numbers for f in found)


def test_digests_do_not_depend_on_order_and_equal_copies_differ_nowhere(spark):
    left, _, _ = made_copies(spark, 500)
    trees = [DG.digest_tree(DG.with_range(df)) for df in (left, left.orderBy(F.rand(3)).repartition(7))]
    assert rows(trees[0]) == rows(trees[1]) and DG.differing_ranges(*trees).count() == 0
    assert trees[0].where("bits = 0").agg(F.sum("n")).first()[0] == 500
    assert DG.differing_ranges(trees[0], trees[0].limit(0)).count() == trees[0].where("bits = 8").count()


# ---- sketches and bitmaps ------------------------------------------------------------------------

@pytest.mark.parametrize("seed", [1, 2])
def test_merged_sketches_keep_the_rank_error(spark, seed):
    """Over random partitions of the values into many hours, of very different sizes."""
    rng = random.Random(seed)
    values = [int(rng.lognormvariate(4, 1.5)) for _ in range(40_000)]
    data = [("t", "d", int(rng.random() ** 3 * 300), v) for v in values]
    hourly = RU.latency_sketches(spark.createDataFrame(data, "tenantId string, date string, hour int, enrichmentLatencyMs bigint").repartition(rng.randint(2, 9)))
    got = RU.latency_stats_of(hourly).first()
    assert (got["sampleCount"], got["maxLatencyMs"]) == (len(values), max(values))
    for q, c in ((0.5, "p50LatencyMs"), (0.95, "p95LatencyMs"), (0.99, "p99LatencyMs")):
        below, upto = sum(v < got[c] for v in values) / len(values), sum(v <= got[c] for v in values) / len(values)
        assert below <= q + 0.015 and upto >= q - 0.015


def test_few_values_are_exact_and_nulls_count_as_samples_of_the_base(spark):
    data = [("t", "PUBLIC", "e", "1", "d", 1, 5, 1, False, v) for v in [7, 3, None, 9]] + [("u", "PUBLIC", "e", "1", "d", 1, 5, 1, False, None)]
    df = spark.createDataFrame(data, "tenantId string, classification string, eventType string, schemaVersion string, date string, hour int, "
                                     "payloadSizeBytes bigint, createdAt bigint, anomalyDetected boolean, enrichmentLatencyMs bigint")
    columns = ["tenantId", "date", "sampleCount", "maxLatencyMs", "p50LatencyMs", "p95LatencyMs", "p99LatencyMs"]
    assert rows(RU.latency_stats_of(A.base_counts(df)).select(*columns)) == rows(A.latency_stats(df).select(*columns))


def test_bitmaps_count_distinct_over_any_range(spark):
    rng = random.Random(4)
    data = [(rng.choice("ab"), day, f"type-{int(rng.random() ** 2 * 40_000)}") for day in range(6) for _ in range(3_000)] + [("a", 0, None)]
    df = spark.createDataFrame(data, "tenantId string, date int, eventType string")
    empty = spark.createDataFrame([], "name string, number bigint")
    first = RU.extended_dictionary(empty, df.where("date < 3"), "eventType")
    whole = RU.extended_dictionary(first, df, "eventType")
    numbers = {r["name"]: r["number"] for r in whole.collect()}
    assert sorted(numbers.values()) == list(range(len(numbers)))
    assert all(numbers[r["name"]] == r["number"] for r in first.collect())
    bitmaps = RU.name_bitmaps(df, whole, "eventType")
    for lo, hi in ((0, 1), (2, 5), (0, 6)):
        got = RU.distinct_names(bitmaps.where(F.col("date").between(lo, hi - 1)), ("tenantId",))
        want = df.where(F.col("date").between(lo, hi - 1)).groupBy("tenantId").agg(F.count_distinct("eventType").alias("distinctNames"))
        assert rows(got) == rows(want)


# ---- sliding rates -------------------------------------------------------------------------------

def plain_rate(samples, t, span):
    """Rate at ``t`` of samples (ms, value) in time order."""
    own = [(a, v) for a, v in samples if t - span < a <= t]
    if len(own) < 2 or own[0][0] == own[-1][0]:
        return None
    up = own[-1][1] - own[0][1] + sum(p[1] for p, q in zip(own, own[1:]) if q[1] < p[1])
    width = (own[-1][0] - own[0][0]) / 1000
    mean = width / (len(own) - 1)
    lo, hi = (own[0][0] - (t - span)) / 1000, (t - own[-1][0]) / 1000
    lo, hi = (x if x < 1.1 * mean else mean / 2 for x in (lo, hi))
    if up > 0 and own[0][1] >= 0:
        lo = min(lo, width * own[0][1] / up)
    return round(up * (width + lo + hi) / width / (span / 1000), 9)


SERIES = "series string, ts bigint, seq bigint, value double"


@pytest.mark.parametrize("seed", [1])
def test_sliding_rates_with_resets_and_gaps(spark, seed):
    rng = random.Random(seed)
    data, plain = [], {}
    for series in ("a", "b"):
        t, v = 1_000_000 * seed, 0.0
        for _ in range(150):
            t += rng.choice([15_000, 15_000, 15_000, 14_000, 60_000, 700_000])
            v = 0.0 if rng.random() < 0.1 else v + rng.choice([0, 1, 5])
            data.append((series, t, len(data), v))
            plain.setdefault(series, []).append((t, v))
    got = {(r["series"], r["evalTs"]): round(r["rate"], 9) for r in M.counter_rate_sliding(spark.createDataFrame(data, SERIES), ["series"], 300_000, 60_000).collect()}
    want = {}
    for series, samples in plain.items():
        for t in range(samples[0][0] // 60_000 * 60_000, samples[-1][0] + 400_000, 60_000):
            rate = plain_rate(samples, t, 300_000)
            if rate is not None:
                want[series, t] = rate
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-8) for k in want)


def test_a_scrape_just_outside_the_span_is_not_seen(spark):
    data = [("a", 0, 0, 0.0), ("a", 60_000, 1, 100.0), ("a", 300_000, 2, 100.0)]
    got = {r["evalTs"]: (r["samples"], r["increase"]) for r in M.counter_rate_sliding(spark.createDataFrame(data, SERIES), ["series"], 300_000, 60_000).collect()}
    assert got[300_000] == (2, 0.0) and got[240_000] == (2, 100.0) and 360_000 not in got


# ---- exact percentiles ---------------------------------------------------------------------------

def at_rank(values, percent):
    """The least value with ``percent`` of all at or below it."""
    return sorted(values)[-(-len(values) * percent // 100) - 1]


def test_percentiles_of_large_groups_are_exact(spark):
    """Far more distinct values than a summary of the group would hold."""
    rng = random.Random(5)
    data = {t: [int(rng.lognormvariate(9, 1.5)) for _ in range(20_000)] for t in "ab"}
    df = spark.createDataFrame([(t, "d", v) for t, vs in data.items() for v in [*vs, None]], "tenantId string, date string, enrichmentLatencyMs bigint")
    got = {r["tenantId"]: r for r in A.latency_stats(df).collect()}
    for t, vs in data.items():
        assert (got[t]["sampleCount"], got[t]["maxLatencyMs"]) == (len(vs) + 1, max(vs))
        assert [got[t][f"p{p}LatencyMs"] for p in (50, 95, 99)] == [at_rank(vs, p) for p in (50, 95, 99)]
    rolled = {r["tenantId"]: r for r in A.metric_rollup(df.withColumn("ts", F.lit(7)), ("tenantId",), "enrichmentLatencyMs").collect()}
    for t, vs in data.items():
        assert (rolled[t]["n"], rolled[t]["total"]) == (len(vs) + 1, sum(vs))
        assert [rolled[t][f"p{p}"] for p in (50, 95, 99)] == [at_rank(vs, p) for p in (50, 95, 99)]


def test_windows_have_exact_percentiles_of_the_kept_events(spark):
    rng = random.Random(6)
    data = [("t", i % 1_000, rng.choice(["FAST", "ENRICHMENT", "POISON_DLQ"]), "PUBLIC", "e", 2, False, int(rng.lognormvariate(9, 1.5))) for i in range(20_000)]
    df = spark.createDataFrame(data, "tenantId string, createdAt bigint, route string, classification string, eventType string, "
                                     "payloadSizeBytes bigint, anomalyDetected boolean, enrichmentLatencyMs bigint")
    kept = [r[-1] for r in data if r[2] != "POISON_DLQ"]
    got = A.windowed_event_agg(df).first()
    assert (got["totalEventCount"], got["dlqCount"], got["totalPayloadBytes"]) == (len(kept), len(data) - len(kept), 2 * len(kept))
    assert (got["p50LatencyMs"], got["p99LatencyMs"]) == (at_rank(kept, 50), at_rank(kept, 99))


def test_the_daily_base_keeps_exact_percentiles_and_counts(spark):
    rng = random.Random(7)
    data = [(rng.choice("tu"), rng.choice(["PUBLIC", None]), rng.choice(["e", "f", None]), "1", "d", i % 24, 5, i, i % 7 == 0,
             rng.choice([None, int(rng.lognormvariate(9, 1.5))])) for i in range(20_000)]
    df = spark.createDataFrame(data, "tenantId string, classification string, eventType string, schemaVersion string, date string, hour int, "
                                     "payloadSizeBytes bigint, createdAt bigint, anomalyDetected boolean, enrichmentLatencyMs bigint")
    base = A.daily_base(df)
    counts = base.where(~F.col("ofLatency"))
    assert rows(A.latency_stats_of(base)) == rows(A.latency_stats(df))
    assert rows(A.event_counts_of(counts)) == rows(A.event_counts(df))
    assert rows(A.hourly_rate_of(counts)) == rows(A.hourly_rate(df))
    values = [r[-1] for r in data if r[0] == "t" and r[-1] is not None]
    assert A.latency_stats_of(base).where("tenantId = 't'").first()["p99LatencyMs"] == at_rank(values, 99)
