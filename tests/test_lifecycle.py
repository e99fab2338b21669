import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidemark.functions import events as E
from tidemark.functions import text as X
from tidemark.operators import aggregates as A
from tidemark.operators import analytic as W
from tidemark.operators import anomaly as N
from tidemark.operators import lifecycle as L
from tidemark.operators import metrics as M
from tidemark.operators import projections as P
from tidemark.operators import quality as Q
from tidemark.operators import routing as R
from tidemark.operators import traces as T

DAY = 86_400_000


def ms(spark, day):
    return spark.sql(f"select unix_millis(timestamp'{day} 12:00:00 UTC')").first()[0]


def test_routes(spark):
    df = spark.createDataFrame([("PUBLIC", False), ("INTERNAL", False), ("CONFIDENTIAL", False), ("RESTRICTED", False), ("X", False), ("PUBLIC", True)],
                               "classification string, poison boolean")
    got = [r[0] for r in df.select(R.route(F.col("poison"))).collect()]
    assert got == ["FAST", "FAST", "ENRICHMENT", "ENRICHMENT", "UNKNOWN_DLQ", "POISON_DLQ"]


def test_archive_boundary_is_strict(spark):
    days = ["2024-05-30", "2024-05-31", "2024-06-29"]
    df = spark.createDataFrame([(d, "PUBLIC", ms(spark, d)) for d in days] + [("i", "INTERNAL", ms(spark, "2024-05-30"))],
                               "id string, classification string, createdAt bigint")
    assert [r["id"] for r in R.archive_eligible(df, "2024-06-30").collect()] == ["2024-05-30"]
    assert R.archive_eligible(df, "2024-06-30", "INTERNAL").count() == 0


def test_retry_plan(spark):
    df = spark.createDataFrame([(i, False, 7, "e" * 2000) for i in range(5)] + [(3, True, 7, "e")],
                               "retryCount int, succeeded boolean, nextRetryAt bigint, errorText string")
    got = [(r["status"], r["retryCount"], r["nextRetryAt"], len(r["errorMessage"] or "")) for r in L.dlq_retry_plan(df, 0).collect()]
    assert got == [("PENDING_RETRY", 1, 60_000, 1024), ("PENDING_RETRY", 2, 120_000, 1024), ("PENDING_RETRY", 3, 240_000, 1024),
                   ("PENDING_RETRY", 4, 480_000, 1024), ("EXHAUSTED", 5, 7, 1024), ("RESOLVED", 3, 7, 0)]


def test_paging(spark):
    df = spark.range(41).withColumnRenamed("id", "n")
    sizes = []
    for no in range(3):
        page = L.page(df, [F.desc("n")], no, 20).collect()
        sizes.append((len(page), page[0]["totalElements"], page[0]["totalPages"], page[0]["hasNext"], page[0]["n"]))
    assert sizes == [(20, 41, 3, True, 40), (20, 41, 3, True, 20), (1, 41, 3, False, 0)]
    plan = L.page(df, ["n"], 1, 20)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "CartesianProduct" not in plan


def test_keyset_equals_offset(spark):
    df = spark.createDataFrame([(i // 3, i) for i in range(30)], "ts int, id int")
    all_rows = rows(df.orderBy(F.desc("ts"), F.desc("id")).offset(10).limit(5))
    edge = df.orderBy(F.desc("ts"), F.desc("id")).offset(9).limit(1).first()
    assert rows(L.page_after(df, "ts", "id", edge["ts"], edge["id"], 5)) == all_rows


@pytest.mark.parametrize("slice_ms", [None, 2])
def test_transitions(spark, slice_ms):
    steps = ["PENDING", "PROCESSED", "PROCESSING", "FAILED", "PROCESSING", "FAILED", "DEAD_LETTERED", "PROCESSING"]
    df = spark.createDataFrame([("e", i, s, i) for i, s in enumerate(steps)], "id string, seq int, status string, changedAt bigint")
    got = [r["legal"] for r in Q.status_transitions(df, slice_ms).orderBy("seq").collect()]
    assert got == [True, False, False, True, True, True, True, False]
    counts = Q.retry_counts(df, slice_ms).first()
    assert (counts["retryCount"], counts["deadLettered"], counts["illegalSteps"]) == (1, True, 3)


def test_validation_names_every_broken_rule(spark):
    df = spark.createDataFrame([(" ", None, 0, None, None, "k" * 256, "", "raw"), ("t_1-A", "s", 1, "RESTRICTED", {"a": "b"}, None, "x", "raw"),
                                ("t" * 129, "s" * 257, 1, "NOPE", {str(i): "" for i in range(65)}, "k", "x", None), ("ok", "s", 1, "PUBLIC", {}, None, "x", "raw")],
                               "tenantId string, schemaName string, schemaVersion int, classification string, metadata map<string,string>, idempotencyKey string, sourceSystem string, rawPayload string")
    got = [(r["violations"], r["valid"]) for r in Q.validate_events(df).collect()]
    assert got[0] == (["tenantId.blank", "schemaName.blank", "schemaVersion.min", "classification.missing", "idempotencyKey.size", "sourceSystem.blank"], False)
    assert got[1] == (["restricted.rawPayload"], False)
    assert got[2] == (["tenantId.format", "schemaName.size", "classification.unknown", "metadata.size"], False)
    assert got[3] == ([], True)


def test_masking_keeps_other_fields(spark):
    body = '{"user":"u","Password" : "p1","apikey":"k","TOKEN":"t","note":"secret"}'
    got = spark.createDataFrame([(body,)], "b string").select(X.mask_sensitive("b")).first()[0]
    assert got == '{"user":"u","password":"****","apiKey":"****","token":"****","note":"secret"}'
    snippet = spark.createDataFrame([("é" * 3,)], "b string").select(X.log_snippet("b", 3)).first()[0]
    assert snippet == "é�"


def test_payload_codec(spark):
    df = spark.createDataFrame([("AQI=",), ("  ",), (None,), ("%%",)], "t string")
    got = [(None if r[0] is None else bytes(r[0]), r[1]) for r in df.select(X.decode_payload("t"), X.payload_rejected("t")).collect()]
    assert got == [(b"\x01\x02", False), (None, False), (None, False), (None, True)]


def test_encryption(spark):
    df = spark.createDataFrame([("t1", "RESTRICTED", b"hello", b"k" * 32)], "tenant string, cls string, p binary, k binary")
    sealed = df.select("*", X.encrypt("p", "k", "tenant", "cls").alias("c")).collect()
    again = df.select(X.encrypt("p", "k", "tenant", "cls").alias("c")).first()["c"]
    assert bytes(sealed[0]["c"]) != bytes(again) and len(sealed[0]["c"]) == 5 + 12 + 16
    stored = spark.createDataFrame([(sealed[0]["tenant"], sealed[0]["cls"], bytes(sealed[0]["c"]), b"k" * 32, b"x" * 32)],
                                   "tenant string, cls string, c binary, k binary, bad binary")
    got = stored.select(X.decrypt("c", "k", "tenant", "cls"), X.decrypt("c", "bad", "tenant", "cls"), X.decrypt(F.col("c"), F.col("k"), F.lit("t2"), F.col("cls"))).first()
    assert (bytes(got[0]), got[1], got[2]) == (b"hello", None, None)


def test_growth_nulls_are_independent(spark):
    daily = spark.createDataFrame([("a", "2024-01-01", 40), ("a", "2024-01-07", 50), ("a", "2024-01-08", 75), ("b", "2024-01-07", 0), ("b", "2024-01-08", 5)],
                                  "tenantId string, date string, totalEvents bigint")
    got = {(r["tenantId"], r["date"]): (r["dayOnDayGrowthPct"], r["weekOnWeekGrowthPct"]) for r in W.growth(daily).collect()}
    assert got[("a", "2024-01-08")] == (50.0, 87.5)
    assert got[("a", "2024-01-07")] == (None, None)
    assert got[("b", "2024-01-08")] == (None, None)
    counts = daily.withColumnRenamed("totalEvents", "eventCount")
    one = {r["tenantId"]: (r["dayOnDayGrowthPct"], r["weekOnWeekGrowthPct"]) for r in W.growth_on(counts, "2024-01-08").collect()}
    assert one == {"a": (50.0, 87.5), "b": (None, None)}


def test_dominant_class_has_one_row_on_ties(spark):
    counts = spark.createDataFrame([("a", "d", "PUBLIC", 3), ("a", "d", "INTERNAL", 2), ("a", "d", "INTERNAL", 1)],
                                   "tenantId string, date string, classification string, eventCount bigint")
    assert [r["dominantClassification"] for r in W.dominant_classification(counts).collect()] == ["INTERNAL"]


@pytest.mark.parametrize("ordinal,baseline,want", [(100, 100.0, 1 / 3), (1000, 100.0, 1.0), (5, None, 0.0), (5, 0.9, 0.0)])
def test_anomaly_score(spark, ordinal, baseline, want):
    df = spark.createDataFrame([(ordinal, baseline)], "n bigint, b double")
    assert df.select(N.score(F.col("n"), F.col("b"))).first()[0] == pytest.approx(want)


def test_baseline_decays_over_idle_windows_and_long_histories(spark):
    counts = [("t", i * 300_000, (i * 7) % 11 + 1) for i in range(1400) if i % 5 != 3 and not 300 < i < 700]
    got = {r["windowStart"]: r["baseline"] for r in N.baselines(spark.createDataFrame(counts, "tenantId string, windowStart bigint, n bigint")).collect()}
    by, ewma, want = {w // 300_000: n for _, w, n in counts}, None, {}
    for i in range(1400):
        want[i * 300_000] = ewma
        c = by.get(i, 0)
        ewma = float(c) if ewma is None else 0.3 * c + 0.7 * ewma
    assert all(got[w] == pytest.approx(want[w], rel=1e-12) if want[w] is not None else got[w] is None for w in got)


def plain_scores(counts):
    """Verdicts of the plain recursion, window by window."""
    out, ewma, last = {}, None, None
    for i, n in sorted(counts.items()):
        base = None if ewma is None else ewma * 0.7 ** (i - 1 - last)
        ewma = float(n) if ewma is None else 0.3 * n + 0.7 ** (i - last) * ewma
        last = i
        out[i] = N.score_of(n, base) >= N.THRESHOLD
    return out


@pytest.mark.parametrize("pattern", [(1, 1, 1, 3), (5, 5, 12), (1, 1, 2), (2, 0, 0, 1, 3)])
def test_verdicts_do_not_depend_on_the_clock(spark, pattern):
    """A burst over a steady baseline, on the edge of both thresholds, from many start windows."""
    counts = {f"t{k}": {k * 37 + i: n for i, n in enumerate(pattern) if n} for k in range(40)}
    frame = spark.createDataFrame([(t, i * N.WINDOW_MS, n) for t, c in counts.items() for i, n in c.items()], "tenantId string, windowStart bigint, n bigint")
    got = N.baselines(frame).withColumn("hit", N.score(F.col("n"), F.col("baseline")) >= N.THRESHOLD).collect()
    want = {(t, i): v for t, c in counts.items() for i, v in plain_scores(c).items()}
    assert {(r["tenantId"], r["windowStart"] // N.WINDOW_MS): r["hit"] for r in got} == want
    assert len({tuple(v for (t, _), v in sorted(want.items()) if t == name) for name in counts}) == 1


def test_scores_do_not_depend_on_slices(spark):
    ev = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id") % 4)).alias("tenantId"),
                                  F.lit("RESTRICTED").alias("classification"), (F.col("id") * F.col("id") % 7919 * 400).alias("createdAt"))
    pick = lambda df: rows(df.select("id", "windowedEventCount", "baseline", "anomalyScore"))
    assert pick(N.score_events(ev, 300_000, 16)) == pick(N.score_events(ev, 300_000, 1)) == pick(N.score_events(ev, 300_000, 3))


@pytest.mark.parametrize("slice_ms", [None, 3000])
def test_login_lock(spark, slice_ms):
    marks = "FFFFFFSFFFFSFFFFF"
    df = spark.createDataFrame([("u", i, i * 1000, m == "F") for i, m in enumerate(marks)], "username string, seq int, at bigint, failed boolean")
    got = rows(W.failed_login_streaks(df, slice_ms).select("failures", "firstAt", "lockedAt", "lockedUntil"))
    assert got == [(5, 12000, 16000, 16000 + 900_000), (6, 0, 4000, 5000 + 900_000)]


def test_degraded_interval(spark):
    df = spark.createDataFrame([("aws", i, i * 30_000, i not in (2, 3, 4), 50, 0.0) for i in range(8)] + [("azure", 9, 0, True, 5001, 0.0)],
                               "cloudProvider string, seq int, checkedAt bigint, reachable boolean, latencyMs bigint, errorRatePercent double")
    assert rows(W.degraded_intervals(df)) == [("aws", 60_000, 120_000, 3)]


def test_counter_reset(spark):
    df = spark.createDataFrame([("s", i, i * 1000, v) for i, v in enumerate([5.0, 8.0, 2.0, 4.0])], "series string, seq int, ts bigint, value double")
    assert M.counter_rate(df, ["series"], 300_000).first()["increase"] == 3 + 2 + 2


def test_quantile_in_unbounded_bucket(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 900)], "k string, v double")
    buckets = M.to_buckets(df, ["k"], "v", [2.0, 4.0])
    assert M.histogram_quantile(buckets, ["k"], 0.5).first()["quantile"] == 2.0
    assert M.histogram_quantile(buckets, ["k"], 0.99).first()["quantile"] == 4.0


def test_alarm_needs_consecutive_periods(spark):
    df = spark.createDataFrame([("events.rejected", "s", p * 300_000, 60.0) for p in (0, 2, 3, 4)], "metric string, series string, ts bigint, value double")
    got = rows(M.alarm_states(df).select("periodStart", "inAlarm"))
    assert got == sorted([(0, False), (600_000, False), (900_000, True), (1_200_000, True), (1_500_000, False)], key=repr)


def test_tail_sampling_and_attributes(spark):
    attrs = {"http.route": "/api"}
    data = [("err", "1", "ERROR", 0, 5, attrs), ("err", "2", "OK", 0, 5, attrs), ("slow", "3", "OK", 0, 5, attrs), ("slow", "4", "OK", 1990, 2000, attrs),
            ("fast", "5", "OK", 0, 5, attrs), ("quiet", "6", "ERROR", 0, 5, {"http.route": "/health"}), ("luck", "7", "OK", 0, 1, None)]
    df = spark.createDataFrame(data, "traceId string, spanId string, statusCode string, startMs bigint, endMs bigint, attributes map<string,string>")
    bucket = F.when(F.col("traceId") == "luck", 9).otherwise(10)
    assert [r[1] for r in rows(T.tail_sample(df, bucket))] == ["1", "2", "7", "3", "4"] or sorted(r[1] for r in T.tail_sample(df, bucket).collect()) == ["1", "2", "3", "4", "7"]
    got = {r["spanId"]: r["attributes"] for r in T.span_attributes(df, "ns", "prod").collect()}
    assert got["1"] == {"http.route": "/api", "service.namespace": "ns", "deployment.environment": "prod"}


def test_windowed_aggregate_counts_dead_letters(spark):
    df = spark.createDataFrame([("t", 10, "FAST", "PUBLIC", "a", 5, False, 7), ("t", 20, "ENRICHMENT", "RESTRICTED", "b", 6, True, 9), ("t", 30, "POISON_DLQ", "PUBLIC", "a", 1, False, 1),
                                ("u", 30, "UNKNOWN_DLQ", "X", "a", 1, False, 1)],
                               "tenantId string, createdAt bigint, route string, classification string, eventType string, payloadSizeBytes int, anomalyDetected boolean, enrichmentLatencyMs bigint")
    got = {r["tenantId"]: r.asDict() for r in A.windowed_event_agg(df).collect()}
    t, u = got["t"], got["u"]
    assert (t["totalEventCount"], t["dlqCount"], t["anomalyCount"], t["totalPayloadBytes"]) == (2, 1, 1, 11)
    assert t["countByClassification"] == {"PUBLIC": 1, "RESTRICTED": 1} and t["countByEventType"] == {"a": 1, "b": 1}
    assert (u["totalEventCount"], u["dlqCount"], u["p50LatencyMs"]) == (0, 1, None)


def test_classification_rules(spark):
    df = spark.createDataFrame([("PUBLIC",), ("CONFIDENTIAL",), ("RESTRICTED",), ("X",)], "classification string")
    assert [tuple(r)[1:] for r in P.class_attributes(df).collect()] == [(365, False, False), (90, True, False), (30, True, True), (None, False, False)]


def test_bulk_resolve_by_ids(spark):
    df = spark.createDataFrame([("1", "a", "EXHAUSTED"), ("2", "a", "EXHAUSTED"), ("3", "b", "EXHAUSTED")], "id string, tenantId string, status string")
    ids = spark.createDataFrame([("1",), ("1",), ("3",)], "id string")
    assert rows(L.dlq_bulk_resolve(df, "a", ids).select("id", "status")) == [("1", "RESOLVED"), ("2", "EXHAUSTED"), ("3", "EXHAUSTED")]


def test_purge_batch_is_bounded_and_never_touches_public_rows(spark):
    df = spark.createDataFrame([(i, "INTERNAL", -400 * DAY + i) for i in range(10)] + [(99, "PUBLIC", -300 * DAY)], "id int, classification string, createdAt bigint")
    assert R.retention_candidates(df, 0).where("purgeDb").count() == 10
    assert [r["id"] for r in R.retention_candidates(df, 0, 3).collect()] == [0, 1, 2]
