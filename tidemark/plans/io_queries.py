"""Round trips through sources, sinks and streams.

Each query writes below the shared folder and returns what a reader finds there.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import schema as S
from tidemark.functions import events as E
from tidemark.operators import analytic as W
from tidemark.operators import lifecycle as L
from tidemark.operators import reconcile as R
from tidemark.operators import routing
from tidemark.plans import batch_queries as B
from tidemark.plans import jobs
from tidemark.plans import lifecycle_queries as LQ
from tidemark.plans import metric_queries as MQ
from tidemark.plans import reconcile_queries as RQ
from tidemark.plans.registry import query
from tidemark.session import shared_dir, use_rocksdb
from tidemark.sinks import files as K
from tidemark.sinks import topics as TP
from tidemark.sources import adapter as T
from tidemark.sources import cdc
from tidemark.sources import files as SRC
from tidemark.sources import streams as ST
from tidemark.streaming import keyed as KS
from tidemark.streaming import pipeline as PL
from tidemark.streaming import stateful as SF

NOW = T.NOW_MS
SIX_HOURS = B.SIX_HOURS
DAY = "2024-01-15"


def wire(df):
    """Canonical events as enriched wire records."""
    return df.select(
        "id", "tenantId", "sourceSystem", "eventType", "classification", "status", "schemaVersion", "idempotencyKey",
        "payloadSizeBytes", "createdAt", "enrichedAt", F.lit("tidemark").alias("processorId"),
        F.lit(0).cast("bigint").alias("windowedEventCount"), F.lit(0.0).alias("anomalyScore"), "anomalyDetected",
        "enrichmentLatencyMs", E.processing_path("classification").alias("processingPath"))


def landed(spark, sf):
    """Valid events as JSON Lines by date and tenant."""
    path = shared_dir(spark, "landing")
    ev = B.dated(wire(T.valid_events(spark, sf))).drop("hour").withColumn("tenant", F.col("tenantId"))
    K.write_partitioned(ev, path, ["date", "tenant"], "json")
    return path


def stream(spark, sf):
    return T.event_columns(ST.table_stream(use_rocksdb(spark), sf, "events"))


def valid_stream(spark, sf):
    return wire(stream(spark, sf).where(~F.col("isPoison") & F.col("classification").isin(S.CLASSIFICATIONS)))


def drain(spark, name, begin):
    """Run ``begin(path, checkpoint)`` until its input is used up; returns the output path."""
    path = shared_dir(spark, name)
    PL.run_all([begin(f"{path}/out", f"{path}/checkpoint")])
    return f"{path}/out"


WIRE = """id, "tenantId", "eventType", classification, "createdAt", "payloadSizeBytes", "anomalyDetected", "processingPath\""""


def wire_out(df):
    return df.select("id", "tenantId", "eventType", "classification", "createdAt", "payloadSizeBytes", "anomalyDetected",
                     "processingPath")


# ---- files ---------------------------------------------------------------------------------------

@query("src_json_recursive", "ev valid", f"SELECT {WIRE} FROM valid")
def src_json_recursive(spark, sf):
    return wire_out(SRC.read_json_events(spark, landed(spark, sf)))


COUNT_COLS = """"tenantId", classification, "eventType", "schemaVersion", "eventCount", date"""


@query("src_parquet_partition", "ev valid", B.COUNTS + f" SELECT {COUNT_COLS} FROM cnt WHERE date='{DAY}'")
def src_parquet_partition(spark, sf):
    path = shared_dir(spark, "counts")
    K.write_partitioned(B.daily_counts(spark, sf), path, ["date"])
    return SRC.read_partition(spark, path, DAY).select(
        "tenantId", "classification", "eventType", "schemaVersion", "eventCount", F.col("date").cast("string").alias("date"))


@query("sink_partitioned", "ev valid", B.COUNTS + f"""
SELECT "tenantId", classification, "eventType", "schemaVersion", CASE WHEN date='{DAY}' THEN "eventCount"*2 ELSE "eventCount" END AS "eventCount", date FROM cnt""")
def sink_partitioned(spark, sf):
    """A rerun of one day replaces that day and leaves the others."""
    path = shared_dir(spark, "counts")
    counts = B.daily_counts(spark, sf)
    K.write_partitioned(counts, path, ["date"])
    again = counts.where(F.col("date") == DAY).withColumn("eventCount", F.col("eventCount") * 2)
    K.write_partitioned(again, path, ["date"])
    return spark.read.parquet(path).select(
        "tenantId", "classification", "eventType", "schemaVersion", "eventCount", F.col("date").cast("string").alias("date"))


ELIGIBLE = f"""el AS (SELECT * FROM ev WHERE CAST(date AS DATE) < DATE '{B.CUTOFF}' AND CAST(date AS DATE) <
  DATE '{B.CUTOFF}' - CASE classification WHEN 'PUBLIC' THEN 30 WHEN 'INTERNAL' THEN 90 WHEN 'CONFIDENTIAL' THEN 180
  WHEN 'RESTRICTED' THEN 365 END)"""


def _archived(spark, sf):
    path = shared_dir(spark, "archive")
    events = T.data_events(spark, sf).select("id", "tenantId", "classification", "eventType", "createdAt")
    at = F.timestamp_millis(F.lit(NOW))
    # Two overlapping runs: the second finds the PUBLIC events already listed.
    jobs.archive_job(events, f"{path}/events", f"{path}/manifest", B.CUTOFF, "2024-07-01", "PUBLIC", at)
    jobs.archive_job(events, f"{path}/events", f"{path}/manifest", B.CUTOFF, "2024-07-02", archived_at=at)
    return path


@query("sink_archive", "ev", ELIGIBLE + """
SELECT id, "tenantId", classification, "eventType", date AS "eventDate", left(date, 4) AS year, substr(date, 6, 2) AS month FROM el""")
def sink_archive(spark, sf):
    rows = spark.read.parquet(f"{_archived(spark, sf)}/events")
    return rows.select("id", "tenantId", "classification", "eventType", F.col("eventDate").cast("string").alias("eventDate"),
                       F.col("year").cast("string").alias("year"), F.lpad(F.col("month").cast("string"), 2, "0").alias("month"))


@query("sink_manifest", "ev", ELIGIBLE + f"""
SELECT id AS "eventId", "tenantId", classification, date AS "eventDate", "createdAt", CAST({NOW} AS BIGINT) AS "archivedAt",
  CASE WHEN classification='PUBLIC' THEN '2024-07-01' ELSE '2024-07-02' END AS date FROM el""")
def sink_manifest(spark, sf):
    rows = K.read_manifest(spark, f"{_archived(spark, sf)}/manifest")
    return rows.select("eventId", "tenantId", "classification", F.col("eventDate").cast("string").alias("eventDate"), "createdAt",
                       F.unix_millis("archivedAt").alias("archivedAt"), "date")


@query("archive_job", "ev", ELIGIBLE + """
SELECT left(date, 4) AS year, substr(date, 6, 2) AS month, classification, count(*) AS events, min("createdAt") AS "firstAt", max("createdAt") AS "lastAt" FROM el GROUP BY ALL""")
def archive_job(spark, sf):
    path = _archived(spark, sf)
    listed = K.read_manifest(spark, f"{path}/manifest").select(F.col("eventId").alias("id"))
    rows = spark.read.parquet(f"{path}/events").join(listed, "id", "left_semi")
    return rows.groupBy(F.col("year").cast("string").alias("year"), F.lpad(F.col("month").cast("string"), 2, "0").alias("month"), "classification").agg(
        F.count(F.lit(1)).alias("events"), F.min("createdAt").alias("firstAt"), F.max("createdAt").alias("lastAt"))


@query("aggregation_job", "ev valid", B.COUNTS + ", " + B.LATENCY + """
SELECT 'event-counts' AS output, date, "tenantId", CAST(sum("eventCount") AS BIGINT) AS n FROM cnt GROUP BY ALL
UNION ALL SELECT 'latency-stats', date, "tenantId", "p99LatencyMs" FROM lat
UNION ALL SELECT 'hourly-rate', date, "tenantId", count(*) FROM valid GROUP BY ALL
UNION ALL SELECT 'top-event-types', date, "tenantId", count(*) FROM (SELECT date, "tenantId", "eventType", rank() OVER (PARTITION BY date, "tenantId" ORDER BY count(*) DESC) AS r
  FROM valid GROUP BY date, "tenantId", "eventType") WHERE r<=10 GROUP BY ALL""")
def aggregation_job(spark, sf):
    """The daily job over all landed days, then the sum of what each output holds per tenant."""
    path = shared_dir(spark, "aggregations")
    jobs.aggregation_job(spark, landed(spark, sf), path)
    read = lambda name, n: (spark.read.parquet(f"{path}/{name}").groupBy(F.col("date").cast("string").alias("date"), "tenantId")
                            .agg(n.cast("bigint").alias("n")).select(F.lit(name).alias("output"), "date", "tenantId", "n"))
    return (read("event-counts", F.sum("eventCount")).unionByName(read("latency-stats", F.max("p99LatencyMs")))
            .unionByName(read("hourly-rate", F.sum("eventCount"))).unionByName(read("top-event-types", F.count(F.lit(1)))))


@query("sink_serving_json", "ev valid", B.COUNTS + ", " + B.LATENCY + ", " + B.SUMMARY + ", " + B.DOMINANT + ", " + B.GROWTH + f"""
SELECT s."tenantId", s."totalEvents", d."dominantClassification", l."p99LatencyMs", g."dayOnDayGrowthPct", g."weekOnWeekGrowthPct"
FROM summ s JOIN lat l USING ("tenantId", date) JOIN dom d USING ("tenantId", date) JOIN gro g USING ("tenantId", date) WHERE s.date='{DAY}'""")
def sink_serving_json(spark, sf):
    """Daily aggregates, the tenant metrics job on top of them, and its JSON output."""
    path = shared_dir(spark, "metrics")
    K.write_partitioned(B.daily_counts(spark, sf), f"{path}/agg/event-counts", ["date"])
    K.write_partitioned(B.latency_stats(spark, sf), f"{path}/agg/latency-stats", ["date"])
    jobs.tenant_metrics_job(spark, f"{path}/agg", f"{path}/out", DAY)
    schema = ("tenantId STRING, totalEvents BIGINT, dominantClassification STRING, p99LatencyMs BIGINT, "
              "dayOnDayGrowthPct DOUBLE, weekOnWeekGrowthPct DOUBLE")
    return spark.read.schema(schema).json(f"{path}/out/json/date={DAY}").withColumns(
        B.r6("dayOnDayGrowthPct", "weekOnWeekGrowthPct"))


@query("sink_upsert_latest", "aws azure", RQ.APPLY + """
SELECT "tenantId", "aggregateId", id, status, clock FROM ap WHERE action<>'REVIEW'
UNION ALL SELECT "tenantId", "aggregateId", id, 'PENDING', 'aws=' || c_aws || ',azure=' || c_azure FROM aws
  WHERE "aggregateId" NOT IN (SELECT "aggregateId" FROM ap WHERE action<>'REVIEW')""")
def sink_upsert_latest(spark, sf):
    """The replication job against a stored copy, then the store as a reader finds it."""
    path = shared_dir(spark, "store")
    K.write_store(T.sync_copy(spark, sf, "aws"), f"{path}/store")
    done = R.sync_apply(T.sync_copy(spark, sf, "azure"), K.read_store(spark, f"{path}/store"), RQ.CONFIG)
    K.upsert_store(done.where(F.col("action") != "REVIEW").select("record.*"), f"{path}/store")
    return K.read_store(spark, f"{path}/store").select(
        "tenantId", "aggregateId", "id", F.col("syncStatus").alias("status"), E.map_text("vectorClock").alias("clock"))


# ---- records -------------------------------------------------------------------------------------

@query("src_avro_decode", "ev", """
SELECT id, "tenantId", classification, "createdAt", seq AS "offset" FROM ev WHERE NOT "isPoison\"""")
def src_avro_decode(spark, sf):
    """Bus records decoded by schema: JSON bodies here; ``streams.decode_avro`` where spark-avro is on the classpath."""
    ev = T.data_events(spark, sf)
    body = F.to_json(F.struct("id", "tenantId", "sourceSystem", "eventType", "classification", "status", "schemaVersion",
                              "idempotencyKey", "payloadSizeBytes", "createdAt"))
    records = ev.select(F.col("tenantId").alias("key"), F.when(~F.col("isPoison"), body).alias("value"), F.col("seq").alias("offset"))
    return ST.decode_json(records, S.DATA_EVENT).select("id", "tenantId", "classification", "createdAt", "offset")


CDC = """
c AS (SELECT 'u-' || "userId" AS key, seq, "createdAt" AS ts, "eventType", value, CASE WHEN seq%47=46 THEN 'd' WHEN seq<200 THEN 'c' ELSE 'u' END AS op FROM ev)
SELECT key, "eventType", value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, seq DESC) AS rn FROM c) WHERE rn=1 AND op<>'d'"""


def cdc_records(spark, sf):
    ev = T.data_events(spark, sf)
    image = F.to_json(F.struct(F.concat(F.lit("u-"), F.col("userId").cast("string")).alias("id"), "eventType", "value"))
    op = F.when(F.col("seq") % 47 == 46, "d").when(F.col("seq") < 200, "c").otherwise("u")
    envelope = F.to_json(F.struct(
        F.when(op != "c", image).alias("before"), F.when(op != "d", image).alias("after"), op.alias("op"),
        F.col("createdAt").alias("ts_ms"), F.struct(F.lit("data_events").alias("table"), F.col("seq").alias("lsn")).alias("source")))
    return ev.select(F.concat(F.lit("u-"), F.col("userId").cast("string")).alias("key"), envelope.alias("value"),
                     F.col("seq").alias("offset"), F.col("createdAt").alias("timestamp"))


def cdc_shown(state):
    return state.select("key", F.get_json_object("row", "$.eventType").alias("eventType"),
                        F.get_json_object("row", "$.value").cast("double").alias("value"))


@query("src_cdc_topic", "ev", CDC)
def src_cdc_topic(spark, sf):
    return cdc_shown(cdc.current_state(cdc.parse_changes(cdc_records(spark, sf))))


# ---- streams -------------------------------------------------------------------------------------

@query("src_stream_events", "ev", """SELECT id, "tenantId", classification, "createdAt" FROM ev""")
def src_stream_events(spark, sf):
    ev = stream(spark, sf).select("id", "tenantId", "classification", "createdAt")
    return spark.read.parquet(drain(spark, "copy", lambda p, c: PL.start(ev, p, c, [], interval=None)))


@query("sink_stream_raw", "ev valid", """
SELECT id, "tenantId", classification, date, lpad(CAST(CAST(strftime(make_timestamp("createdAt"*1000), '%H') AS INT) AS VARCHAR), 2, '0') AS hour FROM valid""")
def sink_stream_raw(spark, sf):
    out = drain(spark, "raw", lambda p, c: PL.raw_sink(PL.prepared(valid_stream(spark, sf)), p, c, None, spread=1))
    return spark.read.parquet(out).select("id", "tenantId", "classification", F.col("date").cast("string").alias("date"),
                                          F.lpad(F.col("hour").cast("string"), 2, "0").alias("hour"))


WINDOWS = """w AS (SELECT "tenantId", classification, "processingPath", count(*) AS "eventCount", CAST(sum("payloadSizeBytes") AS BIGINT) AS "totalBytes",
  count(*) FILTER (WHERE "anomalyDetected") AS "anomalyCount", round(avg("enrichmentLatencyMs"), 6) AS "avgLatencyMs",
  "enrichedAt"//300000*300000 AS "windowStart", "enrichedAt"//300000*300000+300000 AS "windowEnd" FROM valid GROUP BY ALL)"""


def _windows(df):
    return df.select("tenantId", "classification", "processingPath", "eventCount", "totalBytes", "anomalyCount",
                     F.round("avgLatencyMs", 6).alias("avgLatencyMs"), F.unix_millis("windowStart").alias("windowStart"),
                     F.unix_millis("windowEnd").alias("windowEnd"))


@query("sink_stream_agg", "ev valid", WINDOWS + """
SELECT * FROM w WHERE "windowEnd" <= (SELECT max("enrichedAt") FROM valid) - 120000""")
def sink_stream_agg(spark, sf):
    """Append mode: the windows closed by the two-minute watermark."""
    out = drain(spark, "agg", lambda p, c: PL.window_sink(PL.prepared(valid_stream(spark, sf)), p, c, None))
    return _windows(spark.read.parquet(out))


@query("sink_stream_upserts", "ev valid", WINDOWS + " SELECT * FROM w")
def sink_stream_upserts(spark, sf):
    """Update mode: every window, closed or not, in its newest version."""
    out = drain(spark, "upserts", lambda p, c: PL.window_upserts(PL.prepared(valid_stream(spark, sf)), p, c, None))
    return _windows(PL.latest_windows(spark.read.parquet(out)))


@query("sink_topic", "ev", f"""
SELECT "tenantId" AS key, id, {B.ROUTE} AS route, CASE WHEN NOT "isPoison" AND classification<>'UNKNOWN' THEN '{TP.ENRICHED}' ELSE '{TP.DLQ}' END AS topic FROM ev""")
def sink_topic(spark, sf):
    ev = stream(spark, sf).select("id", "tenantId", "classification", "createdAt", "isPoison")
    out = drain(spark, "topics", lambda p, c: PL.route_sink(ev, p, c, None))
    rows = spark.read.parquet(out)
    return rows.select("key", F.get_json_object("value", "$.id").alias("id"), F.get_json_object("value", "$.route").alias("route"), "topic")


@query("sink_topic_windows", "ev valid", f"""
t AS (SELECT "tenantId", "createdAt"//{SIX_HOURS}*{SIX_HOURS} AS ws, count(*) AS n, CAST(sum("payloadSizeBytes") AS BIGINT) AS b,
  count(*) FILTER (WHERE "anomalyDetected") AS a FROM valid GROUP BY ALL),
cc AS (SELECT "tenantId", ws, string_agg(k || '=' || n, ',' ORDER BY k) AS m FROM (SELECT "tenantId", "createdAt"//{SIX_HOURS}*{SIX_HOURS} AS ws,
  classification AS k, count(*) AS n FROM valid GROUP BY ALL) GROUP BY ALL),
ct AS (SELECT "tenantId", ws, string_agg(k || '=' || n, ',' ORDER BY k) AS m FROM (SELECT "tenantId", "createdAt"//{SIX_HOURS}*{SIX_HOURS} AS ws,
  "eventType" AS k, count(*) AS n FROM valid GROUP BY ALL) GROUP BY ALL)
SELECT t."tenantId" AS key, '{TP.PROCESSED}' AS topic, t.ws AS "windowStart", t.n AS "totalEventCount", t.b AS "totalPayloadBytes", t.a AS "anomalyCount",
  cc.m AS "countByClassification", ct.m AS "countByEventType" FROM t JOIN cc ON t."tenantId"=cc."tenantId" AND t.ws=cc.ws
  JOIN ct ON t."tenantId"=ct."tenantId" AND t.ws=ct.ws WHERE t.ws + {SIX_HOURS} <= (SELECT max("createdAt") FROM valid) - 30000""")
def sink_topic_windows(spark, sf):
    """Tenant windows from two chained streaming aggregates, as topic records."""
    out = drain(spark, "processed", lambda p, c: PL.processed_sink(valid_stream(spark, sf), p, c, "6 hours", None))
    schema = ("windowStart BIGINT, totalEventCount BIGINT, totalPayloadBytes BIGINT, anomalyCount BIGINT, "
              "countByClassification MAP<STRING, BIGINT>, countByEventType MAP<STRING, BIGINT>")
    rows = spark.read.parquet(out).select("key", "topic", F.from_json("value", schema).alias("v")).select("key", "topic", "v.*")
    return rows.withColumns({c: E.map_text(c) for c in ("countByClassification", "countByEventType")})


@query("realtime_job", "ev valid", """
w AS (SELECT "tenantId", "enrichedAt"//300000*300000+300000 AS e, count(*) AS n FROM valid GROUP BY ALL)
SELECT 'raw' AS sink, "tenantId", count(*) AS events FROM valid GROUP BY ALL
UNION ALL SELECT 'aggregations', "tenantId", CAST(sum(n) AS BIGINT) FROM w WHERE e <= (SELECT max("enrichedAt") FROM valid) - 120000 GROUP BY ALL""")
def realtime_job(spark, sf):
    """Two queries off one source, run together."""
    path = shared_dir(spark, "realtime")
    PL.run_all(jobs.realtime_job(valid_stream(spark, sf), path, f"{path}/checkpoint", None, spread=1))
    raw = spark.read.parquet(f"{path}/raw").groupBy("tenantId").agg(F.count(F.lit(1)).alias("events"))
    agg = spark.read.parquet(f"{path}/aggregations").groupBy("tenantId").agg(F.sum("eventCount").alias("events"))
    return raw.select(F.lit("raw").alias("sink"), "*").unionByName(agg.select(F.lit("aggregations").alias("sink"), "*"))


@query("sink_landing_json", "ev valid", f"SELECT {WIRE} FROM valid")
def sink_landing_json(spark, sf):
    ev = B.dated(valid_stream(spark, sf)).drop("hour")
    out = drain(spark, "landing", lambda p, c: PL.landing_sink(ev, p, c, None, spread=1))
    return wire_out(SRC.read_json_events(spark, out))


@query("stream_dedup", "ev", """SELECT DISTINCT CASE WHEN seq%13<>0 THEN "idempotencyKey" END AS "idempotencyKey", CASE WHEN seq%13=0 THEN id END AS "unkeyedId" FROM ev""")
def stream_dedup(spark, sf):
    """One event per key, and every event without one; which of a key's events comes first depends on arrival."""
    keyed = stream(spark, sf).withColumn("idempotencyKey", F.when(F.col("seq") % 13 != 0, F.col("idempotencyKey")))
    ev = PL.deduplicated(keyed).select("id", "idempotencyKey")
    out = spark.read.parquet(drain(spark, "dedup", lambda p, c: PL.start(ev, p, c, [], interval=None)))
    return out.select("idempotencyKey", F.when(F.col("idempotencyKey").isNull(), F.col("id")).alias("unkeyedId"))


@query("stream_ewma", "ev valid", B.EWMA + f"""
SELECT "tenantId", i*{SIX_HOURS} AS "windowStart", n, round(baseline, 6) AS baseline, round(s, 6) AS "anomalyScore", s>=0.8 AS "anomalyDetected"
FROM b WHERE (i+1)*{SIX_HOURS} <= (SELECT max("createdAt") FROM valid WHERE classification IN ('CONFIDENTIAL','RESTRICTED')) - 30000""", recursive=True)
def stream_ewma(spark, sf):
    """Windowed counts chained with the stateful baseline in one streaming query."""
    scored = SF.baseline_scores(SF.window_counts(valid_stream(spark, sf), SIX_HOURS), SIX_HOURS)
    out = drain(spark, "ewma", lambda p, c: PL.start(scored, p, c, [], interval=None))
    return spark.read.parquet(out).withColumns(B.r6("baseline", "anomalyScore"))


@query("late_data", "ev", """
SELECT id, "createdAt", value>100 AND "createdAt" <= (SELECT max("createdAt") FROM ev WHERE NOT value>100) - 7200000 AS late FROM ev""")
def late_data(spark, sf):
    """Two runs from one checkpoint: the second finds delayed events and tells which are too late."""
    path = shared_dir(spark, "late")
    ev = T.data_events(spark, sf).select("id", "createdAt", "value")

    def run():
        source = ST.file_stream(use_rocksdb(spark), f"{path}/in", ev.schema, max_files=100_000)
        PL.run_all([PL.start(KS.marked_late(source, "2 hours"), f"{path}/out", f"{path}/checkpoint", ["late"], interval=None)])

    ev.where(~(F.col("value") > 100)).write.parquet(f"{path}/in")
    run()
    ev.where(F.col("value") > 100).write.mode("append").parquet(f"{path}/in")
    run()
    return spark.read.parquet(f"{path}/out").select("id", "createdAt", F.col("late").cast("boolean").alias("late"))


# ---- streams with timers -------------------------------------------------------------------------

FAR_MS = 4_000_000_000_000  # a row of this time closes everything before it


def closed(spark, name, rows, closing, build):
    """Run a stream over ``rows``, then again from its checkpoint over ``closing``, which moves the watermark past them."""
    path = shared_dir(spark, name)
    use_rocksdb(spark)
    for part in (rows, closing):
        part.write.mode("append").parquet(f"{path}/in")
        out = build(ST.file_stream(spark, f"{path}/in", rows.schema))
        PL.run_all([PL.start(out, f"{path}/out", f"{path}/checkpoint", [], interval=None)])
    return spark.read.parquet(f"{path}/out")


@query("tail_sample_stream", "spans", MQ.TAIL)
def tail_sample_stream(spark, sf):
    """Traces decided by timers half a minute after their first span."""
    spans = T.spans(spark, sf)
    last = spans.limit(1).select(F.lit(-1).cast("bigint").alias("traceId"), F.lit("last").alias("spanId"), F.lit("OK").alias("statusCode"),
                                 F.lit(FAR_MS).alias("startMs"), F.lit(FAR_MS).alias("endMs"),
                                 F.create_map().cast("map<string,string>").alias("attributes"))
    kept = closed(spark, "tail-sample", spans, last, lambda s: KS.tail_sample(s, F.col("traceId") % 100))
    return kept.where("traceId >= 0").select("traceId", "spanId", "statusCode")


@query("idempotency_ttl_stream", "ev", LQ.TTL, recursive=True)
def idempotency_ttl_stream(spark, sf):
    """Keys that timers forget when they expire."""
    ev = T.data_events(spark, sf).select(F.col("userId").alias("key"), F.col("eventType").alias("service"), "seq", "createdAt")
    last = ev.limit(1).select(F.lit(None).cast("bigint").alias("key"), "service", "seq", F.lit(FAR_MS).alias("createdAt"))
    out = closed(spark, "ttl", ev, last, lambda s: KS.accept_with_ttl(s, ["key", "service"], "createdAt", "seq", 2 * LQ.DAY))
    return out.where("key IS NOT NULL")


@query("alert_changes_stream", "gauges", MQ.CHANGES)
def alert_changes_stream(spark, sf):
    """Alerts that fire and resolve by timers."""
    samples = T.gauge_samples(spark, sf)
    last = samples.limit(1).select(F.lit("consumer_group_lag").alias("metric"), F.lit("none").alias("series"), "seq",
                                   F.lit(FAR_MS).alias("ts"), F.lit(0.0).alias("value"))
    return closed(spark, "alerts", samples, last, lambda s: KS.alert_changes(s, lookback_ms=MQ.ALERT_LOOKBACK))


@query("alarm_states_stream", "ev", MQ.ALARM_SQL)
def alarm_states_stream(spark, sf):
    """Alarms over fixed periods that timers close."""
    samples = MQ.alarm_samples(spark, sf)
    last = samples.limit(1).select(F.lit("sync.errors").alias("metric"), F.lit("last").alias("series"), F.lit(FAR_MS).alias("ts"),
                                   F.lit(0.0).alias("value"))
    out = closed(spark, "alarms", samples, last, KS.alarm_states)
    return out.where("series <> 'last'").withColumn("value", F.round("value", 6))


@query("windows_and_late", "ev", """
SELECT 'tenant-' || ("userId"%8) AS "tenantId", "createdAt"//3600000*3600000 AS "windowStart", count(*) AS n FROM ev GROUP BY ALL""")
def windows_and_late(spark, sf):
    """Hourly counts by the query's own watermark, then late rows of closed hours as rows of their own; here both are counted."""
    ev = T.data_events(spark, sf).select(F.concat(F.lit("tenant-"), (F.col("userId") % 8).cast("string")).alias("tenantId"), "id", "createdAt")
    last = ev.limit(1).select("tenantId", F.lit("last").alias("id"), F.lit(FAR_MS).alias("createdAt"))
    out = closed(spark, "late", ev, last, lambda s: KS.windows_and_late(s, ["tenantId"], 3_600_000, "0 seconds"))
    return out.groupBy("tenantId", "windowStart").agg(F.sum("n").alias("n"))


@query("cdc_stream", "ev", CDC)
def cdc_stream(spark, sf):
    """The change feed as a stream: the latest change of each key as it comes, and the table they add up to."""
    records = cdc_records(spark, sf)
    last = records.limit(1).select(F.lit("last").alias("key"), F.lit(None).cast("string").alias("value"), F.lit(-1).cast("bigint").alias("offset"),
                                   F.lit(FAR_MS).alias("timestamp"))
    out = closed(spark, "cdc", records, last, lambda s: KS.latest_changes(cdc.parse_changes(s)))
    return cdc_shown(cdc.current_state(out))
