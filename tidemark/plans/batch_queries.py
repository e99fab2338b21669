"""Projections, filters, aggregates, analytic functions and anomaly scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import schema as S
from tidemark.functions import events as E
from tidemark.functions import text as X
from tidemark.operators import aggregates as A
from tidemark.operators import analytic as W
from tidemark.operators import anomaly as N
from tidemark.operators import lifecycle as L
from tidemark.operators import projections as P
from tidemark.operators import rollups as RU
from tidemark.operators import routing as R
from tidemark.plans.registry import query
from tidemark.plans.views import KNOWN
from tidemark.sources import adapter as T

NOW = T.NOW_MS
SIX_HOURS = 6 * 3_600_000
CUTOFF = "2024-06-30"


def r6(*cols: str):
    return {c: F.round(c, 6) for c in cols}


def dated(df):
    """Event date and hour, the partitioning of the landed events."""
    return df.withColumns({"date": F.date_format(E.ts("createdAt"), "yyyy-MM-dd"),
                           "hour": F.hour(E.ts("createdAt")).cast("bigint")})


def routed(spark, sf):
    return T.data_events(spark, sf).withColumn("route", R.route(F.col("isPoison")))


def daily_counts(spark, sf):
    return A.event_counts(dated(T.valid_events(spark, sf)))


# ---- projections ------------------------------------------------------------------------------

@query("event_time_columns", "ev", """
SELECT id, "createdAt" AS "eventTsMs", date, strftime(make_timestamp("createdAt"*1000), '%Y-%m-%d') AS "eventDate",
  "enrichedAt" AS "ingestionTsMs", CAST(strftime(make_timestamp("enrichedAt"*1000), '%H') AS BIGINT) AS hour FROM ev""")
def event_time_columns(spark, sf):
    df = P.event_time_columns(T.data_events(spark, sf))
    return df.select("id", F.unix_millis("eventTs").alias("eventTsMs"), "date",
                     F.col("eventDate").cast("string").alias("eventDate"),
                     F.unix_millis("ingestionTs").alias("ingestionTsMs"), F.col("hour").cast("bigint").alias("hour"))


@query("fast_path_enrich", "ev valid", """
SELECT id, "tenantId", classification, "createdAt" AS "enrichedAt", 'tidemark' AS "processorId",
  CAST(0 AS BIGINT) AS "windowedEventCount", CAST(0 AS DOUBLE) AS "anomalyScore", false AS "anomalyDetected",
  CAST(0 AS BIGINT) AS "enrichmentLatencyMs", 'FAST_PATH' AS "processingPath", 'k=' || mk AS metadata
FROM valid WHERE classification IN ('PUBLIC','INTERNAL')""")
def fast_path_enrich(spark, sf):
    fast = T.valid_events(spark, sf).where(E.is_fast("classification"))
    return P.fast_path_enrich(fast, "tidemark", F.col("createdAt")).select(
        "id", "tenantId", "classification", "enrichedAt", "processorId", "windowedEventCount", "anomalyScore",
        "anomalyDetected", "enrichmentLatencyMs", "processingPath", E.map_text("metadata").alias("metadata"))


ORDINAL = f"""ord AS (SELECT *, row_number() OVER (PARTITION BY "tenantId", "createdAt"//{SIX_HOURS}
  ORDER BY "createdAt", seq) AS n FROM valid WHERE classification IN ('CONFIDENTIAL','RESTRICTED'))"""


@query("metadata_enrich", "ev valid", ORDINAL + """
SELECT id, 'enricher.path=ENRICHMENT_PATH,enricher.version=1.0,enricher.window.count=' || n || ',k=' || mk AS metadata
FROM ord""")
def metadata_enrich(spark, sf):
    counted = N.running_tenant_count(T.valid_events(spark, sf), SIX_HOURS, "seq")
    return P.metadata_enrich(counted).select("id", E.map_text("metadata").alias("metadata"))


@query("processing_path", "ev", """
SELECT id, classification, CASE WHEN classification IN ('CONFIDENTIAL','RESTRICTED') THEN 'ENRICHMENT_PATH'
  ELSE 'FAST_PATH' END AS "processingPath" FROM ev""")
def processing_path(spark, sf):
    return P.with_processing_path(T.data_events(spark, sf)).select("id", "classification", "processingPath")


@query("archive_columns", "ev", f"""
SELECT id, strftime(make_timestamp("createdAt"*1000), '%Y') AS year, strftime(make_timestamp("createdAt"*1000), '%m') AS month,
  date AS "eventDate", CAST({NOW} AS BIGINT) AS "archivedAt", 'archive/events' AS "archiveLocation" FROM ev""")
def archive_columns(spark, sf):
    return P.archive_columns(T.data_events(spark, sf), "archive/events", F.lit(NOW).cast("bigint")).select(
        "id", "year", "month", F.col("eventDate").cast("string").alias("eventDate"), "archivedAt", "archiveLocation")


@query("storage_keys", "aws", """
SELECT id, 'tenants/' || "tenantId" || '/enriched/' || strftime(make_timestamp("createdAt"*1000), '%Y-%m-%d') || '/' || id || '.json' AS "enrichedKey",
  "tenantId" || '/raw/' || "aggregateId" || '/' || id AS "rawKey",
  "tenantId" || '/' || CASE WHEN k%4=0 THEN 'events' ELSE "aggregateType" END || '/'
    || CASE WHEN k%5=0 THEN id ELSE "aggregateId" END || '/1/' || "wallClockTs" || '.bin' AS "syncKey",
  CASE WHEN k%5=0 THEN id ELSE "aggregateId" END AS "documentId"
FROM aws""")
def storage_keys(spark, sf):
    rec = T.sync_copy(spark, sf, "aws")
    k = F.col("_k")
    keyed = rec.withColumn("_k", F.col("aggregateId").cast("bigint"))
    raw = P.raw_object_key(F.col("tenantId"), F.col("aggregateId"), F.col("id"))
    keyed = keyed.withColumn("rawKey", raw).withColumns({
        "aggregateType": F.when(k % 4 != 0, F.col("aggregateType")),
        "aggregateId": F.when(k % 5 != 0, F.col("aggregateId"))})
    return keyed.select(
        "id", P.enriched_object_key(F.col("tenantId"), E.utc_date("createdAt").cast("string"), F.col("id")).alias("enrichedKey"),
        "rawKey", P.sync_object_key().alias("syncKey"), P.sync_document_id().alias("documentId"))


@query("event_dto", "life", """
SELECT id, "tenantId", "schemaName", "schemaVersion", classification, status, "createdAt", "updatedAt", "retryCount",
  status IN ('PROCESSED','DEAD_LETTERED') AS "isTerminal", "encryptedPayload" IS NOT NULL AS "isEncrypted" FROM life""")
def event_dto(spark, sf):
    return P.event_dto(T.lifecycle_rows(spark, sf))


@query("domain_to_event", "life", """
SELECT id, "tenantId", "schemaName" AS "sourceSystem", 'DataEventCreated' AS "eventType", classification,
  'PUBLISHED' AS status, CAST("schemaVersion" AS VARCHAR) AS "schemaVersion", id AS "idempotencyKey",
  '' AS metadata, 0 AS "payloadSizeBytes", "createdAt" FROM life
UNION ALL
SELECT 's-' || id, "tenantId", 'ingestion', "schemaName", classification, 'PUBLISHED', '1.0', "idempotencyKey",
  'encryptionKey=' || coalesce("encryptionKeyVersion", '') || ',storageKey=' || "tenantId" || '/raw/' || id,
  coalesce(strlen("encryptedPayload"), 0), "createdAt" FROM life""")
def domain_to_event(spark, sf):
    rows = T.lifecycle_rows(spark, sf)
    stored = rows.select(
        F.concat(F.lit("s-"), "id").alias("sagaId"), "tenantId", F.col("schemaName").alias("eventType"), "classification",
        F.col("idempotencyKey").alias("requestId"), F.concat_ws("/", "tenantId", F.lit("raw"), "id").alias("storageObjectKey"),
        F.col("encryptionKeyVersion").alias("encryptionKeyId"), "encryptedPayload", "createdAt")
    both = P.created_to_record(rows).unionByName(P.ingested_to_record(stored, "ingestion"))
    return both.withColumn("metadata", E.map_text("metadata"))


@query("payload_codec", "", """
SELECT doc_id, CASE WHEN doc_id%5<3 THEN to_base64(encode(text)) END AS encoded,
  CASE WHEN doc_id%5<3 THEN text END AS decoded, doc_id%5=4 AS rejected FROM documents""")
def payload_codec(spark, sf):
    docs = T.table(spark, sf, "documents")
    k = F.col("doc_id") % 5
    sent = F.when(k < 3, X.encode_payload(F.encode("text", "UTF-8"))).when(k == 3, "  ").otherwise("%%not base64%%")
    sent = docs.select("doc_id", k.alias("k"), sent.alias("sent"))
    return sent.select("doc_id", F.when(F.col("k") < 3, F.regexp_replace("sent", "[\r\n]", "")).alias("encoded"),
                       X.decode_payload("sent").cast("string").alias("decoded"), X.payload_rejected("sent").alias("rejected"))


@query("class_attributes", "ev", """
SELECT id, classification, CASE classification WHEN 'PUBLIC' THEN 365 WHEN 'INTERNAL' THEN 365 WHEN 'CONFIDENTIAL' THEN 90
  WHEN 'RESTRICTED' THEN 30 END AS "rotationDays", classification IN ('CONFIDENTIAL','RESTRICTED') AS "requiresCmk",
  classification='RESTRICTED' AS "requiresAudit" FROM ev""")
def class_attributes(spark, sf):
    return P.class_attributes(T.data_events(spark, sf)).select(
        "id", "classification", "rotationDays", "requiresCmk", "requiresAudit")


@query("mask_sensitive", "", """
SELECT kind, id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(body,
    '"password"\\s*:\\s*"[^"]*"', '"password":"****"', 'gi'), '"token"\\s*:\\s*"[^"]*"', '"token":"****"', 'gi'),
    '"secret"\\s*:\\s*"[^"]*"', '"secret":"****"', 'gi'), '"apiKey"\\s*:\\s*"[^"]*"', '"apiKey":"****"', 'gi') AS masked
FROM (SELECT 'doc' AS kind, CAST(doc_id AS VARCHAR) AS id,
    '{"Password" : "p' || doc_id || '", "apikey":"a", "note":"' || text || '", "TOKEN":"t"}' AS body FROM documents
  UNION ALL SELECT 'turn', conv_id || '/' || turn, '{"secret": "' || role || '", "text":"' || text || '"}' FROM conversations)""")
def mask_sensitive(spark, sf):
    docs = T.table(spark, sf, "documents").select(
        F.lit("doc").alias("kind"), F.col("doc_id").cast("string").alias("id"),
        F.concat(F.lit('{"Password" : "p'), "doc_id", F.lit('", "apikey":"a", "note":"'), "text", F.lit('", "TOKEN":"t"}')).alias("body"))
    turns = T.table(spark, sf, "conversations").select(
        F.lit("turn").alias("kind"), F.concat_ws("/", "conv_id", "turn").alias("id"),
        F.concat(F.lit('{"secret": "'), "role", F.lit('", "text":"'), "text", F.lit('"}')).alias("body"))
    return docs.unionByName(turns).select("kind", "id", X.mask_sensitive("body").alias("masked"))


# ---- filters and routes ------------------------------------------------------------------------

@query("poison_split", "ev", """
SELECT id, CASE WHEN "isPoison" THEN 'DLQ' ELSE 'VALID' END AS branch FROM ev""")
def poison_split(spark, sf):
    return T.data_events(spark, sf).select("id", F.when(F.col("isPoison"), "DLQ").otherwise("VALID").alias("branch"))


ROUTE = """CASE WHEN "isPoison" THEN 'POISON_DLQ' WHEN classification IN ('PUBLIC','INTERNAL') THEN 'FAST'
  WHEN classification IN ('CONFIDENTIAL','RESTRICTED') THEN 'ENRICHMENT' ELSE 'UNKNOWN_DLQ' END"""


@query("classification_route", "ev", f"""SELECT id, classification, {ROUTE} AS route FROM ev""")
def classification_route(spark, sf):
    return routed(spark, sf).select("id", "classification", "route")


@query("merge_paths", "ev", f"""
SELECT id, "tenantId", {ROUTE} AS path FROM ev WHERE NOT "isPoison" AND classification<>'UNKNOWN'""")
def merge_paths(spark, sf):
    """Both enrichment paths in one pass: a route column and a filter, no union."""
    return (routed(spark, sf).where(F.col("route").isin("FAST", "ENRICHMENT"))
            .select("id", "tenantId", F.col("route").alias("path")))


@query("archive_eligible", "ev", f"""
SELECT id, classification, date FROM ev WHERE CAST(date AS DATE) < DATE '{CUTOFF}' AND CAST(date AS DATE) <
  DATE '{CUTOFF}' - CASE classification WHEN 'PUBLIC' THEN 30 WHEN 'INTERNAL' THEN 90 WHEN 'CONFIDENTIAL' THEN 180
  WHEN 'RESTRICTED' THEN 365 END""")
def archive_eligible(spark, sf):
    old = R.archive_eligible(T.data_events(spark, sf), CUTOFF)
    return old.select("id", "classification", E.utc_date("createdAt").cast("string").alias("date"))


@query("find_by_tenant_status", "life", """
SELECT id, "tenantId", status FROM life WHERE "tenantId"='tenant-3' AND status IN ('FAILED','PROCESSING')""")
def find_by_tenant_status(spark, sf):
    return R.by_tenant_status(T.lifecycle_rows(spark, sf), "tenant-3", "FAILED", "PROCESSING").select("id", "tenantId", "status")


@query("find_by_id_tenant_safe", "life", """
SELECT id, "tenantId", "isTerminal" FROM (SELECT id, "tenantId", status IN ('PROCESSED','DEAD_LETTERED') AS "isTerminal" FROM life)
WHERE (id, "tenantId") IN (SELECT CAST(o_orderkey AS VARCHAR), 'tenant-' || (o_custkey%8) FROM orders)""")
def find_by_id_tenant_safe(spark, sf):
    asked = T.table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"), T.tenant(F.col("o_custkey")).alias("tenantId"))
    return R.by_id_tenant_safe(P.event_dto(T.lifecycle_rows(spark, sf)), asked).select("id", "tenantId", "isTerminal")


@query("stale_processing", "life", f"""
SELECT id, "updatedAt" FROM life WHERE status='PROCESSING' AND "updatedAt" < {NOW} - 1800000""")
def stale_processing(spark, sf):
    return R.stale_processing(T.lifecycle_rows(spark, sf), NOW).select("id", "updatedAt")


@query("stale_processing_page", "life", f"""
SELECT id, "updatedAt" FROM life WHERE status='PROCESSING' AND "updatedAt" < {NOW} - 1800000 ORDER BY "updatedAt", id LIMIT 15""")
def stale_processing_page(spark, sf):
    """The oldest first, one page."""
    return R.stale_processing(T.lifecycle_rows(spark, sf), NOW, limit=15).select("id", "updatedAt")


@query("dlq_due", "dlq", f"""
SELECT id, "tenantId", "nextRetryAt" FROM dlq WHERE status='PENDING_RETRY' AND "nextRetryAt" < {NOW}""")
def dlq_due(spark, sf):
    return R.dlq_due(T.dlq_rows(spark, sf), NOW).select("id", "tenantId", "nextRetryAt")


@query("tenant_class_filter", "ev users grants", f"""
SELECT id, "tenantId", classification FROM ev
WHERE ("tenantId", classification) IN (SELECT "tenantId", classification FROM grants WHERE classification IN {KNOWN}
  AND username IN (SELECT username FROM users WHERE "serviceAccount" AND enabled))""")
def tenant_class_filter(spark, sf):
    services = T.users(spark, sf).where(F.col("serviceAccount") & F.col("enabled")).select("username")
    grants = T.user_grants(spark, sf).join(services, "username", "left_semi")
    return R.visible_to(T.data_events(spark, sf), grants).select("id", "tenantId", "classification")


@query("access_log_clean", "http", """
SELECT seq, "tenantId", uri, method, status, "durationMs", "durationMs">2000 AS slow,
  coalesce("contentType", 'unknown') AS "contentType" FROM http
WHERE uri NOT IN ('/actuator/health', '/actuator/info')""")
def access_log_clean(spark, sf):
    return R.access_log_clean(T.http_requests(spark, sf)).drop("ts")


@query("retention_candidates", "", f"""
aged AS (SELECT o_orderkey AS seq, ({NOW} - epoch_ms(o_orderdate))//86400000 AS age,
  (['PUBLIC','INTERNAL','CONFIDENTIAL','RESTRICTED'])[o_orderkey%4+1] AS classification FROM orders),
pol AS (SELECT *, CASE classification WHEN 'PUBLIC' THEN -1 WHEN 'INTERNAL' THEN 365 WHEN 'CONFIDENTIAL' THEN 730 ELSE 1825 END AS db,
  CASE classification WHEN 'PUBLIC' THEN 365 WHEN 'INTERNAL' THEN 730 WHEN 'CONFIDENTIAL' THEN 1825 ELSE 2555 END AS obj FROM aged)
SELECT seq, classification, age AS "ageDays", db>=0 AND age>db AS "purgeDb", obj>=0 AND age>obj AS "expireObject",
  classification IN ('CONFIDENTIAL','RESTRICTED') AS "auditDeletion" FROM pol WHERE (db>=0 AND age>db) OR (obj>=0 AND age>obj)""".replace(
    "aged AS", "WITH aged AS", 1))
def retention_candidates(spark, sf):
    rows = T.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("seq"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("createdAt"),
        T.pick(S.CLASSIFICATIONS, F.col("o_orderkey") % 4).alias("classification"))
    return R.retention_candidates(rows, NOW).drop("createdAt")


LIMITS = """CASE classification WHEN 'PUBLIC' THEN 365 WHEN 'INTERNAL' THEN 365 WHEN 'CONFIDENTIAL' THEN 730 ELSE 1825 END"""


@query("retention_edges", "ev", f"""
aged AS (SELECT seq, classification, {LIMITS} + seq%7 - 3 AS age FROM ev WHERE classification IN ('PUBLIC','INTERNAL','CONFIDENTIAL','RESTRICTED')),
pol AS (SELECT *, CASE classification WHEN 'PUBLIC' THEN -1 WHEN 'INTERNAL' THEN 365 WHEN 'CONFIDENTIAL' THEN 730 ELSE 1825 END AS db,
  CASE classification WHEN 'PUBLIC' THEN 365 WHEN 'INTERNAL' THEN 730 WHEN 'CONFIDENTIAL' THEN 1825 ELSE 2555 END AS obj FROM aged)
SELECT seq, classification, age AS "ageDays", db>=0 AND age>db AS "purgeDb", obj>=0 AND age>obj AS "expireObject",
  classification IN ('CONFIDENTIAL','RESTRICTED') AS "auditDeletion" FROM pol WHERE (db>=0 AND age>db) OR (obj>=0 AND age>obj)""")
def retention_edges(spark, sf):
    """Ages of up to three days around each class's limit: most rows stay."""
    ev = T.data_events(spark, sf).where(F.col("classification").isin(S.CLASSIFICATIONS))
    c = F.col("classification")
    limit = F.when(c.isin("PUBLIC", "INTERNAL"), 365).when(c == "CONFIDENTIAL", 730).otherwise(1825)
    rows = ev.select("seq", "classification", (F.lit(NOW) - (limit + F.col("seq") % 7 - 3) * 86_400_000).alias("createdAt"))
    return R.retention_candidates(rows, NOW).drop("createdAt")


@query("active_users", "users", f"""
SELECT username, "tenantId" FROM users WHERE enabled AND ("lockedUntil" IS NULL OR "lockedUntil" < {NOW})""")
def active_users(spark, sf):
    return R.active_users(T.users(spark, sf), NOW).select("username", "tenantId")


@query("degraded_probe", "probes", """
SELECT seq, "cloudProvider", NOT reachable OR "errorRatePercent">5 OR "latencyMs">5000 AS degraded FROM probes""")
def degraded_probe(spark, sf):
    return T.probes(spark, sf).select("seq", "cloudProvider", R.is_degraded().alias("degraded"))


@query("service_accounts_by_role", "users user_roles", """
SELECT u.username, u."tenantId", r.role FROM users u JOIN user_roles r ON u.username=r.username WHERE u."serviceAccount\"""")
def service_accounts_by_role(spark, sf):
    return R.service_accounts_by_role(T.users(spark, sf), T.user_roles(spark, sf)).select("username", "tenantId", "role")


@query("service_accounts_of_role", "users user_roles", """
f AS (SELECT u.username, u."tenantId", r.role FROM users u JOIN user_roles r ON u.username=r.username
  WHERE u."serviceAccount" AND r.role=(SELECT min(role) FROM user_roles))
SELECT *, (SELECT count(*) FROM f) AS "totalElements", CAST(ceil((SELECT count(*) FROM f)/10.0) AS BIGINT) AS "totalPages",
  1 < ceil((SELECT count(*) FROM f)/10.0)-1 AS "hasNext" FROM f ORDER BY username LIMIT 10 OFFSET 10""")
def service_accounts_of_role(spark, sf):
    """One role, second page."""
    roles = T.user_roles(spark, sf)
    first = roles.agg(F.min("role").alias("r")).first()["r"]
    found = R.service_accounts_by_role(T.users(spark, sf), roles, first).select("username", "tenantId", "role")
    return L.page(found, ["username"], 1, 10)


@query("tenant_offboard", "users", """
SELECT username, "tenantId", enabled AND "tenantId"<>'tenant-2' AS enabled FROM users""")
def tenant_offboard(spark, sf):
    return R.disable_tenant(T.users(spark, sf), "tenant-2").select("username", "tenantId", "enabled")


# ---- aggregates --------------------------------------------------------------------------------

COUNTS = """cnt AS (SELECT "tenantId", classification, "eventType", "schemaVersion", date, count(*) AS "eventCount",
  CAST(sum("payloadSizeBytes") AS BIGINT) AS "totalPayloadBytes", count(*) FILTER (WHERE "anomalyDetected") AS "anomalyCount",
  min("createdAt") AS "firstEventAt", max("createdAt") AS "lastEventAt" FROM valid GROUP BY ALL)"""
LATENCY = """lat AS (SELECT "tenantId", date, count(*) AS "sampleCount", quantile_disc("enrichmentLatencyMs", 0.5) AS "p50LatencyMs",
  quantile_disc("enrichmentLatencyMs", 0.95) AS "p95LatencyMs", quantile_disc("enrichmentLatencyMs", 0.99) AS "p99LatencyMs",
  max("enrichmentLatencyMs") AS "maxLatencyMs" FROM valid GROUP BY ALL)"""
SUMMARY = """summ AS (SELECT "tenantId", date, CAST(sum("eventCount") AS BIGINT) AS "totalEvents", sum("totalPayloadBytes")/1048576.0 AS "totalPayloadMb",
  CAST(sum("anomalyCount") AS BIGINT) AS "totalAnomalies", count(DISTINCT "eventType") AS "uniqueEventTypes",
  count(DISTINCT classification) AS "activeClassifications" FROM cnt GROUP BY ALL)"""
DOMINANT = """per AS (SELECT "tenantId", date, classification, sum("eventCount") AS n FROM cnt GROUP BY ALL),
dom AS (SELECT "tenantId", date, classification AS "dominantClassification" FROM per
  QUALIFY row_number() OVER (PARTITION BY "tenantId", date ORDER BY n DESC, classification)=1)"""
GROWTH = """gro AS (SELECT a."tenantId", a.date, b."totalEvents" AS "prevDayEvents", c."totalEvents" AS "prevWeekEvents",
  CASE WHEN b."totalEvents">0 THEN round((a."totalEvents"-b."totalEvents")*100.0/b."totalEvents", 6) END AS "dayOnDayGrowthPct",
  CASE WHEN c."totalEvents">0 THEN round((a."totalEvents"-c."totalEvents")*100.0/c."totalEvents", 6) END AS "weekOnWeekGrowthPct"
  FROM summ a LEFT JOIN summ b ON a."tenantId"=b."tenantId" AND CAST(a.date AS DATE)-1=CAST(b.date AS DATE)
  LEFT JOIN summ c ON a."tenantId"=c."tenantId" AND CAST(a.date AS DATE)-7=CAST(c.date AS DATE))"""


@query("event_counts", "ev valid", COUNTS + """
SELECT *, round("totalPayloadBytes"/"eventCount", 6) AS "avgPayloadBytes" FROM cnt""")
def event_counts(spark, sf):
    return daily_counts(spark, sf).withColumns(r6("avgPayloadBytes"))


@query("latency_stats", "ev valid", LATENCY + "SELECT * FROM lat")
def latency_stats(spark, sf):
    return A.latency_stats(dated(T.valid_events(spark, sf)))


@query("hourly_rate", "ev valid", """
SELECT "tenantId", date, hour, count(*) AS "eventCount" FROM valid GROUP BY ALL""".strip())
def hourly_rate(spark, sf):
    return A.hourly_rate(dated(T.valid_events(spark, sf)))


@query("tenant_daily_summary", "ev valid", COUNTS + ", " + SUMMARY + """
SELECT * REPLACE (round("totalPayloadMb", 6) AS "totalPayloadMb"), round("totalAnomalies"/"totalEvents", 6) AS "anomalyRate" FROM summ""")
def tenant_daily_summary(spark, sf):
    return A.tenant_daily_summary(daily_counts(spark, sf)).withColumns(r6("totalPayloadMb", "anomalyRate"))


@query("windowed_event_agg", "ev", f"""
r AS (SELECT *, {ROUTE} AS route, "createdAt"//{SIX_HOURS}*{SIX_HOURS} AS ws FROM ev),
t AS (SELECT "tenantId", ws, count(*) FILTER (WHERE route IN ('FAST','ENRICHMENT')) AS n,
  CAST(coalesce(sum("payloadSizeBytes") FILTER (WHERE route IN ('FAST','ENRICHMENT')), 0) AS BIGINT) AS b,
  count(*) FILTER (WHERE route IN ('FAST','ENRICHMENT') AND "anomalyDetected") AS a,
  count(*) FILTER (WHERE route NOT IN ('FAST','ENRICHMENT')) AS d,
  quantile_disc("enrichmentLatencyMs", 0.5) FILTER (WHERE route IN ('FAST','ENRICHMENT')) AS p50,
  quantile_disc("enrichmentLatencyMs", 0.99) FILTER (WHERE route IN ('FAST','ENRICHMENT')) AS p99 FROM r GROUP BY ALL),
cc AS (SELECT "tenantId", ws, string_agg(k || '=' || n, ',' ORDER BY k) AS m FROM (SELECT "tenantId", ws, classification AS k, count(*) AS n
  FROM r WHERE route IN ('FAST','ENRICHMENT') GROUP BY ALL) GROUP BY ALL),
ct AS (SELECT "tenantId", ws, string_agg(k || '=' || n, ',' ORDER BY k) AS m FROM (SELECT "tenantId", ws, "eventType" AS k, count(*) AS n
  FROM r WHERE route IN ('FAST','ENRICHMENT') GROUP BY ALL) GROUP BY ALL)
SELECT t."tenantId", t.ws AS "windowStart", t.ws+{SIX_HOURS} AS "windowEnd", CAST({SIX_HOURS} AS BIGINT) AS "windowDurationMs",
  t.n AS "totalEventCount", coalesce(cc.m, '') AS "countByClassification", t.b AS "totalPayloadBytes", t.a AS "anomalyCount",
  t.d AS "dlqCount", t.p50 AS "p50LatencyMs", t.p99 AS "p99LatencyMs", coalesce(ct.m, '') AS "countByEventType"
FROM t LEFT JOIN cc ON t."tenantId"=cc."tenantId" AND t.ws=cc.ws LEFT JOIN ct ON t."tenantId"=ct."tenantId" AND t.ws=ct.ws""")
def windowed_event_agg(spark, sf):
    agg = A.windowed_event_agg(routed(spark, sf), SIX_HOURS)
    as_text = lambda c: F.coalesce(E.map_text(c), F.lit(""))
    return agg.withColumns({c: as_text(c) for c in ("countByClassification", "countByEventType")})


@query("stream_window_counts", "ev valid", """
SELECT "tenantId", classification, "processingPath", count(*) AS "eventCount", CAST(sum("payloadSizeBytes") AS BIGINT) AS "totalBytes",
  count(*) FILTER (WHERE "anomalyDetected") AS "anomalyCount", round(avg("enrichmentLatencyMs"), 6) AS "avgLatencyMs",
  "enrichedAt"//300000*300000 AS "windowStart", "enrichedAt"//300000*300000+300000 AS "windowEnd" FROM valid GROUP BY ALL""".strip())
def stream_window_counts(spark, sf):
    counts = A.stream_window_counts(P.event_time_columns(T.enriched_events(spark, sf)))
    return counts.withColumns({"windowStart": F.unix_millis("windowStart"), "windowEnd": F.unix_millis("windowEnd"),
                               **r6("avgLatencyMs")})


@query("count_by_tenant_status", "life", """SELECT "tenantId", status, count(*) AS n FROM life GROUP BY ALL""")
def count_by_tenant_status(spark, sf):
    return A.count_by(T.lifecycle_rows(spark, sf), "tenantId", "status")


@query("audit_rollup", "audit", """
SELECT "eventType", outcome, "tenantId", actor, count(*) AS n, min(r) AS "firstRequestId", max(r) AS "lastRequestId", max(timestamp) AS "lastAt"
FROM (SELECT *, CASE WHEN trim(coalesce("requestId", ''))<>'' THEN "requestId" ELSE "contextRequestId" END AS r FROM audit) GROUP BY ALL""")
def audit_rollup(spark, sf):
    return A.audit_rollup(T.audit_events(spark, sf))


# ---- ranks, metrics, intervals -----------------------------------------------------------------

@query("top_event_types", "ev valid", """
t AS (SELECT "tenantId", date, "eventType", count(*) AS "typeCount" FROM valid GROUP BY ALL)
SELECT *, rank() OVER (PARTITION BY "tenantId", date ORDER BY "typeCount" DESC) AS rank FROM t QUALIFY rank<=10""")
def top_event_types(spark, sf):
    return W.top_event_types(dated(T.valid_events(spark, sf))).withColumn("rank", F.col("rank").cast("bigint"))


@query("dominant_classification", "ev valid", COUNTS + ", " + DOMINANT + " SELECT * FROM dom")
def dominant_classification(spark, sf):
    return W.dominant_classification(daily_counts(spark, sf))


@query("growth_metrics", "ev valid", COUNTS + ", " + SUMMARY + ", " + GROWTH + " SELECT * FROM gro")
def growth_metrics(spark, sf):
    daily = A.tenant_daily_summary(daily_counts(spark, sf)).select("tenantId", "date", "totalEvents")
    return W.growth(daily).drop("totalEvents").withColumns(r6("dayOnDayGrowthPct", "weekOnWeekGrowthPct"))


@query("growth_on_date", "ev valid", COUNTS + ", " + SUMMARY + ", " + GROWTH + """
SELECT "tenantId", "prevDayEvents", "prevWeekEvents", "dayOnDayGrowthPct", "weekOnWeekGrowthPct" FROM gro WHERE date='2024-01-15'""")
def growth_on_date(spark, sf):
    return (W.growth_on(daily_counts(spark, sf), "2024-01-15").drop("totalEvents")
            .withColumns(r6("dayOnDayGrowthPct", "weekOnWeekGrowthPct")))


@query("tenant_metrics", "ev valid", COUNTS + ", " + LATENCY + ", " + SUMMARY + ", " + DOMINANT + ", " + GROWTH + """
SELECT s."tenantId", s.date, s."totalEvents", round(s."totalPayloadMb", 6) AS "totalPayloadMb", s."totalAnomalies", s."uniqueEventTypes",
  s."activeClassifications", round(s."totalAnomalies"/s."totalEvents", 6) AS "anomalyRate", g."prevDayEvents", g."prevWeekEvents",
  g."dayOnDayGrowthPct", g."weekOnWeekGrowthPct", l."p50LatencyMs", l."p95LatencyMs", l."p99LatencyMs", d."dominantClassification"
FROM summ s JOIN lat l USING ("tenantId", date) JOIN dom d USING ("tenantId", date) JOIN gro g USING ("tenantId", date)""")
def tenant_metrics(spark, sf):
    latency = A.latency_stats(dated(T.valid_events(spark, sf)))
    return W.tenant_metrics(daily_counts(spark, sf), latency).withColumns(
        r6("totalPayloadMb", "anomalyRate", "dayOnDayGrowthPct", "weekOnWeekGrowthPct"))


EWMA = f"""w AS (SELECT "tenantId", "createdAt"//{SIX_HOURS} AS i, count(*) AS n FROM valid
  WHERE classification IN ('CONFIDENTIAL','RESTRICTED') GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY "tenantId" ORDER BY i) AS rn FROM w),
e AS (SELECT "tenantId", i, n, rn, CAST(n AS DOUBLE) AS e, CAST(NULL AS DOUBLE) AS baseline FROM o WHERE rn=1
  UNION ALL SELECT o."tenantId", o.i, o.n, o.rn, 0.3*o.n + pow(0.7, o.i-e.i)*e.e, pow(0.7, o.i-1-e.i)*e.e
  FROM e JOIN o ON o."tenantId"=e."tenantId" AND o.rn=e.rn+1),
b AS (SELECT *, round(baseline, 9) AS rb, CASE WHEN round(baseline, 9)>=1 THEN least(round(n/(round(baseline, 9)*3.0), 9), 1.0) ELSE 0.0 END AS s FROM e)"""


JOINED = COUNTS + ", " + LATENCY + ", " + SUMMARY + ", " + DOMINANT + ", " + GROWTH


@query("join_latency", "ev valid", JOINED + """
SELECT s."tenantId", s.date, s."totalEvents", l."p50LatencyMs", l."p95LatencyMs", l."p99LatencyMs" FROM summ s LEFT JOIN lat l USING ("tenantId", date)""")
def join_latency(spark, sf):
    return tenant_metrics(spark, sf).select("tenantId", "date", "totalEvents", "p50LatencyMs", "p95LatencyMs", "p99LatencyMs")


@query("join_dominant", "ev valid", JOINED + """
SELECT s."tenantId", s.date, s."totalEvents", d."dominantClassification" FROM summ s LEFT JOIN dom d USING ("tenantId", date)""")
def join_dominant(spark, sf):
    return tenant_metrics(spark, sf).select("tenantId", "date", "totalEvents", "dominantClassification")


@query("join_growth", "ev valid", JOINED + """
SELECT s."tenantId", s.date, s."totalEvents", g."prevDayEvents", g."prevWeekEvents" FROM summ s LEFT JOIN gro g USING ("tenantId", date)""")
def join_growth(spark, sf):
    return tenant_metrics(spark, sf).select("tenantId", "date", "totalEvents", "prevDayEvents", "prevWeekEvents")


@query("anomaly_forward", "ev valid", EWMA + ", " + ORDINAL + """
SELECT o2.id, o2."tenantId", round(least(o2.n/(b.rb*3.0), 1.0), 6) AS "anomalyScore"
FROM ord o2 JOIN b ON o2."tenantId"=b."tenantId" AND o2."createdAt"//21600000=b.i WHERE b.rb>=1 AND round(o2.n/(b.rb*3.0), 9)>=0.8""", recursive=True)
def anomaly_forward(spark, sf):
    scored = N.score_events(T.valid_events(spark, sf), SIX_HOURS, id_col="seq")
    return N.anomalies(scored).select("id", "tenantId", F.round("anomalyScore", 6).alias("anomalyScore"))


@query("running_tenant_count", "ev valid", ORDINAL + """
SELECT id, "tenantId", n AS "windowedEventCount" FROM ord""")
def running_tenant_count(spark, sf):
    return N.running_tenant_count(T.valid_events(spark, sf), SIX_HOURS, "seq").select("id", "tenantId", "windowedEventCount")


@query("ewma_baseline", "ev valid", EWMA + f"""
SELECT "tenantId", i*{SIX_HOURS} AS "windowStart", n, round(baseline, 6) AS baseline, round(s, 6) AS "anomalyScore",
  s>=0.8 AS "anomalyDetected" FROM b""", recursive=True)
def ewma_baseline(spark, sf):
    return N.window_scores(T.valid_events(spark, sf), SIX_HOURS).withColumns(r6("baseline", "anomalyScore"))


@query("ewma_anomaly", "ev valid", EWMA + ", " + ORDINAL + f""", sc AS (
SELECT o2.id, o2."tenantId", o2.n AS "windowedEventCount", b.baseline,
  CASE WHEN b.rb>=1 THEN least(round(o2.n/(b.rb*3.0), 9), 1.0) ELSE 0.0 END AS s
FROM ord o2 JOIN b ON o2."tenantId"=b."tenantId" AND o2."createdAt"//{SIX_HOURS}=b.i)
SELECT id, "tenantId", "windowedEventCount", round(baseline, 6) AS baseline, round(s, 6) AS "anomalyScore", s>=0.8 AS "anomalyDetected" FROM sc""",
       recursive=True)
def ewma_anomaly(spark, sf):
    return (N.score_events(T.valid_events(spark, sf), SIX_HOURS, id_col="seq")
            .select("id", "tenantId", "windowedEventCount", "baseline", "anomalyScore", "anomalyDetected")
            .withColumns(r6("baseline", "anomalyScore")))


@query("failed_login_streak", "logins", """
g AS (SELECT *, count(*) FILTER (WHERE NOT failed) OVER (PARTITION BY username ORDER BY at_ms, seq) AS island FROM logins),
f AS (SELECT *, row_number() OVER (PARTITION BY username, island ORDER BY at_ms, seq) AS streak FROM g WHERE failed)
SELECT username, count(*) AS failures, min(at_ms) AS "firstAt", max(at_ms) AS "lastAt", min(at_ms) FILTER (WHERE streak>=5) AS "lockedAt",
  max(at_ms)+900000 AS "lockedUntil" FROM f GROUP BY username, island HAVING max(streak)>=5""")
def failed_login_streak(spark, sf):
    return W.failed_login_streaks(T.logins(spark, sf))


@query("degraded_intervals", "probes", """
p AS (SELECT *, NOT reachable OR "errorRatePercent">5 OR "latencyMs">5000 AS bad FROM probes),
g AS (SELECT *, count(*) FILTER (WHERE NOT bad) OVER (PARTITION BY "cloudProvider" ORDER BY "checkedAt", seq) AS island FROM p)
SELECT "cloudProvider", min("checkedAt") AS "startAt", max("checkedAt") AS "endAt", count(*) AS samples FROM g WHERE bad
GROUP BY "cloudProvider", island HAVING max("checkedAt")-min("checkedAt")>=60000""")
def degraded_intervals(spark, sf):
    return W.degraded_intervals(T.probes(spark, sf))


# ---- figures that merge ------------------------------------------------------------------------

WITHIN = 0.015


@query("latency_sketches", "ev valid", """
SELECT 'day' AS span, "tenantId", date AS start, count(*) AS "sampleCount", max("enrichmentLatencyMs") AS "maxLatencyMs", true AS within FROM valid GROUP BY ALL
UNION ALL SELECT 'week', "tenantId", strftime(date_trunc('week', CAST(date AS DATE)), '%Y-%m-%d') AS start, count(*), max("enrichmentLatencyMs"), true FROM valid GROUP BY ALL
UNION ALL SELECT 'all', "tenantId", '', count(*), max("enrichmentLatencyMs"), true FROM valid GROUP BY ALL""")
def latency_sketches(spark, sf):
    """Percentiles of days, weeks and the whole time from hourly sketches; ``within`` says that their true ranks are near."""
    week = F.date_format(F.date_trunc("week", F.col("date").cast("date")), "yyyy-MM-dd")
    events = dated(T.valid_events(spark, sf))
    hourly = RU.latency_sketches(events)
    out = None
    for name, start in (("day", F.col("date")), ("week", week), ("all", F.lit(""))):
        keys = ["tenantId", "start"]
        stats = RU.latency_stats_of(hourly.withColumn("start", start), tuple(keys))
        ranked = events.withColumn("start", start).join(stats, keys).groupBy(*keys, "sampleCount", "maxLatencyMs")
        near = F.lit(True)
        aggs = []
        for q, c in ((0.50, "p50LatencyMs"), (0.95, "p95LatencyMs"), (0.99, "p99LatencyMs")):
            share = lambda cond: E.count_if(cond) / F.first("sampleCount")
            aggs.append((share(F.col("enrichmentLatencyMs") < F.col(c)) <= q + WITHIN) & (share(F.col("enrichmentLatencyMs") <= F.col(c)) >= q - WITHIN))
        for a in aggs:
            near = near & a
        part = ranked.agg(near.alias("within")).select(F.lit(name).alias("span"), *keys, "sampleCount", "maxLatencyMs", "within")
        out = part if out is None else out.unionByName(part)
    return out


@query("distinct_types_ranges", "ev valid", """
SELECT "tenantId", date AS start, 'day' AS span, count(DISTINCT "eventType") AS "distinctNames" FROM valid GROUP BY ALL
UNION ALL SELECT "tenantId", strftime(date_trunc('month', CAST(date AS DATE)), '%Y-%m-%d'), 'month', count(DISTINCT "eventType") FROM valid GROUP BY ALL
UNION ALL SELECT "tenantId", '', 'all', count(DISTINCT "eventType") FROM valid GROUP BY ALL""")
def distinct_types_ranges(spark, sf):
    """Exact distinct event types of days, months and the whole time, from daily bitmaps over a dictionary."""
    counts = daily_counts(spark, sf).withColumn("date", F.col("date").cast("string"))
    empty = spark.createDataFrame([], "name string, number bigint")
    bitmaps = RU.name_bitmaps(counts, RU.extended_dictionary(empty, counts, "eventType"), "eventType")
    month = F.date_format(F.date_trunc("month", F.col("date").cast("date")), "yyyy-MM-dd")
    parts = [RU.distinct_names(bitmaps.withColumn("start", start), ("tenantId", "start")).select(
        "tenantId", "start", F.lit(name).alias("span"), "distinctNames") for name, start in (("day", F.col("date")), ("month", month), ("all", F.lit("")))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
