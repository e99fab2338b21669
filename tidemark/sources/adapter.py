"""Canonical views over the benchmark tables.

The benchmark ships plain ``events``, ``orders`` and ``customer`` tables.  Each view below is a
narrow projection of one table into a canonical layout, so column pruning and filters reach the
parquet scan.  The SQL twins are in ``tidemark.plans.views``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schema as S
from tidemark.functions import events as E
from tidemark.session import use_utc

# Evaluation instant of all time-dependent queries: 2024-01-31T00:00:00Z.
NOW_MS = 1_706_659_200_000


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A benchmark table with the schema its files have now."""
    return use_utc(spark).read.parquet(f"{sf}/{name}.parquet")


def _millis(col: str) -> Column:
    return F.unix_millis(F.col(col).cast("timestamp"))


def _str(col) -> Column:
    return col.cast("string")


def pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def tenant(col: Column) -> Column:
    return F.concat(F.lit("tenant-"), _str(col % 8))


EVENT_COLUMNS = [
    "cast(event_id AS string) AS id", "event_id AS seq", "user_id AS userId",
    "concat('tenant-', cast(user_id % 8 AS string)) AS tenantId",
    "concat('sys-', cast(event_id % 3 AS string)) AS sourceSystem", "event_type AS eventType",
    "CASE WHEN event_id % 101 = 100 THEN 'UNKNOWN' WHEN event_id % 10 < 4 THEN 'PUBLIC' "
    "WHEN event_id % 10 < 7 THEN 'INTERNAL' WHEN event_id % 10 < 9 THEN 'CONFIDENTIAL' "
    "ELSE 'RESTRICTED' END AS classification",
    "'RECEIVED' AS status", "if(event_id % 5 = 0, '1.1', '1.0') AS schemaVersion",
    "concat('k-', cast(if(event_id % 10 = 9, event_id - 1, event_id) AS string)) AS idempotencyKey",
    "from_json(props, 'map<string,string>') AS metadata",
    "cast(64 + event_id % 997 AS int) AS payloadSizeBytes",
    "unix_millis(cast(ts AS timestamp)) AS createdAt",
    "unix_millis(cast(ts AS timestamp)) + event_id * 37 % 500 AS enrichedAt",
    "event_id * 37 % 500 AS enrichmentLatencyMs", "event_id % 47 = 46 AS isPoison",
    "value > 150 AS anomalyDetected", "value", "props",
]


def event_columns(events: DataFrame) -> DataFrame:
    """Events in the canonical record layout; works on batch and streaming input."""
    return events.selectExpr(*EVENT_COLUMNS)


def data_events(spark: SparkSession, sf: str) -> DataFrame:
    return event_columns(table(spark, sf, "events"))


def valid_events(spark: SparkSession, sf: str) -> DataFrame:
    """Records with a value and a known classification: what both enrichment paths emit."""
    ev = data_events(spark, sf)
    return ev.where(~F.col("isPoison") & F.col("classification").isin(S.CLASSIFICATIONS))


def enriched_events(spark: SparkSession, sf: str) -> DataFrame:
    return valid_events(spark, sf).withColumn(
        "processingPath", E.processing_path("classification"))


def lifecycle_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The event table of the write side, one row per event."""
    ev = data_events(spark, sf)
    e = F.col("seq")
    encrypted = F.col("classification").isin(S.ENRICHED_CLASSES)
    return ev.select(
        "id", "seq", "tenantId", F.col("eventType").alias("schemaName"),
        (e % 3 + 1).cast("int").alias("schemaVersion"), "classification",
        pick(S.LIFECYCLE_STATUSES, e * 7 % 5).alias("status"), "createdAt",
        (F.col("createdAt") + (e % 90) * 60000).alias("updatedAt"),
        F.when(F.col("classification") != "RESTRICTED", F.col("props")).alias("rawPayload"),
        F.when(encrypted, F.concat(F.lit("enc:"), F.col("props"))).alias("encryptedPayload"),
        F.when(encrypted, F.concat(F.lit("v"), _str(e % 4))).alias("encryptionKeyVersion"),
        (e % 4).cast("int").alias("retryCount"), "idempotencyKey")


def status_history(spark: SparkSession, sf: str) -> DataFrame:
    """Status changes of one entity per five consecutive events."""
    ev = data_events(spark, sf)
    e = F.col("seq")
    return ev.select(
        F.concat(F.lit("e-"), _str(F.floor(e / 5))).alias("id"), "seq", "tenantId",
        pick(S.LIFECYCLE_STATUSES, F.floor(e * 7 / 11) % 5).alias("status"),
        F.col("createdAt").alias("changedAt"))


def ingest_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Write requests, some of which break a validation rule."""
    ev = data_events(spark, sf)
    e = F.col("seq")
    raw = F.when((F.col("classification") == "RESTRICTED") & (e % 3 == 0), F.col("props"))
    return ev.select(
        "id", "seq",
        F.when(e % 211 == 0, " ").when(e % 223 == 0, "tenant 3!").otherwise(F.col("tenantId"))
        .alias("tenantId"),
        F.when(e % 227 == 0, "").otherwise(F.col("sourceSystem")).alias("sourceSystem"),
        F.when(e % 233 == 0, F.repeat(F.col("eventType"), 60)).when(e % 251 == 0, F.lit(None))
        .otherwise(F.col("eventType")).alias("schemaName"),
        F.when(e % 229 == 0, 0).otherwise(1).alias("schemaVersion"),
        F.when(e % 257 == 0, F.lit(None)).otherwise(F.col("classification")).alias("classification"),
        F.when(e % 239 == 0, F.repeat(F.lit("k"), 300)).otherwise(F.col("idempotencyKey"))
        .alias("idempotencyKey"),
        F.when(e % 241 == 0, F.map_from_arrays(
            F.transform(F.sequence(F.lit(1), F.lit(65)), _str),
            F.transform(F.sequence(F.lit(1), F.lit(65)), _str)))
        .otherwise(F.col("metadata")).alias("metadata"),
        raw.alias("rawPayload"), F.when(e % 263 == 0, "PROCESSING").otherwise(F.col("status")).alias("status"))


def topic_records(spark: SparkSession, sf: str) -> DataFrame:
    """Bus records with failure headers; a poison record has a null value."""
    ev = data_events(spark, sf)
    e = F.col("seq")
    errors = ["org.apache.kafka.common.errors.SerializationException",
              "org.apache.avro.SchemaParseException", "org.apache.avro.AvroTypeException",
              "java.lang.NullPointerException", "java.io.IOException"]
    header = lambda k, v: F.struct(F.lit(k).alias("key"), F.encode(v, "UTF-8").alias("value"))
    headers = F.when(e % 6 == 5, F.array().cast("array<struct<key:string,value:binary>>")).otherwise(
        F.array(header("kafka_dlt-exception-fqcn", pick(errors, e % 5)),
                header("kafka_dlt-original-topic", F.concat(F.lit("topic-"), _str(e % 4))),
                header("kafka_dlt-original-offset", _str(e))))
    return ev.select(
        F.col("tenantId").alias("key"), F.when(~F.col("isPoison"), F.col("props")).alias("value"),
        (e % 12).cast("int").alias("partition"), e.alias("offset"), headers.alias("headers"),
        F.col("createdAt").alias("timestamp"))


def _payload(side: str) -> Column:
    k = F.col("o_orderkey")
    status = F.col("o_orderstatus") if side == "aws" else F.when(
        k % 12 == 0, "Z").otherwise(F.col("o_orderstatus"))
    note = F.when(k % 6 == 0, F.concat(F.lit(f',"{side}_note":"n'), _str(k % 7), F.lit('"'))).otherwise("")
    text = F.concat(F.lit('{"status":"'), status, F.lit('","priority":"'), F.col("o_orderpriority"),
                    F.lit('"'), note, F.lit("}"))
    return F.when(k % 66 == 0, F.concat(F.lit(f"[{len(side)},"), _str(k % 9), F.lit("]"))).otherwise(text)


def sync_copy(spark: SparkSession, sf: str, cloud: str) -> DataFrame:
    """One of the two replicated copies of the orders."""
    k = F.col("o_orderkey")
    types = ["TENANT_CONFIG", "AUDIT_RECORD", "RESTRICTED_DATA", "ORDER", "PROFILE"]
    if cloud == "aws":
        missing, step = 7, (k % 5) * 1000
        clock = [1 + k % 3 + F.when((k % 4).isin(2, 3), 1).otherwise(0), k % 2]
    else:
        missing, step = 3, (k % 3) * 1000
        clock = [1 + k % 3, k % 2 + F.when((k % 4).isin(1, 3), 1).otherwise(0)]
    return table(spark, sf, "orders").where(k % 10 != missing).select(
        F.concat(F.lit(f"{cloud}-"), _str(k)).alias("id"), tenant(F.col("o_custkey")).alias("tenantId"),
        pick(types, F.floor(k / 20) % 5).alias("aggregateType"), _str(k).alias("aggregateId"),
        F.lit(cloud).alias("sourceCloud"), F.encode(_payload(cloud), "UTF-8").alias("payload"),
        F.create_map(F.lit("aws"), clock[0].cast("bigint"), F.lit("azure"), clock[1].cast("bigint"))
        .alias("vectorClock"),
        (_millis("o_orderdate") + step).alias("wallClockTs"), F.lit(1).alias("schemaVersion"),
        F.lit("PENDING").alias("syncStatus"), _millis("o_orderdate").alias("createdAt"))


def versions(spark: SparkSession, sf: str) -> DataFrame:
    """Many versions per aggregate: every order is a version of its customer's record."""
    k = F.col("o_orderkey")
    node = lambda n, v: F.struct(F.lit(n).alias("key"), v.cast("bigint").alias("value"))
    clock = F.map_from_entries(F.concat(
        F.array(node("aws", k % 4), node("azure", F.floor(k / 4) % 3)),
        F.when(k % 5 == 0, F.array(node("gcp", k % 2 + 1)))
        .otherwise(F.array().cast("array<struct<key:string,value:bigint>>"))))
    return table(spark, sf, "orders").select(
        _str(k).alias("id"), k.alias("seq"), tenant(F.col("o_custkey")).alias("tenantId"),
        _str(F.col("o_custkey")).alias("aggregateId"), pick(["aws", "azure", "gcp"], k % 3).alias("sourceCloud"),
        clock.alias("vectorClock"),
        (_millis("o_orderdate") + (k % 5) * 1000).alias("wallClockTs"), F.lit("PENDING").alias("syncStatus"))


def dlq_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Dead-letter table: every order is one failed replication."""
    k = F.col("o_orderkey")
    created = F.lit(NOW_MS) - (k % 5000) * 60000
    return table(spark, sf, "orders").select(
        k.alias("seq"), F.concat(F.lit("d-"), _str(k)).alias("id"),
        tenant(F.col("o_custkey")).alias("tenantId"), _str(k).alias("aggregateId"),
        pick(["aws", "azure"], k % 2).alias("targetCloud"),
        pick(S.DLQ_STATUSES, k * 3 % 5).alias("status"), (F.floor(k / 5) % 5).cast("int").alias("retryCount"),
        F.when(k % 5 != 4, created + (k % 7000) * 60000).alias("nextRetryAt"), created.alias("createdAt"),
        (k % 3 == 0).alias("succeeded"),
        F.repeat(F.concat(F.lit("timeout "), F.col("o_orderpriority"), F.lit("; ")), 90).alias("errorText"))


def users(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        k.alias("seq"), F.col("c_name").alias("username"), tenant(k).alias("tenantId"),
        (k % 9 != 0).alias("enabled"), (k % 4 == 0).alias("serviceAccount"),
        F.when(k % 11 == 0, F.lit(NOW_MS) + (k % 5 - 2) * 3600000).alias("lockedUntil"))


def user_roles(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        F.col("c_name").alias("username"),
        F.explode(F.array_distinct(F.array(pick(S.ROLES, k % 6), pick(S.ROLES, F.floor(k / 6) % 6)))).alias("role"))


def user_grants(spark: SparkSession, sf: str) -> DataFrame:
    """Classification claims per user, one of them with an unknown name."""
    k = F.col("c_custkey")
    names = ["PUBLIC", "INTERNAL", "CONFIDENTIAL", "RESTRICTED", "SECRET"]
    return table(spark, sf, "customer").select(
        F.col("c_name").alias("username"), tenant(k).alias("tenantId"),
        F.explode(F.array_distinct(F.array(pick(names, k % 5), pick(names, F.floor(k / 8) % 2))))
        .alias("classification"))


def key_rotations(spark: SparkSession, sf: str) -> DataFrame:
    """Key rotation events: every signup rotates its tenant's key for one classification."""
    ev = data_events(spark, sf).where(
        (F.col("eventType") == "signup") & F.col("classification").isin(S.CLASSIFICATIONS))
    return ev.select(F.concat(F.lit("kv-"), F.col("id")).alias("keyVersion"), "seq", "tenantId",
                     "classification", pick(["AWS", "AZURE"], F.col("seq") % 2).alias("cloudProvider"),
                     "createdAt")


def logins(spark: SparkSession, sf: str) -> DataFrame:
    """Login attempts: an error event is a failure, a click a success."""
    ev = data_events(spark, sf).where(F.col("eventType").isin("error", "click"))
    return ev.select(F.concat(F.lit("user-"), _str(F.col("userId"))).alias("username"), "seq",
                     F.col("createdAt").alias("at"), (F.col("eventType") == "error").alias("failed"))


def audit_events(spark: SparkSession, sf: str) -> DataFrame:
    types = ["LOGIN_SUCCESS", "LOGIN_FAILURE", "KEY_ROTATION_COMPLETED", "RESTRICTED_DATA_ACCESS",
             "DR_CONSISTENCY_CHECK", "ADMIN_ACTION", "AUTHORIZATION_FAILURE"]
    ev = data_events(spark, sf)
    e = F.col("seq")
    return ev.select(
        pick(types, e % 7).alias("eventType"),
        F.when(F.col("eventType") == "error", "FAILURE").when(e % 13 == 0, "PARTIAL")
        .otherwise("SUCCESS").alias("outcome"),
        F.when(e % 17 == 0, "SYSTEM").otherwise(F.concat(F.lit("user-"), _str(F.col("userId")))).alias("actor"),
        "tenantId", F.when(e % 4 == 0, " ").when(e % 4 != 1, F.concat(F.lit("r-"), _str(e % 50))).alias("requestId"),
        F.concat(F.lit("ctx-"), _str(e % 3)).alias("contextRequestId"), F.col("createdAt").alias("timestamp"))


def probes(spark: SparkSession, sf: str) -> DataFrame:
    """Health probes of two clouds."""
    ev = data_events(spark, sf)
    e = F.col("seq")
    return ev.select(
        pick(["aws", "azure"], e % 2).alias("cloudProvider"), "seq", (e % 29 != 0).alias("reachable"),
        F.floor(F.col("value") * 60).alias("latencyMs"), (e % 13).cast("double").alias("errorRatePercent"),
        F.col("createdAt").alias("checkedAt"))


def gauge_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Gauge samples of the five alert metrics, four series each."""
    ev = data_events(spark, sf)
    e, step = F.col("seq"), F.floor(F.col("seq") / 5)
    metric = pick(["dr_state", "replication_lag_seconds", "dlq_exhausted_total",
                   "circuitbreaker_open", "consumer_group_lag"], e % 5)
    value = (F.when(e % 5 == 0, (step % 4).cast("double"))
             .when(e % 5 == 1, F.col("value") * 5)
             .when(e % 5 == 2, (step % 3).cast("double"))
             .when(e % 5 == 3, F.when(step % 6 < 4, 1.0).otherwise(0.0))
             .otherwise(F.col("value") * 300))
    return ev.select(metric.alias("metric"), F.concat(F.lit("s-"), _str(F.col("userId") % 4)).alias("series"),
                     "seq", F.col("createdAt").alias("ts"), value.alias("value"))


def counter_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Monotone counters of four series that restart at every thousandth event."""
    ev = data_events(spark, sf)
    e = F.col("seq")
    return ev.select(F.concat(F.lit("step-"), _str(e % 4)).alias("series"), "seq",
                     F.col("createdAt").alias("ts"),
                     (F.floor(e % 1000 / 4) * 3 + F.floor(e % 1000 / 40)).cast("double").alias("value"))


def http_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Access-log rows."""
    ev = data_events(spark, sf)
    e = F.col("seq")
    uri = pick(["/actuator/health", "/actuator/info", "/api/v1/events", "/api/v1/keys", "/actuator/healthz"], e % 5)
    return ev.select(
        "seq", "tenantId", uri.alias("uri"), pick(["GET", "POST", "PUT"], e % 3).alias("method"),
        F.when(F.col("eventType") == "error", F.when(e % 2 == 0, 500).otherwise(404)).otherwise(200).alias("status"),
        F.floor(F.col("value") * 20).alias("durationMs"),
        F.when(e % 3 != 0, "application/json").alias("contentType"), F.col("createdAt").alias("ts"))


def spans(spark: SparkSession, sf: str) -> DataFrame:
    """Trace spans, four per trace."""
    ev = data_events(spark, sf)
    e, trace = F.col("seq"), F.floor(F.col("seq") / 4)
    start = trace * 100000 + (e % 4) * 50
    attributes = F.map_from_entries(F.filter(F.array(
        F.struct(F.lit("http.route").alias("key"),
                 pick(["/health", "/metrics", "/api/v1/events", "/api/v1/keys", "/api/v1/dr"], e % 5).alias("value")),
        F.when(e % 7 == 0, F.struct(F.lit("service.namespace").alias("key"), F.lit("legacy").alias("value"))),
        F.when(e % 3 == 0, F.struct(F.lit("deployment.environment").alias("key"), F.lit("staging").alias("value")))),
        lambda x: x.isNotNull()))
    return ev.select(
        trace.alias("traceId"), F.col("id").alias("spanId"),
        F.when(F.col("eventType") == "error", F.when(e % 4 == 1, "ERROR").otherwise("UNSET")).otherwise("OK").alias("statusCode"),
        start.alias("startMs"), (start + F.floor(F.col("value") * 20)).alias("endMs"),
        attributes.alias("attributes"))
