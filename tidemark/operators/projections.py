"""Derived columns and projections.  All are narrow: no shuffle, no Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import schema as S
from tidemark.functions import events as E
from tidemark.functions import text as X

ENRICHER_VERSION = "1.0"


def event_time_columns(df: DataFrame) -> DataFrame:
    """Timestamps, calendar date and hour from the epoch-millis columns."""
    return df.withColumns({
        "eventTs": E.ts("createdAt"),
        "eventDate": E.utc_date("createdAt"),
        "ingestionTs": E.ts("enrichedAt"),
        "date": F.date_format(E.ts("createdAt"), "yyyy-MM-dd"),
        "hour": F.hour(E.ts("enrichedAt")),
    })


def fast_path_enrich(df: DataFrame, processor_id: str, enriched_at: Column | None = None) -> DataFrame:
    """Stateless enrichment: the record as it is, with neutral enrichment fields."""
    at = enriched_at if enriched_at is not None else F.unix_millis(F.current_timestamp())
    return df.withColumns({
        "enrichedAt": at,
        "processorId": F.lit(processor_id),
        "windowedEventCount": F.lit(0).cast("bigint"),
        "anomalyScore": F.lit(0.0),
        "anomalyDetected": F.lit(False),
        "enrichmentLatencyMs": F.lit(0).cast("bigint"),
        "processingPath": F.lit("FAST_PATH"),
    })


def metadata_enrich(df: DataFrame, count_col: str = "windowedEventCount") -> DataFrame:
    """Add the enricher's tags to the metadata map; they win over equal keys."""
    tags = F.create_map(
        F.lit("enricher.version"), F.lit(ENRICHER_VERSION),
        F.lit("enricher.path"), E.processing_path("classification"),
        F.lit("enricher.window.count"), F.col(count_col).cast("string"))
    own = F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")),
                       lambda k, _v: ~k.isin("enricher.version", "enricher.path", "enricher.window.count"))
    return df.withColumn("metadata", F.map_concat(own, tags))


def with_processing_path(df: DataFrame) -> DataFrame:
    return df.withColumn("processingPath", E.processing_path("classification"))


def archive_columns(df: DataFrame, location: str, archived_at: Column | None = None) -> DataFrame:
    day = E.utc_date("createdAt")
    return df.withColumns({
        "eventDate": day,
        "year": F.year(day).cast("string"),
        "month": F.lpad(F.month(day).cast("string"), 2, "0"),
        "archivedAt": archived_at if archived_at is not None else F.current_timestamp(),
        "archiveLocation": F.lit(location),
    })


def tenant_key(tenant: Column, key: Column) -> Column:
    return F.concat(F.lit("tenants/"), tenant, F.lit("/"), key)


def raw_object_key(tenant: Column, aggregate: Column, saga: Column) -> Column:
    return F.concat_ws("/", tenant, F.lit("raw"), aggregate, saga)


def enriched_object_key(tenant: Column, date: Column, event_id: Column) -> Column:
    return tenant_key(tenant, F.concat(F.lit("enriched/"), date, F.lit("/"), event_id, F.lit(".json")))


def sync_object_key() -> Column:
    """Versioned key of a replicated record; defaults stand in for absent parts."""
    return F.concat(
        F.concat_ws("/", "tenantId", F.coalesce("aggregateType", F.lit("events")),
                    F.coalesce("aggregateId", "id"), F.col("schemaVersion").cast("string"),
                    F.col("wallClockTs").cast("string")), F.lit(".bin"))


def sync_document_id() -> Column:
    return F.coalesce("aggregateId", "id")


def event_dto(df: DataFrame) -> DataFrame:
    """Public view of a stored event: payloads are reduced to a flag."""
    return df.select(
        "id", "tenantId", "schemaName", "schemaVersion", "classification", "status", "createdAt",
        "updatedAt", "retryCount",
        F.col("status").isin(S.TERMINAL_STATUSES).alias("isTerminal"),
        F.col("encryptedPayload").isNotNull().alias("isEncrypted"))


def created_to_record(df: DataFrame) -> DataFrame:
    """Stream record of a created event: schema name as source, id as idempotency key."""
    return df.select(
        "id", "tenantId", F.col("schemaName").alias("sourceSystem"),
        F.lit("DataEventCreated").alias("eventType"), "classification",
        F.lit("PUBLISHED").alias("status"), F.col("schemaVersion").cast("string").alias("schemaVersion"),
        F.col("id").alias("idempotencyKey"), F.create_map().cast("map<string,string>").alias("metadata"),
        F.lit(0).alias("payloadSizeBytes"), "createdAt")


def ingested_to_record(df: DataFrame, source_system: str) -> DataFrame:
    """Stream record of a stored request: request id as idempotency key, payload length as size."""
    empty = lambda name: F.coalesce(name, F.lit(""))
    return df.select(
        F.col("sagaId").alias("id"), "tenantId", F.lit(source_system).alias("sourceSystem"), "eventType",
        "classification", F.lit("PUBLISHED").alias("status"), F.lit("1.0").alias("schemaVersion"),
        F.col("requestId").alias("idempotencyKey"),
        F.create_map(F.lit("storageKey"), empty("storageObjectKey"),
                     F.lit("encryptionKey"), empty("encryptionKeyId")).alias("metadata"),
        F.coalesce(F.octet_length("encryptedPayload"), F.lit(0)).alias("payloadSizeBytes"), "createdAt")


def class_attributes(df: DataFrame, cls: str = "classification") -> DataFrame:
    """Key-rotation period and protection flags of the row's classification."""
    return df.withColumns({
        "rotationDays": X.rotation_days(cls),
        "requiresCmk": X.needs_cmk(cls),
        "requiresAudit": X.needs_audit(cls),
    })
