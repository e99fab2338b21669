"""Record layouts and fixed values of the data model."""

from __future__ import annotations

# ---- fixed values: enumerations of the data model -------------------------------------------
CLASSIFICATIONS = ["PUBLIC", "INTERNAL", "CONFIDENTIAL", "RESTRICTED"]
FAST_CLASSES = ["PUBLIC", "INTERNAL"]
ENRICHED_CLASSES = ["CONFIDENTIAL", "RESTRICTED"]
STREAM_STATUSES = ["RECEIVED", "VALIDATING", "ENCRYPTING", "ENCRYPTED", "PUBLISHED", "FAILED", "ARCHIVED"]
LIFECYCLE_STATUSES = ["PENDING", "PROCESSING", "PROCESSED", "FAILED", "DEAD_LETTERED"]
TERMINAL_STATUSES = ["PROCESSED", "DEAD_LETTERED"]
ALLOWED_TRANSITIONS = ["PENDING>PROCESSING", "PROCESSING>PROCESSED", "PROCESSING>FAILED",
                       "FAILED>PROCESSING", "FAILED>DEAD_LETTERED"]
SYNC_STATUSES = ["PENDING", "IN_PROGRESS", "SYNCED", "CONFLICT_DETECTED", "CONFLICT_RESOLVED", "FAILED"]
DLQ_STATUSES = ["PENDING_RETRY", "IN_RETRY", "CONFLICT_REVIEW", "EXHAUSTED", "RESOLVED"]
STRATEGIES = ["LAST_WRITE_WINS", "HIGHEST_VECTOR_CLOCK", "CLOUD_PRIORITY", "FIELD_MERGE", "MANUAL_REVIEW"]
ROLES = ["ADMIN", "DATA_INGEST", "DATA_QUERY", "KEY_MANAGER", "PLATFORM_OPS", "SERVICE_ACCOUNT"]

# ---- fixed values: per-classification rules --------------------------------------------------
ROTATION_DAYS = {"PUBLIC": 365, "INTERNAL": 365, "CONFIDENTIAL": 90, "RESTRICTED": 30}
ARCHIVE_AFTER_DAYS = {"PUBLIC": 30, "INTERNAL": 90, "CONFIDENTIAL": 180, "RESTRICTED": 365}
OBJECT_STORE_DAYS = {"PUBLIC": 365, "INTERNAL": 730, "CONFIDENTIAL": 1825, "RESTRICTED": 2555}
DB_RETENTION_DAYS = {"PUBLIC": -1, "INTERNAL": 365, "CONFIDENTIAL": 730, "RESTRICTED": 1825}  # -1: never
PURGE_AUDITED = {"PUBLIC": False, "INTERNAL": False, "CONFIDENTIAL": True, "RESTRICTED": True}

# ---- fixed values: default conflict strategy per aggregate type ------------------------------
DEFAULT_STRATEGIES = {"TENANT_CONFIG": "CLOUD_PRIORITY", "AUDIT_RECORD": "LAST_WRITE_WINS",
                      "RESTRICTED_DATA": "MANUAL_REVIEW"}

# ---- fixed values: wire and table layouts, as DDL --------------------------------------------
DATA_EVENT = (
    "id STRING NOT NULL, tenantId STRING NOT NULL, sourceSystem STRING NOT NULL, "
    "eventType STRING NOT NULL, classification STRING NOT NULL, status STRING NOT NULL, "
    "schemaVersion STRING, idempotencyKey STRING, metadata MAP<STRING, STRING>, "
    "payloadSizeBytes INT, createdAt BIGINT NOT NULL")

ENRICHED_EVENT = (
    "id STRING NOT NULL, tenantId STRING NOT NULL, sourceSystem STRING NOT NULL, "
    "eventType STRING NOT NULL, classification STRING NOT NULL, status STRING NOT NULL, "
    "schemaVersion STRING, idempotencyKey STRING NOT NULL, payloadSizeBytes INT, "
    "createdAt BIGINT NOT NULL, enrichedAt BIGINT NOT NULL, processorId STRING, "
    "windowedEventCount BIGINT, anomalyScore DOUBLE, anomalyDetected BOOLEAN, "
    "enrichmentLatencyMs BIGINT, processingPath STRING")

WINDOWED_AGGREGATION = (
    "tenantId STRING NOT NULL, windowStart BIGINT NOT NULL, windowEnd BIGINT NOT NULL, "
    "windowDurationMs BIGINT NOT NULL, totalEventCount BIGINT NOT NULL, "
    "countByClassification MAP<STRING, BIGINT>, countByEventType MAP<STRING, BIGINT>, "
    "totalPayloadBytes BIGINT, anomalyCount BIGINT, dlqCount BIGINT, "
    "p50LatencyMs BIGINT, p99LatencyMs BIGINT, computedAt BIGINT")

SYNC_RECORD = (
    "id STRING, tenantId STRING, aggregateType STRING, aggregateId STRING, sourceCloud STRING, "
    "payload BINARY, encryptionKeyVersion STRING, vectorClock MAP<STRING, BIGINT>, "
    "wallClockTs BIGINT, schemaVersion INT, syncStatus STRING, createdAt BIGINT, "
    "lastSyncedAt BIGINT, metadata MAP<STRING, STRING>")

CHANGE_ENVELOPE = ("before STRING, after STRING, op STRING, ts_ms BIGINT, "
                   "source STRUCT<table: STRING, lsn: BIGINT>")
