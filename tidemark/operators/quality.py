"""Validation, lifecycle audits and schema drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import schema as S
from tidemark.functions import events as E
from tidemark.operators import ordered as O

# Limits of the write contract.
TENANT_FORMAT = "^[a-zA-Z0-9_-]{1,128}$"
MAX_SCHEMA_NAME = 256
MAX_IDEMPOTENCY_KEY = 255
MAX_METADATA = 64


def _true(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False))


def rules(columns: list[str]) -> dict[str, Column]:
    """Condition under which each rule is broken; the status is checked where rows have one."""
    cls = F.col("classification")
    status = {"status.unknown": ~F.col("status").isin(S.STREAM_STATUSES)} if "status" in columns else {}
    return {
        "tenantId.blank": E.blank("tenantId"),
        "tenantId.format": ~E.blank("tenantId") & ~F.col("tenantId").rlike(TENANT_FORMAT),
        "schemaName.blank": E.blank("schemaName"),
        "schemaName.size": F.length("schemaName") > MAX_SCHEMA_NAME,
        "schemaVersion.min": F.col("schemaVersion") < 1,
        "classification.missing": cls.isNull(),
        "classification.unknown": ~cls.isin(S.CLASSIFICATIONS),
        "metadata.size": F.size(F.map_keys("metadata")) > MAX_METADATA,
        "idempotencyKey.size": F.length("idempotencyKey") > MAX_IDEMPOTENCY_KEY,
        "sourceSystem.blank": E.blank("sourceSystem"),
        "restricted.rawPayload": (cls == "RESTRICTED") & F.col("rawPayload").isNotNull(),
        **status,
    }


def validate_events(df: DataFrame) -> DataFrame:
    """All broken rules of each row in one pass: ``violations`` array and ``valid`` flag."""
    broken = F.filter(F.array(*[F.when(_true(cond), F.lit(name)) for name, cond in rules(df.columns).items()]),
                      lambda x: x.isNotNull())
    return df.withColumn("violations", broken).withColumn("valid", F.size("violations") == 0)


def status_transitions(history: DataFrame, slice_ms: int | None = None) -> DataFrame:
    """Each status change with its predecessor and whether the lifecycle allows the step.

    A first row has no predecessor and is legal when it is the initial state.
    """
    steps = O.with_previous(history, ["id"], "changedAt", "seq", {"previous": "status"}, slice_ms)
    step = F.concat_ws(">", "previous", "status")
    legal = F.when(F.col("previous").isNull(), F.col("status") == "PENDING").otherwise(
        step.isin(S.ALLOWED_TRANSITIONS))
    return steps.withColumn("legal", legal)


def retry_counts(history: DataFrame, slice_ms: int | None = None) -> DataFrame:
    """Retries per event (FAILED to PROCESSING) and whether it was dead-lettered."""
    steps = status_transitions(history, slice_ms)
    after_failure = F.col("previous") == "FAILED"
    return steps.groupBy("id").agg(
        E.count_if(after_failure & (F.col("status") == "PROCESSING")).alias("retryCount"),
        F.coalesce(F.bool_or(after_failure & (F.col("status") == "DEAD_LETTERED")), F.lit(False)).alias("deadLettered"),
        E.count_if(~F.col("legal")).alias("illegalSteps"))


def schema_drift(df: DataFrame, version: str, required: list[str], known_versions: list) -> DataFrame:
    """Per version: record count, whether it is known, and missing values per required field."""
    return (df.groupBy(version)
            .agg(F.count(F.lit(1)).alias("records"),
                 *[E.count_if(E.blank(c)).alias(f"missing_{c}") for c in required])
            .withColumn("knownVersion", F.col(version).isin(known_versions)))
