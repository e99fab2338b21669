"""Filters, predicates and routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import schema as S
from tidemark.functions import events as E
from tidemark.operators.skew import lookup_join

DAY_MS = 86_400_000
# Access-log rules.
QUIET_URIS = "^/actuator/(health|info)$"
SLOW_REQUEST_MS = 2000
# Health thresholds.
MAX_ERROR_PERCENT = 5.0
MAX_LATENCY_MS = 5000


def route(poison: Column, cls: str = "classification") -> Column:
    """Where a raw record goes, decided once per row instead of once per branch."""
    return (F.when(poison, "POISON_DLQ").when(E.is_fast(cls), "FAST")
            .when(E.is_enriched(cls), "ENRICHMENT").otherwise("UNKNOWN_DLQ"))


def archive_eligible(df: DataFrame, cutoff: str, classification: str = "ALL") -> DataFrame:
    """Events old enough for cold storage, measured back from ``cutoff`` per classification."""
    day, end = E.utc_date("createdAt"), F.lit(cutoff).cast("date")
    age = E.by_class(S.ARCHIVE_AFTER_DAYS, "classification")
    kept = df.where((F.col("createdAt") < F.unix_millis(end.cast("timestamp")))
                    & (day < F.date_sub(end, age)))
    return kept if classification == "ALL" else kept.where(F.col("classification") == classification)


def by_tenant_status(df: DataFrame, tenant: str, *statuses: str) -> DataFrame:
    return df.where((F.col("tenantId") == tenant) & F.col("status").isin(*statuses))


def by_id_tenant_safe(df: DataFrame, requests: DataFrame) -> DataFrame:
    """Rows asked for by (id, tenantId); a row of another tenant is not found."""
    return df.join(requests.select("id", "tenantId").distinct(), ["id", "tenantId"], "left_semi")


def stale_processing(df: DataFrame, now_ms: int, minutes: int = 30, limit: int | None = None) -> DataFrame:
    stale = df.where((F.col("status") == "PROCESSING")
                     & (F.col("updatedAt") < now_ms - minutes * 60_000))
    if limit is None:
        return stale
    return stale.orderBy("updatedAt", "id").limit(limit)


def dlq_due(df: DataFrame, now_ms: int) -> DataFrame:
    return df.where((F.col("status") == "PENDING_RETRY") & (F.col("nextRetryAt") < now_ms))


def effective_grants(claims: DataFrame) -> DataFrame:
    """Claims with a known classification; unknown names are skipped."""
    return claims.where(F.col("classification").isin(S.CLASSIFICATIONS))


def visible_to(df: DataFrame, grants: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows whose (tenant, classification) some grant covers, however large one tenant is."""
    keys = ["tenantId", "classification"]
    return lookup_join(df, effective_grants(grants).select(*keys).distinct(), keys, [id_col], "left_semi").select(*df.columns)


def access_log_clean(df: DataFrame) -> DataFrame:
    """Access log without health polling, with the slow requests flagged."""
    return (df.where(~F.col("uri").rlike(QUIET_URIS))
            .withColumn("slow", F.col("durationMs") > SLOW_REQUEST_MS)
            .withColumn("contentType", F.coalesce("contentType", F.lit("unknown"))))


def retention_candidates(df: DataFrame, now_ms: int, batch_size: int | None = None) -> DataFrame:
    """Rows past their retention: ``purgeDb`` and ``expireObject``, with the audit duty.

    A negative limit means never.  ``batch_size`` keeps the oldest rows of one purge run.
    """
    age = F.floor((F.lit(now_ms) - F.col("createdAt")) / F.lit(DAY_MS))
    db = E.by_class(S.DB_RETENTION_DAYS, "classification")
    obj = E.by_class(S.OBJECT_STORE_DAYS, "classification")
    due = (df.withColumns({
        "ageDays": age,
        "purgeDb": (db >= 0) & (age > db),
        "expireObject": (obj >= 0) & (age > obj),
        "auditDeletion": E.by_class(S.PURGE_AUDITED, "classification"),
    }).where(F.col("purgeDb") | F.col("expireObject")))
    return due if batch_size is None else due.orderBy("createdAt", "id").limit(batch_size)


def active_users(df: DataFrame, now_ms: int) -> DataFrame:
    return df.where(F.col("enabled") & (F.col("lockedUntil").isNull() | (F.col("lockedUntil") < now_ms)))


def is_degraded() -> Column:
    return (~F.col("reachable") | (F.col("errorRatePercent") > MAX_ERROR_PERCENT)
            | (F.col("latencyMs") > MAX_LATENCY_MS))


def service_accounts_by_role(users: DataFrame, roles: DataFrame, role: str | None = None) -> DataFrame:
    """Service accounts with a role; with all their roles when none is named."""
    wanted = roles if role is None else roles.where(F.col("role") == role)
    return users.where("serviceAccount").join(wanted, "username")


def disable_tenant(users: DataFrame, tenant: str) -> DataFrame:
    return users.withColumn("enabled", F.col("enabled") & (F.col("tenantId") != tenant))
