"""Dead letters, key versions, change application, outbox and paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import schema as S
from tidemark.functions import events as E
from tidemark.functions import text as X
from tidemark.operators import ordered as O
from tidemark.operators.skew import with_group_totals

# Dead-letter rules.
SCHEMA_ERRORS = ["SerializationException", "SchemaParseException", "AvroTypeException"]
HEADER_EXCEPTION = "kafka_dlt-exception-fqcn"
HEADER_TOPIC = "kafka_dlt-original-topic"
HEADER_OFFSET = "kafka_dlt-original-offset"
MAX_ATTEMPTS = 5
BACKOFF_SECONDS = 30
MAX_BACKOFF_SECONDS = 3600
ERROR_CHARS = 1024
KEY_AGE_DAYS = 90
DAY_MS = 86_400_000
KEY_SLICE_MS = 30 * DAY_MS  # a tenant rotates a class's key a few times a month


def header(name: str, default: str = "unknown") -> Column:
    """Text of the first header with this name."""
    found = F.get(F.filter("headers", lambda h: h["key"] == name), F.lit(0))
    return F.coalesce(F.decode(found["value"], "UTF-8"), F.lit(default))


def dlq_classify(records: DataFrame) -> DataFrame:
    """Why a record was dead-lettered, with its origin."""
    error = F.col("exceptionClass")
    schema_error = F.lit(False)
    for name in SCHEMA_ERRORS:
        schema_error = schema_error | error.contains(name)
    return (records.withColumns({"exceptionClass": header(HEADER_EXCEPTION), "originalTopic": header(HEADER_TOPIC),
                                 "originalOffset": header(HEADER_OFFSET)})
            .withColumn("reason", F.when(F.col("value").isNull(), "POISON_PILL")
                        .when(schema_error, "SCHEMA_MISMATCH").otherwise("PROCESSING_FAILURE")))


def dlq_retry_plan(due: DataFrame, now_ms: int) -> DataFrame:
    """State of each due entry after the attempt whose outcome is in ``succeeded``."""
    failed = ~F.col("succeeded")
    attempts = F.col("_a")
    delay = F.least(F.lit(BACKOFF_SECONDS) * F.expr("shiftleft(1L, _a)"), F.lit(MAX_BACKOFF_SECONDS))
    exhausted = attempts >= MAX_ATTEMPTS
    return (due.withColumn("_a", F.col("retryCount") + 1)
            .withColumns({
                "status": F.when(~failed, "RESOLVED").when(exhausted, "EXHAUSTED").otherwise("PENDING_RETRY"),
                "nextRetryAt": F.when(failed & ~exhausted, F.lit(now_ms) + delay * 1000).otherwise(F.col("nextRetryAt")),
                "retryCount": F.when(failed, attempts).otherwise(F.col("retryCount")),
                "errorMessage": F.when(failed, F.substring("errorText", 1, ERROR_CHARS)),
                "lastAttemptedAt": F.lit(now_ms).cast("bigint"),
            }).drop("_a", "errorText"))


def dlq_bulk_resolve(df: DataFrame, tenant: str, ids: DataFrame | None = None) -> DataFrame:
    """Resolve a tenant's entries, or only those whose id is in ``ids``; ``resolved`` marks them."""
    chosen = F.col("tenantId") == tenant
    if ids is not None:
        listed = ids.select("id").distinct().withColumn("_listed", F.lit(True))
        df = df.join(listed, "id", "left")
        chosen = chosen & F.coalesce("_listed", F.lit(False))
    out = df.withColumn("resolved", chosen)
    out = out.withColumn("status", F.when(F.col("resolved"), "RESOLVED").otherwise(F.col("status")))
    return out.drop("_listed")


def clock_text(clock: str = "vectorClock") -> Column:
    pairs = F.array_sort(F.transform(F.map_entries(clock), lambda e: F.concat(
        e["key"], F.lit("="), e["value"].cast("string"))))
    return F.coalesce(F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}")), F.lit("{}"))


def _b64(payload: str) -> Column:
    return F.regexp_replace(F.base64(payload), "[\r\n]", "")


def failure_entries(records: DataFrame, target: str, error: Column, now_ms: int) -> DataFrame:
    """Dead-letter rows of failed replications; the first retry is due after one backoff."""
    return records.select(
        "tenantId", "aggregateType", "aggregateId", "sourceCloud", F.lit(target).alias("targetCloud"),
        _b64("payload").alias("payloadB64"), clock_text().alias("vectorClockJson"), "wallClockTs", "schemaVersion",
        F.lit("PENDING_RETRY").alias("status"), F.substring(error, 1, ERROR_CHARS).alias("errorMessage"),
        F.lit(0).alias("retryCount"), F.lit(now_ms + BACKOFF_SECONDS * 1000).cast("bigint").alias("nextRetryAt"))


def conflict_entries(pairs: DataFrame, now_ms: int, left: str = "incoming", right: str = "existing") -> DataFrame:
    """Dead-letter rows of conflicts parked for review, with both payloads."""
    flat = pairs.select(f"{left}.*", F.col(f"{right}.sourceCloud").alias("_target"),
                        F.col(f"{right}.payload").alias("_other"))
    rows = flat.select(
        "tenantId", "aggregateType", "aggregateId", "sourceCloud", F.col("_target").alias("targetCloud"),
        _b64("payload").alias("payloadB64"), _b64("_other").alias("competingPayloadB64"),
        clock_text().alias("vectorClockJson"), "wallClockTs", "schemaVersion",
        F.lit("CONFLICT_REVIEW").alias("status"), F.lit("MANUAL_REVIEW").alias("conflictStrategy"),
        F.lit("held until someone decides between the two versions").alias("errorMessage"), F.lit(0).alias("retryCount"),
        F.lit(now_ms).cast("bigint").alias("nextRetryAt"))
    return rows


def key_versions(rotations: DataFrame) -> DataFrame:
    """Validity of every key version: retired by the next rotation of its tenant and class."""
    keys = ["tenantId", "classification"]
    sliced = O.time_slice(rotations, "createdAt", KEY_SLICE_MS)
    nxt = O.with_next(sliced, keys, "createdAt", "seq", {"rotatedAt": "createdAt"})
    counted = O.with_ordinal(nxt, keys, "createdAt", "seq", "rotationCount").drop(O.SLICE)
    return counted.withColumn("active", F.col("rotatedAt").isNull())


def current_keys(rotations: DataFrame) -> DataFrame:
    """Only the active version per tenant and class, from one aggregate."""
    newest = F.struct("createdAt", "seq")
    return (rotations.groupBy("tenantId", "classification")
            .agg(F.max_by(F.struct("keyVersion", "cloudProvider", "createdAt"), newest).alias("k"),
                 F.count(F.lit(1)).alias("rotationCount"))
            .select("tenantId", "classification", "k.*", "rotationCount"))


def stale_keys(active: DataFrame, now_ms: int, max_days: int = KEY_AGE_DAYS) -> DataFrame:
    """Active keys older than their class's rotation period or the general limit."""
    age = F.floor((F.lit(now_ms) - F.col("createdAt")) / F.lit(DAY_MS))
    return (active.withColumn("ageDays", age)
            .withColumns({"pastClassPeriod": age > X.rotation_days("classification"),
                          "pastGeneralLimit": age > max_days})
            .where(F.col("pastClassPeriod") | F.col("pastGeneralLimit")))


def compact_by_key(changes: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Latest value per key; a null value is a tombstone and removes the key."""
    return (changes.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))
            .where(F.col(value).isNotNull()))


def outbox_relay(outbox: DataFrame) -> DataFrame:
    """Pending outbox rows, the earliest per saga, in creation order inside each tenant's ranges.

    Range partitioning on (tenant, time) keeps the order without putting a tenant into one task.
    """
    row = F.struct(*[F.col(c) for c in outbox.columns])
    first = (outbox.where(F.col("status") == "PENDING").groupBy("sagaId")
             .agg(F.min_by(row, F.struct("createdAt", "id")).alias("r")).select("r.*"))
    return first.repartitionByRange("tenantId", "createdAt").sortWithinPartitions("tenantId", "createdAt", "id")


def version_wins(incoming: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Which document survives: ``winner`` is incoming, existing or null for a tombstone."""
    old = existing.select(*keys, F.col("version").alias("_ev"), F.col("ts").alias("_et"))
    iv, ev = F.coalesce("version", F.lit(0)), F.coalesce("_ev", F.lit(0))
    absent = F.col("_et").isNull()
    winner = (F.when(absent, "incoming").when(F.col("tombstone"), F.lit(None))
              .when(iv > ev, "incoming").when(ev > iv, "existing")
              .when(F.col("ts") >= F.col("_et"), "incoming").otherwise("existing"))
    return (incoming.join(old, keys, "left").withColumn("winner", winner)
            .withColumn("winningVersion", F.when(F.col("winner") == "incoming", iv).when(F.col("winner") == "existing", ev))
            .drop("_ev", "_et"))


def page(df: DataFrame, order: list, page_no: int, size: int) -> DataFrame:
    """One page with the real total; a top-(offset + size) selection, not a full sort."""
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    rows = df.orderBy(*order).offset(page_no * size).limit(size)
    pages = F.ceil(F.col("totalElements") / F.lit(size))
    return (rows.withColumn("totalElements", total)
            .withColumns({"totalPages": pages, "hasNext": F.lit(page_no) < pages - 1}))


def page_info(df: DataFrame, page_no: int, size: int) -> DataFrame:
    """Totals of a paged listing as one row, which is there for a page past the end as well."""
    pages = F.ceil(F.col("totalElements") / F.lit(size))
    return (df.agg(F.count(F.lit(1)).alias("totalElements"))
            .withColumns({"totalPages": pages, "hasNext": F.lit(page_no) < pages - 1}))


def page_after(df: DataFrame, ts: str, tie: str, last_ts: int, last_tie, size: int) -> DataFrame:
    """Next page, newest first, after a known last row: depth costs nothing."""
    older = (F.col(ts) < last_ts) | ((F.col(ts) == last_ts) & (F.col(tie) < last_tie))
    return df.where(older).orderBy(F.desc(ts), F.desc(tie)).limit(size)


def page_numbers(df: DataFrame, keys: list[str], ts: str, tie: str, size: int, slice_ms: int = O.SLICE_MS) -> DataFrame:
    """The page of every row in its key's listing, newest first, with the listing's totals.

    Positions are counted by slices of time, so any page, however deep, is a filter: nothing is sorted as a
    whole and no task holds the rows before it.  Keys, ``ts`` and ``tie`` must not be null.
    """
    placed = O.with_ordinal(df, keys, ts, tie, "_at", slice_ms)
    known = with_group_totals(placed, keys, [tie], {"_n": F.count(F.lit(1))}, {"totalElements": (F.sum, "_n")})
    at = F.floor((F.col("totalElements") - F.col("_at")) / F.lit(size))
    pages = F.ceil(F.col("totalElements") / F.lit(size))
    return known.withColumns({"pageNo": at, "totalPages": pages, "hasNext": at < pages - 1}).drop("_at")


def created_between(df: DataFrame, tenant: str, start_ms: int, end_ms: int) -> DataFrame:
    """Inclusive at both ends."""
    return df.where((F.col("tenantId") == tenant) & F.col("createdAt").between(start_ms, end_ms))
