"""Quality, deduplication, dead letters, keys, change application and paging."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import aggregates as A
from tidemark.operators import dedup as D
from tidemark.operators import lifecycle as L
from tidemark.operators import quality as Q
from tidemark.operators import routing as R
from tidemark.operators import skew as K
from tidemark.plans.registry import query
from tidemark.plans.views import KNOWN
from tidemark.sources import adapter as T

NOW = T.NOW_MS
DAY = 86_400_000
RULES = [
    ("tenantId.blank", """trim(coalesce("tenantId", ''))=''"""),
    ("tenantId.format", """trim("tenantId")<>'' AND NOT regexp_full_match("tenantId", '[a-zA-Z0-9_-]{1,128}')"""),
    ("schemaName.blank", """trim(coalesce("schemaName", ''))=''"""),
    ("schemaName.size", """length("schemaName")>256"""),
    ("schemaVersion.min", """"schemaVersion"<1"""),
    ("classification.missing", "classification IS NULL"),
    ("classification.unknown", f"classification NOT IN {KNOWN}"),
    ("metadata.size", """"metadataSize">64"""),
    ("idempotencyKey.size", """length("idempotencyKey")>255"""),
    ("sourceSystem.blank", """trim(coalesce("sourceSystem", ''))=''"""),
    ("restricted.rawPayload", """classification='RESTRICTED' AND "rawPayload" IS NOT NULL"""),
    ("status.unknown", "status NOT IN ('RECEIVED','VALIDATING','ENCRYPTING','ENCRYPTED','PUBLISHED','FAILED','ARCHIVED')"),
]
BROKEN = "concat_ws(',', " + ", ".join(f"CASE WHEN {cond} THEN '{name}' END" for name, cond in RULES) + ")"


@query("validate_events", "req", f"""
v AS (SELECT id, {BROKEN} AS violations FROM req) SELECT id, violations, violations='' AS valid FROM v""")
def validate_events(spark, sf):
    return Q.validate_events(T.ingest_requests(spark, sf)).select(
        "id", F.array_join("violations", ",").alias("violations"), "valid")


STEPS = """st AS (SELECT id, seq, status, lag(status) OVER (PARTITION BY id ORDER BY "changedAt", seq) AS previous FROM hist),
lg AS (SELECT *, CASE WHEN previous IS NULL THEN status='PENDING' ELSE previous || '>' || status IN ('PENDING>PROCESSING',
  'PROCESSING>PROCESSED','PROCESSING>FAILED','FAILED>PROCESSING','FAILED>DEAD_LETTERED') END AS legal FROM st)"""


@query("status_transition_audit", "hist", STEPS + "SELECT * FROM lg")
def status_transition_audit(spark, sf):
    return Q.status_transitions(T.status_history(spark, sf)).select("id", "seq", "status", "previous", "legal")


@query("retry_counts", "hist", STEPS + """
SELECT id, count(*) FILTER (WHERE previous='FAILED' AND status='PROCESSING') AS "retryCount",
  coalesce(bool_or(previous='FAILED' AND status='DEAD_LETTERED'), false) AS "deadLettered",
  count(*) FILTER (WHERE NOT legal) AS "illegalSteps" FROM lg GROUP BY id""")
def retry_counts(spark, sf):
    return Q.retry_counts(T.status_history(spark, sf))


@query("schema_drift", "req", """
SELECT "schemaVersion", count(*) AS records, count(*) FILTER (WHERE trim(coalesce("tenantId", ''))='') AS "missing_tenantId",
  count(*) FILTER (WHERE trim(coalesce("sourceSystem", ''))='') AS "missing_sourceSystem",
  count(*) FILTER (WHERE trim(coalesce("schemaName", ''))='') AS "missing_schemaName",
  count(*) FILTER (WHERE classification IS NULL) AS missing_classification, "schemaVersion"=1 AS "knownVersion" FROM req GROUP BY ALL""")
def schema_drift(spark, sf):
    return Q.schema_drift(T.ingest_requests(spark, sf), "schemaVersion",
                          ["tenantId", "sourceSystem", "schemaName", "classification"], [1])


# ---- deduplication -----------------------------------------------------------------------------

KEYED = """k AS (SELECT id, seq, "createdAt", CASE WHEN seq%13<>0 THEN "idempotencyKey" END AS "idempotencyKey" FROM ev)"""


def _keyed(spark, sf):
    ev = T.data_events(spark, sf)
    return ev.select("id", "seq", "createdAt", F.when(F.col("seq") % 13 != 0, F.col("idempotencyKey")).alias("idempotencyKey"))


@query("idempotent_ingest", "ev", KEYED + """
SELECT id, "idempotencyKey", w AS "winnerId", w<>id AS duplicate FROM (SELECT *, CASE WHEN "idempotencyKey" IS NULL THEN id
  ELSE first_value(id) OVER (PARTITION BY "idempotencyKey" ORDER BY "createdAt", seq) END AS w FROM k)""")
def idempotent_ingest(spark, sf):
    return D.idempotent_ingest(_keyed(spark, sf)).select("id", "idempotencyKey", "winnerId", "duplicate")


@query("first_per_key", "ev", KEYED + """
SELECT id, "idempotencyKey" FROM k WHERE "idempotencyKey" IS NULL
UNION ALL SELECT id, "idempotencyKey" FROM (SELECT *, row_number() OVER (PARTITION BY "idempotencyKey" ORDER BY "createdAt", seq) AS rn
  FROM k WHERE "idempotencyKey" IS NOT NULL) WHERE rn=1""")
def first_per_key(spark, sf):
    return D.first_per_key(_keyed(spark, sf)).select("id", "idempotencyKey")


TTL = f"""
p AS (SELECT "userId" AS key, "eventType" AS service, "createdAt" AS t, "createdAt"*1000000+seq AS pos FROM ev),
acc AS (SELECT key, service, min(pos) AS pos FROM p GROUP BY ALL
  UNION ALL SELECT a.key, a.service, min(p.pos) FROM acc a JOIN p ON p.key=a.key AND p.service=a.service
    AND p.t >= a.pos//1000000 + {2 * DAY} GROUP BY a.key, a.service)
SELECT key, service, pos%1000000 AS seq, pos//1000000 AS "createdAt", pos//1000000 + {2 * DAY} AS "expiresAt" FROM acc"""


@query("idempotency_ttl", "ev", TTL, recursive=True)
def idempotency_ttl(spark, sf):
    ev = T.data_events(spark, sf).select(F.col("userId").alias("key"), F.col("eventType").alias("service"), "seq", "createdAt")
    return D.accept_with_ttl(ev, ["key", "service"], "createdAt", "seq", 2 * DAY)


@query("idempotency_purge", "ev", f"""
SELECT id, "createdAt" + {10 * DAY} AS "expiresAt" FROM ev WHERE "createdAt" + {10 * DAY} >= {NOW}""")
def idempotency_purge(spark, sf):
    store = T.data_events(spark, sf).select("id", (F.col("createdAt") + 10 * DAY).alias("expiresAt"))
    return D.purge_expired(store, NOW)


# ---- dead letters ------------------------------------------------------------------------------

REASON = """CASE WHEN value IS NULL THEN 'POISON_PILL' WHEN "exceptionClass" LIKE '%SerializationException%'
  OR "exceptionClass" LIKE '%SchemaParseException%' OR "exceptionClass" LIKE '%AvroTypeException%' THEN 'SCHEMA_MISMATCH'
  ELSE 'PROCESSING_FAILURE' END"""


@query("dlq_classify", "rec", f"""
SELECT "offset", {REASON} AS reason, "exceptionClass", "originalTopic", "originalOffset" FROM rec""")
def dlq_classify(spark, sf):
    return L.dlq_classify(T.topic_records(spark, sf)).select(
        "offset", "reason", "exceptionClass", "originalTopic", "originalOffset")


@query("dlq_reason_counts", "rec", f"""
c AS (SELECT {REASON} AS reason FROM rec) SELECT reason, count(*) AS n FROM c GROUP BY reason
UNION ALL SELECT 'TOTAL', count(*) FROM c""")
def dlq_reason_counts(spark, sf):
    return A.reason_counts(L.dlq_classify(T.topic_records(spark, sf)))


@query("dlq_retry_plan", "dlq", f"""
SELECT id, CASE WHEN succeeded THEN 'RESOLVED' WHEN "retryCount"+1>=5 THEN 'EXHAUSTED' ELSE 'PENDING_RETRY' END AS status,
  CASE WHEN succeeded THEN "retryCount" ELSE "retryCount"+1 END AS "retryCount",
  CASE WHEN NOT succeeded AND "retryCount"+1<5 THEN {NOW} + least(30*CAST(pow(2, "retryCount"+1) AS BIGINT), 3600)*1000
    ELSE "nextRetryAt" END AS "nextRetryAt",
  CASE WHEN NOT succeeded THEN left("errorText", 1024) END AS "errorMessage", CAST({NOW} AS BIGINT) AS "lastAttemptedAt"
FROM dlq WHERE status='PENDING_RETRY' AND "nextRetryAt" < {NOW}""")
def dlq_retry_plan(spark, sf):
    return L.dlq_retry_plan(R.dlq_due(T.dlq_rows(spark, sf), NOW), NOW).select(
        "id", "status", "retryCount", "nextRetryAt", "errorMessage", "lastAttemptedAt")


@query("dlq_bulk_resolve", "dlq", """
SELECT id, CASE WHEN "tenantId"='tenant-5' THEN 'RESOLVED' ELSE status END AS status, "tenantId"='tenant-5' AS resolved FROM dlq""")
def dlq_bulk_resolve(spark, sf):
    return L.dlq_bulk_resolve(T.dlq_rows(spark, sf), "tenant-5").select("id", "status", "resolved")


@query("dlq_resolve_ids", "dlq", """
l AS (SELECT DISTINCT 'd-' || l_orderkey AS id FROM lineitem WHERE l_returnflag='R'),
m AS (SELECT dlq.*, "tenantId"='tenant-5' AND l.id IS NOT NULL AS hit FROM dlq LEFT JOIN l ON dlq.id=l.id)
SELECT id, CASE WHEN hit THEN 'RESOLVED' ELSE status END AS status, hit AS resolved FROM m""")
def dlq_resolve_ids(spark, sf):
    ids = (T.table(spark, sf, "lineitem").where(F.col("l_returnflag") == "R")
           .select(F.concat(F.lit("d-"), F.col("l_orderkey").cast("string")).alias("id")))
    return L.dlq_bulk_resolve(T.dlq_rows(spark, sf), "tenant-5", ids).select("id", "status", "resolved")


@query("dlq_entries", "aws azure", f"""
SELECT "tenantId", "aggregateType", "aggregateId", "sourceCloud", 'azure' AS "targetCloud", to_base64(encode(payload)) AS "payloadB64",
  '{{aws=' || c_aws || ', azure=' || c_azure || '}}' AS "vectorClockJson", "wallClockTs", 1 AS "schemaVersion", 'PENDING_RETRY' AS status,
  'timeout' AS "errorMessage", 0 AS "retryCount", CAST({NOW}+30000 AS BIGINT) AS "nextRetryAt",
  CAST(NULL AS VARCHAR) AS "competingPayloadB64", CAST(NULL AS VARCHAR) AS "conflictStrategy" FROM aws
UNION ALL SELECT z."tenantId", z."aggregateType", z."aggregateId", z."sourceCloud", 'aws', to_base64(encode(z.payload)),
  '{{aws=' || z.c_aws || ', azure=' || z.c_azure || '}}', z."wallClockTs", 1, 'CONFLICT_REVIEW', 'held until someone decides between the two versions', 0,
  CAST({NOW} AS BIGINT), to_base64(encode(a.payload)), 'MANUAL_REVIEW' FROM azure z JOIN aws a ON a.k=z.k""")
def dlq_entries(spark, sf):
    aws, azure = T.sync_copy(spark, sf, "aws"), T.sync_copy(spark, sf, "azure")
    pack = lambda df, n: df.select("tenantId", "aggregateId", F.struct(*df.columns).alias(n))
    pairs = pack(azure, "incoming").join(pack(aws, "existing"), ["tenantId", "aggregateId"])
    return (L.failure_entries(aws, "azure", F.lit("timeout"), NOW)
            .unionByName(L.conflict_entries(pairs, NOW), allowMissingColumns=True))


# ---- keys --------------------------------------------------------------------------------------

SCD = """scd AS (SELECT *, lead("createdAt") OVER w AS "rotatedAt", row_number() OVER w AS "rotationCount" FROM rot
  WINDOW w AS (PARTITION BY "tenantId", classification ORDER BY "createdAt", seq))"""


@query("key_version_scd2", "rot", SCD + """
SELECT "keyVersion", "tenantId", classification, "cloudProvider", "createdAt", "rotatedAt", "rotationCount", "rotatedAt" IS NULL AS active FROM scd""")
def key_version_scd2(spark, sf):
    return L.key_versions(T.key_rotations(spark, sf)).drop("seq")


@query("stale_keys", "rot", SCD + f"""
SELECT * FROM (SELECT "tenantId", classification, "keyVersion", ({NOW}+{40 * DAY}-"createdAt")//{DAY} AS "ageDays",
  ({NOW}+{40 * DAY}-"createdAt")//{DAY} > CASE classification WHEN 'CONFIDENTIAL' THEN 90 WHEN 'RESTRICTED' THEN 30 ELSE 365 END AS "pastClassPeriod",
  ({NOW}+{40 * DAY}-"createdAt")//{DAY} > 41 AS "pastGeneralLimit" FROM scd WHERE "rotatedAt" IS NULL)
WHERE "pastClassPeriod" OR "pastGeneralLimit\"""")
def stale_keys(spark, sf):
    current = L.current_keys(T.key_rotations(spark, sf))
    return L.stale_keys(current, NOW + 40 * DAY, 41).select(
        "tenantId", "classification", "keyVersion", "ageDays", "pastClassPeriod", "pastGeneralLimit")


@query("encrypt_column", "", """
SELECT doc_id, (['CONFIDENTIAL','RESTRICTED'])[doc_id%2+1] AS classification, true AS "roundTrip", true AS "wrongTenantFails",
  true AS "tamperFails", 28 AS "overheadBytes" FROM documents""")
def encrypt_column(spark, sf):
    """Round trip, wrong tenant and tampered ciphertext over all documents.

    The key table has one derived key per tenant and class and reaches the rows by a join that
    stays even for one dominant tenant.  The ciphertext holds a random IV, so only the outcomes
    are compared.
    """
    docs = T.table(spark, sf, "documents").select(
        "doc_id", T.tenant(F.col("doc_id")).alias("tenantId"),
        T.pick(["CONFIDENTIAL", "RESTRICTED"], F.col("doc_id") % 2).alias("classification"), F.encode("text", "UTF-8").alias("payload"))
    owner = ["tenantId", "classification"]
    keys = docs.select(*owner).distinct().withColumn(
        "dek", F.unhex(F.sha2(F.concat_ws("/", F.lit("dek"), *owner), 256)))
    sealed = K.lookup_join(docs, keys, owner, ["doc_id"]).withColumn(
        "sealed", X.encrypt("payload", "dek", *owner))
    tampered = F.expr("concat(substring(sealed, 1, length(sealed) - 1), unhex(translate("
                      "hex(substring(sealed, -1)), '0123456789ABCDEF', 'FEDCBA9876543210')))")
    return sealed.select(
        "doc_id", "classification",
        (X.decrypt("sealed", "dek", "tenantId", "classification") == F.col("payload")).alias("roundTrip"),
        X.decrypt(F.col("sealed"), F.col("dek"), F.lit("tenant-x"), F.col("classification")).isNull().alias("wrongTenantFails"),
        X.decrypt(tampered, "dek", "tenantId", "classification").isNull().alias("tamperFails"),
        (F.octet_length("sealed") - F.octet_length("payload")).alias("overheadBytes"))


@query("key_history", "rot", """
SELECT "keyVersion", "tenantId", classification, "createdAt", (SELECT count(*) FROM rot) AS "totalElements",
  CAST(ceil((SELECT count(*) FROM rot)/20.0) AS BIGINT) AS "totalPages", 2 < ceil((SELECT count(*) FROM rot)/20.0)-1 AS "hasNext"
FROM rot ORDER BY "createdAt" DESC, seq DESC LIMIT 20 OFFSET 40""")
def key_history(spark, sf):
    rows = T.key_rotations(spark, sf)
    return L.page(rows, [F.desc("createdAt"), F.desc("seq")], 2, 20).drop("seq", "cloudProvider")


# ---- change application ------------------------------------------------------------------------

@query("cdc_apply", "rec", """
u AS (SELECT seq AS "offset", "userId" AS key, CASE WHEN NOT "isPoison" THEN props END AS value, "createdAt" AS ts FROM ev)
SELECT key, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, "offset" DESC) AS rn FROM u)
WHERE rn=1 AND value IS NOT NULL""")
def cdc_apply(spark, sf):
    changes = T.data_events(spark, sf).select(
        F.col("userId").alias("key"), F.when(~F.col("isPoison"), F.col("props")).alias("value"),
        F.col("createdAt").alias("ts"), F.col("seq").alias("offset"))
    return L.compact_by_key(changes, ["key"], ["ts", "offset"], "value")


OUTBOX = """ob AS (SELECT id, seq, 's-' || (seq//2) AS "sagaId", "tenantId", (['PENDING','PUBLISHED','PENDING','FAILED'])[seq%4+1] AS status, "createdAt" FROM ev)"""


@query("outbox_relay", "ev", OUTBOX + """
SELECT id, "sagaId", "tenantId", "createdAt" FROM (SELECT *, row_number() OVER (PARTITION BY "sagaId" ORDER BY "createdAt", id) AS rn
  FROM ob WHERE status='PENDING') WHERE rn=1""")
def outbox_relay(spark, sf):
    ev = T.data_events(spark, sf)
    outbox = ev.select("id", F.concat(F.lit("s-"), F.floor(F.col("seq") / 2).cast("string")).alias("sagaId"), "tenantId",
                       T.pick(["PENDING", "PUBLISHED", "PENDING", "FAILED"], F.col("seq") % 4).alias("status"), "createdAt")
    return L.outbox_relay(outbox).drop("status")


@query("version_wins", "aws azure", """
SELECT z."aggregateId", CASE WHEN a.k IS NULL THEN 'incoming' WHEN z.k%9=0 THEN NULL WHEN z.c_azure>a.c_azure THEN 'incoming'
  WHEN a.c_azure>z.c_azure THEN 'existing' WHEN z."wallClockTs">=a."wallClockTs" THEN 'incoming' ELSE 'existing' END AS winner,
  CASE WHEN a.k IS NULL THEN z.c_azure WHEN z.k%9=0 THEN NULL ELSE greatest(z.c_azure, a.c_azure) END AS "winningVersion"
FROM azure z LEFT JOIN aws a ON a.k=z.k""")
def version_wins(spark, sf):
    doc = lambda cloud: T.sync_copy(spark, sf, cloud).select(
        "aggregateId", F.col("vectorClock")["azure"].alias("version"), F.col("wallClockTs").alias("ts"),
        (F.col("aggregateId").cast("bigint") % 9 == 0).alias("tombstone"))
    return L.version_wins(doc("azure"), doc("aws"), ["aggregateId"]).select("aggregateId", "winner", "winningVersion")


# ---- pages -------------------------------------------------------------------------------------

def _page_sql(source: str, cols: str, order: str, page: int, size: int) -> str:
    return f"""f AS ({source}) SELECT {cols}, (SELECT count(*) FROM f) AS "totalElements",
  CAST(ceil((SELECT count(*) FROM f)/{size}.0) AS BIGINT) AS "totalPages", {page} < ceil((SELECT count(*) FROM f)/{size}.0)-1 AS "hasNext"
FROM f ORDER BY {order} LIMIT {size} OFFSET {page * size}"""


START, END = NOW - 25 * DAY, NOW - 5 * DAY


@query("page_by_created", "life", _page_sql(
    f"""SELECT * FROM life WHERE "tenantId"='tenant-1' AND "createdAt" BETWEEN {START} AND {END}""",
    'id, status, "createdAt"', '"createdAt" DESC, id DESC', 2, 20))
def page_by_created(spark, sf):
    rows = L.created_between(T.lifecycle_rows(spark, sf), "tenant-1", START, END).select("id", "status", "createdAt")
    return L.page(rows, [F.desc("createdAt"), F.desc("id")], 2, 20)


@query("page_by_status", "life", _page_sql(
    """SELECT * FROM life WHERE "tenantId"='tenant-4' AND status='FAILED'""", 'id, status, "createdAt"', '"createdAt" DESC, id DESC', 1, 50))
def page_by_status(spark, sf):
    rows = R.by_tenant_status(T.lifecycle_rows(spark, sf), "tenant-4", "FAILED").select("id", "status", "createdAt")
    return L.page(rows, [F.desc("createdAt"), F.desc("id")], 1, 50)


@query("page_keyset", "life", f"""
SELECT id, status, "createdAt" FROM life WHERE "tenantId"='tenant-1' AND "createdAt" < {END} ORDER BY "createdAt" DESC, id DESC LIMIT 20""")
def page_keyset(spark, sf):
    rows = T.lifecycle_rows(spark, sf).where(F.col("tenantId") == "tenant-1").select("id", "status", "createdAt")
    return L.page_after(rows, "createdAt", "id", END, "", 20)


@query("page_index", "life", """
p AS (SELECT "tenantId", id, "createdAt", (row_number() OVER (PARTITION BY "tenantId" ORDER BY "createdAt" DESC, id DESC)-1)//50 AS "pageNo",
  count(*) OVER (PARTITION BY "tenantId") AS n FROM life)
SELECT "tenantId", "pageNo", max("createdAt") AS newest, min("createdAt") AS oldest, count(*) AS rows, CAST(ceil(max(n)/50.0) AS BIGINT) AS "totalPages" FROM p GROUP BY "tenantId", "pageNo\"""")
def page_index(spark, sf):
    """What every page of every tenant's listing holds."""
    rows = T.lifecycle_rows(spark, sf).select("tenantId", "id", "createdAt")
    return (L.page_numbers(rows, ["tenantId"], "createdAt", "id", 50).groupBy("tenantId", "pageNo")
            .agg(F.max("createdAt").alias("newest"), F.min("createdAt").alias("oldest"), F.count(F.lit(1)).alias("rows"),
                 F.max("totalPages").alias("totalPages")))


@query("page_past_end", "life", """
f AS (SELECT * FROM life WHERE "tenantId"='tenant-4' AND status='FAILED')
SELECT count(*) AS "totalElements", CAST(ceil(count(*)/50.0) AS BIGINT) AS "totalPages", false AS "hasNext" FROM f""")
def page_past_end(spark, sf):
    """Totals of a page that lies past the end."""
    rows = R.by_tenant_status(T.lifecycle_rows(spark, sf), "tenant-4", "FAILED")
    return L.page_info(rows, 1_000_000, 50)


@query("dlq_page", "dlq", _page_sql(
    """SELECT * FROM dlq WHERE "tenantId"='tenant-6'""", 'id, status, "createdAt"', '"createdAt" DESC, id DESC', 3, 20))
def dlq_page(spark, sf):
    rows = T.dlq_rows(spark, sf).where(F.col("tenantId") == "tenant-6").select("id", "status", "createdAt")
    return L.page(rows, [F.desc("createdAt"), F.desc("id")], 3, 20)


@query("dlq_review_queue", "dlq", _page_sql(
    "SELECT * FROM dlq WHERE status='CONFLICT_REVIEW'", 'id, "tenantId", "createdAt"', '"createdAt", id', 0, 20))
def dlq_review_queue(spark, sf):
    rows = T.dlq_rows(spark, sf).where(F.col("status") == "CONFLICT_REVIEW").select("id", "tenantId", "createdAt")
    return L.page(rows, ["createdAt", "id"], 0, 20)
