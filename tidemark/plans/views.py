"""SQL twins of the canonical views in ``tidemark.sources.adapter``."""

from __future__ import annotations

from tidemark.sources.adapter import NOW_MS

KNOWN = "('PUBLIC','INTERNAL','CONFIDENTIAL','RESTRICTED')"
LIFECYCLE = "['PENDING','PROCESSING','PROCESSED','FAILED','DEAD_LETTERED']"
ROLES = "['ADMIN','DATA_INGEST','DATA_QUERY','KEY_MANAGER','PLATFORM_OPS','SERVICE_ACCOUNT']"


def _payload(side: str) -> str:
    status = "o_orderstatus" if side == "aws" else "CASE WHEN k%12=0 THEN 'Z' ELSE o_orderstatus END"
    return f"""CASE WHEN k%66=0 THEN '[{len(side)},' || (k%9) || ']'
      ELSE '{{"status":"' || ({status}) || '","priority":"' || o_orderpriority || '"'
        || CASE WHEN k%6=0 THEN ',"{side}_note":"n' || (k%7) || '"' ELSE '' END || '}}' END"""


def _copy(side: str, missing: int, step: str, aws: str, azure: str) -> str:
    return f"""SELECT '{side}-' || k AS id, k, 'tenant-' || (o_custkey%8) AS "tenantId",
      (['TENANT_CONFIG','AUDIT_RECORD','RESTRICTED_DATA','ORDER','PROFILE'])[(k//20)%5+1] AS "aggregateType",
      CAST(k AS VARCHAR) AS "aggregateId", '{side}' AS "sourceCloud", {_payload(side)} AS payload,
      {aws} AS c_aws, {azure} AS c_azure, epoch_ms(o_orderdate) + {step} AS "wallClockTs",
      epoch_ms(o_orderdate) AS "createdAt", o_orderstatus, o_orderpriority
      FROM (SELECT *, o_orderkey AS k FROM orders) WHERE k%10<>{missing}"""


VIEWS = {
    "ev": """SELECT CAST(event_id AS VARCHAR) AS id, event_id AS seq, user_id AS "userId",
      'tenant-' || (user_id%8) AS "tenantId", 'sys-' || (event_id%3) AS "sourceSystem",
      event_type AS "eventType",
      CASE WHEN event_id%101=100 THEN 'UNKNOWN' WHEN event_id%10<4 THEN 'PUBLIC'
        WHEN event_id%10<7 THEN 'INTERNAL' WHEN event_id%10<9 THEN 'CONFIDENTIAL'
        ELSE 'RESTRICTED' END AS classification,
      CASE WHEN event_id%5=0 THEN '1.1' ELSE '1.0' END AS "schemaVersion",
      'k-' || (CASE WHEN event_id%10=9 THEN event_id-1 ELSE event_id END) AS "idempotencyKey",
      64+event_id%997 AS "payloadSizeBytes", epoch_us(ts)//1000 AS "createdAt",
      epoch_us(ts)//1000 + event_id*37%500 AS "enrichedAt", event_id*37%500 AS "enrichmentLatencyMs",
      event_id%47=46 AS "isPoison", value>150 AS "anomalyDetected", value, props,
      regexp_extract(props, '[0-9]+') AS mk,
      strftime(ts, '%Y-%m-%d') AS date, CAST(strftime(ts, '%H') AS BIGINT) AS hour
      FROM events""",
    "valid": f"""SELECT *, CASE WHEN classification IN ('CONFIDENTIAL','RESTRICTED')
      THEN 'ENRICHMENT_PATH' ELSE 'FAST_PATH' END AS "processingPath"
      FROM ev WHERE NOT "isPoison" AND classification IN {KNOWN}""",
    "life": f"""SELECT id, seq, "tenantId", "eventType" AS "schemaName", seq%3+1 AS "schemaVersion",
      classification, ({LIFECYCLE})[seq*7%5+1] AS status, "createdAt",
      "createdAt" + (seq%90)*60000 AS "updatedAt",
      CASE WHEN classification<>'RESTRICTED' THEN props END AS "rawPayload",
      CASE WHEN classification IN ('CONFIDENTIAL','RESTRICTED') THEN 'enc:' || props END AS "encryptedPayload",
      CASE WHEN classification IN ('CONFIDENTIAL','RESTRICTED') THEN 'v' || (seq%4) END AS "encryptionKeyVersion",
      seq%4 AS "retryCount", "idempotencyKey" FROM ev""",
    "hist": f"""SELECT 'e-' || (seq//5) AS id, seq, "tenantId",
      ({LIFECYCLE})[(seq*7//11)%5+1] AS status, "createdAt" AS "changedAt" FROM ev""",
    "req": """SELECT id, seq,
      CASE WHEN seq%211=0 THEN ' ' WHEN seq%223=0 THEN 'tenant 3!' ELSE "tenantId" END AS "tenantId",
      CASE WHEN seq%227=0 THEN '' ELSE "sourceSystem" END AS "sourceSystem",
      CASE WHEN seq%233=0 THEN repeat("eventType", 60) WHEN seq%251=0 THEN NULL ELSE "eventType" END AS "schemaName",
      CASE WHEN seq%229=0 THEN 0 ELSE 1 END AS "schemaVersion",
      CASE WHEN seq%257=0 THEN NULL ELSE classification END AS classification,
      CASE WHEN seq%239=0 THEN repeat('k', 300) ELSE "idempotencyKey" END AS "idempotencyKey",
      CASE WHEN seq%241=0 THEN 65 ELSE 1 END AS "metadataSize",
      CASE WHEN classification='RESTRICTED' AND seq%3=0 THEN props END AS "rawPayload",
      CASE WHEN seq%263=0 THEN 'PROCESSING' ELSE 'RECEIVED' END AS status FROM ev""",
    "rec": """SELECT "tenantId" AS key, CASE WHEN NOT "isPoison" THEN props END AS value,
      seq%12 AS partition, seq AS "offset", "createdAt" AS timestamp,
      CASE WHEN seq%6<>5 THEN (['org.apache.kafka.common.errors.SerializationException',
        'org.apache.avro.SchemaParseException','org.apache.avro.AvroTypeException',
        'java.lang.NullPointerException','java.io.IOException'])[seq%5+1] ELSE 'unknown' END AS "exceptionClass",
      CASE WHEN seq%6<>5 THEN 'topic-' || (seq%4) ELSE 'unknown' END AS "originalTopic",
      CASE WHEN seq%6<>5 THEN CAST(seq AS VARCHAR) ELSE 'unknown' END AS "originalOffset" FROM ev""",
    "aws": _copy("aws", 7, "(k%5)*1000", "1+k%3+CASE WHEN k%4 IN (2,3) THEN 1 ELSE 0 END", "k%2"),
    "azure": _copy("azure", 3, "(k%3)*1000", "1+k%3", "k%2+CASE WHEN k%4 IN (1,3) THEN 1 ELSE 0 END"),
    "ver": """SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderkey AS seq, 'tenant-' || (o_custkey%8) AS "tenantId",
      CAST(o_custkey AS VARCHAR) AS "aggregateId", (['aws','azure','gcp'])[o_orderkey%3+1] AS "sourceCloud",
      o_orderkey%4 AS c_aws, (o_orderkey//4)%3 AS c_azure,
      CASE WHEN o_orderkey%5=0 THEN o_orderkey%2+1 ELSE 0 END AS c_gcp,
      epoch_ms(o_orderdate) + (o_orderkey%5)*1000 AS "wallClockTs" FROM orders""",
    "dlq": f"""SELECT k AS seq, 'd-' || k AS id, 'tenant-' || (o_custkey%8) AS "tenantId",
      CAST(k AS VARCHAR) AS "aggregateId", (['aws','azure'])[k%2+1] AS "targetCloud",
      (['PENDING_RETRY','IN_RETRY','CONFLICT_REVIEW','EXHAUSTED','RESOLVED'])[k*3%5+1] AS status,
      (k//5)%5 AS "retryCount",
      CASE WHEN k%5<>4 THEN {NOW_MS} - (k%5000)*60000 + (k%7000)*60000 END AS "nextRetryAt",
      {NOW_MS} - (k%5000)*60000 AS "createdAt", k%3=0 AS succeeded,
      repeat('timeout ' || o_orderpriority || '; ', 90) AS "errorText"
      FROM (SELECT *, o_orderkey AS k FROM orders)""",
    "users": f"""SELECT c_custkey AS seq, c_name AS username, 'tenant-' || (c_custkey%8) AS "tenantId",
      c_custkey%9<>0 AS enabled, c_custkey%4=0 AS "serviceAccount",
      CASE WHEN c_custkey%11=0 THEN {NOW_MS} + (c_custkey%5-2)*3600000 END AS "lockedUntil" FROM customer""",
    "user_roles": f"""SELECT DISTINCT username, role FROM (
      SELECT c_name AS username, ({ROLES})[c_custkey%6+1] AS role FROM customer UNION ALL
      SELECT c_name, ({ROLES})[(c_custkey//6)%6+1] FROM customer)""",
    "grants": """SELECT DISTINCT * FROM (
      SELECT c_name AS username, 'tenant-' || (c_custkey%8) AS "tenantId",
        (['PUBLIC','INTERNAL','CONFIDENTIAL','RESTRICTED','SECRET'])[c_custkey%5+1] AS classification FROM customer
      UNION ALL SELECT c_name, 'tenant-' || (c_custkey%8),
        (['PUBLIC','INTERNAL'])[(c_custkey//8)%2+1] FROM customer)""",
    "rot": f"""SELECT 'kv-' || id AS "keyVersion", seq, "tenantId", classification,
      (['AWS','AZURE'])[seq%2+1] AS "cloudProvider", "createdAt"
      FROM ev WHERE "eventType"='signup' AND classification IN {KNOWN}""",
    "logins": """SELECT 'user-' || "userId" AS username, seq, "createdAt" AS at_ms, "eventType"='error' AS failed
      FROM ev WHERE "eventType" IN ('error','click')""",
    "audit": """SELECT (['LOGIN_SUCCESS','LOGIN_FAILURE','KEY_ROTATION_COMPLETED','RESTRICTED_DATA_ACCESS',
      'DR_CONSISTENCY_CHECK','ADMIN_ACTION','AUTHORIZATION_FAILURE'])[seq%7+1] AS "eventType",
      CASE WHEN "eventType"='error' THEN 'FAILURE' WHEN seq%13=0 THEN 'PARTIAL' ELSE 'SUCCESS' END AS outcome,
      CASE WHEN seq%17=0 THEN 'SYSTEM' ELSE 'user-' || "userId" END AS actor, "tenantId",
      CASE WHEN seq%4=0 THEN ' ' WHEN seq%4<>1 THEN 'r-' || (seq%50) END AS "requestId",
      'ctx-' || (seq%3) AS "contextRequestId", "createdAt" AS timestamp FROM ev""",
    "probes": """SELECT (['aws','azure'])[seq%2+1] AS "cloudProvider", seq, seq%29<>0 AS reachable,
      CAST(floor(value*60) AS BIGINT) AS "latencyMs", CAST(seq%13 AS DOUBLE) AS "errorRatePercent",
      "createdAt" AS "checkedAt" FROM ev""",
    "gauges": """SELECT (['dr_state','replication_lag_seconds','dlq_exhausted_total','circuitbreaker_open',
      'consumer_group_lag'])[seq%5+1] AS metric, 's-' || ("userId"%4) AS series, seq, "createdAt" AS ts,
      CASE seq%5 WHEN 0 THEN CAST((seq//5)%4 AS DOUBLE) WHEN 1 THEN value*5
        WHEN 2 THEN CAST((seq//5)%3 AS DOUBLE) WHEN 3 THEN CASE WHEN (seq//5)%6<4 THEN 1.0 ELSE 0.0 END
        ELSE value*300 END AS value FROM ev""",
    "counters": """SELECT 'step-' || (seq%4) AS series, seq, "createdAt" AS ts,
      CAST((seq%1000)//4*3 + (seq%1000)//40 AS DOUBLE) AS value FROM ev""",
    "http": """SELECT seq, "tenantId",
      (['/actuator/health','/actuator/info','/api/v1/events','/api/v1/keys','/actuator/healthz'])[seq%5+1] AS uri,
      (['GET','POST','PUT'])[seq%3+1] AS method,
      CASE WHEN "eventType"='error' THEN CASE WHEN seq%2=0 THEN 500 ELSE 404 END ELSE 200 END AS status,
      CAST(floor(value*20) AS BIGINT) AS "durationMs",
      CASE WHEN seq%3<>0 THEN 'application/json' END AS "contentType", "createdAt" AS ts FROM ev""",
    "spans": """SELECT seq//4 AS "traceId", id AS "spanId", seq,
      CASE WHEN "eventType"='error' THEN CASE WHEN seq%4=1 THEN 'ERROR' ELSE 'UNSET' END ELSE 'OK' END AS "statusCode",
      (seq//4)*100000 + (seq%4)*50 AS "startMs",
      (seq//4)*100000 + (seq%4)*50 + CAST(floor(value*20) AS BIGINT) AS "endMs",
      (['/health','/metrics','/api/v1/events','/api/v1/keys','/api/v1/dr'])[seq%5+1] AS route,
      CASE WHEN seq%7=0 THEN 'legacy' END AS ns, CASE WHEN seq%3=0 THEN 'staging' END AS env FROM ev""",
}

NEEDS_EVENTS = {"valid", "life", "hist", "req", "rec", "rot", "logins", "audit", "probes", "gauges",
                "counters", "http", "spans"}


def with_views(names: str, sql: str, recursive: bool = False) -> str:
    """Prefix ``sql`` with the named views."""
    wanted = names.split()
    if NEEDS_EVENTS & set(wanted) and "ev" not in wanted:
        wanted.insert(0, "ev")
    ctes = [f"{n} AS ({VIEWS[n]})" for n in wanted]
    body = sql.strip()
    if not ctes and not body.upper().startswith("WITH") and not body.upper().startswith("SELECT"):
        return f"WITH {body}"
    if not ctes:
        return f"WITH RECURSIVE {body}" if recursive else body
    head = "WITH RECURSIVE " if recursive else "WITH "
    joint = " " if body.upper().startswith("SELECT") or body.startswith("(") else ", "
    return head + ",\n".join(ctes) + joint + body
