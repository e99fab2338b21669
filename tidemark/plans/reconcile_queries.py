"""Vector clocks, conflict strategies, application of changes, consistency and lag."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import schema as S
from tidemark.functions import clocks as C
from tidemark.functions import events as E
from tidemark.operators import digests as DG
from tidemark.operators import lifecycle as L
from tidemark.operators import reconcile as R
from tidemark.plans.registry import query
from tidemark.session import cut_lineage, shared_dir
from tidemark.sources import adapter as T

NOW = T.NOW_MS
CONFIG = {**S.DEFAULT_STRATEGIES, "PROFILE": "FIELD_MERGE"}

# e = existing (aws copy), i = incoming (azure copy)
PAIR = """pr AS (SELECT e.k, e.id AS eid, i.id AS iid, e."tenantId", e."aggregateId", e."aggregateType" AS typ, e.payload AS ep, i.payload AS ip,
  e.c_aws AS ea, e.c_azure AS ez, i.c_aws AS ia, i.c_azure AS iz, e."wallClockTs" AS et, i."wallClockTs" AS it,
  greatest(e.c_aws, i.c_aws) AS ma, greatest(e.c_azure, i.c_azure) AS mz,
  CASE WHEN e.c_aws=i.c_aws AND e.c_azure=i.c_azure THEN 'EQUAL' WHEN e.c_aws<=i.c_aws AND e.c_azure<=i.c_azure THEN 'BEFORE'
    WHEN e.c_aws>=i.c_aws AND e.c_azure>=i.c_azure THEN 'AFTER' ELSE 'CONCURRENT' END AS rel
  FROM aws e JOIN azure i ON e.k=i.k)"""
TEXT = """'aws=' || {a} || ',azure=' || {z}"""
MERGED = TEXT.format(a="ma", z="mz")
LWW = "CASE WHEN et>it THEN eid ELSE iid END"  # a tie goes to azure, the larger cloud id
OBJ = "k%66<>0"


def pairs(spark, sf, how="inner"):
    return R.pair(T.sync_copy(spark, sf, "azure"), T.sync_copy(spark, sf, "aws"), how)


def shown(df, record="resolved"):
    return df.select("aggregateId", F.col(f"{record}.id").alias("id"), F.col(f"{record}.syncStatus").alias("status"),
                     E.map_text(f"{record}.vectorClock").alias("clock"))


def _strategy_sql(winner: str, status: str = "'CONFLICT_RESOLVED'", clock: str = MERGED) -> str:
    return PAIR + f"""SELECT "aggregateId", {winner} AS id, {status} AS status, {clock} AS clock FROM pr"""


@query("vclock_merge", "aws azure", PAIR + f"""
SELECT "aggregateId", {MERGED} AS merged, 'aws=' || (ea+1) || ',azure=' || ez AS incremented,
  'aws=' || ea || ',azure=' || ez || ',gcp=1' AS grown FROM pr""")
def vclock_merge(spark, sf):
    clock = F.col("existing.vectorClock")
    return pairs(spark, sf).select(
        "aggregateId", E.map_text(C.merge(clock, "incoming.vectorClock")).alias("merged"),
        E.map_text(C.increment(clock, "aws")).alias("incremented"), E.map_text(C.increment(clock, "gcp")).alias("grown"))


@query("vclock_compare", "aws azure", PAIR + """
SELECT "aggregateId", rel AS relation, CASE rel WHEN 'BEFORE' THEN 'AFTER' WHEN 'AFTER' THEN 'BEFORE' ELSE rel END AS reverse FROM pr""")
def vclock_compare(spark, sf):
    a, b = "existing.vectorClock", "incoming.vectorClock"
    return pairs(spark, sf).select("aggregateId", C.compare(a, b).alias("relation"), C.compare(b, a).alias("reverse"))


def _single(strategy, primary="aws"):
    return lambda spark, sf: shown(R.resolve_with(pairs(spark, sf), strategy, primary))


query("resolve_lww", "aws azure", _strategy_sql(LWW))(_single("LAST_WRITE_WINS"))
query("resolve_vclock", "aws azure", _strategy_sql(
    f"CASE rel WHEN 'BEFORE' THEN iid WHEN 'CONCURRENT' THEN {LWW} ELSE eid END"))(_single("HIGHEST_VECTOR_CLOCK"))
query("resolve_cloud_priority", "aws azure", _strategy_sql("eid"))(_single("CLOUD_PRIORITY", "AWS"))
query("resolve_manual", "aws azure", _strategy_sql(
    "eid", "'CONFLICT_DETECTED'", TEXT.format(a="ea", z="ez")))(_single("MANUAL_REVIEW"))


FIELDS = """CASE WHEN {obj} THEN json_extract_string({p}, '$.{f}') END"""


def _pick(field: str) -> str:
    e, i = f"json_extract_string(ep, '$.{field}')", f"json_extract_string(ip, '$.{field}')"
    return f"CASE WHEN {e} IS NULL THEN {i} WHEN {i} IS NULL THEN {e} WHEN it>=et THEN {i} ELSE {e} END"


@query("resolve_field_merge", "aws azure", PAIR + f"""
SELECT "aggregateId", CASE WHEN {OBJ} THEN {_pick('status')} END AS f_status, CASE WHEN {OBJ} THEN {_pick('priority')} END AS f_priority,
  CASE WHEN {OBJ} THEN {_pick('aws_note')} END AS f_aws, CASE WHEN {OBJ} THEN {_pick('azure_note')} END AS f_azure,
  CASE WHEN {OBJ} THEN CASE WHEN et>=it THEN eid ELSE iid END ELSE {LWW} END AS id, greatest(et, it) AS "wallClockTs", {MERGED} AS clock,
  CASE WHEN NOT ({OBJ}) THEN CASE WHEN et>it THEN ep ELSE ip END END AS raw FROM pr""")
def resolve_field_merge(spark, sf):
    merged = R.resolve_with(pairs(spark, sf), "FIELD_MERGE").withColumnRenamed("resolved", "r")
    text = F.col("r.payload").cast("string")
    is_object = text.startswith("{")
    field = lambda n: F.when(is_object, F.get_json_object(text, f"$.{n}"))
    return merged.select("aggregateId", field("status").alias("f_status"), field("priority").alias("f_priority"),
                         field("aws_note").alias("f_aws"), field("azure_note").alias("f_azure"),
                         F.col("r.id").alias("id"), F.col("r.wallClockTs").alias("wallClockTs"),
                         E.map_text("r.vectorClock").alias("clock"), F.when(~is_object, text).alias("raw"))


STRATEGY = """CASE typ WHEN 'TENANT_CONFIG' THEN 'CLOUD_PRIORITY' WHEN 'AUDIT_RECORD' THEN 'LAST_WRITE_WINS'
  WHEN 'RESTRICTED_DATA' THEN 'MANUAL_REVIEW' WHEN 'PROFILE' THEN 'FIELD_MERGE' ELSE 'HIGHEST_VECTOR_CLOCK' END"""
DISPATCH = PAIR + f""", ds AS (SELECT *, {STRATEGY} AS strategy FROM pr),
dw AS (SELECT *, CASE strategy WHEN 'CLOUD_PRIORITY' THEN eid WHEN 'LAST_WRITE_WINS' THEN {LWW} WHEN 'MANUAL_REVIEW' THEN eid
    WHEN 'FIELD_MERGE' THEN CASE WHEN {OBJ} THEN CASE WHEN et>=it THEN eid ELSE iid END ELSE {LWW} END
    ELSE CASE rel WHEN 'BEFORE' THEN iid WHEN 'CONCURRENT' THEN {LWW} ELSE eid END END AS wid,
  CASE WHEN strategy='MANUAL_REVIEW' THEN 'CONFLICT_DETECTED' ELSE 'CONFLICT_RESOLVED' END AS wstatus,
  CASE WHEN strategy='MANUAL_REVIEW' THEN {TEXT.format(a='ea', z='ez')} ELSE {MERGED} END AS wclock FROM ds)"""


@query("resolve_dispatch", "aws azure", DISPATCH + """
SELECT "aggregateId", strategy, wid AS id, wstatus AS status, wclock AS clock FROM dw""")
def resolve_dispatch(spark, sf):
    r = R.resolve(pairs(spark, sf), CONFIG)
    return r.select("aggregateId", "strategy", F.col("resolved.id").alias("id"), F.col("resolved.syncStatus").alias("status"),
                    E.map_text("resolved.vectorClock").alias("clock"))


@query("conflict_counters", "aws azure", DISPATCH + f"""
SELECT counter, count(*) AS n FROM (
  SELECT CASE strategy WHEN 'CLOUD_PRIORITY' THEN 'cloud_priority' WHEN 'LAST_WRITE_WINS' THEN 'lww' WHEN 'MANUAL_REVIEW' THEN 'manual_review'
    WHEN 'FIELD_MERGE' THEN CASE WHEN {OBJ} THEN 'field_merge' ELSE 'lww' END ELSE 'vector_clock' END AS counter FROM dw
  UNION ALL SELECT 'lww' FROM dw WHERE strategy='HIGHEST_VECTOR_CLOCK' AND rel='CONCURRENT') GROUP BY counter""")
def conflict_counters(spark, sf):
    return R.conflict_counters(R.resolve(pairs(spark, sf), CONFIG))


@query("conflict_join", "aws azure", """
SELECT i."aggregateId", e.k IS NOT NULL AS "hasExisting", coalesce((i.c_aws>e.c_aws AND i.c_azure<e.c_azure)
  OR (i.c_aws<e.c_aws AND i.c_azure>e.c_azure), false) AS conflict FROM azure i LEFT JOIN aws e ON e.k=i.k""")
def conflict_join(spark, sf):
    return pairs(spark, sf, "left").select(
        "aggregateId", F.col("existing").isNotNull().alias("hasExisting"),
        F.coalesce(R.is_conflict(), F.lit(False)).alias("conflict"))


APPLY = DISPATCH + """, ap AS (SELECT i."tenantId", i."aggregateId",
  CASE WHEN dw.k IS NULL OR dw.rel<>'CONCURRENT' THEN 'UPSERT' WHEN dw.strategy='MANUAL_REVIEW' THEN 'REVIEW' ELSE 'RESOLVED' END AS action,
  CASE WHEN dw.k IS NULL OR dw.rel<>'CONCURRENT' THEN i.id ELSE dw.wid END AS id,
  CASE WHEN dw.k IS NULL OR dw.rel<>'CONCURRENT' THEN 'SYNCED' ELSE dw.wstatus END AS status,
  CASE WHEN dw.k IS NULL OR dw.rel<>'CONCURRENT' THEN 'aws=' || i.c_aws || ',azure=' || i.c_azure ELSE dw.wclock END AS clock
  FROM azure i LEFT JOIN dw ON dw.k=i.k)"""


@query("sync_apply", "aws azure", APPLY + """SELECT "aggregateId", action, id, status, clock FROM ap""")
def sync_apply(spark, sf):
    done = R.sync_apply(T.sync_copy(spark, sf, "azure"), T.sync_copy(spark, sf, "aws"), CONFIG)
    return done.select("aggregateId", "action", F.col("record.id").alias("id"), F.col("record.syncStatus").alias("status"),
                       E.map_text("record.vectorClock").alias("clock"))


# Versions of an aggregate applied one after the other onto its first version; MANUAL keeps what is stored.
CHAIN = """list_reduce(vs, lambda a, b: CASE
  WHEN (b.ca>=a.ca AND b.cz>=a.cz AND b.cg>=a.cg) OR (b.ca<=a.ca AND b.cz<=a.cz AND b.cg<=a.cg)
    THEN {'t': b.t, 'c': b.c, 'id': b.id, 'ca': b.ca, 'cz': b.cz, 'cg': b.cg, 's': 'SYNCED', 'y': b.y, 'n': a.n, 'm': a.m}
  WHEN a.y='RESTRICTED_DATA' THEN {'t': a.t, 'c': a.c, 'id': a.id, 'ca': a.ca, 'cz': a.cz, 'cg': a.cg, 's': a.s, 'y': a.y, 'n': a.n, 'm': a.m+1}
  WHEN CASE WHEN a.y='TENANT_CONFIG' THEN a.c='aws' ELSE a.t>b.t OR (a.t=b.t AND a.c>=b.c) END
    THEN {'t': a.t, 'c': a.c, 'id': a.id, 'ca': greatest(a.ca, b.ca), 'cz': greatest(a.cz, b.cz), 'cg': greatest(a.cg, b.cg), 's': 'CONFLICT_RESOLVED', 'y': a.y, 'n': a.n+1, 'm': a.m}
  ELSE {'t': b.t, 'c': b.c, 'id': b.id, 'ca': greatest(a.ca, b.ca), 'cz': greatest(a.cz, b.cz), 'cg': greatest(a.cg, b.cg), 's': 'CONFLICT_RESOLVED', 'y': b.y, 'n': a.n+1, 'm': a.m} END)"""
TYPED = """(['TENANT_CONFIG','AUDIT_RECORD','RESTRICTED_DATA','ORDER'])[CAST("aggregateId" AS BIGINT)%4+1]"""


@query("sync_apply_many", "ver", f"""
ls AS (SELECT "tenantId", "aggregateId", list({{'t': "wallClockTs", 'c': "sourceCloud", 'id': id, 'ca': c_aws, 'cz': c_azure, 'cg': c_gcp, 's': 'PENDING',
  'y': {TYPED}, 'n': 0, 'm': 0}} ORDER BY seq) AS vs FROM ver GROUP BY ALL),
fd AS (SELECT "aggregateId", len(vs)-1 AS changes, {CHAIN} AS w FROM ls WHERE len(vs)>1)
SELECT "aggregateId", changes, w.id AS id, w.s AS status, CAST(w.n AS BIGINT) AS "resolvedCount", CAST(w.m AS BIGINT) AS parked,
  concat_ws(',', CASE WHEN w.ca>0 THEN 'aws=' || w.ca END, CASE WHEN w.cz>0 THEN 'azure=' || w.cz END, CASE WHEN w.cg>0 THEN 'gcp=' || w.cg END) AS clock
FROM fd""")
def sync_apply_many(spark, sf):
    """Several changes of every aggregate in one batch, in arrival order."""
    types = F.array(*[F.lit(t) for t in ("TENANT_CONFIG", "AUDIT_RECORD", "RESTRICTED_DATA", "ORDER")])
    typed = T.versions(spark, sf).withColumns({
        "aggregateType": F.element_at(types, (F.col("aggregateId").cast("int") % 4) + 1),
        "payload": F.encode("id", "UTF-8"), "seq": F.col("id").cast("bigint")})
    first = typed.groupBy("tenantId", "aggregateId").agg(F.min("seq").alias("seq"))
    stored = typed.join(first, ["tenantId", "aggregateId", "seq"], "left_semi").drop("seq")
    later = typed.join(first, ["tenantId", "aggregateId", "seq"], "left_anti")
    done = R.sync_apply_many(later, stored, CONFIG, order=["seq"], step=8).done
    clock = F.map_filter("record.vectorClock", lambda _n, c: c > 0)
    return done.select("aggregateId", "changes", F.col("record.id").alias("id"), F.col("record.syncStatus").alias("status"),
                       "resolvedCount", F.col("parkedCount").alias("parked"), E.map_text(clock).alias("clock"))


@query("upsert_latest", "aws azure", APPLY + """
SELECT "aggregateId", id, status, clock FROM ap WHERE action<>'REVIEW'
UNION ALL SELECT "aggregateId", id, 'PENDING', 'aws=' || c_aws || ',azure=' || c_azure FROM aws
  WHERE "aggregateId" NOT IN (SELECT "aggregateId" FROM ap WHERE action<>'REVIEW')""")
def upsert_latest(spark, sf):
    store = T.sync_copy(spark, sf, "aws")
    done = R.sync_apply(T.sync_copy(spark, sf, "azure"), store, CONFIG)
    changes = cut_lineage(done.where(F.col("action") != "REVIEW").select("record.*"), "changes")
    return R.upsert_latest(store, changes).select(
        "aggregateId", "id", F.col("syncStatus").alias("status"), E.map_text("vectorClock").alias("clock"))


@query("sync_review_entries", "aws azure", APPLY + """
SELECT ap."tenantId", ap."aggregateId", to_base64(encode(z.payload)) AS "payloadB64", to_base64(encode(a.payload)) AS "competingPayloadB64",
  'CONFLICT_REVIEW' AS status FROM ap JOIN aws a ON a."aggregateId"=ap."aggregateId" JOIN azure z ON z."aggregateId"=ap."aggregateId"
WHERE action='REVIEW'""")
def sync_review_entries(spark, sf):
    done = R.sync_apply(T.sync_copy(spark, sf, "azure"), T.sync_copy(spark, sf, "aws"), CONFIG)
    return L.conflict_entries(done.where(F.col("action") == "REVIEW"), NOW).select(
        "tenantId", "aggregateId", "payloadB64", "competingPayloadB64", "status")


FOLD = """list_reduce(vs, lambda a, b: CASE
  WHEN a.ca<=b.ca AND a.cz<=b.cz AND a.cg<=b.cg THEN CASE WHEN a.ca=b.ca AND a.cz=b.cz AND a.cg=b.cg THEN a ELSE b END
  WHEN a.ca>=b.ca AND a.cz>=b.cz AND a.cg>=b.cg THEN a
  ELSE CASE WHEN a.t>b.t OR (a.t=b.t AND a.c>=b.c)
    THEN {'t': a.t, 'c': a.c, 'id': a.id, 'ca': greatest(a.ca, b.ca), 'cz': greatest(a.cz, b.cz), 'cg': greatest(a.cg, b.cg), 's': 'CONFLICT_RESOLVED'}
    ELSE {'t': b.t, 'c': b.c, 'id': b.id, 'ca': greatest(a.ca, b.ca), 'cz': greatest(a.cz, b.cz), 'cg': greatest(a.cg, b.cg), 's': 'CONFLICT_RESOLVED'} END END)"""


RESOLVE_ALL = f"""
ls AS (SELECT "tenantId", "aggregateId", list({{'t': "wallClockTs", 'c': "sourceCloud", 'id': id, 'ca': c_aws, 'cz': c_azure, 'cg': c_gcp, 's': 'PENDING'}}
  ORDER BY "wallClockTs", "sourceCloud", id) AS vs FROM ver GROUP BY ALL),
fd AS (SELECT "tenantId", "aggregateId", len(vs) AS versions, {FOLD} AS w FROM ls)
SELECT "tenantId", "aggregateId", versions, w.id AS id, w.c AS "sourceCloud", w.t AS "wallClockTs", w.s AS "syncStatus",
  concat_ws(',', CASE WHEN w.ca>0 THEN 'aws=' || w.ca END, CASE WHEN w.cz>0 THEN 'azure=' || w.cz END, CASE WHEN w.cg>0 THEN 'gcp=' || w.cg END) AS "vectorClock"
FROM fd"""


@query("resolve_all", "ver", RESOLVE_ALL)
def resolve_all(spark, sf):
    return R.resolve_all(T.versions(spark, sf)).withColumn("vectorClock", E.map_text("vectorClock"))


# ---- consistency ---------------------------------------------------------------------------------

VERDICT = """asked AS (SELECT 'tenant-' || (o_custkey%8) AS "tenantId", CAST(o_orderkey AS VARCHAR) AS "aggregateId", o_orderkey AS pos FROM orders
  UNION ALL SELECT 'tenant-' || (c_custkey%10), 'c-' || c_custkey, 1000000000000+c_custkey FROM customer),
vd AS (SELECT q.*, CASE WHEN a.k IS NULL AND z.k IS NULL THEN 'CONSISTENT' WHEN a.k IS NULL OR z.k IS NULL THEN 'GAP'
  WHEN sha256(a.payload)=sha256(z.payload) THEN 'CONSISTENT' ELSE 'MISMATCH' END AS verdict
  FROM asked q LEFT JOIN aws a ON a."tenantId"=q."tenantId" AND a."aggregateId"=q."aggregateId"
  LEFT JOIN azure z ON z."tenantId"=q."tenantId" AND z."aggregateId"=q."aggregateId")"""
REPORT = """"tenantId", count(*) AS "sampledRecords", count(*) FILTER (WHERE verdict='CONSISTENT') AS "consistentRecords",
  count(*) FILTER (WHERE verdict<>'CONSISTENT') AS "divergedRecords",
  round(count(*) FILTER (WHERE verdict='CONSISTENT')*100.0/count(*), 6) AS "consistencyPercent\""""


def _requests(spark, sf):
    orders = T.table(spark, sf, "orders").select(
        T.tenant(F.col("o_custkey")).alias("tenantId"), F.col("o_orderkey").cast("string").alias("aggregateId"),
        F.col("o_orderkey").alias("pos"))
    absent = T.table(spark, sf, "customer").select(
        F.concat(F.lit("tenant-"), (F.col("c_custkey") % 10).cast("string")).alias("tenantId"),
        F.concat(F.lit("c-"), F.col("c_custkey").cast("string")).alias("aggregateId"),
        (F.lit(1000000000000) + F.col("c_custkey")).alias("pos"))
    return orders.unionByName(absent)


def _verdicts(spark, sf):
    return R.verdicts(_requests(spark, sf), T.sync_copy(spark, sf, "aws"), T.sync_copy(spark, sf, "azure"))


@query("consistency_join", "aws azure", VERDICT + """SELECT "tenantId", "aggregateId", verdict FROM vd""")
def consistency_join(spark, sf):
    return _verdicts(spark, sf)


@query("consistency_report", "aws azure", VERDICT + f""", rp AS (SELECT {REPORT} FROM vd GROUP BY "tenantId"),
tn AS (SELECT 'tenant-' || n_nationkey AS "tenantId" FROM nation)
SELECT tn."tenantId", coalesce("sampledRecords", 0) AS "sampledRecords", coalesce("consistentRecords", 0) AS "consistentRecords",
  coalesce("divergedRecords", 0) AS "divergedRecords", coalesce("consistencyPercent", 100.0) AS "consistencyPercent"
FROM tn LEFT JOIN rp ON tn."tenantId"=rp."tenantId\"""")
def consistency_report(spark, sf):
    report = R.consistency_report(_verdicts(spark, sf))
    tenants = T.table(spark, sf, "nation").select(F.concat(F.lit("tenant-"), F.col("n_nationkey").cast("string")).alias("tenantId"))
    return R.tenant_percent(report, tenants).withColumn("consistencyPercent", F.round("consistencyPercent", 6))


@query("consistency_tree", "aws azure", VERDICT + """SELECT "tenantId", "aggregateId", verdict FROM vd""")
def consistency_tree(spark, sf):
    """The same verdicts from two stored copies, reading only the key ranges whose digests differ."""
    path = shared_dir(spark, "copies")
    for cloud in ("aws", "azure"):
        DG.write_copy(T.sync_copy(spark, sf, cloud), f"{path}/{cloud}")
    return DG.compare_copies(_requests(spark, sf), f"{path}/aws", f"{path}/azure")


@query("consistency_sample", "aws azure", VERDICT + f""", sm AS (SELECT *, count(*) OVER (PARTITION BY "tenantId") AS asked_n FROM vd QUALIFY row_number() OVER (PARTITION BY "tenantId" ORDER BY pos)<=100)
SELECT {REPORT}, max(asked_n) AS "requestedRecords", coalesce(string_agg("aggregateId", ',' ORDER BY "aggregateId") FILTER (WHERE verdict<>'CONSISTENT'), '') AS "divergedAggregateIds"
FROM sm GROUP BY "tenantId\"""")
def consistency_sample(spark, sf):
    report = R.sampled_report(_requests(spark, sf), T.sync_copy(spark, sf, "aws"), T.sync_copy(spark, sf, "azure"), "pos", 100)
    return report.withColumns({"consistencyPercent": F.round("consistencyPercent", 6),
                               "divergedAggregateIds": F.array_join("divergedAggregateIds", ",")})


@query("divergence_counts", "aws azure", VERDICT + """SELECT CASE verdict WHEN 'GAP' THEN 'missing_in_cloud' ELSE 'payload_mismatch' END AS reason,
  count(*) AS n FROM vd WHERE verdict<>'CONSISTENT' GROUP BY ALL""")
def divergence_counts(spark, sf):
    return R.divergence_counts(_verdicts(spark, sf))


@query("replication_lag", "aws azure", """
ob AS (SELECT 'aws' AS cloud, "wallClockTs" AS w, k FROM aws UNION ALL SELECT 'azure', "wallClockTs", k FROM azure),
la AS (SELECT cloud, arg_max(w, k) AS last FROM ob GROUP BY cloud),
nw AS (SELECT 996537600000 AS now),
cl AS (SELECT unnest(['aws','azure','gcp']) AS cloud)
SELECT cl.cloud, last AS "lastSyncTs", CASE WHEN last IS NULL THEN -1.0::DOUBLE ELSE greatest(0.0::DOUBLE, (now-last)/1000.0::DOUBLE) END AS "lagSeconds",
  coalesce(greatest(0.0, (now-last)/1000.0)>300, false) AS "rpoBreach" FROM cl LEFT JOIN la ON la.cloud=cl.cloud CROSS JOIN nw""".replace(
    "CROSS JOIN nw", ", nw"))
def replication_lag(spark, sf):
    seen = lambda c: T.sync_copy(spark, sf, c).select(
        F.lit(c).alias("cloud"), "wallClockTs", F.col("aggregateId").cast("bigint").alias("observedAt"))
    syncs = seen("aws").unionByName(seen("azure"))
    return R.replication_lag(syncs, ["aws", "azure", "gcp"], 996_537_600_000)  # 2001-07-31
