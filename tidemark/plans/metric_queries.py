"""Metric rollups, alerts, alarms and traces."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import events as E
from tidemark.operators import aggregates as A
from tidemark.operators import metrics as M
from tidemark.operators import traces as TR
from tidemark.plans.registry import query
from tidemark.sources import adapter as T

HOUR = 3_600_000
BOUNDS = [50.0, 100.0, 200.0, 300.0, 400.0]


def values(rows: list[tuple]) -> str:
    lit = lambda v: f"'{v}'" if isinstance(v, str) else f"CAST({v} AS DOUBLE)" if isinstance(v, float) else str(v)
    return "VALUES " + ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)


BREACH = "CASE op WHEN '>' THEN value>threshold WHEN '<' THEN value<threshold ELSE value=threshold END"


@query("metric_rollup", "ev", """
SELECT classification, "createdAt"//60000*60000 AS "windowStart", count(*) AS n, CAST(sum("payloadSizeBytes") AS BIGINT) AS total,
  quantile_disc("payloadSizeBytes", 0.5) AS p50, quantile_disc("payloadSizeBytes", 0.95) AS p95, quantile_disc("payloadSizeBytes", 0.99) AS p99
FROM ev GROUP BY ALL""")
def metric_rollup(spark, sf):
    return A.metric_rollup(T.data_events(spark, sf), ("classification",), "payloadSizeBytes", "createdAt")


@query("alert_threshold_for", "gauges", f"""
rules(alert, metric, op, threshold, held, severity) AS ({values(M.ALERTS)}),
s AS (SELECT g.*, r.alert, r.severity, r.held, {BREACH} AS bad FROM gauges g JOIN rules r ON g.metric=r.metric),
i AS (SELECT *, count(*) FILTER (WHERE NOT bad) OVER (PARTITION BY alert, series ORDER BY ts, seq) AS island FROM s)
SELECT alert, severity, series, min(ts) AS "startAt", max(ts) AS "endAt", count(*) AS samples, max(value) AS peak, min(ts)+held*1000 AS "firedAt"
FROM i WHERE bad GROUP BY alert, severity, series, held, island HAVING max(ts)-min(ts)>=held*1000""")
def alert_threshold_for(spark, sf):
    return M.threshold_alerts(T.gauge_samples(spark, sf))


@query("alert_threshold_gaps", "gauges", f"""
rules(alert, metric, op, threshold, held, severity) AS ({values(M.ALERTS)}),
s AS (SELECT g.*, r.alert, r.severity, r.held, {BREACH} AS bad FROM gauges g JOIN rules r ON g.metric=r.metric),
q AS (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY alert, series ORDER BY ts, seq) > {HOUR}, false) AS gap FROM s),
i AS (SELECT *, count(*) FILTER (WHERE gap OR NOT bad) OVER (PARTITION BY alert, series ORDER BY ts, seq) AS island FROM q)
SELECT alert, severity, series, min(ts) AS "startAt", max(ts) AS "endAt", count(*) AS samples, max(value) AS peak, min(ts)+held*1000 AS "firedAt"
FROM i WHERE bad GROUP BY alert, severity, series, held, island HAVING max(ts)-min(ts)>=held*1000""")
def alert_threshold_gaps(spark, sf):
    """An hour without a sample ends what was held."""
    return M.threshold_alerts(T.gauge_samples(spark, sf), max_gap=HOUR)


RATE = f"""d AS (SELECT series, ts//{HOUR}*{HOUR} AS ws, value, coalesce(lag(value) OVER (PARTITION BY series ORDER BY ts, seq), value) AS p FROM counters),
rt AS (SELECT series, ws AS "windowStart", sum(CASE WHEN value>=p THEN value-p ELSE value END) AS increase FROM d GROUP BY ALL)"""


@query("counter_rate", "counters", RATE + f"""
SELECT series, "windowStart", increase, round(increase/{HOUR / 1000}, 6) AS rate, increase/{HOUR / 1000}>0.05 AS "failing" FROM rt""")
def counter_rate(spark, sf):
    rates = M.counter_rate(T.counter_samples(spark, sf), ["series"], HOUR)
    return rates.withColumn("failing", F.col("rate") > M.SAGA_FAILURES_PER_SECOND).withColumn("rate", F.round("rate", 6))


STEP, RANGE = HOUR, 6 * HOUR


@query("counter_rate_sliding", "counters", f"""
s AS (SELECT *, lag(value) OVER w AS p, lag(ts) OVER w AS pt FROM counters WINDOW w AS (PARTITION BY series ORDER BY ts, seq)),
e AS (SELECT *, unnest(range((ts+{STEP - 1})//{STEP}*{STEP}, ts+{RANGE}, {STEP})) AS t FROM s),
g AS (SELECT series, t AS "evalTs", count(*) AS samples, min(ts) AS a, max(ts) AS z, arg_min(value, (ts, seq)) AS f, arg_max(value, (ts, seq)) AS l,
  sum(CASE WHEN value<p AND pt>t-{RANGE} THEN p ELSE 0 END) AS lost FROM e GROUP BY series, t HAVING max(ts)>min(ts)),
i AS (SELECT *, l-f+lost AS increase, (z-a)/1000.0 AS s, (z-a)/1000.0/(samples-1) AS m, (a-("evalTs"-{RANGE}))/1000.0 AS lo, ("evalTs"-z)/1000.0 AS hi FROM g),
x AS (SELECT *, CASE WHEN lo<m*1.1 THEN lo ELSE m/2 END AS lo2, CASE WHEN hi<m*1.1 THEN hi ELSE m/2 END AS hi2 FROM i)
SELECT series, "evalTs", samples, increase, round(increase*((s+hi2+CASE WHEN increase>0 AND f>=0 THEN least(lo2, s*f/increase) ELSE lo2 END)/s)/{RANGE / 1000}, 6) AS rate FROM x""")
def counter_rate_sliding(spark, sf):
    """The rate of the last six hours at every full hour."""
    return M.counter_rate_sliding(T.counter_samples(spark, sf), ["series"], RANGE, STEP).withColumn("rate", F.round("rate", 6))


ALERT_LOOKBACK = 300_000


CHANGES = f"""
rules(alert, metric, op, threshold, held, severity) AS ({values(M.ALERTS)}),
s AS (SELECT g.*, r.alert, r.severity, r.held, coalesce({BREACH}, false) AS bad FROM gauges g JOIN rules r ON g.metric=r.metric),
q AS (SELECT *, coalesce(ts - lag(ts) OVER w > {ALERT_LOOKBACK}, false) AS gap, lead(ts) OVER w AS nt, lead(value) OVER w AS nv
  FROM s WINDOW w AS (PARTITION BY alert, series ORDER BY ts, seq)),
i AS (SELECT *, count(*) FILTER (WHERE gap OR NOT bad) OVER (PARTITION BY alert, series ORDER BY ts, seq) AS island FROM q),
r AS (SELECT alert, severity, series, held*1000 AS wait, min(ts) AS a, arg_min(value, (ts, seq)) AS f, arg_max(
  CASE WHEN nt IS NULL OR nt>ts+{ALERT_LOOKBACK} THEN {{'u': ts+{ALERT_LOOKBACK}, 'v': NULL}} ELSE {{'u': nt, 'v': nv}} END, (ts, seq)) AS z
  FROM i WHERE bad GROUP BY alert, severity, series, held, island)
SELECT alert, severity, series, 'PENDING' AS state, a AS at, f AS value FROM r
UNION ALL SELECT alert, severity, series, 'FIRING', a+wait, NULL FROM r WHERE wait=0 OR z.u>a+wait
UNION ALL SELECT alert, severity, series, 'RESOLVED', z.u, z.v FROM r WHERE wait=0 OR z.u>a+wait"""


@query("alert_changes", "gauges", CHANGES)
def alert_changes(spark, sf):
    return M.alert_changes(T.gauge_samples(spark, sf), lookback_ms=ALERT_LOOKBACK)


@query("ratio_alert", "http", f"""
w AS (SELECT "tenantId", ts//{HOUR}*{HOUR} AS ws, count(*) FILTER (WHERE status>=500) AS e, count(*) AS n FROM http
  WHERE uri LIKE '/api/%' GROUP BY ALL),
g AS (SELECT *, e*1.0/n AS ratio, coalesce(ws - lag(ws) OVER (PARTITION BY "tenantId" ORDER BY ws) > {HOUR}, false) AS gap FROM w),
i AS (SELECT *, count(*) FILTER (WHERE gap OR NOT ratio>0.01) OVER (PARTITION BY "tenantId" ORDER BY ws) AS island FROM g)
SELECT "tenantId", min(ws) AS "startAt", max(ws)+{HOUR} AS "endAt", count(*) AS samples, round(max(ratio), 6) AS peak, 'ingestion_error_rate_high' AS alert,
  'warning' AS severity, min(ws)+300000 AS "firedAt" FROM i WHERE ratio>0.01 GROUP BY "tenantId", island HAVING max(ws)+{HOUR}-min(ws)>=300000""")
def ratio_alert(spark, sf):
    requests = T.http_requests(spark, sf).where(F.col("uri").like("/api/%")).withColumn("windowStart", E.window_start("ts", HOUR))
    per = lambda cond: requests.groupBy("tenantId", "windowStart").agg((E.count_if(cond) / F.lit(HOUR / 1000.0)).alias("rate"))
    ratios = M.ratio(per(F.col("status") >= 500), per(F.lit(True)), ["tenantId", "windowStart"])
    return M.ratio_alerts(ratios, ["tenantId"], M.RATIO_ALERTS[0], HOUR).withColumn("peak", F.round("peak", 6))


def _gauge_alert(short: str, rule: tuple, sql_ratio: str, ratio):
    """A ratio rule over gauges of the source systems in windows of ten minutes."""
    name, op, threshold, held, severity = rule
    span, worst = 600_000, "min" if op == "<" else "max"

    @query(f"ratio_alert_{short}", "ev", f"""
w AS (SELECT "sourceSystem", "createdAt"//{span}*{span} AS ws, {sql_ratio} AS ratio FROM ev GROUP BY ALL),
g AS (SELECT *, coalesce(ws - lag(ws) OVER (PARTITION BY "sourceSystem" ORDER BY ws) > {span}, false) AS gap FROM w),
i AS (SELECT *, count(*) FILTER (WHERE gap OR NOT ratio{op}{threshold}) OVER (PARTITION BY "sourceSystem" ORDER BY ws) AS island FROM g)
SELECT "sourceSystem", min(ws) AS "startAt", max(ws)+{span} AS "endAt", count(*) AS samples, round({worst}(ratio), 6) AS peak, '{name}' AS alert,
  '{severity}' AS severity, min(ws)+{held * 1000} AS "firedAt" FROM i WHERE ratio{op}{threshold} GROUP BY "sourceSystem", island
  HAVING max(ws)+{span}-min(ws)>={held * 1000}""")
    def run(spark, sf):
        per = T.data_events(spark, sf).groupBy("sourceSystem", E.window_start("createdAt", span).alias("windowStart")).agg(ratio().alias("ratio"))
        return M.ratio_alerts(per, ["sourceSystem"], rule, span).withColumn("peak", F.round("peak", 6))


_gauge_alert("bulkhead", M.RATIO_ALERTS[1], "min(value)/250.0", lambda: F.min("value") / 250.0)
_gauge_alert("heap", M.RATIO_ALERTS[2], "max(value)/150.0", lambda: F.max("value") / 150.0)
_gauge_alert("gc_pause", M.RATIO_ALERTS[3], 'sum("enrichmentLatencyMs")/2000.0', lambda: F.sum("enrichmentLatencyMs") / 2000.0)


CASES = " UNION ALL ".join(
    f"""SELECT "tenantId", date, CAST({b} AS DOUBLE) AS le, CAST(count(*) FILTER (WHERE "enrichmentLatencyMs"<={b}) AS DOUBLE) AS c FROM ev GROUP BY ALL"""
    for b in BOUNDS) + """ UNION ALL SELECT "tenantId", date, CAST('inf' AS DOUBLE), CAST(count(*) AS DOUBLE) FROM ev GROUP BY ALL"""


@query("histogram_quantile", "ev", f"""
b AS ({CASES}),
p AS (SELECT *, coalesce(lag(le) OVER w, 0.0) AS lo, coalesce(lag(c) OVER w, 0.0) AS below, 0.7*max(c) OVER (PARTITION BY "tenantId", date) AS rk
  FROM b WINDOW w AS (PARTITION BY "tenantId", date ORDER BY le)),
h AS (SELECT *, row_number() OVER (PARTITION BY "tenantId", date ORDER BY le) AS rn FROM p WHERE c>=rk)
SELECT "tenantId", date, round(CASE WHEN isinf(le) THEN lo ELSE lo+(le-lo)*(rk-below)/(c-below) END, 6) AS quantile FROM h WHERE rn=1""")
def histogram_quantile(spark, sf):
    ev = T.data_events(spark, sf).withColumn("date", E.utc_date("createdAt").cast("string"))
    buckets = M.to_buckets(ev, ["tenantId", "date"], "enrichmentLatencyMs", BOUNDS)
    return M.histogram_quantile(buckets, ["tenantId", "date"], 0.7).withColumn("quantile", F.round("quantile", 6))


ALARM_METRICS = [("CPUUtilization", 1.0), ("ReplicaLag", 0.5), ("events.rejected", 1.0), ("sync.errors", 0.1),
                 ("ServiceAvailability", 2.0), ("ReplicationLatency", 60.0)]


ALARM_SQL = f"""
alarms(alarm, metric, statistic, period, op, threshold, periods) AS ({values(M.ALARMS)}),
m(metric, f) AS ({values(ALARM_METRICS)}),
s AS (SELECT a.*, 'all' AS series, ev."createdAt"//(period*1000) AS pd, ev.value*m.f AS v FROM ev, m JOIN alarms a ON a.metric=m.metric),
g AS (SELECT alarm, op, threshold, period, periods, series, pd, CASE min(statistic) WHEN 'Sum' THEN sum(v) WHEN 'Average' THEN avg(v)
  WHEN 'Minimum' THEN min(v) ELSE max(v) END AS value FROM s GROUP BY alarm, op, threshold, period, periods, series, pd),
b AS (SELECT *, {BREACH} AS breaching FROM g),
c AS (SELECT b.*, CAST(b.breaching AS INT) + CASE WHEN b.periods>=2 AND coalesce(x.breaching, false) THEN 1 ELSE 0 END
  + CASE WHEN b.periods>=3 AND coalesce(y.breaching, false) THEN 1 ELSE 0 END AS hits
  FROM b LEFT JOIN b x ON x.alarm=b.alarm AND x.pd=b.pd-1 LEFT JOIN b y ON y.alarm=b.alarm AND y.pd=b.pd-2)
SELECT alarm, series, pd*period*1000 AS "periodStart", round(value, 6) AS value, breaching, hits=periods AS "inAlarm" FROM c
UNION ALL SELECT alarm, series, (pd+1)*period*1000, NULL, false, false FROM c WHERE hits=periods
  AND NOT EXISTS (SELECT 1 FROM b WHERE b.alarm=c.alarm AND b.pd=c.pd+1)"""


def alarm_samples(spark, sf):
    factors = F.array(*[F.struct(F.lit(n).alias("metric"), F.lit(f).alias("f")) for n, f in ALARM_METRICS])
    return (T.data_events(spark, sf).select(F.col("createdAt").alias("ts"), "value", F.explode(factors).alias("m"))
            .select("m.metric", F.lit("all").alias("series"), "ts", (F.col("value") * F.col("m.f")).alias("value")))


@query("alarm_eval_periods", "ev", ALARM_SQL)
def alarm_eval_periods(spark, sf):
    return M.alarm_states(alarm_samples(spark, sf)).withColumn("value", F.round("value", 6))


TAIL = """
h AS (SELECT * FROM spans WHERE route NOT IN ('/health','/metrics')),
t AS (SELECT "traceId" FROM h GROUP BY "traceId" HAVING bool_or("statusCode"='ERROR') OR max("endMs")-min("startMs")>=2000 OR "traceId"%100<10)
SELECT "traceId", "spanId", "statusCode" FROM h WHERE "traceId" IN (SELECT "traceId" FROM t)"""


@query("tail_sample", "spans", TAIL)
def tail_sample(spark, sf):
    return TR.tail_sample(T.spans(spark, sf), F.col("traceId") % 100).select("traceId", "spanId", "statusCode")


@query("span_attributes", "spans", """
SELECT "spanId", 'deployment.environment=' || coalesce(env, 'prod') || ',http.route=' || route || ',service.namespace=tidemark' AS attributes FROM spans""")
def span_attributes(spark, sf):
    return TR.span_attributes(T.spans(spark, sf), "tidemark", "prod").select("spanId", E.map_text("attributes").alias("attributes"))
