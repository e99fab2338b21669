import itertools
import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark import schema as S
from tidemark.functions import clocks as C
from tidemark.operators import lifecycle as L
from tidemark.operators import reconcile as R

FIELDS = "id string, tenantId string, aggregateType string, aggregateId string, sourceCloud string, payload binary, vectorClock map<string,bigint>, wallClockTs bigint, schemaVersion int, syncStatus string"


def record(cloud, ts, clock, payload=b"{}", kind="INVOICE", agg="doc-7"):
    return (f"{agg}@{cloud}", "tenant-1", kind, agg, cloud, payload, clock, ts, 1, "SYNCED")


def settle(spark, strategy, local, remote):
    pairs = R.pair(spark.createDataFrame([remote], FIELDS), spark.createDataFrame([local], FIELDS), "inner")
    return R.resolve_with(pairs, strategy).first()["resolved"]


CLOCKS = {"EQUAL": ({"n1": 4, "n2": 7}, {"n1": 4, "n2": 7}), "BEFORE": ({"n1": 4}, {"n1": 5, "n2": 1}),
          "AFTER": ({"n1": 6, "n3": 2}, {"n3": 2}), "CONCURRENT": ({"n1": 9, "n2": 3}, {"n1": 8, "n2": 4})}
TIMES = [(1_700_000_300, 1_700_000_120), (1_700_000_120, 1_700_000_300), (1_700_000_120, 1_700_000_120)]


def expected(strategy, rel, ta, tb):
    """Side that stays, status and clock by the plain rules."""
    left, right = CLOCKS[rel]
    newer = "aws" if ta > tb else "azure"  # of equal times the larger cloud name
    side = {"LAST_WRITE_WINS": newer, "CLOUD_PRIORITY": "aws", "MANUAL_REVIEW": "aws", "FIELD_MERGE": newer,
            "HIGHEST_VECTOR_CLOCK": {"BEFORE": "azure", "CONCURRENT": newer}.get(rel, "aws")}[strategy]
    if strategy == "MANUAL_REVIEW":
        return side, "CONFLICT_DETECTED", left
    return side, "CONFLICT_RESOLVED", {n: max(left.get(n, 0), right.get(n, 0)) for n in {*left, *right}}


@pytest.mark.parametrize("strategy", ["LAST_WRITE_WINS", "HIGHEST_VECTOR_CLOCK", "CLOUD_PRIORITY", "FIELD_MERGE", "MANUAL_REVIEW"])
def test_strategies_under_every_clock_relation(spark, strategy):
    cases = [(rel, ta, tb) for rel in CLOCKS for ta, tb in TIMES]
    name = lambda i: f"invoice-{i:02d}"
    local = [record("aws", ta, CLOCKS[rel][0], b"left", "INVOICE", name(i)) for i, (rel, ta, _) in enumerate(cases)]
    remote = [record("azure", tb, CLOCKS[rel][1], b"right", "INVOICE", name(i)) for i, (rel, _, tb) in enumerate(cases)]
    pairs = R.pair(spark.createDataFrame(remote, FIELDS), spark.createDataFrame(local, FIELDS), "inner")
    got = {r["resolved"]["aggregateId"]: r["resolved"] for r in R.resolve_with(pairs, strategy).collect()}
    for i, case in enumerate(cases):
        r = got[name(i)]
        assert (r["sourceCloud"], r["syncStatus"], r["vectorClock"]) == expected(strategy, *case), case


def merged(spark, a, b, ta=200, tb=100):
    got = settle(spark, "FIELD_MERGE", record("aws", ta, {}, a), record("azure", tb, {}, b))
    return got


def test_field_merge(spark):
    got = merged(spark, b'{"street":"Elm","no":17}', b'{"zip":"04109"}')
    assert json.loads(bytes(got["payload"])) == {"street": "Elm", "no": 17, "zip": "04109"}
    assert got["syncStatus"] == "CONFLICT_RESOLVED" and got["wallClockTs"] == 200


def test_field_merge_keeps_types_and_picks_newer_field(spark):
    a, b = b'{"n":1,"o":{"x":[1,2]},"s":"l","z":null}', b'{"n":2.5,"o":{"x":[1,2]},"s":"r","t":true}'
    assert json.loads(bytes(merged(spark, a, b)["payload"])) == {"n": 1, "o": {"x": [1, 2]}, "s": "l", "z": None, "t": True}
    tie = merged(spark, a, b, 100, 100)
    assert json.loads(bytes(tie["payload"])) == {"n": 2.5, "o": {"x": [1, 2]}, "s": "r", "z": None, "t": True}
    assert tie["sourceCloud"] == "aws"


def test_field_merge_json_null_is_a_value(spark):
    assert json.loads(bytes(merged(spark, b'{"a":null}', b'{"a":1}')["payload"])) == {"a": None}
    assert json.loads(bytes(merged(spark, b'{"a":null}', b'{"a":1}', 100, 200)["payload"])) == {"a": 1}
    assert json.loads(bytes(merged(spark, b'{"a":1}', b'{"a":null}', 100, 200)["payload"])) == {"a": None}


@pytest.mark.parametrize("a,b", [(b"\xff\xfe\xfd", b"plain text"), (b"[1]", b'{"a":1}'), (b'{"a":1}', b"3"), (b"", b"{}"), (None, b"{}")])
def test_field_merge_falls_back_to_last_write(spark, a, b):
    got = merged(spark, a, b)
    assert got["sourceCloud"] == "aws"
    assert (None if got["payload"] is None else bytes(got["payload"])) == a


def test_strategy_configuration(spark):
    config = {"TENANT_CONFIG": "cloud_priority", "BAD": "NO_SUCH"}
    df = spark.createDataFrame([("tenant_config",), ("BAD",), ("OTHER",), (None,)], "t string")
    got = [r[0] for r in df.select(R.strategy_for(F.col("t"), config)).collect()]
    assert got == ["CLOUD_PRIORITY"] + ["HIGHEST_VECTOR_CLOCK"] * 3


# ---- clock laws ----------------------------------------------------------------------------------

def before_or_equal(a, b):
    return all(a.get(n, 0) <= b.get(n, 0) for n in {*a, *b})


def relation(a, b):
    le, ge = before_or_equal(a, b), before_or_equal(b, a)
    return "EQUAL" if le and ge else "BEFORE" if le else "AFTER" if ge else "CONCURRENT"


def test_clock_laws(spark):
    rnd = random.Random(1)
    clock = lambda: {n: rnd.randrange(0, 3) for n in "abc" if rnd.random() < 0.7}
    data = [(i, clock(), clock(), clock()) for i in range(500)]
    df = spark.createDataFrame(data, "i int, a map<string,bigint>, b map<string,bigint>, c map<string,bigint>")
    out = df.select("*", C.merge("a", "b").alias("ab"), C.merge("b", "a").alias("ba"), C.merge(C.merge("a", "b"), "c").alias("ab_c"),
                    C.merge("a", C.merge("b", "c")).alias("a_bc"), C.merge("a", "a").alias("aa"), C.compare("a", "b").alias("r"),
                    C.compare("b", "a").alias("s"), C.compare("a", C.merge("a", "b")).alias("up"), C.increment("a", "a").alias("inc")).collect()
    mirror = {"EQUAL": "EQUAL", "BEFORE": "AFTER", "AFTER": "BEFORE", "CONCURRENT": "CONCURRENT"}
    for r in out:
        assert r["ab"] == r["ba"] and r["ab_c"] == r["a_bc"] and r["aa"] == r["a"]
        assert r["r"] == relation(r["a"], r["b"]) and r["s"] == mirror[r["r"]]
        assert r["up"] in ("EQUAL", "BEFORE")
        assert r["inc"]["a"] == r["a"].get("a", 0) + 1


@pytest.mark.parametrize("a,b,want", [({}, {}, "EQUAL"), ({"a": 1}, {}, "AFTER"), ({"a": 0}, {}, "EQUAL"), (None, {"a": 1}, "BEFORE")])
def test_clock_edges(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a map<string,bigint>, b map<string,bigint>")
    assert df.select(C.compare("a", "b")).first()[0] == want


# ---- many versions -------------------------------------------------------------------------------

def fold(versions):
    """Pairwise, left to right, as the definition says."""
    def step(a, b):
        rel = relation(a["clock"], b["clock"])
        if rel == "BEFORE":
            return b
        if rel in ("AFTER", "EQUAL"):
            return a
        win = a if (a["ts"], a["cloud"]) >= (b["ts"], b["cloud"]) else b
        return {**win, "status": "CONFLICT_RESOLVED", "clock": {n: max(a["clock"].get(n, 0), b["clock"].get(n, 0)) for n in {*a["clock"], *b["clock"]}}}
    state = versions[0]
    for v in versions[1:]:
        state = step(state, v)
    return state


@pytest.mark.parametrize("copies", [1, 3, 16])
def test_resolve_all_equals_sequential_fold(spark, copies):
    rnd = random.Random(copies)
    data, want = [], {}
    for agg in range(120):
        versions = []
        for v in range(rnd.choice([1, 2, 3, 5, 9])):
            clock = {n: rnd.randrange(0, 4) for n in ("aws", "azure", "gcp") if rnd.random() < 0.75}
            versions.append({"ts": rnd.randrange(0, rnd.choice([1, 5])), "cloud": rnd.choice(["aws", "azure"]), "id": f"{agg}-{v}", "clock": clock,
                             "status": rnd.choice(["SYNCED", "PENDING"])})
        data += [("t", str(agg), v["id"], v["cloud"], v["clock"], v["ts"], v["status"]) for v in versions]
        f = fold(sorted(versions, key=lambda v: (v["ts"], v["cloud"], v["id"])))
        want[str(agg)] = (f["id"], f["cloud"], f["ts"], f["status"], {n: c for n, c in f["clock"].items() if c > 0}, len(versions))
    df = spark.createDataFrame(data, "tenantId string, aggregateId string, id string, sourceCloud string, vectorClock map<string,bigint>, wallClockTs bigint, syncStatus string")
    got = {r["aggregateId"]: (r["id"], r["sourceCloud"], r["wallClockTs"], r["syncStatus"], r["vectorClock"], r["versions"])
           for r in R.resolve_all(df, copies).collect()}
    assert got == want


# ---- consistency ---------------------------------------------------------------------------------

def check(spark, aws, azure, ids=("agg-1",)):
    copy = lambda items: spark.createDataFrame([("t", k, v) for k, v in items.items()], "tenantId string, aggregateId string, payload binary")
    asked = spark.createDataFrame([("t", i) for i in ids], "tenantId string, aggregateId string")
    return R.verdicts(asked, copy(aws), copy(azure))


@pytest.mark.parametrize("aws,azure,verdict", [
    ({"agg-1": b"\x01\x02"}, {"agg-1": b"\x01\x02"}, "CONSISTENT"),
    ({"agg-1": b"\x01\x02"}, {"agg-1": b"\x03\x04"}, "MISMATCH"),
    ({"agg-1": b"\x01"}, {}, "GAP"),
    ({}, {}, "CONSISTENT"),
    ({"agg-1": None}, {"agg-1": b""}, "CONSISTENT"),
    ({"agg-1": None}, {}, "GAP"),
])
def test_verdicts(spark, aws, azure, verdict):
    assert [r["verdict"] for r in check(spark, aws, azure).collect()] == [verdict]


def test_nothing_to_check_is_fully_consistent(spark):
    tenants = spark.createDataFrame([("t",)], "tenantId string")
    got = R.tenant_percent(R.consistency_report(check(spark, {}, {}, ()).limit(0)), tenants).first()
    assert (got["sampledRecords"], got["consistencyPercent"]) == (0, 100.0)


def test_sample_takes_the_first_ids(spark):
    asked = spark.createDataFrame([("t", f"a{i}", i) for i in range(5)], "tenantId string, aggregateId string, pos int")
    none = spark.createDataFrame([], "tenantId string, aggregateId string, payload binary")
    one = spark.createDataFrame([("t", "a1", b"x"), ("t", "a4", b"x")], "tenantId string, aggregateId string, payload binary")
    got = R.sampled_report(asked, one, none, "pos", 2).first()
    assert (got["sampledRecords"], got["divergedRecords"], got["divergedAggregateIds"], got["consistencyPercent"]) == (2, 1, ["a1"], 50.0)


def test_lag_is_never_negative_and_unknown_is_minus_one(spark):
    syncs = spark.createDataFrame([("aws", 1000, 1), ("aws", 500_000, 2), ("azure", 900_000, 1)], "cloud string, wallClockTs bigint, observedAt bigint")
    got = {r["cloud"]: (r["lagSeconds"], r["rpoBreach"]) for r in R.replication_lag(syncs, ["aws", "azure", "gcp"], 801_000).collect()}
    assert got == {"aws": (301.0, True), "azure": (0.0, False), "gcp": (-1.0, False)}


def test_apply_parks_manual_conflicts(spark):
    old = [record("aws", 10, {"aws": 2}, kind="RESTRICTED_DATA", agg="r"), record("aws", 10, {"aws": 1}, kind="ORDER", agg="o")]
    new = [record("azure", 20, {"azure": 1}, kind="RESTRICTED_DATA", agg="r"), record("azure", 20, {"aws": 1, "azure": 1}, kind="ORDER", agg="o"),
           record("azure", 5, {"azure": 1}, agg="n")]
    done = R.sync_apply(spark.createDataFrame(new, FIELDS), spark.createDataFrame(old, FIELDS))
    got = {r["aggregateId"]: (r["action"], r["record"]["syncStatus"]) for r in done.collect()}
    assert got == {"r": ("REVIEW", "CONFLICT_DETECTED"), "o": ("UPSERT", "SYNCED"), "n": ("UPSERT", "SYNCED")}
    entry = L.conflict_entries(done.where("action = 'REVIEW'"), 99).first()
    assert (entry["status"], entry["targetCloud"], entry["conflictStrategy"], entry["nextRetryAt"]) == ("CONFLICT_REVIEW", "aws", "MANUAL_REVIEW", 99)


def test_hot_aggregate_join_is_split(spark):
    """AQE splits the incoming side when one aggregate receives most records."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10000", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        mk = lambda n, hot: spark.range(n).select(
            F.col("id").cast("string").alias("id"), F.lit("t").alias("tenantId"), F.lit("ORDER").alias("aggregateType"),
            F.when(F.lit(hot) & (F.col("id") % 3 == 0), "hot").otherwise(F.col("id").cast("string")).alias("aggregateId"), F.lit("aws").alias("sourceCloud"),
            F.unhex(F.sha2(F.col("id").cast("string"), 512)).alias("payload"), F.create_map(F.lit("aws"), F.col("id")).alias("vectorClock"),
            F.col("id").alias("wallClockTs"), F.lit(1).alias("schemaVersion"), F.lit("SYNCED").alias("syncStatus"))
        store = mk(2000, False).withColumn("aggregateId", F.when(F.col("id") == "0", "hot").otherwise(F.col("aggregateId"))).repartition(4)
        joined = R.pair(mk(20000, True).repartition(8), store)
        df = joined.select("incoming.payload", "existing.sourceCloud")
        assert len(df.collect()) == 20000
        assert "skew=true" in df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


# ---- several changes of one aggregate ------------------------------------------------------------

def apply_one(state, change, kind):
    """What one incoming record does to the stored one: (stored afterwards, resolved, parked)."""
    if state is None or relation(state["clock"], change["clock"]) != "CONCURRENT":
        return {**change, "status": "SYNCED"}, 0, 0
    if kind == "RESTRICTED_DATA":
        return state, 0, 1
    stays = state["cloud"] == "aws" if kind == "TENANT_CONFIG" else (state["ts"], state["cloud"]) >= (change["ts"], change["cloud"])
    both = {n: max(state["clock"].get(n, 0), change["clock"].get(n, 0)) for n in {*state["clock"], *change["clock"]}}
    return {**(state if stays else change), "clock": both, "status": "CONFLICT_RESOLVED"}, 1, 0


MANY = FIELDS + ", seq bigint"


@pytest.mark.parametrize("step", [1, 3, 1000])
def test_many_changes_equal_a_sequential_loop(spark, step):
    rnd = random.Random(step)
    kinds = ["TENANT_CONFIG", "RESTRICTED_DATA", "ORDER", "AUDIT_RECORD"]
    clock = lambda: {n: rnd.randrange(1, 5) for n in ("aws", "azure", "gcp") if rnd.random() < 0.7}
    make = lambda agg, i: (f"id-{i}", "tenant-1", kinds[agg % 4], f"agg-{agg}", rnd.choice(["aws", "azure"]), b"{}", clock(),
                           rnd.randrange(50), 1, "PENDING", i)
    stored = [make(agg, -agg - 1) for agg in range(0, 12, 2)]
    changes = [make(rnd.randrange(12), i) for i in range(90)]
    config = {"TENANT_CONFIG": "CLOUD_PRIORITY", "RESTRICTED_DATA": "MANUAL_REVIEW", "AUDIT_RECORD": "LAST_WRITE_WINS"}
    plain = lambda r: {"id": r[0], "cloud": r[4], "clock": r[6], "ts": r[7], "status": r[9]}
    state = {r[3]: (plain(r), 0, 0, 0) for r in stored}
    for r in changes:
        old, n, m, p = state.get(r[3], (None, 0, 0, 0))
        new, resolved, parked = apply_one(old, plain(r), r[2])
        state[r[3]] = (new, n + 1, m + resolved, p + parked)
    applied = R.sync_apply_many(spark.createDataFrame(changes, MANY), spark.createDataFrame([r[:-1] for r in stored], FIELDS),
                                config, order=["seq"], step=step, slice_len=7)
    got = applied.done.collect()
    pairs = Counter(r["aggregateId"] for r in applied.parked.collect())
    assert {r["aggregateId"] for r in got} == {r[3] for r in changes}
    for r in got:
        want, n, m, p = state[r["aggregateId"]]
        rec = r["record"]
        assert (rec["id"], rec["syncStatus"], rec["vectorClock"], rec["wallClockTs"]) == (want["id"], want["status"], want["clock"], want["ts"])
        assert (r["changes"], r["resolvedCount"], r["parkedCount"], pairs[r["aggregateId"]]) == (n, m, p, p)


def test_the_second_change_meets_the_result_of_the_first(spark):
    stored = [record("aws", 1, {"aws": 1})]
    changes = [record("azure", 10, {"azure": 1}) + (1,), record("azure", 5, {"azure": 2}) + (2,)]
    got = R.sync_apply_many(spark.createDataFrame(changes, MANY), spark.createDataFrame(stored, FIELDS), order=["seq"]).done.first()
    assert got["record"]["vectorClock"] == {"aws": 1, "azure": 2}
    empty = spark.createDataFrame([], MANY)
    nothing = R.sync_apply_many(empty, spark.createDataFrame(stored, FIELDS), order=["seq"])
    assert nothing.done.count() == 0 and nothing.parked.count() == 0


def test_an_aggregate_of_ten_thousand_changes(spark):
    """Half of them for review: their pairs are rows, and later steps do not carry them."""
    kinds = ["RESTRICTED_DATA", "ORDER"]
    changes = [(f"i{i}", "tenant-1", kinds[i % 2], f"agg-{i % 2}", "azure", b"{}", {"azure": i + 1}, i, 1, "PENDING", i) for i in range(20_000)]
    stored = [record("aws", 1, {"aws": 1}, kind=k, agg=f"agg-{i}") for i, k in enumerate(kinds)]
    applied = R.sync_apply_many(spark.createDataFrame(changes, MANY).repartition(4), spark.createDataFrame(stored, FIELDS),
                                {"RESTRICTED_DATA": "MANUAL_REVIEW"}, order=["seq"], step=3_000, slice_len=500)
    got = {r["aggregateId"]: r for r in applied.done.collect()}
    assert (got["agg-0"]["changes"], got["agg-0"]["parkedCount"], got["agg-0"]["record"]["vectorClock"]) == (10_000, 10_000, {"aws": 1})
    assert (got["agg-1"]["changes"], got["agg-1"]["parkedCount"], got["agg-1"]["record"]["vectorClock"]) == (10_000, 0, {"aws": 1, "azure": 20_000})
    assert applied.parked.groupBy("step").count().count() == 4 and applied.parked.count() == 10_000
