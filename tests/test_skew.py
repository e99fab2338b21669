import pytest
from conftest import rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import dedup as D
from tidemark.operators import skew as K


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows have one key; a few have none."""
    key = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 7, F.lit(None)).otherwise(F.concat(F.lit("k"), F.col("id") % 700))
    return spark.range(9000).select("id", key.alias("key"))


@pytest.mark.parametrize("salts", [1, 4, 256])
def test_group_totals_equal_a_window(skewed, salts):
    keyed = skewed.where("key is not null")
    got = K.with_group_totals(keyed, ["key"], ["id"], {"n": F.count(F.lit(1)), "m": F.min("id")},
                              {"rows": (F.sum, "n"), "first": (F.min, "m")}, salts)
    w = Window.partitionBy("key")
    assert rows(got) == rows(keyed.select("*", F.count(F.lit(1)).over(w).alias("rows"), F.min("id").over(w).alias("first")).select(got.columns))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_lookup_join_equals_plain_join(skewed, spark, how):
    lookup = spark.createDataFrame([("hot", "H"), ("k1", "one"), ("zz", "none")], "key string, label string")
    got = K.lookup_join(skewed, lookup, ["key"], ["id"], how)
    assert rows(got) == rows(skewed.join(lookup, "key", how).select(got.columns))


def test_hot_key_leaves_its_hash_partition(skewed, spark):
    """The rows of the hot key are on many tasks after either join."""
    lookup = spark.createDataFrame([("hot", "H"), ("k1", "one")], "key string, label string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for joined in (K.lookup_join(skewed, lookup, ["key"], ["id"]),
                       K.with_group_totals(skewed.where("key is not null"), ["key"], ["id"], {"n": F.count(F.lit(1))}, {"rows": (F.sum, "n")})):
            assert joined.where("key = 'hot'").select(F.spark_partition_id()).distinct().count() >= 7
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def brute_force(points, ttl):
    out = []
    for key in sorted({k for k, _, _ in points}):
        expires = None
        for t, s in sorted((t, s) for k, t, s in points if k == key):
            if expires is None or t >= expires:
                out.append((key, t, s, t + ttl))
                expires = t + ttl
    return sorted(out)


@pytest.mark.parametrize("slice_ms", [1, 4, 100, 1 << 15])
def test_ttl_acceptance_equals_a_loop(spark, slice_ms):
    import random
    rnd = random.Random(3)
    points = [("hot" if rnd.random() < 0.5 else rnd.choice(["a", "b", "c"]), rnd.randrange(-200, 900), i) for i in range(400)]
    df = spark.createDataFrame(points, "k string, t bigint, s bigint")
    got = D.accept_with_ttl(df, ["k"], "t", "s", 13, slice_ms=slice_ms)
    want = {}
    for k, t, s in points:
        want[k, t] = min(s, want.get((k, t), s))
    assert sorted(tuple(r) for r in got.select("k", "t", "s", "expiresAt").collect()) == brute_force([(k, t, s) for (k, t), s in want.items()], 13)


@pytest.mark.parametrize("slice_ms", [1, 64, 1 << 15])
def test_ttl_accepts_every_row_without_a_key(spark, slice_ms):
    """The rows of the null key stay whatever the other keys hold; a row without a time is none."""
    points = [(None, 0), (None, 50), (None, 200), ("k", 0), ("k", 50), ("k", 200), ("k", None)]
    df = spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate(points)], "k string, t bigint, s bigint")
    got = sorted((r["k"] or "", r["t"]) for r in D.accept_with_ttl(df, ["k"], "t", "s", 100, slice_ms).collect())
    assert got == [("", 0), ("", 50), ("", 200), ("k", 0), ("k", 200)]


def test_ttl_of_nothing_and_of_two_keys(spark):
    df = spark.createDataFrame([("a", "x", 0, 1), ("a", "y", 1, 2), ("a", "x", 5, 3)], "k string, v string, t bigint, s bigint")
    assert len(D.accept_with_ttl(df, ["k", "v"], "t", "s", 10).collect()) == 2
    assert D.accept_with_ttl(df.limit(0), ["k"], "t", "s", 10).count() == 0


def test_ttl_builds_its_plan_without_a_job(spark):
    df = spark.range(100).selectExpr("id % 3 AS k", "id AS t", "id AS s")
    tracker, group = spark.sparkContext.statusTracker(), "ttl-plan"
    spark.sparkContext.setJobGroup(group, group)
    try:
        plan = D.accept_with_ttl(df, ["k"], "t", "s", 10)
        assert not tracker.getJobIdsForGroup(group)
        assert plan.count() and tracker.getJobIdsForGroup(group)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_rows_without_a_key_are_never_duplicates(spark):
    df = spark.createDataFrame([("1", None, 5, 1), ("2", None, 5, 2), ("3", "x", 9, 3), ("4", "x", 7, 4)],
                               "id string, idempotencyKey string, createdAt bigint, seq bigint")
    got = {r["id"]: (r["winnerId"], r["duplicate"]) for r in D.idempotent_ingest(df).collect()}
    assert got == {"1": ("1", False), "2": ("2", False), "3": ("4", True), "4": ("4", False)}
    assert sorted(r["id"] for r in D.first_per_key(df).collect()) == ["1", "2", "4"]
