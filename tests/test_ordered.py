"""Sliced computations against plain windows, with slices small enough to cut every key."""

import random

import pytest
from conftest import rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import ordered as O


@pytest.fixture(scope="module")
def events(spark):
    rnd = random.Random(7)
    data = [("hot" if rnd.random() < 0.4 else rnd.choice("abc"), rnd.randrange(0, 60), i, rnd.randrange(0, 9),
             rnd.random() < 0.3) for i in range(600)]
    return spark.createDataFrame(data, "k string, ts bigint, seq bigint, v int, brk boolean")


@pytest.fixture(scope="module")
def W(spark):
    return Window.partitionBy("k").orderBy("ts", "seq")


@pytest.mark.parametrize("slice_ms", [None, 1, 7, 1000])
def test_ordinal(events, W, slice_ms):
    got = O.with_ordinal(events, ["k"], "ts", "seq", "n", slice_ms)
    assert rows(got) == rows(events.withColumn("n", F.row_number().over(W).cast("bigint")))


@pytest.mark.parametrize("slice_ms", [None, 1, 7, 1000])
def test_previous_and_next(events, W, slice_ms):
    got = O.with_next(O.with_previous(events, ["k"], "ts", "seq", {"p": "v", "pt": "ts"}, slice_ms),
                      ["k"], "ts", "seq", {"x": "v"}, slice_ms)
    want = events.select("*", F.lag("v").over(W).alias("p"), F.lag("ts").over(W).alias("pt"), F.lead("v").over(W).alias("x"))
    assert rows(got) == rows(want)


@pytest.mark.parametrize("slice_ms", [None, 1, 7, 1000])
def test_running_sum_and_max(events, W, slice_ms):
    got = O.with_running_max(O.with_running_sum(events, ["k"], "ts", "seq", F.col("v"), "s", slice_ms),
                             ["k"], "ts", "seq", F.when(F.col("brk"), F.col("v")), "m", slice_ms)
    want = events.select("*", F.sum("v").over(W).alias("s"), F.max(F.when(F.col("brk"), F.col("v"))).over(W).alias("m"))
    assert rows(got) == rows(want)


@pytest.mark.parametrize("slice_ms", [None, 1, 7, 1000])
def test_last_break(events, W, slice_ms):
    got = O.with_last_break(events, ["k"], "ts", "seq", F.col("brk"), "b", slice_ms)
    at = F.when(F.col("brk"), F.struct("ts", "seq"))
    want = events.withColumn("b", F.max(at).over(W.rowsBetween(Window.unboundedPreceding, -1)))
    flat = lambda df: rows(df.select("k", "seq", F.col("b.ts"), F.col("b").getField("tie" if "tie" in df.schema["b"].dataType.names else "seq")))
    assert flat(got) == flat(want)


def test_chained_steps_share_one_shuffle(events, spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        base = O.time_slice(events.select("k", "ts", "seq").where("k is not null and ts is not null"), "ts", 7)
        df = O.with_running_max(O.with_running_sum(base, ["k"], "ts", "seq", F.col("seq"), "s"), ["k"], "ts", "seq", F.col("s"), "m")
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    shuffles = [l for l in plan.splitlines() if "Exchange hashpartitioning(k" in l]
    # One for the rows, the rest for the two summaries; the second step reuses the first one's.
    assert sum("ReusedExchange" not in l for l in shuffles) == 6
    assert any("ReusedExchange" in l for l in shuffles)
