"""Stateful streams against their batch twins: after the drain, over restarts, with late rows and with silence."""

import random
from collections import Counter

import pandas as pd
import pyarrow as pa
import pytest
from conftest import rows
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark.operators import dedup as D
from tidemark.operators import metrics as M
from tidemark.operators import traces as TR
from tidemark.session import shared_dir, use_rocksdb
from tidemark.sources import streams as ST
from tidemark.streaming import keyed as KS
from tidemark.streaming import pipeline as PL

FAR = 10_000_000_000


@pytest.fixture(autouse=True, scope="module")
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


class Feed:
    """A folder read as a stream, one file a batch; every push is a run of its own, so each restarts from the checkpoint."""

    def __init__(self, spark, schema, build):
        self.spark, self.schema, self.build, self.path = spark, schema, build, shared_dir(spark, "feed")

    def push(self, *batches):
        for batch in batches:
            self.spark.createDataFrame(batch, self.schema).coalesce(1).write.mode("append").parquet(f"{self.path}/in")
            stream = ST.file_stream(use_rocksdb(self.spark), f"{self.path}/in", self.spark.createDataFrame([], self.schema).schema, max_files=1)
            self.query = PL.start(self.build(stream), f"{self.path}/out", f"{self.path}/c", [], interval=None)
            PL.run_all([self.query])
        return self

    def out(self):
        return self.spark.read.parquet(f"{self.path}/out")

    def state_rows(self):
        return [op.numRowsTotal for op in self.query.lastProgress.stateOperators]


SPANS = "traceId bigint, spanId string, statusCode string, startMs bigint, endMs bigint, attributes map<string,string>"


def span(trace, i, start, status="OK", length=10, route="/api"):
    return (trace, f"{trace}-{i}", status, start, start + length, {"http.route": route})


def test_sampled_traces_equal_the_batch_over_restarts(spark):
    rng = random.Random(1)
    spans = []
    for trace in range(60):
        base = trace * 5_000
        for i in range(rng.randint(1, 5)):
            spans.append(span(trace, i, base + rng.randrange(0, 20_000), rng.choice(["OK"] * 8 + ["ERROR"]), rng.choice([10, 10, 2_500]),
                              rng.choice(["/api", "/api", "/health"])))
    spans += [(None, "x", "ERROR", 5, 6, None)]
    spans.sort(key=lambda s: s[3])
    bucket = F.col("traceId") % 100
    feed = Feed(spark, SPANS, lambda s: KS.tail_sample(s, bucket))
    feed.push(spans[:50], spans[50:51], spans[51:], [span(9_999_999, 0, FAR)])
    want = TR.tail_sample(spark.createDataFrame(spans, SPANS), bucket)
    assert rows(feed.out().drop("attributes")) == rows(want.drop("attributes")) and want.count() > 10


def test_late_spans_follow_the_decision_until_it_is_forgotten(spark):
    feed = Feed(spark, SPANS, lambda s: KS.tail_sample(s, F.lit(50), wait_ms=1_000, remember_ms=5_000))
    feed.push([span(1, 0, 0, "ERROR"), span(2, 0, 0)], [span(3, 0, 3_000)])  # moves the watermark past both decisions
    feed.push([span(1, 1, 100), span(2, 1, 100, "ERROR")])
    assert sorted(r["spanId"] for r in feed.out().collect()) == ["1-0", "1-1"]
    feed.push([span(4, 0, FAR)], [span(2, 2, 200, "ERROR")], [span(5, 0, 2 * FAR)])
    assert sorted(r["spanId"] for r in feed.out().collect()) == ["1-0", "1-1", "2-2"]


def test_trace_state_is_by_group_and_spans_keep_their_attributes(spark):
    """Of 400 traces only groups are in the store; a span that waited comes out as it went in."""
    made = [(f"t{i}", f"{i}", "ERROR" if i % 4 else "OK", i, i + 5, {"http.route": "/api", "n": str(i), "none": None} if i % 3 else None) for i in range(400)]
    schema = SPANS.replace("traceId bigint", "traceId string")
    feed = Feed(spark, schema, lambda s: KS.tail_sample(s, F.lit(50), groups=4))
    feed.push(made, [("last", "last", "OK", FAR, FAR, None)])
    assert rows(feed.out()) == sorted((m for m in made if m[2] == "ERROR"), key=repr)
    assert max(feed.state_rows()) <= 5 * 6


def test_a_call_of_the_sampler_holds_one_part(spark):
    """Few store calls whatever the number of traces, parts of bounded size, and the decisions of a loop."""
    class Many(dict):
        updateValue, getValue, removeKey = dict.__setitem__, dict.__getitem__, dict.__delitem__

    class One(list):
        exists, get, update, clear = lambda self: bool(self), lambda self: self[0], lambda self, v: self.__setitem__(slice(None), [v]), list.clear

    class Index(list):
        get, put = lambda self: iter(list(self)), lambda self, rows: self.__setitem__(slice(None), rows)

    wait, remember, slow = 50, 400, 30

    def loop(calls):
        """Output of every call, one trace at a time: (due, first, last, error, decision, waiting)."""
        state, out = {}, []
        for now, spans_ in calls:
            got, late = [], {}
            for trace, i, start, end, error in spans_:
                live = state.setdefault(trace, {"due": None, "start": start, "end": end, "keep": False, "decided": False, "spans": []})
                if live["decided"]:
                    got += [i] if live["keep"] else []
                    continue
                late[trace] = min(start, late.get(trace, start))
                live["start"], live["end"], live["keep"] = min(start, live["start"]), max(end, live["end"]), live["keep"] or error
                live["spans"].append(i)
            for trace, first in late.items():
                if state[trace]["due"] is None:
                    state[trace]["due"] = first + wait
            for trace, live in list(state.items()):
                if live["due"] <= now and live["decided"]:
                    del state[trace]
                elif live["due"] <= now:
                    live["keep"] = live["keep"] or live["end"] - live["start"] >= slow
                    got += live["spans"] if live["keep"] else []
                    live |= {"decided": True, "due": live["due"] + remember, "spans": []}
            out.append(sorted(got))
        return out, state

    def run(calls, at_once, stretch):
        sampler, woken, out, sizes = KS._Sampler(wait, remember, slow, at_once), [], [], []
        sampler.traces, sampler.parts, sampler.waiting, sampler.due, sampler.wake_at = One(), Index(), Many(), One(), woken.append
        put = sampler.put
        sampler.put = lambda parts, rows_, due: (sizes.append(len(rows_)), put(parts, rows_, due))
        names = ["traceId", "spanId", "startMs", "endMs", "_keep"]
        for now, spans_ in calls:
            at = type("Now", (), {"getCurrentWatermarkInMs": lambda self, now=now: now})()
            packed = [KS._to_bytes(pa.table(dict(zip(names, zip(*spans_[i:i + stretch]))))) for i in range(0, len(spans_), stretch)]
            shown = list(sampler.handleInputRows((0,), (pd.DataFrame({"rows": packed[i:i + 2]}) for i in range(0, len(packed), 2)), at))
            if woken and woken[-1] is not None and woken[-1] <= now:
                fired = type("Fired", (), {"getExpiryTimeInMs": lambda self, due=woken[-1]: due})()
                shown += list(sampler.handleExpiredTimer((0,), at, fired))
            out.append(sorted(i for f in shown for data in f["rows"] for i in KS._from_bytes(data)["spanId"].to_pylist()))
        return out, sampler, sizes

    rng = random.Random(11)
    calls, n, now = [], 0, 0
    for _ in range(60):
        spans_ = []
        for _ in range(rng.choice([1, 20, 300])):
            n += 1
            start = max(0, now + rng.randint(-200, 100))
            spans_.append((rng.choice([rng.randrange(60), rng.randrange(2_000), 7]), n, start, start + rng.choice([0, 0, 1, 35]), rng.random() < 0.05))
        calls.append((now, spans_))
        now += rng.choice([0, 5, 60, 500])
    calls += [(now + 10_000, calls[0][1][:0]), (now + 10_000, [])]
    want, left = loop(calls)
    for at_once, stretch in ((1 << 16, 1 << 16), (40, 20)):
        got, sampler, sizes = run(calls, at_once, stretch)
        assert got == want and not left and not sampler.waiting and not sampler.parts and not sampler.traces
        assert at_once > 40 or max(sizes) <= 60
    assert sum(map(len, want)) > 1_000


GATED = "k string, t bigint, s bigint"


def test_expiring_keys_equal_a_loop_and_the_batch(spark):
    rng = random.Random(7)
    points = sorted([(rng.choice(["a", "b", "c", None]), rng.randrange(0, 2_000), i) for i in range(300)], key=lambda p: (p[1], p[2]))
    seen, points_at_once = set(), []
    for p in points:  # one row per key and time, as the batch form reduces them
        if p[0] is None or p[:2] not in seen:
            seen.add(p[:2])
            points_at_once.append(p)
    build = lambda s: KS.accept_with_ttl(s, ["k"], "t", "s", 90)
    cut = [b for b in range(0, len(points_at_once), 70)]
    chunks, last = [], None
    for p in points_at_once:  # a time is not split over batches: the second one would be behind the watermark
        if not chunks or (len(chunks[-1]) >= 70 and p[1] != last):
            chunks.append([])
        chunks[-1].append(p)
        last = p[1]
    feed = Feed(spark, GATED, build).push(*chunks)
    expires, loop = {}, []
    for k, t, s in points_at_once:
        if k is None or t >= expires.get(k, 0):
            loop.append((k, t, s, t + 90))
            expires[k] = t + 90
    batch = D.accept_with_ttl(spark.createDataFrame(points_at_once, GATED), ["k"], "t", "s", 90)
    assert len(cut) > 2 and rows(feed.out().select("k", "t", "s", "expiresAt")) == sorted(loop, key=repr)
    assert rows(batch.select("k", "t", "s", "expiresAt")) == sorted(loop, key=repr)


def test_expired_keys_leave_the_state(spark):
    feed = Feed(spark, GATED, lambda s: KS.accept_with_ttl(s, ["k"], "t", "s", 50))
    feed.push([(f"k{i}", 10, i) for i in range(200)])
    before = max(feed.state_rows())
    feed.push([("z", 100_000, 0)], [("z", 200_000, 1)])
    assert max(feed.state_rows()) < before / 10
    feed.push([("z", 300_000, 2), (None, 300_000, 3), (None, 300_000, 4)])
    assert feed.out().where("k is null").count() == 2


RULES = [("high", "m", ">", 10.0, 60, "warning"), ("any", "m", ">", 5.0, 0, "critical"), ("low", "n", "<", 1.0, 30, "warning")]
SAMPLES = "metric string, series string, ts bigint, seq bigint, value double"


def test_alert_changes_equal_the_batch(spark):
    rng = random.Random(3)
    made = []
    for series in ("a", "b", None):
        ts = 0
        for _ in range(120):
            ts += rng.choice([5_000, 10_000, 15_000, 60_000, 61_000, 200_000])
            made.append((rng.choice(["m", "n", "other"]), series, ts, len(made), rng.choice([0.5, 3.0, 7.0, 12.0, 12.0, 12.0, None])))
    made.sort(key=lambda r: r[2])
    feed = Feed(spark, SAMPLES, lambda s: KS.alert_changes(s, RULES, lookback_ms=60_000, delay="20 seconds"))
    feed.push(made[:100], made[100:], [("other", "z", FAR, 0, 1.0), ("m", "z", FAR, 1, 0.0)])
    want = M.alert_changes(spark.createDataFrame(made, SAMPLES), RULES, 60_000)
    got, want = Counter(rows(feed.out().select(*want.columns))), Counter(rows(want))
    assert not got - want and not want - got
    assert {r[3] for r in want} == {"PENDING", "FIRING", "RESOLVED"}


def test_only_silence_ends_an_alert(spark):
    """After the last sample of the series nothing but other series moves the time on."""
    feed = Feed(spark, SAMPLES, lambda s: KS.alert_changes(s, RULES[:1], lookback_ms=100_000))
    feed.push([("m", "a", 1_000, 0, 99.0)])
    state = lambda: [(r["state"], r["at"], r["value"]) for r in feed.out().where("series = 'a'").orderBy("at").collect()]
    feed.push([("m", "b", 62_000, 1, 0.0)])
    assert state() == [("PENDING", 1_000, 99.0), ("FIRING", 61_000, None)]
    feed.push([("m", "b", 200_000, 2, 0.0)])
    assert state() == [("PENDING", 1_000, 99.0), ("FIRING", 61_000, None), ("RESOLVED", 101_000, None)]
    assert rows(M.alert_changes(spark.createDataFrame([("m", "a", 1_000, 0, 99.0)], SAMPLES), RULES[:1], 100_000).select("state", "at")) == [
        ("FIRING", 61_000), ("PENDING", 1_000), ("RESOLVED", 101_000)]


def test_the_last_trace_is_decided_when_the_table_begins_with_a_quiet_span(spark, sf, tmp_path):
    """All 24 spans are of sampled traces; the first one has a route that is left out."""
    spark.read.parquet(f"{sf}/events.parquet").where("event_id < 24").orderBy("event_id").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    queries = entry.queries()
    want = rows(queries["tail_sample"](spark, str(tmp_path)))
    assert rows(queries["tail_sample_stream"](spark, str(tmp_path))) == want and max(r[0] for r in want) == 5


def test_alarm_states_equal_the_batch_and_silence_ends_them(spark):
    rng = random.Random(8)
    alarms = [("cpu", "m", "Average", 60, ">", 8.0, 2), ("space", "m", "Minimum", 300, "<", 4.0, 1), ("errors", "n", "Sum", 60, ">", 15.0, 1),
              ("peak", "n", "Maximum", 60, ">", 10.0, 3)]
    made = [(rng.choice("mn"), rng.choice("ab"), 60_000 * minute + rng.randrange(60_000), 0, float(rng.choice([2, 7, 9, 12, 12, 12])))
            for minute in range(60) if minute % 9 < 6 for _ in range(6)]
    made.sort(key=lambda r: r[2])
    feed = Feed(spark, SAMPLES, lambda s: KS.alarm_states(s, alarms, "30 seconds"))
    feed.push(made[:100], made[100:], [("other", "z", FAR, 0, 1.0), ("m", "z", FAR, 0, 9.0)])
    shown = lambda df: rows(df.where("series <> 'z'").select("alarm", "series", "periodStart", F.round("value", 6), "breaching", "inAlarm"))
    want = shown(M.alarm_states(spark.createDataFrame(made, SAMPLES), alarms))
    assert shown(feed.out()) == want
    assert any(r[5] for r in want) and any(r[3] is None for r in want)


def test_alarm_state_is_touched_per_call_not_per_row(spark):
    """Figures of many rows and periods meet before the store is asked, out of order and with NaN as Spark orders it."""
    class Store:
        def __init__(self):
            self.rows, self.calls = [], 0

        def get(self):
            self.calls += 1
            return iter(self.rows)

        def put(self, values):
            self.calls, self.rows = self.calls + 1, values

    rng = random.Random(9)
    made = [(rng.randrange(200 * 60_000), rng.choice([1.0, 5.0, float("nan")])) for _ in range(3_000)]
    alarm = KS._Alarm([("low", "m", "Minimum", 60, "<", 2.0, 1)])
    alarm.open, woken = Store(), []
    alarm.closed, alarm.wake_at = type("Closed", (), {"exists": lambda self: False})(), woken.append
    frames = [pd.DataFrame(made[i:i + 500], columns=["ts", "value"]) for i in range(0, len(made), 500)]
    now = type("Now", (), {"getCurrentWatermarkInMs": lambda self: 0})()
    assert list(alarm.handleInputRows((0, "a"), iter(frames), now)) == []
    want = {}
    for ts, v in made:
        want.setdefault(ts // 60_000, []).append(v)
    assert alarm.open.calls == 2 and woken == [60_000]
    assert [(p, n) for p, _, n, _, _ in alarm.open.rows] == sorted((p, len(vs)) for p, vs in want.items())
    for p, _, _, low, high in alarm.open.rows:
        known = [v for v in want[p] if v == v]
        assert low == min(known) and (high == max(known) if len(known) == len(want[p]) else high != high)


EVENTS = "tenantId string, id string, createdAt bigint"


def test_late_rows_and_windows_are_all_rows(spark):
    """The query's watermark only moves between batches, so rows that a running maximum calls late can still be counted."""
    feed = Feed(spark, EVENTS, lambda s: KS.windows_and_late(s, ["tenantId"], 1_000, "0 seconds"))
    first = [("a", f"x{i}", t) for i, t in enumerate([100, 5_000, 200, 4_999, 300])]  # 200 and 300 come after 5000, within a batch
    second = [("a", "y0", 150), ("b", "y1", 950), ("a", "y2", 5_001), ("a", "y3", 3_999)]
    feed.push(first, second, [("c", "z", FAR)])
    late = {r["id"] for r in feed.out().where("kind = 'late'").collect()}
    assert late == {"y0", "y1", "y3"}
    counted = {(r["tenantId"], r["windowStart"]): r["n"] for r in KS.window_totals(feed.out(), ["tenantId"]).collect()}
    assert counted == {("a", 0): 3, ("a", 4_000): 1, ("a", 5_000): 2}
    assert len(late) + sum(counted.values()) == len(first) + len(second)


@pytest.mark.parametrize("late_by", [10_000])
def test_nothing_is_lost_whatever_the_delay(spark, late_by):
    rng = random.Random(late_by)
    made = [(rng.choice(["a", "b", None]), f"e{i}", max(0, 100 * i - rng.randrange(0, 15_000))) for i in range(400)]
    feed = Feed(spark, EVENTS, lambda s: KS.windows_and_late(s, ["tenantId"], 2_000, f"{late_by} milliseconds"))
    feed.push(made[:150], made[150:], [("end", "z", FAR)])
    assert feed.out().agg(F.sum("n")).first()[0] == len(made)


CHANGES = "key string, op string, ts bigint, lsn bigint, row string"


def test_change_feed_out_of_order_and_replayed_gives_the_table(spark):
    from tidemark.sources import cdc
    rng = random.Random(11)
    made = [(rng.choice("abcdefgh"), "u", 1_000 * i, i, f"v{i}") for i in range(120)]
    made = [(k, "d", t, n, None) if n % 7 == 3 else (k, o, t, n, v) for k, o, t, n, v in made] + [("a", "d", 120_000, 120, None)]
    fed = sorted(made, key=lambda c: c[2] + rng.randrange(0, 20_000))
    fed = fed[:60] + fed[40:90] + fed[80:]  # parts come twice
    feed = Feed(spark, CHANGES, lambda s: KS.latest_changes(s, "60 seconds"))
    feed.push(fed[:50], fed[50:], [("zz", "u", FAR, 1, "last")])
    got = cdc.current_state(feed.out()).where("key <> 'zz'")
    want = cdc.current_state(spark.createDataFrame(made, CHANGES))
    assert rows(got) == rows(want) and want.count() < 8
    assert feed.out().count() < len(fed) and max(feed.state_rows()) <= 2 * 9


def test_waiting_samples_are_held_a_slice_at_a_time(spark):
    """Whatever waits, a call holds one part of the input or one slice of time; the changes are those of one walk."""
    class Many(dict):
        updateValue, getValue, removeKey = dict.__setitem__, dict.__getitem__, dict.__delitem__

    class One(list):
        exists, get, update, clear, put = lambda self: bool(self), lambda self: self[0], lambda self, v: self.__setitem__(slice(None), [v]), list.clear, None

    class Index(list):
        get, put = lambda self: iter(list(self)), lambda self, rows: self.__setitem__(slice(None), rows)

    def run(slice_ms, at_once):
        alert = KS._Alert(2_000, slice_ms, at_once)
        alert.slices, alert.waiting, alert.breach, alert.wake_at, sizes = Index(), Many(), One(), lambda at: None, []
        taken = alert.take
        alert.take = lambda *a: (lambda rows: sizes.append(len(rows)) or rows)(taken(*a))
        out = []
        for now, rows_ in ((0, made[:4_000]), (1_500_000, made[4_000:]), (3_000_000, made[:0])):
            frames = [pd.DataFrame(rows_[i:i + 100], columns=["ts", "seq", "value", "known", "breach"]) for i in range(0, len(rows_), 100)]
            at = type("Now", (), {"getCurrentWatermarkInMs": lambda self, now=now: now})()
            out += [tuple(r) for f in alert.handleInputRows(("a", "page", 3, "s"), iter(frames), at) for r in f.assign(value=[None if v is pd.NA else v for v in f["value"]]).astype(str).itertuples(index=False)]
        assert not alert.waiting and not alert.slices
        return out, max(sizes)

    rng = random.Random(10)
    made = [(rng.randrange(1_000_000), i, float(i), True, rng.random() < 0.9) for i in range(4_000)]
    made += [(rng.randrange(1_500_001, 2_500_000), 4_000 + i, float(i), True, rng.random() < 0.9) for i in range(4_000)]
    whole, most = run(10_000_000, 1 << 20)
    small, few = run(20_000, 300)
    assert small == whole and {r[3] for r in whole} == {"PENDING", "FIRING", "RESOLVED"}
    assert most == 8_000 and few < 200
