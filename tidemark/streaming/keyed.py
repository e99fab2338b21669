"""Stateful streams with event-time timers: trace sampling, expiring keys, alerts, alarms, late rows and change feeds.

State lives in the RocksDB store and is cleared by timers, because a state's own time to live counts processing time and
would make a replay differ.  Timers fire when the query's watermark has passed them, so every processor is silent about
the time after the last watermark; a later row, of any key, moves it on.

Spark drops rows behind the watermark before a processor sees them where the grouped rows still carry the event-time
column.  ``_watched`` hides it: the watermark goes on, and late rows are the processor's own decision.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from tidemark.functions import events as E
from tidemark.operators import metrics as M
from tidemark.operators import traces as TR

WAIT_MS = 30_000
REMEMBER_MS = 600_000
LOOKBACK_MS = 300_000
WAITING_MS = 3_600_000  # time in one slice of what waits
AT_ONCE = 1 << 16  # rows of a key that a call holds


def _watched(df: DataFrame, ts: str, delay: str) -> DataFrame:
    """A watermark on an epoch-millis column, without an event-time column that drops rows."""
    return df.withColumn("_at", E.ts(ts)).withWatermark("_at", delay).select(*df.columns)


def _doubles(values) -> pd.Series:
    """A column of a frame in which null and NaN stay what they are."""
    kind = pa.float64()
    return pd.Series(pa.array(values, kind), dtype=pd.ArrowDtype(kind))


class Timed(StatefulProcessor):
    """One pending timer per key, remembered beside the state."""

    def init(self, handle) -> None:
        self.handle = handle
        self.due = handle.getValueState("due", "at BIGINT")
        self.states(handle)

    def states(self, handle) -> None:
        raise NotImplementedError

    def wake_at(self, at: int | None) -> None:
        """Move the timer; None takes it away."""
        old = self.due.get()[0] if self.due.exists() else None
        if old == at:
            return
        if old is not None:
            self.handle.deleteTimer(old)
        if at is None:
            self.due.clear()
        else:
            self.handle.registerTimer(at)
            self.due.update((at,))

    def close(self) -> None:
        pass


# ---- traces ----------------------------------------------------------------------------------------

GROUPS = 1024  # groups of traces; more of them is less in a call


def _together(parts: Iterator, at_once: int) -> Iterator[list]:
    """Tables or batches in lists that end with ``at_once`` rows."""
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += part.num_rows
        if n >= at_once:
            yield held
            held, n = [], 0
    if n:
        yield held


def _packed(at_once: int) -> Callable:
    """Rows as one stretch of Arrow bytes for each group, at most ``at_once`` rows together."""
    def shut(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        group = table["_group"].to_numpy()
        order = np.argsort(group, kind="stable")
        group, table = group[order], table.drop_columns("_group").take(order).combine_chunks()
        starts = np.flatnonzero(np.diff(group, prepend=-1))
        parts = [_to_bytes(table.slice(at, end - at)) for at, end in zip(starts, [*starts[1:], len(group)])]
        return pa.RecordBatch.from_arrays([pa.array(group[starts], pa.int32()), pa.array(parts, pa.binary())], ["_group", "rows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return map(shut, _together(batches, at_once))
    return run


def _unpacked(names: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in batch["rows"]:
                yield from _from_bytes(rows.as_buffer()).select(names).to_batches()
    return run


def _to_bytes(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _from_bytes(data) -> pa.Table:
    with pa.ipc.open_stream(data) as reader:
        return reader.read_all()


class _Traces:
    """The live traces of a group as arrays: ``due`` is when a waiting trace is decided or a decided one forgotten.

    ``keep`` is whether an error or the share keeps the trace, and later the decision.
    """

    KINDS = {"due": "i8", "start": "i8", "end": "i8", "keep": "?", "decided": "?"}

    def __init__(self, stored: bytes | None = None):
        table = _from_bytes(stored) if stored else None
        self.ids = table["id"].combine_chunks() if stored else None
        for name, kind in self.KINDS.items():
            setattr(self, name, np.array(table[name].to_numpy(), kind) if stored else np.empty(0, kind))

    def __len__(self) -> int:
        return 0 if self.ids is None else len(self.ids)

    def to_bytes(self) -> bytes:
        return _to_bytes(pa.table({"id": self.ids} | {name: getattr(self, name) for name in self.KINDS}))

    def only(self, which: np.ndarray) -> None:
        self.ids = self.ids.filter(pa.array(which))
        for name in self.KINDS:
            setattr(self, name, getattr(self, name)[which])

    def places(self, ids: pa.Array) -> np.ndarray:
        """Where the traces are; unknown ones come to the end, undecided."""
        if self.ids is None:
            self.ids = ids[:0]
        known = len(self)
        fresh = pc.unique(ids.filter(pc.invert(pc.is_in(ids, self.ids))))
        if len(fresh):
            self.ids = pa.concat_arrays([self.ids, fresh])
            largest = np.iinfo("i8").max
            for name, value in (("due", largest), ("start", largest), ("end", -largest), ("keep", False), ("decided", False)):
                setattr(self, name, np.append(getattr(self, name)[:known], np.full(len(fresh), value, self.KINDS[name])))
        return pc.index_in(ids, self.ids).to_numpy()

    def next_due(self) -> int | None:
        return int(self.due.min()) if len(self) else None


class _Sampler(Timed):
    """Spans wait for their trace's decision; afterwards the decision is remembered for a while.

    A call has a group of traces.  Their figures are read and written once a call; waiting spans lie in parts of about
    ``at_once`` rows at most, and a part is read when one of its traces is due.
    """

    def __init__(self, wait_ms: int, remember_ms: int, slow_ms: int, at_once: int = AT_ONCE):
        self.wait, self.remember, self.slow, self.at_once = wait_ms, remember_ms, slow_ms, at_once

    def states(self, handle) -> None:
        self.traces = handle.getValueState("traces", "rows BINARY")
        self.parts = handle.getListState("parts", "part BIGINT, due BIGINT")
        self.waiting = handle.getMapState("waiting", "part BIGINT", "rows BINARY")

    def known(self) -> tuple[_Traces, dict[int, int]]:
        return _Traces(bytes(self.traces.get()[0]) if self.traces.exists() else None), {part: due for part, due in self.parts.get()}

    def store(self, traces: _Traces, parts: dict[int, int], after: int | None = None) -> None:
        if len(traces):
            self.traces.update((traces.to_bytes(),))
        else:
            self.traces.clear()
        if parts:
            self.parts.put(list(parts.items()))
        else:
            self.parts.clear()
        at = traces.next_due()
        self.wake_at(at if after is None or at is None else max(at, after + 1))

    def put(self, parts: dict[int, int], rows: pa.Table, due: int) -> None:
        part = max(parts, default=-1) + 1
        self.waiting.updateValue((part,), (_to_bytes(rows),))
        parts[part] = due

    def take(self, parts: dict[int, int], now: int) -> Iterator[pa.Table]:
        """Parts in which a trace is due; they wait no longer."""
        for part in [part for part, due in parts.items() if due <= now]:
            yield _from_bytes(bytes(self.waiting.getValue((part,))[0]))
            self.waiting.removeKey((part,))
            del parts[part]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        traces, parts = self.known()
        known, written = len(traces), set(parts)
        for held in _together((_from_bytes(data) for frame in rows for data in frame["rows"]), self.at_once):
            spans = pa.concat_tables(held).combine_chunks()
            at = traces.places(spans["traceId"].combine_chunks())
            kept = traces.decided[at] & traces.keep[at]
            if kept.any():
                yield pd.DataFrame({"rows": [_to_bytes(spans.filter(pa.array(kept)))]})
            open_ = ~traces.decided[at]
            if open_.any():
                at, spans = at[open_], spans.filter(pa.array(open_))
                start = spans["startMs"].to_numpy().astype("i8")
                np.minimum.at(traces.start, at, start)
                np.maximum.at(traces.end, at, spans["endMs"].to_numpy())
                np.logical_or.at(traces.keep, at, spans["_keep"].to_numpy())
                fresh = at >= known
                np.minimum.at(traces.due, at[fresh], start[fresh] + self.wait)
                self.put(parts, spans, int(traces.due[at].min()))
        if len(parts) > len(written):
            if len(traces) > known:  # a later span of this call may have begun a trace earlier
                first = int(traces.due[known:].min())
                parts = {part: due if part in written else min(due, first) for part, due in parts.items()}
            self.store(traces, parts)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.due.clear()
        now, fired = timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()
        traces, parts = self.known()
        ended = traces.due <= now
        forgotten, ready = ended & traces.decided, ended & ~traces.decided
        traces.keep |= ready & (traces.end - traces.start >= self.slow)
        for held in _together(self.take(parts, now), self.at_once):
            spans = pa.concat_tables(held).combine_chunks()
            at = traces.places(spans["traceId"].combine_chunks())
            kept = ready[at] & traces.keep[at]
            if kept.any():
                yield pd.DataFrame({"rows": [_to_bytes(spans.filter(pa.array(kept)))]})
            if not ready[at].all():
                self.put(parts, spans.filter(pa.array(~ready[at])), int(traces.due[at[~ready[at]]].min()))
        traces.due[ready] += self.remember
        traces.decided |= ready
        traces.only(~forgotten)
        self.store(traces, parts, fired)


def tail_sample(spans: DataFrame, bucket: Column | None = None, wait_ms: int = WAIT_MS, remember_ms: int = REMEMBER_MS,
                delay: str = "0 seconds", groups: int = GROUPS) -> DataFrame:
    """Streaming twin of ``traces.tail_sample``: a trace is decided ``wait_ms`` after its first span's start.

    Spans that come later follow the decision for ``remember_ms``; after that a trace starts anew.  Spans
    without a trace or a start are left out, as in the batch form.  State belongs to ``groups`` groups of
    traces, so it is read and written per group and batch, not per trace; rows pass Python as Arrow data.
    """
    share = F.pmod(F.xxhash64("traceId"), F.lit(100)) if bucket is None else bucket
    heard = TR.drop_noise(spans).where(F.col("traceId").isNotNull() & F.col("startMs").isNotNull())
    heard = heard.withColumn("endMs", F.coalesce("endMs", "startMs"))
    keep = F.coalesce(F.col("statusCode") == "ERROR", F.lit(False)) | F.coalesce(share < TR.SAMPLE_PERCENT, F.lit(False))
    group = F.pmod(F.xxhash64("traceId"), F.lit(groups)).cast("int")
    watched = _watched(heard.withColumns({"_keep": keep, "_group": group}), "startMs", delay)
    packed = watched.mapInArrow(_packed(AT_ONCE), "_group INT, rows BINARY")
    kept = packed.groupBy("_group").transformWithStateInPandas(
        statefulProcessor=_Sampler(wait_ms, remember_ms, TR.SLOW_TRACE_MS), outputStructType="rows BINARY",
        outputMode="append", timeMode="eventTime")
    return kept.mapInArrow(_unpacked(heard.columns), heard.schema)


# ---- expiring keys ---------------------------------------------------------------------------------

class _Gate(Timed):
    """The time until which a key is a duplicate."""

    def __init__(self, names: list[str], ts: str, tie: str, ttl_ms: int):
        self.names, self.ts, self.tie, self.ttl = names, ts, tie, ttl_ms

    def states(self, handle) -> None:
        self.expires = handle.getValueState("expires", "at BIGINT")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        until = self.expires.get()[0] if self.expires.exists() else None
        start = until
        for row in sorted(rows, key=lambda r: (r[self.ts], r[self.tie])):
            if until is None or row[self.ts] >= until:
                until = row[self.ts] + self.ttl
                yield Row(*self.names, "expiresAt")(*row, until)
        if until != start:
            self.expires.update((until,))
            self.wake_at(until)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.due.clear()
        self.expires.clear()
        return iter(())


def accept_with_ttl(df: DataFrame, keys: list[str], ts: str, tie: str, ttl_ms: int, delay: str = "0 seconds") -> DataFrame:
    """Streaming twin of ``dedup.accept_with_ttl``: accepted rows with ``expiresAt``, in order of arrival.

    A row is a duplicate until its key's expiry, also one that is older than the accepted row but comes
    after it.  A key is forgotten when the watermark passes its expiry, so state holds live keys only;
    rows behind the watermark are dropped by the query, as nothing is known about their keys any more.
    Rows without one of the keys are never duplicates and keep no state.
    """
    slim = df.where(F.col(ts).isNotNull()).select(*keys, F.col(ts).cast("bigint").alias(ts), tie)
    timed = slim.withColumn("_at", E.ts(ts)).withWatermark("_at", delay)
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    out = T.StructType([*timed.schema.fields, T.StructField("expiresAt", T.LongType())])
    gated = timed.where(known).groupBy(*keys).transformWithState(
        statefulProcessor=_Gate(timed.columns, ts, tie, ttl_ms), outputStructType=out, outputMode="append", timeMode="eventTime")
    free = timed.where(~known).withColumn("expiresAt", F.col(ts) + ttl_ms)
    return gated.drop("_at").unionByName(free.drop("_at"))


# ---- alerts ----------------------------------------------------------------------------------------

CHANGES = "alert STRING, severity STRING, series STRING, state STRING, at BIGINT, value DOUBLE"


class _Alert(Timed):
    """A condition over time: samples are taken in order once the watermark has passed them.

    Samples wait in slices of time, which are written in parts as rows come and read one after the other: a
    call holds one part or one slice, however many samples wait.  ``since`` is the start of the breach,
    ``last`` and ``value`` the latest sample, ``fired`` whether the alert is on.  Between samples only two
    things can happen: the alert has held long enough, or the latest sample has grown too old to stand for
    the present.
    """

    def __init__(self, lookback_ms: int, slice_ms: int = WAITING_MS, at_once: int = AT_ONCE):
        self.lookback, self.slice, self.at_once = lookback_ms, slice_ms, at_once

    def states(self, handle) -> None:
        self.slices = handle.getListState("slices", "slice BIGINT, parts BIGINT, first BIGINT")
        self.waiting = handle.getMapState("waiting", "slice BIGINT, part BIGINT",
                                          "ts ARRAY<BIGINT>, seq ARRAY<BIGINT>, value ARRAY<DOUBLE>, breach ARRAY<BOOLEAN>")
        self.breach = handle.getValueState("breach", "since BIGINT, last BIGINT, value DOUBLE, fired BOOLEAN")

    def put(self, slices: dict, at: int, samples: list[tuple]) -> None:
        """One more part of a slice."""
        parts, first = slices.get(at, (0, samples[0][0]))
        self.waiting.updateValue((at, parts), tuple(list(column) for column in zip(*samples)))
        slices[at] = (parts + 1, min(first, min(s[0] for s in samples)))

    def take(self, slices: dict, at: int) -> list[tuple]:
        """A slice's samples in order; they wait no longer."""
        samples = []
        for part in range(slices.pop(at)[0]):
            samples += zip(*self.waiting.getValue((at, part)))
            self.waiting.removeKey((at, part))
        return sorted(samples, key=lambda s: s[:2])

    def put_all(self, slices: dict, frames: list[pd.DataFrame]) -> None:
        whole = pd.concat(frames)
        for at, own in whole.groupby(whole["ts"] // self.slice):
            value = [v if known else None for v, known in zip(own["value"].tolist(), own["known"].tolist())]
            self.put(slices, int(at), list(zip(own["ts"].tolist(), own["seq"].tolist(), value, own["breach"].tolist())))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        slices, frames, held = self.known_slices(), [], 0
        for batch in rows:
            frames.append(batch[["ts", "seq", "value", "known", "breach"]])
            held += len(batch)
            if held >= self.at_once:
                self.put_all(slices, frames)
                frames, held = [], 0
        if held:
            self.put_all(slices, frames)
        return self.advance(key, slices, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.due.clear()
        return self.advance(key, self.known_slices(), timerValues.getCurrentWatermarkInMs())

    def known_slices(self) -> dict[int, tuple[int, int]]:
        return {at: (parts, first) for at, parts, first in self.slices.get()}

    def advance(self, key, slices: dict, now: int) -> Iterator[pd.DataFrame]:
        alert, severity, held, series = key
        wait, state, out = held * 1000, self.breach.get() if self.breach.exists() else None, []

        def pass_time(state, upto, end):
            """What happens by itself until ``upto``, at ``end`` inclusive."""
            if state:
                since, last, seen, fired = state
                silent = last + self.lookback
                if not fired and since + wait < min(upto, silent):
                    out.append(("FIRING", since + wait, None))
                    fired = True
                    state = (since, last, seen, True)
                if silent < upto or (end and silent <= upto):
                    if fired:
                        out.append(("RESOLVED", silent, None))
                    state = None
            return state

        for at in sorted(slices):
            if slices[at][1] > now:
                break
            samples = self.take(slices, at)
            ready = sum(s[0] <= now for s in samples)
            for ts, _, value, breaching in samples[:ready]:
                state = pass_time(state, ts, False)
                if breaching and state:
                    state = (state[0], ts, value, state[3])
                elif breaching:
                    out.append(("PENDING", ts, value))
                    if not wait:
                        out.append(("FIRING", ts, None))
                    state = (ts, ts, value, not wait)
                elif state:
                    if state[3]:
                        out.append(("RESOLVED", ts, value))
                    state = None
            if ready < len(samples):
                self.put(slices, at, samples[ready:])
            if len(out) >= self.at_once:
                yield self.shown(key, out)
                out.clear()
        state = pass_time(state, now, True)
        if slices:
            self.slices.put([(at, *known) for at, known in slices.items()])
        else:
            self.slices.clear()
        if state:
            self.breach.update(state)
        elif self.breach.exists():
            self.breach.clear()
        next_ = [min(first for _, first in slices.values())] if slices else []
        if state:
            next_.append(state[1] + self.lookback)
            # The timer fires at its time; the condition must outlive it, so it is looked at one later.
            next_ += [] if state[3] else [state[0] + wait + 1]
        self.wake_at(min(next_) if next_ else None)
        if out:
            yield self.shown(key, out)

    def shown(self, key, changes: list[tuple]) -> pd.DataFrame:
        state, at, value = zip(*changes)
        return pd.DataFrame({"alert": key[0], "severity": key[1], "series": key[3], "state": state, "at": at, "value": _doubles(value)})


def alert_changes(samples: DataFrame, rules: list[tuple] = M.ALERTS, lookback_ms: int = LOOKBACK_MS, delay: str = "0 seconds") -> DataFrame:
    """Streaming twin of ``metrics.alert_changes``: PENDING, FIRING and RESOLVED rows as they become known.

    Samples may come in any order within ``delay``; those behind the watermark are dropped by the query.
    """
    named = M.breaching(samples, rules)
    seq = F.coalesce(F.col("seq").cast("bigint"), F.lit(-1 << 63))  # a frame has no null numbers
    timed = named.select("alert", "severity", "heldSeconds", "series", "ts", seq.alias("seq"), F.col("value").cast("double").alias("value"),
                         F.col("value").isNotNull().alias("known"), "breach", E.ts("ts").alias("_at")).withWatermark("_at", delay)
    return timed.groupBy("alert", "severity", "heldSeconds", "series").transformWithStateInPandas(
        statefulProcessor=_Alert(lookback_ms), outputStructType=CHANGES, outputMode="append", timeMode="eventTime")


# ---- alarms over fixed periods ---------------------------------------------------------------------

ALARM_STATES = "alarm STRING, series STRING, periodStart BIGINT, value DOUBLE, breaching BOOLEAN, inAlarm BOOLEAN"
FIGURES = "period BIGINT, total DOUBLE, n BIGINT, low DOUBLE, high DOUBLE"


def _per_period(parts: list[tuple]) -> tuple:
    """Figures (period, total, n, low, high) as arrays, one row a period, in order."""
    period, total, n, low, high = (np.concatenate(column) for column in zip(*parts))
    order = np.argsort(period, kind="stable")
    period = period[order]
    starts = np.flatnonzero(np.diff(period, prepend=period[:1] - 1))
    gathered = [(np.add, total), (np.add, n), (np.fmin, low), (np.maximum, high)]  # Spark's order: NaN is the largest
    return (period[starts], *(f.reduceat(column[order], starts) for f, column in gathered))


class _Alarm(Timed):
    """Figures of the open periods, and the latest closed one with how many in a row have breached.

    The open periods are read and written once a call, not once a row.
    """

    def __init__(self, alarms: list[tuple]):
        self.alarms = alarms

    def states(self, handle) -> None:
        self.open = handle.getListState("open", FIGURES)
        self.closed = handle.getValueState("closed", "period BIGINT, breached BIGINT")

    def stored(self) -> list[tuple]:
        found = list(self.open.get())
        return [tuple(np.array(c, t) for c, t in zip(zip(*found), ("i8", "f8", "i8", "f8", "f8")))] if found else []

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        length, parts = self.alarms[key[0]][3] * 1000, self.stored()
        for batch in rows:
            value = batch["value"].to_numpy("f8")
            parts.append(_per_period([(batch["ts"].to_numpy("i8") // length, value, np.ones(len(value), "i8"), value, value)]))
            if sum(len(p[0]) for p in parts[1:]) > AT_ONCE:
                parts = [_per_period(parts)]
        return self.advance(key, parts, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.due.clear()
        return self.advance(key, self.stored(), timerValues.getCurrentWatermarkInMs())

    def advance(self, key, parts: list[tuple], now: int) -> Iterator[pd.DataFrame]:
        rule, series = key
        alarm, _, statistic, seconds, op, threshold, periods = self.alarms[rule]
        length = seconds * 1000
        figures = list(zip(*(column.tolist() for column in _per_period(parts)))) if parts else []
        ready = sum((f[0] + 1) * length <= now for f in figures)
        last, breached = self.closed.get() if self.closed.exists() else (None, 0)
        out = []
        for period, total, n, low, high in figures[:ready]:
            if last is not None and period > last + 1:
                if breached >= periods:
                    out.append((last + 1, None, False, False))
                breached = 0
            value = {"Sum": total, "Average": total / n, "Minimum": low}.get(statistic, high)
            breaching = value > threshold if op == ">" else value < threshold if op == "<" else value == threshold
            last, breached = period, breached + 1 if breaching else 0
            out.append((period, value, breaching, breached >= periods))
        if breached >= periods and (last + 2) * length <= now:
            out.append((last + 1, None, False, False))  # a period without data ends the alarm
            breached = 0
        if last is not None:
            self.closed.update((last, breached))
        left = figures[ready:]
        if left:
            self.open.put(left)
        else:
            self.open.clear()
        next_ = [(left[0][0] + 1) * length] if left else []
        self.wake_at(min([*next_, *([(last + 2) * length] if breached >= periods else [])], default=None))
        if out:
            period, value, breaching, on = zip(*out)
            yield pd.DataFrame({"alarm": alarm, "series": series, "periodStart": np.array(period, "i8") * length,
                                "value": _doubles(value), "breaching": breaching, "inAlarm": on})


def alarm_states(samples: DataFrame, alarms: list[tuple] = M.ALARMS, delay: str = "0 seconds") -> DataFrame:
    """Streaming twin of ``metrics.alarm_states``: a row for every closed period with data, and one where silence ends an alarm.

    Samples without a series, a time or a value are left out.
    """
    whole = samples.where(F.col("series").isNotNull() & F.col("ts").isNotNull() & F.col("value").isNotNull())
    ruled = M.with_rules(whole, [(i, a[1]) for i, a in enumerate(alarms)], ["rule", "metric"])
    timed = ruled.select("rule", "series", "ts", F.col("value").cast("double").alias("value"), E.ts("ts").alias("_at")).withWatermark("_at", delay)
    return timed.groupBy("rule", "series").transformWithStateInPandas(
        statefulProcessor=_Alarm(alarms), outputStructType=ALARM_STATES, outputMode="append", timeMode="eventTime")


# ---- late rows -------------------------------------------------------------------------------------

class _Marker(StatefulProcessor):
    """Compares rows with the watermark of their batch; keeps nothing."""

    def __init__(self, names: list[str], ts: str):
        self.names, self.ts = names, ts

    def init(self, handle) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs()
        for r in rows:
            yield Row(*self.names, "late")(*[r[c] for c in self.names], r[self.ts] <= mark)

    def close(self) -> None:
        pass


def marked_late(events: DataFrame, delay: str, ts: str = "createdAt", spread: int = 64) -> DataFrame:
    """Every event with ``late``: whether the query's watermark had passed it, so that Spark would drop it.

    Rows without a time are left out.  ``spread`` is how many tasks share the work.
    """
    plain = [c for c, kind in events.dtypes if not kind.startswith(("map", "variant"))]
    salted = events.where(F.col(ts).isNotNull()).withColumn("_salt", F.pmod(F.xxhash64(*plain), F.lit(spread)))
    out = T.StructType([*events.schema.fields, T.StructField("late", T.BooleanType())])
    return _watched(salted, ts, delay).groupBy("_salt").transformWithState(
        statefulProcessor=_Marker(events.columns, ts), outputStructType=out, outputMode="append", timeMode="eventTime")


class _Windows(Timed):
    """Counts of one window until the watermark passes its end; afterwards its rows are late, one by one."""

    def __init__(self, columns: list[str], keys: list[str], window_ms: int):
        self.columns, self.keys, self.window = columns, keys, window_ms

    def states(self, handle) -> None:
        self.count = handle.getValueState("count", "n BIGINT")

    def row(self, key, kind, n, values) -> Row:
        return Row("kind", "windowStart", "n", *self.columns)(kind, key[-2], n, *values)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        end = key[-2] + self.window
        if end <= timerValues.getCurrentWatermarkInMs():
            for r in rows:
                yield self.row(key, "late", 1, [r[c] for c in self.columns])
            return
        n = sum(1 for _ in rows) + (self.count.get()[0] if self.count.exists() else 0)
        self.count.update((n,))
        self.wake_at(end)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.due.clear()
        n = self.count.get()[0]
        self.count.clear()
        own = dict(zip(self.keys, key))
        yield self.row(key, "window", n, [own.get(c) for c in self.columns])


def windows_and_late(events: DataFrame, keys: list[str], window_ms: int, delay: str, ts: str = "createdAt", spread: int = 8) -> DataFrame:
    """Counts per closed window and key, and every row that came after its window had closed.

    ``kind`` is ``window`` with a count in ``n``, or ``late`` with the row's own columns and 1: together they
    are the input that the watermark has passed.  The watermark is the query's own.  A window of a key is
    counted by ``spread`` tasks, whose counts ``window_totals`` adds up.
    """
    timed = events.where(F.col(ts).isNotNull()).withColumns(
        {"_start": E.window_start(ts, window_ms).cast("bigint"),
         "_salt": F.pmod(F.xxhash64(*[c for c, kind in events.dtypes if not kind.startswith(("map", "variant"))]), F.lit(spread))})
    out = T.StructType([T.StructField("kind", T.StringType()), T.StructField("windowStart", T.LongType()), T.StructField("n", T.LongType()),
                        *[T.StructField(f.name, f.dataType) for f in events.schema.fields]])
    return _watched(timed, ts, delay).groupBy(*keys, "_start", "_salt").transformWithState(
        statefulProcessor=_Windows(events.columns, keys, window_ms), outputStructType=out, outputMode="append", timeMode="eventTime")


def window_totals(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.where("kind = 'window'").groupBy(*keys, "windowStart").agg(F.sum("n").alias("n"))


# ---- change feeds ----------------------------------------------------------------------------------

class _Versions(Timed):
    """The position of a key's latest change; a deleted key is remembered until no older change can come."""

    def __init__(self, names: list[str]):
        self.names = names

    def states(self, handle) -> None:
        self.latest = handle.getValueState("latest", "ts BIGINT, lsn BIGINT")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        top = max(rows, key=lambda r: (r["ts"], r["lsn"]))
        at = (top["ts"], top["lsn"])
        if self.latest.exists() and tuple(self.latest.get()) >= at:
            return
        self.latest.update(at)
        self.wake_at(top["ts"] if top["row"] is None else None)
        yield Row(*self.names)(*top)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.due.clear()
        self.latest.clear()
        return iter(())


def latest_changes(changes: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Streaming twin of ``lifecycle.compact_by_key`` over parsed changes (key, op, ts, lsn, row).

    Gives a change only when it is the latest of its key so far, by (ts, lsn): out of order or replayed ones
    give nothing.  A null ``row`` deletes.  The feed may be out of order by ``delay``; changes behind the
    watermark are dropped, so a deleted key's position goes once it is behind it.  Living keys keep theirs.
    """
    timed = changes.where(F.col("ts").isNotNull()).withColumn("lsn", F.coalesce("lsn", F.lit(-1).cast("bigint")))
    timed = timed.withColumn("_at", E.ts("ts")).withWatermark("_at", delay)
    return timed.groupBy("key").transformWithState(
        statefulProcessor=_Versions(timed.columns), outputStructType=timed.schema, outputMode="append", timeMode="eventTime").drop("_at")
