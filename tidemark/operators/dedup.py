"""Idempotency: first-wins deduplication and deduplication with expiry."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.skew import with_group_totals

SLICE_MS = 1 << 15  # arrival times of a key in one row: at most as many as a slice has milliseconds


def idempotent_ingest(df: DataFrame, key: str = "idempotencyKey", ts: str = "createdAt",
                      tie: str = "seq") -> DataFrame:
    """Map every row to the first row with its idempotency key.

    Adds ``winnerId`` and ``duplicate``.  Winners come from salted partial aggregates, so a key
    repeated a billion times is no single task.  Rows without a key are never duplicates and skip
    the shuffles.
    """
    keyed = df.where(F.col(key).isNotNull())
    first = F.min(F.struct(F.col(ts).alias("t"), F.col(tie).alias("s"), F.col("id").alias("id")))
    mapped = (with_group_totals(keyed, [key], ["id"], {"_p": first}, {"_first": (F.min, "_p")})
              .withColumn("winnerId", F.col("_first.id")).drop("_first")
              .withColumn("duplicate", F.col("winnerId") != F.col("id")))
    unkeyed = df.where(F.col(key).isNull()).withColumn("winnerId", F.col("id")).withColumn("duplicate", F.lit(False))
    return mapped.unionByName(unkeyed.select(mapped.columns))


def first_per_key(df: DataFrame, key: str = "idempotencyKey", ts: str = "createdAt",
                  tie: str = "seq") -> DataFrame:
    """Only the accepted rows of ``idempotent_ingest``: one aggregate, no join."""
    row = F.struct(*[F.col(c) for c in df.columns])
    kept = (df.where(F.col(key).isNotNull()).groupBy(key)
            .agg(F.min_by(row, F.struct(ts, tie, "id")).alias("_row")).select("_row.*"))
    return kept.unionByName(df.where(F.col(key).isNull()))


def purge_expired(store: DataFrame, now_ms: int) -> DataFrame:
    return store.where(F.col("expiresAt") >= now_ms)


def accept_with_ttl(df: DataFrame, keys: list[str], ts: str, tie: str, ttl_ms: int,
                    slice_ms: int = SLICE_MS) -> DataFrame:
    """Rows accepted by a store that forgets a key ``ttl_ms`` after it was accepted.

    Acceptance depends on the previously accepted row, so a key is a chain: after a row accepted at
    t comes the first row at or after t + ttl.  Only distinct arrival times matter, so rows are first
    reduced to one per (key, time) and then to one sorted list per (key, slice of time), which no
    number of rows can make longer than the slice has milliseconds.  The slices of a key are then
    walked in order, a batch at a time, with the key's expiry as the only state: a hot key costs its
    distinct times, not its rows.  One plan for all keys; nothing runs while it is built.

    A row without one of its keys is never a duplicate (as in ``idempotent_ingest``) and is accepted;
    of rows of one key and time the least ``tie`` is.  Rows without a time are left out.
    Returns keys, ``ts``, ``tie`` and ``expiresAt``.
    """
    timed = df.where(F.col(ts).isNotNull()).select(*keys, F.col(ts).cast("bigint").alias("_t"), tie)
    keyed = F.lit(True)
    for k in keys:
        keyed = keyed & F.col(k).isNotNull()
    points = timed.where(keyed).groupBy(*keys, "_t").agg(F.min(tie).alias(tie))
    lists = (points.withColumn("_slice", F.floor(F.col("_t") / F.lit(slice_ms))).groupBy(*keys, "_slice")
             .agg(F.array_sort(F.collect_list(F.struct("_t", F.col(tie).alias("s")))).alias("_p")))
    fields = [*[lists.schema[k] for k in keys], T.StructField("_t", T.LongType()), T.StructField(tie, df.schema[tie].dataType)]
    walked = lists.repartition(*keys).sortWithinPartitions(*keys, "_slice").mapInArrow(_walk(keys, tie, ttl_ms), T.StructType(fields))
    accepted = walked.unionByName(timed.where(~keyed))
    return accepted.withColumn("expiresAt", F.col("_t") + ttl_ms).withColumnRenamed("_t", ts)


def _walk(keys: list[str], tie: str, ttl_ms: int) -> Callable:
    """Accept along the sorted slices of each key."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, expires = None, None
        for batch in batches:
            points = batch.column("_p").flatten()
            times = points.field("_t").to_numpy()
            ends = np.cumsum(batch.column("_p").value_lengths().to_numpy())
            owners = zip(*[batch.column(k).to_pylist() for k in keys])
            taken, of, at = [], [], 0
            for i, (owner, end) in enumerate(zip(owners, ends.tolist())):
                if owner != last:
                    last, expires = owner, None
                if expires is not None and times[at] < expires:
                    at += int(np.searchsorted(times[at:end], expires))
                while at < end:
                    taken.append(at)
                    of.append(i)
                    expires = int(times[at]) + ttl_ms
                    at += max(1, int(np.searchsorted(times[at:end], expires)))
                at = end
            rows, hits = pa.array(of, pa.int64()), pa.array(taken, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k).take(rows) for k in keys], points.field("_t").take(hits), points.field("s").take(hits)],
                names=[*keys, "_t", tie])

    return run
