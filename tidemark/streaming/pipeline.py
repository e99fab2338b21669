"""Streaming queries: landing, windowed aggregates, routing and deduplication.

Every query recovers from its checkpoint.  File sinks commit through their log, and ``foreachBatch``
sinks replace the output of their batch id, so a replayed batch leaves the same rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions import events as E
from tidemark.operators import aggregates as A
from tidemark.operators import projections as P
from tidemark.operators import routing as R
from tidemark.session import exists, names_in, remove
from tidemark.sinks import topics as TP

TRIGGER = "30 seconds"
WATERMARK = "2 minutes"


FILES_PER_PARTITION = 8


def start(df: DataFrame, path: str, checkpoint: str, partition_by: list[str], fmt: str = "parquet",
          interval: str | None = TRIGGER, spread: int = FILES_PER_PARTITION) -> StreamingQuery:
    """Append to files; with ``interval=None`` drain what is there and stop.

    Rows meet by output partition before they are written, or every task would add a file to every
    partition; ``spread`` salts them so that a hot partition is written by that many tasks.
    """
    if partition_by:
        plain = [f.name for f in df.schema if f.name not in partition_by
                 and not isinstance(f.dataType, (T.MapType, T.ArrayType, T.StructType, T.VariantType))]
        salt = F.pmod(F.xxhash64(*plain), F.lit(spread))
        tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        df = df.repartition(tasks, *partition_by, salt)
    writer = df.writeStream.format(fmt).outputMode("append").option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return triggered(writer, interval).start(path)


def triggered(writer, interval: str | None):
    return writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)


def prepared(events: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Time columns and the watermark on ingestion time."""
    return P.event_time_columns(events).withColumn(
        "hour", F.date_format("eventTs", "HH")).withWatermark("ingestionTs", watermark)


def raw_sink(events: DataFrame, path: str, checkpoint: str, interval: str | None = TRIGGER,
             spread: int = FILES_PER_PARTITION) -> StreamingQuery:
    """All events by date, hour and classification."""
    return start(events, path, checkpoint, ["date", "hour", "classification"], interval=interval, spread=spread)


def window_sink(events: DataFrame, path: str, checkpoint: str, interval: str | None = TRIGGER) -> StreamingQuery:
    """Five-minute counts per tenant, each window written once it is closed."""
    return start(A.stream_window_counts(events), path, checkpoint, ["tenantId"], interval=interval, spread=1)


def window_upserts(events: DataFrame, path: str, checkpoint: str, interval: str | None = TRIGGER) -> StreamingQuery:
    """Five-minute counts before they close: every batch writes the windows it changed.

    Rows carry the batch number; ``read_windows`` gives the newest version of each window, and
    ``compact_windows`` keeps what it reads from growing with the number of batches.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        (batch.withColumn("batchId", F.lit(batch_id)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("batchId").parquet(path))

    writer = (A.stream_window_counts(events).writeStream.outputMode("update").foreachBatch(write)
              .option("checkpointLocation", checkpoint))
    return triggered(writer, interval).start()


WINDOW_KEYS = ["tenantId", "classification", "processingPath", "windowStart"]


def _newest_rows(versions: DataFrame) -> DataFrame:
    rest = [c for c in versions.columns if c not in WINDOW_KEYS]
    return versions.groupBy(*WINDOW_KEYS).agg(F.max_by(F.struct(*rest), "batchId").alias("_r")).select(*WINDOW_KEYS, "_r.*")


def latest_windows(versions: DataFrame) -> DataFrame:
    return _newest_rows(versions).drop("batchId")


def read_windows(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of every window: the last compaction and the batches after it, nothing older."""
    return latest_windows(_live_versions(spark, path)[0])


def _live_versions(spark: SparkSession, path: str) -> tuple[DataFrame, list[int], int]:
    """Versions to read, the batches among them, and the number of the last compaction (-1 without one)."""
    done = [int(name[5:]) for name, _ in names_in(spark, f"{path}/_base") if name.startswith("upto=")]
    upto = max((n for n in done if exists(spark, f"{path}/_base/upto={n}/_SUCCESS")), default=-1)
    batches = sorted(int(name[8:]) for name, _ in names_in(spark, path) if name.startswith("batchId="))
    rest = [n for n in batches if n > upto]
    parts = [spark.read.option("basePath", path).parquet(*[f"{path}/batchId={n}" for n in rest])] if rest else []
    if upto >= 0:
        parts.append(spark.read.parquet(f"{path}/_base/upto={upto}"))
    return reduce(DataFrame.unionByName, parts), batches, upto


def compact_windows(spark: SparkSession, path: str) -> int:
    """Fold the batches so far into one version per window and remove them; returns the last batch folded.

    The compaction is visible once it is complete, and only then do its batches and the one before it go.
    Run it between two batches or while the query is stopped: a batch that is replayed is written again
    and is newer than the compaction only if it was not part of it.
    """
    versions, batches, before = _live_versions(spark, path)
    upto = max([before, *batches])
    if upto > before:
        _newest_rows(versions).write.mode("overwrite").parquet(f"{path}/_base/upto={upto}")
        for n in batches:
            remove(spark, f"{path}/batchId={n}")
        if before >= 0:
            remove(spark, f"{path}/_base/upto={before}")
    return upto


def tenant_windows(events: DataFrame, window: str = "5 minutes", grace: str = "30 seconds") -> DataFrame:
    """Closed windows per tenant with counts by classification and by event type.

    Three chained aggregates: the first counts (window, tenant, classification, type), the second sums
    by name of either kind, and the third lists one entry per name, so the maps cost no more than
    their size.
    """
    first = (events.withColumn("eventTs", E.ts("createdAt")).withWatermark("eventTs", grace)
             .groupBy(F.window("eventTs", window).alias("w"), "tenantId", "classification", "eventType")
             .agg(F.count(F.lit(1)).alias("n"), F.sum("payloadSizeBytes").alias("bytes"),
                  E.count_if(F.col("anomalyDetected")).alias("anomalies")))
    entry = lambda kind, name: F.struct(F.lit(kind).alias("kind"), F.col(name).alias("name"))
    named = first.select("w", "tenantId", "n", "bytes", "anomalies",
                         F.explode(F.array(entry("class", "classification"), entry("type", "eventType"))).alias("e"))
    second = (named.groupBy(F.window(F.window_time("w"), window).alias("w"), "tenantId", "e.kind", "e.name")
              .agg(*[F.sum(c).alias(c) for c in ("n", "bytes", "anomalies")]))
    of = lambda kind, c: F.when(F.col("kind") == kind, F.col(c))
    counted = lambda kind: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("name", "n")))))
    return (second.groupBy(F.window(F.window_time("w"), window).alias("w"), "tenantId")
            .agg(F.sum(of("class", "n")).alias("totalEventCount"), F.sum(of("class", "bytes")).alias("totalPayloadBytes"),
                 F.sum(of("class", "anomalies")).alias("anomalyCount"),
                 counted("class").alias("countByClassification"), counted("type").alias("countByEventType"))
            .select("tenantId", F.unix_millis("w.start").alias("windowStart"), F.unix_millis("w.end").alias("windowEnd"),
                    "totalEventCount", "countByClassification", "countByEventType", "totalPayloadBytes", "anomalyCount"))


def processed_sink(events: DataFrame, path: str, checkpoint: str, window: str = "5 minutes",
                   interval: str | None = TRIGGER) -> StreamingQuery:
    """Tenant windows as records of the processed topic."""
    records = TP.to_record(tenant_windows(events, window), "tenantId", TP.PROCESSED)
    return start(records, path, checkpoint, [], interval=interval)


def landing_sink(events: DataFrame, path: str, checkpoint: str, interval: str | None = TRIGGER,
                 spread: int = FILES_PER_PARTITION) -> StreamingQuery:
    """JSON Lines by date and tenant: what the batch jobs read.

    The tenant folder is a copy of the column, so the records themselves stay complete.
    """
    return start(events.withColumn("tenant", F.col("tenantId")), path, checkpoint, ["date", "tenant"],
                 fmt="json", interval=interval, spread=spread)


def deduplicated(events: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """First event per idempotency key within the watermark, with bounded state.

    An event without a key is never a duplicate: it is told apart by its id.
    """
    own = F.when(F.col("idempotencyKey").isNull(), F.col("id"))
    return (events.withColumns({"eventTs": E.ts("createdAt"), "_own": own}).withWatermark("eventTs", watermark)
            .dropDuplicatesWithinWatermark(["idempotencyKey", "_own"]).drop("_own"))


def route_sink(records: DataFrame, path: str, checkpoint: str, interval: str | None = TRIGGER,
               poison: str = "isPoison") -> StreamingQuery:
    """Enriched records and both kinds of dead letters, one read of the batch for all routes.

    The route is a column and the topic a partition, so the batch is written in one job without
    being cached.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        routed = P.with_processing_path(batch.withColumn("route", R.route(F.col(poison))))
        topic = F.when(F.col("route").isin("FAST", "ENRICHMENT"), TP.ENRICHED).otherwise(TP.DLQ)
        out = TP.to_record(routed, "tenantId", topic).withColumn("batchId", F.lit(batch_id))
        (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batchId", "topic").parquet(path))

    writer = records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return triggered(writer, interval).start()


def run_all(queries: list[StreamingQuery]) -> None:
    """Wait for a set of queries; the first failure is raised and the others are stopped."""
    try:
        for q in queries:
            q.awaitTermination()
    finally:
        for q in queries:
            if q.isActive:
                q.stop()
