"""Whole jobs: daily aggregation, tenant metrics, archive, replication and the real-time path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions import events as E
from tidemark.operators import aggregates as A
from tidemark.operators import analytic as W
from tidemark.operators import lifecycle as L
from tidemark.operators import reconcile as R
from tidemark.operators import routing
from tidemark.session import cut_lineage, job_folder
from tidemark.sinks import files as K
from tidemark.sources import files as SRC
from tidemark.streaming import pipeline as PL


def dated(events: DataFrame) -> DataFrame:
    """Processing date and hour of enriched events."""
    return events.withColumns({"date": F.date_format(E.ts("createdAt"), "yyyy-MM-dd"),
                               "hour": F.hour(E.ts("enrichedAt"))})


def aggregation_job(spark: SparkSession, input_path: str, output_path: str, date: str | None = None,
                    fmt: str = "parquet") -> None:
    """The four daily aggregates of the landed events; of every landed day when no date is given.

    All are sums of one base, which holds the finest counts and how often each latency occurs on a day:
    percentiles are exact, the landing is read once and no events are kept.
    """
    folder = f"date={date}" if date else None
    events = dated(SRC.read_json_events(spark, input_path, folder))
    with job_folder(spark, "aggregation"):
        base = cut_lineage(A.daily_base(events), "base-counts")
        counts = base.where(~F.col("ofLatency"))
        outputs = {"event-counts": A.event_counts_of(counts), "latency-stats": A.latency_stats_of(base),
                   "hourly-rate": A.hourly_rate_of(counts), "top-event-types": W.top_event_types_of(counts)}
        for name, df in outputs.items():
            K.write_partitioned(df, f"{output_path}/{name}", ["date"], fmt)


def tenant_metrics_job(spark: SparkSession, agg_path: str, output_path: str, date: str) -> None:
    """The tenant rows of one day, from three day partitions of the aggregates."""
    day = F.lit(date).cast("date")
    counts = spark.read.parquet(f"{agg_path}/event-counts").where(
        F.col("date").isin(day, F.date_sub(day, 1), F.date_sub(day, 7)))
    latency = SRC.read_partition(spark, f"{agg_path}/latency-stats", date)
    with job_folder(spark, "tenant-metrics"):
        metrics = cut_lineage(W.tenant_metrics(counts, latency).where(F.col("date") == day)
                              .withColumn("computedAt", F.current_timestamp()), "tenant-metrics")
        K.write_partitioned(metrics, f"{output_path}/parquet", ["date"])
        K.write_serving_json(metrics, f"{output_path}/json", date)


def archive_job(events: DataFrame, archive_path: str, manifest_path: str, cutoff: str, run_date: str,
                classification: str = "ALL", archived_at: Column | None = None) -> int:
    """Copy what is old enough to the archive and list it; returns how many events that were."""
    return K.write_archive(routing.archive_eligible(events, cutoff, classification), archive_path, manifest_path, run_date, archived_at)


def sync_job(incoming: DataFrame, store_path: str, dlq_path: str, now_ms: int, config: dict | None = None,
             primary: str = "aws", order: list[str] | None = None, run: str | None = None) -> None:
    """Apply incoming records to a store one after the other; conflicts for review go to the dead letters.

    ``order`` are the columns that order the changes of an aggregate, the arrival order where there
    is one.  A backfill is this job over the records of a date range.

    Dead letters belong to a run: a run that stopped before the store's pointer replaces its own ones
    when it is repeated.  A ``run`` that the store's newest pointer names is done, and repeating it
    changes nothing; without a name the run is the next version of the store.
    """
    spark = incoming.sparkSession
    n, done_run = K.committed_run(spark, store_path)
    if run is not None and run == done_run:
        return
    with job_folder(spark, "sync"):
        applied = R.sync_apply_many(incoming, K.read_store(spark, store_path), config, primary, order)
        letters = L.conflict_entries(applied.parked, now_ms).withColumn("run", F.lit(run or f"version-{n + 1}"))
        K.write_partitioned(letters, dlq_path, ["run"])
        K.upsert_store(applied.done.where("changes > parkedCount").select("record.*"), store_path, run)


def sync_stream(records: DataFrame, store_path: str, dlq_path: str, checkpoint: str, now_ms: int, config: dict | None = None,
                primary: str = "aws", order: list[str] | None = None, interval: str | None = PL.TRIGGER, name: str = "sync") -> StreamingQuery:
    """``sync_job`` over a stream: the store is the state, and every micro-batch a run of its own.

    The store's pointer names the last batch it holds, so a batch that is replayed after a failure is either
    done already or starts over, dead letters included.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        sync_job(batch, store_path, dlq_path, now_ms, config, primary, order, f"{name}-{batch_id}")

    writer = records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return PL.triggered(writer, interval).start()


def realtime_job(events: DataFrame, output_path: str, checkpoint_path: str, interval: str | None = PL.TRIGGER,
                 spread: int = PL.FILES_PER_PARTITION) -> list[StreamingQuery]:
    """Landing and windowed counts off one source; wait for them with ``pipeline.run_all``."""
    ready = PL.prepared(events)
    return [PL.raw_sink(ready, f"{output_path}/raw", f"{checkpoint_path}/raw", interval, spread),
            PL.window_sink(ready, f"{output_path}/aggregations", f"{checkpoint_path}/aggregations", interval)]
