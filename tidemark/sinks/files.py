"""Batch file sinks.

Writers rebalance by their partition columns: AQE then merges small outputs and splits a partition
that holds most of the rows over several files, so no task writes a hot partition alone.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import events as E
from tidemark.operators import projections as P
from tidemark.operators import reconcile as R
from tidemark.session import cut_lineage, exists, job_folder, names_in, remove, setting, touch

FORMATS = ("parquet", "json", "delta")
TASK_SIZE = "16MB"  # shuffled bytes a writing task sorts by folder; in memory they were up to 17 times as many


def write_partitioned(df: DataFrame, path: str, partition_by: list[str], fmt: str = "parquet",
                      compression: str = "snappy", mode: str = "overwrite", seen: Observation | None = None) -> None:
    """Partitioned write that replaces only the partitions it has rows for; ``seen`` observes their number ``n``.

    A static overwrite would delete every other day, and with it the history growth needs.
    """
    if fmt not in FORMATS:
        raise ValueError(f"format {fmt} is not one of {FORMATS}")
    df = df.hint("rebalance", *partition_by)
    if seen is not None:
        df = df.observe(seen, F.count(F.lit(1)).alias("n"))
    writer = (df.write.format(fmt).mode(mode).partitionBy(*partition_by)
              .option("partitionOverwriteMode", "dynamic"))
    if fmt != "json":
        writer = writer.option("compression", compression)
    with setting(df.sparkSession, "spark.sql.adaptive.advisoryPartitionSizeInBytes", TASK_SIZE):
        writer.save(path)


MANIFEST = ("eventId STRING, tenantId STRING, classification STRING, eventDate DATE, createdAt BIGINT, "
            "archivedAt TIMESTAMP, archiveLocation STRING, date STRING, runId STRING, month STRING")
ARCHIVE_BY = ["year", "month", "classification", "runId"]


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(path)


def _month(day: str) -> Column:
    return F.date_format(day, "yyyy-MM")


def not_yet_archived(events: DataFrame, manifest_path: str) -> DataFrame:
    """Events no manifest lists, so that a repeated run appends nothing twice.

    The manifest is partitioned by the events' month; only the months of these events are read.
    """
    spark = events.sparkSession
    if not exists(spark, manifest_path):
        return events
    first, last = events.agg(*[f(_month(E.utc_date("createdAt"))) for f in (F.min, F.max)]).first()
    if first is None:
        return events
    done = read_manifest(spark, manifest_path).where(F.col("month").between(first, last))
    return events.join(done.select(F.col("eventId").alias("id")), "id", "left_anti")


def write_archive(events: DataFrame, archive_path: str, manifest_path: str, run_date: str,
                  archived_at: Column | None = None) -> int:
    """Add a run to the gzip archive, then list what was archived in its manifest; returns the number of events.

    A run has a number of its own, which both outputs carry, and a mark in ``_open`` from before its first
    file until its manifest is complete.  A run that stopped is finished first, from what it archived, so
    its events are not archived again; only marks are listed for that.  Events are written once: the
    manifest is read from the run's own part of the archive, and the count is observed while writing.
    """
    spark = events.sparkSession
    finish_open_runs(spark, archive_path, manifest_path)
    at = archived_at if archived_at is not None else F.current_timestamp()
    run = f"{run_date}_{uuid.uuid4().hex[:12]}"
    batch = P.archive_columns(not_yet_archived(events, manifest_path), archive_path, at).drop("archiveLocation").withColumn("runId", F.lit(run))
    seen = Observation()
    touch(spark, f"{archive_path}/_open/{run}")
    write_partitioned(batch, archive_path, ARCHIVE_BY, compression="gzip", mode="append", seen=seen)
    n = seen.get["n"]
    _close_run(spark, archive_path, manifest_path, run)
    return n


def _close_run(spark: SparkSession, archive_path: str, manifest_path: str, run: str) -> None:
    """List what the run has in the archive, in place of an earlier try, and take its mark away."""
    own = f"{archive_path}/year=*/month=*/classification=*/runId={run}"
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(own)
    found = fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(fs_path)
    if found is not None and len(found):
        rows = spark.read.option("basePath", archive_path).parquet(own).withColumn("eventDate", F.col("eventDate").cast("date"))
        _write_manifest(rows, archive_path, manifest_path)
    remove(spark, f"{archive_path}/_open/{run}")


def _write_manifest(rows: DataFrame, archive_path: str, manifest_path: str) -> None:
    listed = rows.select(F.col("id").alias("eventId"), "tenantId", "classification", "eventDate", "createdAt", "archivedAt",
                         F.lit(archive_path).alias("archiveLocation"), F.split_part("runId", F.lit("_"), F.lit(1)).alias("date"),
                         "runId", _month("eventDate").alias("month"))
    write_partitioned(listed, manifest_path, ["month", "runId"])


def finish_open_runs(spark: SparkSession, archive_path: str, manifest_path: str) -> None:
    """Write the manifests of runs that stopped before theirs was complete."""
    for run, _ in names_in(spark, f"{archive_path}/_open"):
        _close_run(spark, archive_path, manifest_path, run)


def write_serving_json(df: DataFrame, path: str, date: str) -> None:
    """JSON for the serving side, in the day's folder."""
    df.write.mode("overwrite").json(f"{path.rstrip('/')}/date={date}")


PER_BUCKET = 100_000  # records of a bucket when a store is written without a bucket count
POINTER = "tenantId STRING, bucket INT, version INT, n INT, run STRING"
KEPT_MS = 24 * 3_600_000  # how long a version is kept after the last pointer that names it was replaced


def with_bucket(df: DataFrame, buckets: int) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64("aggregateId"), F.lit(buckets)).cast("int"))


def write_store(df: DataFrame, path: str, buckets: int | None = None) -> None:
    """A record store by tenant and hash bucket; its bucket count follows its size and is kept with it.

    Records lie in folders by version.  A pointer names the version of every (tenant, bucket), and a
    reader follows the newest pointer, so an upsert becomes visible as a whole or not at all.
    """
    spark = df.sparkSession
    buckets = buckets or max(1, -(-df.count() // PER_BUCKET))
    layout = {"buckets": buckets, "schema": df.schema.json()}
    spark.createDataFrame([tuple(layout.values())], "buckets int, schema string").coalesce(1).write.mode("overwrite").json(f"{path}/layout")
    write_partitioned(with_bucket(df, buckets), f"{path}/data/version=0", ["tenantId", "bucket"])
    parts = spark.read.schema(_stored(df.schema)).parquet(f"{path}/data/version=0").select("tenantId", "bucket").distinct()
    _point(spark, path, parts.withColumn("version", F.lit(0)), 0, None)


def _stored(schema: T.StructType) -> T.StructType:
    """What a file holds and its folder names: declared, so nothing is inferred or cast."""
    return T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())])


def _layout(spark: SparkSession, path: str) -> tuple[int, T.StructType]:
    row = spark.read.schema("buckets int, schema string").json(f"{path}/layout").first()
    return row["buckets"], T.StructType.fromJson(json.loads(row["schema"]))


def _point(spark: SparkSession, path: str, rows: DataFrame, n: int, run: str | None) -> None:
    """One small file, which is there or not."""
    named = rows.select("tenantId", "bucket", "version").withColumn("run", F.lit(run).cast("string"))
    named.coalesce(1).write.mode("overwrite").parquet(f"{path}/pointer/n={n}")


def _newest(spark: SparkSession, path: str) -> int:
    """Number of the newest complete pointer."""
    whole = [int(name[2:]) for name, _ in names_in(spark, f"{path}/pointer") if name.startswith("n=")]
    return max(n for n in whole if exists(spark, f"{path}/pointer/n={n}/_SUCCESS"))


def _pointer(spark: SparkSession, path: str, n: int) -> DataFrame:
    return spark.read.schema(POINTER).parquet(f"{path}/pointer/n={n}").drop("n")


def committed_run(spark: SparkSession, path: str) -> tuple[int, str | None]:
    """Number of the newest pointer and the run that wrote it."""
    n = _newest(spark, path)
    first = _pointer(spark, path, n).select("run").first()
    return n, first and first["run"]


def _parts(spark: SparkSession, path: str, pointer: DataFrame, schema: T.StructType) -> DataFrame:
    """Records of the parts that ``pointer`` names; versions that it does not name are not even listed."""
    versions = sorted(r["version"] for r in pointer.select("version").distinct().collect())  # one an upsert, until they expire
    whole = T.StructType([*_stored(schema).fields, T.StructField("version", T.IntegerType())])
    if not versions:
        return spark.createDataFrame([], whole)
    found = spark.read.schema(whole).option("basePath", f"{path}/data").parquet(*[f"{path}/data/version={v}" for v in versions])
    return found.join(pointer.select("tenantId", "bucket", "version"), ["tenantId", "bucket", "version"], "left_semi")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    _, schema = _layout(spark, path)
    return _parts(spark, path, _pointer(spark, path, _newest(spark, path)), schema).drop("bucket", "version").select(*schema.names)


def upsert_store(changes: DataFrame, path: str, run: str | None = None) -> None:
    """Merge changes into a record store: the touched (tenant, bucket) parts are written once, as a new version.

    With ``run`` the pointer says who wrote it.
    """
    spark = changes.sparkSession
    buckets, schema = _layout(spark, path)
    with job_folder(spark, "upsert"):
        n = _newest(spark, path)
        current = _pointer(spark, path, n).select("tenantId", "bucket", "version")
        keys = ["tenantId", "bucket", "aggregateId"]
        # Reduced before they are kept: the merge reads them twice, and what decided them often has them by key.
        last = cut_lineage(R.last_changes(with_bucket(changes.select(*schema.names), buckets), keys), "changes")
        touched = last.select("tenantId", "bucket").distinct()
        store = _parts(spark, path, current.join(touched, ["tenantId", "bucket"], "left_semi"), schema).drop("version")
        merged = R.replace_by_key(store, last, keys)
        write_partitioned(merged, f"{path}/data/version={n + 1}", ["tenantId", "bucket"])
        kept = current.join(touched, ["tenantId", "bucket"], "left_anti")
        _point(spark, path, kept.unionByName(touched.withColumn("version", F.lit(n + 1))), n + 1, run)


def expire_store(spark: SparkSession, path: str, now_ms: int, kept_ms: int = KEPT_MS) -> list[int]:
    """Remove pointers replaced more than ``kept_ms`` ago, and versions that no remaining pointer names.

    A reader that began less than ``kept_ms`` ago still finds its files.  Returns the removed versions.
    """
    newest = _newest(spark, path)
    written = sorted((int(name[2:]), at) for name, at in names_in(spark, f"{path}/pointer") if name.startswith("n="))
    # A pointer is replaced when the next one is written.
    old = [n for (n, _), (_, replaced) in zip(written, written[1:]) if n < newest and replaced < now_ms - kept_ms]
    left = [n for n, _ in written if n not in old]
    named = {r["version"] for n in left for r in _pointer(spark, path, n).select("version").distinct().collect()}
    for n in old:
        remove(spark, f"{path}/pointer/n={n}")
    gone = [v for v, at in ((int(name[8:]), at) for name, at in names_in(spark, f"{path}/data") if name.startswith("version="))
            if v not in named and v <= newest]
    for v in gone:
        remove(spark, f"{path}/data/version={v}")
    return sorted(gone)
