"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import SparkSession

# Cluster defaults.  AQE picks the number of reduce tasks from real sizes, so the initial
# number is set high and coalesced down; skewed join partitions are split at run time.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.parquet.mergeSchema": "false",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
}


def build_session(app_name: str = "tidemark", master: str | None = None, **conf) -> SparkSession:
    """A session with the defaults above; keyword settings use ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def use_utc(spark: SparkSession) -> SparkSession:
    """Every date in the library is a UTC date."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def use_rocksdb(spark: SparkSession) -> SparkSession:
    """Keep streaming state on local disk with incremental checkpoints, as large state needs."""
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, DEFAULTS[key])
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it.

    A local session that names none gets a temporary folder; a cluster that names none is a
    configuration error, because a driver-local folder would be invisible to the executors.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    root = tempfile.mkdtemp(prefix="tidemark-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


_JOB: ContextVar[str | None] = ContextVar("job folder", default=None)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, or below the running job's part of it."""
    return f"{_JOB.get() or shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


@contextmanager
def job_folder(spark: SparkSession, name: str) -> Iterator[str]:
    """Intermediates written inside belong to one job and go when it ends, also when it fails."""
    path = shared_dir(spark, name)
    token = _JOB.set(path)
    try:
        yield path
    finally:
        _JOB.reset(token)
        remove(spark, path)


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting for the actions inside; afterwards it is what it was."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def _at(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    fs, place = _at(spark, path)
    return fs.exists(place)


def remove(spark: SparkSession, path: str) -> None:
    fs, place = _at(spark, path)
    fs.delete(place, True)


def touch(spark: SparkSession, path: str) -> None:
    """An empty file, which is there or not."""
    fs, place = _at(spark, path)
    fs.create(place, True).close()


def names_in(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Name and modification time in epoch millis of what lies directly in a folder; nothing if it is not there."""
    fs, place = _at(spark, path)
    return [(f.getPath().getName(), f.getModificationTime()) for f in fs.listStatus(place)] if fs.exists(place) else []


def cut_lineage(df, name: str):
    """Write ``df`` to the shared folder and read it back.

    Survives the loss of executors, unlike a local checkpoint, and gives the next step real
    statistics.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
