"""Streams against their batch twins, restarts, and the file sinks under them."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidemark.operators import anomaly as N
from tidemark.plans import io_queries as IO
from tidemark.plans import jobs
from tidemark.session import exists, names_in, shared_dir, shared_root, use_rocksdb
from tidemark.sinks import files as K
from tidemark.sources import adapter as T
from tidemark.sources import cdc, jdbc
from tidemark.sources import files as SRC
from tidemark.sources import streams as ST
from tidemark.streaming import keyed as KS
from tidemark.streaming import pipeline as PL
from tidemark.streaming import stateful as SF

HOUR = 3_600_000


@pytest.fixture()
def parts(spark, sf):
    """Events in four time-ordered chunks, to arrive one after the other."""
    ev = IO.wire(T.valid_events(spark, sf))
    bounds = ev.approxQuantile("createdAt", [0.25, 0.5, 0.75], 0.0)
    chunk = sum((F.col("createdAt") > b).cast("int") for b in bounds)
    return ev, [ev.where(chunk == i) for i in range(4)]


def source(spark, ev, path):
    return ST.file_stream(use_rocksdb(spark), path, ev.schema, max_files=1)


def test_restart_from_checkpoint_neither_loses_nor_repeats(spark, parts):
    ev, chunks = parts
    path = shared_dir(spark, "restart")
    for chunk in chunks:
        chunk.coalesce(2).write.mode("append").parquet(f"{path}/in")
        PL.run_all([PL.start(source(spark, ev, f"{path}/in"), f"{path}/out", f"{path}/c", ["classification"], interval=None)])
    out = spark.read.parquet(f"{path}/out").select(*ev.columns)
    assert rows(out) == rows(ev)


def test_chunked_baseline_equals_batch(spark, parts):
    """State carried over restarts gives the batch scores of all closed windows."""
    ev, chunks = parts
    path = shared_dir(spark, "ewma")
    for chunk in chunks:
        chunk.coalesce(1).write.mode("append").parquet(f"{path}/in")
        scored = SF.baseline_scores(SF.window_counts(source(spark, ev, f"{path}/in"), 6 * HOUR), 6 * HOUR)
        PL.run_all([PL.start(scored, f"{path}/out", f"{path}/c", [], interval=None)])
    got = spark.read.parquet(f"{path}/out").withColumns({c: F.round(c, 9) for c in ("baseline", "anomalyScore")})
    end = ev.where("classification in ('CONFIDENTIAL', 'RESTRICTED')").agg(F.max("createdAt")).first()[0] - 30_000
    want = (N.window_scores(ev, 6 * HOUR).where(F.col("windowStart") + 6 * HOUR <= end)
            .withColumns({c: F.round(c, 9) for c in ("baseline", "anomalyScore")}).select(got.columns))
    assert rows(got) == rows(want)


def test_update_mode_versions_collapse_to_the_batch_result(spark, parts):
    ev, chunks = parts
    path = shared_dir(spark, "upserts")
    for i, chunk in enumerate(chunks):
        chunk.coalesce(1).write.mode("append").parquet(f"{path}/in")
        PL.run_all([PL.window_upserts(PL.prepared(source(spark, ev, f"{path}/in"), "2 days"), f"{path}/out", f"{path}/c", None)])
        if i in (1, 2):
            PL.compact_windows(spark, f"{path}/out")
            assert [n for n, _ in names_in(spark, f"{path}/out") if n.startswith("batchId=")] == []
    got = PL.read_windows(spark, f"{path}/out")
    from tidemark.operators import aggregates as A
    from tidemark.operators import projections as P
    assert rows(got) == rows(A.stream_window_counts(P.event_time_columns(ev)).select(got.columns))


def test_two_sinks_off_one_source(spark, parts):
    ev, _ = parts
    path = shared_dir(spark, "multi")
    ev.coalesce(1).write.parquet(f"{path}/in")
    PL.run_all(jobs.realtime_job(source(spark, ev, f"{path}/in"), path, f"{path}/c", None))
    assert spark.read.parquet(f"{path}/raw").count() == ev.count()
    assert spark.read.parquet(f"{path}/aggregations").agg(F.sum("eventCount")).first()[0] <= ev.count()


def test_dedup_across_batches(spark):
    path = shared_dir(spark, "dups")
    schema = "id string, idempotencyKey string, createdAt bigint"
    for ids in (["1", "2"], ["3"]):
        spark.createDataFrame([(i, "k" if i != "2" else "other", 1000 * int(i)) for i in ids], schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
        stream = ST.file_stream(use_rocksdb(spark), f"{path}/in", schema)
        PL.run_all([PL.start(PL.deduplicated(stream), f"{path}/out", f"{path}/c", [], interval=None)])
    assert sorted(r["id"] for r in spark.read.parquet(f"{path}/out").collect()) == ["1", "2"]


def test_a_failing_query_stops_its_siblings(spark, parts):
    ev, _ = parts
    path = shared_dir(spark, "fail")
    ev.coalesce(1).write.parquet(f"{path}/in")
    stream = source(spark, ev, f"{path}/in")
    bad = stream.withColumn("x", F.raise_error(F.lit("broken")))
    running = PL.start(stream, f"{path}/ok", f"{path}/c1", [], interval="1 second")
    with pytest.raises(Exception, match="broken"):
        PL.run_all([PL.start(bad, f"{path}/bad", f"{path}/c2", [], interval=None), running])
    assert not running.isActive


# ---- batch sinks and sources -----------------------------------------------------------------------

def test_rerun_of_a_day_keeps_other_days(spark):
    path = shared_dir(spark, "days")
    mk = lambda data: spark.createDataFrame(data, "date string, n int")
    K.write_partitioned(mk([("2024-01-01", 1), ("2024-01-02", 2)]), path, ["date"])
    K.write_partitioned(mk([("2024-01-02", 9)]), path, ["date"])
    assert rows(spark.read.parquet(path).select(F.col("date").cast("string"), "n")) == [("2024-01-01", 1), ("2024-01-02", 9)]
    with pytest.raises(ValueError):
        K.write_partitioned(mk([]), path, ["date"], "xml")


def test_read_partition_prunes_folders(spark):
    path = shared_dir(spark, "prune")
    K.write_partitioned(spark.createDataFrame([("2024-01-01", 1), ("2024-01-02", 2)], "date string, n int"), path, ["date"])
    df = SRC.read_partition(spark, path, "2024-01-02")
    assert [r["n"] for r in df.collect()] == [2]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan


def test_archive_run_twice_appends_once(spark):
    path = shared_dir(spark, "arch")
    df = spark.createDataFrame([("1", "t", "PUBLIC", 0), ("2", "t", "RESTRICTED", 0)], "id string, tenantId string, classification string, createdAt bigint")
    counts = [jobs.archive_job(df, f"{path}/a", f"{path}/m", "2020-01-01", day) for day in ("2024-01-01", "2024-01-02")]
    assert counts == [2, 0]
    assert spark.read.parquet(f"{path}/a").count() == 2
    assert K.read_manifest(spark, f"{path}/m").count() == 2


def test_a_run_that_stopped_before_its_manifest_is_not_repeated(spark, monkeypatch):
    path = shared_dir(spark, "arch-stop")
    df = spark.createDataFrame([(str(i), "t", "PUBLIC", i * 10**9) for i in range(40)], "id string, tenantId string, classification string, createdAt bigint")
    write = K._write_manifest
    monkeypatch.setattr(K, "_write_manifest", lambda *a: (_ for _ in ()).throw(OSError("stopped")))
    with pytest.raises(OSError):
        jobs.archive_job(df, f"{path}/a", f"{path}/m", "2020-01-01", "2020-01-01")
    monkeypatch.setattr(K, "_write_manifest", write)
    jobs.archive_job(df, f"{path}/a", f"{path}/m", "2020-01-01", "2020-01-02")
    assert spark.read.parquet(f"{path}/a").count() == 40
    listed = K.read_manifest(spark, f"{path}/m")
    assert listed.count() == 40 and [r["date"] for r in listed.select("date").distinct().collect()] == ["2020-01-01"]


def test_store_versions_switch_as_a_whole(spark, sf):
    path = shared_dir(spark, "store-switch")
    store = T.sync_copy(spark, sf, "aws")
    K.write_store(store, path, buckets=3)
    assert rows(K.read_store(spark, path).select("id", "aggregateId")) == rows(store.select("id", "aggregateId"))
    changes = store.limit(5).withColumn("syncStatus", F.lit("CHANGED"))
    K.upsert_store(changes, path)
    after = K.read_store(spark, path)
    assert after.count() == store.count() and after.where("syncStatus = 'CHANGED'").count() == 5
    # Data of a version that no pointer names is not seen.
    K.write_partitioned(K.with_bucket(store, 3), f"{path}/data/version=9", ["tenantId", "bucket"])
    assert K.read_store(spark, path).count() == store.count()


def test_expiry_keeps_what_a_recent_reader_may_need(spark, sf):
    import time
    path = shared_dir(spark, "store-expiry")
    store = T.sync_copy(spark, sf, "aws")
    K.write_store(store, path, buckets=1)
    for i in range(3):  # every upsert touches every part
        K.upsert_store(store.withColumn("syncStatus", F.lit(f"S{i}")), path)
    now = int(time.time() * 1000)
    assert K.expire_store(spark, path, now, 3_600_000) == []
    assert K.expire_store(spark, path, now + 3_700_000, 3_600_000) == [0, 1, 2]
    assert K.read_store(spark, path).where("syncStatus = 'S2'").count() == store.count()
    assert [n for n, _ in names_in(spark, f"{path}/pointer") if n.startswith("n=")] == ["n=3"]
    K.upsert_store(store.limit(1).withColumn("syncStatus", F.lit("S3")), path)
    assert K.read_store(spark, path).where("syncStatus = 'S2'").count() == store.count() - 1


def test_dead_letters_are_written_once_whatever_stops(spark, sf, monkeypatch):
    """A run that stops between dead letters and store, its repetition, and the repetition of a finished run."""
    path = shared_dir(spark, "sync-stop")
    K.write_store(T.sync_copy(spark, sf, "aws"), f"{path}/store", buckets=2)
    changes = T.sync_copy(spark, sf, "azure")
    run = lambda name: jobs.sync_job(changes, f"{path}/store", f"{path}/dlq", 0, run=name)
    upsert = K.upsert_store
    monkeypatch.setattr(K, "upsert_store", lambda *a: (_ for _ in ()).throw(OSError("stopped")))
    with pytest.raises(OSError):
        run("r1")
    first = spark.read.parquet(f"{path}/dlq").count()
    monkeypatch.setattr(K, "upsert_store", upsert)
    run("r1")
    store = rows(K.read_store(spark, f"{path}/store").select("id", "aggregateId", "syncStatus"))
    run("r1")
    assert first > 0 and spark.read.parquet(f"{path}/dlq").count() == first
    assert rows(K.read_store(spark, f"{path}/store").select("id", "aggregateId", "syncStatus")) == store


def test_sync_stream_equals_the_job_over_all_changes(spark, sf):
    """Batches of a stream with a restart between them, against the changes applied one after the other."""
    path = shared_dir(spark, "sync-stream")
    base = T.sync_copy(spark, sf, "aws").where("tenantId IN ('tenant-1', 'tenant-2')")
    changes = T.sync_copy(spark, sf, "azure").where("tenantId IN ('tenant-1', 'tenant-2')")
    later = changes.withColumns({"wallClockTs": F.col("wallClockTs") + 1_000, "vectorClock": F.expr("map('aws', 1L, 'azure', 9L)")})
    for name in ("a", "b"):
        K.write_store(base, f"{path}/{name}", buckets=1)
    order = ["wallClockTs", "sourceCloud", "id"]
    for part in (changes, later):
        part.coalesce(1).write.mode("append").parquet(f"{path}/in")
        stream = ST.file_stream(spark, f"{path}/in", changes.schema, max_files=1)
        PL.run_all([jobs.sync_stream(stream, f"{path}/a", f"{path}/dlq-a", f"{path}/c", 0, order=order, interval=None)])
    jobs.sync_job(changes, f"{path}/b", f"{path}/dlq-b", 0, order=order)
    jobs.sync_job(later, f"{path}/b", f"{path}/dlq-b", 0, order=order)
    shown = lambda p: rows(K.read_store(spark, p).select("aggregateId", "id", "syncStatus", "wallClockTs", F.map_entries("vectorClock")))
    assert shown(f"{path}/a") == shown(f"{path}/b")
    letters = lambda p: rows(spark.read.parquet(p).select("aggregateId", "vectorClockJson"))
    assert letters(f"{path}/dlq-a") == letters(f"{path}/dlq-b") != []


def test_jobs_leave_no_intermediates(spark, sf):
    before = {n for n, _ in names_in(spark, shared_root(spark))}
    path = shared_dir(spark, "clean")
    K.write_store(T.sync_copy(spark, sf, "aws"), f"{path}/store", buckets=1)
    jobs.sync_job(T.sync_copy(spark, sf, "azure").limit(20), f"{path}/store", f"{path}/dlq", 0)
    landing = IO.landed(spark, sf)
    jobs.aggregation_job(spark, landing, f"{path}/agg")
    jobs.tenant_metrics_job(spark, f"{path}/agg", f"{path}/metrics", IO.DAY)
    left = {n for n, _ in names_in(spark, shared_root(spark))} - before
    assert left == {path.rsplit("/", 1)[1], landing.rsplit("/", 1)[1]}


def test_late_rows_are_marked_by_the_watermark_of_their_batch(spark):
    path = shared_dir(spark, "marks")
    schema = "id bigint, createdAt bigint"
    for batch in ([(0, 300)], [(1, 240), (2, 250), (3, 251), (4, 900)], [(5, 850), (6, 851), (7, None)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
        src = ST.file_stream(use_rocksdb(spark), f"{path}/in", spark.createDataFrame([], schema).schema, max_files=1)
        PL.run_all([PL.start(KS.marked_late(src, "50 milliseconds"), f"{path}/out", f"{path}/c", [], interval=None)])
    assert {r["id"]: r["late"] for r in spark.read.parquet(f"{path}/out").collect()} == {
        0: False, 1: True, 2: True, 3: False, 4: False, 5: True, 6: False}


def test_nothing_due_writes_nothing(spark):
    path = shared_dir(spark, "arch0")
    df = spark.createDataFrame([("1", "t", "PUBLIC", 10**13)], "id string, tenantId string, classification string, createdAt bigint")
    assert jobs.archive_job(df, f"{path}/a", f"{path}/m", "2020-01-01", "2020-01-02") == 0
    assert [n for n, _ in names_in(spark, f"{path}/a") if not n.startswith("_")] == [] == names_in(spark, f"{path}/a/_open")
    assert not exists(spark, f"{path}/m")


def test_sync_job_applies_and_parks(spark, sf):
    path = shared_dir(spark, "syncjob")
    K.write_store(T.sync_copy(spark, sf, "aws"), f"{path}/store", buckets=2)
    before = K.read_store(spark, f"{path}/store").count()
    jobs.sync_job(T.sync_copy(spark, sf, "azure"), f"{path}/store", f"{path}/dlq", 0)
    jobs.sync_job(T.sync_copy(spark, sf, "azure").limit(1), f"{path}/store", f"{path}/dlq", 0)
    store, parked = K.read_store(spark, f"{path}/store"), spark.read.parquet(f"{path}/dlq")
    assert store.count() > before and parked.count() > 0
    assert store.groupBy("tenantId", "aggregateId").count().where("count > 1").count() == 0


def test_corrupt_json_is_kept_aside(spark, tmp_path):
    day = tmp_path / "date=2024-01-01" / "t"
    day.mkdir(parents=True)
    (day / "a.json").write_text('{"id":"1","tenantId":"t","createdAt":5}\nnot json\n')
    df = SRC.read_json_events(spark, str(tmp_path), "date=2024-01-01", keep_corrupt=True).cache()
    assert sorted((r["id"] or "", r["_corrupt_record"] or "") for r in df.collect()) == [("", "not json"), ("1", "")]
    (day / "b.json").write_text('{"id":"2",\n "tenantId":"t"}')
    assert "2" in [r["id"] for r in SRC.read_json_events(spark, str(tmp_path), multi_line=True).collect()]


def test_change_feed(spark):
    import json
    env = lambda op, b, a, lsn: json.dumps({"op": op, "before": b and json.dumps(b), "after": a and json.dumps(a), "ts_ms": lsn, "source": {"table": "data_events", "lsn": lsn}})
    data = [("a", env("c", None, {"id": "a", "v": 1}, 1), 1, 1), ("a", env("u", {"id": "a", "v": 1}, {"id": "a", "v": 2}, 2), 2, 2),
            ("b", env("c", None, {"id": "b"}, 3), 3, 3), ("b", env("d", {"id": "b"}, None, 4), 4, 4), ("c", env("c", None, {"id": "c"}, 5), 5, 5), ("c", None, 6, 6)]
    df = spark.createDataFrame(data, "key string, value string, offset bigint, timestamp bigint")
    got = {r["key"]: json.loads(r["row"]) for r in cdc.current_state(cdc.parse_changes(df)).collect()}
    assert got == {"a": {"id": "a", "v": 2}}


def test_connector_options():
    o = ST.kafka_options("h:1", "t")
    assert (o["startingOffsets"], o["maxOffsetsPerTrigger"], o["failOnDataLoss"]) == ("latest", "50000", "false")
    j = jdbc.jdbc_options("jdbc:x", "sync_dlq", "id", 0, 10, 4)
    assert (j["partitionColumn"], j["lowerBound"], j["upperBound"], j["numPartitions"]) == ("id", "0", "10", "4")
    with pytest.raises(ValueError):
        jdbc.jdbc_options("jdbc:x", "t", "id")


def test_shared_folder_is_the_cluster_setting(spark):
    assert shared_dir(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_a_large_folder_is_sorted_by_several_tasks(spark, tmp_path):
    """40 MB of one folder: below Spark's own size for a task, above the sink's."""
    key, path = "spark.sql.adaptive.advisoryPartitionSizeInBytes", f"{tmp_path}/out"
    before = spark.conf.get(key)
    big = spark.range(0, 300_000, numPartitions=6).select("id", F.concat(*[F.sha2(F.concat(F.col("id").cast("string"), F.lit(c)), 256) for c in "ab"])
                                                           .alias("text"), F.lit("2024-01-15").alias("date"))
    K.write_partitioned(big, path, ["date"])
    assert spark.read.parquet(path).select(F.input_file_name()).distinct().count() >= 2
    assert spark.read.parquet(path).agg(F.count("id"), F.sum("id")).first()[:] == (300_000, 299_999 * 150_000)
    assert spark.conf.get(key) == before


def test_an_upsert_keeps_one_change_a_key(spark, sf, tmp_path, monkeypatch):
    path, kept = f"{tmp_path}/store", []
    store = T.sync_copy(spark, sf, "aws").limit(200).localCheckpoint()
    changes = store.withColumn("syncStatus", F.lit("OLD")).unionByName(
        store.withColumns({"syncStatus": F.lit("NEW"), "wallClockTs": F.col("wallClockTs") + 1}))
    K.write_store(store, path, 2)

    def cut(df, name, plain=K.cut_lineage):
        done = plain(df, name)
        kept.append(done.count())
        return done

    monkeypatch.setattr(K, "cut_lineage", cut)
    K.upsert_store(changes, path)
    assert kept == [200]
    assert rows(K.read_store(spark, path).select("id", "syncStatus")) == rows(store.select("id", F.lit("NEW").alias("syncStatus")))
