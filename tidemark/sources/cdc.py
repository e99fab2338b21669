"""Change feeds: before/after envelopes of a logical replication stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import schema as S
from tidemark.operators import lifecycle as L


def parse_changes(records: DataFrame, key_field: str = "id", value: str = "value") -> DataFrame:
    """One change per envelope: table, key, op, order and the row image (null for a delete).

    A null body is a tombstone; its key comes from the record key.
    """
    e = F.from_json(F.col(value).cast("string"), S.CHANGE_ENVELOPE)
    image = F.coalesce("_e.after", "_e.before")
    return (records.withColumn("_e", e).select(
        F.col("_e.source.table").alias("table"),
        F.coalesce(F.get_json_object(image, f"$.{key_field}"), F.col("key").cast("string")).alias("key"),
        F.coalesce("_e.op", F.lit("d")).alias("op"),
        F.coalesce("_e.ts_ms", "timestamp").alias("ts"), F.coalesce("_e.source.lsn", "offset").alias("lsn"),
        F.when(F.coalesce("_e.op", F.lit("d")) != "d", F.col("_e.after")).alias("row")))


def current_state(changes: DataFrame) -> DataFrame:
    """Row image per key after all changes; deleted keys are gone."""
    return L.compact_by_key(changes, ["key"], ["ts", "lsn"], "row")
