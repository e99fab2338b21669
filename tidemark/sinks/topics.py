"""Bus sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Topic names.
ENRICHED = "events.enriched"
PROCESSED = "events.processed"
DLQ = "dlq"


def to_record(df: DataFrame, key: str, topic: str | Column) -> DataFrame:
    """Key, JSON value and topic of each row, as the bus sink expects them."""
    body = [c for c in df.columns]
    return df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*body)).alias("value"),
                     (F.lit(topic) if isinstance(topic, str) else topic).alias("topic"))


def write_kafka(records: DataFrame, servers: str) -> None:
    """Batch write; needs the spark-sql-kafka package."""
    records.write.format("kafka").option("kafka.bootstrap.servers", servers).save()


def stream_kafka(records: DataFrame, servers: str, checkpoint: str, interval: str = "30 seconds"):
    return (records.writeStream.format("kafka").option("kafka.bootstrap.servers", servers)
            .option("checkpointLocation", checkpoint).trigger(processingTime=interval).start())
