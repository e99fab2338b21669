"""Streaming readers and record decoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schema as S

MAX_OFFSETS_PER_TRIGGER = 50_000


def kafka_options(servers: str, topic: str, starting: str = "latest",
                  max_offsets: int = MAX_OFFSETS_PER_TRIGGER) -> dict[str, str]:
    return {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": starting,
            "maxOffsetsPerTrigger": str(max_offsets), "failOnDataLoss": "false"}


def kafka_records(spark: SparkSession, servers: str, topic: str, **kw) -> DataFrame:
    """Topic records; needs the spark-sql-kafka package on the classpath."""
    return spark.readStream.format("kafka").options(**kafka_options(servers, topic, **kw)).load()


def file_stream(spark: SparkSession, folder: str, schema, fmt: str = "parquet", max_files: int = 1000,
                glob: str | None = None) -> DataFrame:
    """Files of a folder as a stream."""
    reader = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", max_files)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(folder)


def table_stream(spark: SparkSession, sf: str, name: str, max_files: int = 1000) -> DataFrame:
    """A benchmark table as a stream, whether it is one file or a folder of files."""
    path = f"{sf}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.getFileStatus(hadoop).isDirectory():
        return file_stream(spark, path, schema, max_files=max_files)
    return file_stream(spark, sf, schema, max_files=max_files, glob=f"{name}.parquet")


def decode_json(records: DataFrame, schema: str = S.ENRICHED_EVENT, value: str = "value") -> DataFrame:
    """Bus columns beside the decoded record; a record without an id was not readable."""
    keep = [c for c in records.columns if c != value]
    body = F.from_json(F.col(value).cast("string"), schema.replace(" NOT NULL", ""))
    return records.select(*keep, body.alias("_e")).select(*keep, "_e.*").where(F.col("id").isNotNull())


def avro_available(spark: SparkSession) -> bool:
    try:
        spark._jvm.java.lang.Class.forName("org.apache.spark.sql.avro.AvroDataToCatalyst")
        return True
    except Exception:
        return False


def decode_avro(records: DataFrame, avro_schema: str, value: str = "value") -> DataFrame:
    """As ``decode_json`` for Avro bodies; needs the spark-avro package on the classpath."""
    from pyspark.sql.avro.functions import from_avro

    keep = [c for c in records.columns if c != value]
    body = from_avro(F.col(value), avro_schema, {"mode": "PERMISSIVE"})
    return records.select(*keep, body.alias("_e")).select(*keep, "_e.*").where(F.col("id").isNotNull())
