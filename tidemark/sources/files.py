"""File readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schema as S

CORRUPT = "_corrupt_record"


def read_json_events(spark: SparkSession, root: str, folder: str | None = None, schema: str = S.ENRICHED_EVENT,
                     multi_line: bool = False, keep_corrupt: bool = False) -> DataFrame:
    """Landed JSON events below ``root`` (one folder of it when named), at any depth.

    The schema is given, so no inference pass reads the data.  JSON Lines files are split among
    tasks; ``multi_line`` is for one-object-per-file landings and reads each file whole.
    """
    fields = f"{schema.replace(' NOT NULL', '')}, {CORRUPT} STRING"
    path = f"{root.rstrip('/')}/{folder}/" if folder else root
    df = (spark.read.option("recursiveFileLookup", "true").option("multiLine", str(multi_line).lower())
          .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).schema(fields).json(path))
    return df if keep_corrupt else df.drop(CORRUPT)


def read_partition(spark: SparkSession, root: str, date: str, fmt: str = "parquet") -> DataFrame:
    """One day of a ``date=`` partitioned table; the filter prunes folders and keeps the column."""
    return spark.read.format(fmt).load(root).where(F.col("date").cast("string") == date)


def read_days(spark: SparkSession, root: str, dates: list[str], fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).load(root).where(F.col("date").cast("string").isin(dates))
