"""Relational tables, read in parallel ranges with filters pushed to the database."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Tables of the write side.
TABLES = ["data_events", "idempotency_keys", "outbox_events", "sync_dlq", "key_versions",
          "auth_users", "auth_user_roles", "auth_user_classifications"]


def jdbc_options(url: str, table: str, column: str | None = None, lower=None, upper=None,
                 partitions: int = 64, fetch_size: int = 10_000) -> dict[str, str]:
    """Reader options; ``column`` with its bounds splits the scan into ``partitions`` ranges."""
    options = {"url": url, "dbtable": table, "fetchsize": str(fetch_size), "pushDownPredicate": "true",
               "pushDownAggregate": "true", "pushDownLimit": "true"}
    if column:
        if lower is None or upper is None:
            raise ValueError("a partition column needs both bounds")
        options.update(partitionColumn=column, lowerBound=str(lower), upperBound=str(upper),
                       numPartitions=str(partitions))
    return options


def read_table(spark: SparkSession, url: str, table: str, properties: dict | None = None, **split) -> DataFrame:
    return (spark.read.format("jdbc").options(**jdbc_options(url, table, **split))
            .options(**(properties or {})).load())
