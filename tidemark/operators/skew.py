"""Joins of a large table with one row per key, when one key may hold much of the table.

AQE splits a skewed join partition only when both inputs come straight from a shuffle; a lookup that
is an aggregate on the join key is not such an input.  Both forms here salt the rows of every key the
same way, whatever the keys' sizes, so nothing has to be counted first and the plan does not depend
on the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 256
COPIES = 16


def _salted(rows: DataFrame, spread_by: list[str], salts: int) -> DataFrame:
    return rows.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(salts)))


def with_group_totals(rows: DataFrame, keys: list[str], spread_by: list[str], partial: dict[str, Column],
                      final: dict[str, tuple], salts: int = SALTS) -> DataFrame:
    """Add totals per key to ``rows``, whose keys must not be null.

    ``spread_by`` are columns that differ within a key.  ``partial`` names aggregates per (key, salt)
    and ``final`` maps an output column to ``(function, partial column)``.  A key has at most
    ``salts`` partial rows, its total is a window over those, and the rows meet it by (key, salt):
    no task gets a whole key, and a key with few rows costs as many partial rows.
    """
    salted = _salted(rows, spread_by, salts)
    whole = Window.partitionBy(*keys)
    totals = (salted.groupBy(*keys, "_salt").agg(*[c.alias(n) for n, c in partial.items()])
              .select(*keys, "_salt", *[f(F.col(c)).over(whole).alias(n) for n, (f, c) in final.items()]))
    return salted.join(totals, [*keys, "_salt"]).drop("_salt")


def lookup_join(rows: DataFrame, lookup: DataFrame, keys: list[str], spread_by: list[str], how: str = "inner",
                copies: int = COPIES) -> DataFrame:
    """Join to a lookup that is small beside ``rows``: it is repeated ``copies`` times, so that many
    tasks share the rows of one key.  Spark still broadcasts it when its measured size allows.
    """
    repeated = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)).cast("array<bigint>")))
    return _salted(rows, spread_by, copies).join(repeated, [*keys, "_salt"], how).drop("_salt")
