"""Expressions over event columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark import schema as S


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ts(millis: Column | str) -> Column:
    return F.timestamp_millis(c(millis))


def utc_date(millis: Column | str) -> Column:
    return F.to_date(ts(millis))


def window_start(millis: Column | str, size_ms: int) -> Column:
    """Start of the epoch-aligned tumbling window that holds ``millis``."""
    return c(millis) - F.pmod(c(millis), F.lit(size_ms))


def is_fast(cls: Column | str) -> Column:
    return c(cls).isin(S.FAST_CLASSES)


def is_enriched(cls: Column | str) -> Column:
    return c(cls).isin(S.ENRICHED_CLASSES)


def processing_path(cls: Column | str) -> Column:
    return F.when(is_enriched(cls), "ENRICHMENT_PATH").otherwise("FAST_PATH")


def by_class(rules: dict, cls: Column | str) -> Column:
    """Value of a per-classification rule; null for an unknown class.

    A four-way literal expression, so no join and no broadcast is needed.
    """
    value = None
    for name, v in rules.items():
        test = c(cls) == name
        value = F.when(test, F.lit(v)) if value is None else value.when(test, F.lit(v))
    return value


def blank(x: Column | str) -> Column:
    return c(x).isNull() | (F.trim(c(x)) == "")


def map_text(m: Column | str) -> Column:
    """Deterministic ``k=v,k=v`` text of a map with string keys."""
    pairs = F.transform(F.map_entries(c(m)),
                        lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return F.array_join(F.array_sort(pairs), ",")


def count_if(cond: Column) -> Column:
    return F.count(F.when(cond, F.lit(1)))
