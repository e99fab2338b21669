"""Vector clocks as ``map<string, bigint>`` columns; an absent node counts as 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.events import c


def _clock(x) -> Column:
    return F.coalesce(c(x), F.create_map().cast("map<string,bigint>"))


def merge(a, b) -> Column:
    """Per-node maximum."""
    return F.map_zip_with(_clock(a), _clock(b), lambda _n, x, y: F.greatest(x, y))


def increment(clock, node) -> Column:
    one = F.create_map(c(node) if isinstance(node, Column) else F.lit(node), F.lit(1).cast("bigint"))
    return F.map_zip_with(
        _clock(clock), one,
        lambda _n, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


def compare(a, b) -> Column:
    """BEFORE, AFTER, EQUAL or CONCURRENT, seen from ``a``."""
    zero = F.lit(0).cast("bigint")
    signs = F.map_values(F.map_zip_with(
        _clock(a), _clock(b), lambda _n, x, y: F.signum(F.coalesce(x, zero) - F.coalesce(y, zero)).cast("int")))
    le, ge = ~F.array_contains(signs, 1), ~F.array_contains(signs, -1)
    return (F.when(le & ge, "EQUAL").when(le, "BEFORE").when(ge, "AFTER")
            .otherwise("CONCURRENT"))


def concurrent(a, b) -> Column:
    return compare(a, b) == "CONCURRENT"
