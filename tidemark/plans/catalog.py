"""The query catalogue: importing this module registers every query."""

from tidemark.plans import (  # noqa: F401
    batch_queries,
    io_queries,
    lifecycle_queries,
    metric_queries,
    reconcile_queries,
)
from tidemark.plans.registry import QUERIES, SQL  # noqa: F401
