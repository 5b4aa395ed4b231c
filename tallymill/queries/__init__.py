"""Importing this package fills the registry."""

from tallymill.queries import (  # noqa: F401
    dataset_queries, expression_queries, metric_queries, reconcile_queries, result_queries, source_queries,
    stream_queries,
)
from tallymill.queries.registry import ORACLES, QUERIES  # noqa: F401
