"""Every query of the library by name, with its SQL."""

from __future__ import annotations

from tidelake.plans import feature_queries, relational_queries, target_queries, metric_queries, rule_queries, learning_queries, stream_queries, validation_queries
from tidelake.plans.base import Query

_REGISTRIES = [feature_queries.R, relational_queries.R, target_queries.R, metric_queries.R, rule_queries.R, learning_queries.R, stream_queries.R, validation_queries.R]


def queries() -> dict[str, Query]:
    return {n: q for r in _REGISTRIES for n, q in r.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {n: q for r in _REGISTRIES for n, q in r.sql.items()}
