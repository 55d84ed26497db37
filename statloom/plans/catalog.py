"""All registered queries."""

from __future__ import annotations

from statloom.plans import registry


def _load() -> None:
    from statloom.plans import (  # noqa: F401
        aggregate_queries, join_queries, model_queries, rating_queries, sink_queries, source_queries,
        stream_queries, value_queries, window_queries,
    )


def queries():
    _load()
    return dict(registry.QUERIES)


def oracle_sql():
    _load()
    return dict(registry.SQL)
