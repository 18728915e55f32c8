"""All registered retail queries: name to (spark, sf_dir) -> DataFrame, and name to SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trolley.plans import ingest_queries, model_queries, more_queries, price_queries, stream_queries, text_queries, trend_queries
from trolley.plans.bindings import Tables


def _bound(make: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: make(Tables(spark, sf_dir))


_MODULES = (ingest_queries, model_queries, more_queries, price_queries, stream_queries, text_queries, trend_queries)
QUERIES = {name: _bound(make) for m in _MODULES for name, make in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
