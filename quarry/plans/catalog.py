"""Name to query: what the entry point registers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import code_queries, evaluation_queries, graph_queries, more_queries, page_queries, retrieval_queries, system_queries, text_queries  # noqa: F401
from .registry import ORACLES, QUERIES, Query


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fused retrieval of sources for every benchmark item."""
    return retrieval_queries.fusion_only(spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
