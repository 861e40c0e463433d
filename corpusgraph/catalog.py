"""All registered queries outside the llm subpackage, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusgraph.plans import community_queries, evaluation_queries, extraction_queries, graph_queries, index_queries, model_queries, relation_queries, search_queries, sequence_queries, strategy_queries, text_queries, tree_queries  # noqa: F401
from corpusgraph.plans.registry import ORACLES, QUERIES


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: BM25 over all documents for every benchmark passage, with retrieval metrics by exact containment."""
    return QUERIES["ev_metrics"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
