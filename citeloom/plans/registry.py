"""All registered queries of the library, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from citeloom.plans import assembly_queries, context_queries, enrichment_queries, evidence_queries, file_queries, join_queries, key_queries, outline_queries, pool_queries, record_queries, search_queries, window_queries

Query = Callable[[SparkSession, str], DataFrame]
ALL = key_queries.QUERIES | join_queries.QUERIES | window_queries.QUERIES | search_queries.QUERIES | evidence_queries.QUERIES | file_queries.QUERIES | context_queries.QUERIES | pool_queries.QUERIES | outline_queries.QUERIES | assembly_queries.QUERIES | enrichment_queries.QUERIES | record_queries.QUERIES


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ALL.items() if sql}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and their survivors after the cascade of keys."""
    return join_queries.dedupe_key_cascade(spark, sf_dir)
