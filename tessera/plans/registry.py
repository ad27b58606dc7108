"""All registered queries outside the training-data operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import domain_queries, governance_queries, round_trips, session_queries, stream_queries, structure_queries, text_queries

MODULES = (text_queries, governance_queries, session_queries, structure_queries, domain_queries, stream_queries, round_trips)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_queries.r9(spark, sf_dir)


def queries() -> dict:
    return {name: fn for m in MODULES for name, (fn, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
