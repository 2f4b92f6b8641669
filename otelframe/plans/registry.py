"""All named queries of the telemetry library and their SQL equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from otelframe.plans import analysis, cookbook, stored  # noqa: F401  stored adds its queries to those of analysis
from otelframe.plans.suite import register, run_sql
from otelframe.sources.fixtures import signals


def _cookbook(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register(spark, signals(spark, sf_dir))
        return run_sql(spark, cookbook.spark_text(name))

    return run


def queries() -> dict:
    return {name: _cookbook(name) for name in cookbook.COOKBOOK} | {name: q.run for name, q in analysis.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: cookbook.oracle_text(name) for name in cookbook.COOKBOOK}
    return found | {name: q.sql for name, q in analysis.QUERIES.items() if q.sql}
