"""Names of the registered queries and of the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import jobs, tables


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.snv_pls_metrics(spark, sf_dir)


def queries() -> dict:
    return dict(tables.QUERIES)


def oracle_sql() -> dict:
    return dict(tables.ORACLE)
