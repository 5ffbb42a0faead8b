"""Queries of the general problems (units, times)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ampora.operators import timestamps, units
from ampora.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stated amount of the feed and of project rows, in kW, kWh or whole units of its currency."""
    return units.found(spark, table(spark, sf_dir, "project_intel"), table(spark, sf_dir, "sources"), table(spark, sf_dir, "projects"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value that states a valid time, in its normal form."""
    return timestamps.found(table(spark, sf_dir, "documents"), table(spark, sf_dir, "dajiala_article"), table(spark, sf_dir, "project_intel"), table(spark, sf_dir, "sources"))


def p4_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many values of each field the pass chose from how many interpretations."""
    times = timestamps.all_times(table(spark, sf_dir, "documents"), table(spark, sf_dir, "dajiala_article"), table(spark, sf_dir, "project_intel"), table(spark, sf_dir, "sources"))
    return times.groupBy("table_name", "field", "candidates").agg(F.count("*").alias("n"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p4_found": p4_found, "p4_choices": p4_choices}


def oracle_sql() -> dict[str, str]:
    """Neither parsing has a SQL form; both are tested on small tables in tests/."""
    return {}
