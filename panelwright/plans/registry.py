"""All queries of the core by name, with SQL where SQL can state the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelwright.plans import describe, estimates, event_time, manifest, panel, runs, text

MODULES = [event_time, panel, describe, manifest, text, estimates, runs]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in MODULES for name, query in module.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.oracle_sql().items()}


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["firm_year_treatment_panel"](spark, sf_dir)
