"""Queries on attributes as known at event time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.functions.keys import firm_key
from panelwright.operators.asof import as_known_at


def _known(spark: SparkSession, sf_dir: str, columns: list[str]) -> DataFrame:
    panel = spark.read.parquet(f"{sf_dir}/analysis_panel.parquet").select("panel_id", "cik", "datadate", *(c for c in columns if c != "version_id"))
    history = spark.read.parquet(f"{sf_dir}/treatment_history.parquet")
    return as_known_at(
        panel, history,
        entity=firm_key(F.col("cik")), event_time=F.col("datadate"),
        version_entity=firm_key(F.col("cik")), effective=F.col("effective_date"), recorded=F.col("recorded_at"),
        version_id="version_id", take={c: c for c in columns},
    )


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _known(spark, sf_dir, ["version_id"]).filter("version_id is not null").select("panel_id", "version_id")


def p1_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every panel row with the treatment values known at its datadate in place of those computed last."""
    return _known(spark, sf_dir, ["version_id", "first_ai_filing_date", "ai_adoption_year"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p1_panel": p1_panel}


def _key(c: str) -> str:
    return f"nullif(regexp_replace(regexp_replace(regexp_replace({c}, '\\.0+([^0-9]*)$', '\\1'), '[^0-9]', '', 'g'), '^0+(.)', '\\1'), '')"


_KNOWN = f"""
WITH p AS (SELECT panel_id, cik, datadate, {_key("cik")} AS k FROM analysis_panel),
v AS (SELECT *, {_key("cik")} AS k FROM treatment_history),
found AS (
    SELECT panel_id, version_id, first_ai_filing_date, ai_adoption_year,
           row_number() OVER (PARTITION BY panel_id ORDER BY effective_date DESC, recorded_at DESC, version_id DESC) AS r
    FROM p JOIN v USING (k) WHERE effective_date < datadate AND recorded_at < CAST(datadate AS TIMESTAMP))
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"{_KNOWN} SELECT panel_id, version_id FROM found WHERE r = 1",
        "p1_panel": f"""{_KNOWN} SELECT p.panel_id, p.cik, p.datadate, f.version_id, f.first_ai_filing_date, f.ai_adoption_year
            FROM p LEFT JOIN (SELECT * FROM found WHERE r = 1) f USING (panel_id)""",
    }
