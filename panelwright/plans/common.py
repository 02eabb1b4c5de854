"""Tables, keys and rounding that the query modules share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.functions.keys import firm_key

Query = Callable[[SparkSession, str], DataFrame]

MEASURES = ["total_assets", "che", "dltt", "ni", "xrd", "capx", "sale", "emp", "oibdp", "csho", "prcc_f"]


class Registry:
    """Queries of a module with their SQL."""

    def __init__(self):
        self.query: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None):
        def register(f: Query) -> Query:
            self.query[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that results compare across engines; never within an operator."""
    return df.select(*(F.round(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def sql_key(c: str) -> str:
    """firm_key in SQL."""
    return f"nullif(regexp_replace(regexp_replace(regexp_replace({c}, '\\.0+([^0-9]*)$', '\\1'), '[^0-9]', '', 'g'), '^0+(.)', '\\1'), '')"


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """analysis_panel with the firm's key in one spelling."""
    return table(spark, sf_dir, "analysis_panel").withColumn("firm", firm_key(F.col("cik")))


SQL_PANEL = f"panel AS (SELECT {sql_key('cik')} AS firm, * FROM analysis_panel)"

_MISSING = " + ".join(f"CAST({m} IS NULL AS INT)" for m in MEASURES)

#: One row per firm and fiscal year: fewest missing measures, latest datadate, smallest panel_id.
SQL_UNIQUE = f"""{SQL_PANEL}, uniq AS (
    SELECT * EXCLUDE (r) FROM (
        SELECT *, {_MISSING} AS n_missing, row_number() OVER (PARTITION BY firm, fyear ORDER BY {_MISSING}, datadate DESC NULLS LAST, panel_id) AS r
        FROM panel WHERE firm IS NOT NULL AND fyear IS NOT NULL) WHERE r = 1)"""


def unique_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelwright.operators.panel import most_complete_row

    known = panel(spark, sf_dir).filter("firm is not null and fyear is not null")
    return most_complete_row(known, ["firm", "fyear"], MEASURES, "datadate", "panel_id")


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """filing_manifest with the firm's key and parsed dates."""
    from panelwright.functions.exprs import parse_date

    rows = table(spark, sf_dir, "filing_manifest")
    return rows.withColumns({"firm": firm_key(F.col("cik")), "filed": parse_date(F.col("filing_date")), "period": parse_date(F.col("report_date"))})


def sql_date(c: str) -> str:
    return f"""CASE WHEN regexp_matches(trim({c}), '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN TRY_CAST(trim({c}) AS DATE)
        WHEN regexp_matches(trim({c}), '^[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}$') THEN CAST(try_strptime(trim({c}), '%m/%d/%Y') AS DATE) END"""


SQL_FILINGS = f"filings AS (SELECT *, {sql_key('cik')} AS firm, {sql_date('filing_date')} AS filed, {sql_date('report_date')} AS period FROM filing_manifest)"
