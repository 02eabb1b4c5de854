"""Filings matched to fiscal periods and the treatment that follows from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.operators.panel import best_row


def canonical_filing(filings: DataFrame, firm: str, period: str, filed: str, form: str, accession: str) -> DataFrame:
    """One filing per firm and period: an original before an amendment, the earliest, the smallest accession number."""
    known = filings.filter(F.col(form).isin("10-K", "10-K/A") & F.col(firm).isNotNull() & F.col(period).isNotNull())
    return best_row(known, [firm, period], [F.when(F.col(form) == "10-K", 0).otherwise(1).asc(), F.col(filed).asc_nulls_last(), F.col(accession).asc()])


def newest_row(df: DataFrame, keys: list[str], updated: str, tie: str) -> DataFrame:
    """Newest row per key; an unknown time counts as newest, as it does where nulls sort first in descending order."""
    return best_row(df, keys, [F.col(updated).desc_nulls_first(), F.col(tie).desc()])


def treatment_dates(filings: DataFrame, firm: str, filed: str, score: str, weak: int = 2, strong: int = 3) -> DataFrame:
    """Per firm the first date of a filing with at least the weak score, and with the strong one."""
    date = F.col(filed)
    return filings.filter(F.col(firm).isNotNull()).groupBy(firm).agg(F.min(F.when(F.col(score) >= weak, date)).alias("first_date"), F.min(F.when(F.col(score) == strong, date)).alias("first_strong_date"), F.count(score).alias("n_scored"))


def absorbing_treatment(panel: DataFrame, dates: DataFrame, firm: str, period_end: str, year: str) -> DataFrame:
    """Adds has_history, adopted and adoption_year.

    adopted is null for a firm without scored filings, else 1 in periods that end strictly after the first date, else 0.
    adoption_year is null without history, 0 without a treated period, else the first year with one.
    """
    joined = panel.join(dates.select(firm, "first_date", F.col("n_scored").alias("__n")), firm, "left")
    history = F.coalesce(F.col("__n") > 0, F.lit(False))
    after = F.coalesce(F.col(period_end) > F.col("first_date"), F.lit(False))
    first = F.min(F.when(after, F.col(year))).over(Window.partitionBy(firm))
    return joined.withColumns({"has_history": history, "adopted": F.when(history, after.cast("int")), "adoption_year": F.when(history, F.coalesce(first, F.lit(0)))}).drop("__n")


def reversals(panel: DataFrame, firm: str, order: str, state: str) -> DataFrame:
    """Per firm whether the state ever falls from one known row to the next, and how often."""
    w = Window.partitionBy(firm).orderBy(order)
    steps = panel.filter(F.col(firm).isNotNull() & F.col(state).isNotNull()).select(firm, (F.col(state) < F.lag(state).over(w)).alias("__down"))
    return steps.groupBy(firm).agg(F.count_if("__down").alias("n_falls"), F.coalesce(F.bool_or("__down"), F.lit(False)).alias("reversed"))


def cohort_mismatch(panel: DataFrame, firm: str, year: str, treated: str, cohort: str) -> DataFrame:
    """Firms whose first treated year isn't their cohort (0 stands for never)."""
    first = panel.filter(F.col(firm).isNotNull()).groupBy(firm).agg(F.min(F.when(F.col(treated) == 1, F.col(year))).alias("first_treated"), F.max(cohort).alias("cohort"))
    return first.filter(F.col("cohort").isNotNull() & (F.coalesce("first_treated", F.lit(0)) != F.col("cohort")))


def prevalence(panel: DataFrame, year: str, treated: str) -> DataFrame:
    """Per year the known rows, the treated ones and their share."""
    return panel.groupBy(year).agg(F.count(treated).alias("n"), F.sum(treated).cast("long").alias("n_treated"), F.avg(treated).alias("share"))
