"""Paths of an ordinal state over a firm's years. All need (firm, year) unique; rows with a null state are left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _known(df: DataFrame, firm: str, state: str) -> DataFrame:
    return df.filter(F.col(firm).isNotNull() & F.col(state).isNotNull())


def first_switch(df: DataFrame, firm: str, year: str, state: str) -> DataFrame:
    """(firm, initial, first_switch_year, direction): first level, first year with another one, and 1 up or -1 down."""
    w = Window.partitionBy(firm).orderBy(year)
    rows = _known(df, firm, state).withColumn("__first", F.first(state).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    changed = F.when(F.col(state) != F.col("__first"), F.struct(F.col(year).alias("y"), F.signum(F.col(state) - F.col("__first")).cast("int").alias("d")))
    out = rows.groupBy(firm).agg(F.min("__first").alias("initial"), F.min(changed).alias("__c"))
    return out.select(firm, "initial", F.col("__c.y").alias("first_switch_year"), F.col("__c.d").alias("direction"))


def transitions(df: DataFrame, firm: str, year: str, state: str) -> DataFrame:
    """(firm, year, before, after, change_no): every change from one known row to the next, numbered per firm."""
    w = Window.partitionBy(firm).orderBy(year)
    rows = _known(df, firm, state).withColumn("before", F.lag(state).over(w)).withColumn("__c", F.coalesce((F.col(state) != F.col("before")).cast("int"), F.lit(0)))
    rows = rows.withColumn("change_no", F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    return rows.filter("__c = 1").select(firm, year, "before", F.col(state).alias("after"), "change_no")


def path_summary(df: DataFrame, firm: str, year: str, state: str) -> DataFrame:
    """Per firm: path as text, its number of years, switches up and down, and whether 0, 1, 2 occur in this order and 0 is directly followed by 2."""
    w = Window.partitionBy(firm).orderBy(year)
    rows = _known(df, firm, state).select(firm, year, F.col(state).alias("__s"), F.lag(state).over(w).alias("__b"))
    out = rows.groupBy(firm).agg(
        F.array_sort(F.collect_list(F.struct(F.col(year).alias("y"), F.col("__s").alias("s")))).alias("__p"), F.count(F.lit(1)).alias("n_years"),
        F.count_if(F.col("__s") > F.col("__b")).alias("n_up"), F.count_if(F.col("__s") < F.col("__b")).alias("n_down"),
        F.coalesce(F.bool_or((F.col("__b") == 0) & (F.col("__s") == 2)), F.lit(False)).alias("direct_0_2"),
    )
    # Greedy subsequence: how far 0, 1, 2 has been met; a firm has at most one row per year.
    met = F.aggregate("__p", F.lit(0), lambda acc, x: F.when(x["s"] == acc, acc + 1).otherwise(acc))
    path = F.array_join(F.transform("__p", lambda x: x["s"].cast("string")), "->")
    return out.select(firm, path.alias("path"), "n_years", "n_up", "n_down", (met >= 3).alias("ordered_0_1_2"), "direct_0_2")


def run_before(df: DataFrame, firm: str, year: str, switch_year: str) -> DataFrame:
    """(firm, n_pre): length of the run of consecutive years that ends the year before switch_year; 0 if that year is missing."""
    rows = df.filter(F.col(firm).isNotNull() & (F.col(year) < F.col(switch_year))).select(firm, year, switch_year)
    w = Window.partitionBy(firm).orderBy(F.col(year).desc())
    rows = rows.withColumn("__back", F.row_number().over(w)).filter(F.col(year) == F.col(switch_year) - F.col("__back"))
    n = rows.groupBy(firm).agg(F.count(F.lit(1)).alias("n_pre"))
    firms = df.filter(F.col(firm).isNotNull() & F.col(switch_year).isNotNull()).select(firm).distinct()
    return firms.join(n, firm, "left").select(firm, F.coalesce("n_pre", F.lit(0)).alias("n_pre"))


def baselines(df: DataFrame, firm: str, year: str, switch_year: str, columns: list[str]) -> DataFrame:
    """(firm, base_year, <column>_pre): values of the year before the switch; of firms without one, of their earliest complete row.

    Switchers without a row for that year have none.
    """
    known = df.filter(F.col(firm).isNotNull())
    before = known.filter(F.col(year) == F.col(switch_year) - 1)
    complete: Column = F.lit(True)
    for c in columns:
        complete = complete & F.col(c).isNotNull()
    rank = F.row_number().over(Window.partitionBy(firm).orderBy(year))
    never = known.filter(F.col(switch_year).isNull() & complete).withColumn("__r", rank).filter("__r = 1").drop("__r")
    pick = [F.col(firm), F.col(year).alias("base_year"), *(F.col(c).alias(f"{c}_pre") for c in columns)]
    return before.select(*pick).unionByName(never.select(*pick))


def merge_intervals(df: DataFrame, keys: list[str], begin: str, end: str, gap: int = 1) -> DataFrame:
    """Union of intervals per key; those at most gap apart are joined. Adds the number of intervals in each."""
    w = Window.partitionBy(*keys).orderBy(begin, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = df.filter(F.col(begin).isNotNull() & F.col(end).isNotNull()).select(*keys, begin, end, F.coalesce((F.col(begin) > reach + gap).cast("int"), F.lit(1)).alias("__new"))
    rows = rows.withColumn("__island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "__island").agg(F.min(begin).alias(begin), F.max(end).alias(end), F.count(F.lit(1)).alias("n_intervals")).drop("__island")
