"""Small recodes of panels and filings: caps, renames, indicators, interactions and orders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.exprs import ratio


def year_cap(df: DataFrame, year: str, last: int) -> DataFrame:
    """Rows up to the year last; 0 keeps all. With a cap, rows of an unknown year go."""
    return df.filter(F.col(year) <= last) if last else df


def rename_prefixes(df: DataFrame, prefixes: dict[str, str]) -> DataFrame:
    """Columns whose name begins with a key get its value instead; the longest fitting key counts."""
    fit = lambda c: max((p for p in prefixes if c.startswith(p)), key=len, default=None)
    return df.withColumnsRenamed({c: prefixes[p] + c[len(p) :] for c in df.columns if (p := fit(c)) is not None})


def intensity(score: Column) -> Column:
    """A score of 1 to 3 as 0 to 2, anything else null."""
    return F.when(score.between(1, 3), score - 1)


def spending(df: DataFrame, column: str, assets_before: str, name: str) -> DataFrame:
    """Adds name (null as 0, negative as null), name_binary and name_intensity (over the assets of the year before)."""
    amount = F.when(F.coalesce(column, F.lit(0.0)) >= 0, F.coalesce(column, F.lit(0.0)))
    out = df.withColumn(name, amount)
    return out.withColumns({f"{name}_binary": (F.col(name) > 0).cast("int"), f"{name}_intensity": ratio(F.col(name), F.col(assets_before))})


def interactions(df: DataFrame, columns: list[str], factor: str, suffix: str) -> DataFrame:
    """Adds each column times the factor; null if either is."""
    return df.withColumns({f"{c}{suffix}": F.col(c) * F.col(factor) for c in columns})


def trends(df: DataFrame, columns: list[str], year: str, start: int, suffix: str = "_trend") -> DataFrame:
    """Adds each column times the years since start: a fixed characteristic with its own trend."""
    return df.withColumns({f"{c}{suffix}": F.col(c) * (F.col(year) - start) for c in columns})


def stable_rank(df: DataFrame, by: list[str], order: list[Column], position: str, name: str = "rank") -> DataFrame:
    """Adds the row's rank (from 1) within by in the given order; equal rows keep the order of position."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order, F.col(position).asc())))


def head(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group; Spark limits groups per task before the shuffle."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("__r") <= n).drop("__r")


def sorted_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(columns, n, place): groups from the largest, ties by their values; place is their rank."""
    counts = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.orderBy(F.col("n").desc(), *(F.col(c).asc_nulls_first() for c in columns))))  # one row per group


def in_lookup(rows: DataFrame, lookup: DataFrame, pairs: dict[str, str]) -> DataFrame:
    """Rows that the lookup asks for: left columns -> lookup columns, all equal."""
    cond = reduce(lambda a, b: a & b, (rows[a] == lookup[b] for a, b in pairs.items()))
    return rows.join(lookup, cond, "left_semi")
