"""Checks on tables. Each either returns the offending rows as a DataFrame or raises ContractError; none collects a table."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class ContractError(ValueError):
    """A table isn't as an operator needs it."""


def require_columns(df: DataFrame, columns: Iterable[str], label: str = "table") -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ContractError(f"{label} lacks {', '.join(missing)}")
    return df


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of more than one row, with their number of rows; null is a value like others."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")


def require_unique(df: DataFrame, keys: list[str], label: str = "table") -> DataFrame:
    some = duplicate_keys(df, keys).limit(3).collect()
    if some:
        raise ContractError(f"{label} has repeated keys, such as {[tuple(r) for r in some]}")
    return df


def lookup_join(df: DataFrame, lookup: DataFrame, keys: list[str], label: str = "lookup") -> DataFrame:
    """Left join that can't add rows: the lookup's keys are checked to be unique and known."""
    if not lookup.filter(reduce(lambda a, b: a | b, (F.col(k).isNull() for k in keys))).isEmpty():
        raise ContractError(f"{label} has a null key")
    require_unique(lookup, keys, label)
    return df.join(lookup, keys, "left")


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, rows): how many rows break each rule, in one pass. A rule is the condition of a bad row; null isn't one."""
    counts = df.agg(*(F.count_if(c).alias(f"c{i}") for i, c in enumerate(rules.values())))
    pairs = F.array(*(F.struct(F.lit(n).alias("rule"), F.col(f"c{i}").alias("rows")) for i, n in enumerate(rules)))
    return counts.select(F.inline(pairs))


def require_none(df: DataFrame, rules: dict[str, Column], label: str = "table") -> DataFrame:
    bad = violations(df, rules).filter("rows > 0").collect()
    if bad:
        raise ContractError(f"{label}: " + ", ".join(f"{r['rows']} rows with {r['rule']}" for r in bad))
    return df


def key_difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys on one side only, with side ``left`` or ``right``; null keys are equal to each other."""
    a = left.select(*keys).distinct().withColumn("__l", F.lit(1))
    b = right.select(*keys).distinct().withColumn("__r", F.lit(1))
    same = reduce(lambda x, y: x & y, (a[k].eqNullSafe(b[k]) for k in keys))
    both = a.join(b, same, "full")
    side = F.when(F.col("__r").isNull(), "left").when(F.col("__l").isNull(), "right")
    return both.select(*(F.coalesce(a[k], b[k]).alias(k) for k in keys), side.alias("side")).filter("side is not null")


def varying_within(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """(group, column, values): columns that have more than one known value within a group."""
    counts = df.filter(F.col(group).isNotNull()).groupBy(group).agg(*(F.count_distinct(c).alias(f"n{i}") for i, c in enumerate(columns)))
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("values")) for i, c in enumerate(columns)))
    return counts.select(group, F.inline(pairs)).filter("values > 1")


def coverage_drops(df: DataFrame, period: str, present: Column, least: float = 0.5) -> DataFrame:
    """Rows with a value per period against the period before, flagged where fewer than the share least remain."""
    yearly = df.filter(F.col(period).isNotNull()).groupBy(period).agg(F.count_if(present).alias("n"))
    before = F.lag("n").over(Window.orderBy(period))  # one row per period
    return yearly.withColumn("before", before).withColumn("dropped", F.coalesce(F.col("n") < least * F.col("before"), F.lit(False)))
