"""Grids of parameters, results over a grid, and tables for publication."""

from __future__ import annotations

import itertools
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.functions.exprs import fixed


def grid(spark: SparkSession, axes: dict[str, list], schema: str, drop: Callable[[dict], bool] | None = None, seed: int | None = None) -> DataFrame:
    """One row per combination of the axes' values, in order, numbered by model from 1; seed adds seed + model - 1.

    drop leaves combinations out. A grid is made on the driver, as each of its rows stands for a plan of its own.
    """
    cells = [dict(zip(axes, values)) for values in itertools.product(*axes.values())]
    kept = [c for c in cells if not (drop and drop(c))]
    rows = [(*c.values(), i + 1, *([seed + i] if seed is not None else [])) for i, c in enumerate(kept)]
    return spark.createDataFrame(rows, schema + ", model int" + (", seed int" if seed is not None else ""))


def without(columns: list[str], outcome: str, swap: dict[str, str]) -> list[str]:
    """Controls of an outcome: those that the outcome itself is made of (swap: outcome -> control) are left out."""
    return [c for c in columns if swap.get(outcome) != c]


def over_grid(cells: DataFrame, run: Callable[[dict], DataFrame]) -> DataFrame:
    """The results of run for every row of the grid, each with the row's columns, as one table.

    One plan is built per cell and all are united, so that Spark runs them side by side.
    """
    parts = []
    for row in cells.orderBy("model").collect():
        out = run(row.asDict())
        parts.append(out.select(*(F.lit(v).cast(t).alias(c) for (c, t), v in zip(cells.dtypes, row)), *out.columns))
    return reduce(DataFrame.unionByName, parts)


def missing_outputs(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Expected rows without an output; null keys are equal to each other."""
    cond = reduce(lambda a, b: a & b, (expected[k].eqNullSafe(found[k]) for k in keys))
    return expected.join(found.select(*keys).distinct(), cond, "left_anti")


def publication_rows(results: DataFrame, row: str, column: str, estimate: Column, error: Column, marks: Column, columns: list[str], digits: int = 3) -> DataFrame:
    """(row, line, a column per name): line 1 has the estimate with its marks, line 2 the error in brackets; empty where there is none."""
    cell = F.array(F.struct(F.lit(1).alias("line"), F.concat(fixed(estimate, digits), marks).alias("text")), F.struct(F.lit(2).alias("line"), F.when(error.isNotNull(), F.concat(F.lit("("), fixed(error, digits), F.lit(")"))).alias("text")))
    long = results.select(F.col(row), F.col(column).alias("__c"), F.inline(cell))
    return long.groupBy(row, "line").agg(*(F.coalesce(F.max(F.when(F.col("__c") == c, F.col("text"))), F.lit("")).alias(str(c)) for c in columns))


def event_times(results: DataFrame, kind: str, step: str) -> DataFrame:
    """Adds event_time: an effect of step k lies k - 1 years after the change, a placebo k years before it."""
    return results.withColumn("event_time", F.when(F.col(kind) == "placebo", -F.col(step)).otherwise(F.col(step) - 1))
