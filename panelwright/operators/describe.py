"""Descriptive statistics. Empty groups give null, not an error; quantiles are exact with linear interpolation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.exprs import normal_p
from panelwright.operators.quantiles import exact_quantiles, wide_quantiles


def to_long(df: DataFrame, keys: list[str], columns: list[str], name: str = "variable", value: str = "value") -> DataFrame:
    """One row per row and column, values as doubles. Nulls stay."""
    pairs = F.array(*(F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for c in columns))
    return df.select(*keys, F.inline(pairs))


def to_wide(df: DataFrame, keys: list[str], name: str, value: str, names: list[str]) -> DataFrame:
    """The reverse of to_long for the given names; of several values the largest."""
    return df.groupBy(*keys).agg(*(F.max(F.when(F.col(name) == n, F.col(value))).alias(n) for n in names))


def _beside(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """left with the columns of right, which has at most one row per key; null keys are equal."""
    if not keys:
        return left.crossJoin(F.broadcast(right))  # one row
    renamed = right.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), *(c for c in right.columns if c not in keys))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)))
    return left.join(renamed, same, "left").drop(*(f"__k{i}" for i in range(len(keys))))


def summary_table(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Per variable, and group if by is given: n, mean, sd, min, p25, median, p75, max of the known values."""
    keys, long = [*(by or []), "variable"], to_long(df, by or [], columns)
    stats = long.groupBy(*keys).agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.min("value").alias("min"), F.max("value").alias("max"))
    quartiles = wide_quantiles(long, keys, "value", {"p25": 0.25, "median": 0.5, "p75": 0.75})
    return _beside(stats, quartiles, keys).select(*keys, "n", "mean", "sd", "min", "p25", "median", "p75", "max")


def quick_stats(df: DataFrame, column: str) -> DataFrame:
    """One row: N, mean, sd, p01, p05, p50, p95, p99."""
    one = df.select(F.col(column).cast("double").alias("value"))
    stats = one.agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    return _beside(stats, wide_quantiles(one, [], "value", {f"p{p:02d}": p / 100 for p in (1, 5, 50, 95, 99)}), [])


def correlation(df: DataFrame, x: str, y: str, least: int = 5, by: list[str] | None = None) -> DataFrame:
    """(n, correlation) of the pairs in which both are known; null below least pairs or without variance."""
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    sums = both.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), F.covar_samp(x, y).alias("__c"), (F.stddev_samp(x) * F.stddev_samp(y)).alias("__s"))
    return sums.select(*(by or []), "n", F.when(F.col("n") >= least, F.try_divide("__c", "__s")).alias("correlation"))


def weighted_mean(df: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """Mean of the known values weighted by known weights; null for a weight of zero in all."""
    both = df.filter(F.col(value).isNotNull() & F.col(weight).isNotNull())
    return both.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight)).alias("mean"))


def shares(df: DataFrame, by: list[str], within: list[str] | None = None) -> DataFrame:
    """Counts of the groups and their share of the total, or of the total of the within columns."""
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    if not within:
        total = counts.agg(F.sum("n").alias("__t"))
        return counts.crossJoin(F.broadcast(total)).withColumn("share", F.col("n") / F.col("__t")).drop("__t")  # one row
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*within)))


def balance(df: DataFrame, arm: str, columns: list[str]) -> DataFrame:
    """Per variable: n, mean and sd of the treated and the others, difference, Welch standard error and normal p-value."""
    long = to_long(df.filter(F.col(arm).isNotNull()), [arm], columns)
    aggs = []
    for tag, value in (("treated", True), ("control", False)):
        x = F.when(F.col(arm).cast("boolean") == F.lit(value), F.col("value"))
        aggs += [F.count(x).alias(f"n_{tag}"), F.avg(x).alias(f"mean_{tag}"), F.stddev_samp(x).alias(f"sd_{tag}")]
    out = long.groupBy("variable").agg(*aggs)
    se = F.sqrt(F.col("sd_treated") ** 2 / F.col("n_treated") + F.col("sd_control") ** 2 / F.col("n_control"))
    out = out.withColumn("difference", F.col("mean_treated") - F.col("mean_control")).withColumn("se", F.when((F.col("n_treated") > 1) & (F.col("n_control") > 1), se))
    return out.withColumn("p_value", normal_p(F.col("difference"), F.col("se")))


def standardized_difference(df: DataFrame, arm: str, columns: list[str]) -> DataFrame:
    """Per variable: difference of means over the pooled standard deviation, and both medians."""
    long = to_long(df.filter(F.col(arm).isNotNull()), [arm], columns)
    t, c = (F.when(F.col(arm).cast("boolean") == F.lit(v), F.col("value")) for v in (True, False))
    pooled = F.sqrt((F.var_samp(t) + F.var_samp(c)) / 2)
    smd = long.groupBy("variable").agg(F.try_divide(F.avg(t) - F.avg(c), pooled).alias("smd"))
    medians = exact_quantiles(long.withColumn("__arm", F.col(arm).cast("boolean")), ["variable", "__arm"], "value", [0.5])
    of = lambda v: F.max(F.when(F.col("__arm") == F.lit(v), F.col("quantile")))
    return _beside(smd, medians.groupBy("variable").agg(of(True).alias("median_treated"), of(False).alias("median_control")), ["variable"])


def firm_year_maximum(filings: DataFrame, firm: str, year: str, score: str, status: str, accession: str) -> DataFrame:
    """Per firm and year: highest score, joined sorted accession numbers, filings, scored and failed ones, and their joint status.

    The joint status is retry_success if any is, else success if any is scored or was not to be, else failed. Rows with a
    null firm or year are left out.
    """
    known = filings.filter(F.col(firm).isNotNull() & F.col(year).isNotNull())
    retry, good = F.bool_or(F.col(status) == "retry_success"), F.bool_or(F.col(status).isin("ok", "success", "not_called"))
    return known.groupBy(firm, year).agg(
        F.max(score).alias("max_score"), F.array_join(F.array_sort(F.collect_set(accession)), ";").alias("accessions"), F.count(F.lit(1)).alias("n_filings"),
        F.count(score).alias("n_scored"), F.count_if(F.col(score).isNull()).alias("n_failed"), F.when(retry, "retry_success").when(good, "success").otherwise("failed").alias("status"),
    )


def first_known(df: DataFrame, by: list[str], value: str, order: list[str]) -> DataFrame:
    """Per group the first value that is neither null nor blank, in the given order."""
    key = F.struct(*order, value)
    known = df.filter(F.trim(F.col(value)) != "")
    return known.groupBy(*by).agg(F.min(key).alias("__k")).select(*by, F.col(f"__k.{value}").alias(value))


def latest_known(df: DataFrame, by: list[str], value: str, period: str, windows: dict[str, tuple[int, int]]) -> DataFrame:
    """Per group the value of the latest period in which it is known, and its mean over each window of periods."""
    known = df.filter(F.col(value).isNotNull() & F.col(period).isNotNull())
    latest = F.max(F.struct(F.col(period).alias("p"), F.col(value).alias("v")))
    means = [F.avg(F.when(F.col(period).between(a, b), F.col(value))).alias(n) for n, (a, b) in windows.items()]
    out = known.groupBy(*by).agg(latest.alias("__l"), *means)
    return out.select(*by, F.col("__l.p").alias("latest_period"), F.col("__l.v").alias("latest_value"), *windows)


def survey_long(estimates: DataFrame, errors: DataFrame, keys: list[str], dates: DataFrame, wave: str, titles: DataFrame, code: str) -> DataFrame:
    """Estimates and standard errors by full outer join, with the dates of their wave and the title of their code (null if unknown)."""
    return estimates.join(errors, keys, "full").join(dates, wave, "left").join(titles, code, "left")


def yearly_overview(panel: DataFrame, filings: DataFrame, other: DataFrame, year: str) -> DataFrame:
    """Counts per year of three tables; a year of any is kept, missing counts are 0."""
    count = lambda df, name: df.filter(F.col(year).isNotNull()).groupBy(year).agg(F.count(F.lit(1)).alias(name))
    out = count(panel, "n_panel").join(count(filings, "n_filings"), year, "full").join(count(other, "n_other"), year, "left")
    return out.na.fill(0, ["n_panel", "n_filings", "n_other"])


def slope(df: DataFrame, by: list[str], y: str, x: str) -> DataFrame:
    """Least-squares line of y on x per group; null without variance."""
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    out = both.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.try_divide(F.covar_samp(x, y), F.var_samp(x)).alias("slope"), F.avg(x).alias("__x"), F.avg(y).alias("__y"))
    return out.select(*by, "n", "slope", (F.col("__y") - F.col("slope") * F.col("__x")).alias("intercept"))


def round_numbers(df: DataFrame, digits: int = 3) -> DataFrame:
    """Doubles and floats rounded half to even, for reports."""
    return df.select(*(F.bround(F.col(c), digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


def union_all(frames: list[DataFrame], tags: list[str] | None = None, tag: str = "source") -> DataFrame:
    """Union by name; missing columns are null. With tags each frame's rows carry theirs."""
    if tags:
        frames = [f.withColumn(tag, F.lit(t)) for f, t in zip(frames, tags)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
