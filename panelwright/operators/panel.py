"""Firm-year panels: one row per key, lags across consecutive years, derived measures, winsorizing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.functions.exprs import clip, null_count, null_sum, plain_ratio, ratio, safe_log
from panelwright.operators.quantiles import exact_quantiles


def best_row(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order, which must end with a unique column to be definite.

    Null keys form groups like other values. Spark limits groups to one row per task before the shuffle.
    """
    return df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__rank = 1").drop("__rank")


def most_complete_row(df: DataFrame, keys: list[str], measures: list[str], date: str, tie: str) -> DataFrame:
    """One row per key: fewest missing measures, then the latest date (null last), then the smallest tie value."""
    ranked = df.withColumn("n_missing", null_count(measures))
    return best_row(ranked, keys, [F.col("n_missing").asc(), F.col(date).desc_nulls_last(), F.col(tie).asc()])


def consecutive_lags(df: DataFrame, firm: str, year: str, columns: list[str], suffix: str = "_l1") -> DataFrame:
    """Adds lag_source_fyear, lag_is_consecutive and of each column the value of the year before, null across gaps.

    (firm, year) must be unique; rows with a null firm get null lags.
    """
    w = Window.partitionBy(firm).orderBy(F.col(year).asc_nulls_first())
    known = F.col(firm).isNotNull()
    out = df.withColumn("lag_source_fyear", F.when(known, F.lag(year).over(w)))
    out = out.withColumn("lag_is_consecutive", F.coalesce(F.col(year) == F.col("lag_source_fyear") + 1, F.lit(False)))
    return out.withColumns({f"{c}{suffix}": F.when(F.col("lag_is_consecutive"), F.lag(c).over(w)) for c in columns})


def winsorize(df: DataFrame, columns: list[str], low: float = 0.01, high: float = 0.99, suffix: str = "_w") -> DataFrame:
    """Adds each column clipped to its own exact quantiles over the whole table (linear interpolation); null stays null.

    The quantiles are those of exact_quantiles; as one row they are joined to the table. A column of nulls alone stays null.
    """
    from panelwright.operators.describe import to_long

    numbered = df.select(*(F.col(c).alias(str(i)) for i, c in enumerate(columns)))
    found = exact_quantiles(to_long(numbered, [], numbered.columns), ["variable"], "value", [low, high])
    pick = lambda i, p: F.max(F.when((F.col("variable") == str(i)) & (F.col("p") == p), F.col("quantile")))
    bounds = found.agg(*(F.struct(pick(i, low).alias("a"), pick(i, high).alias("b")).alias(f"__b{i}") for i in range(len(columns))))
    joined = df.crossJoin(F.broadcast(bounds))  # one row
    out = joined.withColumns({f"{c}{suffix}": clip(F.col(c), F.col(f"__b{i}.a"), F.col(f"__b{i}.b")) for i, c in enumerate(columns)})
    return out.drop(*(f"__b{i}" for i in range(len(columns))))


def with_null_columns(df: DataFrame, columns: dict[str, T.DataType | str]) -> DataFrame:
    """Adds the columns that are missing as nulls of their type."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns})


#: Measures that derived_measures reads; those missing in a table count as null.
INPUTS = ["at", "che", "csho", "dlc", "dltt", "intan", "ni", "xrd", "capx", "prcc_f", "sale", "emp", "xlr", "oibdp", "xopr"]
LAGGED = ["at", "log_at", "log_emp", "markup", "leverage", "cash_ratio", "roa", "firm_age", "log_labor_productivity"]


def derived_measures(df: DataFrame, firm: str = "gvkey", year: str = "fyear", first_year: str = "first_compustat_fyear") -> DataFrame:
    """Levels, logarithms, guarded ratios, first lags, growth and intensities of an annual panel.

    Ratios need a positive denominator; operating_profit alone needs only one that isn't zero. Lags come from the year
    directly before. (firm, year) must be unique.
    """
    df = with_null_columns(df, {c: "double" for c in INPUTS})
    c = F.col
    df = df.withColumns({"total_debt": null_sum(c("dlc"), c("dltt")), "market_cap": c("csho") * c("prcc_f"), "firm_age": F.when(c(year) >= c(first_year), c(year) - c(first_year)), "value_added": null_sum(c("oibdp"), c("xlr"))})
    df = df.withColumns({
        **{f"log_{x}": safe_log(c(x)) for x in ("at", "market_cap", "sale", "emp", "xopr")},
        "leverage": ratio(c("total_debt"), c("at")), "cash_ratio": ratio(c("che"), c("at")), "roa": ratio(c("ni"), c("at")),
        "intangibles_ratio": ratio(c("intan"), c("at")), "markup": ratio(c("oibdp"), c("sale")),
        "avg_wage": F.when(c("xlr") > 0, ratio(c("xlr"), c("emp"))), "labor_productivity": F.when(c("sale") > 0, ratio(c("sale"), c("emp"))),
        "value_added_per_employee": F.when(c("value_added") > 0, ratio(c("value_added"), c("emp"))),
        "rd_reporter": c("xrd").isNotNull(), "tobins_q": ratio(c("market_cap") + c("total_debt"), c("at")),
        "operating_profit": plain_ratio(c("oibdp"), c("at")),
    })
    df = df.withColumns({f"log_{x}": safe_log(c(x)) for x in ("avg_wage", "labor_productivity", "value_added_per_employee")})
    df = consecutive_lags(df, firm, year, LAGGED)
    return df.withColumns({"asset_growth_y": ratio(c("at") - c("at_l1"), c("at_l1")), "rd_intensity_y": ratio(c("xrd"), c("at_l1")), "capx_intensity_y": ratio(c("capx"), c("at_l1")), "total_inv_intensity_y": ratio(null_sum(c("xrd"), c("capx")), c("at_l1"))})


def first_observed(df: DataFrame, firm: str, year: str) -> DataFrame:
    """(firm, first_year) of every known firm."""
    return df.filter(F.col(firm).isNotNull()).groupBy(firm).agg(F.min(year).alias("first_year"))
