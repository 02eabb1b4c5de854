"""Exact quantiles of columns of any size.

No task holds a column's values: they are counted by value, ordered by range, and the ranges' counts tell in which range each
order statistic lies; only those ranges are numbered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.session import cut


def exact_quantiles(df: DataFrame, by: list[str], value: str, probs: list[float]) -> DataFrame:
    """(by, p, quantile): quantiles of the known values of each group by linear interpolation between order statistics.

    Null values don't count, NaN is the largest; a group without known values has no rows. Null groups are groups. A value
    that fills a third of the rows is one row once counted; the largest task holds one range of values.
    """
    spark = df.sparkSession
    names = [f"__g{i}" for i in range(len(by))]
    keys = [*names, "__v"]
    counted = df.select(*(F.col(b).alias(n) for b, n in zip(by, names)), F.col(value).cast("double").alias("__v")).filter("__v is not null").groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    ranged = cut(counted.repartitionByRange(parts, *keys).select(*keys, "__n", F.spark_partition_id().alias("__r")), "ranges")
    group = Window.partitionBy(*names)
    held = ranged.groupBy(*names, "__r").agg(F.sum("__n").alias("__m"))  # one row per group and range
    before = F.coalesce(F.sum("__m").over(group.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = held.withColumns({"__before": before, "__all": F.sum("__m").over(group)})
    # Order statistics from 0: the two around p (n - 1), with the share of the upper one.
    at = F.col("__p") * (F.col("__all") - 1)
    wanted = held.withColumn("__p", F.explode(F.array(*(F.lit(float(p)) for p in probs))))
    wanted = wanted.withColumns({"__low": F.floor(at), "__part": at - F.floor(at)})
    wanted = wanted.withColumn("__k", F.explode(F.array_distinct(F.array("__low", F.least(F.col("__low") + 1, F.col("__all") - 1)))))
    wanted = wanted.filter((F.col("__k") >= F.col("__before")) & (F.col("__k") < F.col("__before") + F.col("__m")))
    wanted = wanted.select(*(F.col(n).alias(f"{n}_w") for n in names), F.col("__r").alias("__rw"), "__p", "__low", "__part", "__k", "__before")
    same = F.col("__r") == F.col("__rw")
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(f"{n}_w"))
    targets = wanted.select(*(F.col(f"{n}_w") for n in names), "__rw").distinct()
    here = ranged.join(targets, same, "left_semi")
    upto = F.sum("__n").over(Window.partitionBy(*names, "__r").orderBy("__v"))
    found = here.withColumn("__upto", upto).join(wanted, same).filter((F.col("__k") < F.col("__before") + F.col("__upto")) & (F.col("__k") >= F.col("__before") + F.col("__upto") - F.col("__n")))
    low, high = F.max(F.when(F.col("__k") == F.col("__low"), F.col("__v"))), F.max(F.when(F.col("__k") > F.col("__low"), F.col("__v")))
    out = found.groupBy(*names, "__p", "__part").agg(low.alias("__a"), high.alias("__b"))
    quantile = F.when(F.col("__part") > 0, F.col("__a") * (1 - F.col("__part")) + F.col("__b") * F.col("__part")).otherwise(F.col("__a"))
    return out.select(*(F.col(n).alias(b) for n, b in zip(names, by)), F.col("__p").alias("p"), quantile.alias("quantile"))


def wide_quantiles(df: DataFrame, by: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """(by, a column per name of probs)."""
    rows = exact_quantiles(df, by, value, list(probs.values()))
    return rows.groupBy(*by).agg(*(F.max(F.when(F.col("p") == p, F.col("quantile"))).alias(n) for n, p in probs.items()))
