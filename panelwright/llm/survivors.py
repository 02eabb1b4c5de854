"""Best representative of each group of duplicate records.

Both operators rank by a window of which only the first rows are kept. Spark then limits every group to its first rows per
task before the shuffle, so a group that holds a third of the table sends one or two rows per task, not all its rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")


def best_record(df: DataFrame, keys: list[str], *, usable: dict[str, Column], trust: Column, recency: Column, tie: Column) -> DataFrame:
    """One whole record per group: the one with the most usable fields, then the lowest trust rank, the latest recency
    (null last) and the largest tie value.

    Rows in which a key is null belong to no group and are left out. All columns of df come back unchanged; an empty table
    gives an empty result; wholly equal rows give one of them.
    """
    score = reduce(lambda a, b: a + b, (F.when(c.isNotNull(), 1).otherwise(0) for c in usable.values()))
    known = df.dropna(subset=keys)
    return _first(known, keys, [score.desc(), trust.asc_nulls_last(), recency.desc_nulls_last(), tie.desc_nulls_last()])


def best_fields(df: DataFrame, keys: dict[str, Column], *, usable: dict[str, Column], trust: Column, recency: Column, tie: Column, least_records: int = 2) -> DataFrame:
    """One record per group of at least least_records rows, each field filled on its own.

    keys (name -> expression) make the group; usable (name -> expression) give the field's cleaned value or null where a
    record's value can't be used. Of the records with a usable value the one with the lowest trust rank wins, then the
    latest recency (null last), then the largest tie value. Columns: the keys, then the fields.

    Rows in which a key is null belong to no group. A group without a usable value for a field has null there. Repeated
    rows count as records. An empty table gives an empty result; other columns, of whatever name, aren't read.
    """
    names, fields = list(keys), list(usable)
    inner, most = [f"__k{i}" for i in range(len(names))], max(1, least_records)
    base = df.select(
        *(c.alias(a) for a, c in zip(inner, keys.values())),
        *(c.alias(f"__f{i}") for i, c in enumerate(usable.values())),
        trust.alias("__trust"), recency.alias("__recency"), tie.alias("__tie"),
    )
    types = dict(base.dtypes)
    # A record stands once for each field that it can fill, and once for itself (slot -1), by which a group's records are told.
    slot = lambda i: F.struct(F.lit(i).alias("i"), *(F.col(f"__f{j}").alias(f"v{j}") if i == j else F.lit(None).cast(types[f"__f{j}"]).alias(f"v{j}") for j in range(len(fields))))
    slots = F.array_compact(F.array(slot(-1), *(F.when(F.col(f"__f{i}").isNotNull(), slot(i)) for i in range(len(fields)))))
    keyed = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in inner))
    long = base.select(*inner, F.explode(F.when(keyed, slots)).alias("__slot"), "__trust", "__recency", "__tie")
    order = [F.col("__trust").asc_nulls_last(), F.col("__recency").desc_nulls_last(), F.col("__tie").desc_nulls_last()]
    rank = F.row_number().over(Window.partitionBy(*inner, "__i").orderBy(*order))
    ranked = long.select(*inner, F.col("__slot.i").alias("__i"), *(F.col(f"__slot.v{j}").alias(f"__v{j}") for j in range(len(fields))), "__trust", "__recency", "__tie").withColumn("__rank", rank).filter(F.col("__rank") <= most)
    first = F.col("__rank") == 1
    wide = ranked.groupBy(*inner).agg(*(F.max(F.when(first, F.col(f"__v{j}"))).alias(f"__w{j}") for j in range(len(fields))), F.max(F.when(F.col("__i") == -1, F.col("__rank"))).alias("__n"))
    return wide.filter(F.col("__n") >= most).select(*(F.col(a).alias(b) for a, b in zip(inner, names)), *(F.col(f"__w{j}").alias(n) for j, n in enumerate(fields)))
