"""Incremental runs over a folder that receives files: each file once, results by key, restartable at any point."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def process_new_files(spark: SparkSession, source: str, schema: T.StructType | str, step: Callable[[DataFrame], DataFrame], results: str, checkpoint: str, keys: list[str]) -> None:
    """Runs step over the files not yet processed and appends its rows whose keys have no result yet.

    A micro-batch that is repeated after a failure adds nothing twice: its rows carry the batch's number and a repeated
    number replaces its own folder. Keys repeated within a batch are kept once.
    """

    def write(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        rows = step(batch).dropDuplicates(keys)
        done = existing(session, results, rows.schema, before=number)
        rows.join(done.select(*keys), keys, "left_anti").write.mode("overwrite").parquet(f"{results}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(source)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def existing(spark: SparkSession, results: str, schema: T.StructType, before: int | None = None) -> DataFrame:
    """Results so far, those of earlier batches only if before is given; empty before the first run."""
    path = spark._jvm.org.apache.hadoop.fs.Path(results)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return spark.createDataFrame([], schema)
    df = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).parquet(results)
    return (df if before is None else df.filter(F.col("batch") < before)).select(*schema.names)
