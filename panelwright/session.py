"""Session settings and the folder that all executors share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_CHECKPOINTS: dict[str, str] = {}


def local_session(cpus: int | str = "*", app: str = "panelwright", memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine. On a cluster the caller's own session is used as it is."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where the setting is absent, as in local tests."""
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    key = spark.sparkContext.applicationId
    if key not in _LOCAL_CHECKPOINTS:
        _LOCAL_CHECKPOINTS[key] = tempfile.mkdtemp(prefix="panelwright-")
        atexit.register(shutil.rmtree, _LOCAL_CHECKPOINTS[key], ignore_errors=True)
        spark.sparkContext.setCheckpointDir(_LOCAL_CHECKPOINTS[key])
    return "file://" + _LOCAL_CHECKPOINTS[key]


def _tables(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tables/{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there and a lost executor costs no recomputation.

    Tables lie in a folder of the application; `discard` deletes single ones, `release` all of them.
    """
    spark = df.sparkSession
    path = f"{_tables(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._cut_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes tables written by `cut` that no DataFrame still to be evaluated reads."""
    for table in tables:
        if path := getattr(table, "_cut_path", None):
            _delete(table.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Deletes all tables that `cut` wrote in this application, once their results have been used."""
    _delete(spark, _tables(spark))


def spread(df: DataFrame, parts: int | None = None) -> DataFrame:
    """df for work that is heavy per row: dealt out anew where its files give fewer partitions than half the cores."""
    cores = parts or df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores // 2 else df


def local_path(uri: str) -> str | None:
    """The plain path of a file: URI or None for other file systems."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if uri.startswith(os.sep) else None


def table_rows(df: DataFrame) -> int:
    """Row count; over Parquet it comes from the footers, without reading a column."""
    return df.count()


#: Partitions of one shuffle; more burden the driver. Groups and buckets within them aren't limited in number.
MOST_PARTITIONS = 100_000


def buckets_for(spark: SparkSession, rows: int, per_bucket: int) -> int:
    """Number of buckets so that one holds about per_bucket rows, at least the session's default; it grows without limit."""
    default = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(1, min(default, max(1, rows // 1000)), -(-rows // per_bucket))


def partitions_for(spark: SparkSession, rows: int, per_partition: int) -> int:
    """The same for shuffle partitions, at most MOST_PARTITIONS."""
    return min(MOST_PARTITIONS, buckets_for(spark, rows, per_partition))
