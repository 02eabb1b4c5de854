"""Sources and sinks. Keys are read as text, never inferred as numbers."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType | str, sep: str = ",", **options) -> DataFrame:
    """Delimited files with a header and the given schema; unusable values become null."""
    return spark.read.options(header=True, sep=sep, mode="PERMISSIVE", multiLine=options.pop("multiLine", True), escape='"', **options).schema(schema).csv(path)


def read_csv_folder(spark: SparkSession, folder: str, schema: T.StructType | str, pattern: str = "*.csv") -> DataFrame:
    """All matching files below a folder as one table, with source_csv, the name of each row's file. Empty files add nothing."""
    df = spark.read.options(header=True, recursiveFileLookup=True, pathGlobFilter=pattern, escape='"').schema(schema).csv(folder)
    return df.withColumn("source_csv", F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)$", 1))


def read_marked_lines(spark: SparkSession, path: str, marker: str, columns: list[str], sep: str = "|") -> DataFrame:
    """Rows of the lines of a delimited file that hold a marker; the others are dropped before they are parsed."""
    lines = spark.read.text(path).filter(F.contains("value", F.lit(marker)))
    parts = F.split("value", re.escape(sep))
    return lines.select(*(F.nullif(F.trim(F.get(parts, F.lit(i))), F.lit("")).alias(c) for i, c in enumerate(columns)))


def read_query(spark: SparkSession, url: str, query: str, **options) -> DataFrame:
    """A query that a database runs, by JDBC."""
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


def with_start_date(query: str, start: str, column: str = "datadate") -> str:
    """The query with the date literal that column is compared with from below replaced; fails if there is none."""
    new, n = re.subn(rf"(\b{re.escape(column)}\s*>=?\s*)'\d{{4}}-\d{{2}}-\d{{2}}'", rf"\g<1>'{start}'", query)
    if not n:
        raise ValueError(f"the query compares {column} with no start date")
    return new


def read_zip_json(spark: SparkSession, path: str, member: str = r"\.json$") -> DataFrame:
    """(archive, member, payload): JSON members of ZIP files whose name matches; one that isn't JSON has a null payload."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    wanted = re.compile(member)
    names = ["archive", "member", "payload"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with zipfile.ZipFile(io.BytesIO(body)) as archive:
                    for one in archive.namelist():
                        if wanted.search(one):
                            text = archive.read(one).decode("utf-8", errors="replace")
                            try:
                                json.loads(text)
                            except ValueError:
                                text = None
                            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([one]), pa.array([text], pa.string())], names)

    return files.mapInArrow(run, "archive string, member string, payload string")


CHUNK = re.compile(r"chunk_(\d{5})\.parquet$")


def list_chunks(paths: list[str]) -> dict[int, str]:
    """Chunk files by number; two files of one number are an error, others are passed over."""
    found: dict[int, str] = {}
    for path in sorted(paths):
        if m := CHUNK.search(path):
            if int(m.group(1)) in found:
                raise ValueError(f"chunk {m.group(1)} exists twice")
            found[int(m.group(1))] = path
    return found


def select_chunks(chunks: dict[int, str], ids: list[int] | None = None, span: tuple[int, int] | None = None, most: int | None = None) -> list[str]:
    """Paths by numbers, by inclusive range or all, at most so many; a number that doesn't exist is an error."""
    if ids is not None and span is not None:
        raise ValueError("give numbers or a range, not both")
    if ids is not None and (missing := [i for i in ids if i not in chunks]):
        raise ValueError(f"no chunk {missing}")
    chosen = [i for i in sorted(chunks) if (ids is None or i in ids) and (span is None or span[0] <= i <= span[1])]
    return [chunks[i] for i in chosen[:most]]


def write_chunks(df: DataFrame, path: str, chunk: str = "chunk_id") -> None:
    """One folder per chunk, its rows together; Spark's commit makes the write whole or absent."""
    df.repartition(chunk).write.mode("overwrite").partitionBy(chunk).parquet(path)


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A small table as Markdown; bars and line breaks within cells are escaped. A table above most rows is an error."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    cell = lambda v: "" if v is None else re.sub(r"\s*[\r\n]+\s*", " ", str(v)).replace("|", "\\|")
    line = lambda values: "| " + " | ".join(map(cell, values)) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *(line(r) for r in rows)])


def clean_names(df: DataFrame) -> DataFrame:
    """Column names in lower case with underscores; repeated ones are numbered."""
    seen: dict[str, int] = {}
    names = []
    for c in df.columns:
        name = re.sub(r"[^a-z0-9]+", "_", c.strip().lower()).strip("_") or "column"
        seen[name] = seen.get(name, 0) + 1
        names.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return df.toDF(*names)


def order_columns(df: DataFrame, first: list[str]) -> DataFrame:
    """The named columns that exist, then the others in their order."""
    return df.select(*[c for c in first if c in df.columns], *[c for c in df.columns if c not in first])
