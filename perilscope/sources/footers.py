"""Counts of a Parquet table from the footers of its files, without reading a value."""

from __future__ import annotations

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from perilscope.columns import col_of, cols_of

#: The reader that answers counts from footers.
SETTINGS = {
    "spark.sql.sources.useV1SourceList": "",
    "spark.sql.parquet.aggregatePushdown": "true",
}


def nested(kind: DataType) -> bool:
    return isinstance(kind, (ArrayType, MapType, StructType))


def pushed(spark: SparkSession, path: str) -> DataFrame:
    """The table as a reader sees it that pushes aggregates down, in a session of its own."""
    other = spark.newSession()
    for key, value in SETTINGS.items():
        other.conf.set(key, value)
    return other.read.parquet(path)


def counted(df: DataFrame, names: list[str]) -> DataFrame:
    """One row: the rows, and those with a value of each column."""
    return df.agg(
        F.count("*").alias("rows"), *[F.count(col_of(c)).alias(f"n{i}") for i, c in enumerate(names)]
    )


def filled_counts(spark: SparkSession, path: str) -> tuple[int, dict[str, int]]:
    """The rows of a table, and for each column those that are not null.

    Flat columns are counted by the footers; nested ones, and all of files whose footers leave
    the numbers out, by a scan of these columns.
    """
    table = spark.read.parquet(path)
    flat = [f.name for f in table.schema.fields if not nested(f.dataType)]
    deep = [f.name for f in table.schema.fields if nested(f.dataType)]
    try:
        row = counted(pushed(spark, path), flat).first()
    except (PySparkException, Py4JJavaError):  # no statistics
        row = counted(table, flat).first()
    counts = {c: row[f"n{i}"] for i, c in enumerate(flat)}
    if deep:
        found = counted(table, deep).first()
        counts |= {c: found[f"n{i}"] for i, c in enumerate(deep)}
    return row["rows"], {c: counts[c] for c in table.columns}


def null_counts(spark: SparkSession, path: str, top: int = 15) -> DataFrame:
    """(column, nulls) of the columns with the most nulls, as ``report.null_counts`` has them."""
    rows, filled = filled_counts(spark, path)
    most = sorted(((rows - n, c) for c, n in filled.items()), key=lambda x: (-x[0], x[1]))[:top]
    return spark.createDataFrame(
        pa.table({
            "column": pa.array([c for _, c in most], pa.string()),
            "nulls": pa.array([n for n, _ in most], pa.int64()),
        })
    ).orderBy(F.desc("nulls"), "column")


def read_filled(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table without the columns that have no value."""
    _, filled = filled_counts(spark, path)
    return spark.read.parquet(path).select(*cols_of(c for c, n in filled.items() if n))
