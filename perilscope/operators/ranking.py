"""The leading values of groups.

Ranks are taken on counted values, never on raw rows, and the rank filter lets Spark drop
all but the first n per group before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from perilscope.columns import col_of, cols_of, rows_of
from perilscope.functions.text import render
from perilscope.operators.cleaning import drop_missing


def value_counts_by(
    df: DataFrame, keys: Sequence[str], value: str, count: str | None = None
) -> DataFrame:
    """(keys, value, n); ``count`` names the rows that a row of ``df`` stands for."""
    known = drop_missing(df, [*keys, value])
    return known.groupBy(*cols_of([*keys, value])).agg(rows_of(count).alias("n"))


def _leading(counts: DataFrame, keys: Sequence[str], value: str, n: int) -> DataFrame:
    order = Window.partitionBy(*cols_of(keys)).orderBy(F.desc("n"), col_of(value))
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def top_causes(
    df: DataFrame, keys: Sequence[str], value: str, n: int = 3, count: str | None = None
) -> DataFrame:
    """(keys, value, n, rank) of the n most frequent values, ties in text order."""
    return _leading(value_counts_by(df, keys, value, count), keys, value, n)


def top_causes_text(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    n: int = 3,
    text: str = "{cause} ({n})",
    between: str = " • ",
    count: str | None = None,
) -> DataFrame:
    """(keys, causes): the n most frequent values with their counts as one text."""
    entry = F.struct("rank", render(text, {"cause": col_of(value), "n": F.col("n")}).alias("text"))
    return (
        top_causes(df, keys, value, n, count)
        .groupBy(*cols_of(keys))
        .agg(F.sort_array(F.collect_list(entry)).alias("entries"))
        .select(*cols_of(keys), F.array_join(F.col("entries")["text"], between).alias("causes"))
    )


def cause_share(
    df: DataFrame, keys: Sequence[str], value: str, n: int = 3, count: str | None = None
) -> DataFrame:
    """(keys, value, n, rank, share): the leading values with their share in all values."""
    counts = value_counts_by(df, keys, value, count)
    totals = counts.groupBy(*cols_of(keys)).agg(F.sum("n").alias("total"))
    return (
        _leading(counts, keys, value, n)
        .join(totals, list(keys))
        .withColumn("share", F.col("n") / F.col("total"))
        .drop("total")
    )
