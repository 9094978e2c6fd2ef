"""Year-over-year trend and modal profiles of groups."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perilscope.columns import col_of, cols_of, rows_of
from perilscope.functions.numbers import clip
from perilscope.operators.cleaning import UNKNOWN


def yoy_trend(
    df: DataFrame,
    area: str,
    theme: str,
    year: str,
    quarter: str,
    y1: int,
    y2: int,
    quarters: Sequence[int] = (1, 2),
    lo: float = 0.8,
    hi: float = 1.5,
    only_new: float = 1.2,
    same_period_denominator: bool = False,
    n: str | None = None,
) -> DataFrame:
    """(area, theme, trend): share of the theme in some quarters of year 2 over year 1.

    The numerators count the theme in these quarters; the denominators all rows of the area
    in the year (only those quarters if ``same_period_denominator``). The quotient is
    limited to ``[lo, hi]``; ``only_new`` if only year 2 has rows of the theme, 1 if a year
    is empty or has none. One pass over the data; the totals come from its counts. ``n`` names
    the column with the rows that a row of ``df`` stands for.
    """
    in_period = col_of(quarter).isin(list(quarters))

    def counted(value: int, alias: str):
        return rows_of(n, (col_of(year) == value) & in_period).alias(alias)

    def total(value: int, alias: str):
        rows = col_of(year) == value
        return rows_of(n, rows & in_period if same_period_denominator else rows).alias(alias)

    cells = (
        df.where(col_of(area).isNotNull())
        .groupBy(*cols_of([area, theme]))
        .agg(counted(y1, "n1"), counted(y2, "n2"), total(y1, "t1"), total(y2, "t2"))
    )
    totals = cells.groupBy(col_of(area)).agg(F.sum("t1").alias("all1"), F.sum("t2").alias("all2"))
    r1, r2 = F.col("n1") / F.col("all1"), F.col("n2") / F.col("all2")
    trend = (
        F.when((F.col("all1") == 0) | (F.col("all2") == 0), F.lit(1.0))
        .when(F.col("n1") > 0, clip(r2 / r1, lo, hi))
        .when(F.col("n2") > 0, F.lit(float(only_new)))
        .otherwise(F.lit(1.0))
    )
    return (
        cells.where(col_of(theme).isNotNull())
        .join(totals, area)
        .select(*cols_of([area, theme]), trend.alias("trend"))
    )


def modal_profile(
    df: DataFrame, key: str, features: Sequence[str], default: str = UNKNOWN
) -> DataFrame:
    """The most frequent value of each feature per key, the smallest of equally frequent ones.

    Values are counted before anything is compared, so a key with most of the rows costs
    no more memory than its distinct values.
    """
    pairs = F.explode(
        F.array(
            *[
                F.struct(F.lit(i).alias("feature"), col_of(f).cast("string").alias("value"))
                for i, f in enumerate(features)
            ]
        )
    )
    counts = (
        df.where(col_of(key).isNotNull())
        .select(col_of(key), pairs.alias("_p"))
        .groupBy(col_of(key), F.col("_p")["feature"].alias("f"), F.col("_p")["value"].alias("v"))
        .agg(F.count("*").alias("n"))
    )
    # a null value comes after all others, so it stands only if there is nothing else
    best = counts.groupBy(col_of(key), "f").agg(
        F.min_by("v", F.struct(F.col("v").isNull(), -F.col("n"), F.col("v"))).alias("v")
    )
    return best.groupBy(col_of(key)).agg(
        *[
            F.coalesce(F.max(F.when(F.col("f") == i, F.col("v"))), F.lit(default)).alias(f)
            for i, f in enumerate(features)
        ]
    )


def expand_values(df: DataFrame, name: str, values: Sequence) -> DataFrame:
    """Each row once per value of a short list."""
    return df.select(F.explode(F.array(*[F.lit(v) for v in values])).alias(name), *cols_of(df.columns))


def joined_on(frames: Sequence[DataFrame], key: str) -> DataFrame:
    """Rows of all frames side by side by key; a key missing in one has nulls there."""
    return reduce(lambda a, b: a.join(b, key, "full"), frames)
