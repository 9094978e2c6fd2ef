"""Counts and shares of one column against another, wide and long."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perilscope.columns import bounded_values, col_of, cols_of, rows_of
from perilscope.functions.numbers import percent


def crosstab(
    df: DataFrame,
    row: str,
    col: str,
    values: Sequence | None = None,
    normalize: bool = False,
    digits: int | None = 1,
    n: str | None = None,
    most: int = 10_000,
) -> DataFrame:
    """One row per ``row`` value, one column per ``col`` value; nulls on either side left out.

    Given ``values`` become the columns, also absent ones; otherwise all there are, of which
    more than ``most`` are an error, since they are columns of the plan. Shares are percentages
    of all non-null rows of the ``row`` value. One aggregate with map-side counts, no pivot
    pass. ``n`` names the column with the rows that a row of ``df`` stands for.
    """
    names = bounded_values(df, col, most) if values is None else list(values)
    known = df.where(col_of(row).isNotNull() & col_of(col).isNotNull())
    counts = known.groupBy(col_of(row)).agg(
        rows_of(n).alias("_total"),
        *[rows_of(n, col_of(col) == v).alias(f"_v{i}") for i, v in enumerate(names)],
    )

    def cell(i: int) -> Column:
        return percent(f"_v{i}", "_total", digits) if normalize else F.col(f"_v{i}")

    return counts.select(col_of(row), *[cell(i).alias(str(v)) for i, v in enumerate(names)])


def share_long(df: DataFrame, row: str, col: str, digits: int | None = 1) -> DataFrame:
    """(row, col, n, pct) for categories too many to be columns."""
    known = df.where(col_of(row).isNotNull() & col_of(col).isNotNull())
    counts = known.groupBy(*cols_of([row, col])).agg(F.count("*").alias("n"))
    totals = counts.groupBy(col_of(row)).agg(F.sum("n").alias("_total"))
    return counts.join(totals, row).select(
        *cols_of([row, col]), "n", percent("n", "_total", digits).alias("pct")
    )


def theme_impact(
    df: DataFrame, theme: str, severity: str, severe: Sequence[str], n: str | None = None
) -> DataFrame:
    """Unrounded share of severe rows per theme, in percent."""
    known = df.where(col_of(theme).isNotNull() & col_of(severity).isNotNull())
    hit = rows_of(n, col_of(severity).isin(list(severe)))
    return known.groupBy(col_of(theme)).agg((hit / rows_of(n) * F.lit(100.0)).alias("impact"))


def worst_group(table: DataFrame, group: str, col: str) -> DataFrame:
    """The group with the largest value, the first by name of equal ones, and the value."""
    return table.agg(
        F.min_by(col_of(group), F.struct(-col_of(col), col_of(group))).alias("group"),
        F.max(col_of(col)).alias("value"),
    )


def to_long(
    df: DataFrame, ids: Sequence[str], values: Mapping[str, str], var: str, val: str
) -> DataFrame:
    """Wide to long; ``values`` maps column names to the labels that stand for them."""
    named = df.select(*cols_of(ids), *[col_of(c).alias(label) for c, label in values.items()])
    return named.unpivot(cols_of(ids), cols_of(values.values()), var, val)


def to_wide(
    df: DataFrame, ids: Sequence[str], var: str, val: str, values: Mapping[str, str]
) -> DataFrame:
    """Long to wide; ``values`` maps labels to column names."""
    return df.groupBy(*cols_of(ids)).agg(
        *[F.max(F.when(col_of(var) == v, col_of(val))).alias(name) for v, name in values.items()]
    )
