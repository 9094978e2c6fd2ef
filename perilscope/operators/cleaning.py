"""Values: blanks, numbers, month names, missing categories, unions of years."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from perilscope.columns import col_of, cols_of
from perilscope.functions.dates import month_title
from perilscope.functions.text import strip, western_digits
from perilscope.operators.schema import select_existing, tag

# Texts that stand for a missing value.
BLANK_TEXTS = ("", "nan", "<NA>", "None")
UNKNOWN = "Unknown"
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def blank_to_null(df: DataFrame, blanks: Sequence[str] = BLANK_TEXTS) -> DataFrame:
    """Trim every text column and make placeholder texts null."""
    text = {f.name for f in df.schema.fields if isinstance(f.dataType, StringType)}

    def cleaned(name: str) -> Column:
        bare = strip(name)
        return F.when(~bare.isin(*blanks), bare).alias(name)

    return df.select(*[cleaned(c) if c in text else col_of(c) for c in df.columns])


def to_number(text: Column) -> Column:
    """Double of a plain number; other text is null (a type suffix such as ``5d`` too)."""
    bare = strip(western_digits(text))
    return F.when(bare.rlike(NUMBER), bare.try_cast("double"))


def coerce_numeric(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Turn the existing ones of these columns into doubles."""
    fields = {f.name: f.dataType for f in df.schema.fields}

    def number(name: str) -> Column:
        if isinstance(fields[name], StringType):
            return to_number(col_of(name))
        value = col_of(name).cast("double")
        return F.when(~F.isnan(value), value)

    return df.withColumns({n: number(n) for n in names if n in fields})


def normalise_months(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, month_title(name)) if name in df.columns else df


def fill_unknown(df: DataFrame, names: Sequence[str], value: str = UNKNOWN) -> DataFrame:
    """Add missing columns and fill nulls with one category."""
    filled = {
        n: F.coalesce(col_of(n).cast("string"), F.lit(value)) if n in df.columns else F.lit(value)
        for n in names
    }
    return df.withColumns(filled)


def drop_missing(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Keep rows with a value in all of these columns."""
    return df.where(reduce(lambda a, b: a & b, [col_of(n).isNotNull() for n in names]))


def training_set(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    required: Sequence[str] = (),
    unknown: Sequence[str] = (),
) -> DataFrame:
    """The existing features and the label; ``unknown`` features filled, ``required`` present."""
    chosen = select_existing(df, [*features, label])
    fill = [c for c in unknown if c in chosen.columns]
    return drop_missing(fill_unknown(chosen, fill), [label, *required])


def union_years(years: Mapping[int, DataFrame], column: str = "year") -> DataFrame:
    """All years in one table, matched by column name; absent columns are null."""
    tagged = [tag(df, column, year) for year, df in years.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def distinct_values(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.select(*cols_of(names)).distinct()
