"""Small helpers shared by all modules: column references and bounded driver reads."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ColumnLike = Column | str


def quoted(name: str) -> str:
    """Backtick a column name, so that dots and brackets in it are taken literally."""
    return "`" + name.replace("`", "``") + "`"


def col_of(value: ColumnLike) -> Column:
    """A Column as it is; a string as the name of a column."""
    return F.col(quoted(value)) if isinstance(value, str) else value


def cols_of(values: Iterable[ColumnLike]) -> list[Column]:
    return [col_of(v) for v in values]


def free_name(name: str, taken: Iterable[str]) -> str:
    """``name``, with underscores in front as long as another column is called so."""
    lowered = {t.lower() for t in taken}
    while name.lower() in lowered:
        name = "_" + name
    return name


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once.

    Inside higher-order functions Spark evaluates an expression at every place it stands;
    the variable of a lambda over an array of one element is evaluated once.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def constant(value: object, schema: str) -> Column:
    """A nested constant. Spark folds it into a literal of the plan, and it takes one call
    to build, where a column per element would take thousands."""
    return F.from_json(F.lit(json.dumps(value, ensure_ascii=False)), schema)


def rows_of(n: str | None, condition: Column | None = None) -> Column:
    """The number of rows, of those that meet a condition if given.

    With a column ``n``, each row stands for so many: a frame of counts gives the results of
    the rows that were counted.
    """
    if n is None:
        return F.count("*") if condition is None else F.count_if(condition)
    rows = col_of(n) if condition is None else F.when(condition, col_of(n))
    return F.coalesce(F.sum(rows), F.lit(0)).cast("bigint")


def bounded_values(df: DataFrame, column: str, limit: int = 1000) -> list:
    """Distinct non-null values in ascending order, for plan building.

    Meant for category lists (themes, severities, features of a model). Fails beyond
    ``limit`` instead of pulling an unbounded set to the driver.
    """
    rows = (
        df.select(col_of(column).alias("v"))
        .where(F.col("v").isNotNull())
        .distinct()
        .limit(limit + 1)
        .collect()
    )
    if len(rows) > limit:
        raise ValueError(f"column {column!r} has more than {limit} distinct values")
    return sorted(r["v"] for r in rows)
