"""Spark helpers that several operators of this package share."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perilscope.columns import col_of, cols_of
from perilscope.session import materialise, run_folder

#: More bytes than this are never broadcast.
BROADCAST_BYTES = 32 * 1024 * 1024
WORDS = r"[^\x20\x09-\x0D]+"


def fresh(name: str, taken: Sequence[str]) -> str:
    """``name``, with underscores in front as long as another column is called so."""
    lowered = {t.lower() for t in taken}
    while name.lower() in lowered:
        name = "_" + name
    return name


def text_or_empty(text: str) -> Column:
    return F.coalesce(col_of(text).cast("string"), F.lit(""))


def same(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)


def computed_once(value: Column) -> Column:
    """``value``, kept by the optimizer as a column of its own.

    A filter on a column is otherwise pushed below it, with the column's expression in its
    place; inside lambdas that expression would then be worked out for every element.
    """
    return F.when(F.spark_partition_id() >= 0, value)


def staged(df: DataFrame, replaces: DataFrame | None = None) -> DataFrame:
    """``df`` written as a table in the shared folder and read again.

    For frames that are joined round after round. A checkpoint keeps the estimated size of the
    joins it is made of, as a product that each round squares; a table has the size it has.
    The table of the frame it ``replaces`` is removed.
    """
    spark = df.sparkSession
    path = run_folder(spark, "staged")
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    if replaces is not None:
        for old in {f.rpartition("/")[0] for f in replaces.inputFiles()}:
            target = spark._jvm.org.apache.hadoop.fs.Path(old)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    return out


def small(df: DataFrame, row_bytes: int, limit: int | None = None) -> bool:
    """Whether the rows of ``df``, of at most ``row_bytes`` each, fit a broadcast."""
    limit = BROADCAST_BYTES if limit is None else limit
    return df.count() * row_bytes <= limit


def join_counted(
    left: DataFrame, right: DataFrame, keys: Sequence[str], n: str, share: int = 1000
) -> DataFrame:
    """Left join with unique right keys of which ``right[n]`` says how many left rows they have.

    Keys that hold more than one ``share``-th of those rows are joined by a broadcast; there
    are fewer than ``share`` of them, whatever the size. All others go through a shuffle, in
    which the rows that already have their match, and rows with a null key, are spread evenly.
    The column ``n`` is not part of the result.
    """
    total = right.agg(F.sum(n)).first()[0] or 0
    heavy = right.where(col_of(n) * share > total)
    light = right.where(col_of(n) * share <= total)
    values = [c for c in right.columns if c not in keys and c != n]
    mark, salt = fresh("hit", [*left.columns, *values]), fresh("salt", [*left.columns, *values])
    first = heavy.select(*cols_of(keys), F.struct(*cols_of(values)).alias(mark))
    no_key = reduce(lambda a, b: a | b, [col_of(k).isNull() for k in keys])
    met = left.join(F.broadcast(first), list(keys), "left").withColumn(
        salt,
        F.when(
            no_key | col_of(mark).isNotNull(),
            F.pmod(F.xxhash64(*cols_of(left.columns)), F.lit(1 << 20)) + 1,
        ).otherwise(F.lit(0)),
    )
    rest = light.select(
        *cols_of(keys), F.lit(0).cast("bigint").alias(salt), *cols_of(values)
    )
    joined = met.join(rest, [*keys, salt], "left")
    return joined.select(
        *cols_of(left.columns),
        *[
            F.when(col_of(mark).isNotNull(), F.col(f"`{mark}`.`{v}`"))
            .otherwise(col_of(v))
            .alias(v)
            for v in values
        ],
    )


__all__ = [
    "BROADCAST_BYTES", "WORDS", "col_of", "cols_of", "computed_once", "fresh", "join_counted", "materialise",
    "same", "small", "staged", "text_or_empty",
]
