"""Joins with lookup tables, master data and derived columns."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StringType

from perilscope.columns import col_of, cols_of, free_name
from perilscope.functions.text import strip
from perilscope.session import materialise

BROADCAST_BYTES = 64 * 1024 * 1024
CASE_LIMIT = 40


def fits_broadcast(df: DataFrame, limit: int | None = None) -> bool:
    """Whether the values of ``df`` take at most ``limit`` bytes, by one aggregate over it.

    ``BROADCAST_BYTES`` is the limit if none is given.
    """
    limit = BROADCAST_BYTES if limit is None else limit
    per_row = reduce(
        lambda a, b: a + b,
        [
            F.coalesce(F.octet_length(col_of(f.name)), F.lit(0)) + 16
            if isinstance(f.dataType, StringType)
            else F.lit(16)
            for f in df.schema.fields
        ],
    )
    return (df.agg(F.sum(per_row.cast("bigint")).alias("b")).first()["b"] or 0) <= limit


def common_type(spark: SparkSession, one: DataType, other: DataType) -> DataType:
    """The type as which Spark compares two columns."""
    if one == other:
        return one
    both = F.coalesce(F.lit(None).cast(one), F.lit(None).cast(other))
    return spark.range(0).select(both.alias("k")).schema["k"].dataType


def spread_left_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    salts: int | None = None,
    hot_rows: int = 1_000_000,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Left equi join that stays even when one key holds a large part of ``left``.

    Keys are compared as their common type. All keys with at least ``hot_rows`` rows, and at
    least one row in 100,000, are split over ``salts`` (as many as there are shuffle
    partitions if not given), and their right rows repeated once per salt. There are at most
    100,000 of them, so they are told to both sides by a broadcast. Rows with a null key match
    nothing and are spread the same way. ``counts`` saves the pass over the key columns where
    the rows per key are known: a frame of the keys and ``n``.
    """
    spark = left.sparkSession
    salts = salts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    types = {k: common_type(spark, left.schema[k].dataType, right.schema[k].dataType) for k in keys}
    taken = [*left.columns, *right.columns]
    inner = {k: free_name(f"_key{i}", taken) for i, k in enumerate(keys)}
    hot_, salt_, n_ = (free_name(c, taken) for c in ("_hot", "_salt", "_n"))

    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumns({inner[k]: col_of(k).cast(types[k]) for k in keys})

    if counts is None:
        counts = left.groupBy(*cols_of(keys)).agg(F.count("*").alias(n_))
    else:
        counts = counts.select(*cols_of(keys), col_of("n").alias(n_))
    counts = keyed(counts).groupBy(*inner.values()).agg(F.sum(n_).alias(n_))
    total = counts.agg(F.sum(n_)).first()[0] or 0
    hot = F.broadcast(
        materialise(
            counts.where(F.col(n_) >= max(hot_rows, total // 100_000))
            .na.drop(subset=list(inner.values()))
            .select(*inner.values(), F.lit(True).alias(hot_))
        )
    )
    some_null = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in inner.values()])
    # the partition id also spreads exact copies of a row; both parts survive a task retry
    spread = F.pmod(
        F.xxhash64(*cols_of(left.columns), F.spark_partition_id()), F.lit(salts)
    ).cast("int")
    is_hot = F.coalesce(hot_, F.lit(False))
    salted_left = keyed(left).join(hot, [*inner.values()], "left").withColumn(
        salt_, F.when(some_null | is_hot, spread).otherwise(F.lit(0))
    )
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    salted_right = (
        keyed(right).drop(*keys).join(hot, [*inner.values()], "left")
        .withColumn(salt_, F.explode(copies)).drop(hot_)
    )
    joined = salted_left.join(salted_right, [*inner.values(), salt_], "left")
    others = [c for c in left.columns if c not in keys]
    return joined.select(*cols_of([*keys, *others, *[c for c in right.columns if c not in keys]]))


def join_checked(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    counts: DataFrame | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Left join that broadcasts ``right`` if its size is within ``limit``, else spreads keys."""
    if fits_broadcast(right, limit):
        return left.join(F.broadcast(right), list(keys), "left")
    return spread_left_join(left, right, keys, counts=counts)


#: 64-bit words of a filter at most: 8 MB, enough for some six million keys.
FILTER_WORDS = 1 << 20
HASHES = 4


def key_filter(df: DataFrame, keys: Sequence[Column]) -> Callable[[Sequence[Column]], Column] | None:
    """A Bloom filter of the keys of ``df``: a condition that is true for all of them, and for
    about one in a hundred others; None if there are too many for one to tell.

    The bits are set by a distributed aggregate and travel as one scalar of bounded size, as
    those of Spark's own run-time filters do.
    """
    known = df.select(F.xxhash64(*keys).alias("h")).where(
        reduce(lambda a, b: a & b, [k.isNotNull() for k in keys])
    )
    count = known.agg(F.approx_count_distinct("h")).first()[0]
    words = 1
    while words * 64 < 10 * count:
        words *= 2
    if words > FILTER_WORDS:
        return None

    def places(h: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(h, F.lit(i)), F.lit(words * 64)) for i in range(HASHES)]

    bits = known.select(F.explode(F.array(*places(F.col("h")))).alias("bit"))
    masks = bits.groupBy(F.shiftright("bit", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("mask")
    )
    everywhere = df.sparkSession.range(words).withColumnRenamed("id", "word")
    filled = everywhere.join(masks, "word", "left").select("word", F.coalesce("mask", F.lit(0)).alias("mask"))
    table = filled.agg(
        F.transform(F.array_sort(F.collect_list(F.struct("word", "mask"))), lambda x: x["mask"]).alias("t")
    ).scalar()

    def may_have(values: Sequence[Column]) -> Column:
        tests = []
        for place in places(F.xxhash64(*values)):
            word = F.get(table, F.shiftright(place, 6).cast("int"))
            tests.append(F.getbit(word, (place % 64).cast("int")) == 1)
        return reduce(lambda a, b: a & b, tests)

    return may_have


def lookup_value(keys: Sequence[Column], table: Mapping, default: object = None) -> Column:
    """The entry of a small dictionary for the key columns, as an expression."""
    out = F.lit(default)
    for entry, value in reversed(table.items()):
        parts = entry if isinstance(entry, tuple) else (entry,)
        test = reduce(lambda a, b: a & b, [k == part for k, part in zip(keys, parts)])
        out = F.when(test, F.lit(value)).otherwise(out)
    return out


def lookup_frame(df: DataFrame, keys: Sequence[str], table: Mapping, value: str) -> DataFrame:
    """A dictionary as a frame of known size."""
    rows = [(k if isinstance(k, tuple) else (k,)) for k in table]
    arrays = [pa.array([r[i] for r in rows]) for i in range(len(keys))]
    arrays.append(pa.array(list(table.values())))
    return df.sparkSession.createDataFrame(pa.Table.from_arrays(arrays, names=[*keys, value]))


def lookup(
    df: DataFrame,
    keys: Sequence[str],
    table: Mapping | DataFrame,
    value: str,
    default: object = None,
) -> DataFrame:
    """Add the table's ``value`` for the key columns, ``default`` where there is none.

    A small dictionary becomes an expression, a larger one a broadcast. A frame, whose keys
    must be unique, is broadcast if its size allows it, else joined with hot keys split. An
    existing column called ``value`` is replaced; the new one is the last.
    """
    others = [c for c in df.columns if c != value]
    df = df.select(*cols_of(others))
    if isinstance(table, Mapping) and len(table) <= CASE_LIMIT:
        return df.withColumn(value, lookup_value(cols_of(keys), table, default))
    if isinstance(table, Mapping):
        joined = df.join(F.broadcast(lookup_frame(df, keys, table, value)), list(keys), "left")
    else:
        joined = join_checked(df, table.select(*cols_of([*keys, value])), keys)
    return joined.select(*cols_of(others), F.coalesce(col_of(value), F.lit(default)).alias(value))


def join_key(value: Column) -> Column:
    """Key text without blanks and without the ``.0`` of a number read as a float."""
    return F.regexp_replace(strip(value.cast("string")), r"^(\d+)\.0$", "$1")


def join_master(
    df: DataFrame, master: DataFrame, key: str, suffix: str = "_bank", limit: int | None = None
) -> DataFrame:
    """All rows of ``df`` with the columns of ``master``; clashing names get ``suffix``.

    Keys compare as trimmed text, null matches nothing, several master rows repeat the row. A
    master above the broadcast ``limit`` loses the rows without a partner before it is shuffled;
    one pass over the keys of ``df``, which counts them, tells these and the hot keys.
    """
    left = df.withColumn(key, join_key(col_of(key)))
    right = master.withColumn(key, join_key(col_of(key)))
    clashes = {c: c + suffix for c in right.columns if c in left.columns and c != key}
    right = right.withColumnsRenamed(clashes).where(col_of(key).isNotNull())
    if fits_broadcast(right, limit):
        joined = left.join(F.broadcast(right), [key], "left")
    else:
        # spread_left_join expects the counts as ``n``
        counts = None if key.lower() == "n" else materialise(
            left.groupBy(col_of(key)).agg(F.count("*").alias("n"))
        )
        few = partners(right, left if counts is None else counts, key)
        joined = spread_left_join(left, few, [key], counts=counts)
    return joined.select(*cols_of([*left.columns, *[c for c in right.columns if c != key]]))


def partners(right: DataFrame, left: DataFrame, key: str) -> DataFrame:
    """``right`` without nearly all rows whose key is not in ``left``, told by a filter."""
    may_have = key_filter(left, [col_of(key)])
    return right if may_have is None else right.where(may_have([col_of(key)]))


#: The identity of a row of a table without a key: its file and its place there.
POSITION = "row_position"
#: Rows of a table joined by position that a task gets; their file names shrink so well that
#: the bytes of a shuffle do not tell how many rows fit.
ROWS_PER_TASK = 500_000


def positioned(table: DataFrame, name: str = POSITION) -> DataFrame:
    """A Parquet table as it is read, with the place of each row, which is unique and the same
    for each reading; copies of a row are told apart by it."""
    return table.withColumn(
        name, F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    )


def personalised(
    raw: DataFrame,
    derived: DataFrame | Callable[[DataFrame], DataFrame],
    key: str | Sequence[str] | None,
    names: Mapping[str, str],
) -> DataFrame:
    """``raw`` with the existing ones of some derived columns under new names.

    ``derived`` is best a function that works on the rows of ``raw`` and keeps them all: the
    raw values then travel along, and nothing is joined. A frame is joined by ``key``, which
    must be unique in both; rows with a null key are spread. Without a key, both have to be
    ``positioned``, and rows are joined by their place, which is then left out.
    """
    keys = [POSITION] if key is None else [key] if isinstance(key, str) else list(key)

    def picked(columns: Sequence[str]) -> dict[str, str]:
        return {old: new for old, new in names.items() if old in columns}

    if callable(derived):
        kept = {c: f"_raw_{i}" for i, c in enumerate(raw.columns)}
        out = derived(raw.withColumns({new: col_of(c) for c, new in kept.items()}))
        return out.select(
            *[F.col(new).alias(c) for c, new in kept.items()],
            *[col_of(old).alias(new) for old, new in picked(out.columns).items()],
        )
    chosen = derived.select(
        *cols_of(keys), *[col_of(old).alias(new) for old, new in picked(derived.columns).items()]
    )
    if key is None:  # no two rows have the same place
        others = [c for c in raw.columns if c != POSITION]
        new = picked(derived.columns).values()
        file_, row_ = (free_name(c, [*others, *new]) for c in ("_file", "_row"))
        parts = -(-raw.count() // ROWS_PER_TASK)
        least = int(raw.sparkSession.conf.get("spark.sql.shuffle.partitions"))

        def placed(df: DataFrame) -> DataFrame:
            place = {row_: F.col(POSITION)["row"], file_: F.col(POSITION)["file"]}
            flat = df.withColumns(place).drop(POSITION)
            return flat.repartition(max(parts, least), row_, file_) if parts > 1 else flat

        joined = placed(raw).join(placed(chosen), [row_, file_], "left")
        return joined.select(*cols_of([*others, *new]))
    joined = spread_left_join(raw, chosen, keys)
    return joined.select(*cols_of([*raw.columns, *picked(derived.columns).values()]))
