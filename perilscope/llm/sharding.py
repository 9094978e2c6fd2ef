"""Placement on shards by a lookup table that the shards fill in turns.

Every shard has an order of preference over the slots of a table whose size is a prime: a
start and a step drawn from its name, so that the order visits each slot once. In turns, each
shard claims the first slot of its order that is still free, until none is left. A key is
hashed to a slot and belongs to the shard there. All shards hold the same number of slots, to
within one, and adding or removing a shard moves little more than its share of the slots.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from perilscope.llm.frames import col_of, cols_of, fresh

#: A prime over a thousand times the usual number of shards.
TABLE_SIZE = 65_537


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def preference(name: str, size: int) -> tuple[int, int]:
    """Start and step of a shard's order: slots ``start + k * step`` modulo ``size``."""
    digest = hashlib.sha256(name.encode()).digest()
    start = int.from_bytes(digest[:8], "big") % size
    return start, int.from_bytes(digest[8:16], "big") % (size - 1) + 1


def fill_table(names: Sequence[str], size: int = TABLE_SIZE) -> list[int]:
    """The shard (its place in ``names``) of each slot.

    The result depends on the set of names and their order, which decides the turns. Raises
    ValueError without shards, with equal names, or if ``size`` is no prime or too small.
    """
    if not names or len(set(names)) != len(names):
        raise ValueError("shards need names, each its own")
    if not is_prime(size) or size < len(names):
        raise ValueError(f"the table size must be a prime of at least {len(names)}")
    orders = [preference(name, size) for name in names]
    at = [start for start, _ in orders]
    table, free = [-1] * size, size
    while True:
        for shard, (_, step) in enumerate(orders):
            slot = at[shard]
            while table[slot] >= 0:
                slot = (slot + step) % size
            table[slot] = shard
            at[shard] = (slot + step) % size
            free -= 1
            if not free:
                return table


def table_frame(spark: SparkSession, names: Sequence[str], size: int = TABLE_SIZE) -> DataFrame:
    """The filled table with columns ``slot``, ``shard`` and ``shard_name``."""
    table = fill_table(names, size)
    return spark.createDataFrame(
        pa.table(
            {
                "slot": pa.array(range(size), pa.int32()),
                "shard": pa.array(table, pa.int32()),
                "shard_name": pa.array([names[s] for s in table]),
            }
        )
    )


def slot_of(keys: Sequence[str], size: int, row: Sequence[str]) -> Column:
    """Slot of the key columns, from 60 bits of the MD5 of their text form.

    A key that is null as a whole stands for no key: such a row takes the slot of all its
    columns ``row``, or many rows without a key would meet on one shard.
    """

    def hashed(columns: Sequence[str], mark: str) -> Column:
        # the length in front keeps ("a", "bc") and ("ab", "c") apart
        parts = [
            F.coalesce(F.concat(F.length(c), F.lit(":"), c), F.lit("-"))
            for c in (col_of(name).cast("string") for name in columns)
        ]
        if len(columns) == 1:
            parts = [col_of(columns[0]).cast("string")]
        return F.md5(F.concat(F.lit(mark), *parts).cast("binary"))

    digest = F.coalesce(
        F.when(F.coalesce(*[col_of(k).cast("string") for k in keys]).isNotNull(), hashed(keys, "")),
        hashed(row, "row:") if len(row) > 1 else F.lit(None).cast("string"),
        F.md5(F.lit("null").cast("binary")),
    )
    return (F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint") % size).cast("int")


def place(
    df: DataFrame, keys: Sequence[str], names: Sequence[str], size: int = TABLE_SIZE
) -> DataFrame:
    """``df`` with ``slot``, ``shard`` and ``shard_name``, without a shuffle.

    The table has ``size`` rows whatever the data, so it is broadcast. Equal keys share a
    shard; rows whose key columns are all null are spread by their other columns, copies of
    such a row together. An empty frame stays empty; existing columns of the three names are
    replaced.
    """
    added = ("slot", "shard", "shard_name")
    taken = [c for c in df.columns if c.lower() not in added]
    slot = fresh("slot_key", taken)
    row = [f.name for f in df.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    with_slot = df.withColumn(slot, slot_of(keys, size, row)).select(*cols_of([*taken, slot]))
    table = table_frame(df.sparkSession, names, size).withColumnRenamed("slot", slot)
    joined = with_slot.join(F.broadcast(table), slot, "inner")
    return joined.select(
        *cols_of(taken), col_of(slot).alias("slot"), col_of("shard"), col_of("shard_name")
    )


def write_shards(placed: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """One folder for each shard under ``path``; a shard of any size is written by many tasks."""
    spread = F.pmod(F.xxhash64(*cols_of(placed.columns)), F.lit(8))
    (
        placed.repartition(col_of("shard"), spread)
        .write.mode("errorifexists")
        .option("maxRecordsPerFile", rows_per_file)
        .partitionBy("shard")
        .parquet(path)
    )
