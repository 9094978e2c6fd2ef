"""CSV records whose quoted values hold line breaks, read in parts.

A reader that knows quotes has to read a file from its beginning, in one task. Here files are
split as any text. Whether a part begins within quotes follows from the number of quotes in the
parts before it, of which only the parity counts: one pass counts them, a running sum over the
parts tells each its beginning, and a second pass puts lines together to records within each
part. Records that reach over the end of a part are put together from their pieces alone.

Quotes within values must be doubled, and values that hold quotes be quoted, as RFC 4180 has it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from perilscope.operators.joins import fits_broadcast
from perilscope.session import materialise

RECORD = "file string, block bigint, at bigint, n bigint, kind int, record string"
WHOLE, BEGUN, CONTINUED = 0, 1, 2


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``block`` (where its part begins), ``at`` (growing in a part) and ``text``."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), F.col("value").alias("text"),
    )


def open_parts(lines: DataFrame) -> DataFrame:
    """``file``, ``block``, ``within`` and ``open`` of the parts that begin within quotes
    (``within``) or end so (``open``)."""
    quotes = F.length("text") - F.length(F.replace("text", F.lit('"'), F.lit("")))
    counted = lines.groupBy("file", "block").agg(F.sum(quotes).alias("quotes"))
    so_far = Window.partitionBy("file").orderBy("block")
    total = F.sum("quotes").over(so_far)
    return counted.select(
        "file", "block", ((total - F.col("quotes")) % 2 == 1).alias("within"),
        (total % 2 == 1).alias("open"),
    ).where("within or open")


def joined_lines(batches: Iterable[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
    """Lines (``file``, ``block``, ``at``, ``within``, ``text``) put together to records.

    With ``whole``, the records that begin and end in their part; otherwise the pieces of those
    that do not, of the kind ``BEGUN`` or ``CONTINUED``. ``n`` is the record's number in the part
    in which it begins.
    """
    held: tuple | None = None  # file, block, at, n, kind, texts of the record that is still open
    key, n, odd = None, 0, 0

    def piece() -> Iterator[pa.RecordBatch]:
        if held is not None and not whole:
            yield batch_of([held[0]], [held[1]], [held[2]], [held[3]], [held[4]], ["\n".join(held[5])])

    for batch in batches:
        files = batch.column(0).dictionary_encode()
        code, block = files.indices.to_numpy(), batch.column(1).to_numpy()
        new = np.flatnonzero((code[1:] != code[:-1]) | (block[1:] != block[:-1])) + 1
        cuts = [0, *new.tolist(), len(batch)] if len(batch) else []
        for lo, hi in zip(cuts, cuts[1:]):
            own = (batch.column(0)[lo].as_py(), int(block[lo]))
            at, text = batch.column(2).slice(lo, hi - lo).to_numpy(), batch.column(4).slice(lo, hi - lo)
            if own != key:
                yield from piece()
                key, n, odd = own, 0, int(batch.column(3)[lo].as_py())
                held = (*own, int(at[0]), -1, CONTINUED, []) if odd else None
            quotes = pc.count_substring(text, '"').to_numpy(zero_copy_only=False)
            after = (odd + np.cumsum(quotes)) % 2
            before = np.concatenate([[odd], after[:-1]])
            odd = int(after[-1])
            starts = np.flatnonzero(before == 0)
            first = int(starts[0]) if len(starts) else hi - lo
            if held is not None:
                held[5].extend(text.slice(0, first).to_pylist())
                if len(starts):  # the open record has ended
                    if held[4] == CONTINUED:
                        yield from piece()
                    elif whole:
                        yield batch_of(
                            [own[0]], [own[1]], [held[2]], [held[3]], [WHOLE], ["\n".join(held[5])]
                        )
                    held = None
            if not len(starts):
                continue
            ends = np.concatenate([starts[1:], [hi - lo]])
            done = len(starts) - odd  # the last one goes on
            if done and not whole:
                blank = pc.is_in(text, pa.array(["", "\r"])).to_numpy(zero_copy_only=False)
                n += done - int(blank[starts[:done]].sum())
            if whole and done:
                offsets = np.concatenate([starts[:done], ends[done - 1 : done]])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), text)
                records = pc.binary_join(lists, "\n")
                blank = pc.is_in(records, pa.array(["", "\r"])).to_numpy(zero_copy_only=False)
                count = np.cumsum(~blank)
                yield batch_of(
                    [own[0]] * done, [own[1]] * done, at[starts[:done]], n + count - 1,
                    [WHOLE] * done, records,
                )
                n += int(count[-1])
            if odd:
                last = int(starts[-1])
                held = (*own, int(at[last]), n, BEGUN, text.slice(last).to_pylist())
                n += 1
    yield from piece()


def batch_of(file, block, at, n, kind, record) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(file, pa.string()), pa.array(block, pa.int64()), pa.array(at, pa.int64()),
         pa.array(n, pa.int64()), pa.array(kind, pa.int32()),
         record if isinstance(record, pa.Array) else pa.array(record, pa.string())],
        ["file", "block", "at", "n", "kind", "record"],
    )


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All CSV records of the files at ``path`` as texts: ``file``, ``block``, ``at``, ``n``,
    ``record``. They sort by the first three; ``n`` is the record's number among those that begin
    in its part, from 0. Line breaks within values stay as they are.

    A part is a task's share of a file, as for any text file, so that a file of any size is read
    by many tasks. Empty lines are no records. An open quote at the end of a file ends there.
    """
    lines = text_lines(spark, path)
    parts = materialise(open_parts(lines))

    def run(whole: bool):
        return lambda batches: joined_lines(batches, whole)

    told = F.broadcast(parts) if fits_broadcast(parts) else parts
    columns = ["file", "block", "at", F.coalesce("within", F.lit(False)).alias("within"), "text"]
    given = lines.join(told, ["file", "block"], "left").select(*columns)
    records = _bare(given.mapInArrow(run(True), RECORD).drop("kind"))
    if not parts.isEmpty():
        some = lines.join(told, ["file", "block"]).select(*columns)
        pieces = some.mapInArrow(run(False), RECORD)
        order = Window.partitionBy("file").orderBy("block", "at")
        begun = F.last(F.when(F.col("kind") == BEGUN, F.struct("block", "at", "n")), ignorenulls=True)
        grouped = pieces.withColumn("begin", begun.over(order)).groupBy("file", "begin").agg(
            F.array_sort(F.collect_list(F.struct("block", "at", "record"))).alias("p")
        )
        merged = grouped.select(
            "file", F.col("begin.block").alias("block"), F.col("begin.at").alias("at"),
            F.coalesce("begin.n", F.lit(0)).alias("n"),
            F.array_join(F.transform("p", lambda x: x["record"]), "\n").alias("record"),
        )
        records = records.union(_bare(merged))
    return records


def _bare(records: DataFrame) -> DataFrame:
    """Without what is left of a line break of two characters, and without empty lines."""
    return records.withColumn("record", F.regexp_replace("record", "\r$", "")).where("record <> ''")


def parsed(records: DataFrame, schema: StructType) -> DataFrame:
    """The records with their cells as columns, as Spark's reader makes them from one line."""
    cells = F.from_csv("record", schema.toDDL(), {"escape": '"', "multiLine": "true"})
    names = [f.name for f in schema.fields]
    return records.select("*", cells.alias("cells")).select(
        "file", "block", "at", "n", *[F.col("cells")[name].alias(name) for name in names]
    )
