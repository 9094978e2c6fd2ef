"""Read tables and repair the header of exported sheets."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from perilscope.columns import col_of, cols_of
from perilscope.sources.records import parsed, read_records


#: Rows of the first file that are read to find a header.
PROBE = 1000


def read_table(
    spark: SparkSession,
    path: str,
    schema: StructType | str | None = None,
    multi_line: bool = False,
) -> DataFrame:
    """Parquet, or CSV with a header when the path says so; CSV values stay text.

    CSV without a schema is read as text columns, so that no extra pass infers types.
    ``multi_line`` reads line breaks within quotes, as form exports have them in their column
    names and values; files of any size are read in parts by ``read_records``.
    """
    if not path.rstrip("/").endswith((".csv", ".csv.gz")):
        reader = spark.read.schema(schema) if schema else spark.read
        return reader.parquet(path)
    if multi_line:
        return _read_record_table(spark, path, schema)
    reader = spark.read.option("header", True).option("escape", '"')
    return (reader.schema(schema) if schema else reader).csv(path)


def _read_record_table(spark: SparkSession, path: str, schema: StructType | str | None) -> DataFrame:
    """A CSV table by its records; the first one of each file is its header."""
    if schema is None:
        top = first_rows(spark, path, 1)
        schema = StructType(
            [StructField(n, StringType()) for n in (header_names(top[1][0]) if top else [])]
        )
    elif isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    if not schema.fields:
        return spark.createDataFrame([], schema)
    body = read_records(spark, path).where("block > 0 or n > 0")
    return parsed(body, schema).select(*cols_of(f.name for f in schema.fields))


def header_names(cells: Sequence[str | None]) -> list[str]:
    """Names for the columns under a header: one without a text is called by its place, and
    equal ones get their places."""
    lowered = [c.lower() for c in cells if c]
    return [
        f"_c{i}" if not c else (f"{c}{i}" if lowered.count(c.lower()) > 1 else c)
        for i, c in enumerate(cells)
    ]


def first_file(spark: SparkSession, path: str) -> str | None:
    """The first file by name that is not empty, from the listing alone."""
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    return files.where("length > 0").agg(F.min("path")).first()[0]


def first_rows(spark: SparkSession, path: str, count: int) -> tuple[str, list[list]] | None:
    """The first file and the cells of its first rows; no more of it is read, and no other."""
    file = first_file(spark, path)
    if file is None:
        return None
    reader = spark.read.option("header", False).option("multiLine", True).option("escape", '"')
    rows = reader.csv(file).limit(count).collect()
    return (file, [list(r) for r in rows]) if rows else None


def place_of(file: str, block: str, at: str) -> Column:
    """A text that sorts by file name, place of the part in the file, and place in the part."""
    return F.concat(
        F.col(file), F.lit("\n"), F.lpad(F.col(block).cast("string"), 19, "0"),
        F.lpad(F.col(at).cast("string"), 19, "0"),
    )


def cell_schema(width: int) -> StructType:
    return StructType([StructField(f"c{i}", StringType()) for i in range(width)])


def read_sheet(
    spark: SparkSession, path: str, width: int, line: str = "line", multi_line: bool = False
) -> DataFrame:
    """A CSV without a trusted header: text columns ``c0..`` and a growing line number, by
    ``place_of``. ``multi_line`` as in ``read_table``."""
    cells = _cells(spark, path, width, multi_line)
    return cells.select(
        *[f"c{i}" for i in range(width)], place_of("file", "block", "at").alias(line)
    )


def _cells(spark: SparkSession, path: str, width: int, multi_line: bool) -> DataFrame:
    """``c0..``, ``file``, ``block`` and ``at`` of all rows, and ``n``, which numbers those of
    the first part of a file that is read alone from 0."""
    if multi_line:
        return parsed(read_records(spark, path), cell_schema(width))
    at = F.monotonically_increasing_id()
    reader = spark.read.schema(cell_schema(width)).option("header", False).option("escape", '"')
    return reader.csv(path).select(
        *[f"c{i}" for i in range(width)], F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"), at.alias("at"),
        (at % F.lit(1 << 33)).alias("n"),
    )


def read_with_header(
    spark: SparkSession,
    path: str,
    width: int,
    markers: Sequence[str],
    look: int = 5,
    unnamed: str = "Unnamed",
    multi_line: bool = False,
    probe: int = PROBE,
) -> DataFrame:
    """A CSV sheet under its own header, without the rows above it; the rules of ``promote_header``.

    The header is searched among the first ``probe`` rows of the first file, which is all that
    is read for it; only if it is not there are all rows searched.
    """
    top = first_rows(spark, path, probe)
    if top is None:
        return read_sheet(spark, path, width, multi_line=multi_line).drop("line")
    file, rows = top
    rows = [[*r, *[None] * width][:width] for r in rows]
    place = 0
    if untitled(rows[0], look, unnamed):
        hits = (i for i, r in enumerate(rows) if i and any(m in c for c in r if c for m in markers))
        place = next(hits, None)
    if place is None:
        sheet = read_sheet(spark, path, width, multi_line=multi_line)
        return promote_header(sheet, "line", markers, look, unnamed).drop("line")
    names = [f"c{i}" for i in range(width)]
    same = F.regexp_replace("file", "^file:/+", "/") == F.regexp_replace(F.lit(file), "^file:/+", "/")
    below = (F.col("block") > 0) | (F.col("n") > place)
    if multi_line:  # records are numbered in each part, so that one reading does for all files
        return titled(_cells(spark, path, width, True).where(~same | below).select(*names), names, rows[place])
    # the rows up to the header are the first ones of its file, which is read by itself
    head = _cells(spark, file, width, multi_line).where(below)
    rest = _cells(spark, path, width, multi_line).where(~same)
    return titled(head.select(*names).union(rest.select(*names)), names, rows[place])


def untitled(cells: Sequence[str | None], look: int, unnamed: str) -> bool:
    """Whether one of the first cells has no text or one that begins with ``unnamed``."""
    return any(not title or title.startswith(unnamed) for title in cells[:look])


def titled(df: DataFrame, names: Sequence[str], titles: Sequence[str | None]) -> DataFrame:
    """The columns ``names`` under their ``titles``."""
    return df.select(
        *[col_of(n).alias(t if t else f"Unnamed: {i}") for i, (n, t) in enumerate(zip(names, titles))]
    )


def promote_header(
    df: DataFrame, line: str, markers: Sequence[str], look: int = 5, unnamed: str = "Unnamed"
) -> DataFrame:
    """Use the header of a sheet as column names and drop it and the rows above it.

    The first row is the header if its first ``look`` cells all have a text that does not
    begin with ``unnamed``. Otherwise the rows below it are searched for the first one in which
    a cell contains a marker; without such a row the first one is the header after all. An
    empty frame is returned as it is. The search is one aggregate that brings back two rows.
    """
    names = [c for c in df.columns if c != line]
    row = F.struct(*cols_of([line, *names]))
    top = df.agg(F.min_by(row, col_of(line)).alias("h")).first()["h"]
    if top is None:
        return df
    header = top
    if untitled(top[1:], look, unnamed):
        hit = reduce(
            lambda a, b: a | b,
            [F.coalesce(col_of(c).contains(m), F.lit(False)) for c in names for m in markers],
        )
        below = df.where((col_of(line) > top[0]) & hit)
        header = below.agg(F.min_by(row, col_of(line)).alias("h")).first()["h"] or top
    picked = []
    for place, name in enumerate(names):
        title = header[place + 1]
        picked.append(col_of(name).alias(title if title else f"Unnamed: {place}"))
    return df.where(col_of(line) > header[0]).select(col_of(line), *picked)
