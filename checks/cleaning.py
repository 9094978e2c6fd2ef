"""Schema repair, cleaning and unions."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.fixtures import INCIDENT, incident, table
from checks.registry import check
from perilscope.operators import cleaning, schema
from perilscope.session import materialise, run_folder
from perilscope.sources.outputs import read_output, write_outputs
from perilscope.sources.tables import promote_header, read_sheet, read_table, read_with_header

# the same dirty texts in both dialects
_DIRTY = """CASE l_linenumber WHEN 1 THEN concat('  ', l_returnflag, ' ') WHEN 2 THEN 'nan'
  WHEN 3 THEN ' <NA>' WHEN 4 THEN 'None' WHEN 5 THEN '   ' ELSE l_linestatus END"""
_NUMBER = """CASE l_linenumber WHEN 1 THEN CAST(CAST(l_quantity AS INT) AS STRING)
  WHEN 2 THEN concat(' ', CAST(CAST(l_quantity AS INT) AS STRING), '.5 ') WHEN 3 THEN '5d'
  WHEN 4 THEN 'nan' WHEN 5 THEN concat('-', CAST(CAST(l_quantity AS INT) AS STRING), 'e2')
  WHEN 6 THEN 'forty' END"""
_KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


def _line(spark, folder, **columns):
    return table(spark, folder, "lineitem").select(
        *_KEY.split(", "), *[F.expr(e).alias(n) for n, e in columns.items()]
    )


@check(
    f"""SELECT {_KEY}, CASE WHEN trim(t) NOT IN ('', 'nan', '<NA>', 'None') THEN trim(t) END AS flag,
  l_returnflag AS other
FROM (SELECT *, {_DIRTY} AS t FROM lineitem)"""
)
def clean_strings(spark, folder):
    return cleaning.blank_to_null(_line(spark, folder, flag=_DIRTY, other="l_returnflag"))


@check(
    rf"""SELECT {_KEY}, CASE WHEN regexp_matches(trim(t), '^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$')
  THEN try_cast(trim(t) AS DOUBLE) END AS amount, l_discount AS rate
FROM (SELECT *, {_NUMBER} AS t FROM lineitem)"""
)
def coerce_numeric(spark, folder):
    df = _line(spark, folder, amount=_NUMBER, rate="l_discount")
    return cleaning.coerce_numeric(df, ["amount", "rate", "absent"])


@check(f"SELECT {_KEY}, l_returnflag AS flag FROM lineitem")
def drop_empty_columns(spark, folder):
    df = _line(
        spark, folder,
        **{"Unnamed: 0": "l_tax", "flag": "l_returnflag", "never": "CAST(NULL AS STRING)",
           "also never": "CASE WHEN l_linenumber > 7 THEN 1 END"},
    )
    return schema.drop_empty_columns(schema.drop_unnamed(df))


@check(
    f"""WITH {INCIDENT}
SELECT row_key, coalesce(cause, 'Unknown') AS cause, coalesce(severity, 'Unknown') AS severity,
       'Unknown' AS visibility FROM incident"""
)
def fill_unknown(spark, folder):
    df = incident(spark, folder, "row_key", "cause", "severity")
    return cleaning.fill_unknown(df, ["cause", "severity", "visibility"])


@check(
    f"""WITH {INCIDENT}
SELECT area, coalesce(surface, 'Unknown') AS surface, coalesce(cause, 'Unknown') AS cause,
       severity FROM incident WHERE severity IS NOT NULL AND age IS NOT NULL"""
)
def training_set(spark, folder):
    df = incident(spark, folder, "row_key", "area", "surface", "cause", "severity")
    return cleaning.training_set(
        df, ["area", "surface", "cause", "absent"], "severity", ["area"], ["surface", "cause"]
    )


@check(f"SELECT {_KEY}, l_tax FROM lineitem")
def select_existing(spark, folder):
    df = table(spark, folder, "lineitem")
    return schema.select_existing(df, [*_KEY.split(", "), "not there", "l_tax"])


@check("SELECT c_custkey, c_mktsegment FROM customer")
def drop_personal(spark, folder):
    df = table(spark, folder, "customer").withColumnsRenamed(
        {"c_name": "full\n name", "c_acctbal": "account balance"}
    )
    return schema.drop_personal(
        df, ["full name", "accountbalance", "c_nationkey", "no such column"]
    )


@check(
    """SELECT c_custkey AS id, c_name AS "full name", c_mktsegment AS segment, 2568 AS year
FROM customer"""
)
def rename_resolve(spark, folder):
    df = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("  full\n  name "),
        F.col("c_mktsegment").alias("old segment"), F.col("c_acctbal").alias("spare"),
    )
    out, _ = schema.resolve_columns(
        df, ["id", "fullname"], ["segment"], {"old segment": "segment", "nothing": "x"}
    )
    out = schema.drop_optional(schema.tag(out, "year", 2568), "spare", "absent")
    return out.withColumnRenamed("fullname", "full name")


@check(
    f"""SELECT target, status, source, score, CASE WHEN source IS NOT NULL
  THEN (SELECT count(*) FROM customer) END AS filled
FROM (VALUES
  ('employee id', 'fuzzy', 'employee idd', {200 * 11}::DOUBLE / 23),
  ('home', 'fuzzy', 'name of home nation', 90.0::DOUBLE),
  ('market segment', 'fuzzy', 'market segmnt', {200 * 13}::DOUBLE / 27),
  ('Full  Name', 'normalized', 'Full Name', 100.0::DOUBLE),
  ('spare', 'NOT FOUND', NULL, 0.0::DOUBLE)) AS t(target, status, source, score)"""
)
def fuzzy_columns(spark, folder):
    """Resolved names of a table whose columns are spelled differently, and the report."""
    df = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("employee idd"), F.col("c_name").alias("Full Name"),
        F.col("c_mktsegment").alias("market segmnt"),
        F.col("c_nationkey").alias("name of home nation"),
    )
    out, report = schema.resolve_columns(
        df, ["employee id"], ["market segment", "Full  Name", "home", "spare"]
    )
    size = out.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in out.columns])
    filled = size.unpivot([], size.columns, "target", "filled")
    return report.join(filled, "target", "left")


@check("SELECT c_custkey, c_mktsegment AS value FROM customer")
def find_column(spark, folder):
    df = table(spark, folder, "customer")
    name = schema.find_column(df, ["no such", "segment"], "c_name")
    assert schema.find_column(df, "nowhere", "c_name") == "c_name"
    return df.select("c_custkey", F.col(name).alias("value"))


@check(
    """SELECT (c_custkey + 3)::BIGINT AS line, CAST(c_custkey AS VARCHAR) AS "customer key",
  c_name AS name, c_mktsegment AS "Unnamed: 2" FROM customer"""
)
def promote_header_row(spark, folder):
    customer = table(spark, folder, "customer")
    body = customer.select(
        (F.col("c_custkey") + 3).alias("line"), F.col("c_custkey").cast("string").alias("c0"),
        F.col("c_name").alias("c1"), F.col("c_mktsegment").alias("c2"),
    )
    # a title, a blank and the real header stand above the body
    rows = F.array(
        *[
            F.struct(F.lit(n).cast("bigint").alias("line"), *[F.lit(v).cast("string").alias(f"c{i}")
              for i, v in enumerate(cells)])
            for n, cells in [
                (0, ("list of 2025", None, None)), (1, (None, None, None)),
                (2, ("customer key", "name", None)),
            ]
        ]
    )
    top = customer.agg(F.count("*")).select(F.explode(rows).alias("r")).select("r.*")
    return promote_header(body.unionByName(top), "line", ["key"])


@check(
    f"""WITH {INCIDENT}
SELECT row_key, severity, speed, CASE WHEN year = 1999 THEN NULL ELSE price END AS price,
       year + 543 AS year
FROM incident WHERE year IN (1999, 2000)"""
)
def union_years(spark, folder):
    df = incident(spark, folder, "row_key", "severity", "speed", "price", "year")
    first = df.where("year = 1999").select("row_key", "severity", "speed")
    second = df.where("year = 2000").select("price", F.col("speed").alias("velocity"), "row_key",
                                            "severity")
    return cleaning.union_years(
        {2542: first, 2543: schema.rename(second, {"velocity": "speed", "gone": "x"})}
    )


@check(f"WITH {INCIDENT} SELECT DISTINCT area, month FROM incident")
def distinct_causes(spark, folder):
    return cleaning.distinct_values(incident(spark, folder, "area", "month"), ["area", "month"])


@check(f"WITH {INCIDENT} SELECT row_key, cause, severity FROM incident WHERE cause IS NOT NULL")
def drop_missing(spark, folder):
    return cleaning.drop_missing(incident(spark, folder, "row_key", "cause", "severity"), ["cause"])


@check(
    f"""WITH {INCIDENT}
SELECT area, severity, count(*) AS n FROM incident WHERE severity IS NOT NULL GROUP BY ALL"""
)
def write_read_back(spark, folder):
    """Counts written under a run id and read back; the empty frame is not written."""
    df = incident(spark, folder, "area", "severity")
    counts = df.where("severity IS NOT NULL").groupBy("area", "severity").agg(
        F.count("*").alias("n")
    )
    base = run_folder(spark, "round_trip")
    paths = write_outputs(
        {"counts": counts, "unmapped": df.where("severity = 'never'"), "joined": None},
        base, "r1",
    )
    assert list(paths) == ["counts"]
    return read_output(spark, base, "counts", "r1").select("area", "severity", "n")


@check("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_mktsegment FROM customer")
def read_csv_table(spark, folder):
    """A table written as CSV with a header and read again as text."""
    df = table(spark, folder, "customer").select("c_custkey", "c_mktsegment")
    path = write_outputs({"customer": df}, run_folder(spark, "csv"), "r1.csv", "csv")["customer"]
    return read_table(spark, path)


@check(
    """SELECT CAST(c_custkey AS VARCHAR) AS "key", c_mktsegment AS segment FROM customer"""
)
def read_sheet_with_header_row(spark, folder):
    """A CSV in files of unequal size, whose header is not its first line, read as cells."""
    customer = table(spark, folder, "customer")
    cells = F.array(
        F.struct(F.lit("report").alias("a"), F.lit("").alias("b")),
        F.struct(F.lit("key").alias("a"), F.lit("segment").alias("b")),
    )
    top = customer.agg(F.count("*")).select(F.explode(cells).alias("r")).select("r.*")
    base = run_folder(spark, "sheet")
    top.write.csv(f"{base}/1")
    rows = customer.select(F.col("c_custkey").cast("string"), "c_mktsegment")
    rows.repartition(3).write.csv(f"{base}/2")
    df = read_sheet(spark, f"{base}/*", 2)
    return promote_header(df, "line", ["key"]).drop("line")


@check(
    """SELECT CAST(c_custkey AS VARCHAR) AS area, c_name AS "speed (digits)",
  c_mktsegment || chr(10) || '"x"' AS cause FROM customer"""
)
def read_form_export(spark, folder):
    """A form export: line breaks in a column name and in values."""
    df = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("area"), F.col("c_name").alias("speed \n(digits)"),
        F.concat("c_mktsegment", F.lit('\n"x"')).alias("cause"),
    )
    base = run_folder(spark, "form") + ".csv"
    df.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(base)
    return schema.squash_names(read_table(spark, base, multi_line=True))


@check(
    """SELECT CAST(c_custkey AS VARCHAR) AS "key", c_name AS "Unnamed: 1", c_mktsegment AS segment
FROM customer"""
)
def promote_first_row(spark, folder):
    """Without a row that has a marker, the first row is the header."""
    customer = table(spark, folder, "customer")
    body = customer.select(
        F.col("c_custkey").alias("line"), F.col("c_custkey").cast("string").alias("c0"),
        F.col("c_name").alias("c1"), F.col("c_mktsegment").alias("c2"),
    )
    top = customer.agg(
        F.lit(-1).cast("bigint").alias("line"), F.first(F.lit("key")).alias("c0"),
        F.first(F.lit(None).cast("string")).alias("c1"), F.first(F.lit("segment")).alias("c2"),
    )
    return promote_header(body.unionByName(top), "line", ["no such mark"]).drop("line")


def _quoted_export(spark, folder, rows):
    """Customers as one CSV file with line breaks and quotes in values, below other rows."""
    customer = table(spark, folder, "customer").select(
        F.col("c_custkey").cast("string").alias("c0"), F.col("c_name").alias("c1"),
        F.concat(
            "c_mktsegment", F.when(F.col("c_custkey") % 3 == 0, F.lit('\n"a, b"\n')).otherwise(F.lit(""))
        ).alias("c2"),
    )
    body = customer.repartitionByRange(1, "c0")
    base = run_folder(spark, "quoted")
    as_is = {"escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    top = spark.createDataFrame(rows, "c0 string, c1 string, c2 string").coalesce(1)
    top.write.options(**as_is).csv(f"{base}/1")
    for part in ("2", "3"):
        some = body.where((F.crc32(F.col("c0").cast("binary")) % 2 == 0) == (part == "2"))
        some.write.options(**as_is, quoteAll=part == "3").csv(f"{base}/{part}")
    return f"{base}/*"


_QUOTED_SQL = """SELECT CAST(c_custkey AS VARCHAR) AS "key", c_name AS "name",
  c_mktsegment || CASE WHEN c_custkey % 3 = 0 THEN chr(10) || '"a, b"' || chr(10) ELSE '' END
    AS segment FROM customer"""


def _in_parts(spark, read):
    """A frame whose files are cut into parts of 4 kB, computed at once."""
    before = {k: spark.conf.get(k) for k in _SMALL_PARTS}
    try:
        for key, value in _SMALL_PARTS.items():
            spark.conf.set(key, value)
        return materialise(read())
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


_SMALL_PARTS = {"spark.sql.files.maxPartitionBytes": "4k", "spark.sql.files.openCostInBytes": "64"}


@check(_QUOTED_SQL)
def read_quoted_in_parts(spark, folder):
    """Quoted line breaks in large files, each read by several tasks."""
    rows = [("report", None, None), ("key", "name", "segment")]
    path = _quoted_export(spark, folder, rows)
    return _in_parts(spark, lambda: read_with_header(spark, path, 3, ["key"], multi_line=True))


@check(_QUOTED_SQL)
def read_sheet_by_probe(spark, folder):
    """The header is found among the first rows of the first of many files."""
    rows = [("a report\nof customers", None, None), (None, "x", None), ("key", "name", "segment")]
    path = _quoted_export(spark, folder, rows)
    return read_with_header(spark, path, 3, ["segment"], multi_line=True)
