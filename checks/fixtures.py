"""The given tables in the part of incident records, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.registry import values
from perilscope.operators.rules import classify, classify_counts

THEMES = {"Handling": "handling", "Attention": "attention", "Road": "road", "Speed": "speed"}
SEVERE = ["long"]
SEVERITIES = ["long", "short", "none"]
# the last two are spelled one letter off, for the fuzzy stage
RULES = [
    ("red rod (Brand#3)/promo", "Road"),
    ("anvil", "Handling"),
    ("red ring", "Speed"),
    ("ring", "Road"),
    ("bolt", "Road"),
    ("gear", "Speed"),
    ("new gizmo", "Handling"),
    ("gizmo", "Attention"),
    ("old plate", "Speed"),
    ("plate", "Handling"),
    ("hot rod", "Attention"),
    ("promotion stand", "Attention"),
    ("old widget (Brand#11)/standardd", "Speed"),
    ("cold widget (Brand#8)/econmy", "Road"),
]
SYNONYMS = {
    "hot widget (Brand#5)/economy": "red rod (Brand#3)/promo",
    "old rod (Brand#7)/large": "gear",
}
AREA_PRODUCTS = {
    ("Road", "High"): "full", ("Road", "Medium"): "standard", ("Road", "Low"): "basic",
    ("Speed", "High"): "full plus", ("Speed", "Medium"): "standard plus",
    ("Handling", "High"): "standard group", ("Attention", "Medium"): "basic group",
}
ROW_PRODUCTS = {
    ("Road", "long"): "full", ("Road", "short"): "standard", ("Speed", "long"): "full plus",
    ("Speed", "short"): "standard plus", ("Attention", "long"): "standard group",
    ("Handling", "none"): "basic",
}


# stated, so that no job reads file footers to find them
SCHEMAS = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
    "c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
    "p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
    "value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def incident(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Incident rows with the wanted columns; only the tables behind them are joined.

    Only ``nation`` (25 rows at any scale) is broadcast by name; Spark decides on the rest.
    """
    df = table(spark, folder, "lineitem")
    if "area" in columns:
        supplier = table(spark, folder, "supplier").select("s_suppkey", "s_nationkey")
        nation = table(spark, folder, "nation").select("n_nationkey", "n_name")
        homes = supplier.join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))
        df = df.join(homes.select("s_suppkey", "n_name"), F.col("l_suppkey") == F.col("s_suppkey"))
    if {"cause", "age"} & set(columns):
        # the text is built per part, not per incident
        part = table(spark, folder, "part").select(
            "p_partkey", "p_size",
            F.concat(
                F.col("p_name"), F.lit(" ("), F.col("p_brand"), F.lit(")/"), F.lower("p_type")
            ).alias("p_text"),
        )
        df = df.join(part, F.col("l_partkey") == F.col("p_partkey"))
    if {"employee", "priority", "segment"} & set(columns):
        orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
        df = df.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    if "segment" in columns:
        customer = table(spark, folder, "customer").select("c_custkey", "c_mktsegment")
        df = df.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    flag = F.col("l_returnflag")
    shown = {
        "row_key": F.concat_ws(
            "-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
            F.round(F.col("l_extendedprice") * 100).cast("bigint"),
        ),
        "area": F.col("n_name"),
        "cause": F.when(F.col("l_linenumber") != 7, F.col("p_text")),
        "severity": F.when(
            ~((F.col("l_linenumber") == 6) & (F.col("l_quantity") > 45)),
            F.when(flag == "R", "long").when(flag == "A", "short").otherwise("none"),
        ),
        "age": F.col("p_size"),
        "speed": F.col("l_quantity"),
        "date": F.col("l_shipdate"),
        "year": F.year("l_shipdate"),
        "quarter": F.quarter("l_shipdate"),
        "month": F.date_format("l_shipdate", "MMM"),
        "surface": F.col("l_linestatus"),
        "employee": F.col("o_custkey"),
        "priority": F.col("o_orderpriority"),
        "segment": F.col("c_mktsegment"),
        "line": F.col("l_linenumber"),
        "price": F.col("l_extendedprice"),
    }
    return df.select(*[shown[c].alias(c) for c in columns])


INCIDENT = """incident AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,
                   round(l_extendedprice * 100)::BIGINT) AS row_key,
         n_name AS area,
         CASE WHEN l_linenumber <> 7
              THEN concat(p_name, ' (', p_brand, ')/', lower(p_type)) END AS cause,
         CASE WHEN NOT (l_linenumber = 6 AND l_quantity > 45)
              THEN CASE l_returnflag WHEN 'R' THEN 'long' WHEN 'A' THEN 'short' ELSE 'none' END
              END AS severity,
         p_size AS age, l_quantity AS speed, l_shipdate AS date,
         year(l_shipdate)::INT AS year, quarter(l_shipdate)::INT AS quarter,
         strftime(l_shipdate, '%b') AS month, l_linestatus AS surface,
         o_custkey AS employee, o_orderpriority AS priority, c_mktsegment AS segment,
         l_linenumber AS line, l_extendedprice AS price
  FROM lineitem
  JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey
  JOIN part ON l_partkey = p_partkey
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
)"""

RULES_SQL = values("rules", "pattern, label, ord", [(p, x, i) for i, (p, x) in enumerate(RULES)])
SYNONYMS_SQL = values("synonyms", "source, target", list(SYNONYMS.items()))

TOKENS_SQL = r"""
  list_filter(list_transform(string_split(regexp_replace({0}, '\(.*?\)', '', 'g'), '/'),
                             lambda x: trim(x)), lambda x: x <> '')"""

# length of the longest common subsequence of each (a, b) of a table ``cand``, by the textbook
# table, one row of it per character of ``a``
LCS = """walk AS (
  SELECT a, b, 0 AS i, list_transform(range(length(b) + 1), lambda x: 0) AS row
  FROM (SELECT DISTINCT a, b FROM cand)
  UNION ALL
  SELECT a, b, i + 1,
    list_reduce(range(1, length(b) + 1), lambda acc, j: list_append(acc,
      CASE WHEN substr(a, i + 1, 1) = substr(b, j::INT, 1) THEN row[j] + 1
           ELSE greatest(acc[j], row[j + 1]) END), [0])
  FROM walk WHERE i < length(a)
),
scored AS (
  SELECT a, b, 200.0::DOUBLE * row[length(b) + 1] / (length(a) + length(b)) AS score
  FROM walk WHERE i = length(a)
)"""


def near(a: str, b: str, min_score: float) -> str:
    allowed = f"floor((length({a}) + length({b})) * {(100 - min_score) / 100}::DOUBLE + 1e-9)"
    return f"levenshtein({a}, {b}) <= {allowed}"


def texts_sql(rules_sql: str = RULES_SQL) -> str:
    """The distinct texts and their tokens, with the rules and synonyms they are matched with."""
    return f"""{INCIDENT},
{rules_sql},
{SYNONYMS_SQL},
texts AS (
  SELECT cause, coalesce(target, trim(cause)) AS text
  FROM (SELECT DISTINCT cause FROM incident WHERE cause IS NOT NULL)
  LEFT JOIN synonyms ON trim(cause) = source
),
split AS (SELECT cause, text, {TOKENS_SQL.format('text')} AS toks FROM texts),
tokened AS (
  SELECT cause, unnest(toks) AS token, generate_subscripts(toks, 1) AS pos FROM split
),
token_hit AS (
  SELECT cause, arg_min(label, pos * 1000 + ord) AS label
  FROM tokened JOIN rules ON contains(pattern, token) OR contains(token, pattern)
  GROUP BY cause
),
exact_hit AS (SELECT cause, label FROM texts JOIN rules ON text = pattern)"""


THEMED = """themed AS (
  SELECT i.*, c.theme FROM incident i LEFT JOIN cascade c ON i.cause = c.cause
)"""

# the cascade without its fuzzy stages, on distinct texts
TWO_STAGES = f"""{texts_sql()},
cascade AS (
  SELECT t.cause, coalesce(e.label, k.label) AS theme
  FROM texts t LEFT JOIN exact_hit e ON t.cause = e.cause LEFT JOIN token_hit k ON t.cause = k.cause
),
{THEMED}"""


def cascade_sql(rules_sql: str = RULES_SQL) -> str:
    """The whole cascade, for ``WITH RECURSIVE``."""
    return f"""{texts_sql(rules_sql)},
near AS (
  SELECT text AS a, pattern AS b FROM texts JOIN rules ON {near("text", "pattern", 97)}
  UNION SELECT token, pattern FROM tokened JOIN rules ON {near("token", "pattern", 97)}
),
cand AS (SELECT DISTINCT a, b FROM near),
{LCS},
whole AS (
  SELECT cause, label, row_number() OVER (PARTITION BY cause ORDER BY score DESC, ord) AS place
  FROM texts JOIN scored ON text = a JOIN rules ON b = pattern WHERE score >= 97
),
part_hit AS (
  SELECT cause, label, row_number() OVER (PARTITION BY cause ORDER BY score DESC, pos, ord) AS place
  FROM tokened JOIN scored ON token = a JOIN rules ON b = pattern WHERE score >= 97
),
cascade AS (
  SELECT t.cause, coalesce(e.label, k.label, w.label, p.label) AS theme
  FROM texts t LEFT JOIN exact_hit e ON t.cause = e.cause LEFT JOIN token_hit k ON t.cause = k.cause
  LEFT JOIN (FROM whole WHERE place = 1) w ON t.cause = w.cause
  LEFT JOIN (FROM part_hit WHERE place = 1) p ON t.cause = p.cause
),
{THEMED}"""


CASCADE = cascade_sql()


def themed(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Incident rows with their theme by the whole cascade."""
    df = incident(spark, folder, *dict.fromkeys([*columns, "cause"]))
    df, _ = classify(df, "cause", RULES, SYNONYMS)
    return df.select(*columns, "theme")


def themed_counts(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Counts ``n`` of the incident rows by some columns and theme."""
    df = incident(spark, folder, *dict.fromkeys([*columns, "cause"]))
    return classify_counts(df, columns, "cause", RULES, SYNONYMS)[0]
