"""Scalar functions over texts built from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.fixtures import INCIDENT, SYNONYMS, SYNONYMS_SQL, TOKENS_SQL, incident, table
from checks.registry import check, r
from perilscope.functions import dates, numbers, similarity, text
from perilscope.operators.report import rank_rows

UNITS = {"year": "yr", "month": "mo", "day": "dd", "week": "wk"}

# the same duration texts in both dialects
_DURATION = """CASE p_partkey % 6
  WHEN 0 THEN concat(p_size, 'yr', p_partkey % 12, 'mo')
  WHEN 1 THEN concat(p_size, 'mo ', p_partkey % 30, 'dd')
  WHEN 2 THEN concat(p_size % 9, 'wk', p_partkey % 28, 'dd')
  WHEN 3 THEN concat(p_size, ' yr')
  WHEN 4 THEN 'unknown' END"""


def _amount(unit: str) -> str:
    return f"coalesce(try_cast(regexp_extract(t, '(\\d+){unit}', 1) AS DOUBLE), 0)"


@check(
    f"""WITH d AS (SELECT p_partkey, {_DURATION} AS t FROM part)
SELECT p_partkey, t AS duration, CASE WHEN t IS NOT NULL THEN
  {_amount('yr')} * 12 + {_amount('mo')} + {_amount('dd')} / 30 + {_amount('wk')} / 4 END AS months
FROM d"""
)
def duration_months(spark, folder):
    df = table(spark, folder, "part").select("p_partkey", F.expr(_DURATION).alias("duration"))
    return df.withColumn("months", text.duration_months("duration", UNITS))


_CLOCK_SPARK = """CASE event_id % 5
  WHEN 0 THEN date_format(ts, 'HH:mm') WHEN 1 THEN concat('at ', date_format(ts, 'H.mm'), ' h')
  WHEN 2 THEN 'some time' WHEN 3 THEN concat(event_id, ':', event_id % 60) END"""
_CLOCK_SQL = """CASE event_id % 5
  WHEN 0 THEN strftime(ts, '%H:%M')
  WHEN 1 THEN concat('at ', hour(ts), '.', strftime(ts, '%M'), ' h')
  WHEN 2 THEN 'some time' WHEN 3 THEN concat(event_id, ':', event_id % 60) END"""


@check(
    rf"""WITH c AS (SELECT event_id, {_CLOCK_SQL} AS clock FROM events),
h AS (SELECT *, try_cast(regexp_extract(clock, '(\d{{1,2}})[:.](\d{{1,2}})', 1) AS INT) AS hour FROM c)
SELECT event_id, clock, hour, CASE WHEN hour < 6 THEN 'Late Night' WHEN hour < 12 THEN 'Morning'
  WHEN hour < 18 THEN 'Afternoon' WHEN hour IS NOT NULL THEN 'Night' END AS period FROM h"""
)
def clock_hour_period(spark, folder):
    df = table(spark, folder, "events").select("event_id", F.expr(_CLOCK_SPARK).alias("clock"))
    return df.withColumn("hour", text.clock_hour("clock")).withColumn(
        "period", text.day_period("hour")
    )


@check(
    """SELECT p_partkey, p_size,
  CASE WHEN p_size > 0 AND p_size <= 20 THEN '<20' WHEN p_size > 20 AND p_size <= 25 THEN '20-25'
       WHEN p_size > 25 AND p_size <= 30 THEN '26-30' WHEN p_size > 30 AND p_size <= 100 THEN '>30'
       END AS age_group,
  CASE WHEN p_size - 20 >= 0 AND p_size - 20 <= 10 THEN 'low'
       WHEN p_size - 20 > 10 AND p_size - 20 <= 25 THEN 'high' END AS shifted
FROM part"""
)
def bin_right_closed(spark, folder):
    return table(spark, folder, "part").select(
        "p_partkey",
        "p_size",
        numbers.bin_right_closed("p_size", (0, 20, 25, 30, 100), ("<20", "20-25", "26-30", ">30"))
        .alias("age_group"),
        numbers.bin_right_closed(F.col("p_size") - 20, (0, 10, 25), ("low", "high"), True).alias(
            "shifted"
        ),
    )


_DATE_SPARK = """CASE o_orderkey % 6
  WHEN 0 THEN concat(year(o_orderdate) + 543, date_format(o_orderdate, '-MM-dd'), ' 00:00:00')
  WHEN 1 THEN concat(date_format(o_orderdate, 'dd/MM/'), year(o_orderdate) + 543)
  WHEN 2 THEN date_format(o_orderdate, 'yyyy-MM-dd')
  WHEN 3 THEN concat(day(o_orderdate), '-', month(o_orderdate), '-', year(o_orderdate) + 543)
  WHEN 4 THEN concat('2566-02-', o_orderkey % 40) END"""
_DATE_SQL = """CASE o_orderkey % 6
  WHEN 0 THEN concat(year(o_orderdate) + 543, strftime(o_orderdate, '-%m-%d'), ' 00:00:00')
  WHEN 1 THEN concat(strftime(o_orderdate, '%d/%m/'), year(o_orderdate) + 543)
  WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d')
  WHEN 3 THEN concat(day(o_orderdate), '-', month(o_orderdate), '-', year(o_orderdate) + 543)
  WHEN 4 THEN concat('2566-02-', o_orderkey % 40) END"""


@check(
    rf"""WITH d AS (SELECT o_orderkey, {_DATE_SQL} AS t FROM orders),
p AS (
  SELECT o_orderkey, t,
    CASE WHEN regexp_matches(t, '^\d{{4}}-') THEN string_split(split_part(t, ' ', 1), '-')
         ELSE list_reverse(regexp_split_to_array(t, '[-/]')) END AS f
  FROM d
),
n AS (
  SELECT *, try_cast(f[1] AS INT) AS y FROM p
)
SELECT o_orderkey, t AS said, day, (year(day) + 543)::INT AS year, month(day)::INT AS month,
       quarter(day)::INT AS quarter
FROM (
  SELECT *, try_cast(printf('%04d-%02d-%02d', CASE WHEN y // 100 = 25 THEN y - 543 ELSE y END,
                            try_cast(f[2] AS INT), try_cast(f[3] AS INT)) AS DATE) AS day
  FROM n
)"""
)
def era_date(spark, folder):
    df = table(spark, folder, "orders").select("o_orderkey", F.expr(_DATE_SPARK).alias("said"))
    day = F.col("day")
    return df.withColumn("day", dates.era_date("said")).select(
        "*", (F.year(day) + 543).alias("year"), F.month(day).alias("month"),
        F.quarter(day).alias("quarter"),
    )


@check(
    f"""WITH d AS (SELECT o_orderkey, {_DATE_SQL} AS t FROM orders)
SELECT o_orderkey, CASE WHEN regexp_matches(left(t, 4), '^\\d+$') THEN left(t, 4)::INT END AS year
FROM d"""
)
def leading_year(spark, folder):
    df = table(spark, folder, "orders").select("o_orderkey", F.expr(_DATE_SPARK).alias("said"))
    return df.select("o_orderkey", text.leading_year("said").alias("year"))


_THAI_SHORT = [names[0] for names in dates.MONTH_SPELLINGS]
_MONTH_SQL = """CASE l_linenumber WHEN 1 THEN strftime(l_shipdate, ' %B')
  WHEN 2 THEN upper(strftime(l_shipdate, '%b')) WHEN 3 THEN strftime(l_shipdate, '%m')
  WHEN 4 THEN concat(month(l_shipdate), '.0')
  WHEN 5 THEN [{}][month(l_shipdate)]
  WHEN 6 THEN 'month 13' END""".format(", ".join(f"'{m}'" for m in _THAI_SHORT))
_MONTH_SPARK = """CASE l_linenumber WHEN 1 THEN concat(' ', date_format(l_shipdate, 'MMMM'))
  WHEN 2 THEN upper(date_format(l_shipdate, 'MMM')) WHEN 3 THEN date_format(l_shipdate, 'MM')
  WHEN 4 THEN concat(month(l_shipdate), '.0')
  WHEN 5 THEN element_at(array({}), month(l_shipdate))
  WHEN 6 THEN 'month 13' END""".format(", ".join(f"'{m}'" for m in _THAI_SHORT))


@check(
    f"""WITH m AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate, {_MONTH_SQL} AS said FROM lineitem
)
SELECT l_orderkey, l_linenumber, l_partkey, said,
  CASE WHEN l_linenumber <= 5 THEN quarter(l_shipdate)::INT END AS quarter,
  NULL::INT AS short_quarter,
  CASE WHEN l_linenumber IN (1, 2) THEN (month(l_shipdate) - 1)::INT ELSE 999 END AS month_key
FROM m"""
)
def month_to_quarter(spark, folder):
    df = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.expr(_MONTH_SPARK).alias("said")
    )
    return df.select(
        "*",
        dates.quarter_of_month("said").alias("quarter"),
        dates.quarter_of_short_month("said").alias("short_quarter"),
        dates.month_key("said").alias("month_key"),
    )


@check(
    f"""WITH {INCIDENT}
SELECT row_key, month, quarter FROM incident"""
)
def short_month_quarter(spark, folder):
    return incident(spark, folder, "row_key", "month").select(
        "row_key",
        dates.month_title(F.lower("month")).alias("month"),
        dates.quarter_of_short_month("month").alias("quarter"),
    )


@check(
    f"""WITH {INCIDENT},
texts AS (SELECT DISTINCT cause FROM incident WHERE cause IS NOT NULL)
SELECT cause, array_to_string({TOKENS_SQL.format("cause")}, '|') AS tokens FROM texts"""
)
def tokenise(spark, folder):
    df = incident(spark, folder, "cause").where("cause IS NOT NULL").distinct()
    return df.select("cause", F.array_join(text.tokens("cause"), "|").alias("tokens"))


@check(
    r"""SELECT page_id, url, array_to_string(list_filter(list_transform(
  string_split(regexp_replace(url, '\(.*?\)', '', 'g'), '/'), lambda x: trim(x)),
  lambda x: x <> ''), '|') AS tokens FROM pages"""
)
def tokenise_urls(spark, folder):
    return table(spark, folder, "pages").select(
        "page_id", "url", F.array_join(text.tokens("url"), "|").alias("tokens")
    )


@check(
    f"""WITH {INCIDENT}, {SYNONYMS_SQL},
texts AS (SELECT DISTINCT cause FROM incident)
SELECT cause, coalesce(target, trim(cause)) AS text
FROM texts LEFT JOIN synonyms ON trim(cause) = source"""
)
def synonym_replace(spark, folder):
    df = incident(spark, folder, "cause").distinct()
    return df.select("cause", text.replace_synonym("cause", SYNONYMS).alias("text"))


@check(
    """SELECT name, concat('NATION_', lpad(length(ltrim(substr(name, 8), '0'))::VARCHAR, 10, '0'),
  ltrim(substr(name, 8), '0')) AS sort_key FROM (
  SELECT n_name AS name FROM nation
  UNION SELECT concat('NATION_', s_suppkey * 7 + 30) FROM supplier)"""
)
def natural_sort(spark, folder):
    nation = table(spark, folder, "nation").select(F.col("n_name").alias("name"))
    supplier = table(spark, folder, "supplier").select(
        F.concat(F.lit("NATION_"), F.col("s_suppkey") * 7 + 30)
    )
    names = nation.union(supplier).distinct().withColumn("sort_key", text.natural_key("name"))
    return rank_rows(names, ["sort_key"], [True])


@check(
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  {r("l_extendedprice * l_discount", 2)} AS rounded,
  {r("l_quantity / 3", 1)} AS third,
  least(greatest(l_quantity / 20, 0.8::DOUBLE), 1.5::DOUBLE) AS clipped,
  CASE WHEN l_tax > 0 THEN l_discount / l_tax END AS ratio
FROM lineitem"""
)
def round_clip_ratio(spark, folder):
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        numbers.round_even(F.col("l_extendedprice") * F.col("l_discount"), 2).alias("rounded"),
        numbers.round_even(F.col("l_quantity") / 3, 1).alias("third"),
        numbers.clip(F.col("l_quantity") / 20, 0.8, 1.5).alias("clipped"),
        numbers.safe_ratio("l_discount", "l_tax").alias("ratio"),
    )


@check(
    """WITH RECURSIVE pairs AS (
  SELECT p_partkey, p_name AS a, lower(p_type) || ' ' || p_brand AS b FROM part
),
distinct_pairs AS (SELECT DISTINCT a, b FROM pairs),
walk AS (
  SELECT a, b, 0 AS i, list_transform(range(length(b) + 1), lambda x: 0) AS row FROM distinct_pairs
  UNION ALL
  SELECT a, b, i + 1,
    list_reduce(range(1, length(b) + 1), lambda acc, j: list_append(acc,
      CASE WHEN substr(a, i + 1, 1) = substr(b, j::INT, 1) THEN row[j] + 1
           ELSE greatest(acc[j], row[j + 1]) END), [0])
  FROM walk WHERE i < length(a)
)
SELECT p_partkey, p.a, p.b, 200.0::DOUBLE * w.row[length(p.b) + 1] / (length(p.a) + length(p.b)) AS ratio
FROM pairs p JOIN walk w ON p.a = w.a AND p.b = w.b AND w.i = length(p.a)"""
)
def indel_ratio(spark, folder):
    df = table(spark, folder, "part").select(
        "p_partkey", F.col("p_name").alias("a"),
        F.concat(F.lower("p_type"), F.lit(" "), F.col("p_brand")).alias("b"),
    )
    return df.withColumn("ratio", similarity.indel_ratio("a", "b"))
