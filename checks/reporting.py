"""Slices, counts, key figures and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.fixtures import CASCADE, INCIDENT, SEVERE, THEMES, incident, table, themed, themed_counts
from checks.registry import check, r
from checks.summaries import _SHARES
from perilscope.functions.numbers import round_even
from perilscope.functions.text import natural_key
from perilscope.operators import area as areas
from perilscope.operators import joins, report
from perilscope.session import run_folder
from perilscope.sources import footers


@check(
    f"""WITH {INCIDENT}
SELECT row_key, area, month FROM incident
WHERE month IN ('Jan', 'Mar', 'Jul') AND area IN ('NATION_2', 'NATION_10', 'NATION_24')"""
)
def filtered_slice(spark, folder):
    df = incident(spark, folder, "row_key", "area", "month")
    return report.slice_rows(
        df,
        {"month": ["Jan", "Mar", "Jul"], "area": ["NATION_2", "NATION_10", "NATION_24"],
         "row_key": []},
    )


@check(
    f"""WITH {INCIDENT}
SELECT row_key, area, quarter FROM incident WHERE quarter = 3 AND cause IS NULL"""
)
def quarter_slice(spark, folder):
    df = incident(spark, folder, "row_key", "area", "quarter", "cause")
    out = report.slice_rows(df, {"quarter": [3], "area": None})
    return out.where(F.col("cause").isNull()).drop("cause")


@check("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def value_counts(spark, folder):
    return report.value_counts(table(spark, folder, "events"), "event_type")


@check(f"WITH {INCIDENT} SELECT severity, count(*) AS n FROM incident GROUP BY severity")
def value_counts_nulls(spark, folder):
    return report.value_counts(incident(spark, folder, "severity"), "severity", dropna=False)


@check(
    f"""WITH {INCIDENT}
SELECT cause, count(*) AS n FROM incident WHERE cause IS NOT NULL GROUP BY cause
ORDER BY n DESC, cause LIMIT 20"""
)
def top20_causes(spark, folder):
    return report.value_counts(incident(spark, folder, "cause"), "cause", top=20)


@check(f"WITH {INCIDENT} SELECT month, count(*) AS n FROM incident GROUP BY month")
def month_counts_calendar(spark, folder):
    return report.counts_by_month(incident(spark, folder, "month"), "month")


@check(
    """WITH wanted(event_type) AS (VALUES ('view'), ('click'), ('absent'))
SELECT event_type, n FROM wanted
LEFT JOIN (SELECT event_type, count(*) AS n FROM events GROUP BY event_type) USING (event_type)"""
)
def reindexed_counts(spark, folder):
    counts = report.value_counts(table(spark, folder, "events"), "event_type")
    return report.reindex(counts, "event_type", ["view", "click", "absent"])


@check(
    f"""WITH RECURSIVE {_SHARES}
SELECT (SELECT count(*) FROM themed) AS reports,
  (SELECT count(*) FILTER (WHERE priority_level = 'High') FROM banded) AS high_areas,
  (SELECT {r("avg(risk_score)", 1)} FROM banded) AS mean_score,
  (SELECT {r("count(theme)::DOUBLE / count(*) * 100", 1)} FROM themed) AS mapped_pct,
  (SELECT theme FROM themed WHERE theme IS NOT NULL GROUP BY theme
   ORDER BY count(*) DESC, theme LIMIT 1) AS top_theme"""
)
def kpis(spark, folder):
    df = themed_counts(spark, folder, "area", "severity")
    summary = areas.area_summary(df, "area", "theme", "severity", SEVERE, THEMES, n="n")
    return report.kpis(df, summary, "theme", n="n")


@check(
    f"""WITH {INCIDENT}
SELECT segment, sum(speed) AS value FROM incident GROUP BY segment
ORDER BY value DESC, segment LIMIT 1"""
)
def group_sum_argmax(spark, folder):
    return report.group_top(incident(spark, folder, "segment", "speed"), ["segment"], "speed")


@check(
    f"""WITH RECURSIVE {CASCADE}
SELECT theme, cause, avg(speed) AS value FROM themed WHERE theme IS NOT NULL
GROUP BY theme, cause ORDER BY value DESC, theme, cause LIMIT 5"""
)
def top5_mean(spark, folder):
    df = themed(spark, folder, "cause", "speed").where("theme IS NOT NULL")
    return report.group_top(df, ["theme", "cause"], "speed", "mean", 5)


@check(
    f"""WITH RECURSIVE {CASCADE}
SELECT theme, avg(speed) AS value FROM themed GROUP BY theme"""
)
def group_mean(spark, folder):
    return report.group_measure(themed(spark, folder, "speed"), ["theme"], "speed", "mean")


@check(
    f"""WITH {INCIDENT}
SELECT count(DISTINCT CASE WHEN speed > 49 AND severity = 'long' THEN employee END) AS n FROM incident"""
)
def distinct_if(spark, folder):
    df = incident(spark, folder, "employee", "speed", "severity")
    return report.distinct_if(df, "employee", (F.col("speed") > 49) & (F.col("severity") == "long"))


_DESCRIBED = ("l_quantity", "l_linenumber", "l_extendedprice")
_DESCRIBE = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count({c}) AS "count", {r(f"avg({c})", 6)} AS mean,
  {r(f"stddev_samp({c})", 6)} AS std, min({c})::DOUBLE AS min,
  {r(f"quantile_cont({c}, 0.25)", 6)} AS q1, {r(f"quantile_cont({c}, 0.5)", 6)} AS median,
  {r(f"quantile_cont({c}, 0.75)", 6)} AS q3, max({c})::DOUBLE AS max FROM lineitem"""
    for c in _DESCRIBED
)


def _described(spark, folder, **options):
    out = report.describe(table(spark, folder, "lineitem"), _DESCRIBED, **options)
    return out.withColumns(
        {c: round_even(c, 6) for c in ("mean", "std", "q1", "median", "q3")}
    )


@check(_DESCRIBE)
def describe(spark, folder):
    return _described(spark, folder)


@check(_DESCRIBE)
def describe_in_ranges(spark, folder):
    """The same by narrowing ranges, as for columns too large to rank."""
    return _described(spark, folder, few=500)


_COLUMNS = [
    "row_key", "area", "cause", "severity", "age", "speed", "date", "year", "quarter", "month",
    "surface", "employee", "priority", "segment", "line", "price",
]


@check(
    f"""WITH {INCIDENT}, n AS (
  SELECT {", ".join(f"count(*) - count({c}) AS {c}" for c in _COLUMNS)} FROM incident
)
SELECT * FROM (UNPIVOT n ON {", ".join(_COLUMNS)} INTO NAME "column" VALUE nulls)
ORDER BY nulls DESC, "column" LIMIT 15"""
)
def null_counts(spark, folder):
    return report.null_counts(incident(spark, folder, *_COLUMNS))


@check(
    f"""WITH {INCIDENT}
SELECT area, severity, count(*) AS n FROM incident GROUP BY ALL
ORDER BY severity NULLS LAST, n DESC, area LIMIT 17"""
)
def rank_rows(spark, folder):
    df = incident(spark, folder, "area", "severity").groupBy("area", "severity").agg(
        F.count("*").alias("n")
    )
    return report.rank_rows(df, ["severity", "n", "area"], [True, False, True], 17)


@check(
    f"""WITH {INCIDENT}
SELECT area FROM (SELECT DISTINCT area FROM incident) ORDER BY substr(area, 8)::INT"""
)
def natural_area_list(spark, folder):
    df = incident(spark, folder, "area").distinct()
    return report.rank_rows(df, [natural_key("area")], [True])


@check(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem
WHERE l_partkey IN (SELECT 3 * x FROM range(100000) t(x))
  AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)"""
)
def long_list_slice(spark, folder):
    """A filter of 100,000 values, and one that is a frame."""
    df = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"
    )
    rich = table(spark, folder, "supplier").where("s_acctbal > 0").select("s_suppkey")
    return report.slice_rows(df, {"l_partkey": range(0, 300_000, 3), "l_suppkey": rich})


_DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@check(
    f"""WITH n AS (
  SELECT {", ".join(f"count(*) - count({c}) AS {c}" for c in _DOCUMENT_COLUMNS)} FROM documents
)
SELECT * FROM (UNPIVOT n ON {", ".join(_DOCUMENT_COLUMNS)} INTO NAME "column" VALUE nulls)"""
)
def null_counts_by_footer(spark, folder):
    return footers.null_counts(spark, f"{folder}/documents.parquet")


@check("SELECT c_custkey, c_mktsegment FROM customer")
def read_filled_columns(spark, folder):
    """Columns without a value are told by the footers."""
    base = run_folder(spark, "filled")
    customer = table(spark, folder, "customer")
    customer.select(
        "c_custkey", F.lit(None).cast("string").alias("never"), "c_mktsegment",
        F.when(F.col("c_custkey") < 0, 1).alias("not yet"),
    ).repartition(3).write.parquet(base)
    return footers.read_filled(spark, base)


@check(
    """SELECT l_returnflag, l_linenumber, l_quantity * 2 AS twice, l_linestatus = 'O' AS is_open
FROM lineitem"""
)
def personalised_by_position(spark, folder):
    """A table without a key, with many copies of rows, joined with what was derived from it."""
    lines = joins.positioned(table(spark, folder, "lineitem"))
    raw = lines.select(joins.POSITION, "l_returnflag", "l_linenumber")
    derived = lines.select(
        joins.POSITION, (F.col("l_quantity") * 2).alias("d"), (F.col("l_linestatus") == "O").alias("o")
    )
    return joins.personalised(raw, derived, None, {"d": "twice", "o": "is_open", "x": "absent"})


@check(
    """SELECT CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderkey, c_name
FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_custkey % 7 = 0"""
)
def master_join_filtered(spark, folder):
    """A master above the broadcast limit, filtered by the keys of the rows before the shuffle."""
    rows = table(spark, folder, "orders").select("o_custkey", "o_orderkey")
    master = table(spark, folder, "customer").where("c_custkey % 7 = 0").select(
        F.col("c_custkey").alias("o_custkey"), "c_name"
    )
    return joins.join_master(rows, master, "o_custkey", limit=-1)
