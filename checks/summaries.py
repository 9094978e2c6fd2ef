"""Area summary, crosstabs, shares, leading causes, lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.fixtures import (
    AREA_PRODUCTS,
    CASCADE,
    INCIDENT,
    ROW_PRODUCTS,
    RULES,
    SEVERE,
    SEVERITIES,
    SYNONYMS,
    THEMES,
    incident,
    table,
    themed,
    themed_counts,
)
from checks.registry import check, r, values
from perilscope.functions.numbers import bin_right_closed, percent, weighted_score
from perilscope.operators import area as areas
from perilscope.operators import crosstab as ct
from perilscope.operators import joins, ranking, trend
from perilscope.operators.rules import classify
from perilscope.session import stored


def _pct(part: str, total: str, digits: int = 1) -> str:
    return r(f"{part} / {total} * 100", digits)


def _count(condition: str) -> str:
    return f"(count(*) FILTER (WHERE {condition}))::DOUBLE"


_SHARES = f"""{CASCADE},
impact AS (
  SELECT theme, {_count("severity = 'long'")} / count(*)::DOUBLE * 100 AS impact
  FROM themed WHERE theme IS NOT NULL AND severity IS NOT NULL GROUP BY theme
),
sums AS (
  SELECT area, {_count("severity IS NOT NULL")} AS s_all, {_count("severity = 'long'")} AS s_n,
         {_count("theme IS NOT NULL")} AS t_all,
         {", ".join(f"{_count(f'theme = {t!r}')} AS {p}_n" for t, p in THEMES.items())}
  FROM themed GROUP BY area
),
shares AS (
  SELECT area, {_pct("s_n", "s_all")} AS severity_pct,
         {", ".join(f"{_pct(f'{p}_n', 't_all')} AS {p}_pct" for p in THEMES.values())}
  FROM sums
),
scores AS (
  SELECT *, {", ".join(
      r(f"{p}_pct * coalesce((SELECT impact FROM impact WHERE theme = {t!r}), 0)", 2)
      + f" AS {p}_score" for t, p in THEMES.items())},
      {r("severity_pct * 0.5::DOUBLE + road_pct * 0.3::DOUBLE + speed_pct * 0.2::DOUBLE", 2)}
      AS risk_score
  FROM shares
),
banded AS (
  SELECT *, CASE WHEN risk_score > 0 AND risk_score <= 20 THEN 'Low'
                 WHEN risk_score > 20 AND risk_score <= 30 THEN 'Medium'
                 WHEN risk_score > 30 AND risk_score <= 100 THEN 'High' END AS priority_level
  FROM scores
),
long_pct AS (
  {" UNION ALL ".join(
      f"SELECT area, '{t}' AS theme, {i} AS ord, {p}_pct AS pct, {p}_score AS score FROM banded"
      for i, (t, p) in enumerate(THEMES.items()))}
),
ranked AS (
  SELECT area,
         row_number() OVER (PARTITION BY area ORDER BY score DESC, ord) AS by_score,
         row_number() OVER (PARTITION BY area ORDER BY pct DESC, ord) AS by_pct,
         theme, score
  FROM long_pct
),
picked AS (
  SELECT area, max(theme) FILTER (WHERE by_pct = 1) AS dominant_theme,
         max(theme) FILTER (WHERE by_score = 1) AS recommended_campaign,
         max(theme) FILTER (WHERE by_score = 2) || ' > ' || max(theme) FILTER (WHERE by_score = 3)
           AS supporting_campaigns,
         max(score) FILTER (WHERE by_score = 1) AS top1,
         max(score) FILTER (WHERE by_score = 2) AS top2
  FROM ranked GROUP BY area
),
recommended AS (
  SELECT b.*, dominant_theme, recommended_campaign, supporting_campaigns,
         CASE WHEN top1 + top2 > 0 THEN {r("top1 / (top1 + top2) * 100", 1)} END AS confidence
  FROM banded b JOIN picked USING (area)
)"""


def _summary(spark, folder):
    df = themed_counts(spark, folder, "area", "severity")
    return areas.area_summary(
        df, "area", "theme", "severity", SEVERE, THEMES,
        products=AREA_PRODUCTS, default_product="basic", n="n",
    )


_SCORE_COLUMNS = [
    "area", "severity_pct", *[f"{p}_pct" for p in THEMES.values()],
    *[f"{p}_score" for p in THEMES.values()], "risk_score", "priority_level",
]


@check(f"WITH RECURSIVE {_SHARES} SELECT {', '.join(_SCORE_COLUMNS)} FROM banded")
def area_risk_summary(spark, folder):
    summary = _summary(spark, folder).select(*_SCORE_COLUMNS)
    return areas.sort_by_risk(summary, "area")


@check(
    f"""WITH RECURSIVE {_SHARES},
{values("products", "theme, band, product", [(*k, v) for k, v in AREA_PRODUCTS.items()])}
SELECT area, dominant_theme, recommended_campaign, supporting_campaigns, confidence,
       coalesce(product, 'basic') AS insurance_recommendation
FROM recommended LEFT JOIN products ON recommended_campaign = theme AND priority_level = band"""
)
def area_recommendation(spark, folder):
    return _summary(spark, folder).select(
        "area", "dominant_theme", "recommended_campaign", "supporting_campaigns", "confidence",
        "insurance_recommendation",
    )


@check(
    f"""WITH RECURSIVE {_SHARES},
said AS (
  SELECT *, coalesce(priority_level, '-') AS band,
         format('{{:.1f}}', round_even(risk_score * 10, 0) / 10) AS score,
         format('{{:.1f}}', confidence) AS sure
  FROM recommended
)
SELECT area,
  CASE WHEN dominant_theme = recommended_campaign THEN
    'Risk band ' || band || ' (score ' || score || '). Theme ''' || dominant_theme ||
    ''' is the most frequent one and, weighted by severity, ''' || recommended_campaign ||
    ''' is also the most important one.'
  ELSE
    'Risk band ' || band || ' (score ' || score || '). Theme ''' || dominant_theme ||
    ''' is the most frequent one, but, weighted by severity, ''' || recommended_campaign ||
    ''' matters more.' END AS reason,
  'Risk: ' || band || ' (' || score || ')' || chr(10) || 'Dominant: ' || dominant_theme ||
  chr(10) || 'Recommended: ' || recommended_campaign || chr(10) || 'Supporting: ' ||
  supporting_campaigns || chr(10) || 'Confidence: ' || sure || '%' AS insight
FROM said"""
)
def area_explanation(spark, folder):
    return _summary(spark, folder).select("area", "reason", "insight")


@check(
    f"""WITH RECURSIVE {_SHARES},
counted AS (
  SELECT area, theme, cause, count(*) AS n FROM themed
  WHERE theme IS NOT NULL AND cause IS NOT NULL GROUP BY ALL
),
top AS (
  SELECT *, row_number() OVER (PARTITION BY area, theme ORDER BY n DESC, cause) AS rank
  FROM counted QUALIFY rank <= 3
),
detail AS (
  SELECT area, theme, string_agg(cause || ' (' || n || ')', ' • ' ORDER BY rank) AS causes
  FROM top GROUP BY area, theme
)
SELECT r.area, recommended_campaign, coalesce(causes, '-') AS recommended_campaign_detail
FROM recommended r LEFT JOIN detail d ON r.area = d.area AND recommended_campaign = d.theme"""
)
def attach_detail(spark, folder):
    df = themed_counts(spark, folder, "area", "severity", "cause")
    summary = areas.area_summary(df, "area", "theme", "severity", SEVERE, THEMES, n="n")
    return areas.attach_detail(summary, df, "area", "theme", "cause", count="n").select(
        "area", "recommended_campaign", "recommended_campaign_detail"
    )


@check(
    f"""WITH RECURSIVE {CASCADE}
SELECT area, {", ".join(f"count(*) FILTER (WHERE theme = {t!r}) AS {t}" for t in [*THEMES, "Unused"])}
FROM themed WHERE area IS NOT NULL AND theme IS NOT NULL GROUP BY area"""
)
def theme_crosstab(spark, folder):
    return ct.crosstab(
        themed_counts(spark, folder, "area"), "area", "theme", [*THEMES, "Unused"], n="n"
    )


@check(
    f"""WITH RECURSIVE {CASCADE}
SELECT area, {", ".join(f"{_pct(_count(f'theme = {t!r}'), 'count(*)')} AS {t}" for t in THEMES)}
FROM themed WHERE theme IS NOT NULL GROUP BY area"""
)
def theme_share(spark, folder):
    return ct.crosstab(
        themed_counts(spark, folder, "area"), "area", "theme", list(THEMES), True, n="n"
    )


_BY_GROUP = f"""{INCIDENT},
grouped AS (
  SELECT CASE WHEN age > 0 AND age <= 20 THEN '<20' WHEN age > 20 AND age <= 25 THEN '20-25'
              WHEN age > 25 AND age <= 30 THEN '26-30' WHEN age > 30 AND age <= 100 THEN '>30'
              END AS age_group, severity
  FROM incident
),
by_group AS (
  SELECT age_group, {", ".join(
      f"{_pct(_count(f'severity = {s!r}'), 'count(*)')} AS {s}" for s in SEVERITIES)}
  FROM grouped WHERE age_group IS NOT NULL AND severity IS NOT NULL GROUP BY age_group
)"""


def _by_group(spark, folder):
    df = incident(spark, folder, "age", "severity").withColumn(
        "age_group", bin_right_closed("age", (0, 20, 25, 30, 100), ("<20", "20-25", "26-30", ">30"))
    )
    return ct.crosstab(df, "age_group", "severity", SEVERITIES, True)


@check(f"WITH {_BY_GROUP} SELECT * FROM by_group")
def severity_share_by_group(spark, folder):
    return _by_group(spark, folder)


@check(
    f"""WITH {_BY_GROUP}
SELECT age_group AS "group", long AS value FROM by_group ORDER BY long DESC, age_group LIMIT 1"""
)
def worst_group(spark, folder):
    return ct.worst_group(_by_group(spark, folder), "age_group", "long")


@check(
    f"""WITH RECURSIVE {CASCADE}
SELECT theme, {_count("severity = 'long'")} / count(*)::DOUBLE * 100 AS impact
FROM themed WHERE theme IS NOT NULL AND severity IS NOT NULL GROUP BY theme"""
)
def theme_impact(spark, folder):
    return ct.theme_impact(
        themed_counts(spark, folder, "severity"), "theme", "severity", SEVERE, "n"
    )


@check(
    f"""WITH {INCIDENT},
counts AS (
  SELECT cause, severity, count(*) AS n FROM incident
  WHERE cause IS NOT NULL AND severity IS NOT NULL GROUP BY ALL
)
SELECT cause, severity, n, {_pct("n", "sum(n) OVER (PARTITION BY cause)")} AS pct FROM counts"""
)
def cause_severity_share(spark, folder):
    return ct.share_long(incident(spark, folder, "cause", "severity"), "cause", "severity")


@check(
    f"""WITH RECURSIVE {_SHARES}
SELECT area, theme AS "Theme", pct AS "%" FROM long_pct"""
)
def theme_share_long(spark, folder):
    wide = areas.area_shares(
        themed_counts(spark, folder, "area", "severity"), "area", "theme", "severity", SEVERE, THEMES,
        n="n",
    )
    return ct.to_long(wide, ["area"], {f"{p}_pct": t for t, p in THEMES.items()}, "Theme", "%")


@check(
    f"""WITH RECURSIVE {CASCADE},
counted AS (
  SELECT area, theme, cause, count(*) AS n FROM themed
  WHERE theme IS NOT NULL AND cause IS NOT NULL GROUP BY ALL
),
top AS (
  SELECT *, row_number() OVER (PARTITION BY area, theme ORDER BY n DESC, cause) AS rank
  FROM counted QUALIFY rank <= 3
)
SELECT area, theme, string_agg(cause || ' (' || n || ')', ' • ' ORDER BY rank) AS causes
FROM top GROUP BY area, theme"""
)
def topn_cause_text(spark, folder):
    return ranking.top_causes_text(
        themed_counts(spark, folder, "area", "cause"), ["area", "theme"], "cause", count="n"
    )


@check(
    f"""WITH RECURSIVE {CASCADE},
counted AS (
  SELECT area, theme, cause, count(*) AS n FROM themed
  WHERE theme IS NOT NULL AND cause IS NOT NULL GROUP BY ALL
)
SELECT area, theme, cause, n,
       row_number() OVER (PARTITION BY area, theme ORDER BY n DESC, cause)::INT AS rank,
       n::DOUBLE / sum(n) OVER (PARTITION BY area, theme) AS share
FROM counted QUALIFY rank <= 3"""
)
def cause_share_top3(spark, folder):
    return ranking.cause_share(
        themed_counts(spark, folder, "area", "cause"), ["area", "theme"], "cause", count="n"
    )


@check(
    f"""WITH RECURSIVE {CASCADE},
{values("products", "p_theme, p_severity, product", [(*k, v) for k, v in ROW_PRODUCTS.items()])}
SELECT row_key, t.theme, t.severity, coalesce(product, 'basic (default)') AS product
FROM themed t LEFT JOIN products p ON t.theme = p_theme AND t.severity = p_severity"""
)
def row_product_lookup(spark, folder):
    df = themed(spark, folder, "row_key", "severity")
    return joins.lookup(df, ["theme", "severity"], ROW_PRODUCTS, "product", "basic (default)").select(
        "row_key", "theme", "severity", "product"
    )


@check(
    f"""WITH {INCIDENT},
keyed AS (
  SELECT row_key, segment AS c_mktsegment,
         CASE WHEN line = 7 THEN NULL ELSE CAST(employee AS VARCHAR) END AS c_custkey
  FROM incident
)
SELECT row_key, k.c_custkey, k.c_mktsegment, c.c_mktsegment AS c_mktsegment_bank, c_name
FROM keyed k LEFT JOIN customer c ON k.c_custkey = CAST(c.c_custkey AS VARCHAR)"""
)
def master_join(spark, folder):
    df = incident(spark, folder, "row_key", "employee", "segment", "line").select(
        "row_key",
        F.when(F.col("line") != 7, F.concat(F.lit(" "), F.col("employee").cast("string"), F.lit(".0")))
        .alias("c_custkey"),
        F.col("segment").alias("c_mktsegment"),
    )
    master = table(spark, folder, "customer").select(
        "c_custkey", "c_mktsegment", "c_name"
    )
    return joins.join_master(stored(df, "rows"), master, "c_custkey")


@check(
    f"""WITH RECURSIVE {CASCADE}
SELECT row_key, cause, severity, cause AS actual_cause, theme AS advice
FROM themed"""
)
def personalised_output(spark, folder):
    raw = incident(spark, folder, "row_key", "cause", "severity")

    def derived(df):
        return classify(df, "cause", RULES, SYNONYMS, label="campaign_theme")[0]

    return joins.personalised(
        raw, derived, "row_key",
        {"cause": "actual_cause", "campaign_theme": "advice", "absent": "nowhere"},
    )


@check(
    f"""WITH RECURSIVE {CASCADE},
a AS (SELECT area, {_pct(_count("severity = 'long'"), 'count(*)')} AS severity_pct
      FROM themed WHERE severity IS NOT NULL AND line < 6 GROUP BY area),
b AS (SELECT area, {_pct(_count("theme = 'Road'"), 'count(*)')} AS road_pct
      FROM themed WHERE theme IS NOT NULL AND year <> 1999 GROUP BY area)
SELECT coalesce(a.area, b.area) AS area, severity_pct, road_pct FROM a FULL JOIN b ON a.area = b.area"""
)
def aligned_series(spark, folder):
    df = themed(spark, folder, "area", "severity", "line", "year")
    severity = (
        df.where("severity IS NOT NULL AND line < 6")
        .groupBy("area")
        .agg(percent(F.count_if(F.col("severity") == "long"), F.count("*")).alias("severity_pct"))
    )
    road = (
        df.where("theme IS NOT NULL AND year <> 1999")
        .groupBy("area")
        .agg(percent(F.count_if(F.col("theme") == "Road"), F.count("*")).alias("road_pct"))
    )
    return trend.joined_on([severity, road], "area")


@check(
    f"""WITH RECURSIVE {_SHARES}
SELECT area, {", ".join(r(f"{p}_pct * coalesce((SELECT impact FROM impact WHERE theme = {t!r}), 0)", 2) + f" AS {p}_score" for t, p in THEMES.items())},
       {r("road_pct * 0.25::DOUBLE + speed_pct * 0.75::DOUBLE", 1)} AS other_score
FROM shares"""
)
def theme_scores(spark, folder):
    df = themed(spark, folder, "area", "severity")
    shares = areas.area_shares(df, "area", "theme", "severity", SEVERE, THEMES)
    return shares.select(
        "area", *[f"{p}_score" for p in THEMES.values()],
        weighted_score({"road_pct": 0.25, "speed_pct": 0.75}, 1).alias("other_score"),
    )



@check(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, s_name
FROM lineitem LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 3 > 0) ON l_suppkey = s_suppkey"""
)
def join_mixed_keys(spark, folder):
    """Keys of different types on the two sides, all of them hot."""
    left = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("l_suppkey").cast("int").alias("l_suppkey")
    )
    right = table(spark, folder, "supplier").where("s_suppkey % 3 > 0").select(
        F.col("s_suppkey").alias("l_suppkey"), "s_name"
    )
    joined = joins.spread_left_join(left, right, ["l_suppkey"], salts=4, hot_rows=10)
    return joined.withColumn("l_suppkey", F.col("l_suppkey").cast("bigint"))
