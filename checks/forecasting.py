"""Trend, profiles, forecasts, encoding, split and model quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.fixtures import (
    AREA_PRODUCTS,
    CASCADE,
    INCIDENT,
    ROW_PRODUCTS,
    RULES,
    SEVERE,
    SYNONYMS,
    THEMES,
    incident,
    table,
    themed,
    themed_counts,
)
from checks.registry import check, r, values
from checks.summaries import _SHARES
from perilscope.functions.numbers import round_even
from perilscope.operators import model, trend
from perilscope.operators.crosstab import to_wide
from perilscope.plans import forecast
from perilscope.plans import incident as pipeline
from perilscope.session import run_folder, stored
from perilscope.sources.outputs import read_output

_TREND = f"""{CASCADE},
cells AS (
  SELECT area, theme, count(*) FILTER (WHERE year = 1999 AND quarter IN (1, 2)) AS n1,
         count(*) FILTER (WHERE year = 2000 AND quarter IN (1, 2)) AS n2,
         sum(count(*) FILTER (WHERE year = 1999)) OVER (PARTITION BY area) AS all1,
         sum(count(*) FILTER (WHERE year = 2000)) OVER (PARTITION BY area) AS all2
  FROM themed GROUP BY area, theme
),
trend AS (
  SELECT area, theme, CASE WHEN all1 = 0 OR all2 = 0 THEN 1.0::DOUBLE
    WHEN n1 > 0 THEN least(greatest((n2 / all2::DOUBLE) / (n1 / all1::DOUBLE), 0.8::DOUBLE), 1.5::DOUBLE)
    WHEN n2 > 0 THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END AS trend
  FROM cells WHERE theme IS NOT NULL
)"""


def _trend(df, n=None):
    return trend.yoy_trend(df, "area", "theme", "year", "quarter", 1999, 2000, n=n)


@check(f"WITH RECURSIVE {_TREND} SELECT * FROM trend")
def yoy_trend(spark, folder):
    return _trend(themed_counts(spark, folder, "area", "year", "quarter"), "n")


_FEATURES = ["priority", "segment", "surface", "severity"]
_MODE = f"""{INCIDENT},
long AS (
  {" UNION ALL ".join(f"SELECT area, '{f}' AS feature, {f}::VARCHAR AS v FROM incident" for f in _FEATURES)}
),
counts AS (SELECT area, feature, v, count(*) AS n FROM long GROUP BY ALL),
modes AS (
  SELECT area, feature, v FROM counts
  QUALIFY row_number() OVER (PARTITION BY area, feature ORDER BY v IS NULL, n DESC, v) = 1
),
profile AS (
  SELECT area, {", ".join(f"coalesce(max(v) FILTER (WHERE feature = '{f}'), 'Unknown') AS {f}" for f in _FEATURES)}
  FROM modes GROUP BY area
)"""


@check(f"WITH {_MODE} SELECT * FROM profile")
def mode_profile(spark, folder):
    df = incident(spark, folder, "area", *_FEATURES)
    return trend.modal_profile(df, "area", _FEATURES)


@check(f"WITH {_MODE} SELECT q AS quarter, p.* FROM profile p, (VALUES (3), (4)) AS t(q)")
def future_profile(spark, folder):
    df = incident(spark, folder, "area", *_FEATURES)
    return forecast.future_profile(df, "area", (3, 4), _FEATURES)


# the share of each theme in the rows of the quarter in past years stands for the model
_PROBS = f"""{_TREND},
probs AS (
  SELECT area, theme, quarter,
         count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY area, quarter) AS prob
  FROM themed WHERE theme IS NOT NULL AND quarter IN (3, 4) GROUP BY area, theme, quarter
),
counted AS (
  SELECT area, theme, cause, count(*) AS n FROM themed
  WHERE theme IS NOT NULL AND cause IS NOT NULL GROUP BY ALL
),
shares AS (
  SELECT area, theme, cause, n::DOUBLE / sum(n) OVER (PARTITION BY area, theme) AS share
  FROM counted
  QUALIFY row_number() OVER (PARTITION BY area, theme ORDER BY n DESC, cause) <= 3
),
forecast AS (
  SELECT quarter, p.area, p.theme, {r("prob * 100", 2)} AS base_prob, {r("trend", 2)} AS trend,
         cause AS sub_cause, {r("prob * share * trend * 100", 2)} AS estimated_prob,
         {r("share * 100", 2)} AS history_pct, {r("prob * share * 100", 2)} AS plain_prob
  FROM probs p JOIN shares s ON p.area = s.area AND p.theme = s.theme
  JOIN trend t ON p.area = t.area AND p.theme = t.theme
)"""


def _probs(df):
    known = df.where("theme IS NOT NULL AND quarter IN (3, 4)")
    cells = known.groupBy("area", "theme", "quarter").agg(F.count("*").alias("n"))
    totals = cells.groupBy("area", "quarter").agg(F.sum("n").alias("total"))
    return cells.join(totals, ["area", "quarter"]).select(
        "quarter", "area", "theme", (F.col("n") / F.col("total")).alias("prob")
    )


@check(
    f"""WITH RECURSIVE {_PROBS}
SELECT quarter, area, theme, base_prob, trend, sub_cause, estimated_prob FROM forecast"""
)
def subcause_forecast(spark, folder):
    df = themed(spark, folder, "area", "cause", "year", "quarter")
    return forecast.subcause_forecast(_probs(df), df, "area", "theme", "cause", _trend(df))


@check(
    f"""WITH RECURSIVE {_PROBS}
SELECT quarter, area, theme, base_prob, sub_cause, history_pct, plain_prob AS estimated_prob
FROM forecast"""
)
def subcause_forecast_plain(spark, folder):
    df = themed(spark, folder, "area", "cause", "year", "quarter")
    return forecast.subcause_forecast(_probs(df), df, "area", "theme", "cause")


@check(
    f"""WITH RECURSIVE {_PROBS},
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY quarter, area
    ORDER BY prob DESC, list_position({list(THEMES)!r}, theme)) AS place FROM probs
)
SELECT quarter, area,
  {", ".join(f"{r(f'100 * max(prob) FILTER (WHERE theme = {t!r})', 2)} AS prob_{t}" for t in THEMES)},
  max(theme) FILTER (WHERE place = 1) AS top_theme, {r("max(prob) * 100", 2)} AS top_prob
FROM ranked GROUP BY quarter, area"""
)
def theme_forecast(spark, folder):
    df = themed(spark, folder, "area", "quarter")
    return forecast.theme_forecast(_probs(df), "area", "theme", list(THEMES))


@check(
    f"""WITH RECURSIVE {_PROBS}
SELECT quarter, area, {", ".join(f"max(prob) FILTER (WHERE theme = '{t}') AS {t}" for t in THEMES)}
FROM probs GROUP BY quarter, area"""
)
def theme_prob_wide(spark, folder):
    probs = _probs(themed(spark, folder, "area", "quarter"))
    return to_wide(probs, ["quarter", "area"], "theme", "prob", {t: t for t in THEMES})


@check(f"WITH RECURSIVE {_PROBS} SELECT quarter, count(*) AS n FROM forecast GROUP BY quarter")
def forecast_counts(spark, folder):
    df = themed(spark, folder, "area", "cause", "year", "quarter")
    return forecast.forecast_counts(
        forecast.subcause_forecast(_probs(df), df, "area", "theme", "cause", _trend(df))
    )


@check(
    f"""WITH RECURSIVE {_PROBS}
SELECT (SELECT count(DISTINCT area) FROM forecast WHERE trend > 1.1) AS rising_areas,
  (SELECT theme FROM forecast GROUP BY theme
   ORDER BY {r("sum(estimated_prob)", 4)} DESC, theme LIMIT 1) AS top_theme"""
)
def forecast_kpis(spark, folder):
    df = themed(spark, folder, "area", "cause", "year", "quarter")
    out = forecast.subcause_forecast(_probs(df), df, "area", "theme", "cause", _trend(df))
    return forecast.forecast_kpis(out, "area", "theme")


# causes are some 2000 texts at the smallest scale of the comparison
_CODED = ["area", "priority", "severity", "cause"]


@check(
    f"""WITH {INCIDENT},
{", ".join(f"c_{f} AS (SELECT v, (row_number() OVER (ORDER BY v) - 1)::DOUBLE AS code FROM (SELECT DISTINCT coalesce({f}, 'Unknown') AS v FROM incident WHERE line <> 1))" for f in _CODED)}
SELECT row_key, {", ".join(f"coalesce(c_{f}.code, -1) AS {f}_code" for f in _CODED)}
FROM incident i {" ".join(f"LEFT JOIN c_{f} ON coalesce(i.{f}, 'Unknown') = c_{f}.v" for f in _CODED)}"""
)
def ordinal_encode(spark, folder):
    df = incident(spark, folder, "row_key", "line", *_CODED)
    codes = model.OrdinalEncoding.fit(df.where("line <> 1"), _CODED)
    return codes.transform(df).select("row_key", *[f"{f}_code" for f in _CODED])


@check(
    f"""WITH {INCIDENT},
hashed AS (
  SELECT row_key, severity, md5(row_key || '|42') || '|' || row_key AS h FROM incident
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY severity ORDER BY h) AS place,
         count(*) OVER (PARTITION BY severity) AS n FROM hashed
)
SELECT row_key, severity,
       severity IS NOT NULL AND place <= floor(n * 0.2::DOUBLE) AS is_test FROM placed"""
)
def stratified_split(spark, folder):
    df = incident(spark, folder, "row_key", "severity")
    return model.split_flag(df, "severity", ["row_key"])


_CONFUSION = """pairs AS (
  SELECT quality::VARCHAR AS label, CASE WHEN contains(text, 'http') THEN '0'
         WHEN length(text) > 3000 THEN '2' ELSE '1' END AS pred
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id
)"""


def _judged(spark, folder):
    documents = table(spark, folder, "documents").select("doc_id", "text")
    labels = table(spark, folder, "labels").select("doc_id", "quality")
    return documents.join(labels, "doc_id").select(
        F.col("quality").cast("string").alias("label"),
        F.when(F.col("text").contains("http"), "0").when(F.length("text") > 3000, "2")
        .otherwise("1").alias("pred"),
    )


@check(
    f"""WITH {_CONFUSION},
classes AS (SELECT DISTINCT label AS class FROM pairs UNION SELECT DISTINCT pred FROM pairs),
counts AS (
  SELECT class, count(*) FILTER (WHERE label = class) AS support,
         count(*) FILTER (WHERE pred = class) AS given,
         count(*) FILTER (WHERE label = class AND pred = class) AS hits
  FROM classes, pairs GROUP BY class
),
rates AS (
  SELECT *, CASE WHEN given > 0 THEN hits::DOUBLE / given ELSE 0 END AS precision,
         CASE WHEN support > 0 THEN hits::DOUBLE / support ELSE 0 END AS recall FROM counts
),
scored AS (
  SELECT *, CASE WHEN precision + recall > 0
    THEN 2.0::DOUBLE * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM rates
),
every AS (
  SELECT class, precision, recall, f1, support FROM scored
  UNION ALL SELECT 'accuracy', sum(hits)::DOUBLE / sum(support), sum(hits)::DOUBLE / sum(support),
    sum(hits)::DOUBLE / sum(support), sum(support) FROM scored
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM scored
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support),
    sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM scored
)
SELECT class, {r("precision", 6)} AS precision, {r("recall", 6)} AS recall, {r("f1", 6)} AS f1,
       support::BIGINT AS support FROM every"""
)
def classification_report(spark, folder):
    out = model.classification_report(_judged(spark, folder), "label", "pred")
    return out.withColumns({c: round_even(c, 6) for c in ("precision", "recall", "f1")})


@check(
    f"""WITH {_CONFUSION}
SELECT {r("count(*) FILTER (WHERE label = pred)::DOUBLE / count(*) * 100", 2)} AS accuracy FROM pairs"""
)
def model_accuracy(spark, folder):
    return model.accuracy(_judged(spark, folder), "label", "pred")


def _plan() -> forecast.ForecastPlan:
    """The forest of the original size, learned from all labelled rows."""
    themes: dict[str, list[str]] = {}
    for pattern, label in RULES[:11]:
        themes.setdefault(label, []).append(pattern)
    return forecast.ForecastPlan(
        area="area", cause_word="cause", default_cause="cause text", month_word="month",
        themes=themes, default_theme="Handling",
        factor_cases=[("Environment", "cause", ["ring"]), ("Environment", "surface", ["f"]),
                      ("Machine", "cause", ["gear", "bolt"])],
        factor_default="Man", surface="surface",
        features=["quarter", "area", "surface", "priority", "traffic", "factor"],
        key=["row_key"], years=(1999, 2000), second_year_renames={"place": "area"},
        drop=["course"], trees=200, depth=10,
    )


def _years(spark, folder, land=False):
    """The rows of two years; a run that passes over them many times gets them as a table."""
    df = incident(spark, folder, "row_key", "area", "cause", "month", "surface", "priority", "year")
    if land:
        df = stored(df.where("year IN (1999, 2000)"), "years")
    named = df.withColumnRenamed("cause", "cause text")
    first = named.where("year = 1999").drop("year").withColumn("Unnamed: 9", F.lit(1))
    second = named.where("year = 2000").drop("year").withColumnRenamed("area", "place")
    return first, second.withColumn("course", F.lit("yes"))


@check(
    f"""WITH {INCIDENT}
SELECT q AS quarter, area, true AS whole, true AS top_is_largest, true AS as_written
FROM (SELECT DISTINCT area FROM incident WHERE year IN (1999, 2000)), (VALUES ('Q3'), ('Q4')) AS v(q)"""
)
def forest_forecast(spark, folder):
    """The whole forecast run, written and read back, by what must hold for any forest: the
    probabilities of an area sum to 100 and the top theme has the largest one."""
    result = forecast.run_forecast(*_years(spark, folder, land=True), _plan())
    base = run_folder(spark, "forecast")
    forecast.write_forecast(result, base, "r1")
    back = read_output(spark, base, "theme_forecast", "r1").drop("run_id")
    frames = [result.themes, back.select(*result.themes.columns)]
    same = frames[0].exceptAll(frames[1]).union(frames[1].exceptAll(frames[0])).isEmpty()
    probs = {c.removeprefix("prob_"): c for c in back.columns if c.startswith("prob_")}
    total = sum((F.col(c) for c in probs.values()), F.lit(0.0))
    largest = F.greatest(*[F.col(c) for c in probs.values()])
    of_top = F.coalesce(*[F.when(F.col("top_theme") == t, F.col(c)) for t, c in probs.items()])
    return back.select(
        "quarter", "area", (F.abs(total - 100.0) < 0.05).alias("whole"),
        ((of_top == largest) & (F.col("top_prob") == largest)).alias("top_is_largest"),
        F.lit(same).alias("as_written"),
    )


_PLAN_RULES = [(p, t) for t, ps in _plan().themes.items() for p in ps]
_SUBCAUSES = f"""{INCIDENT},
{values("rules", "pattern, label, ord", [(*x, i) for i, x in enumerate(_PLAN_RULES)])},
labels AS (
  SELECT cause, arg_min(label, ord) AS label
  FROM (SELECT DISTINCT cause FROM incident) JOIN rules ON contains(cause, pattern) GROUP BY cause
),
themed AS (
  SELECT i.*, coalesce(label, 'Handling') AS theme
  FROM incident i LEFT JOIN labels x ON i.cause = x.cause WHERE year IN (1999, 2000)
),
cells AS (
  SELECT area, theme, count(*) FILTER (WHERE year = 1999 AND quarter IN (1, 2)) AS n1,
         count(*) FILTER (WHERE year = 2000 AND quarter IN (1, 2)) AS n2,
         sum(count(*) FILTER (WHERE year = 1999)) OVER (PARTITION BY area) AS all1,
         sum(count(*) FILTER (WHERE year = 2000)) OVER (PARTITION BY area) AS all2
  FROM themed GROUP BY area, theme
),
trends AS (
  SELECT area, theme, CASE WHEN all1 = 0 OR all2 = 0 THEN 1.0::DOUBLE
    WHEN n1 > 0 THEN least(greatest((n2 / all2::DOUBLE) / (n1 / all1::DOUBLE), 0.8::DOUBLE), 1.5::DOUBLE)
    WHEN n2 > 0 THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END AS trend
  FROM cells
),
counted AS (
  SELECT area, theme, cause, count(*) AS n FROM themed WHERE cause IS NOT NULL
  GROUP BY area, theme, cause
),
top AS (
  SELECT area, theme, cause FROM counted
  QUALIFY row_number() OVER (PARTITION BY area, theme ORDER BY n DESC, cause) <= 3
)"""


@check(
    f"""WITH {_SUBCAUSES}
SELECT q AS quarter, area, theme AS campaign_theme, {r("trend", 2)} AS trend, cause AS sub_cause,
       true AS is_share
FROM top JOIN trends USING (area, theme), (VALUES ('Q3'), ('Q4')) AS v(q)"""
)
def forest_forecast_rows(spark, folder):
    """Of the whole forecast run, all that does not depend on the forest itself."""
    out = forecast.run_forecast(*_years(spark, folder, land=True), _plan()).forecast
    share = F.col("base_prob").between(0, 100) & (F.col("estimated_prob") <= F.col("base_prob") * 1.5)
    return out.select("quarter", "area", "campaign_theme", "trend", "sub_cause", share.alias("is_share"))


@check(
    f"""SELECT feature, true AS is_share, true AS all_is_100
FROM (VALUES {", ".join(f"('{f}')" for f in _plan().features)}) AS v(feature)"""
)
def forest_importance(spark, folder):
    """Importances of exactly the given features, which are shares of 100."""
    plan = _plan()
    df, _ = forecast.forecast_input(*_years(spark, folder, land=True), plan)
    fitted = model.fit_forest(df, plan.features, "campaign_theme", plan.trees, plan.depth)
    found = model.importances(fitted, df)
    total = found.agg(F.sum("importance").alias("t")).scalar()
    return found.select(
        "feature", F.col("importance").between(0, 100).alias("is_share"),
        (F.abs(total - 100.0) < 0.05).alias("all_is_100"),
    )


# a label that two features decide, among others that say nothing about it
_SIGNAL = """CASE WHEN left(priority, 1) IN ('1', '4') THEN 'early'
  WHEN surface = 'F' THEN 'late' ELSE 'never' END"""
_SIGNAL_FEATURES = ["quarter", "area", "surface", "priority"]


def _signal(spark, folder):
    """Rows with the label, and a forest that has learned it from 80 of 100 of them."""
    df = stored(incident(spark, folder, "row_key", *_SIGNAL_FEATURES), "signal")
    df = df.withColumn("label", F.expr(_SIGNAL))
    train, test = model.stratified_split(df, "label", ["row_key"])
    fitted = model.fit_forest(train, _SIGNAL_FEATURES, "label", trees=60, depth=8)
    return df, test, fitted


@check(
    f"""WITH {INCIDENT}
SELECT DISTINCT {", ".join(_SIGNAL_FEATURES)}, {_SIGNAL} AS pred FROM incident"""
)
def forest_signal(spark, folder):
    """The forest predicts the planted label of every combination of features."""
    df, _, fitted = _signal(spark, folder)
    return model.predict_class(fitted, df.select(*_SIGNAL_FEATURES).distinct())


@check("SELECT 100.0::DOUBLE AS accuracy")
def forest_signal_accuracy(spark, folder):
    """What was held out is predicted without an error; the rows are those of ``stratified_split``."""
    _, test, fitted = _signal(spark, folder)
    return model.accuracy(model.predict_class(fitted, test), "label", "pred")


@check(
    """SELECT * FROM (VALUES ('priority', 1::INT, true), ('surface', 2, true), ('area', NULL, false),
  ('quarter', NULL, false)) AS v(feature, place, decides)"""
)
def forest_signal_importance(spark, folder):
    """The features that decide the label come first, and have nearly all of the importance."""
    df, _, fitted = _signal(spark, folder)
    found = model.importances(fitted, df)
    falling = found.agg(F.sort_array(F.collect_list("importance"), False).alias("all")).scalar()
    decides = F.col("importance") > 15
    place = F.array_position(falling, F.col("importance")).cast("int")
    return found.select("feature", F.when(decides, place).alias("place"), decides.alias("decides"))


@check(
    f"""WITH {INCIDENT}
SELECT row_key, quarter, coalesce(area, 'Unknown') AS area, year::INT AS year,
  CASE WHEN contains(c, 'ring') OR contains(lower(surface), 'f') THEN 'Environment'
       WHEN contains(c, 'gear') OR contains(c, 'bolt') THEN 'Machine' ELSE 'Man' END AS factor,
  'Unknown' AS traffic
FROM (SELECT *, lower(coalesce(cause, '')) AS c FROM incident) WHERE year IN (1999, 2000)"""
)
def forecast_input(spark, folder):
    df, _ = forecast.forecast_input(*_years(spark, folder), _plan())
    return df.select("row_key", "quarter", "area", "year", "factor", "traffic")


@check(
    f"""WITH RECURSIVE {_SHARES},
counted AS (
  SELECT area, theme, cause, count(*) AS n FROM themed
  WHERE theme IS NOT NULL AND cause IS NOT NULL GROUP BY area, theme, cause
),
top AS (
  SELECT *, row_number() OVER (PARTITION BY area, theme ORDER BY n DESC, cause) AS rank
  FROM counted QUALIFY rank <= 3
),
detail AS (
  SELECT area, theme, string_agg(cause || ' (' || n || ')', ' • ' ORDER BY rank) AS causes
  FROM top GROUP BY area, theme
),
{values("products", "theme, band, product", [(*k, v) for k, v in AREA_PRODUCTS.items()])}
SELECT r.area, risk_score, priority_level, recommended_campaign, supporting_campaigns, confidence,
       coalesce(product, 'basic') AS insurance_recommendation,
       coalesce(causes, '-') AS recommended_campaign_detail
FROM recommended r LEFT JOIN detail d ON r.area = d.area AND recommended_campaign = d.theme
LEFT JOIN products p ON recommended_campaign = p.theme AND priority_level = band"""
)
def pipeline_end_to_end(spark, folder):
    """The incident run from a dirty table to the area table, written and read back."""
    return _incident_run(spark, folder, "area_summary").select(
        "area", "risk_score", "priority_level", "recommended_campaign", "supporting_campaigns",
        "confidence", "insurance_recommendation", "recommended_campaign_detail",
    )


@check(
    f"""WITH RECURSIVE {CASCADE},
{values("products", "theme, severity, product", [(*k, v) for k, v in ROW_PRODUCTS.items()])}
SELECT row_key, t.cause AS "cause text", t.theme AS campaign_theme,
       coalesce(product, 'basic') AS insurance_recommendation
FROM themed t LEFT JOIN products p ON t.theme = p.theme AND t.severity = p.severity"""
)
def pipeline_rows(spark, folder):
    """The row-level output of the same run, read back."""
    return _incident_run(spark, folder, "rows").select(
        "row_key", "cause text", "campaign_theme", "insurance_recommendation"
    )


def _incident_run(spark, folder, name):
    raw = incident(
        spark, folder, "row_key", "area", "cause", "severity", "age", "month", "employee"
    ).select(
        F.concat(F.lit(" "), "area").alias(" area "), F.col("cause").alias("cause  text"),
        F.coalesce("severity", F.lit("nan")).alias("severity"),
        F.col("age").cast("string").alias("age"), F.lower("month").alias("month"),
        F.col("employee").alias("employee id"), F.col("row_key"), F.lit(None).cast("string").alias("empty"),
    )
    plan = pipeline.IncidentPlan(
        area="area", cause="cause text", severity="severity", severe=SEVERE, themes=THEMES,
        rules=RULES, synonyms=SYNONYMS, row_products=ROW_PRODUCTS,
        optional=["age", "month", "employee id"], numbers=["age"], age="age", month="month",
        personal=["employee id"], employee="employee id", area_products=AREA_PRODUCTS,
    )
    result = pipeline.run_pipeline(stored(raw, "raw"), plan)
    base = run_folder(spark, "incidents")
    pipeline.write_run(result, plan, base, "r1")
    return read_output(spark, base, name, "r1")
