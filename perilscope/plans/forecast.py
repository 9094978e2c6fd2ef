"""Forecast of themes and causes for coming quarters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perilscope.columns import col_of, cols_of
from perilscope.functions.dates import quarter_label, quarter_of_month
from perilscope.functions.numbers import argmax_label, round_even
from perilscope.operators import model, report, rules, schema
from perilscope.operators.cleaning import blank_to_null, fill_unknown, union_years
from perilscope.operators.crosstab import to_wide
from perilscope.operators.ranking import cause_share
from perilscope.operators.trend import expand_values, modal_profile, yoy_trend
from perilscope.session import materialise
from perilscope.sources.outputs import publish_outputs


def future_profile(
    df: DataFrame, area: str, quarters: Sequence, features: Sequence[str], quarter: str = "quarter"
) -> DataFrame:
    """The modal profile of each area once per coming quarter."""
    return expand_values(modal_profile(df, area, features), quarter, quarters)


def subcause_forecast(
    probs: DataFrame,
    df: DataFrame,
    area: str,
    theme: str,
    cause: str,
    trend: DataFrame | None = None,
    n: int = 3,
) -> DataFrame:
    """Split theme probabilities into those of the n leading causes of the area and theme.

    ``probs`` has (quarter, area, theme, prob). With a ``trend`` frame (area, theme, trend)
    the probability is weighted by it; without one the historical share is shown instead.
    Themes without rows in the area are left out.
    """
    shares = cause_share(df, [area, theme], cause, n).drop("n", "rank")
    out = probs.join(shares, [area, theme])
    keys = ["quarter", *cols_of([area, theme])]
    base = round_even(F.col("prob") * 100.0, 2).alias("base_prob")
    if trend is None:
        return out.select(
            *keys, base, col_of(cause).alias("sub_cause"),
            round_even(F.col("share") * 100.0, 2).alias("history_pct"),
            round_even(F.col("prob") * F.col("share") * 100.0, 2).alias("estimated_prob"),
        )
    out = out.join(trend, [area, theme], "left").withColumn("trend", F.coalesce("trend", F.lit(1.0)))
    return out.select(
        *keys, base, round_even("trend", 2).alias("trend"), col_of(cause).alias("sub_cause"),
        round_even(F.col("prob") * F.col("share") * F.col("trend") * 100.0, 2).alias(
            "estimated_prob"
        ),
    )


def theme_forecast(
    probs: DataFrame, area: str, theme: str, themes: Sequence[str], keep: Sequence[str] = ()
) -> DataFrame:
    """Wide: one probability column per theme, the top theme and its probability."""
    raw = {t: f"_p{i}" for i, t in enumerate(themes)}
    wide = to_wide(probs, ["quarter", area, *keep], theme, "prob", raw)
    return wide.select(
        "quarter", *cols_of([area, *keep]),
        *[round_even(F.col(c) * 100.0, 2).alias(f"prob_{t}") for t, c in raw.items()],
        argmax_label(raw).alias("top_theme"),
        round_even(F.greatest(*[F.col(c) for c in raw.values()]) * 100.0, 2).alias("top_prob"),
    )


def forecast_counts(forecast: DataFrame) -> DataFrame:
    return forecast.groupBy("quarter").agg(F.count("*").alias("n"))


@dataclass(frozen=True)
class ForecastPlan:
    """Names, rules and parameters of a forecast run."""

    area: str
    cause_word: str
    default_cause: str
    month_word: str
    themes: Mapping[str, Sequence[str]]
    default_theme: str
    factor_cases: Sequence[tuple[str, str, Sequence[str]]]
    factor_default: str
    surface: str
    features: Sequence[str]
    key: Sequence[str]
    years: tuple[int, int]
    second_year_renames: Mapping[str, str] = field(default_factory=dict)
    drop: Sequence[str] = ()
    quarters: Sequence[int] = (3, 4)
    trees: int = 200
    depth: int = 10
    seed: int = 42


@dataclass(frozen=True)
class ForecastResult:
    forecast: DataFrame
    themes: DataFrame
    cleaned: DataFrame
    accuracy: DataFrame
    importances: DataFrame
    report: DataFrame


def forecast_input(first: DataFrame, second: DataFrame, plan: ForecastPlan) -> tuple[DataFrame, str]:
    """Both years cleaned, in one table with year, quarter, theme and factor."""
    parts = {}
    for year, df in zip(plan.years, (first, second)):
        df = schema.drop_empty_columns(schema.drop_unnamed(df))
        if year == plan.years[1]:
            df = schema.drop_optional(schema.rename(df, plan.second_year_renames), *plan.drop)
        month = schema.find_column(df, plan.month_word)
        quarter = quarter_of_month(col_of(month).cast("string")) if month else F.lit(None).cast("int")
        parts[year] = df.withColumn("quarter", quarter)
    df = blank_to_null(union_years(parts), ("", "nan", "<NA>"))
    cause = schema.find_column(df, plan.cause_word, plan.default_cause)
    df = rules.first_contains(df, cause, plan.themes, plan.default_theme, label="campaign_theme")
    names = {"cause": cause, "surface": plan.surface}
    cases = [
        (label, names[side], words)
        for label, side, words in plan.factor_cases
        if names[side] in df.columns
    ]
    df = rules.priority_class(df, cases, plan.factor_default, "factor")
    wanted = [f for f in plan.features if f not in ("quarter", "factor")]
    return fill_unknown(df, list(dict.fromkeys([plan.area, *wanted]))), cause


def run_forecast(first: DataFrame, second: DataFrame, plan: ForecastPlan) -> ForecastResult:
    """Train on two years, evaluate, and forecast the coming quarters by area and cause.

    The columns that the model and the forecast read are computed once, since they pass
    over them many times; ``cleaned`` stays as lazy as it came.
    """
    cleaned, cause = forecast_input(first, second, plan)
    needed = [*plan.key, *plan.features, plan.area, cause, "campaign_theme", "year"]
    df = materialise(schema.select_existing(cleaned, dict.fromkeys(needed)))
    label = "campaign_theme"
    encoding = model.OrdinalEncoding.fit(df, plan.features)
    train, test = model.stratified_split(df, label, plan.key, 0.2, plan.seed)
    settings = dict(trees=plan.trees, depth=plan.depth, seed=plan.seed, encoding=encoding)
    fitted = model.fit_forest(train, plan.features, label, **settings)
    judged = materialise(
        model.predict_class(fitted, test).select(col_of(label), F.col("pred"))
    )
    final = model.fit_forest(df, plan.features, label, **settings)
    others = [f for f in plan.features if f not in ("quarter", plan.area)]
    profile = future_profile(df, plan.area, plan.quarters, others)
    probs = materialise(
        model.predict_long(final, profile, ["quarter", plan.area, "factor"]).withColumnRenamed(
            "theme", label
        )
    )
    trend = yoy_trend(df, plan.area, label, "year", "quarter", *plan.years)
    forecast = subcause_forecast(probs.drop("factor"), df, plan.area, label, cause, trend)
    themes = theme_forecast(probs, plan.area, label, final.classes, ["factor"])
    return ForecastResult(
        forecast=forecast.withColumn("quarter", quarter_label("quarter")),
        themes=themes.withColumn("quarter", quarter_label("quarter")),
        cleaned=cleaned,
        accuracy=model.accuracy(judged, label, "pred"),
        importances=model.importances(fitted, df),
        report=model.classification_report(judged, label, "pred"),
    )


def write_forecast(
    result: ForecastResult, base: str, run_id: str, fmt: str = "parquet"
) -> dict[str, str]:
    """Write what a report reads back: both forecasts, the importances and the accuracy."""
    frames = {
        "forecast": result.forecast,
        "theme_forecast": result.themes,
        "importances": result.importances,
        "accuracy": result.accuracy,
    }
    return publish_outputs(frames, base, run_id, fmt, skip_empty=("forecast", "theme_forecast"))


def forecast_kpis(forecast: DataFrame, area: str, theme: str, rising: float = 1.1) -> DataFrame:
    """One row: the theme with the largest summed probability, and the number of areas
    with a trend above ``rising``."""
    totals = forecast.groupBy(col_of(theme).alias("t")).agg(F.sum("estimated_prob").alias("p"))
    top = totals.agg(F.min_by("t", F.struct(-F.col("p"), F.col("t"))).alias("top_theme"))
    areas = report.distinct_if(forecast, area, F.col("trend") > rising, "rising_areas")
    return areas.withColumn("top_theme", top.scalar())
