"""The incident pipeline: clean, derive, classify, summarise, recommend, write."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from perilscope.columns import col_of
from perilscope.functions.dates import quarter_of_short_month
from perilscope.functions.numbers import bin_right_closed
from perilscope.functions.text import clock_hour, day_period, duration_months, leading_year
from perilscope.operators import area as areas
from perilscope.operators import cleaning, joins, rules, schema
from perilscope.sources.outputs import publish_outputs


@dataclass(frozen=True)
class IncidentPlan:
    """Names, rule tables and parameters of an incident run."""

    area: str
    cause: str
    severity: str
    severe: Sequence[str]
    themes: Mapping[str, str]
    rules: rules.RuleTable
    optional: Sequence[str] = ()
    numbers: Sequence[str] = ()
    age: str | None = None
    time: str | None = None
    month: str | None = None
    rider_experience: str | None = None
    driver_experience: str | None = None
    date: str | None = None
    employee: str | None = None
    personal: Sequence[str] = ()
    renames: Mapping[str, str] = field(default_factory=dict)
    synonyms: Mapping[str, str] = field(default_factory=dict)
    stages: Sequence[str] = rules.STAGES
    min_score: float = 97
    units: Mapping[str, str] = field(default_factory=dict)
    experience_bins: tuple[Sequence[float], Sequence[str]] = ((-1, 3, 12, 24, 999),
                                                              ("<3m", "3-12m", "1-2y", ">2y"))
    age_bins: tuple[Sequence[float], Sequence[str]] = ((0, 20, 25, 30, 100),
                                                       ("<20", "20-25", "26-30", ">30"))
    weights: Mapping[str, float] = field(default_factory=lambda: dict(areas.WEIGHTS))
    bands: tuple[Sequence[float], Sequence[str]] = (areas.BAND_EDGES, areas.BAND_LABELS)
    area_products: Mapping[tuple[str, str], str] = field(default_factory=dict)
    default_area_product: str = "basic"
    row_products: Mapping[tuple[str, str], str] = field(default_factory=dict)
    default_row_product: str = "basic"
    texts: tuple[str, str, str] = (areas.REASON_SAME, areas.REASON_OTHER, areas.INSIGHT)
    cause_text: str = "{cause} ({n})"
    row_columns: Sequence[str] = ()


@dataclass(frozen=True)
class IncidentResult:
    rows: DataFrame
    raw_with_id: DataFrame
    area_summary: DataFrame
    unmapped: DataFrame
    joined: DataFrame | None
    column_report: DataFrame

    def frames(self, row_columns: Sequence[str]) -> dict[str, DataFrame | None]:
        return {
            "area_summary": self.area_summary,
            "rows": schema.select_existing(self.rows, row_columns or self.rows.columns),
            "unmapped": self.unmapped,
            "joined": self.joined,
        }


def clean(raw: DataFrame, plan: IncidentPlan) -> tuple[DataFrame, DataFrame]:
    """Resolved names, no empty or personal columns, no placeholder text, real numbers."""
    df = schema.drop_empty_columns(schema.drop_unnamed(raw))
    df, report = schema.resolve_columns(
        df, [plan.area, plan.cause, plan.severity], plan.optional, plan.renames
    )
    df = cleaning.blank_to_null(schema.drop_personal(df, plan.personal))
    df = cleaning.coerce_numeric(df, plan.numbers)
    return (cleaning.normalise_months(df, plan.month) if plan.month else df), report


def features(df: DataFrame, plan: IncidentPlan) -> DataFrame:
    """Experience in months and its group, age group, hour and period, year, quarter."""

    def has(name: str | None) -> bool:
        return name is not None and name in df.columns

    new = {}
    if has(plan.rider_experience):
        months = duration_months(plan.rider_experience, plan.units)
        new["rider_exp_month"] = months
        new["rider_exp_group"] = bin_right_closed(months, *plan.experience_bins)
    if has(plan.driver_experience):
        new["driver_exp_month"] = duration_months(plan.driver_experience, plan.units)
    if has(plan.age):
        new["age_group"] = bin_right_closed(plan.age, *plan.age_bins)
    if has(plan.time):
        new["hour"] = clock_hour(col_of(plan.time).cast("string"))
        new["period"] = day_period(new["hour"])
    if has(plan.date):
        new["year"] = leading_year(col_of(plan.date).cast("string"))
    if has(plan.month):
        new["quarter"] = quarter_of_short_month(plan.month)
    return df.withColumns(new) if new else df


def run_pipeline(
    raw: DataFrame, plan: IncidentPlan, master: DataFrame | None = None
) -> IncidentResult:
    """All frames of an incident run, none of them written yet."""
    cleaned, report = clean(raw, plan)
    named, _ = schema.resolve_columns(
        raw, [plan.area, plan.cause, plan.severity], plan.optional, plan.renames
    )
    rows = features(cleaned, plan)
    theme = "campaign_theme"
    # the area table needs nothing but counts; only the row-level output joins the rows
    counts, labelled = rules.classify_counts(
        rows, [plan.area, plan.severity], plan.cause, plan.rules, plan.synonyms, plan.stages,
        plan.min_score, theme,
    )
    unmapped = rules.unmapped_texts(labelled, plan.cause, theme)
    df = joins.lookup(
        rules.attach_by_text(rows, plan.cause, labelled, theme), [theme, plan.severity],
        plan.row_products, "insurance_recommendation", plan.default_row_product,
    )
    summary = areas.area_summary(
        counts, plan.area, theme, plan.severity, plan.severe, plan.themes, plan.weights,
        *plan.bands, products=plan.area_products, default_product=plan.default_area_product,
        texts=plan.texts, n="n",
    )
    summary = areas.sort_by_risk(
        areas.attach_detail(
            summary, counts, plan.area, theme, plan.cause, text=plan.cause_text, count="n"
        ),
        plan.area,
    )
    joined = None
    if master is not None and plan.employee is not None:
        joined = joins.join_master(named, master, plan.employee)
    return IncidentResult(df, named, summary, unmapped, joined, report)


def write_run(result: IncidentResult, plan: IncidentPlan, base: str, run_id: str, fmt: str = "parquet"):
    return publish_outputs(result.frames(plan.row_columns), base, run_id, fmt)
