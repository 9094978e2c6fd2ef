"""The risk summary of areas."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perilscope.columns import col_of, cols_of, rows_of
from perilscope.functions.numbers import (
    argmax_label,
    bin_right_closed,
    confidence,
    percent,
    ranked_labels,
    round_even,
    weighted_score,
)
from perilscope.functions.text import one_decimal, render
from perilscope.operators.joins import lookup
from perilscope.operators.ranking import top_causes_text

# Weights and bands of the risk score.
WEIGHTS = {"severity_pct": 0.5, "road_pct": 0.3, "speed_pct": 0.2}
BAND_EDGES = (0, 20, 30, 100)
BAND_LABELS = ("Low", "Medium", "High")

REASON_SAME = (
    "Risk band {band} (score {score}). Theme '{dominant}' is the most frequent one and, "
    "weighted by severity, '{recommended}' is also the most important one."
)
REASON_OTHER = (
    "Risk band {band} (score {score}). Theme '{dominant}' is the most frequent one, but, "
    "weighted by severity, '{recommended}' matters more."
)
INSIGHT = (
    "Risk: {band} ({score})\nDominant: {dominant}\nRecommended: {recommended}\n"
    "Supporting: {supporting}\nConfidence: {confidence}%"
)


def area_shares(
    df: DataFrame,
    area: str,
    theme: str,
    severity: str,
    severe: Sequence[str],
    themes: Mapping[str, str],
    score_digits: int | None = 2,
    n: str | None = None,
) -> DataFrame:
    """Per area: severe share, theme shares and theme scores (share times overall impact).

    Shares are rounded before they are multiplied, the impact is not. Each share has its own
    denominator: rows with a known theme, rows with a known severity, and for the impact
    rows with both. One pass over the data counts (area, theme, severity class); all else
    works on those counts. ``n`` names the column with the rows that a row stands for.
    """
    counts = df.groupBy(
        col_of(area).alias("_area"),
        col_of(theme).alias("_theme"),
        F.when(col_of(severity).isNotNull(), col_of(severity).isin(list(severe))).alias("_severe"),
    ).agg(rows_of(n).alias("n"))

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))

    known_theme, known_severity = F.col("_theme").isNotNull(), F.col("_severe").isNotNull()
    impact = counts.agg(
        F.struct(
            *[
                F.coalesce(
                    percent(
                        total((F.col("_theme") == t) & F.col("_severe")),
                        total((F.col("_theme") == t) & known_severity),
                        None,
                    ),
                    F.lit(0.0),
                ).alias(prefix)
                for t, prefix in themes.items()
            ]
        ).alias("impact")
    )
    sums = counts.groupBy("_area").agg(
        total(F.col("_area").isNotNull() & (known_theme | known_severity)).alias("_rows"),
        total(known_severity).alias("_severity_rows"),
        total(F.col("_severe")).alias("_severe_rows"),
        total(known_theme).alias("_theme_rows"),
        *[total(F.col("_theme") == t).alias(f"_{p}_rows") for t, p in themes.items()],
    )
    # filtered after the sums: a filter on the counts would be pushed into their scan, and
    # the shuffle of the counts could not serve the impacts as well
    sums = sums.where(F.col("_rows") > 0)
    shares = sums.select(
        F.col("_area").alias(area),
        percent("_severe_rows", "_severity_rows").alias("severity_pct"),
        *[percent(f"_{p}_rows", "_theme_rows").alias(f"{p}_pct") for p in themes.values()],
    )

    def score(prefix: str) -> Column:
        exact = F.col(f"{prefix}_pct") * F.col("_impact")[prefix]
        return exact if score_digits is None else round_even(exact, score_digits)

    # the overall impacts are one row of the same counts, read as a scalar
    return shares.withColumn("_impact", impact.scalar()).select(
        *cols_of(shares.columns), *[score(p).alias(f"{p}_score") for p in themes.values()]
    )


def area_summary(
    df: DataFrame,
    area: str,
    theme: str,
    severity: str,
    severe: Sequence[str],
    themes: Mapping[str, str],
    weights: Mapping[str, float] = WEIGHTS,
    band_edges: Sequence[float] = BAND_EDGES,
    band_labels: Sequence[str] = BAND_LABELS,
    products: Mapping[tuple[str, str], str] | None = None,
    default_product: str = "basic",
    texts: tuple[str, str, str] = (REASON_SAME, REASON_OTHER, INSIGHT),
    score_digits: int | None = 2,
    n: str | None = None,
) -> DataFrame:
    """One row per area: shares, scores, risk score and band, themes, texts, product.

    ``themes`` maps each theme to the prefix of its columns; their order breaks ties.
    ``weights`` names columns of the summary. An area without any theme keeps its row, with
    null scores and no recommendation. Texts may name ``{area} {band} {score} {dominant}
    {recommended} {supporting} {confidence}``.
    """
    shares = area_shares(df, area, theme, severity, severe, themes, score_digits, n)
    score = {t: f"{p}_score" for t, p in themes.items()}
    scored = shares.withColumns(
        {
            "risk_score": weighted_score(weights),
            "dominant_theme": argmax_label({t: f"{p}_pct" for t, p in themes.items()}),
            "_order": ranked_labels(score),
        }
    )
    named = scored.select(
        *cols_of([*shares.columns, "risk_score"]),
        bin_right_closed("risk_score", band_edges, band_labels).alias("priority_level"),
        "dominant_theme",
        F.get("_order", F.lit(0)).alias("recommended_campaign"),
        F.when(F.size("_order") > 1, F.concat_ws(" > ", F.slice("_order", 2, 2))).alias(
            "supporting_campaigns"
        ),
        confidence(score).alias("confidence"),
    )
    fields = {
        "area": area,
        "band": "priority_level",
        "score": one_decimal("risk_score"),
        "dominant": "dominant_theme",
        "recommended": "recommended_campaign",
        "supporting": "supporting_campaigns",
        "confidence": one_decimal("confidence"),
    }
    same, other, insight = texts
    agree = F.col("dominant_theme") == F.col("recommended_campaign")
    told = named.withColumns(
        {
            "reason": F.when(agree, render(same, fields)).otherwise(render(other, fields)),
            "insight": render(insight, fields),
        }
    )
    return lookup(
        told,
        ["recommended_campaign", "priority_level"],
        products or {},
        "insurance_recommendation",
        default_product,
    )


def sort_by_risk(summary: DataFrame, area: str) -> DataFrame:
    return summary.orderBy(F.desc_nulls_last("risk_score"), col_of(area))


def attach_detail(
    summary: DataFrame,
    df: DataFrame,
    area: str,
    theme: str,
    cause: str,
    n: int = 3,
    text: str = "{cause} ({n})",
    default: str = "-",
    count: str | None = None,
) -> DataFrame:
    """Add the leading causes of the recommended theme of each area as one text. ``count`` names
    the column of ``df`` with the rows that a row stands for."""
    detail = top_causes_text(df, [area, theme], cause, n, text, count=count).withColumnsRenamed(
        {theme: "recommended_campaign", "causes": "recommended_campaign_detail"}
    )
    joined = summary.join(detail, [area, "recommended_campaign"], "left")
    return joined.withColumn(
        "recommended_campaign_detail",
        F.coalesce("recommended_campaign_detail", F.lit(default)),
    ).select(*cols_of([*summary.columns, "recommended_campaign_detail"]))
