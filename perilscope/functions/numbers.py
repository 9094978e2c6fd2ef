"""Rounding, bins, ratios and comparisons across the columns of one row."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from perilscope.columns import ColumnLike, col_of


def round_even(value: ColumnLike, digits: int) -> Column:
    """Round half to even on the scaled value (``round`` of Spark rounds half up)."""
    scale = F.lit(float(10**digits))
    return F.rint(col_of(value) * scale) / scale


def clip(value: ColumnLike, low: float, high: float) -> Column:
    """Limit to ``[low, high]``; null stays null."""
    v = col_of(value)
    return F.when(v < low, F.lit(float(low))).when(v > high, F.lit(float(high))).otherwise(v)


def safe_ratio(numerator: ColumnLike, denominator: ColumnLike) -> Column:
    """The quotient where the denominator is positive, else null."""
    d = col_of(denominator)
    return F.when(d > 0, col_of(numerator) / d)


def percent(part: ColumnLike, total: ColumnLike, digits: int | None = 1) -> Column:
    """``part / total * 100``, null without a total, rounded unless ``digits`` is None."""
    share = safe_ratio(part, total) * F.lit(100.0)
    return share if digits is None else round_even(share, digits)


def bin_right_closed(
    value: ColumnLike,
    edges: Sequence[float],
    labels: Sequence[str],
    include_lowest: bool = False,
) -> Column:
    """Label of the interval ``(edges[i], edges[i+1]]`` the value lies in, else null."""
    if len(edges) != len(labels) + 1:
        raise ValueError("one more edge than labels is needed")
    v = col_of(value)
    out = None
    for i, label in enumerate(labels):
        above = v >= edges[i] if include_lowest and i == 0 else v > edges[i]
        inside = above & (v <= edges[i + 1])
        out = F.when(inside, label) if out is None else out.when(inside, label)
    return out


def weighted_score(weights: Mapping[str, float], digits: int = 2) -> Column:
    """Sum of the named columns times their weights; null if one of them is null."""
    terms = [col_of(name) * F.lit(float(w)) for name, w in weights.items()]
    return round_even(reduce(lambda a, b: a + b, terms), digits)


def _scored(columns: Mapping[str, ColumnLike]) -> Column:
    """Non-null (value, -position, label) entries; their order ranks the columns."""
    entries = []
    for position, (label, column) in enumerate(columns.items()):
        v = col_of(column)
        entry = F.struct(
            v.cast("double").alias("value"),
            F.lit(-position).alias("place"),
            F.lit(label).alias("label"),
        )
        entries.append(F.when(v.isNotNull() & ~F.isnan(v), entry))
    return F.array_compact(F.array(*entries))


def argmax_label(columns: Mapping[str, ColumnLike]) -> Column:
    """Label of the largest column; the first one wins ties; null if all are null."""
    return F.array_max(_scored(columns))["label"]


def ranked(columns: Mapping[str, ColumnLike]) -> Column:
    """Array of (value, place, label), largest first, ties in the given order."""
    return F.sort_array(_scored(columns), asc=False)


def ranked_labels(columns: Mapping[str, ColumnLike]) -> Column:
    return F.transform(ranked(columns), lambda e: e["label"])


def confidence(columns: Mapping[str, ColumnLike], digits: int = 1) -> Column:
    """Share of the best value in the sum of the best two, in percent."""
    order = ranked(columns)
    first, second = F.get(order, F.lit(0))["value"], F.get(order, F.lit(1))["value"]
    return percent(first, first + second, digits)
