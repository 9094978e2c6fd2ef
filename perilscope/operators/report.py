"""Slices, counts, key figures and column statistics for reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perilscope.columns import col_of, cols_of, free_name, rows_of
from perilscope.functions.dates import month_key
from perilscope.functions.numbers import round_even
from perilscope.operators.joins import common_type, fits_broadcast


#: Longer lists are joined, so that the plan does not grow with them.
LIST_LIMIT = 1000


def slice_rows(df: DataFrame, filters: Mapping[str, Sequence | DataFrame | None]) -> DataFrame:
    """Rows whose columns are in the given lists; an empty or absent list does not filter.

    A list of more than ``LIST_LIMIT`` values, or a frame, whose first column is the list, is
    met by a semi join; the range of a list is a filter that reaches the scan. A frame filters
    even if it is empty.
    """
    for name, values in filters.items():
        if isinstance(values, DataFrame):
            df = _in_frame(df, name, values.select(col_of(values.columns[0]).alias("v")))
        elif values is not None and len(values) > LIST_LIMIT:
            known = sorted({v for v in values if v is not None})
            if known:
                df = df.where(col_of(name).between(known[0], known[-1]))
            listed = df.sparkSession.createDataFrame(pa.table({"v": pa.array(known)}))
            df = _in_frame(df, name, listed)
        elif values:
            df = df.where(col_of(name).isin(list(values)))
    return df


def _in_frame(df: DataFrame, name: str, listed: DataFrame) -> DataFrame:
    """Rows with a value of ``listed``: broadcast within a checked size, else shuffled, where
    null and frequent values do not matter to a semi join with distinct values."""
    kind = common_type(df.sparkSession, df.schema[name].dataType, listed.schema["v"].dataType)
    value = free_name("value", df.columns)
    given = listed.select(F.col("v").cast(kind).alias(value)).where(F.col(value).isNotNull()).distinct()
    given = F.broadcast(given) if fits_broadcast(given) else given
    return df.join(given, col_of(name).cast(kind) == F.col(value), "left_semi")


def value_counts(
    df: DataFrame, name: str, dropna: bool = True, top: int | None = None
) -> DataFrame:
    """(value, n), most frequent first, ties in value order."""
    rows = df.where(col_of(name).isNotNull()) if dropna else df
    counts = rows.groupBy(col_of(name)).agg(F.count("*").alias("n"))
    ordered = counts.orderBy(F.desc("n"), col_of(name).asc_nulls_last())
    return ordered if top is None else ordered.limit(top)


def counts_by_month(df: DataFrame, month: str) -> DataFrame:
    """(month, n) in calendar order."""
    return value_counts(df, month).orderBy(month_key(month), col_of(month))


def reindex(df: DataFrame, key: str, keys: Sequence) -> DataFrame:
    """The rows of the given keys, in that order; a key without a row has nulls."""
    places = F.explode(F.array(*[F.struct(F.lit(i).alias("place"), F.lit(k).alias(key))
                                 for i, k in enumerate(keys)]))
    frame = df.sparkSession.range(1).select(places.alias("e")).select("e.*")
    return frame.join(df, key, "left").orderBy("place").select(*cols_of(df.columns))


def kpis(
    df: DataFrame, areas: DataFrame, theme: str, high: str = "High", n: str | None = None
) -> DataFrame:
    """One row: reports, areas in the top band, mean score, mapped share, leading theme. ``n``
    names the column with the rows that a row of ``df`` stands for."""
    counts = df.groupBy(col_of(theme).alias("theme")).agg(rows_of(n).alias("n"))
    summary = areas.agg(
        F.count_if(col_of("priority_level") == high).alias("high_areas"),
        F.avg("risk_score").alias("mean_score"),
    )
    known = F.col("theme").isNotNull()
    return counts.agg(
        F.sum("n").alias("reports"),
        (F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0)) / F.sum("n") * F.lit(100.0)).alias(
            "mapped_pct"
        ),
        F.min_by("theme", F.when(known, F.struct(-F.col("n"), F.col("theme")))).alias("top_theme"),
    ).select(
        "reports",
        summary.select("high_areas").scalar().alias("high_areas"),
        round_even(summary.select("mean_score").scalar(), 1).alias("mean_score"),
        round_even("mapped_pct", 1).alias("mapped_pct"),
        "top_theme",
    )


def group_measure(df: DataFrame, keys: Sequence[str], measure: str, how: str = "sum") -> DataFrame:
    """(keys, value) with the sum or the mean of a column."""
    function = {"sum": F.sum, "mean": F.avg}[how]
    return df.groupBy(*cols_of(keys)).agg(function(col_of(measure)).alias("value"))


def group_top(
    df: DataFrame, keys: Sequence[str], measure: str, how: str = "sum", n: int = 1
) -> DataFrame:
    """The n groups with the largest sum or mean, ties in key order."""
    return (
        group_measure(df, keys, measure, how)
        .orderBy(F.desc("value"), *cols_of(keys))
        .limit(n)
    )


def distinct_if(df: DataFrame, name: str, condition: Column, alias: str = "n") -> DataFrame:
    """Number of distinct values among the rows that meet the condition."""
    return df.agg(F.count_distinct(F.when(condition, col_of(name))).alias(alias))


def rank_rows(
    df: DataFrame, by: Sequence[str | Column], ascending: Sequence[bool], n: int | None = None
) -> DataFrame:
    """Sort by several keys, each in its direction, nulls last; keep n rows if given."""
    keys = [
        col_of(b).asc_nulls_last() if up else col_of(b).desc_nulls_last()
        for b, up in zip(by, ascending)
    ]
    ordered = df.orderBy(*keys)
    return ordered if n is None else ordered.limit(n)


def exact_quantiles(
    df: DataFrame, numbers: Sequence[Column], counts: Sequence[int], shares: Sequence[float],
    few: int = 1_000_000, accuracy: int = 10_000,
) -> list[list[float] | None]:
    """For each number column its quantiles, interpolated between neighbours, exactly.

    Each share is looked for in a range of values, at first in all. While a range holds more
    than ``few`` values, one pass over ``df`` finds approximate bounds around each rank and
    another counts below and between them, for all columns and shares at once. At last the
    values within the ranges are counted and ranked; no task holds more than ``few``.
    """

    @dataclass
    class Range:
        column: int
        rank: int
        part: float
        below: int
        size: int
        lo: float | None = None
        hi: float | None = None

        def inside(self) -> Column:
            v = numbers[self.column]
            return v.isNotNull() if self.lo is None else v.between(F.lit(self.lo), F.lit(self.hi))

    wanted = [
        Range(i, int(p * (n - 1)), p * (n - 1) % 1, 0, n)
        for i, n in enumerate(counts) if n for p in shares
    ]

    def row(columns: Sequence[Column]) -> list:
        return list(df.agg(*[c.alias(f"a{i}") for i, c in enumerate(columns)]).first())

    margin = 2.0 / accuracy
    while wide := [r for r in wanted if r.size > few and (r.lo is None or r.lo != r.hi)]:
        around = []
        for r in wide:
            at = [(r.rank - r.below) / r.size - margin, (r.rank + 1 - r.below) / r.size + margin]
            ends = F.array(*[F.lit(min(max(x, 0.0), 1.0)) for x in at])
            v = F.when(r.inside(), numbers[r.column])
            around.append(F.percentile_approx(v, ends, F.lit(accuracy)))
        bounds = row(around)
        counted = []
        for r, (lo, hi) in zip(wide, bounds):
            v = numbers[r.column]
            counted += [F.count_if(r.inside() & (v < lo)), F.count_if(r.inside() & v.between(F.lit(lo), F.lit(hi)))]
        sizes = row(counted)
        narrowed = False
        for k, (r, (lo, hi)) in enumerate(zip(wide, bounds)):
            under, within = sizes[2 * k], sizes[2 * k + 1]
            if r.below + under <= r.rank and r.rank + bool(r.part) < r.below + under + within:
                narrowed |= within < r.size or lo == hi
                r.below, r.size, r.lo, r.hi = r.below + under, within, lo, hi
        margin *= 1.0 if narrowed else 4.0
    places = F.array(
        *[F.struct(F.lit(k).alias("k"), F.when(r.inside(), numbers[r.column]).alias("v"))
          for k, r in enumerate(wanted) if r.lo is None or r.lo != r.hi]
    )
    found: dict[int, dict[int, float]] = {}
    if any(r.lo is None or r.lo != r.hi for r in wanted):
        values = df.select(F.explode(places).alias("x")).select("x.*").where(F.col("v").isNotNull())
        upto = values.groupBy("k", "v").agg(F.count("*").alias("c")).withColumn(
            "upto", F.sum("c").over(Window.partitionBy("k").orderBy("v"))
        )
        ranks = F.create_map(
            *[F.lit(x) for k, r in enumerate(wanted) for x in (k, r.rank - r.below)]
        )
        rank, before = F.element_at(ranks, F.col("k")), F.col("upto") - F.col("c")
        hits = upto.withColumn("r", rank).select(
            "k", "v", ((before <= F.col("r")) & (F.col("r") < F.col("upto"))).alias("at"),
            ((before <= F.col("r") + 1) & (F.col("r") + 1 < F.col("upto"))).alias("next"),
        ).where("at or next")
        for h in hits.collect():
            for step, hit in ((0, h["at"]), (1, h["next"])):
                if hit:
                    found.setdefault(h["k"], {})[step] = h["v"]
    out: list[list[float] | None] = [None] * len(counts)
    for k, r in enumerate(wanted):
        lo = found[k][0] if k in found else r.lo
        hi = found[k].get(1, lo) if k in found else r.lo
        out[r.column] = [*(out[r.column] or []), lo + (hi - lo) * r.part]
    return out


DESCRIPTION = pa.schema(
    [("column", pa.string()), ("count", pa.int64())]
    + [(c, pa.float64()) for c in ("mean", "std", "min", "q1", "median", "q3", "max")]
)


def describe(df: DataFrame, names: Sequence[str], few: int = 1_000_000) -> DataFrame:
    """One row per numeric column: count, mean, std, min, quartiles, max.

    Quartiles by ``exact_quantiles``.
    """

    def number(name: str) -> Column:
        value = col_of(name).cast("double")
        return F.when(~F.isnan(value), value)

    names = list(names)
    measures = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    found = df.agg(
        *[m(number(c)).alias(f"{k}{i}") for i, c in enumerate(names) for k, m in measures.items()]
    ).first()
    counts = [found[f"count{i}"] for i in range(len(names))]
    quantiles = exact_quantiles(df, [number(c) for c in names], counts, (0.25, 0.5, 0.75), few)
    rows = [
        (c, *[found[f"{k}{i}"] for k in ("count", "mean", "std", "min")],
         *(quantiles[i] or [None] * 3), found[f"max{i}"])
        for i, c in enumerate(names)
    ]
    columns = [pa.array([r[k] for r in rows], f.type) for k, f in enumerate(DESCRIPTION)]
    return df.sparkSession.createDataFrame(pa.Table.from_arrays(columns, schema=DESCRIPTION))


def null_counts(df: DataFrame, top: int = 15) -> DataFrame:
    """(column, nulls) of the columns with the most nulls, from one aggregate."""
    counts = df.agg(*[F.count_if(col_of(c).isNull()).alias(c) for c in df.columns])
    return (
        counts.unpivot([], cols_of(counts.columns), "column", "nulls")
        .orderBy(F.desc("nulls"), "column")
        .limit(top)
    )
