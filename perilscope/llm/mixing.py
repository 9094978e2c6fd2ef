"""Mixing sources to target weights that change over the training run.

Each source has a target, the words the mix takes of it, and a schedule, its weight as a
piecewise linear function of training time 0 to 1. The schedule's integral, scaled to the
target, is the source's cumulative demand; the documents of a source stand in an order drawn
from their ids, pass after pass, and a document is read at the time at which the demand
reaches its first word. Documents are then sorted by that position, by ranges.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from fractions import Fraction
from itertools import pairwise
from math import ceil, log2

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from perilscope.llm.frames import WORDS, col_of, cols_of, materialise, same, text_or_empty

#: More sources than this are an error: a mix is configured per source.
MAX_SOURCES = 100_000
#: Rows of one source that are put in order by one task.
ROWS_PER_BUCKET = 5_000
FLAT = ((0.0, 1.0), (1.0, 1.0))
ADDED = ("size", "source_size", "target", "taken", "positions")
SEGMENTS = "array<struct<d0:double,t0:double,w0:double,slope:double>>"

Schedule = Sequence[tuple[float, float]]


def word_count(text: str) -> Column:
    """Words of a text, 0 for null."""
    return F.regexp_count(text_or_empty(text), F.lit(WORDS)).cast("bigint")


def targets(
    sizes: Sequence[int], weights: Sequence[float], share: float = 1.5, repeat: float = 2.0
) -> list[float]:
    """Words to take of each source: ``share`` of all words, split by weight.

    No target exceeds ``repeat`` times its source's size; what is above goes to the others by
    weight, until none is above. Exact up to the last rounding.
    """
    exact = [Fraction(w) for w in weights]
    caps = [Fraction(repeat) * s for s in sizes]
    capped: set[int] = set()
    while True:
        left = Fraction(share) * sum(sizes) - sum(caps[i] for i in capped)
        total = sum(w for i, w in enumerate(exact) if i not in capped)
        level = left / total if total else Fraction(0)
        above = {
            i for i in range(len(sizes)) if i not in capped and exact[i] * level > caps[i]
        }
        if not above:
            return [
                float(caps[i] if i in capped else exact[i] * level) for i in range(len(sizes))
            ]
        capped |= above


def demand(schedule: Schedule, target: float) -> list[dict]:
    """The cumulative demand of a schedule, as segments that start at demand ``d0``, time
    ``t0`` and rate ``w0`` and change their rate by ``slope``.

    Raises ValueError unless times rise from 0 to 1 and weights are not negative, with a
    positive integral.
    """
    times = [t for t, _ in schedule]
    if times[0] != 0 or times[-1] != 1 or any(a >= b for a, b in pairwise(times)):
        raise ValueError("the times of a schedule must rise from 0 to 1")
    if any(w < 0 for _, w in schedule):
        raise ValueError("a schedule must not have negative weights")
    whole = sum((b - a) * (v + w) / 2 for (a, v), (b, w) in pairwise(schedule))
    if whole <= 0:
        raise ValueError("a schedule needs a positive weight somewhere")
    scale, done, out = target / whole, 0.0, []
    for (a, v), (b, w) in pairwise(schedule):
        if v + w > 0:
            out.append(
                {"d0": done, "t0": a, "w0": v * scale, "slope": (w - v) * scale / (b - a)}
            )
        done += (b - a) * (v + w) / 2 * scale
    return out


def time_of(words: Column, segments: Column) -> Column:
    """When the cumulative demand reaches ``words``: the inverse of the integrated schedule."""
    at = F.element_at(F.filter(segments, lambda s: s["d0"] <= words), -1)
    need = words - at["d0"]
    root = F.sqrt(F.greatest(at["w0"] * at["w0"] + at["slope"] * need * 2.0, F.lit(0.0)))
    return F.least(
        at["t0"] + F.when(need > 0, need * 2.0 / (at["w0"] + root)).otherwise(0.0), F.lit(1.0)
    )


def assign(
    df: DataFrame,
    weights: Sequence[float],
    schedules: Sequence[Schedule] = (FLAT,),
    share: float = 1.5,
    repeat: float = 2.0,
    id: str = "doc_id",
    source: str = "source",
    text: str = "text",
    by_source: Mapping[str | None, float] | None = None,
    sized: str | None = None,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """``df`` with ``size``, ``source_size``, ``target``, ``taken`` and ``positions``.

    Sources in code point order, null last, take ``weights`` and ``schedules`` by turns;
    ``by_source`` gives single sources another weight. ``sized`` names a column that holds the
    words already. ``taken`` is the number of words the mix reads of a document, repeats
    counted: whole passes over the source and then documents in the source's order up to the
    target, so that each source's sum is its target, rounded; the document at the end of the
    last pass is read up to there. ``positions`` has a training time for each reading.

    No text, or a null one, has size 0 and is never taken. Null ids take part; rows that agree
    in id and size are interchangeable. Empty frames give empty frames. Existing columns of
    the added names are replaced.

    The order is that of a hash of the id. It is built from sums over ranges of the hash and a
    running sum within each range, so no task holds a source.
    """
    words = word_count(text) if sized is None else F.coalesce(col_of(sized), F.lit(0))
    keep = [c for c in df.columns if c.lower() not in ADDED]
    digest = F.md5(F.coalesce(col_of(id).cast("string"), F.lit("null")).cast("binary"))
    rows = df.withColumn("_size", words.cast("bigint")).select(
        *cols_of(keep),
        col_of("_size"),
        F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint").alias("_h"),
    )
    per_source = (
        rows.groupBy(col_of(source).alias("s"))
        .agg(F.sum("_size").alias("n"), F.count("*").alias("rows"))
        .limit(MAX_SOURCES + 1)
        .collect()
    )
    if len(per_source) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    # code points in order are UTF-8 bytes in order
    per_source.sort(key=lambda r: (r["s"] is None, str(r["s"]).encode("utf-8", "surrogatepass")))
    names = [r["s"] for r in per_source]
    sizes = [r["n"] for r in per_source]
    each = [
        (by_source or {}).get(s, weights[i % len(weights)]) for i, s in enumerate(names)
    ]
    goal = targets(sizes, each, share, repeat)
    plan = df.sparkSession.createDataFrame(
        pa.table(
            {
                "_source": pa.array(names, None if any(n is not None for n in names) else pa.string()),
                "_i": pa.array(range(len(names)), pa.int32()),
                "source_size": pa.array(sizes, pa.int64()),
                "target": pa.array(goal, pa.float64()),
                "_curve": pa.array(
                    [demand(schedules[i % len(schedules)], g) for i, g in enumerate(goal)],
                    pa.list_(
                        pa.struct([(k, pa.float64()) for k in ("d0", "t0", "w0", "slope")])
                    ),
                ),
            }
        )
    )
    total = sum(r["rows"] for r in per_source)
    bits = max(0, ceil(log2(max(total, 1) / rows_per_bucket)))
    tagged = (
        rows.join(F.broadcast(plan), same(col_of(source), col_of("_source")), "inner")
        .drop("_source")
        .withColumn("_bucket", F.shiftright(F.col("_h"), 60 - bits))
    )
    starts = (
        tagged.groupBy("_i", "_bucket")
        .agg(F.sum("_size").alias("_sum"))
        .withColumn(
            "_start",
            F.sum("_sum").over(W.partitionBy("_i").orderBy("_bucket")) - F.col("_sum"),
        )
        .drop("_sum")
    )
    within = W.partitionBy("_i", "_bucket").orderBy(
        F.col("_h"), col_of(id).asc_nulls_last(), F.col("_size")
    ).rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = tagged.join(starts, ["_i", "_bucket"]).withColumn(
        "_at", F.col("_start") + F.sum("_size").over(within) - F.col("_size")
    )
    budget = F.floor(F.col("target") + 0.5).cast("bigint")
    size, whole = F.col("_size"), F.col("source_size")
    passes = F.when(whole > 0, F.floor(budget / whole).cast("bigint")).otherwise(F.lit(0))
    last = F.greatest(F.least(budget - passes * whole - F.col("_at"), size), F.lit(0))
    taken = F.when(size > 0, passes * size + last).otherwise(F.lit(0)).cast("bigint")
    readings = F.when(size > 0, F.ceil(F.col("taken") / size)).otherwise(F.lit(0)).cast("int")
    reading = F.when(readings > 0, F.sequence(F.lit(0), readings - 1)).otherwise(
        F.array().cast("array<int>")
    )
    return placed.withColumn("taken", taken).select(
        *cols_of(keep),
        size.alias("size"),
        whole,
        F.col("target"),
        F.col("taken"),
        F.transform(
            reading,
            lambda k: time_of((F.col("_at") + k * whole).cast("double"), F.col("_curve")),
        ).alias("positions"),
    )


def curriculum(assigned: DataFrame, id: str = "doc_id") -> DataFrame:
    """One row for each reading, with its ``position``, in the order of training.

    Documents that the mix does not take are left out; a document read twice appears twice.
    The rows are range-partitioned by position and sorted within each range.
    """
    keep = [c for c in assigned.columns if c not in ADDED]
    read = assigned.select(*cols_of(keep), F.explode("positions").alias("position"))
    return read.orderBy(F.col("position"), col_of(id))


def sizes_only(df: DataFrame, id: str, source: str, text: str) -> DataFrame:
    """Id, source and words of each document, computed once: the texts are read a single time."""
    return materialise(df.select(*cols_of([id, source]), word_count(text).alias("words")))


__all__ = [
    "FLAT", "assign", "curriculum", "demand", "sizes_only", "targets", "time_of",
    "word_count",
]
