"""Column names: drop, rename, resolve, select. All of it happens while planning."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perilscope.columns import col_of, cols_of

REPORT_SCHEMA = pa.schema(
    [("target", pa.string()), ("status", pa.string()), ("source", pa.string()),
     ("score", pa.float64())]
)


def drop_unnamed(df: DataFrame, prefix: str = "Unnamed") -> DataFrame:
    return df.select(*cols_of(c for c in df.columns if not c.startswith(prefix)))


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Drop columns without any value, by one aggregate over all of them."""
    found = df.agg(
        *[F.max(col_of(c).isNotNull()).alias(f"n{i}") for i, c in enumerate(df.columns)]
    ).first()
    return df.select(*cols_of(c for i, c in enumerate(df.columns) if found[f"n{i}"]))


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename the columns that exist; names without a column are ignored."""
    return df.withColumnsRenamed({old: new for old, new in names.items() if old in df.columns})


def name_key(name: str) -> str:
    return re.sub(r"\s+", "", name)


def squash_names(df: DataFrame) -> DataFrame:
    """Replace runs of white space in names by one blank."""
    names = [re.sub(r"\s+", " ", c).strip() for c in df.columns]
    clashes = sorted({n for n in names if names.count(n) > 1})
    if clashes:
        raise ValueError(f"column names that become equal: {clashes}")
    return df.toDF(*names)


def plain_score(a: str, b: str) -> float:
    """``indel_ratio`` of two texts, for the driver."""
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, start=1):
            diagonal, row[j] = row[j], diagonal + 1 if x == y else max(row[j], row[j - 1])
    return 200.0 * row[-1] / (len(a) + len(b)) if a or b else 100.0


def part_score(a: str, b: str) -> float:
    """The best ``plain_score`` of the shorter text and a part of the longer one, of its length
    or cut off at an end."""
    short, long = sorted((a, b), key=len)
    cuts = {long[max(i, 0) : i + len(short)] for i in range(1 - len(short), len(long))}
    return max((plain_score(short, c) for c in cuts if c), default=0.0 if long else 100.0)


def words_score(a: str, b: str, part: bool = False) -> float:
    """Scores that disregard the order of words and, by sets, words that both have."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    score = part_score if part else plain_score
    both, left, right = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if part and both:
        return 100.0
    ordered = score(" ".join(sorted(a.split())), " ".join(sorted(b.split())))
    if part:
        return max(ordered, part_score(left, right))
    if both and not (left and right):
        return 100.0
    one, other = (f"{both} {s}".strip() for s in (left, right))
    shared = max(plain_score(both, one), plain_score(both, other)) if both else 0.0
    return max(ordered, plain_score(one, other), shared)


def name_score(a: str, b: str) -> float:
    """How alike two column names are, from 0 to 100: the plain ratio, or, at a discount, that of
    their words in any order, or of the shorter name and the best part of the longer one.

    Parts count from half as long again on, at 90 %, and at 60 % beyond eight times the length;
    words count at 95 % of that.
    """
    if not a or not b:
        return 0.0
    plain, apart = plain_score(a, b), max(len(a), len(b)) / min(len(a), len(b))
    if apart < 1.5:
        return max(plain, 0.95 * words_score(a, b))
    share = 0.9 if apart <= 8 else 0.6
    return max(plain, share * part_score(a, b), 0.95 * share * words_score(a, b, part=True))


def resolve_columns(
    df: DataFrame,
    required: Sequence[str],
    optional: Sequence[str] = (),
    renames: Mapping[str, str] | None = None,
    fuzzy_min: float = 80,
) -> tuple[DataFrame, DataFrame]:
    """Give columns their expected names; returns the frame and a report.

    A name matches exactly, else without regard to white space, else as the most similar
    one of the columns that no target has claimed, from ``fuzzy_min`` on. Each column
    serves one target. A missing required column is an error that names the best candidate.
    """
    df = squash_names(rename(df, renames or {}))
    targets = [*required, *optional]
    by_key = {name_key(c): c for c in reversed(df.columns)}
    found = {t: by_key[name_key(t)] for t in targets if name_key(t) in by_key}
    report = {
        t: ("exact" if source == t else "normalized", source, 100.0)
        for t, source in found.items()
    }
    free = [c for c in df.columns if c not in found.values()]
    for target in (t for t in targets if t not in found):
        scored = sorted(((name_score(target, c), -i, c) for i, c in enumerate(free)), reverse=True)
        best = scored[0] if scored else (0.0, 0, None)
        if best[2] is not None and best[0] >= fuzzy_min:
            found[target] = best[2]
            free.remove(best[2])
            report[target] = ("fuzzy", best[2], best[0])
        else:
            report[target] = ("NOT FOUND", best[2], best[0])
    missing = [t for t in required if t not in found]
    if missing:
        lines = [f"{t!r} (closest: {report[t][1]!r}, {report[t][2]:.0f}%)" for t in missing]
        raise ValueError("required columns not found: " + "; ".join(lines))
    renamed = df.withColumnsRenamed({s: t for t, s in found.items() if s != t})
    rows = [(t, *report[t]) for t in targets]
    table = pa.Table.from_arrays(
        [pa.array([r[i] for r in rows], type=REPORT_SCHEMA.field(i).type) for i in range(4)],
        schema=REPORT_SCHEMA,
    )
    return renamed, df.sparkSession.createDataFrame(table)


def drop_personal(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Drop the listed columns, white space in names ignored."""
    keys = {name_key(n) for n in names}
    return df.select(*cols_of(c for c in df.columns if name_key(c) not in keys))


def tag(df: DataFrame, name: str, value: object) -> DataFrame:
    """Add a constant column."""
    return df.withColumn(name, F.lit(value))


def drop_optional(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*[n for n in names if n in df.columns])


def select_existing(df: DataFrame, names: Iterable[str]) -> DataFrame:
    return df.select(*cols_of(n for n in names if n in df.columns))


def find_column(df: DataFrame, words: str | Sequence[str], default: str | None = None) -> str | None:
    """First column whose name contains one of the words."""
    wanted = [words] if isinstance(words, str) else list(words)
    return next((c for c in df.columns if any(w in c for w in wanted)), default)

