"""Text similarity by the longest common subsequence (LCS), in native expressions.

The LCS is counted with bit vectors: one bit per character of the second text, in words of
60 bits so that additions never overflow under ANSI rules, one step per character of the
first text (Hyyrö 2004, "Bit-parallel LCS-length computation revisited").
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from perilscope.columns import ColumnLike, bind, col_of

WORD = 60
FULL = (1 << WORD) - 1


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda ch: ch != "")


def _words(length: Column) -> Column:
    return F.ceil(length / F.lit(WORD)).cast("int")


def char_masks(text: ColumnLike) -> Column:
    """Map from each character to the bit words of its places."""

    def word(chars: Column, ch: Column, k: Column) -> Column:
        start = F.struct(F.lit(0).cast("bigint").alias("m"), F.lit(1).cast("bigint").alias("bit"))
        return F.aggregate(
            F.slice(chars, k * WORD + 1, F.lit(WORD)),
            start,
            lambda s, x: F.struct(
                F.when(x == ch, s["m"].bitwiseOR(s["bit"])).otherwise(s["m"]).alias("m"),
                F.shiftleft(s["bit"], 1).alias("bit"),
            ),
            lambda s: s["m"],
        )

    def masks(chars: Column) -> Column:
        word_ids = F.sequence(F.lit(0), _words(F.size(chars)) - 1)
        return F.map_from_entries(
            F.transform(
                F.array_distinct(chars),
                lambda ch: F.struct(ch, F.transform(word_ids, lambda k: word(chars, ch, k))),
            )
        )

    return bind(_chars(col_of(text)), masks)


def mask_entry(text: str) -> dict:
    """``char_masks`` and length of a constant, computed while planning, for ``constant``."""
    words = max(1, math.ceil(len(text) / WORD))
    masks: dict[str, list[int]] = {}
    for place, ch in enumerate(text):
        masks.setdefault(ch, [0] * words)[place // WORD] |= 1 << (place % WORD)
    return {"length": len(text), "masks": masks}


MASK_FIELDS = "length: int, masks: map<string, array<bigint>>"


def lcs_from_masks(text: Column, masks: Column, length: Column) -> Column:
    """LCS length of ``text`` and the text of ``length`` characters behind ``masks``."""

    def advance(state: Column, mask: Column) -> Column:
        start = F.struct(
            F.array().cast("array<bigint>").alias("out"), F.lit(0).cast("bigint").alias("carry")
        )

        def one_word(s: Column, pair: Column) -> Column:
            v, m = pair["v"], pair["m"]
            total = v + v.bitwiseAND(m) + s["carry"]
            kept = total.bitwiseOR(v.bitwiseAND(F.bitwise_not(m)))
            return F.struct(
                F.array_append(s["out"], kept.bitwiseAND(F.lit(FULL))).alias("out"),
                F.shiftright(total, WORD).alias("carry"),
            )

        pairs = F.arrays_zip(state.alias("v"), mask.alias("m"))
        return F.aggregate(pairs, start, one_word, lambda s: s["out"])

    words = _words(length)
    final = F.aggregate(
        _chars(text),
        F.array_repeat(F.lit(FULL).cast("bigint"), words),
        lambda v, ch: F.coalesce(advance(v, F.element_at(masks, ch)), v),
    )
    ones = F.aggregate(final, F.lit(0), lambda n, v: n + F.bit_count(v))
    return words * WORD - ones


def ratio_from_masks(text: Column, masks: Column, length: Column) -> Column:
    both = F.length(text) + length
    return F.lit(200.0) * lcs_from_masks(text, masks, length) / both


def indel_ratio(a: ColumnLike, b: ColumnLike) -> Column:
    """``200 * LCS / (len(a) + len(b))``: 100 for equal texts, 0 for nothing in common."""
    left, right = col_of(a), col_of(b)
    ratio = bind(char_masks(right), lambda m: ratio_from_masks(left, m, F.length(right)))
    empty = F.when((F.length(left) == 0) & (F.length(right) == 0), F.lit(100.0)).otherwise(0.0)
    return F.when((F.length(left) > 0) & (F.length(right) > 0), ratio).when(
        left.isNotNull() & right.isNotNull(), empty
    )


def allowed_edits(total_length: Column, min_score: float) -> Column:
    """Insertions plus deletions that two texts of this total length may differ by."""
    return F.floor(total_length * F.lit((100.0 - min_score) / 100.0) + F.lit(1e-9)).cast("int")


def partial_ratio(a: ColumnLike, b: ColumnLike) -> Column:
    """Best ``indel_ratio`` of the shorter text with the windows of the longer one.

    Windows are as long as the shorter text, or shorter at both ends. For short texts: the
    work grows with the product of the lengths.
    """
    left, right = col_of(a), col_of(b)
    la, lb = F.length(left), F.length(right)

    def side(short: Column, long: Column) -> Column:
        return F.struct(short.alias("short"), long.alias("long"))

    def best(pair: Column) -> Column:
        short, long = pair["short"], pair["long"]
        n = F.length(short)

        def score(masks: Column) -> Column:
            def window(start: Column) -> Column:
                cut = F.substring(
                    long, F.greatest(start, F.lit(1)), n - F.greatest(F.lit(1) - start, F.lit(0))
                )
                return ratio_from_masks(cut, masks, n)

            return F.array_max(F.transform(F.sequence(F.lit(2) - n, F.length(long)), window))

        return bind(char_masks(short), score)

    # texts of equal length take both parts
    pairs = (
        F.when(la < lb, F.array(side(left, right)))
        .when(la > lb, F.array(side(right, left)))
        .otherwise(F.array(side(left, right), side(right, left)))
    )
    return (
        F.when((la > 0) & (lb > 0), F.array_max(F.transform(pairs, best)))
        .when((la == 0) & (lb == 0), F.lit(100.0))
        .when(left.isNotNull() & right.isNotNull(), F.lit(0.0))
    )


def _seed_pattern(word: str, edits: int) -> str:
    """Regular expression for the windows in which ``word`` can have at most ``edits`` edits.

    ``word`` is cut into ``edits + 1`` pieces. At least one of them stands unchanged in such
    a window, at most ``edits`` places from where it is expected.
    """
    count = min(edits + 1, len(word))
    bounds = [round(i * len(word) / count) for i in range(count + 1)]
    options = []
    for start, end in zip(bounds, bounds[1:]):
        low, high = max(0, start - edits), start + edits
        options.append(f".{{{low},{high}}}?{re.escape(word[start:end])}")
    return f"(?s)(?=((?:{'|'.join(options)}).{{0,{len(word)}}}))"


def word_entry(word: str, min_score: float) -> dict:
    """A constant word with what ``partial_ratio_to`` needs to find and score it."""
    edits = math.floor(2 * len(word) * (100.0 - min_score) / 100.0 + 1e-9)
    return {"word": word, "seeds": _seed_pattern(word, edits), **mask_entry(word)}


WORD_FIELDS = f"word: string, seeds: string, {MASK_FIELDS}"


def partial_ratio_to(text: ColumnLike, entry: Column) -> Column:
    """``partial_ratio`` with a constant ``word_entry``, exact from its ``min_score`` on, else lower.

    Windows that cannot reach ``min_score`` are never scored, so the work is linear in the
    length of a long text.
    """
    t = col_of(text)
    n = entry["length"]
    starts = F.regexp_extract_all(t, entry["seeds"], F.lit(1))
    inner = F.transform(starts, lambda w: F.substring(w, F.lit(1), n))
    heads = F.transform(F.sequence(F.lit(1), n), lambda k: F.substring(t, F.lit(1), k))
    windows = F.array_distinct(F.concat(inner, heads))
    long_text = F.array_max(
        F.transform(windows, lambda w: ratio_from_masks(w, entry["masks"], n))
    )
    return F.when(F.length(t) > n, long_text).otherwise(partial_ratio(t, entry["word"]))
