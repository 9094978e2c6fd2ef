"""Text normalisation, duration and clock parsing, tokens, sort keys."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from perilscope.columns import ColumnLike, bind, col_of, constant

# Characters that count as white space, and the Thai decimal digits.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
THAI_DIGITS = "๐๑๒๓๔๕๖๗๘๙"


def strip(text: ColumnLike) -> Column:
    """Trim all white space, not only blanks."""
    return F.btrim(col_of(text), F.lit(WHITESPACE))


def western_digits(text: ColumnLike) -> Column:
    return F.translate(col_of(text), THAI_DIGITS, "0123456789")


def literal_map(table: Mapping[str, str]) -> Column:
    """A small lookup table as a constant of the plan."""
    return constant(dict(table), "map<string, string>")


def duration_months(
    text: ColumnLike, units: Mapping[str, str], allow_space: bool = False
) -> Column:
    """Months in a duration text: years * 12 + months + days / 30 + weeks / 4.

    ``units`` names the unit words for ``year month day week``. The digits must stand
    directly before the word unless ``allow_space``. Text without any unit gives 0.
    """
    source = western_digits(text)
    gap = r"\s*" if allow_space else ""

    def amount(unit: str) -> Column:
        found = F.regexp_extract(source, rf"(\d+){gap}\Q{units[unit]}\E", 1)
        return F.coalesce(found.try_cast("double"), F.lit(0.0))

    total = amount("year") * 12 + amount("month") + amount("day") / 30 + amount("week") / 4
    return F.when(col_of(text).isNotNull(), total)


def clock_hour(text: ColumnLike) -> Column:
    """Hour of the first ``h:mm`` or ``h.mm`` in the text."""
    return F.regexp_extract(western_digits(text), r"(\d{1,2})[:.](\d{1,2})", 1).try_cast("int")


def day_period(hour: ColumnLike) -> Column:
    h = col_of(hour)
    return (
        F.when(h < 6, "Late Night")
        .when(h < 12, "Morning")
        .when(h < 18, "Afternoon")
        .when(h.isNotNull(), "Night")
    )


def leading_year(text: ColumnLike) -> Column:
    """The first four characters as a number."""
    head = strip(F.substring(western_digits(text), 1, 4))
    return F.when(head.rlike(r"^\d+$"), head.try_cast("int"))


def tokens(text: ColumnLike) -> Column:
    """Parts between slashes, bracketed remarks removed; one part if nothing is left."""
    bare = F.regexp_replace(col_of(text), r"\(.*?\)", "")
    parts = F.filter(F.transform(F.split(bare, "/"), strip), lambda part: part != "")
    return bind(
        parts, lambda p: F.when(F.size(p) > 0, p).when(F.size(p) == 0, F.array(strip(bare)))
    )


def replace_synonym(text: ColumnLike, synonyms: Mapping[str, str] | None) -> Column:
    """The stripped text, replaced if the whole of it is a known synonym."""
    bare = strip(text)
    if not synonyms:
        return bare
    return F.coalesce(F.element_at(literal_map(synonyms), bare), bare)


def natural_key(text: ColumnLike) -> Column:
    """Sort key in which runs of digits, of any length, compare as numbers: each is written as
    the number of its digits, leading zeros left out, and the digits."""

    def part(piece: Column) -> Column:
        digits = F.ltrim(piece, F.lit("0"))
        size = F.lpad(F.length(digits).cast("string"), 10, "0")
        return F.when(piece.rlike(r"^\d"), F.concat(size, digits)).otherwise(piece)

    pieces = F.regexp_extract_all(western_digits(text), F.lit(r"\d+|\D+"), F.lit(0))
    return F.array_join(F.transform(pieces, part), "")


def render(template: str, fields: Mapping[str, ColumnLike], missing: str = "-") -> Column:
    """Fill ``{name}`` places of a text with columns; null shows as ``missing``."""
    parts, rest = [], template
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        if before:
            parts.append(F.lit(before))
        parts.append(F.coalesce(col_of(fields[name]).cast("string"), F.lit(missing)))
    if rest:
        parts.append(F.lit(rest))
    return F.concat(*parts)


def one_decimal(value: ColumnLike) -> Column:
    """The number with one decimal, rounded half to even before it is formatted."""
    v = col_of(value)
    return F.when(v.isNotNull(), F.format_string("%.1f", F.rint(v * 10.0) / 10.0))
