"""Month names, quarters and dates of another era."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from perilscope.columns import ColumnLike, col_of
from perilscope.functions.text import strip, western_digits

# Calendar order, and the spellings of each month in the input.
MONTHS = (
    "Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec",
)
MONTH_SPELLINGS = (
    ("ม.ค.", "มกราคม", "jan", "january", "1", "01", "1.0"),
    ("ก.พ.", "กุมภาพันธ์", "feb", "february", "2", "02", "2.0"),
    ("มี.ค.", "มีนาคม", "mar", "march", "3", "03", "3.0"),
    ("เม.ย.", "เมษายน", "apr", "april", "4", "04", "4.0"),
    ("พ.ค.", "พฤษภาคม", "may", "5", "05", "5.0"),
    ("มิ.ย.", "มิถุนายน", "jun", "june", "6", "06", "6.0"),
    ("ก.ค.", "กรกฎาคม", "jul", "july", "7", "07", "7.0", "07.0"),
    ("ส.ค.", "สิงหาคม", "aug", "august", "8", "08", "8.0"),
    ("ก.ย.", "กันยายน", "sep", "september", "9", "09", "9.0"),
    ("ต.ค.", "ตุลาคม", "oct", "october", "10", "10.0"),
    ("พ.ย.", "พฤศจิกายน", "nov", "november", "11", "11.0"),
    ("ธ.ค.", "ธันวาคม", "dec", "december", "12", "12.0"),
)
NO_MONTH = 999


def month_title(text: ColumnLike) -> Column:
    return F.initcap(strip(text))


def month_key(text: ColumnLike) -> Column:
    """Calendar position 0 to 11 by the first three letters, 999 for other text."""
    names = F.array(*[F.lit(m) for m in MONTHS])
    place = F.array_position(names, F.substring(month_title(text), 1, 3)).cast("int")
    return F.when(place > 0, place - 1).otherwise(F.lit(NO_MONTH))


def quarter_of_short_month(text: ColumnLike) -> Column:
    """Quarter of a three-letter English month; other spellings are null."""
    names = F.array(*[F.lit(m) for m in MONTHS])
    place = F.array_position(names, col_of(text))
    return F.when(place > 0, F.ceil(place / 3).cast("int"))


def quarter_of_month(
    text: ColumnLike, spellings: Sequence[Sequence[str]] = MONTH_SPELLINGS
) -> Column:
    """Quarter of a month written in any of the given spellings, case ignored."""
    bare = F.lower(strip(text))
    out = None
    for q in range(4):
        words = [w for names in spellings[3 * q : 3 * q + 3] for w in names]
        out = F.when(bare.isin(words), q + 1) if out is None else out.when(bare.isin(words), q + 1)
    return out


def quarter_label(quarter: ColumnLike) -> Column:
    return F.concat(F.lit("Q"), col_of(quarter).cast("string"))


def era_date(text: ColumnLike, offset: int = 543, century: int = 25) -> Column:
    """Date of a text like ``2568-01-31`` or ``31/1/2568``; a clock part is ignored.

    Years that begin with ``century`` are of the other era and lose ``offset``. Both field
    orders are tried per row; text that is no date gives null.
    """
    bare = F.regexp_replace(strip(western_digits(text)), r"\s+\d{2}:\d{2}:\d{2}.*", "")
    year_first = r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})$"
    day_first = r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})$"

    def built(pattern: str, y: int, m: int, d: int) -> Column:
        year = F.regexp_extract(bare, pattern, y).try_cast("int")
        own = F.when(F.floor(year / 100) == century, year - offset).otherwise(year)
        month = F.regexp_extract(bare, pattern, m).try_cast("int")
        day = F.regexp_extract(bare, pattern, d).try_cast("int")
        return F.try_to_date(F.format_string("%04d-%02d-%02d", own, month, day), "yyyy-MM-dd")

    return F.when(bare.rlike(year_first), built(year_first, 1, 2, 3)).when(
        bare.rlike(day_first), built(day_first, 3, 2, 1)
    )
