"""Dates: French long forms, ISO guards, ordering of blanks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom import dims
from lexloom.functions.text import fold
from lexloom.runtime import map_lookup

# Day, month and year in French words; ISO and day-first numeric dates.
FRENCH_DATE = (r"(?iuU)\b(1er|\d{1,2})\s+(janv|f[ée]vr?|mars|avr|mai|juin|juil|ao[uû]t|sept|oct|nov|d[ée]c)"
               r"\w*\.?\s+(\d{4})\b")
ISO_DATE = r"\b(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})\b"
DAY_FIRST_DATE = r"\b(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})\b"


def plausible(date: Column) -> Column:
    """A date outside 1800–2099 counts as unknown."""
    return F.when(F.year(date).between(1800, 2099), date)


def clean_iso_date(col: Column | str) -> Column:
    """`YYYY-MM-DD…` text to a date; malformed or implausible values become NULL."""
    col = F.col(col) if isinstance(col, str) else col
    return plausible(F.try_to_date(F.regexp_extract(col, r"^(\d{4}-\d{2}-\d{2})", 1), "yyyy-MM-dd"))


def _ymd(year: Column, month: Column, day: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")


def month_number(word: Column) -> Column:
    """Month number of a French month word or abbreviation."""
    key = fold(word)
    return F.coalesce(
        map_lookup(dims.MONTH_ABBREVIATIONS, F.substring(key, 1, 4)),
        map_lookup(dims.MONTH_ABBREVIATIONS, F.substring(key, 1, 3)),
    )


def parse_fr_date(col: Column | str) -> Column:
    """First French long date in the text (`1er mars 2020`, `27 fév. 2024`)."""
    col = F.col(col) if isinstance(col, str) else col
    day = F.regexp_replace(F.lower(F.regexp_extract(col, FRENCH_DATE, 1)), "er", "")
    return _ymd(F.regexp_extract(col, FRENCH_DATE, 3), month_number(F.regexp_extract(col, FRENCH_DATE, 2)), day)


def parse_any_date(col: Column | str) -> Column:
    """ISO date, else day-first numeric date, else French long date."""
    col = F.col(col) if isinstance(col, str) else col
    iso = plausible(_ymd(*[F.regexp_extract(col, ISO_DATE, i) for i in (1, 2, 3)]))
    day_first = _ymd(*[F.regexp_extract(col, DAY_FIRST_DATE, i) for i in (3, 2, 1)])
    return F.coalesce(iso, day_first, parse_fr_date(col))


def parse_month_year(col: Column | str) -> Column:
    """`mars 2024` to the first day of that month."""
    col = F.col(col) if isinstance(col, str) else col
    pattern = r"(?iuU)\b(\p{L}{3,9})\.?\s+(\d{4})\b"
    return _ymd(F.regexp_extract(col, pattern, 2), month_number(F.regexp_extract(col, pattern, 1)), F.lit("1"))


def format_fr_date(col: Column | str) -> Column:
    """`2023-02-14` -> `14 février 2023`, `2023-02` -> `février 2023`; anything else is returned unchanged."""
    col = F.col(col) if isinstance(col, str) else col
    shape = r"^(\d{4})-(\d{2})(?:-(\d{1,2}))?$"
    month = F.regexp_extract(col, shape, 2).try_cast("int")
    day = F.regexp_extract(col, shape, 3).try_cast("int").cast("string")
    name = F.get(F.array(*[F.lit(m) for m in dims.MONTHS]), month - 1)
    text = F.concat_ws(" ", day, name, F.regexp_extract(col, shape, 1))
    return F.when(month.between(1, 12), text).otherwise(F.coalesce(col, F.lit("")))


def date_order(col: Column | str, direction: str = "desc") -> Column:
    """Date sort key that always puts unknown dates last."""
    col = F.col(col) if isinstance(col, str) else col
    return col.desc_nulls_last() if direction == "desc" else col.asc_nulls_last()
