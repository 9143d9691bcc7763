"""Dates from text: a ladder of formats, the first that fits wins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import trim

ISO, ISO_SLASH, COMPACT = (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"), (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"), (r"^\d{8}$", "yyyyMMdd")
US, EU = [(r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"), (r"^\d{1,2}-\d{1,2}-\d{4}$", "M-d-yyyy")], [(r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"), (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy")]
NAMED = [(r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM yyyy"), (r"^\d{1,2} [A-Za-z]{3,} \d{4}$", "d MMMM yyyy"), (r"^[A-Za-z]{3} \d{1,2}, \d{4}$", "MMM d, yyyy"), (r"^[A-Za-z]{3,} \d{1,2}, \d{4}$", "MMMM d, yyyy")]
HINTS = {None: [ISO, ISO_SLASH, *US, *EU, COMPACT, *NAMED], "us": [*US, ISO, ISO_SLASH, *EU, COMPACT, *NAMED], "eu": [*EU, ISO, ISO_SLASH, *US, COMPACT, *NAMED], "iso": [ISO, ISO_SLASH, *US, *EU, COMPACT, *NAMED]}


#: One pattern for whatever some step of the ladder takes, to be asked before the ladder.
SHAPE = r"^\s*(?:" + "|".join(dict.fromkeys(pattern[1:-1] for pattern, _ in HINTS[None])) + r")\s*$"


def ladder(c: Column, hint: str | None = None) -> Column:
    t = trim(c)
    return F.coalesce(*[F.when(F.rlike(t, F.lit(pattern)), F.to_date(F.try_to_timestamp(t, F.lit(form)))) for pattern, form in HINTS[hint]])


def parse_date(c: Column, hint: str | None = None) -> Column:
    return ladder(c, hint)


def normalize_any(c: Column) -> Column:
    """The ladder, then Excel's day numbers between 1 and 100000, from 1899-12-30."""
    t = trim(c)
    serial = F.when(F.rlike(t, F.lit(r"^\d{1,6}(\.\d+)?$")), t.try_cast("double"))
    return F.coalesce(ladder(c), F.when((serial > 1) & (serial < 100000), F.date_add(F.lit("1899-12-30").cast("date"), F.floor(serial).cast("int"))))


def parse_format(c: Column, form: str) -> Column:
    """ISO text of a date in one format; the original where it fails."""
    return F.coalesce(F.date_format(F.try_to_timestamp(c, F.lit(form)), "yyyy-MM-dd"), c)


def reformat(c: Column, target: str) -> Column:
    return F.date_format(ladder(c), target)


def bucket(c: Column) -> Column:
    """Monday of the week."""
    return F.date_trunc("week", c).cast("date")


def clean(c: Column) -> Column:
    """ISO text, or the trimmed original."""
    return F.coalesce(F.date_format(ladder(c), "yyyy-MM-dd"), trim(c))
