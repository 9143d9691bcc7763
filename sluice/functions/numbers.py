"""Money, numbers, booleans, selections from text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank, trim

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
SYMBOLS = r"[$€£¥₹\s]"
TRUE, FALSE = ("yes", "true", "1", "y", "t"), ("no", "false", "0", "n", "f")


def to_double(c: Column) -> Column:
    """A double if the text is a plain number, else NULL."""
    return F.when(F.rlike(c, F.lit(NUMBER)), c.try_cast("double"))


def currency_to_float(c: Column, symbol: str = "$") -> Column:
    """0.0 for NULL, empty text and what isn't a number."""
    return F.coalesce(to_double(F.regexp_replace(c, rf"[{symbol},\s]", "")), F.lit(0.0))


def parse_decimal(c: Column, locale: str = "en") -> Column:
    t = F.regexp_replace(c, SYMBOLS, "")
    t = F.translate(F.replace(t, F.lit("."), F.lit("")), ",", ".") if locale in ("de", "fr", "es", "it") else F.replace(t, F.lit(","), F.lit(""))
    return F.when(F.rlike(t, F.lit(r"^[+-]?(\d+\.?\d*|\.\d+)$")), t.try_cast("decimal(38,6)"))


def clean_currency(c: Column) -> Column:
    """Decimal text with two places, else the text without symbols."""
    return F.coalesce(parse_decimal(c).cast("decimal(38,2)").cast("string"), F.regexp_replace(c, r"[$€£¥₹,\s]", ""))


def clean_numeric(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\d.-]", "")


def extract_numeric(c: Column) -> Column:
    return to_double(clean_numeric(c))


def numeric_convert(c: Column, scale: float = 1.0) -> Column:
    return to_double(F.regexp_replace(c, r"[$€£¥,\s]", "")) * F.lit(scale)


def round_even(c: Column, places: int = 0) -> Column:
    return F.bround(c, places)


def _is(c: Column, values) -> Column:
    return F.lower(trim(c)).isin(*values)


def parse_bool(c: Column, true=TRUE, false=FALSE) -> Column:
    return F.when(_is(c, true), True).when(_is(c, false), False)


def bool_text(c: Column) -> Column:
    """'true', 'false' or NULL."""
    return parse_bool(c).cast("string")


def normalize_bool(c: Column) -> Column:
    """'true', 'false' or the original."""
    return F.coalesce(bool_text(c), c)


def selection_map(c: Column, mapping: dict[str, str]) -> Column:
    """The value of the trimmed lower-case key; the original if there is none."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[F.lower(trim(c))], c)


def is_blank(c: Column) -> Column:
    return trim(blank(c)) == ""
