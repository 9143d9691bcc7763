"""Text functions over columns. NULL in gives NULL out unless a docstring says otherwise."""

from __future__ import annotations

import html
import re
from functools import reduce
from html.entities import html5

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Legal suffixes in the order they are stripped, and titles before names.
LEGAL_SUFFIXES = ("llc", "inc", "corp", "ltd", "limited", "corporation", "company", "co", "incorporated", "l l c", "l l p")
TITLES = ("Dr", "Mr", "Ms", "Mrs", "Prof", "Rev", "Sr", "Jr")
#: Abbreviations in headers.
ABBREVIATIONS = {"amt": "amount", "qty": "quantity", "desc": "description", "addr": "address", "tel": "telephone", "num": "number", "ref": "reference", "cust": "customer", "prod": "product"}
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"


def blank(c: Column) -> Column:
    """NULL as empty text."""
    return F.coalesce(c, F.lit(""))


def trim(c: Column) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse_spaces(c: Column) -> Column:
    return trim(F.regexp_replace(c, r"(?U)\s+", " "))


def title_case(c: Column) -> Column:
    """A capital after anything that isn't a letter, the rest in lower case."""
    runs = F.regexp_extract_all(F.lower(c), F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), r.substr(F.lit(2), F.length(r)))), "")


def strip_special(c: Column) -> Column:
    return F.regexp_replace(c, r"[^a-zA-Z0-9\s]", "")


def empty_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def default_if_empty(c: Column, default: str) -> Column:
    """The default for NULL and blank text."""
    return F.when(c.isNull() | (trim(c) == ""), F.lit(default)).otherwise(c)


def concat_present(*cs: Column, sep: str = " ") -> Column:
    """Joins what is neither NULL nor empty."""
    return F.concat_ws(sep, *[empty_to_null(c) for c in cs])


def extract(c: Column, pattern: str, group: int = 0) -> Column:
    """The first match; empty text if there is none or c is NULL."""
    return F.coalesce(F.regexp_extract(c, pattern, group), F.lit(""))


#: Fixed value: a name or a number with its semicolon; a number has as many digits as the last character's.
CLOSED_REFERENCE = re.compile(r"&(?:[A-Za-z][A-Za-z0-9]*|#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6});")


def _references(c: pd.Series) -> pd.Series:
    return c.map(html.unescape, na_action="ignore")


def _closed(found: re.Match) -> str:
    r = found[0]
    return html.unescape(r) if r[1] == "#" or r[1:] in html5 else r


def _closed_references(c: pd.Series) -> pd.Series:
    return c.map(lambda s: CLOSED_REFERENCE.sub(_closed, s), na_action="ignore")


def html_unescape(c: Column, closed: bool = False) -> Column:
    """Decodes character references of HTML 5 once: decimal, hexadecimal, and all names, the longest that
    fits, with or without semicolon where HTML lets it be left out. If closed, only whole names and numbers
    that end with a semicolon; what is cut short stays. Text without an ampersand isn't sent to the Arrow
    function."""
    asked = F.contains(c, F.lit("&"))
    decode = F.pandas_udf(_closed_references if closed else _references, "string")
    return F.when(asked, decode(F.when(asked, c))).otherwise(c)


def normalize_string(c: Column) -> Column:
    """Lower case without punctuation and with single spaces; NULL gives empty text."""
    return F.regexp_replace(F.regexp_replace(trim(F.lower(blank(c))), r"(?U)[^\w\s-]", ""), r"\s+", " ")


def normalize_company(c: Column) -> Column:
    """normalize_string without legal suffixes, each tried once in the listed order."""
    return reduce(lambda x, s: trim(F.regexp_replace(x, rf"\b{s}\.?$", "")), LEGAL_SUFFIXES, normalize_string(c))


def normalize_vat(c: Column) -> Column:
    return F.upper(F.regexp_replace(blank(c), r"[\s\-.]", ""))


def normalize_address(street: Column, street2: Column, city: Column, state: Column, country: Column, zip_code: Column) -> Column:
    """Parts that are there, normalized and joined by a bar."""
    parts = [F.when(blank(c) != "", normalize_string(c)) for c in (street, street2, city, state, country)]
    return F.concat_ws("|", *parts, F.when(blank(zip_code) != "", F.upper(F.regexp_replace(zip_code, r"\s", ""))))


def fold_accents(c: Column) -> Column:
    return F.translate(c, ACCENTED, PLAIN)


def slug(c: Column, most: int = 64) -> Column:
    """ASCII letters and digits in lower case, joined by _; NULL gives empty text."""
    s = F.regexp_replace(F.lower(F.regexp_replace(fold_accents(blank(c)), r"[^\x00-\x7F]", "")), r"[^a-z0-9]+", "_")
    s = F.regexp_replace(s, r"^_+|_+$", "")
    return F.regexp_replace(F.substring(s, 1, most), r"_+$", "")


def slug48(c: Column) -> Column:
    """Without accent folding, 48 characters at most, `x` if nothing is left."""
    s = F.regexp_replace(F.regexp_replace(F.lower(blank(c)), r"[^A-Za-z0-9]+", "_"), r"^_+|_+$", "")
    return F.coalesce(F.nullif(F.substring(s, 1, 48), F.lit("")), F.lit("x"))


def split_name(c: Column) -> tuple[Column, Column]:
    """(first word, the rest); NULL gives empty texts."""
    t = trim(blank(c))
    return F.regexp_extract(t, r"^(\S*)", 1), F.regexp_extract(t, r"^\S+\s+([\s\S]*)$", 1)


def strip_title(c: Column) -> Column:
    """Off goes one title that ends at a full stop, a space or the end."""
    return trim(F.regexp_replace(trim(c), rf"^(?:{'|'.join(TITLES)})(?:\.|\s|$)", ""))


def split_person(c: Column) -> tuple[Column, Column]:
    """`Last, First` or `First Last`, without a title, in title case."""
    t = trim(blank(c))
    comma = F.contains(t, F.lit(","))
    last = trim(F.substring_index(t, ",", 1))
    first = strip_title(F.regexp_extract(t, r"^[^,]*,([\s\S]*)$", 1))
    a, b = split_name(strip_title(t))
    return title_case(F.when(comma, first).otherwise(a)), title_case(F.when(comma, last).otherwise(b))


def person_name(c: Column) -> Column:
    first, last = split_person(c)
    return concat_present(first, last)


def technical_name(c: Column, prefix: str = "x_bt_") -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(c), r"(?U)[^\w]+", "_"), r"^_+|_+$", "")
    return F.concat(F.lit(prefix), F.regexp_replace(s, r"_+", "_"))


def field_label(c: Column) -> Column:
    return title_case(trim(c))


def normalize_header(c: Column) -> Column:
    """Lower case, separators as blanks, no parentheses, abbreviations spelled out by whole word."""
    s = trim(F.regexp_replace(F.translate(trim(F.lower(blank(c))), "_-.", "   "), r"\([^)]*\)", ""))
    return trim(reduce(lambda x, a: F.regexp_replace(x, rf"(^|\s){a[0]}(?=\s|$)", f"$1{a[1]}"), ABBREVIATIONS.items(), s))


def split_list(c: Column, delimiter: str = ";") -> Column:
    """Trimmed parts that aren't empty."""
    return F.filter(F.transform(F.split(c, rf"\Q{delimiter}\E"), trim), lambda x: x != "")


def external_id(c: Column, table: str) -> Column:
    return F.concat(F.lit(f"migr.{table}."), F.regexp_replace(c, r"[^a-zA-Z0-9_.-]", "_"))


def string_clean(c: Column, strip: bool = True, lower: bool = False, upper: bool = False) -> Column:
    c = trim(c) if strip else c
    c = F.lower(c) if lower else c
    return F.upper(c) if upper else c
