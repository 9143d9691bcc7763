"""Phones, e-mails, countries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank, trim

#: Country calling codes of the regions that are told apart by rule.
CALLING = {"US": "1", "CA": "1", "GB": "44", "DE": "49", "FR": "33", "ES": "34", "IT": "39"}
EMAIL = r"^[a-z0-9._%+-]+@[a-z0-9](?:[a-z0-9-]*[a-z0-9])?(?:\.[a-z0-9](?:[a-z0-9-]*[a-z0-9])?)*\.[a-z]{2,}$"


def phone_us(c: Column) -> Column:
    """Digits of a US number with its 1; NULL if there are neither 10 nor 11 of them."""
    d = F.regexp_replace(c, r"[^0-9]", "")
    return F.when(F.length(d) == 10, F.concat(F.lit("1"), d)).when((F.length(d) == 11) & d.startswith("1"), d)


def phone_valid(c: Column, region: str = "US") -> Column:
    """E.164 by rule, or NULL: an extension goes, + keeps its country, else the region's code is put
    before. NANP numbers have ten digits after the 1, others 7 to 14."""
    t = F.regexp_replace(trim(c), r"(?i)\s*(?:x|ext\.?)\s*[0-9]+$", "")
    d = F.regexp_replace(t, r"[^0-9]", "")
    code = CALLING[region]
    full = F.when(t.startswith("+"), d).when((F.lit(code) == "1") & (F.length(d) == 11) & d.startswith("1"), d).otherwise(F.concat(F.lit(code), F.regexp_replace(d, "^0", "")))
    ok = F.when(full.startswith("1"), F.length(full) == 11).otherwise(F.length(full).between(8, 15))
    return F.when(ok, F.concat(F.lit("+"), full))


def phone_e164(c: Column, region: str = "US") -> Column:
    """E.164, or the original where that fails."""
    return F.coalesce(phone_valid(c, region), c)


def email_basic(c: Column) -> Column:
    """Trimmed, in lower case; empty text without an @ and for NULL."""
    t = F.lower(trim(blank(c)))
    return F.when(F.contains(t, F.lit("@")), t).otherwise("")


def email_ok(c: Column) -> Column:
    """One @, something before it, a dotted domain without an empty label."""
    return F.rlike(F.lower(trim(blank(c))), F.lit(r"^[^@\s]+@[^@\s.]+(?:\.[^@\s.]+)+$"))


def email_strict(c: Column) -> Column:
    return F.when(email_ok(c), F.lower(trim(c))).otherwise("")


def email_rfc(c: Column) -> Column:
    """The common part of the RFC syntax, else NULL."""
    t = F.lower(trim(c))
    return F.when(F.rlike(t, F.lit(EMAIL)) & ~F.contains(t, F.lit("..")), t)


def email_domain(c: Column) -> Column:
    """What lies between the first @ and the next; empty text without one."""
    return F.coalesce(F.lower(trim(F.get(F.split(c, "@"), F.lit(1)))), F.lit(""))
