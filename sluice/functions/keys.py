"""Hashes, natural keys and external ids. MD5 everywhere: it is the key's fixed form, not a secret."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .contact import email_domain
from .dates import bucket
from .text import blank, normalize_address, normalize_company, normalize_string, normalize_vat, slug, slug48, trim

#: Audit fields that a content hash leaves out.
AUDIT = ("id", "created_at", "updated_at", "create_date", "write_date", "__last_update", "display_name")


def short_hash(*cs: Column) -> Column:
    """Six hex digits of the MD5 of the values joined by a bar, NULL as empty."""
    return F.substring(F.md5(F.concat_ws("|", *[blank(c) for c in cs])), 1, 6)


def values_hash(values: Column) -> Column:
    """MD5 of sorted values joined by a comma."""
    return F.md5(F.array_join(F.array_sort(values), ","))


def content_hash(columns: dict[str, Column], exclude=AUDIT) -> Column:
    """MD5 of `name:value` pairs in order of names, NULLs and audit fields left out."""
    return F.md5(F.concat_ws("|", *[F.when(c.isNotNull(), F.concat(F.lit(f"{k}:"), c.cast("string"))) for k, c in sorted(columns.items()) if k not in exclude]))


def _named(c: Column) -> Column:
    """NULL in the text of a last-resort key is the word None."""
    return F.coalesce(c.cast("string"), F.lit("None"))


def _set(c: Column) -> Column:
    return blank(c.cast("string")) != ""


def key_company(vat: Column, name: Column, street: Column, city: Column, state: Column, country: Column, phone: Column, email: Column) -> Column:
    """VAT, else name and address, else name and contact, else all fields."""
    none = F.lit(None).cast("string")
    return F.md5(
        F.when(normalize_vat(vat) != "", F.concat(F.lit("vat:"), normalize_vat(vat)))
        .when(_set(name) & (_set(street) | _set(city)), F.concat(F.lit("name_addr:"), normalize_company(name), F.lit("|"), normalize_address(street, none, city, state, country, none)))
        .when(_set(name) & (_set(phone) | _set(email)), F.concat(F.lit("name_contact:"), normalize_company(name), F.lit("|"), F.when(_set(phone), phone).otherwise(email_domain(email))))
        .otherwise(F.concat_ws("|", *map(_named, (name, street, city, phone, email))))
    )


def key_contact(parent: Column, name: Column, email: Column, phone: Column) -> Column:
    contact = F.when(_set(email), email).when(_set(phone), phone).otherwise("")
    return F.md5(F.concat(F.lit("contact:"), _named(parent), F.lit("|"), normalize_string(name), F.lit("|"), contact))


def key_lead(external: Column, partner: Column, name: Column, email: Column, created: Column) -> Column:
    week = F.date_format(bucket(created), "yyyy-MM-dd")
    has = _set(name) & created.isNotNull()
    return F.md5(
        F.when(_set(external), F.concat(F.lit("ext_id:"), external))
        .when(partner.isNotNull() & (partner.cast("string") != "0") & has, F.concat(F.lit("partner_name_date:"), partner.cast("string"), F.lit("|"), normalize_string(name), F.lit("|"), week))
        .when(_set(email) & has, F.concat(F.lit("email_name_date:"), F.lower(trim(email)), F.lit("|"), normalize_string(name), F.lit("|"), week))
        .otherwise(F.concat_ws("|", _named(partner), _named(name), _named(email), _named(F.date_format(created, "yyyy-MM-dd"))))
    )


def key_vocab(name: Column, company: Column) -> Column:
    return F.md5(F.concat(F.lit("vocab:"), normalize_string(name), F.lit("|"), F.coalesce(F.nullif(company.cast("string"), F.lit("0")), F.lit("global"))))


# External ids: the first key that is there, else a hash.


def _id(prefix: str, *steps: tuple[Column, Column], unknown: Column) -> Column:
    out = None
    for condition, value in steps:
        out = out.when(condition, value) if out is not None else F.when(condition, value)
    return F.concat(F.lit(prefix), out.otherwise(unknown) if out is not None else unknown)


def _unknown() -> Column:
    return short_hash(F.lit("unknown"))


def partner_id(name: Column, email: Column, phone: Column, address: Column) -> Column:
    return _id("partner_", (_set(email), slug48(email)), (_set(phone), slug48(phone)), (_set(name) & _set(address), F.concat_ws("_", slug48(name), short_hash(address))), (_set(name), slug48(name)), unknown=short_hash(F.lit("unknown"), F.lit(""), F.lit("")))


def lead_id(name: Column, email: Column, phone: Column) -> Column:
    return _id("lead_", (_set(email), slug48(email)), (_set(phone), slug48(phone)), (_set(name), slug48(name)), unknown=short_hash(F.lit("unknown"), F.lit(""), F.lit("")))


def product_id(name: Column, code: Column) -> Column:
    return _id("product_", (_set(code), slug48(code)), (_set(name), slug48(name)), unknown=_unknown())


def order_id(number: Column, prefix: str = "so_") -> Column:
    """Orders `so_` and invoices `inv_`."""
    return _id(prefix, (_set(number), slug48(number)), unknown=_unknown())


def line_id(number: Column, index: Column, prefix: str = "sol_") -> Column:
    """Order lines `sol_` and invoice lines `invl_`."""
    return F.concat_ws("_", order_id(number, prefix), index.cast("string"))


def project_id(name: Column, code: Column) -> Column:
    return _id("project_", (_set(code), slug48(code)), (_set(name), slug48(name)), unknown=_unknown())


def task_id(project: Column, name: Column, index: Column) -> Column:
    return _id("task_", (_set(project) & _set(name), F.concat_ws("_", slug48(project), slug48(name))), (_set(project) & index.isNotNull(), F.concat_ws("_", slug48(project), index.cast("string"))), (_set(name), slug48(name)), unknown=_unknown())


def vehicle_id(vin: Column, plate: Column) -> Column:
    return _id("veh_", (_set(vin), slug48(vin)), (_set(plate), slug48(plate)), unknown=_unknown())


def generic_id(model: str, *values: Column) -> Column:
    """Model and all slugs; beyond 64 characters the first slug and a hash."""
    prefix = re.sub(r"[^a-z0-9]+", "_", model.lower()).strip("_")
    slugs = [F.when(_set(v), slug48(v)) for v in values]
    whole = F.concat_ws("_", F.lit(prefix), *slugs)
    some = F.greatest(*[_set(v).cast("int") for v in values], F.lit(0)) == 1
    return F.when(~some, F.concat_ws("_", F.lit(prefix), _unknown())).when(F.length(whole) > 64, F.concat_ws("_", F.lit(prefix), F.coalesce(*slugs), short_hash(*values))).otherwise(whole)


def render_id(template: str, row: dict[str, Column]) -> Column:
    """An id from a template: `{slug(a) or slug(b)}`, `{concat(a, b)}` and text; 60 characters at most."""
    parts: list[Column] = []
    for text, inner in re.findall(r"([^{}]+)|\{([^{}]*)\}", template):
        if text:
            parts.append(F.lit(text))
            continue
        options = []
        for option in re.split(r"\s+or\s+", inner.strip()):
            fn, args = re.fullmatch(r"(\w+)\(([^)]*)\)", option.strip()).groups()
            cs = [row.get(a.strip(), F.lit(None).cast("string")) for a in args.split(",")]
            options.append(F.nullif(slug(cs[0]) if fn == "slug" else F.concat_ws("_", *[F.nullif(c, F.lit("")) for c in cs]), F.lit("")))
        parts.append(F.coalesce(*options, F.lit("")))
    return F.substring(F.concat(*parts), 1, 60)
