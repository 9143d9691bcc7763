"""Scalar cases: what goes in, what comes out, and that a second pass changes nothing."""

import datetime

import pytest
from pyspark.sql import functions as F

from sluice.functions import contact, dates, keys, numbers, text
from sluice.operators import matching, reshape


def values(spark, fn, items):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(items)], "i int, x string")
    return [r[0] for r in rows.select("i", fn(F.col("x")).alias("y")).orderBy("i").select("y").collect()]


def test_phone_us(spark):
    same = ["5551234567", "(555) 123-4567", "555-123-4567", "555.123.4567", "+1 (555) 123-4567"]
    assert values(spark, contact.phone_us, [*same, "123", "1" * 17, None, ""]) == ["15551234567"] * 5 + [None] * 4


def test_email_rfc(spark):
    cases = {"USER@EXAMPLE.COM": "user@example.com", "user+tag@example.com": "user+tag@example.com", "user.name@example.co.uk": "user.name@example.co.uk", "not-an-email": None, "@example.com": None, "user@": None}
    assert values(spark, contact.email_rfc, list(cases)) == list(cases.values())


def test_dates(spark):
    jan = datetime.date(2024, 1, 15)
    cases = ["01/15/2024", "15/01/2024", "Jan 15, 2024", "15 January 2024", "20240115", "2024-01-15"]
    assert values(spark, dates.normalize_any, cases) == [jan] * 6
    assert values(spark, dates.normalize_any, ["31/12/2024", "44927", "13/32/2024", "2024-02-30", None]) == [datetime.date(2024, 12, 31), datetime.date(2023, 1, 1), None, None, None]


def test_booleans(spark):
    assert values(spark, numbers.bool_text, ["yes", "Y", "TRUE", "t", "1"]) == ["true"] * 5
    assert values(spark, numbers.bool_text, ["no", "N", "False", "f", "0"]) == ["false"] * 5
    assert values(spark, numbers.bool_text, ["maybe", "123", None]) == [None] * 3


def test_slug(spark):
    cases = {"Hello World": "hello_world", "José's Email": "jose_s_email", "Product #123": "product_123", None: "", "123": "123", "  ": ""}
    assert values(spark, text.slug, list(cases)) == list(cases.values())
    assert values(spark, text.slug, ["a" * 63 + " b"]) == ["a" * 63]


def test_title_case(spark):
    cases = ["o'neil mc-donald", "ÉCOLE élan", "3rd place", "", None]
    assert values(spark, text.title_case, cases) == [None if c is None else c.title() for c in cases]


def test_render_id(spark):
    row = spark.createDataFrame([("", "Jane Doe")], "email string, name string")
    out = row.select(keys.render_id("partner_{slug(email) or slug(name)}", {"email": F.col("email"), "name": F.col("name")}), keys.render_id("p_{slug(other)}", {})).first()
    assert tuple(out) == ("partner_jane_doe", "p_")


@pytest.mark.parametrize("fn", [text.trim, text.collapse_spaces, text.normalize_string, text.slug, contact.phone_us, contact.email_rfc, numbers.bool_text, text.normalize_vat, numbers.clean_numeric])
def test_twice_is_once(spark, fn):
    cases = ["  A  b\tc ", "José's", "(555) 123-4567", " USER@Example.com", "Yes", "US 12-3.4", "", None, "$1,234.50"]
    once = values(spark, fn, cases)
    assert values(spark, fn, once) == once


def test_names_are_cleaned_and_made_unique():
    assert reshape.clean_names(["Amount (USD)", "Amount", "Na?me*", "...", " a   b #"]) == ["Amount", "Amount_2", "Name", "Unnamed", "a b"]


def test_unknown_transform_is_an_error(spark):
    with pytest.raises(KeyError):
        reshape.transform_chain(F.lit("a"), ["no_such_transform"])


def test_trim_takes_white_space_of_any_kind(spark):
    row = spark.createDataFrame([("\u00a0\u2003 a\u2003\u00a0 b\u00a0",)], "t string").select(text.trim(F.col("t")).alias("x"), text.collapse_spaces(F.col("t")).alias("y")).first()
    assert (row.x, row.y) == ("a\u2003\u00a0 b", "a b")


def test_html_references(spark):
    cases = {"&#8364;5": "€5", "&#x20AC;&#X41;": "€A", "&#128512;": "😀", "&#0;&#xD800;&#1114112;": "\ufffd\ufffd\ufffd", "&amp;#65; &amp;lt;": "&#65; &lt;", "a & b &#; &x;": "a & b &#; &x;", "": "", None: None}
    assert values(spark, text.html_unescape, list(cases)) == list(cases.values())


def test_closed_html_references(spark):
    cases = {"and&amp</title>&am</p>&": "and&amp</title>&am</p>&", "&copy 5 &notit; &ampamp; &#65 &#x41 &;": "&copy 5 &notit; &ampamp; &#65 &#x41 &;", "&amp;amp;&amp&#38;lt;&lt": "&amp;&amp&lt;&lt", "&notin;&frac12;&#65;&#X20aC;&#0;": "∉½A€\ufffd", "&#" + "9" * 5000 + ";": "&#" + "9" * 5000 + ";", None: None}
    assert values(spark, lambda x: text.html_unescape(x, closed=True), list(cases)) == list(cases.values())


def test_a_failing_user_function_changes_nothing(spark):
    assert values(spark, lambda c: reshape.remap_function(c, lambda x: str(10 // int(x)) if x != "9" else None), ["5", "0", "x", "9", None]) == ["2", "0", "x", "9", None]


def test_best_match_and_tiers(spark):
    kb = spark.createDataFrame([("sale", "order_date", "Date of order"), ("sale", "amount", "Total"), ("base", "zip", "Post code")], "model string, field string, label string")
    cols = spark.createDataFrame(list(enumerate(["Order Date", "the order date", "date sent", "Post Code", "sale amount", "my mail x", "mail", "none", "", None])), "col_id int, header string")
    known = spark.createDataFrame([("Mail", "base", "email"), ("", "base", "nothing")], "pattern string, model string, field string")
    best = {r.col_id: (r.field, r.confidence) for r in matching.best_match(cols, kb).collect()}
    assert best == {0: ("order_date", 1.0), 1: ("order_date", 0.8), 2: ("order_date", 0.5), 4: ("amount", 0.8)}
    tiers = {r.col_id: (r.field, r.confidence, r.method) for r in matching.hybrid(cols, kb, known).collect()}
    assert tiers == {0: ("order_date", 1.0, "field_name"), 3: ("zip", 0.95, "label"), 4: ("amount", 0.9, "compound"), 5: ("email", 0.9, "substring"), 6: ("email", 1.0, "pattern")}
