"""Schema matching, value analysis, pivots and the catalogue against plain Python."""

import difflib
import random
import re

import pytest
from pyspark.sql import functions as F

from sluice.functions import text
from sluice.operators import matching, schema, values
from sluice.plans import schema as plans
from tests.oracle import DATA


def test_sequence_ratio_is_that_of_matching_blocks(spark):
    rng = random.Random(3)
    make = lambda: "".join(rng.choice("abc dé") for _ in range(rng.choice((0, 1, 3, 8, 25))))
    pairs = [(make(), make()) for _ in range(500)] + [("due date", "date due"), ("same", "same"), ("", ""), (None, "x"), ("x", None)]
    for r in spark.createDataFrame(pairs, "a string, b string").select("a", "b", schema.sequence_ratio("a", "b").alias("s")).collect():
        want = None if r.a is None or r.b is None else difflib.SequenceMatcher(None, r.a, r.b, autojunk=False).ratio()
        assert r.s == (want if want is None else pytest.approx(want, abs=1e-12))


def plain(s):
    return re.sub(r"\s+", " ", re.sub(r"[^a-z0-9\s]", " ", s.lower())).strip()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def within(a, b):
    return min(len(a), len(b)) / max(len(a), len(b), 1) if a in b or b in a else None


def strategies(col, fields):
    """All candidates of one column as (model, field, confidence, strategy)."""
    out, header = [], plain(col.header)
    words = lambda s: set(plain(s.replace("_", " ")).split())
    labels, fuzzy = [], []
    for f in fields:
        add = lambda conf, name, f=f: out.append((f.model, f.field, round(conf, 6), name))
        h, label = header.replace(" ", "_"), plain(f.label)
        if h in (f.field, f.model.replace(".", "_") + "_" + f.field):
            add(1.0 if h == f.field else 0.95, "exact")
        if header == label or label.startswith(header):
            labels.append((header == label, 1.0 if header == label else within(header, label), f))
        both = set(col["values"]) & set(f.options)
        if col["values"] and len(both) / len(set(col["values"])) >= 0.5:
            add(0.7 * len(both) / len(col["values"]) + 0.3 * len(both) / len(f.options), "selection")
        if f.ttype in matching.COMPATIBLE[col.data_type]:
            add(schema.TYPE_SCORES.get((col.data_type, f.ttype), 0.6 if f.ttype in ("char", "text") else 0.5), "type")
        best = [r * (0.8 * (1.2 if f.ttype in schema.PATTERN_TYPES[p] else 1) if f.field in schema.PATTERN_FIELDS[p] else 0.6) for p in schema.PATTERN_FIELDS if (r := col[f"p_{p}"]) and r >= 0.7 and (f.field in schema.PATTERN_FIELDS[p] or f.ttype in schema.PATTERN_TYPES[p])]
        if best:
            add(max(best), "pattern")
        u = col.uniqueness
        stats = [0.7 * u] * (u >= 0.95 and f.field.startswith(schema.UNIQUE)) + [0.6 * (1 - u) * (1.2 if f.ttype == "selection" else 1)] * (u <= 0.1 and f.field.startswith(schema.FEW))
        stats += [0.55] * (col.data_type in ("integer", "float") and col["min"] is not None and 0 <= col["min"] <= 100 and 0 <= col["max"] <= 100 and f.field.startswith(schema.SHARES) and f.ttype in ("float", "integer"))
        if stats:
            add(max(stats), "statistics")
        a, b = (re.sub("[^a-z0-9]", "", s.lower()) for s in (col.header, f.field))
        s = 1.0 if a == b else within(a, b)
        s = jaccard(words(col.header), words(f.field)) if s is None else s
        if s >= 0.3:
            add(s * 0.85, "context")
        best = 0.0
        for other in (plain(f.field.replace("_", " ")), label):
            if header and other:
                best = max(best, 0.5 * difflib.SequenceMatcher(None, header, other, autojunk=False).ratio() + 0.3 * jaccard(set(header.split()), set(other.split())) + 0.2 * (within(header, other) or 0))
        if best >= 0.6:
            fuzzy.append((best, f))
    equal = [x for x in labels if x[0]]
    out += [(f.model, f.field, round(0.98 * s, 6), "label") for _, s, f in equal]
    if len(equal) < 5:
        near = sorted((x for x in labels if not x[0]), key=lambda x: (-x[1], x[2].model, x[2].field))[:10]
        out += [(f.model, f.field, round(0.85 * s, 6), "label") for _, s, f in near]
    out += [(f.model, f.field, round(0.85 * s, 6), "fuzzy") for s, f in sorted(fuzzy, key=lambda x: (-round(x[0], 9), x[1].model, x[1].field))[:10]]
    return out


@pytest.fixture(scope="module")
def matched(spark):
    cols = plans.columns(spark, DATA)
    asked = plans.asked_models(spark, DATA, cols).collect()
    return cols.collect(), plans.fields(spark).collect(), asked, plans.match_schema(spark, DATA).collect()


def test_match_schema_as_by_force(matched):
    cols, fields, asked, got = matched
    want = {}
    for col in cols:
        mine = {a.model for a in asked if a.tab == col.tab}
        merged = {}
        for model, field, conf, name in strategies(col, [f for f in fields if f.model in mine]):
            merged.setdefault((model, field), []).append((conf, name))
        words = plain(col.header.replace("_", " ")).split()
        hint = plans.WORDS.get(words[0]) if len(words) > 1 else None
        ranked = []
        for (model, field), found in merged.items():
            conf = round(min(1.0, max(c for c, _ in found) + min(0.1, 0.03 * (len({n for _, n in found}) - 1))), 6)
            conf = min(1.0, conf * ((2.0 if model == hint else 0.3) if hint else 1.5))
            for prefix, spoken, factor in schema.FAMILIES:
                if model.startswith(prefix) and not any(w in col.header.lower() for w in spoken):
                    conf *= factor
            if round(conf, 6) >= 0.4:
                ranked.append((-round(conf, 6), model, field))
        if ranked:
            conf, model, field = min(ranked)
            want[col.col_id] = (model, field, -conf)
    assert {r.col_id: (r.model, r.field, pytest.approx(r.confidence, abs=2e-6)) for r in got} == want


def test_labelled_headers_by_known_patterns(spark):
    """Headers of ten kinds of tables, clean and dirty, against known headers of each model: the share of
    columns whose field is right. Half of the known headers come from one case of dirt, so the rest
    depends on normalization."""
    cols = plans.columns(spark, DATA)
    truth = spark.createDataFrame(plans.TRUTH, plans.SCHEMA)
    known = truth.select(F.col("header").alias("pattern"), "model", "field")
    hits = []
    for (case, model), _ in plans.LABELLED.items():
        mine = cols.where(F.col("tab").rlike(f"^{case}_[0-9]+$"))
        kb = plans.fields(spark).where(F.col("model") == model)
        found = matching.hybrid(mine, kb, known.where(F.col("model") == model))
        right = mine.select("col_id", (F.col("col_id") % plans.N).alias("n")).join(truth.select("n", F.col("field").alias("want")), "n").join(found, "col_id", "left")
        hits.append(right.select((F.col("field") == F.col("want")).cast("int").alias("ok"), F.lit(case).alias("case")))
    both = hits[0]
    for h in hits[1:]:
        both = both.union(h)
    share = both.agg(F.avg(F.coalesce("ok", F.lit(0)))).first()[0]
    assert share >= 0.987


def test_prefix_labels_count_only_beside_few_equal_ones(spark):
    cols = spark.createDataFrame([(1, "Date"), (2, "Name"), (3, "")], "col_id int, header string")
    fields = spark.createDataFrame([("m", f"f{i}", x) for i, x in enumerate(["Date", "Date Order", "date due", "Up to date"] + ["Name"] * 5 + ["Name of it"])], "model string, field string, label string")
    got = {(r.col_id, r.field): r.confidence for r in schema.label_join(cols, fields).collect()}
    assert got == {(1, "f0"): 0.98, (1, "f1"): 0.34, (1, "f2"): 0.425, **{(2, f"f{i}"): 0.98 for i in range(4, 9)}}


def test_candidates_fall_back_to_the_default_models(spark):
    tables = spark.createDataFrame([("a",), ("b",)], "tab string")
    found = spark.createDataFrame([("a", "x"), ("b", "y")], "tab string, model string")
    got = {(r.tab, r.model) for r in schema.candidates(tables, found, selected=found.where("model = 'x'")).collect()}
    assert got == {("a", "x")} | {("b", m) for m in schema.DEFAULT_MODELS}


def test_references_are_decoded_once(spark):
    import html.entities as known

    cases = {f"a&{n}b": None for n in list(known.html5)[:2300]}
    cases |= {"&amp;lt;": "&lt;", "&#38;lt;": "&lt;", "&notit;": "¬it;", "&notin;": "∉", "&#x80;": "€", "&#0;": "�", "&#xD800;": "�", "&#1114112;": "�", "a & b": "a & b", "&unknown;": "&unknown;", "&#;": "&#;", "none": "none"}
    for n, v in known.html5.items():
        if n.endswith(";"):
            cases[f"&{n}"] = v
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "t string").select("t", text.html_unescape(F.col("t")).alias("u"))
    for r in df.collect():
        if r.t is None:
            assert r.u is None
        elif cases[r.t] is not None:
            assert r.u == cases[r.t], r.t


def test_values_of_empty_and_null_columns(spark):
    rows = spark.createDataFrame([(None, " ", "Acme Inc"), (None, "", "Beta LLC")], "a string, b string, c string")
    got = {r.column: r for r in values.analyze_values(rows, ["a", "b", "c"]).collect()}
    assert got["a"].confidence == got["b"].confidence == 0.0 and got["a"].category is None
    assert got["c"].entity_type == "company" and got["c"].confidence == 1.0
    assert {r.confidence for r in values.analyze_values(rows.limit(0), ["a", "c"]).collect()} == {0.0}


def test_pivot_groups_need_an_order(spark):
    heads = ["activity_1_type", "activity_2_type", "activity_1_date", "activity_2_date", "activity_2_note", "gap_1", "gap_4", "late_3", "late_4", "Tag_0 ", "tag_1", "x"]
    got = {r.prefix: (r.n, r.indices, r.fields, r.confidence, r.target) for r in values.pivot_groups(spark.createDataFrame([("t", h) for h in heads], "table string, header string")).collect()}
    assert got == {"activity": (5, "1,2", 3, 0.8, "mail.activity"), "tag": (2, "0,1", 1, 0.8, "tags")}


def test_catalogue_tells_what_it_skips(spark):
    models = spark.createDataFrame([("sale.order", "Order"), ("x.order", "Order"), ("res.partner", "Contact")], "name string, description string")
    fields = spark.createDataFrame([("Order", "name", "Reference"), ("RES.PARTNER", "name", "Name"), ("nothing", "f", "F")], "model string, field string, label string")
    selections = spark.createDataFrame([("Name (Contact)", "a"), ("Reference", "b"), ("Nowhere", "c"), (None, "d")], "field string, value string")
    loaded, options, skipped = (x.collect() for x in values.load_catalogue(models, fields, selections))
    assert {(r.model, r.field, r.targets) for r in loaded} == {("x.order", "name", 2), ("res.partner", "name", 1)}
    assert {(r.model, r.field, r.value) for r in options} == {("res.partner", "name", "a"), ("x.order", "name", "b")}
    assert {(r.kind, r.reason) for r in skipped} == {("field", "no model"), ("selection", "no field")} and len(skipped) == 3
