"""Queries of schema matching in full: labelled headers of ten kinds of tables against a catalogue.

The headers, their models and fields are a labelled set of 75; `part` deals them out to sheets, so that
the number of sheets and columns grows with it, and dirties them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import matching, schema, values
from ..sources.shared import stored
from .profiles import TYPES
from .registry import PARTNERS, partners, query, table
from .scalars import trim

c = F.col

#: Labelled headers by case and model, with each field and its type.
LABELLED = {
    ("customers", "res.partner"): "Customer Name:name:char,Contact Email:email:char,Phone:phone:char,Street Address:street:char,City:city:char,State:state_id:many2one,Zip Code:zip:char,Annual Revenue:x_annual_revenue:monetary,Customer ID:ref:char",
    ("products", "product.product"): "Product Name:name:char,SKU:default_code:char,Sale Price:list_price:float,Cost Price:standard_price:float,Category:categ_id:many2one,Barcode:barcode:char,Active:active:boolean",
    ("sales_orders", "sale.order"): "Order Number:name:char,Customer:partner_id:many2one,Order Date:date_order:datetime,Total:amount_total:monetary,Status:state:selection,Salesperson:user_id:many2one",
    ("leads", "crm.lead"): "Opportunity Title:name:char,Email:email_from:char,Phone:phone:char,Street Address (Contact):street:char,City (Contact):city:char,Zip (Contact):zip:char,Lead Status:stage_id:many2one,Salesperson:user_id:many2one,Source:source_id:many2one,Expected Revenue:expected_revenue:monetary",
    ("invoices", "account.move"): "Invoice Number:name:char,Customer:partner_id:many2one,Invoice Date:invoice_date:date,Due Date:invoice_date_due:date,Subtotal:amount_untaxed:monetary,Tax:amount_tax:monetary,Total:amount_total:monetary,Status:state:selection",
    ("projects", "project.project"): "Project Name:name:char,Customer:partner_id:many2one,Project Manager:user_id:many2one,Start Date:date_start:date,Deadline:date:date,Active:active:boolean",
    ("tasks", "project.task"): "Task Title:name:char,Project:project_id:many2one,Assigned To:user_id:many2one,Due Date:date_deadline:date,Priority:priority:selection,Status:kanban_state:selection",
    ("vehicles", "fleet.vehicle"): "VIN:vin:char,License Plate:license_plate:char,Vehicle Model:model_id:many2one,Driver:driver_id:many2one,Acquisition Date:acquisition_date:date,Odometer:odometer:float,Active:active:boolean",
    ("sale_order_lines", "sale.order.line"): "Order Number:order_id:many2one,Product:product_id:many2one,Description:name:text,Quantity:product_uom_qty:float,Unit Price:price_unit:float,Discount:discount:float,Subtotal:price_subtotal:monetary",
    ("financial_analysis", "account.analytic.line"): "Date:date:date,Product:product_id:many2one,Segment:account_id:many2one,Country:partner_id:many2one,Units Sold:unit_amount:float,Revenue:amount:monetary,COGS:x_cogs:monetary,Profit:x_profit:monetary,Discount Band:tag_ids:many2many",
}
TRUTH = [(i, *row) for i, row in enumerate((case, model, *entry.split(":")) for (case, model), entries in LABELLED.items() for entry in entries.split(","))]
N = len(TRUTH)
#: Columns of the labelled set.
SCHEMA = "n int, case string, model string, header string, field string, ttype string"

# Expressions over (k, size, header, field, ttype) that mean the same in both dialects.
DIRTY = "CASE WHEN (k / 75) % 6 = 1 THEN concat(header, ' *') WHEN (k / 75) % 6 = 2 THEN concat(header, '...') WHEN (k / 75) % 6 = 3 THEN upper(header) WHEN (k / 75) % 6 = 4 THEN concat(header, ' #') WHEN (k / 75) % 6 = 5 THEN concat('  ', header, '?') ELSE header END"
DATA_TYPE = "CASE WHEN ttype IN ('monetary', 'float') THEN 'float' WHEN ttype = 'boolean' THEN 'boolean' WHEN ttype IN ('date', 'datetime') THEN 'date' WHEN field = 'tag_ids' THEN 'integer' ELSE 'string' END"
UNIQUENESS = "CASE WHEN field IN ('name', 'ref', 'vin', 'default_code', 'barcode') THEN 1.0 WHEN ttype IN ('selection', 'boolean') THEN 0.02 ELSE (size % 50) / 50.0 END"
LOW = "CASE WHEN ttype IN ('monetary', 'float') THEN 0.0 END"
HIGH = "CASE WHEN ttype IN ('monetary', 'float') THEN CASE WHEN size % 2 = 0 THEN 90.0 ELSE 9000.0 END END"
RATIOS = {"email": "CASE WHEN field IN ('email', 'email_from') THEN 0.95 END", "phone": "CASE WHEN field = 'phone' THEN 0.9 END", "url": "CAST(NULL AS DOUBLE)", "currency": "CASE WHEN ttype IN ('monetary', 'float') THEN 0.6 + size / 125.0 END", "date": "CASE WHEN ttype IN ('date', 'datetime') THEN 1.0 END"}
PLAIN = {"header": DIRTY, "data_type": DATA_TYPE, "uniqueness": f"CAST({UNIQUENESS} AS DOUBLE)", "min": f"CAST({LOW} AS DOUBLE)", "max": f"CAST({HIGH} AS DOUBLE)", **{f"p_{k}": f"CAST({e} AS DOUBLE)" for k, e in RATIOS.items()}}
OPTIONS = ("draft", "sale", "done", "cancel")


def truth(spark):
    return spark.createDataFrame(TRUTH, SCHEMA)


def columns(spark, d):
    """A row per part: a column of the sheet that its number falls into."""
    parts = table(spark, d, "part").select(c("p_partkey").alias("k"), c("p_size").alias("size"), (c("p_partkey") % N).cast("int").alias("n"))
    x = parts.join(F.broadcast(truth(spark)), "n")
    some = F.when(c("ttype") == "selection", F.filter(F.array(*map(F.lit, OPTIONS)), lambda o: (F.length(o) + c("k")) % 3 != 0)).otherwise(F.array().cast("array<string>"))
    spec = {k: F.expr(e.replace("(k / 75)", "(k div 75)")) for k, e in PLAIN.items()}
    return x.select(F.concat_ws("_", "case", F.expr("k div 75").cast("string")).alias("tab"), c("k").alias("col_id"), *[e.alias(k) for k, e in spec.items()], some.alias("values"))


def fields(spark):
    label = F.trim(F.regexp_replace(F.regexp_replace("field", "^x_|_ids?$", ""), "_", " "))
    options = F.when(c("ttype") == "selection", F.array(*map(F.lit, OPTIONS))).otherwise(F.array().cast("array<string>"))
    return truth(spark).select("model", "field", label.alias("label"), "ttype", options.alias("options")).distinct()


def models(spark, d):
    """(tab, model): the sheet's own model, and customers and orders for every second sheet."""
    parts = table(spark, d, "part").select(c("p_partkey").alias("k"), (c("p_partkey") % N).cast("int").alias("n")).join(F.broadcast(truth(spark)), "n")
    tab = F.concat_ws("_", "case", F.expr("k div 75").cast("string"))
    more = F.when(F.expr("k div 75") % 2 == 0, F.array(c("model"), F.lit("res.partner"), F.lit("sale.order"))).otherwise(F.array("model"))
    return parts.select(tab.alias("tab"), F.explode(more).alias("model")).distinct()


def found(spark, d):
    return schema.pairs(columns(spark, d), fields(spark), models(spark, d))


# The same in SQL.
def plain(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def squeezed(x: str) -> str:
    return f"regexp_replace(lower({x}), '[^a-z0-9]', '', 'g')"


def jaccard(a: str, b: str) -> str:
    return f"coalesce(len(list_intersect({a}, {b})) / nullif(len(list_distinct(list_concat({a}, {b}))), 0), 0.0)"


def words(x: str) -> str:
    return f"list_distinct([t FOR t IN string_split({plain(f"replace({x}, '_', ' ')")}, ' ') IF t <> ''])"


def within(a: str, b: str, otherwise: str) -> str:
    return f"CASE WHEN {a} = {b} THEN 1.0 WHEN contains({a}, {b}) OR contains({b}, {a}) THEN coalesce(least(length({a}), length({b})) / nullif(greatest(length({a}), length({b})), 0), 0.0) ELSE {otherwise} END"


ARRAYS = "CASE WHEN ttype = 'selection' THEN [o FOR o IN ['draft', 'sale', 'done', 'cancel'] IF (length(o) + k) % 3 <> 0] ELSE [] END"
_BASE = f"""WITH truth(n, case_, model, header, field, ttype) AS (VALUES {', '.join(map(str, TRUTH))}),
x AS (SELECT p_partkey AS k, p_size AS size, truth.* FROM part JOIN truth ON p_partkey % {N} = n),
cols AS MATERIALIZED (SELECT concat(case_, '_', k // 75) AS tab, k AS col_id, {', '.join(f"{e.replace('(k / 75)', '(k // 75)')} AS {k}" for k, e in PLAIN.items())}, {ARRAYS} AS vals FROM x),
fields AS (SELECT DISTINCT model, field, trim(replace(regexp_replace(regexp_replace(field, '^x_', ''), '_ids?$', ''), '_', ' ')) AS label, ttype, CASE WHEN ttype = 'selection' THEN ['draft', 'sale', 'done', 'cancel'] ELSE [] END AS options FROM truth)"""
_PAIRS = ", found AS MATERIALIZED (SELECT * FROM cols JOIN models USING (tab) JOIN fields USING (model))"
BASE = _BASE + ", models AS (SELECT DISTINCT concat(case_, '_', k // 75) AS tab, unnest(CASE WHEN (k // 75) % 2 = 0 THEN [model, 'res.partner', 'sale.order'] ELSE [model] END) AS model FROM x)" + _PAIRS
FITS = ", ".join(f"'{a}>{b}'" for a, bs in matching.COMPATIBLE.items() for b in bs)
TYPE_SQL = f"CASE WHEN concat(data_type, '>', ttype) IN ({FITS}) THEN CASE concat(data_type, '>', ttype) {' '.join(f"WHEN '{a}>{b}' THEN {s}" for (a, b), s in schema.TYPE_SCORES.items())} ELSE CASE WHEN ttype IN ('char', 'text') THEN 0.60 ELSE 0.50 END END END"


def listed(xs) -> str:
    return ", ".join(f"'{x}'" for x in xs)


def begins(xs) -> str:
    return "(" + " OR ".join(f"starts_with(field, '{x}')" for x in xs) + ")"


PATTERN_SQL = "greatest(" + ", ".join(f"CASE WHEN p_{p} >= 0.7 THEN CASE WHEN field IN ({listed(schema.PATTERN_FIELDS[p])}) THEN p_{p} * 0.8 * CASE WHEN ttype IN ({listed(schema.PATTERN_TYPES[p])}) THEN 1.2 ELSE 1.0 END WHEN ttype IN ({listed(schema.PATTERN_TYPES[p])}) THEN p_{p} * 0.6 END END" for p in schema.PATTERN_FIELDS) + ")"
STATISTICS_SQL = f"greatest(CASE WHEN uniqueness >= 0.95 AND {begins(schema.UNIQUE)} THEN 0.70 * uniqueness END, CASE WHEN uniqueness <= 0.1 AND {begins(schema.FEW)} THEN 0.60 * (1 - uniqueness) * CASE WHEN ttype = 'selection' THEN 1.2 ELSE 1.0 END END, CASE WHEN data_type IN ('integer', 'float') AND min BETWEEN 0 AND 100 AND max BETWEEN 0 AND 100 AND {begins(schema.SHARES)} AND ttype IN ('float', 'integer') THEN 0.55 END)"
SELECTION_SQL = "CASE WHEN len(list_intersect(vals, options)) / nullif(len(vals), 0) >= 0.5 THEN 0.7 * len(list_intersect(vals, options)) / len(vals) + 0.3 * len(list_intersect(vals, options)) / len(options) END"
SIMILAR = within(plain("header"), plain("label"), jaccard(f"string_split({plain('header')}, ' ')", f"string_split({plain('label')}, ' ')"))
CONTEXT_SQL = within(squeezed("header"), squeezed("field"), jaccard(words("header"), words("field")))
EXACT_SQL = f"CASE WHEN replace({plain('header')}, ' ', '_') = field THEN 1.0 WHEN replace({plain('header')}, ' ', '_') = concat(replace(model, '.', '_'), '_', field) THEN 0.95 END"


def strategy(name: str, confidence: str, source: str = "found") -> str:
    return f"SELECT * FROM (SELECT col_id, model, field, CAST(round({confidence}, 6) AS DOUBLE) AS confidence, '{name}' AS strategy FROM {source}) WHERE confidence IS NOT NULL"


def label_sql(source: str) -> str:
    asked = f"SELECT *, {plain('header')} = {plain('label')} AS equal, {SIMILAR} AS similarity FROM {source} WHERE {plain('header')} = {plain('label')} OR (starts_with({plain('label')}, {plain('header')}) AND {plain('header')} <> '')"
    kept = f"SELECT * FROM (SELECT *, count(*) FILTER (WHERE equal) OVER (PARTITION BY col_id) AS n, row_number() OVER (PARTITION BY col_id, equal ORDER BY similarity DESC, model, field) AS near FROM ({asked})) WHERE equal OR (n < 5 AND near <= 10)"
    return strategy("label", "similarity * CASE WHEN equal THEN 0.98 ELSE 0.85 END", f"({kept})")


def context_sql(source: str = "found") -> str:
    return strategy("context", f"CASE WHEN {CONTEXT_SQL} >= 0.3 THEN ({CONTEXT_SQL}) * 0.85 END", source)


@query("C26_match_label", f"{BASE} {label_sql('(SELECT * FROM cols CROSS JOIN fields)')}")
def match_label(spark, d):
    return schema.label_join(columns(spark, d), fields(spark))


@query("C28_match_dtype", f"{BASE} {strategy('type', TYPE_SQL)}")
def match_dtype(spark, d):
    return schema.dtype(found(spark, d))


@query("C29_match_pattern", f"{BASE} {strategy('pattern', PATTERN_SQL)}")
def match_pattern(spark, d):
    return schema.pattern(found(spark, d))


@query("C30_match_statistics", f"{BASE} {strategy('statistics', STATISTICS_SQL)}")
def match_statistics(spark, d):
    return schema.statistics(found(spark, d))


@query("C31_match_context", f"{BASE} {context_sql()}")
def match_context(spark, d):
    return schema.context(found(spark, d))


@query("C32_match_fuzzy")
def match_fuzzy(spark, d):
    return schema.fuzzy(found(spark, d))


@query("J4_sequence_ratio")
def sequence_ratio(spark, d):
    """Headers of a sheet's columns against the labels of its model's fields."""
    pairs = found(spark, d).select(schema.plain(c("header")).alias("header"), "label").distinct()
    return pairs.select("header", "label", F.round(schema.sequence_ratio("header", "label"), 6).alias("ratio"))


#: Domains of sheets: required and optional words, the kind of pattern that counts, words of a sheet's
#: name, models from the likeliest on.
SIGNATURES = {
    "customer_contacts": {"required": ("name", "company", "customer", "client", "email", "phone", "mobile", "contact"), "optional": ("address", "street", "city", "state", "country", "zip", "website", "notes"), "boost": "reach", "sheet": ("customers", "contacts", "clients", "partners"), "models": ("res.partner", "crm.lead"), "threshold": 0.6},
    "sales_orders": {"required": ("order", "customer", "total", "date"), "optional": ("status", "salesperson", "discount", "tax"), "boost": "money", "sheet": ("sales", "orders"), "models": ("sale.order", "sale.order.line")},
    "order_lines": {"required": ("product", "quantity", "price", "subtotal"), "optional": ("discount", "description", "order"), "boost": "money", "sheet": ("lines",), "models": ("sale.order.line", "sale.order")},
    "products": {"required": ("product", "sku", "price", "barcode"), "optional": ("category", "cost", "active"), "sheet": ("products", "items"), "models": ("product.product",)},
    "invoices": {"required": ("invoice", "total", "due_date", "customer"), "optional": ("tax", "subtotal", "status"), "boost": "money", "sheet": ("invoice", "bill"), "models": ("account.move", "account.move.line")},
    "sales_pipeline": {"required": ("lead", "opportunity", "expected_revenue", "source"), "optional": ("email", "phone", "salesperson", "status"), "sheet": ("leads", "pipeline"), "models": ("crm.lead",)},
    "projects": {"required": ("project", "manager", "deadline"), "optional": ("customer", "start", "active"), "sheet": ("projects",), "models": ("project.project", "project.task")},
    "tasks": {"required": ("task", "assigned", "priority"), "optional": ("project", "due_date", "status"), "boost": "time", "sheet": ("tasks",), "models": ("project.task", "project.project")},
    "fleet": {"required": ("vin", "license", "vehicle", "odometer"), "optional": ("driver", "acquisition", "active"), "sheet": ("vehicles", "fleet"), "models": ("fleet.vehicle",)},
    "financial_analysis": {"required": ("revenue", "profit", "segment", "country"), "optional": ("cogs", "units", "discount", "date"), "boost": "money", "sheet": ("financial", "analysis"), "models": ("account.analytic.line", "account.move")},
}


def _domain_sql(name: str) -> str:
    s = SIGNATURES[name]

    def fits(w: str) -> str:
        return f"bool_or(contains(h, '{w}') OR contains('{w}', h) OR len(list_intersect(string_split('{w}', '_'), string_split(h, '_'))) > 0)"

    share = lambda kind: "(" + " + ".join(f"CAST({fits(w)} AS INT)" for w in s[kind]) + f") / {len(s[kind])}"
    sheet = " OR ".join(f"contains(any_value(t), '{w}')" for w in s["sheet"])
    boost = {"money": "any_value(money)", "reach": "any_value(reach)", "time": "any_value(time)"}.get(s.get("boost"), "0.0")
    score = f"least(1.0, 0.5 * {share('required')} + 0.15 * {share('optional')} + 0.15 * least(1.0, {boost}) + 0.2 * CASE WHEN {sheet} THEN 1 ELSE 0 END)"
    if s.get("boost") == "reach":
        score = f"CASE WHEN {fits('name')} AND ({' OR '.join(fits(w) for w in ('email', 'phone', 'street', 'address', 'city', 'country'))}) THEN 0.8 ELSE {score} END"
    return f"SELECT * FROM (SELECT tab, '{name}' AS domain, CAST(round({score}, 6) AS DOUBLE) AS score FROM heads JOIN boosts USING (tab) GROUP BY tab) WHERE score >= {s.get('threshold', 0.5)}"


HEADS = f", heads AS (SELECT DISTINCT tab, lower(tab) AS t, replace({plain("replace(header, '_', ' ')")}, ' ', '_') AS h FROM cols), boosts AS (SELECT tab, 0.2 * count(*) FILTER (WHERE p_currency > 0.5) + 0.1 * count(*) FILTER (WHERE regexp_matches(lower(header), 'amount|total|revenue|sales') AND data_type IN ('integer', 'float')) AS money, 0.3 * count(*) FILTER (WHERE p_email > 0.5) + 0.2 * count(*) FILTER (WHERE p_phone > 0.5) AS reach, 0.2 * count(*) FILTER (WHERE p_date > 0.5) + 0.3 * count(*) FILTER (WHERE contains(lower(header), 'hour') AND data_type IN ('integer', 'float')) AS time FROM cols GROUP BY tab)"
DOMAINS = f"{HEADS}, domains AS ({' UNION ALL '.join(map(_domain_sql, SIGNATURES))})"
MODEL_ROWS = [(d, m, i) for d, s in SIGNATURES.items() for i, m in enumerate(s["models"])]
MODELS = f"{DOMAINS}, totals AS (SELECT tab, model, sum(score * (1 - 0.1 * pos)) AS total FROM domains JOIN (VALUES {', '.join(map(str, MODEL_ROWS))}) m(domain, model, pos) USING (domain) GROUP BY ALL), shares AS (SELECT tab, model, CAST(round(total / max(total) OVER (PARTITION BY tab), 6) AS DOUBLE) AS score FROM totals), scored_models AS (SELECT tab, model, score FROM (SELECT *, row_number() OVER (PARTITION BY tab ORDER BY score DESC, model) AS r FROM shares WHERE score >= 0.5) WHERE r <= 10)"


@query("D24_score_domain", f"{_BASE}{DOMAINS} SELECT * FROM domains")
def score_domain(spark, d):
    return schema.domain_scores(columns(spark, d), SIGNATURES)


@query("D25_score_models", f"{_BASE}{MODELS} SELECT * FROM scored_models")
def score_models(spark, d):
    return schema.model_scores(schema.domain_scores(columns(spark, d), SIGNATURES), SIGNATURES)


#: Models that the first word of a compound header names.
WORDS = {"customer": "res.partner", "product": "product.product", "order": "sale.order", "invoice": "account.move", "project": "project.project", "task": "project.task", "vehicle": "fleet.vehicle", "lead": "crm.lead"}
SQL_STRATEGIES = [strategy("exact", EXACT_SQL), label_sql("found"), strategy("selection", SELECTION_SQL), strategy("type", TYPE_SQL), strategy("pattern", PATTERN_SQL), strategy("statistics", STATISTICS_SQL), context_sql()]
HINT = f"CASE WHEN contains({plain("replace(header, '_', ' ')")}, ' ') THEN CASE split_part({plain("replace(header, '_', ' ')")}, ' ', 1) {' '.join(f"WHEN '{w}' THEN '{m}'" for w, m in WORDS.items())} END END"
FAMILY = "CASE " + " ".join(f"WHEN starts_with(model, '{p}') AND NOT ({' OR '.join(f"contains(lower(header), '{w}')" for w in ws)}) THEN {f}" for p, ws, f in reversed(schema.FAMILIES)) + " ELSE 1.0 END"
MERGED = f", merged AS (SELECT col_id, model, field, round(least(1.0, max(confidence) + least(0.1, (count(DISTINCT strategy) - 1) * 0.03)), 6) AS confidence FROM ({' UNION ALL '.join(SQL_STRATEGIES)}) GROUP BY col_id, model, field)"
PRIOR = f"{MERGED}, prior AS (SELECT m.col_id, m.model, field, CAST(round(least(1.0, m.confidence * CASE WHEN ({HINT}) IS NOT NULL THEN CASE WHEN m.model = ({HINT}) THEN 2.0 ELSE 0.3 END WHEN k.model IS NOT NULL THEN 1.5 ELSE 0.5 END) * {FAMILY.replace('(model', '(m.model')}, 6) AS DOUBLE) AS confidence FROM merged m JOIN cols USING (col_id) LEFT JOIN models k ON k.tab = cols.tab AND k.model = m.model)"
ASKED = ", models AS MATERIALIZED (SELECT tab, model FROM scored_models UNION SELECT tab, unnest(['res.partner', 'product.product', 'sale.order', 'account.move']) FROM (SELECT DISTINCT tab FROM cols) WHERE tab NOT IN (SELECT tab FROM scored_models))"


def asked_models(spark, d, cols):
    return schema.candidates(cols, schema.model_scores(schema.domain_scores(cols, SIGNATURES), SIGNATURES))


def prioritized(spark, d, strategies=schema.STRATEGIES):
    cols = stored(columns(spark, d), "columns")
    of = stored(asked_models(spark, d, cols), "candidate-models")
    pairs = stored(schema.pairs(cols, fields(spark), of), "candidate-pairs")
    found = strategies[0](pairs)
    for s in strategies[1:]:
        found = found.union(s(pairs))
    return schema.priority(matching.merge_candidates(found).drop("strategies"), cols, of, WORDS)


@query("D23_apply_model_priority", f"{_BASE}{MODELS}{ASKED}{_PAIRS}{PRIOR} SELECT * FROM prior")
def apply_model_priority(spark, d):
    return prioritized(spark, d, schema.STRATEGIES[:-1])


@query("P3_match_schema")
def match_schema(spark, d):
    """Domains name candidate models; all eight strategies on the pairs; merged, weighed, ranked. Not in
    SQL, as one strategy is a sequence ratio: held against plain Python in the tests."""
    return schema.tiered(prioritized(spark, d), 1).select("col_id", "model", "field", "confidence", "tier")


VALUED = {"name": "name", "phone": "phone", "city": "city", "segment": "segment", "balance": "balance", "nation": "nation", "money": "money", "day": "day", "flag": "CASE WHEN id % 2 = 0 THEN 'yes' ELSE 'no' END", "country": "CASE nation % 3 WHEN 0 THEN 'France' WHEN 1 THEN 'germany' ELSE ' Brazil ' END", "status": "CASE id % 3 WHEN 0 THEN 'Draft' WHEN 1 THEN 'done' ELSE 'Cancelled' END", "bill": "concat('INV-', id)", "sku": "concat('AB-', 1000 + id)", "person": "CASE id % 3 WHEN 0 THEN concat('Dr Ann Lee', id) ELSE concat('Max Po', id) END", "none": "CAST(NULL AS STRING)"}


def _valued_sql(x: str) -> str:
    contains_any = lambda ws: "(" + " OR ".join(f"contains(low, '{w}')" for w in ws) + ")"
    upper = r"len([w FOR w IN ws IF NOT regexp_matches(w, '^\p{Lu}')]) = 0"
    refs = ", ".join(f"count(*) FILTER (WHERE regexp_matches(v, '(?i)^({'|'.join(ps)})')) AS ref_{k}" for k, ps in values.REFERENCES.items())
    states = ", ".join(f"coalesce(bool_or(low IN ({listed(ws)})), false) AS state_{k}" for k, ws in values.STATES.items())
    bools = ", ".join(f"coalesce(bool_and(low IN ({listed(ws)})), false) AS bool_{i}" for i, ws in enumerate(values.BOOLEANS))
    best, most = "greatest(company, person, product)", f"greatest({', '.join(f'ref_{k}' for k in values.REFERENCES)})"
    state = "CASE " + " ".join(f"WHEN state_{k} THEN '{k}'" for k in values.STATES) + " END"
    boolean = "(" + " OR ".join(f"bool_{i}" for i in range(len(values.BOOLEANS))) + ")"
    numeric, few = "type IN ('integer', 'float')", "uniqueness < 0.1"
    classes = [("financial", "currency", 0.8, f"{numeric} AND lo >= 0 AND hi < 1000000 AND cents"), ("quantity", "integer", 0.7, f"{numeric} AND whole AND lo >= 0 AND hi < 10000"), ("percentage", None, 0.6, f"{numeric} AND lo BETWEEN 0 AND 100 AND hi BETWEEN 0 AND 100"), ("numeric", None, 0.5, numeric), ("temporal", "date", 0.9, "type = 'date'"), ("selection", "state", 0.8, f"{few} AND ({state}) IS NOT NULL"), ("boolean", None, 0.9, f"{few} AND {boolean}"), ("categorical", None, 0.6, few), ("text", None, 0.5, "true")]
    pick = lambda i: "CASE " + " ".join(f"WHEN {k[3]} THEN {'NULL' if k[i] is None else repr(k[i])}" for k in classes) + " END"
    place = "CASE WHEN countries > 0.3 * n THEN 'country' WHEN cities > 0.5 * n THEN 'city_or_region' END"
    entity_conf, ref_conf = f"CASE WHEN {best} = 0 THEN 0.0 ELSE least(1.0, {best} / n) END", f"CASE WHEN {most} = 0 THEN 0.0 ELSE least(1.0, {most} / n) END"
    inner = f"""SELECT count(*) AS n, coalesce(sum(CASE WHEN {contains_any(values.COMPANY_SUFFIXES)} THEN 2 ELSE 0 END + CASE WHEN {contains_any(values.COMPANY_WORDS)} THEN 1 ELSE 0 END), 0) AS company,
 coalesce(sum(CASE WHEN len(ws) BETWEEN 2 AND 3 THEN CASE WHEN lower(ws[1]) IN ({listed(values.PERSON_TITLES)}) THEN 2 WHEN {upper} THEN 1 ELSE 0 END ELSE 0 END), 0) AS person,
 coalesce(sum(CASE WHEN regexp_matches(v, '{values.SKU}') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(v, '^[0-9]+$') AND length(v) IN (8, 10, 12, 13) THEN 1 ELSE 0 END), 0) AS product, {refs},
 min(num) AS lo, max(num) AS hi, coalesce(bool_or(num % 0.01::DOUBLE = 0), false) AS cents, coalesce(bool_and(num = floor(num)), false) AS whole, {states}, {bools},
 count(*) FILTER (WHERE low IN ({listed(values.COUNTRIES)})) AS countries, count(*) FILTER (WHERE len(ws) BETWEEN 1 AND 3 AND {upper}) AS cities
 FROM (SELECT *, lower(v) AS low, [w FOR w IN regexp_split_to_array(v, '\\s+') IF w <> ''] AS ws, TRY_CAST(v AS DOUBLE) AS num FROM (SELECT {trim('v')} AS v FROM (SELECT DISTINCT {x} AS v FROM valued)) WHERE v <> '')"""
    hints = "array_to_string(flatten([CASE h " + " ".join(f"WHEN '{k}' THEN [{listed(hs)}]" for k, hs in values.HINTS.items()) + " ELSE [] END FOR h IN [entity_type, reference_type, subtype, place] IF h IS NOT NULL]), ',')"
    outer = f"""SELECT '{x}' AS "column", CASE WHEN n > 0 AND {entity_conf} > 0.5 THEN CASE WHEN company = {best} THEN 'company' WHEN person = {best} THEN 'person' ELSE 'product' END END AS entity_type,
 CASE WHEN n > 0 AND {ref_conf} > 0.5 THEN CASE {' '.join(f"WHEN ref_{k} = {most} THEN '{k}'" for k in values.REFERENCES)} END END AS reference_type, CASE WHEN n > 0 THEN {pick(0)} END AS category, CASE WHEN n > 0 THEN {pick(1)} END AS subtype,
 CASE WHEN n > 0 THEN {place} END AS place, CASE WHEN n > 0 THEN {state} END AS state_type,
 CAST(CASE WHEN n > 0 THEN round(greatest({entity_conf}, {ref_conf}, {pick(2)}, CASE {place} WHEN 'country' THEN 0.8 WHEN 'city_or_region' THEN 0.6 ELSE 0 END, CASE WHEN ({state}) IS NOT NULL THEN 0.7 ELSE 0 END), 6) ELSE 0 END AS DOUBLE) AS confidence
 FROM ({inner}) CROSS JOIN (SELECT {TYPES.replace('{c}', 'v')}, count(DISTINCT v) / nullif(count(v), 0) AS uniqueness FROM (SELECT {x} AS v FROM valued))"""
    return f"SELECT *, nullif({hints}, '') AS hints FROM ({outer})"


@query("D30_analyze_values", f"{PARTNERS}, valued AS (SELECT {', '.join(f'CAST({e} AS VARCHAR) AS {k}'.replace('STRING', 'VARCHAR') for k, e in VALUED.items())} FROM partners) " + " UNION ALL ".join(map(_valued_sql, VALUED)))
def analyze_values(spark, d):
    return values.analyze_values(partners(spark, d).selectExpr(*[f"{e} AS {k}" for k, e in VALUED.items()]), list(VALUED))


NUMBERED = "CASE WHEN p_partkey % 7 = 0 THEN concat(replace(p_name, ' ', '_'), '_', p_size % 4) ELSE concat(replace(p_name, ' ', '_'), '_', p_size % 4, CASE p_partkey % 3 WHEN 0 THEN '_note' WHEN 1 THEN '_date' ELSE '_type' END) END"


@query("D28_detect_pivot_groups", rf"""WITH h AS (SELECT DISTINCT p_brand AS "table", {NUMBERED} AS header FROM part), p AS (SELECT "table", CASE WHEN regexp_matches(header, '^([a-z_]+?)_(\d+)_([a-z_]+)$') THEN regexp_extract(header, '^([a-z_]+?)_(\d+)_([a-z_]+)$', 1) ELSE regexp_extract(header, '^([a-z_]+?)_(\d+)$', 1) END AS prefix, CAST(regexp_extract(header, '_(\d+)(?:_[a-z_]+)?$', 1) AS INTEGER) AS i, regexp_extract(header, '_\d+_([a-z_]+)$', 1) AS child FROM h),
f AS (SELECT "table", prefix, child, count(*) AS k FROM p GROUP BY ALL), g AS (SELECT "table", prefix, count(*) AS n, list_sort(list(DISTINCT i)) AS ix FROM p GROUP BY ALL), s AS (SELECT "table", prefix, count(*) AS fields, min(k) AS least, max(k) AS most FROM f GROUP BY ALL)
SELECT "table", prefix, n, array_to_string(ix, ',') AS indices, fields, CAST(round(least(1.0, 0.4 * len(ix) / (ix[-1] - ix[1] + 1) + 0.4 * least / most + CASE WHEN fields >= 3 THEN 0.2 WHEN fields = 2 THEN 0.1 ELSE 0 END), 6) AS DOUBLE) AS confidence, CASE WHEN regexp_matches(prefix, 'activity|task') THEN 'mail.activity' WHEN regexp_matches(prefix, 'note|message|comment') THEN 'mail.message' WHEN regexp_matches(prefix, 'line|item') THEN 'sale.order.line' WHEN contains(prefix, 'tag') THEN 'tags' END AS target FROM g JOIN s USING ("table", prefix) WHERE n >= 2 AND ix[1] IN (0, 1) AND len([k FOR k IN range(2, len(ix) + 1) IF ix[k] - ix[k - 1] > 2]) = 0""")
def detect_pivot_groups(spark, d):
    return values.pivot_groups(table(spark, d, "part").select(c("p_brand").alias("table"), F.expr(NUMBERED).alias("header")).distinct())


# A dictionary from part: models of types, fields of parts, options of parts; some keys fit nothing.
DICTIONARY = {
    "models": "SELECT DISTINCT concat('m.', lower(p_type)) AS name, CASE WHEN p_type = 'PROMO' THEN 'Economy' ELSE concat(upper(substr(p_type, 1, 1)), lower(substr(p_type, 2))) END AS description FROM part",
    "fields": "SELECT CASE p_partkey % 5 WHEN 0 THEN concat('M.', p_type) WHEN 4 THEN 'unknown' ELSE p_type END AS model, concat('f_', p_partkey) AS field, concat(p_name, ' ', p_size) AS label FROM part",
    "selections": "SELECT CASE p_partkey % 4 WHEN 0 THEN concat(p_name, ' ', p_size, ' (', upper(substr(p_type, 1, 1)), lower(substr(p_type, 2)), ')') WHEN 1 THEN concat(p_name, ' ', p_size) ELSE p_brand END AS field, concat('v', p_partkey) AS value FROM part",
}
_DICTIONARY = f"""WITH models AS ({DICTIONARY['models']}), f AS ({DICTIONARY['fields']}), s AS ({DICTIONARY['selections']}),
told AS (SELECT lower(description) AS k, max(name) AS by_description, count(DISTINCT name) AS targets FROM models GROUP BY 1), keyed AS (SELECT f.*, m.name AS by_name, by_description, targets FROM f LEFT JOIN (SELECT DISTINCT name FROM models) m ON lower(m.name) = lower(f.model) LEFT JOIN told ON told.k = lower(f.model)),
loaded AS (SELECT coalesce(by_name, by_description) AS model, field, label, CASE WHEN by_name IS NOT NULL THEN 1 ELSE targets END AS targets FROM keyed WHERE coalesce(by_name, by_description) IS NOT NULL),
known AS (SELECT DISTINCT l.model, field, label, description FROM loaded l JOIN (SELECT name AS model, max(description) AS description FROM models GROUP BY 1) m ON l.model = m.model),
full_ AS (SELECT concat(label, ' (', description, ')') AS k, max({{'m': model, 'f': field}}) AS p, count(*) AS n FROM known GROUP BY 1), bare AS (SELECT label AS k, max({{'m': model, 'f': field}}) AS p, count(*) AS n FROM known GROUP BY 1),
met AS (SELECT s.field AS key, value, coalesce(full_.p, bare.p) AS p, coalesce(full_.n, bare.n) AS n FROM s LEFT JOIN full_ ON full_.k = s.field LEFT JOIN bare ON bare.k = s.field)
SELECT 'field' AS kind, model, field, label AS value, targets, CAST(NULL AS VARCHAR) AS reason FROM loaded UNION ALL SELECT 'option', p.m, p.f, value, n, NULL FROM met WHERE p IS NOT NULL
UNION ALL SELECT 'field', NULL, NULL, concat(model, '.', field), NULL, 'no model' FROM keyed WHERE coalesce(by_name, by_description) IS NULL UNION ALL SELECT 'selection', NULL, NULL, concat(key, '=', value), NULL, 'no field' FROM met WHERE p IS NULL"""


@query("C38_kb_load", _DICTIONARY)
def kb_load(spark, d):
    """Fields and options as loaded, and what was skipped with its reason."""
    sheets = [spark.sql(sql.replace("FROM part", "FROM {part}"), part=table(spark, d, "part")) for sql in DICTIONARY.values()]
    loaded, options, skipped = values.load_catalogue(*sheets)
    none = F.lit(None).cast("string")
    out = loaded.select(F.lit("field").alias("kind"), "model", "field", c("label").alias("value"), "targets", none.alias("reason"))
    out = out.union(options.select(F.lit("option"), "model", "field", "value", "targets", none))
    return out.union(skipped.select("kind", none, none, "key", F.lit(None).cast("long"), "reason"))
