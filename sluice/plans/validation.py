"""Queries of validation, the ledger, and the export pipeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import contact, keys, text
from ..operators import reshape
from ..operators import validate as op
from ..operators.resolve import small
from ..sources import csvio
from ..sources.shared import fresh_path, stored
from .registry import PARTNERS, partners, query, table
from .reshape import LABELLED, labelled
from .scalars import COMPANY_SQL, company_key, digits, slug, trim
from .scalars import date as date_sql

c = F.col

EMAIL_BAD = f"coalesce(email, '') <> '' AND NOT coalesce(regexp_matches(lower({trim('email')}), '{contact.EMAIL}') AND NOT contains(lower({trim('email')}), '..'), false)"
_D = digits("phone")
PHONE_BAD = f"coalesce(phone, '') <> '' AND NOT coalesce(length({_D}) = 10 OR (length({_D}) = 11 AND starts_with({_D}, '1')), false)"
_SERIAL = rf"CASE WHEN regexp_full_match({trim('day')}, '\d{{1,6}}(\.\d+)?') THEN TRY_CAST({trim('day')} AS DOUBLE) END"
DATE_BAD = f"coalesce(day, '') <> '' AND coalesce({date_sql('day')}, CASE WHEN {_SERIAL} > 1 AND {_SERIAL} < 100000 THEN DATE '1900-01-01' END) IS NULL"
SEGMENTS = "('BUILDING', 'MACHINERY', 'AUTOMOBILE')"
CODE = f"CASE WHEN name IS NULL THEN 'REQ_MISSING' WHEN {EMAIL_BAD} THEN 'INVALID_EMAIL' WHEN {PHONE_BAD} THEN 'INVALID_PHONE' WHEN {DATE_BAD} THEN 'DATE_PARSE_FAIL' WHEN segment NOT IN {SEGMENTS} THEN 'ENUM_UNKNOWN' WHEN nation NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 2) THEN 'FK_UNRESOLVED' END"


def checked(spark, d):
    """Partners with their first error: required, normal forms, vocabulary, parent; one pass."""
    vocab = spark.createDataFrame([("BUILDING",), ("MACHINERY",), ("AUTOMOBILE",)], "known string")
    nations = table(spark, d, "nation").where("n_regionkey <> 2").select(c("n_nationkey").alias("parent"))
    p = partners(spark, d).join(small(vocab), c("segment") == c("known"), "left").join(small(nations), c("nation") == c("parent"), "left")
    checks = [op.required("name"), op.normalizable("email", "email"), op.normalizable("phone", "phone"), op.normalizable("day", "date"), op.known("segment", c("known")), op.has_parent("nation", c("parent"))]
    return op.validated(p, checks)


@query("V1_validate", f"{PARTNERS} SELECT source_ptr, {CODE} AS error_code FROM partners")
def validate(spark, d):
    return checked(spark, d).select("source_ptr", c("error.code").alias("error_code"))


@query("V2_req_missing", f"{LABELLED} SELECT doc_id, 'REQ_MISSING' AS error_code, CASE WHEN quality IS NULL THEN 'quality' ELSE 'rare' END AS field FROM dl WHERE quality IS NULL OR rare IS NULL")
def req_missing(spark, d):
    return op.exceptions(op.validated(labelled(spark, d), [op.required("quality"), op.required("rare")]), "doc_id").select("doc_id", "error_code", "field")


@query("V3_invalid_formats", f"{PARTNERS} SELECT source_ptr, {EMAIL_BAD} AS bad_email, {PHONE_BAD} AS bad_phone, {DATE_BAD} AS bad_date FROM partners")
def invalid_formats(spark, d):
    bad = lambda f, k: op.normalizable(f, k).isNotNull()
    return partners(spark, d).select("source_ptr", bad("email", "email").alias("bad_email"), bad("phone", "phone").alias("bad_phone"), bad("day", "date").alias("bad_date"))


@query("V4_enum_unknown", f"{PARTNERS} SELECT source_ptr FROM partners WHERE segment NOT IN {SEGMENTS}")
def enum_unknown(spark, d):
    vocab = spark.createDataFrame([("BUILDING",), ("MACHINERY",), ("AUTOMOBILE",)], "known string")
    p = partners(spark, d).join(F.broadcast(vocab), c("segment") == c("known"), "left")
    return op.validated(p, [op.known("segment", c("known"))]).where("error IS NOT NULL").select("source_ptr")


@query("V5_fk_unresolved", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 11 <> 0)")
def fk_unresolved(spark, d):
    parents = table(spark, d, "part").where("p_partkey % 11 <> 0").select(c("p_partkey").alias("parent"))
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(parents, c("l_partkey") == c("parent"), "left")
    return op.validated(lines, [op.has_parent("l_partkey", c("parent"))]).where("error IS NOT NULL").select("l_orderkey", "l_linenumber")


@query("V6_check_at_least_one", f"{PARTNERS} SELECT source_ptr FROM partners WHERE coalesce(nullif(email, ''), nullif(phone, ''), nullif(vat, '')) IS NULL")
def check_at_least_one(spark, d):
    return partners(spark, d).where(F.coalesce(*[text.empty_to_null(c(x)) for x in ("email", "phone", "vat")]).isNull()).select("source_ptr")


@query("V7_check_range", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT (l_quantity BETWEEN 5 AND 45 AND l_discount >= 0.02)")
def check_range(spark, d):
    return reshape.violations(table(spark, d, "lineitem"), "l_quantity BETWEEN 5 AND 45 AND l_discount >= 0.02").select("l_orderkey", "l_linenumber")


@query("V8_check_implies", "SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND NOT o_orderstatus = 'F'")
def check_implies(spark, d):
    return reshape.violations(table(spark, d, "orders"), "NOT o_orderpriority = '1-URGENT' OR o_orderstatus = 'F'").select("o_orderkey")


@query("V9_check_deadline_age", "SELECT o_orderkey FROM orders WHERE o_orderdate IS NULL OR date_diff('day', CAST(o_orderdate AS DATE), DATE '1996-01-01') > 90")
def check_deadline_age(spark, d):
    return table(spark, d, "orders").where(c("o_orderdate").isNull() | (F.datediff(F.lit("1996-01-01").cast("date"), c("o_orderdate").cast("date")) > 90)).select("o_orderkey")


@query("G1_union_exceptions", f"{PARTNERS} SELECT source_ptr, {CODE} AS error_code FROM partners WHERE {CODE} IS NOT NULL")
def union_exceptions(spark, d):
    return op.exceptions(checked(spark, d)).select("source_ptr", "error_code")


@query("G6_valid_split", f"{PARTNERS} SELECT source_ptr, name, email FROM partners WHERE {CODE} IS NULL")
def valid_split(spark, d):
    return op.valid_rows(checked(spark, d)).select("source_ptr", "name", "email")


@query("D20_exceptions_by_code", f"{PARTNERS} SELECT {CODE} AS error_code, count(*) AS n FROM partners WHERE {CODE} IS NOT NULL GROUP BY 1")
def exceptions_by_code(spark, d):
    return op.exceptions(checked(spark, d)).groupBy("error_code").agg(F.count("*").alias("n"))


@query("W1_write_keymap", f"{PARTNERS} SELECT coalesce(nullif({trim('email')}, ''), nullif(name, ''), source_ptr) AS source_key, 'partner_' || id AS xml_id, {COMPANY_SQL} AS natural_key, md5(concat_ws('|', 'email:' || email, 'name:' || name)) AS content_hash, 1.0 AS confidence, 'created' AS method FROM partners")
def write_keymap(spark, d):
    p = partners(spark, d)
    rows = p.select(F.coalesce(text.empty_to_null(text.trim(c("email"))), text.empty_to_null(c("name")), c("source_ptr")).alias("source_key"), F.concat(F.lit("partner_"), "id").alias("xml_id"), company_key().alias("natural_key"), keys.content_hash({"email": c("email"), "name": c("name")}).alias("content_hash"), F.lit(1.0).alias("confidence"), F.lit("created").alias("method"))
    return stored(rows, "keymap")


LEDGER = "WITH ledger AS (SELECT CAST(event_id AS VARCHAR) AS source_key, CASE WHEN event_id % 3 = 0 THEN 'quarantined' ELSE 'created' END AS action FROM events), decisions AS (SELECT CAST(event_id AS VARCHAR) AS source_key, CASE event_id % 4 WHEN 0 THEN 'approve' WHEN 1 THEN 'match' WHEN 2 THEN 'reject' ELSE 'later' END AS decision FROM events WHERE event_id % 2 = 0 OR event_id % 9 = 0)"


def ledger(spark, d):
    e = table(spark, d, "events")
    k = c("event_id")
    rows = e.select(k.cast("string").alias("source_key"), F.when(k % 3 == 0, "quarantined").otherwise("created").alias("action"))
    decision = F.element_at(F.array(*map(F.lit, ("approve", "match", "reject", "later"))), (k % 4 + 1).cast("int"))
    return rows, e.where((k % 2 == 0) | (k % 9 == 0)).select(k.cast("string").alias("source_key"), decision.alias("decision"))


RESOLVED = "CASE WHEN action = 'quarantined' THEN CASE decision WHEN 'approve' THEN 'created' WHEN 'match' THEN 'matched' WHEN 'reject' THEN 'skipped' ELSE action END ELSE action END"


@query("W3_resolve_quarantine", f"{LEDGER} SELECT source_key, {RESOLVED} AS action FROM ledger LEFT JOIN decisions USING (source_key)")
def resolve_quarantine(spark, d):
    return op.resolve_quarantine(*ledger(spark, d))


@query("W6_resume_quarantine", f"{PARTNERS} SELECT source_ptr, {CODE.replace('name IS NULL', 'false')} AS error_code FROM partners WHERE name IS NULL")
def resume_quarantine(spark, d):
    """Rows whose name was missing, fixed, go through the checks again."""
    fixed = checked(spark, d).where("error.code = 'REQ_MISSING'").drop("error").withColumn("name", F.lit("fixed"))
    checks = [op.required("name"), op.normalizable("email", "email"), op.normalizable("phone", "phone"), op.normalizable("day", "date"), op.known("segment", c("known")), op.has_parent("nation", c("parent"))]
    return op.validated(fixed, checks).select("source_ptr", c("error.code").alias("error_code"))


@query("W7_failure_action", "WITH v AS (SELECT 'orphans' AS check_name, 'blocker' AS severity, count(*) FILTER (WHERE l_partkey % 97 = 0) AS n FROM lineitem UNION ALL SELECT 'discount', 'warning', count(*) FILTER (WHERE l_discount > 0.05) FROM lineitem UNION ALL SELECT 'negative', 'critical', count(*) FILTER (WHERE l_quantity < 0) FROM lineitem) SELECT check_name, n, CASE WHEN n = 0 THEN 'pass' ELSE CASE severity WHEN 'blocker' THEN 'abort' WHEN 'critical' THEN 'critical' WHEN 'error' THEN 'quarantine' ELSE 'warn' END END AS action FROM v")
def failure_action(spark, d):
    rules = {"orphans": ("blocker", "l_partkey % 97 = 0"), "discount": ("warning", "l_discount > 0.05"), "negative": ("critical", "l_quantity < 0")}
    row = table(spark, d, "lineitem").agg(*[F.count_if(F.expr(r)).alias(k) for k, (_, r) in rules.items()])
    v = row.select(F.explode(F.array(*[F.struct(F.lit(k).alias("check_name"), F.lit(s).alias("severity"), c(k).alias("n")) for k, (s, _) in rules.items()])).alias("v")).select("v.*")
    action = F.create_map(*[F.lit(x) for kv in op.SEVERITY.items() for x in kv])[c("severity")]
    return v.select("check_name", "n", F.when(c("n") == 0, "pass").otherwise(action).alias("action"))


@query("F2_quarantine_queue", "SELECT event_id, reason, model, n FROM (SELECT event_id, event_type AS reason, CASE WHEN user_id % 2 = 0 THEN 'lead' ELSE 'partner' END AS model, ts, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE reason = 'error' AND model = 'lead' ORDER BY ts DESC, event_id LIMIT 50")
def quarantine_queue(spark, d):
    e = table(spark, d, "events").withColumn("model", F.when(c("user_id") % 2 == 0, "lead").otherwise("partner"))
    n = e.groupBy("user_id").agg(F.count("*").alias("n"))
    q = e.where((c("event_type") == "error") & (c("model") == "lead")).join(n, "user_id").orderBy(F.desc("ts"), "event_id").limit(50)
    return q.select("event_id", c("event_type").alias("reason"), "model", "n")


EXPORT = f"""{PARTNERS}, valid AS (SELECT *, substr('partner_' || coalesce(nullif({slug('email')}, ''), nullif({slug('name')}, ''), ''), 1, 60) AS base FROM partners WHERE {CODE} IS NULL),
ids AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY source_ptr) AS n FROM valid),
p AS (SELECT substr(CASE WHEN n = 1 THEN base ELSE base || '_' || n END, 1, 64) AS pid, id AS custkey, name FROM ids),
o AS (SELECT 'so_' || o_orderkey AS oid, o_orderkey, pid FROM orders JOIN p ON o_custkey = custkey)
SELECT 'res.partner' AS model, pid AS id, coalesce(name, '') AS label, '' AS parent FROM p
UNION ALL SELECT 'sale.order', oid, '', pid FROM o
UNION ALL SELECT 'sale.order.line', 'sol_' || l_orderkey || '_' || l_linenumber, '', oid FROM lineitem JOIN o ON l_orderkey = o_orderkey"""


@query("P4_export_tables", EXPORT)
def export_tables(spark, d):
    """Partners, then orders, then lines: mapped, validated, stamped with ids; ids of what was emitted are
    a stored table that decides which children have a parent. Each is written as ordered CSV parts."""
    p = op.valid_rows(checked(spark, d)).withColumn("base", keys.render_id("partner_{slug(email) or slug(name)}", {"email": c("email"), "name": c("name")}))
    p = stored(reshape.dedupe_ids(p, "base", "source_ptr").select(c("unique_id").alias("id"), c("id").alias("custkey"), c("name").alias("label")), "partners")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey").join(p.select(c("id").alias("parent"), "custkey"), c("o_custkey") == c("custkey"))
    o = stored(o.select(F.concat(F.lit("so_"), "o_orderkey").alias("id"), "o_orderkey", "parent"), "orders")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").join(o.select(c("id").alias("parent"), "o_orderkey"), c("l_orderkey") == c("o_orderkey"))
    lines = lines.select(F.concat_ws("_", F.lit("sol"), "l_orderkey", "l_linenumber").alias("id"), "parent")
    out = None
    for model, t in (("res.partner", p), ("sale.order", o), ("sale.order.line", lines)):
        t = reshape.with_headers(t, ["id", "label", "parent"])
        path = fresh_path(spark, model)
        csvio.emit(t, ["id", "label", "parent"], path, single=False)
        got = spark.read.csv(path, header=True, schema="id string, label string, parent string", escape='"').na.fill("").select(F.lit(model).alias("model"), "id", "label", "parent")
        out = got if out is None else out.unionByName(got)
    return out


RAW = "concat('  ', r_name, ' &amp; co &#65; ')"


@query("P2_clean_rules", "SELECT r_regionkey AS \"Key\", r_name || ' & co A' AS \"Region Name\" FROM region")
def clean_rules(spark, d):
    """Headers, white space, entities, in this order; a rule is a function of a table."""
    raw = table(spark, d, "region").select(c("r_regionkey").alias("Key*"), F.expr(RAW).alias("Region   Name (text)"))
    strings = lambda t, fn: t.select([fn(c(f"`{x}`")).alias(x) if k == "string" else c(f"`{x}`") for x, k in t.dtypes])
    rules = [lambda t: t.toDF(*reshape.clean_names(t.columns)), lambda t: strings(t, text.collapse_spaces), lambda t: strings(t, text.html_unescape)]
    for rule in rules:
        raw = raw.transform(rule)
    return raw
