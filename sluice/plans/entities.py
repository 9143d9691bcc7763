"""Queries of entity resolution: companies, contacts and leads against altered copies of themselves.

Names are words made from hashes of the rows' keys, so they repeat as little as the tables' rows do; the
copies have typos, other suffixes, missing values and new names.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keys, text
from ..operators import entities as op
from ..operators import resolve, validate
from ..sources.shared import stored
from .registry import query, table
from .scalars import COMPANY_SQL, company, company_key, here, named, normal

c = F.col


def word(h: str, at: int, syllables: int = 3) -> str:
    """A word from hexadecimal digits, in Spark's SQL and in DuckDB's."""
    pairs = [f"translate(substr({h}, {at + 2 * k}, 1), '0123456789abcdef', 'bcdfghklmnprstvz'), translate(substr({h}, {at + 2 * k + 1}, 1), '0123456789abcdef', 'aeiouaeiouaeioua')" for k in range(syllables)]
    return f"concat({', '.join(pairs)})"


def typo(a: str, b: str) -> str:
    """Two words, with a typo by the last digit of the hash."""
    return f"""CASE WHEN substr(h, 32, 1) IN ('4', '5', '6') THEN concat({a}, ' ', substr({b}, 1, 2), substr({b}, 4))
      WHEN substr(h, 32, 1) IN ('7', '8') THEN concat({a}, ' ', substr({b}, 1, 2), substr({b}, 4, 1), substr({b}, 3, 1), substr({b}, 5))
      WHEN substr(h, 32, 1) = '9' THEN concat(substr({a}, 1, 1), substr({a}, 3), ' ', substr({b}, 1, 4), 'x', substr({b}, 6))
      WHEN substr(h, 32, 1) = 'f' THEN concat('nova ', {word('h', 15)}) ELSE concat({a}, ' ', {b}) END"""


# Each table in three steps, as text that is SQL for both: columns of the base table, words, columns.
COMPANIES = (
    "c_custkey AS id, c_nationkey AS nation, md5(concat('company', c_custkey)) AS h",
    f"id, nation, h, CASE substr(h, 1, 1) WHEN '0' THEN 'North Wind' WHEN '1' THEN 'Global Parts' WHEN '2' THEN 'Blue Ocean' ELSE {word('h', 2, 2)} END AS a, {word('h', 6)} AS b, concat(translate(substr(h, 22, 2), 'abcdef', '123456'), ' ', {word('h', 24)}, ' street') AS way, CASE WHEN substr(h, 13, 1) < '4' THEN concat('xx', substr(h, 14, 8)) END AS tax",
)
SAME = "id, nation, tax AS vat, concat(a, ' ', b, CASE WHEN substr(h, 12, 1) < '6' THEN ' Inc' WHEN substr(h, 12, 1) < 'b' THEN ' LLC' ELSE '' END) AS name, way AS street, concat('city ', nation) AS city, CAST(NULL AS STRING) AS phone, concat('info@', b, '.org') AS email"
COPY = f"id, nation, CASE WHEN substr(h, 31, 1) < '8' THEN upper(tax) END AS vat, CASE WHEN substr(h, 32, 1) < '3' THEN upper(concat(a, '  ', b, ' Ltd.')) ELSE {typo('a', 'b')} END AS name, CASE WHEN substr(h, 30, 1) < '4' THEN replace(way, 'street', 'st') WHEN substr(h, 30, 1) < 'e' THEN way END AS street, concat('City ', nation) AS city, CAST(NULL AS STRING) AS phone, CASE WHEN substr(h, 29, 1) < '8' THEN concat('info@', b, '.org') END AS email"
CONTACTS = ("o_orderkey AS id, o_custkey AS parent, md5(concat('contact', o_orderkey)) AS h", f"id, parent, h, {word('h', 1, 2)} AS a, {word('h', 5)} AS b")
CONTACT_SAME = "id, parent, concat(a, ' ', b) AS name, CASE WHEN substr(h, 12, 1) < 'c' THEN concat(b, '@', parent, '.org') END AS email, CAST(NULL AS STRING) AS phone"
CONTACT_COPY = f"id, CASE WHEN substr(h, 14, 1) < 'e' THEN parent END AS parent, {typo('a', 'b')} AS name, CASE WHEN substr(h, 13, 1) < '8' THEN concat(upper(b), '@', parent, '.org') WHEN substr(h, 13, 1) < 'c' THEN concat(b, '@', parent, '.org') END AS email, CAST(NULL AS STRING) AS phone"
LEADS = ("event_id AS id, user_id AS partner, event_type, CAST(ts AS DATE) AS day, md5(concat('lead', event_id)) AS h", f"id, partner, day, h, {word('h', 1, 2)} AS a, concat({word('h', 5, 2)}, ' ', event_type) AS b")
LEAD_SAME = "id, partner, concat(a, ' ', b) AS name, concat('u', partner, '.', substr(h, 20, 1), '@x.org') AS email, day AS created, CASE WHEN substr(h, 9, 1) = '0' THEN concat('crm', id) END AS ext"
LEAD_COPY = f"id, partner, {typo('a', 'b')} AS name, CASE WHEN substr(h, 10, 1) < 'a' THEN concat('U', partner, '.', substr(h, 20, 1), '@x.org') END AS email, CASE WHEN substr(h, 11, 1) < 'c' THEN day END AS created, CASE WHEN substr(h, 9, 1) = '0' THEN concat('crm', id) END AS ext"


def select(base: str, steps: tuple[str, str], columns: str) -> str:
    return f"SELECT {columns} FROM (SELECT {steps[1]} FROM (SELECT {steps[0]} FROM {base}))"


def made(spark, d, base, steps, *columns):
    """A table per list of columns. The words are stored, so that they aren't made anew wherever a column
    asks for them."""
    words = stored(spark.sql(f"SELECT {steps[1]} FROM (SELECT {steps[0]} FROM {{base}})", base=table(spark, d, base)), "words")
    return [spark.sql(f"SELECT {x} FROM {{words}}", words=words) for x in columns]


def companies(spark, d):
    """Every customer as a company, and an altered copy of each: (source, canon)."""
    out = []
    for df in made(spark, d, "customer", COMPANIES, COPY, SAME):
        df = df.withColumn("natural_key", company_key()).withColumn("name", text.normalize_company(c("name")))
        out.append(df.withColumn("keys", op.name_keys(c("name"), c("nation").cast("string"))).select("id", "name", "street", "city", "natural_key", "keys"))
    return out


def contacts(spark, d):
    return [df.withColumn("name", text.normalize_string(c("name"))) for df in made(spark, d, "orders", CONTACTS, CONTACT_COPY, CONTACT_SAME)]


def leads(spark, d):
    return [df.withColumn("name", text.normalize_string(c("name"))) for df in made(spark, d, "events", LEADS, LEAD_COPY, LEAD_SAME)]


# The same in SQL.
def soundex(w: str) -> str:
    """American Soundex of a word of letters."""
    code = lambda x: f"translate(upper({x}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '01230127022455012623017202')"
    runs = f"concat({code(f'substr({w}, 1, 1)')}, replace({code(f'substr({w}, 2)')}, '7', ''))"
    for digit in "0123456":
        runs = f"regexp_replace({runs}, '{digit}+', '{digit}', 'g')"
    return f"CASE WHEN {w} = '' THEN '' ELSE rpad(substr(concat(upper(substr({w}, 1, 1)), replace(substr({runs}, 2), '0', '')), 1, 4), 4, '0') END"


def canon_sql(x: str) -> str:
    return x.replace("STRING", "VARCHAR")


def _keyed(columns: str) -> str:
    named_ = f"SELECT *, {COMPANY_SQL} AS natural_key, {company('name')} AS norm FROM ({canon_sql(select('customer', COMPANIES, columns))})"
    less = "[concat(substr(sq, 1, i - 1), substr(sq, i + 1)) FOR i IN range(1, length(sq) + 1)]"
    sound = f"array_to_string([{soundex('t')} FOR t IN string_split(norm, ' ')], '')"
    return f"SELECT id, norm AS name, street, city, natural_key, CASE WHEN sq = '' THEN [] ELSE [k FOR k IN list_distinct(list_concat([concat('s|', {sound}, '|', nation), concat('p|', substr(sq, 1, {op.LONG_PREFIX}), '|', nation), sq], {less})) IF k <> ''] END AS keys FROM (SELECT *, replace(norm, ' ', '') AS sq FROM ({named_}))"


LEV = "CASE WHEN s.street IS NULL OR s.city IS NULL OR t.street IS NULL OR t.city IS NULL THEN 0.0 ELSE 1 - levenshtein(lower(concat(s.street, ' ', s.city)), lower(concat(t.street, ' ', t.city))) / greatest(length(concat(s.street, ' ', s.city)), length(concat(t.street, ' ', t.city))) END"
BLOCKS = f"co AS MATERIALIZED ({_keyed(COPY)}), ca AS MATERIALIZED ({_keyed(SAME)}), pairs AS (SELECT DISTINCT id, c_id FROM (SELECT id, unnest(keys) AS k FROM co) JOIN (SELECT id AS c_id, unnest(keys) AS k FROM ca) USING (k))"
COMPANY_SCORES = f"{BLOCKS}, company_all AS (SELECT s.id, t.id AS c_id, round(0.7 * jaro_winkler_similarity(s.name, t.name) + 0.3 * ({LEV}), 6) AS score FROM pairs p JOIN co s ON s.id = p.id JOIN ca t ON t.id = p.c_id), company_scores AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, c_id) AS rank FROM company_all WHERE score >= 0.70)"


def equal(a: str) -> str:
    return f"CASE WHEN lower(s.{a}) = lower(t.{a}) THEN 1.0 ELSE 0.0 END"


def _scored(name: str, source: str, target: str, score: str, on: str, review: float) -> str:
    return f"{name}_all AS (SELECT s.id, t.id AS c_id, round({score}, 6) AS score FROM {source} s JOIN {target} t ON {on}), {name}_scores AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, c_id) AS rank FROM {name}_all WHERE score >= {review})"


def _plain(base: str, steps, columns: str) -> str:
    return f"SELECT * REPLACE ({normal('name')} AS name) FROM ({canon_sql(select(base, steps, columns))})"


CONTACT = f"po AS MATERIALIZED ({_plain('orders', CONTACTS, CONTACT_COPY)}), pa AS MATERIALIZED ({_plain('orders', CONTACTS, CONTACT_SAME)})"
CONTACT_SCORE = f"0.5 * jaro_winkler_similarity(s.name, t.name) + 0.5 * {equal('email')}"
LEAD = f"lo AS MATERIALIZED ({_plain('events', LEADS, LEAD_COPY)}), la AS MATERIALIZED ({_plain('events', LEADS, LEAD_SAME)})"
LEAD_SCORE = f"0.4 * jaro_winkler_similarity(s.name, t.name) + 0.4 * {equal('email')} + 0.2 * coalesce(greatest(0, 1 - abs(date_diff('day', s.created, t.created)) / 30), 0)"
LEAD_ON = f"lower(s.email) = lower(t.email) OR (s.name <> '' AND substr(s.name, 1, {op.PREFIX}) = substr(t.name, 1, {op.PREFIX}))"


@query("J3_jaro_winkler", f"WITH {BLOCKS} SELECT p.id, p.c_id, round(jaro_winkler_similarity(s.name, t.name), 6) AS similarity FROM pairs p JOIN co s ON s.id = p.id JOIN ca t ON t.id = p.c_id")
def jaro_winkler(spark, d):
    return op.paired(*companies(spark, d), "id").select("id", "c_id", F.round(op.jaro_winkler("name", "c_name"), 6).alias("similarity"))


@query("C17_fuzzy_match_company", f"WITH {COMPANY_SCORES} SELECT id, c_id, score, CAST(rank AS INT) AS rank FROM company_scores")
def fuzzy_match_company(spark, d):
    return op.company_scores(*companies(spark, d))


@query("C18_fuzzy_match_contact", f"WITH {CONTACT}, {_scored('contact', 'po', 'pa', CONTACT_SCORE, 's.parent = t.parent', 0.65)} SELECT id, c_id, score, CAST(rank AS INT) AS rank FROM contact_scores")
def fuzzy_match_contact(spark, d):
    return op.contact_scores(*contacts(spark, d))


@query("C19_fuzzy_match_lead", f"WITH {LEAD}, {_scored('lead', 'lo', 'la', LEAD_SCORE, LEAD_ON, 0.60)} SELECT id, c_id, score, CAST(rank AS INT) AS rank FROM lead_scores")
def fuzzy_match_lead(spark, d):
    return op.lead_scores(*leads(spark, d))


DECIDE = "SELECT id, count(*) FILTER (WHERE score >= 0.85) AS n_auto, count(*) FILTER (WHERE score < 0.85) AS n_review FROM company_scores GROUP BY id"


@query("C21_decide_match", f"WITH {COMPANY_SCORES} SELECT *, CASE WHEN n_auto = 1 THEN 'fuzzy_match' WHEN n_auto > 1 OR n_review > 0 THEN 'multi_match' ELSE 'create' END AS decision FROM ({DECIDE})")
def decide_match(spark, d):
    return resolve.decide(op.company_scores(*companies(spark, d)), "id", "score", "company")


@query("W2_quarantine", f"WITH {COMPANY_SCORES} SELECT CAST(id AS VARCHAR) AS source_key, 'quarantined' AS action, 'multi_match' AS reason FROM ({DECIDE}) WHERE n_auto <> 1 AND (n_auto > 1 OR n_review > 0)")
def quarantine(spark, d):
    waiting = resolve.decide(op.company_scores(*companies(spark, d)), "id", "score", "company").where("decision = 'multi_match'")
    return validate.quarantine(waiting, "id", F.lit("multi_match"))


def _resolved(name: str, model: str, source: str, canon: str, scores: str, auto: float) -> str:
    """CTEs of one entity's stages: exact keys, scores of the rest, key map and quarantine."""
    return f"""{name}_exact AS MATERIALIZED (SELECT s.id, min(t.id) AS target FROM {source} s JOIN {canon} t USING (natural_key) GROUP BY s.id),
{name}_left AS MATERIALIZED (SELECT * FROM {source} WHERE id NOT IN (SELECT id FROM {name}_exact)), {scores},
{name}_each AS MATERIALIZED (SELECT id, count(*) FILTER (WHERE score >= {auto}) AS n_auto, count(*) FILTER (WHERE score < {auto}) AS n_review, max(score) AS best, min_by(c_id, rank) AS target FROM {name}_scores GROUP BY id),
{name}_keymap AS MATERIALIZED (SELECT '{model}' AS model, CAST(id AS VARCHAR) AS source_key, CAST(target AS VARCHAR) AS target_id, 'exact_match' AS method, CAST(1.0 AS DOUBLE) AS confidence FROM {name}_exact
  UNION ALL SELECT '{model}', CAST(id AS VARCHAR), CAST(target AS VARCHAR), 'fuzzy_match', best FROM {name}_each WHERE n_auto = 1
  UNION ALL SELECT '{model}', CAST(id AS VARCHAR), concat('new_', id), 'create', 0.0 FROM {name}_left WHERE id NOT IN (SELECT id FROM {name}_each)),
{name}_waiting AS (SELECT '{model}' AS model, CAST(id AS VARCHAR) AS source_key, 'multi_match' AS reason, CASE WHEN n_auto > 1 THEN n_auto ELSE n_review END AS n_candidates,
  (SELECT string_agg(c_id, ',' ORDER BY rank) FROM {name}_scores x WHERE x.id = e.id AND rank <= {op.SHOWN} AND (n_auto <= 1 OR score >= {auto})) AS candidates FROM {name}_each e WHERE n_auto <> 1)"""


def _parented(name: str, source: str, column: str) -> str:
    lost = f"{column} IS NOT NULL AND target_id IS NULL"
    joined = f"SELECT x.* EXCLUDE ({column}), x.{column}, target_id FROM {source} x LEFT JOIN company_keymap ON CAST(x.{column} AS VARCHAR) = source_key"
    return f"{name}_joined AS MATERIALIZED ({joined}), {name}_lost AS (SELECT '{name}' AS model, CAST(id AS VARCHAR) AS source_key, 'fk_unresolved' AS reason, CAST(NULL AS BIGINT) AS n_candidates, CAST(NULL AS VARCHAR) AS candidates FROM {name}_joined WHERE {lost}), {name}_kept AS MATERIALIZED (SELECT * EXCLUDE ({column}, target_id), target_id AS {column} FROM {name}_joined WHERE NOT ({lost}))"


CONTACT_KEY = f"md5(concat('contact:', {named('parent')}, '|', {normal('name')}, '|', CASE WHEN {here('email')} THEN email WHEN {here('phone')} THEN phone ELSE '' END))"
WEEK = "strftime(date_trunc('week', created), '%Y-%m-%d')"
LEAD_KEY = f"""md5(CASE WHEN {here('ext')} THEN 'ext_id:' || ext
  WHEN coalesce(partner, '0') <> '0' AND {here('name')} AND created IS NOT NULL THEN 'partner_name_date:' || partner || '|' || {normal('name')} || '|' || {WEEK}
  WHEN {here('email')} AND {here('name')} AND created IS NOT NULL THEN 'email_name_date:' || lower(trim(email)) || '|' || {normal('name')} || '|' || {WEEK}
  ELSE concat_ws('|', {named('partner')}, {named('name')}, {named('email')}, coalesce(strftime(created, '%Y-%m-%d'), 'None')) END)"""
LEDGER = "SELECT model, source_key, target_id, method, confidence, CAST(NULL AS VARCHAR) AS reason, CAST(NULL AS BIGINT) AS n_candidates, CAST(NULL AS VARCHAR) AS candidates FROM {0}_keymap UNION ALL SELECT model, source_key, NULL, NULL, NULL, reason, n_candidates, candidates FROM {0}_waiting"
ENTITIES = f"""WITH co AS MATERIALIZED ({_keyed(COPY)}), ca AS MATERIALIZED ({_keyed(SAME)}),
{_resolved('company', 'company', 'co', 'ca', COMPANY_SCORES.replace(BLOCKS, f"pairs AS (SELECT DISTINCT id, c_id FROM (SELECT id, unnest(keys) AS k FROM company_left) JOIN (SELECT id AS c_id, unnest(keys) AS k FROM ca) USING (k))"), 0.85)},
{CONTACT}, {_parented('contact', 'po', 'parent')},
ps AS MATERIALIZED (SELECT *, {CONTACT_KEY} AS natural_key FROM contact_kept), pt AS MATERIALIZED (SELECT *, {CONTACT_KEY} AS natural_key FROM (SELECT * REPLACE (CAST(parent AS VARCHAR) AS parent) FROM pa)),
{_resolved('contact', 'contact', 'ps', 'pt', _scored('contact', 'contact_left', 'pt', CONTACT_SCORE, 's.parent = t.parent', 0.65), 0.80)},
{LEAD}, {_parented('lead', 'lo', 'partner')},
ls AS MATERIALIZED (SELECT *, {LEAD_KEY} AS natural_key FROM lead_kept), lt AS MATERIALIZED (SELECT *, {LEAD_KEY} AS natural_key FROM (SELECT * REPLACE (CAST(partner AS VARCHAR) AS partner) FROM la)),
{_resolved('lead', 'lead', 'ls', 'lt', _scored('lead', 'lead_left', 'lt', LEAD_SCORE, LEAD_ON, 0.60), 0.75)}
{' UNION ALL '.join(LEDGER.format(x) for x in ('company', 'contact', 'lead'))} UNION ALL SELECT model, source_key, NULL, NULL, NULL, reason, n_candidates, candidates FROM contact_lost UNION ALL SELECT model, source_key, NULL, NULL, NULL, reason, n_candidates, candidates FROM lead_lost"""


@query("P5_resolve_entities", ENTITIES)
def resolve_entities(spark, d):
    """Companies, then contacts under resolved companies, then leads of resolved partners: each stage adds
    to one key map and one quarantine; the result is both."""
    keymap, waiting = op.resolved(*companies(spark, d), "company", "company", op.company_scores)
    keymap = stored(keymap, "keymap")
    maps, waits = [keymap], [waiting]
    phone = lambda df: df.withColumn("natural_key", keys.key_contact(c("parent").cast("string"), c("name"), c("email"), c("phone")))
    week = lambda df: df.withColumn("natural_key", keys.key_lead(c("ext"), c("partner").cast("string"), c("name"), c("email"), c("created")))
    for model, (source, canon), column, key, scores in (("contact", contacts(spark, d), "parent", phone, op.contact_scores), ("lead", leads(spark, d), "partner", week, op.lead_scores)):
        kept, lost = op.unparented(source, keymap, "company", column)
        canon = canon.withColumn(column, c(column).cast("string"))
        found, left = op.resolved(stored(key(kept), model), key(canon), model, model, scores)
        maps.append(found)
        waits += [left, lost.select(F.lit(model).alias("model"), "source_key", F.lit("quarantined").alias("action"), "reason", F.lit(None).cast("long").alias("n_candidates"), F.lit(None).cast("array<struct<id:string,score:double>>").alias("candidates"))]
    out = None
    for m in maps:
        rows = m.select("model", "source_key", "target_id", "method", "confidence", F.lit(None).cast("string").alias("reason"), F.lit(None).cast("long").alias("n_candidates"), F.lit(None).cast("string").alias("candidates"))
        out = rows if out is None else out.union(rows)
    for w in waits:
        none = F.lit(None)
        out = out.union(w.select("model", "source_key", none.cast("string").alias("target_id"), none.cast("string").alias("method"), none.cast("double").alias("confidence"), "reason", "n_candidates", F.array_join(F.transform("candidates", lambda x: x["id"]), ",").alias("candidates")))
    return out
