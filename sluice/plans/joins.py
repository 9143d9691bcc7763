"""Queries of key, vocabulary and entity resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keys, text
from ..operators import resolve as op
from .registry import query, table
from .scalars import normal, trim

c = F.col

KEYMAP = "WITH keymap AS (SELECT 'res.partner' AS model, CAST(c_custkey AS VARCHAR) AS source_key, 'partner_' || c_custkey AS target_id FROM customer WHERE c_custkey % 3 <> 0)"


def keymap(spark, d):
    return table(spark, d, "customer").where("c_custkey % 3 <> 0").select(F.lit("res.partner").alias("model"), c("c_custkey").cast("string").alias("source_key"), F.concat(F.lit("partner_"), "c_custkey").alias("target_id"))


@query("C1_resolve_fk", f"{KEYMAP} SELECT o_orderkey, coalesce(target_id, CAST(o_custkey AS VARCHAR)) AS o_custkey FROM orders LEFT JOIN keymap ON CAST(o_custkey AS VARCHAR) = source_key")
def resolve_fk(spark, d):
    return op.resolve_fk(table(spark, d, "orders").select("o_orderkey", "o_custkey"), keymap(spark, d), "o_custkey", "res.partner")


@query("C2_resolve_self_fk", "SELECT a.c_custkey, b.c_name AS parent_name FROM (SELECT c_custkey, CASE WHEN c_custkey % 10 <> 0 THEN CAST(floor(c_custkey / 10) AS BIGINT) END AS parent FROM customer) a LEFT JOIN customer b ON a.parent = b.c_custkey")
def resolve_self_fk(spark, d):
    cust = table(spark, d, "customer")
    child = cust.select("c_custkey", F.when(c("c_custkey") % 10 != 0, F.floor(c("c_custkey") / 10)).alias("parent"))
    return child.join(cust.select(c("c_custkey").alias("parent"), c("c_name").alias("parent_name")), "parent", "left").select("c_custkey", "parent_name")


@query("C3_check_fk", "SELECT l_orderkey, l_linenumber, 'FK_UNRESOLVED' AS error_code FROM lineitem WHERE l_partkey IS NOT NULL AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 45)")
def check_fk(spark, d):
    return op.unresolved(table(spark, d, "lineitem"), "l_partkey", table(spark, d, "part").where("p_size < 45"), "p_partkey").select("l_orderkey", "l_linenumber", F.lit("FK_UNRESOLVED").alias("error_code"))


@query("C4_fk_unresolved_count", "SELECT count(*) AS n FROM orders WHERE o_custkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0)")
def fk_unresolved_count(spark, d):
    return op.unresolved(table(spark, d, "orders"), "o_custkey", table(spark, d, "customer").where("c_acctbal > 0"), "c_custkey").agg(F.count("*").alias("n"))


@query("C5_orphans", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F')")
def orphans(spark, d):
    return op.unresolved(table(spark, d, "lineitem"), "l_orderkey", table(spark, d, "orders").where("o_orderstatus = 'F'"), "o_orderkey").select("l_orderkey", "l_linenumber")


ROUTED = "WITH routed AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'customer' ELSE 'supplier' END AS model, user_id AS id FROM events)"


def routed(spark, d):
    return table(spark, d, "events").select("event_id", F.when(c("event_id") % 2 == 0, "customer").otherwise("supplier").alias("model"), c("user_id").alias("id"))


def _anchored(spark, d):
    cust = table(spark, d, "customer").select(F.lit("customer").alias("model"), c("c_custkey").alias("id"))
    supp = table(spark, d, "supplier").select(F.lit("supplier").alias("model"), c("s_suppkey").alias("id"))
    return cust.union(supp)


@query("C6_polymorphic_orphans", f"{ROUTED} SELECT event_id, model FROM routed LEFT JOIN customer ON model = 'customer' AND id = c_custkey LEFT JOIN supplier ON model = 'supplier' AND id = s_suppkey WHERE c_custkey IS NULL AND s_suppkey IS NULL")
def polymorphic_orphans(spark, d):
    return routed(spark, d).join(_anchored(spark, d), ["model", "id"], "left_anti").select("event_id", "model")


@query("D31_anchor_coverage", f"{ROUTED} SELECT model, round(count(coalesce(c_custkey, s_suppkey)) / count(*), 6) AS resolved, count(coalesce(c_custkey, s_suppkey)) / count(*) < 0.9 AS warn FROM routed LEFT JOIN customer ON model = 'customer' AND id = c_custkey LEFT JOIN supplier ON model = 'supplier' AND id = s_suppkey GROUP BY model")
def anchor_coverage(spark, d):
    r = routed(spark, d).join(_anchored(spark, d).withColumn("hit", F.lit(1)), ["model", "id"], "left")
    return r.groupBy("model").agg(F.round(F.count("hit") / F.count("*"), 6).alias("resolved"), (F.count("hit") / F.count("*") < 0.9).alias("warn"))


@query("C7_state_matches_country", "SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> c_custkey % 5")
def state_matches_country(spark, d):
    states = table(spark, d, "nation").select(c("n_nationkey").alias("c_nationkey"), "n_regionkey")
    return table(spark, d, "customer").join(op.small(states), "c_nationkey").where(c("n_regionkey") != c("c_custkey") % 5).select("c_custkey")


@query("C8_require_child", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def require_child(spark, d):
    lines = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(c("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").join(lines, "o_orderkey", "left_anti").select("o_orderkey")


TREE = "SELECT c_custkey AS node, CASE WHEN c_custkey % 100 < 3 THEN c_custkey - c_custkey % 100 + (c_custkey % 100 + 1) % 3 WHEN c_custkey % 7 = 0 THEN NULL ELSE c_custkey - 1 END AS parent FROM customer"


@query("C9_cycle_check", f"WITH RECURSIVE t AS ({TREE}), walk(node, here, n) AS (SELECT node, parent, 1 FROM t WHERE parent IS NOT NULL UNION SELECT w.node, t.parent, n + 1 FROM walk w JOIN t ON w.here = t.node WHERE t.parent IS NOT NULL AND n < 32) SELECT DISTINCT node FROM walk WHERE node = here")
def cycle_check(spark, d):
    k = c("c_custkey")
    parent = F.when(k % 100 < 3, k - k % 100 + (k % 100 + 1) % 3).when(k % 7 == 0, None).otherwise(k - 1)
    return op.cycles(table(spark, d, "customer").select(k.alias("node"), parent.alias("parent")))


SEED_ROWS = [("won", "stage_won", "canonical"), ("open", "stage_open", "canonical"), ("F", "stage_won", "synonym")]
SEEDS = "WITH seeds(alias, canonical_id, kind) AS (VALUES ('won','stage_won','canonical'),('open','stage_open','canonical'),('F','stage_won','synonym'))"
STATUS = "CASE WHEN o_orderkey % 5 = 0 THEN 'stage_open' WHEN o_orderkey % 5 = 1 THEN ' won ' ELSE o_orderstatus END"
RESOLVED = f"coalesce((SELECT canonical_id FROM seeds WHERE kind = 'synonym' AND alias = {trim(STATUS)}), CASE {trim(STATUS)} WHEN 'O' THEN 'stage_open' END, (SELECT DISTINCT canonical_id FROM seeds WHERE canonical_id = {trim(STATUS)}), (SELECT canonical_id FROM seeds WHERE kind = 'canonical' AND alias = {trim(STATUS)}))"


def statuses(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.expr(STATUS).alias("status"))


def seeds(spark):
    return spark.createDataFrame(SEED_ROWS, "alias string, canonical_id string, kind string")


@query("C10_resolve_enum", f"{SEEDS} SELECT o_orderkey, {RESOLVED} AS resolved, CASE WHEN {RESOLVED} IS NULL THEN 'ENUM_UNKNOWN' END AS error_code FROM orders")
def resolve_enum(spark, d):
    r = op.resolve_enum(statuses(spark, d), "status", seeds(spark), {"O": "stage_open"})
    return r.select("o_orderkey", "resolved", F.when(c("resolved").isNull(), "ENUM_UNKNOWN").alias("error_code"))


@query("C11_seed_resolve", f"{SEEDS} SELECT o_orderkey, coalesce((SELECT canonical_id FROM seeds WHERE kind = 'synonym' AND alias = o_orderstatus), (SELECT canonical_id FROM seeds WHERE kind = 'canonical' AND alias = o_orderstatus)) AS id FROM orders")
def seed_resolve(spark, d):
    best = seeds(spark).groupBy("alias").agg(F.max_by("canonical_id", "kind").alias("id"))  # synonyms first
    return table(spark, d, "orders").join(op.small(best), c("o_orderstatus") == c("alias"), "left").select("o_orderkey", "id")


ALIAS_ROWS = [("Feed", None, "newsletter"), ("feed", 1, "rss"), ("mail", None, "email"), ("ad s", 2, "adwords")]
ALIASES = "WITH aliases(alias, company_id, canonical_value) AS (VALUES ('Feed', NULL, 'newsletter'), ('feed', 1, 'rss'), ('mail', NULL, 'email'), ('ad s', 2, 'adwords'))"
UTM = "CASE page_id % 4 WHEN 0 THEN ' FEED' WHEN 1 THEN 'Mail!' WHEN 2 THEN 'ad  s' ELSE 'other' END"
ALIASED = f"{ALIASES}, p AS (SELECT page_id, {UTM} AS utm, CAST(page_id % 3 AS INT) AS company FROM pages), a AS (SELECT page_id, utm, company, coalesce((SELECT canonical_value FROM aliases WHERE {normal('alias')} = {normal('utm')} AND company_id = company), (SELECT canonical_value FROM aliases WHERE {normal('alias')} = {normal('utm')} AND company_id IS NULL)) AS canonical FROM p)"


def aliased(spark, d):
    aliases = spark.createDataFrame(ALIAS_ROWS, "alias string, company_id int, canonical_value string")
    p = table(spark, d, "pages").select("page_id", F.expr(UTM).alias("utm"), (c("page_id") % 3).cast("int").alias("company"))
    return op.vocab_alias(p, "utm", "company", aliases)


@query("C12_vocab_alias", f"{ALIASED} SELECT page_id, canonical FROM a")
def vocab_alias(spark, d):
    return aliased(spark, d).select("page_id", "canonical")


@query("C13_vocab_lookup_ci", "SELECT page_id, n_nationkey FROM pages LEFT JOIN nation ON lower(n_name) = lower(CASE WHEN page_id % 2 = 0 THEN 'France' ELSE 'germany' END)")
def vocab_lookup_ci(spark, d):
    p = table(spark, d, "pages").select("page_id", F.when(c("page_id") % 2 == 0, "France").otherwise("germany").alias("v"))
    n = table(spark, d, "nation").select(F.lower("n_name").alias("k"), "n_nationkey")
    return p.join(op.small(n), F.lower("v") == c("k"), "left").select("page_id", "n_nationkey")


@query("C14_resolve_vocab", f"{ALIASED} SELECT page_id, coalesce(canonical, CASE WHEN company = 0 THEN utm END) AS value, CASE WHEN canonical IS NOT NULL THEN 'matched' WHEN company = 0 THEN 'created' WHEN company = 1 THEN 'quarantined' ELSE 'skipped' END AS status FROM a")
def resolve_vocab(spark, d):
    policy = F.when(c("company") == 0, "created").when(c("company") == 1, "quarantined").otherwise("skipped")
    r = aliased(spark, d).withColumn("status", F.when(c("canonical").isNotNull(), "matched").otherwise(policy))
    return r.select("page_id", F.coalesce("canonical", F.when(c("status") == "created", c("utm"))).alias("value"), "status")


@query("C15_vocab_cache_expire", "SELECT event_id FROM events WHERE ts + INTERVAL 24 HOUR > (SELECT max(ts) FROM events)")
def vocab_cache_expire(spark, d):
    e = table(spark, d, "events")
    return e.crossJoin(F.broadcast(e.agg(F.max("ts").alias("now")))).where(c("ts") + F.expr("INTERVAL 24 HOURS") > c("now")).select("event_id")


@query("C16_natural_key_lookup", "SELECT a.c_custkey, b.c_custkey AS match_id FROM customer a LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 2 = 0) b ON md5(concat(a.c_name, '|', a.c_nationkey)) = md5(concat(b.c_name, '|', b.c_nationkey))")
def natural_key_lookup(spark, d):
    cust = table(spark, d, "customer").select("c_custkey", F.md5(F.concat_ws("|", "c_name", "c_nationkey")).alias("k"))
    return cust.join(cust.where("c_custkey % 2 = 0").select(c("c_custkey").alias("match_id"), "k"), "k", "left").select("c_custkey", "match_id")


@query("C20_fuzzy_match_vocab", f"SELECT DISTINCT p_type, v.name AS vocab FROM part, (VALUES ('STANDRD'), ('PROMOS'), ('Economiy!')) v(name) WHERE 1 - levenshtein({normal('p_type')}, {normal('v.name')}) / greatest(length({normal('p_type')}), length({normal('v.name')})) >= 0.85".replace("levenshtein(", "levenshtein("))
def fuzzy_match_vocab(spark, d):
    vocab = spark.createDataFrame([("STANDRD",), ("PROMOS",), ("Economiy!",)], "vocab string").withColumn("v", text.normalize_string(c("vocab")))
    values = table(spark, d, "part").select("p_type").distinct().withColumn("n", text.normalize_string(c("p_type")))
    # Few vocabulary terms against distinct values: bounded on both sides.
    return values.join(F.broadcast(vocab), op.levenshtein_ratio(c("n"), c("v")) >= 0.85).select("p_type", "vocab")


CHANGED = "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN upper(c_name) || '!' ELSE c_name END AS c_name, c_nationkey FROM customer WHERE c_custkey % 2 = 0"


def versions(spark, d):
    cust = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey")
    new = cust.where("c_custkey % 2 = 0").withColumn("c_name", F.when(c("c_custkey") % 3 == 0, F.concat(F.upper("c_name"), F.lit("!"))).otherwise(c("c_name")))
    return new, cust.where("c_custkey % 5 <> 0")


UPSERT = f"SELECT coalesce(s.c_custkey, t.c_custkey) AS c_custkey, CASE WHEN s.c_custkey IS NOT NULL THEN s.c_name ELSE t.c_name END AS c_name, CASE WHEN s.c_custkey IS NOT NULL THEN s.c_nationkey ELSE t.c_nationkey END AS c_nationkey, CASE WHEN t.c_custkey IS NULL THEN 'create' WHEN s.c_custkey IS NULL THEN 'keep' WHEN s.c_name = t.c_name AND s.c_nationkey = t.c_nationkey THEN 'skip' ELSE 'update' END AS op FROM ({CHANGED}) s FULL JOIN (SELECT * FROM customer WHERE c_custkey % 5 <> 0) t ON s.c_custkey = t.c_custkey"


@query("C22_upsert", UPSERT)
def upsert(spark, d):
    new, old = versions(spark, d)
    return op.upsert(new, old, "c_custkey")


@query("C23_factorize_lead", "SELECT md5(concat('lead|', o_orderkey)) AS lead_key, md5(concat('partner|', c_custkey)) AS partner_key, md5(concat('nation|', n_name)) AS nation_key, o_orderstatus FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_custkey % 7 <> 0 LEFT JOIN nation ON c_nationkey = n_nationkey")
def factorize_lead(spark, d):
    cust = table(spark, d, "customer").where("c_custkey % 7 <> 0").select("c_custkey", "c_nationkey")
    o = table(spark, d, "orders").join(cust, c("o_custkey") == c("c_custkey"), "left").join(op.small(table(spark, d, "nation")), c("c_nationkey") == c("n_nationkey"), "left")
    key = lambda kind, x: F.md5(F.concat(F.lit(kind + "|"), F.coalesce(c(x).cast("string"), F.lit(""))))  # noqa: E731  as concat of the SQL side skips NULL
    return o.select(key("lead", "o_orderkey").alias("lead_key"), key("partner", "c_custkey").alias("partner_key"), key("nation", "n_name").alias("nation_key"), "o_orderstatus")


@query("C24_cross_source_dedupe", f"SELECT source, c_custkey, CASE WHEN n = 1 THEN 'create' WHEN content = before THEN 'skip' ELSE 'update' END AS action FROM (SELECT *, row_number() OVER w AS n, lag(content) OVER w AS before FROM (SELECT 'a' AS source, c_custkey, md5(c_name) AS content FROM customer UNION ALL SELECT 'b', c_custkey, md5(c_name) FROM ({CHANGED})) WINDOW w AS (PARTITION BY c_custkey ORDER BY source))")
def cross_source_dedupe(spark, d):
    new, _ = versions(spark, d)
    both = table(spark, d, "customer").select(F.lit("a").alias("source"), "c_custkey", F.md5("c_name").alias("content")).union(new.select(F.lit("b"), "c_custkey", F.md5("c_name")))
    return op.cross_source(both, "c_custkey", "content", ["source"]).select("source", "c_custkey", "action")


@query("W5_detect_changes", f"SELECT coalesce(s.c_custkey, t.c_custkey) AS c_custkey, CASE WHEN t.c_custkey IS NULL THEN 'create' WHEN s.c_custkey IS NULL THEN 'absent' WHEN md5('c_name:' || s.c_name || '|c_nationkey:' || s.c_nationkey) = md5('c_name:' || t.c_name || '|c_nationkey:' || t.c_nationkey) THEN 'skip' ELSE 'update' END AS action FROM ({CHANGED}) s FULL JOIN (SELECT * FROM customer WHERE c_custkey % 5 <> 0) t ON s.c_custkey = t.c_custkey")
def detect_changes(spark, d):
    h = lambda x: keys.content_hash({"c_name": c("c_name"), "c_nationkey": c("c_nationkey")})
    new, old = versions(spark, d)
    s, t = new.select("c_custkey", h(new).alias("hs")), old.select("c_custkey", h(old).alias("ht"))
    action = F.when(c("ht").isNull(), "create").when(c("hs").isNull(), "absent").when(c("hs") == c("ht"), "skip").otherwise("update")
    return s.join(t, "c_custkey", "full_outer").select("c_custkey", action.alias("action"))


@query("P6_resolve_relations", f"{KEYMAP} SELECT o_orderkey, coalesce(target_id, CAST(o_custkey AS VARCHAR)) AS partner, CASE WHEN target_id IS NULL THEN 'quarantined' WHEN o_orderkey % 2 = 0 THEN 'update' ELSE 'create' END AS action FROM orders LEFT JOIN keymap ON CAST(o_custkey AS VARCHAR) = source_key")
def resolve_relations(spark, d):
    """Parents first: orders get their partner's target id; known orders update, others create, and
    those without a partner are quarantined. A dry run stops at these labels."""
    o = table(spark, d, "orders").select("o_orderkey", c("o_custkey").cast("string").alias("partner"))
    known = o.where("o_orderkey % 2 = 0").select("o_orderkey", F.lit(True).alias("known"))
    r = op.resolve_fk(o, keymap(spark, d), "partner", "res.partner").join(known, "o_orderkey", "left")
    return r.select("o_orderkey", "partner", F.when(~c("partner").startswith("partner_"), "quarantined").when(c("known"), "update").otherwise("create").alias("action"))
