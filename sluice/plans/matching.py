"""Queries of schema matching. The lake's columns and the catalogue's fields are made from `part`: a
part is a column of the table of its brand, and every third part a field of the model of its type."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import matching as op
from ..operators.resolve import small
from ..sources.shared import stored
from .registry import query, table
from .scalars import _header, slug, trim

c = F.col

COL = {"col_id": "p_partkey", "tab": "p_brand", "header": "CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN concat(upper(p_name), ' (x)') WHEN 2 THEN concat(p_type, ' ', p_name) WHEN 3 THEN concat(p_name, ' qty') ELSE concat('old-', p_name) END"}
KB = {"model": "p_type", "field": "replace(p_name, ' ', '_')", "label": "p_name"}
BASE = f"WITH cols AS (SELECT {', '.join(f'{e} AS {k}' for k, e in COL.items())} FROM part), kb AS (SELECT DISTINCT {', '.join(f'{e} AS {k}' for k, e in KB.items())} FROM part WHERE p_partkey % 3 = 0)"


def cols(spark, d):
    return table(spark, d, "part").selectExpr(*[f"{e} AS {k}" for k, e in COL.items()])


def kb(spark, d):
    return table(spark, d, "part").where("p_partkey % 3 = 0").selectExpr(*[f"{e} AS {k}" for k, e in KB.items()]).distinct()


EXACT = f"SELECT col_id, model, field, 1.0 AS confidence, 'exact' AS strategy FROM cols JOIN kb ON {slug('header')} = field UNION ALL SELECT col_id, model, field, 0.95, 'exact' FROM cols JOIN kb ON {slug('header')} = concat_ws('_', {slug('model')}, field)"
LABEL = f"SELECT col_id, model, field, 0.98 AS confidence, 'label' AS strategy FROM cols JOIN kb ON {_header('header')} = {_header('label')}"
TOK = "list_distinct([t FOR t IN string_split({}, ' ') IF t <> ''])"
SHARED = f"SELECT col_id, model, field, len(list_intersect(ct, kt)) AS n, len(ct) AS nc, len(kt) AS nk FROM (SELECT col_id, {TOK.format(_header('header'))} AS ct FROM cols) JOIN (SELECT model, field, {TOK.format(_header('field'))} AS kt FROM kb) ON len(list_intersect(ct, kt)) > 0"
CONTEXT = f"SELECT col_id, model, field, round(n / (nc + nk - n) * 0.85, 6) AS confidence, 'context' AS strategy FROM ({SHARED}) WHERE n / (nc + nk - n) >= 0.3"


@query("C25_match_exact_name", f"{BASE} {EXACT}")
def match_exact_name(spark, d):
    return op.exact_name(cols(spark, d), kb(spark, d))


@query("C27_match_selection_values", "WITH v AS (SELECT DISTINCT o_orderpriority AS col, o_orderstatus AS val FROM orders), s AS (SELECT DISTINCT l_returnflag AS field, l_linestatus AS val FROM lineitem), nv AS (SELECT col, count(*) AS n FROM v GROUP BY 1), ns AS (SELECT field, count(*) AS n FROM s GROUP BY 1) SELECT col, field, round(0.7 * count(*) / any_value(nv.n) + 0.3 * count(*) / any_value(ns.n), 6) AS confidence FROM v JOIN s USING (val) JOIN nv USING (col) JOIN ns USING (field) GROUP BY col, field HAVING count(*) / any_value(nv.n) >= 0.5")
def match_selection_values(spark, d):
    v = table(spark, d, "orders").select(c("o_orderpriority").alias("col"), c("o_orderstatus").alias("val")).distinct()
    s = table(spark, d, "lineitem").select(c("l_returnflag").alias("field"), c("l_linestatus").alias("val")).distinct()
    n = v.join(s, "val").groupBy("col", "field").agg(F.count("*").alias("n"))
    n = n.join(v.groupBy("col").agg(F.count("*").alias("nv")), "col").join(s.groupBy("field").agg(F.count("*").alias("ns")), "field")
    return n.where(c("n") / c("nv") >= 0.5).select("col", "field", F.round(0.7 * c("n") / c("nv") + 0.3 * c("n") / c("ns"), 6).alias("confidence"))


#: Headers known for a field: the name, for parts of even size with an x after it.
KNOWN = {"pattern": "CASE WHEN p_size % 2 = 0 THEN concat(p_name, ' (x)') ELSE p_name END", "model": "p_type", "field": "replace(p_name, ' ', '_')"}
TIERS = (
    f"SELECT col_id, model, field, 1.0 AS confidence, 'field_name' AS method, 1 AS tier FROM cols JOIN kb ON {slug('header')} = field"
    " UNION ALL SELECT col_id, model, field, 1.0, 'pattern', 2 FROM h JOIN known ON h = p"
    " UNION ALL SELECT col_id, model, field, 0.9, 'substring', 3 FROM h JOIN known ON contains(' ' || h || ' ', ' ' || p || ' ')"
    f" UNION ALL SELECT col_id, model, field, 0.95, 'label', 4 FROM cols JOIN kb ON {_header('header')} = {_header('label')}"
    f" UNION ALL SELECT col_id, model, field, 0.9, 'compound', 5 FROM cols JOIN kb ON {slug('header')} = concat_ws('_', {slug('model')}, field)"
)
HYBRID = f", h AS (SELECT col_id, {_header('header')} AS h FROM cols), known AS (SELECT DISTINCT {_header('pattern')} AS p, model, field FROM (SELECT {', '.join(f'{e} AS {k}' for k, e in KNOWN.items())} FROM part)) SELECT col_id, model, field, CAST(confidence AS DOUBLE) AS confidence, method FROM (SELECT *, row_number() OVER (PARTITION BY col_id ORDER BY tier, model, field) AS n FROM ({TIERS})) WHERE n = 1"


@query("C33_match_hybrid", f"{BASE} {HYBRID}")
def match_hybrid(spark, d):
    known = table(spark, d, "part").selectExpr(*[f"{e} AS {k}" for k, e in KNOWN.items()])
    return op.hybrid(cols(spark, d), kb(spark, d), known)


SCORED = f"SELECT col_id, model, field, CASE WHEN h = f THEN 1.0 WHEN contains(' ' || h || ' ', ' ' || f || ' ') OR contains(' ' || f || ' ', ' ' || h || ' ') THEN 0.8 ELSE round(len(list_intersect(ct, kt)) / len(ct), 6) END AS confidence FROM (SELECT col_id, {_header('header')} AS h, {TOK.format(_header('header'))} AS ct FROM cols) JOIN (SELECT model, field, {_header('field')} AS f, {TOK.format(_header('field'))} AS kt FROM kb) ON len(list_intersect(ct, kt)) > 0"
BEST = f"SELECT col_id, model, field, confidence FROM (SELECT *, row_number() OVER (PARTITION BY col_id ORDER BY confidence DESC, model, field) AS r FROM ({SCORED})) WHERE r = 1"


@query("C34_best_match", f"{BASE} {BEST}")
def best_match(spark, d):
    return op.best_match(cols(spark, d), kb(spark, d))


FOUND = f"found AS ({EXACT} UNION ALL {LABEL} UNION ALL {CONTEXT}), merged AS (SELECT col_id, model, field, string_agg(DISTINCT strategy, ',' ORDER BY strategy) AS strategies, round(least(1.0, max(confidence) + least(0.1, (count(DISTINCT strategy) - 1) * 0.03)), 6) AS confidence FROM found GROUP BY col_id, model, field)"


def merged(spark, d):
    x, k = stored(cols(spark, d), "columns"), stored(kb(spark, d), "fields")
    return op.merge_candidates(op.exact_name(x, k).unionByName(op.label(x, k)).unionByName(op.context(x, k)))


@query("D22_merge_candidates", f"{BASE}, {FOUND} SELECT * FROM merged")
def merge_candidates(spark, d):
    return merged(spark, d)


PRIORITY = "prior AS (SELECT col_id, model, field, round(least(1.0, confidence * CASE WHEN col_id % 5 = 2 THEN CASE WHEN model = 'ECONOMY' THEN 2.0 ELSE 0.3 END WHEN model = 'PROMO' THEN 1.5 ELSE 0.5 END), 6) AS confidence FROM merged)"


def prior(spark, d):
    return op.model_priority(merged(spark, d), F.when(c("col_id") % 5 == 2, "ECONOMY"), F.lit("PROMO")).select("col_id", "model", "field", "confidence")


RANKED = "ranked AS (SELECT *, row_number() OVER (PARTITION BY col_id ORDER BY confidence DESC, model, field) AS rank FROM prior)"


@query("E4_top_k_candidates", f"{BASE}, {FOUND}, {PRIORITY}, {RANKED} SELECT * FROM ranked WHERE rank <= 10")
def top_k_candidates(spark, d):
    return op.top_candidates(prior(spark, d), 10)


@query("F5_rank_candidates", f"{BASE}, {FOUND} SELECT col_id, model, field, confidence FROM merged WHERE confidence >= 0.98 ORDER BY confidence DESC, col_id, model, field")
def rank_candidates(spark, d):
    return merged(spark, d).where("confidence >= 0.98").select("col_id", "model", "field", "confidence").orderBy(F.desc("confidence"), "col_id", "model", "field")


@query("D35_evaluate_mapping", f"{BASE}, {FOUND}, {PRIORITY}, {RANKED} SELECT tab, count(*) AS n, round(count(*) FILTER (WHERE m = model AND f = field) / count(*), 6) AS accuracy, round(coalesce(count(*) FILTER (WHERE m = model AND f = field) / nullif(count(field), 0), 0), 6) AS precision, round(count(*) FILTER (WHERE m = model AND f = field) / count(*), 6) AS recall FROM (SELECT p_partkey, p_brand AS tab, p_type AS m, replace(p_name, ' ', '_') AS f FROM part) t LEFT JOIN (SELECT * FROM ranked WHERE rank = 1) r ON t.p_partkey = r.col_id GROUP BY tab")
def evaluate_mapping(spark, d):
    truth = table(spark, d, "part").selectExpr("p_partkey AS col_id", "p_brand AS tab", "p_type AS model", "replace(p_name, ' ', '_') AS field")
    return op.evaluate(op.top_candidates(prior(spark, d), 1), truth, "tab")


# Signatures over the words of a table's headers.
SIGNATURES = {"jewel": (["ring"], ["gold|silver", "small"]), "tool": (["widget|bolt|gear"], ["red", "blue|green"])}


@query("D26_detect_entities", " UNION ALL ".join(f"SELECT p_brand AS tab, '{k}' AS entity, round(least(1.0, {' * '.join(f"CAST(bool_or(regexp_matches(p_name, '{r}')) AS INT)" for r in req)} + 0.2 * ({' + '.join(f"CAST(bool_or(regexp_matches(p_name, '{o}')) AS INT)" for o in opt)}) / {len(opt)}), 6) AS score FROM part GROUP BY p_brand HAVING {' AND '.join(f"bool_or(regexp_matches(p_name, '{r}'))" for r in req)}" for k, (req, opt) in SIGNATURES.items()))
def detect_entities(spark, d):
    """All signatures in one aggregation over headers, per table."""
    hit = lambda p: F.bool_or(F.rlike("p_name", F.lit(p)))
    out = []
    for entity, (req, opt) in SIGNATURES.items():
        required, share = F.lit(True), F.lit(0.0)
        for r in req:
            required = required & hit(r)
        for o in opt:
            share = share + hit(o).cast("int")
        out.append(F.struct(F.lit(entity).alias("entity"), F.when(required, F.round(F.least(F.lit(1.0), 1 + 0.2 * share / len(opt)), 6)).alias("score")))
    return table(spark, d, "part").groupBy(c("p_brand").alias("tab")).agg(F.array(*out).alias("e")).select("tab", F.explode("e").alias("e")).select("tab", "e.*").where("score IS NOT NULL")


LINES = """WITH lines AS (SELECT c_nationkey AS file, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) + 1 AS line, [CAST(c_custkey AS VARCHAR), c_name, NULL, 'x'] AS vals FROM customer
UNION ALL SELECT n_nationkey, 0, CASE WHEN n_nationkey % 2 = 0 THEN ['Exported on Monday', NULL, NULL, NULL] ELSE ['Id', 'Full name', 'Remarks here', 'Kind'] END FROM nation
UNION ALL SELECT n_nationkey, 1, CASE WHEN n_nationkey % 2 = 0 THEN ['Customer id', 'Full name', NULL, 'Kind of it'] ELSE ['1', 'a', 'b', 'c'] END FROM nation)"""
SCORED = f"""{LINES}, v AS (SELECT *, [x FOR x IN vals IF x IS NOT NULL] AS v FROM lines WHERE line < 10), s AS (SELECT *, CASE WHEN len(v) / 4 > 0.8 THEN 40 WHEN len(v) / 4 > 0.5 THEN 20 WHEN len(v) / 4 < 0.1 THEN -50 ELSE 0 END + CASE WHEN len(v) > 0 THEN 30 ELSE -20 END
+ CASE WHEN len(v) = 0 THEN 0 WHEN length(array_to_string(v, '')) / len(v) BETWEEN 5 AND 50 THEN 20 WHEN length(array_to_string(v, '')) / len(v) > 100 THEN -20 WHEN length(array_to_string(v, '')) / len(v) < 3 THEN -10 ELSE 0 END
- CASE WHEN regexp_matches(lower(array_to_string(v, ' ')), '{op.METADATA}') THEN 40 ELSE 0 END + CASE WHEN len(v) = 0 THEN 0 WHEN len(list_distinct([lower(x) FOR x IN v])) / len(v) > 0.9 THEN 15 WHEN len(list_distinct([lower(x) FOR x IN v])) / len(v) < 0.5 THEN -15 ELSE 0 END
+ CASE WHEN line = 0 THEN 10 WHEN line = 1 THEN 5 WHEN line > 5 THEN -10 ELSE 0 END AS score FROM v), b AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY score DESC, line) AS n FROM s)"""


@query("B6_promote_header", f"{SCORED} SELECT file, CAST(CASE WHEN score >= 50 THEN line ELSE 0 END AS INTEGER) AS header_line, array_to_string([coalesce(vals[i], 'Column_' || (i - 1)) FOR i IN range(1, 5)], ',') AS header FROM b WHERE n = 1")
def promote_header(spark, d):
    from pyspark.sql import Window

    n = table(spark, d, "nation")
    none = F.lit(None).cast("string")
    array = lambda *xs: F.array(*[none if x is None else F.lit(x) for x in xs])
    even = c("n_nationkey") % 2 == 0
    data = table(spark, d, "customer").select(c("c_nationkey").alias("file"), (F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")) + 1).alias("line"), F.array(c("c_custkey").cast("string"), c("c_name"), none, F.lit("x")).alias("values"))
    top = n.select(c("n_nationkey").alias("file"), F.lit(0).alias("line"), F.when(even, array("Exported on Monday", None, None, None)).otherwise(array("Id", "Full name", "Remarks here", "Kind")).alias("values"))
    second = n.select(c("n_nationkey").alias("file"), F.lit(1).alias("line"), F.when(even, array("Customer id", "Full name", None, "Kind of it")).otherwise(array("1", "a", "b", "c")).alias("values"))
    return op.promote_header(data.union(top).union(second))


ISO = [("FRANCE", "FR", "FRA"), ("GERMANY", "DE", "DEU"), ("UNITED STATES", "US", "USA"), ("UNITED KINGDOM", "GB", "GBR"), ("JAPAN", "JP", "JPN"), ("CANADA", "CA", "CAN"), ("BRAZIL", "BR", "BRA"), ("CHINA", "CN", "CHN")]
ISO_SQL = f"iso(name, a2, a3) AS (VALUES {', '.join(map(str, ISO))})"
GIVEN = "CASE c_custkey % 4 WHEN 0 THEN n_name WHEN 1 THEN lower(n_name) WHEN 2 THEN substr(n_name, 1, 2) ELSE concat(' ', n_name, ' ') END"


@query("S37_parse_country", f"WITH {ISO_SQL}, k AS (SELECT name AS key, a2 FROM iso UNION ALL SELECT a2, a2 FROM iso UNION ALL SELECT a3, a2 FROM iso) SELECT c_custkey, a2 AS code FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN k ON upper({trim(GIVEN)}) = k.key")
def parse_country(spark, d):
    iso = spark.createDataFrame([(k, r[1]) for r in ISO for k in r], "key string, code string")
    given = table(spark, d, "customer").join(small(table(spark, d, "nation")), c("c_nationkey") == c("n_nationkey")).select("c_custkey", F.upper(text.trim(F.expr(GIVEN))).alias("g"))
    return given.join(F.broadcast(iso), c("g") == c("key"), "left").select("c_custkey", "code")


STATES = [("US", "CA", "California"), ("US", "NY", "New York"), ("CA", "QC", "Quebec"), ("CA", "ON", "Ontario")]
STATE = "CASE c_custkey % 5 WHEN 0 THEN 'ca' WHEN 1 THEN 'New York' WHEN 2 THEN 'queb' WHEN 3 THEN ' ON' ELSE 'nowhere' END"


@query("S38_parse_state", f"WITH st(country, code, name) AS (VALUES {', '.join(map(str, STATES))}), g AS (SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN 'US' ELSE 'CA' END AS country, upper({trim(STATE)}) AS s FROM customer) SELECT c_custkey, (SELECT arg_min(code, CASE WHEN s = st.code THEN 1 WHEN s = upper(st.name) THEN 2 ELSE 3 END) FROM st WHERE st.country = g.country AND (s = st.code OR s = upper(st.name) OR contains(upper(st.name), s))) AS code FROM g")
def parse_state(spark, d):
    st = spark.createDataFrame(STATES, "country string, code string, name string")
    g = table(spark, d, "customer").select("c_custkey", F.when(c("c_nationkey") % 2 == 0, "US").otherwise("CA").alias("country"), F.upper(text.trim(F.expr(STATE))).alias("s"))
    name = F.upper("name")
    tier = F.when(c("s") == c("code"), 1).when(c("s") == name, 2).when(F.contains(name, c("s")), 3)
    hits = g.join(F.broadcast(st), "country").withColumn("tier", tier).where("tier IS NOT NULL").groupBy("c_custkey").agg(F.min_by("code", "tier").alias("code"))
    return g.select("c_custkey").join(hits, "c_custkey", "left")


REL_HEADER = "CASE p_size % 4 WHEN 0 THEN concat(replace(p_name, ' ', '_'), '_id') WHEN 1 THEN concat(replace(p_name, ' ', '_'), '_', p_size) WHEN 2 THEN concat(replace(p_name, ' ', '_'), '_tags') ELSE p_name END"


@query("D27_detect_relationships", f"SELECT p_brand AS tab, kind, confidence, target, count(*) AS n FROM (SELECT p_brand, CASE WHEN regexp_matches(h, '_id$') THEN 'many2one' WHEN regexp_matches(h, '_\\d+$') THEN 'one2many' WHEN regexp_matches(h, '_tags$') THEN 'many2many' END AS kind, CASE WHEN regexp_matches(h, '_id$') THEN 0.8 WHEN regexp_matches(h, '_\\d+$') THEN 0.9 WHEN regexp_matches(h, '_tags$') THEN 0.7 END AS confidence, regexp_replace(h, '_(id|tags|\\d+)$', '') AS target FROM (SELECT p_brand, {REL_HEADER} AS h FROM part)) WHERE kind IS NOT NULL GROUP BY ALL")
def detect_relationships(spark, d):
    h = F.expr(REL_HEADER)
    pick = lambda *v: F.when(F.rlike(h, F.lit("_id$")), v[0]).when(F.rlike(h, F.lit(r"_\d+$")), v[1]).when(F.rlike(h, F.lit("_tags$")), v[2])
    r = table(spark, d, "part").select(c("p_brand").alias("tab"), pick("many2one", "one2many", "many2many").alias("kind"), pick(0.8, 0.9, 0.7).alias("confidence"), F.regexp_replace(h, r"_(id|tags|\d+)$", "").alias("target"))
    return r.where("kind IS NOT NULL").groupBy("tab", "kind", "confidence", "target").agg(F.count("*").alias("n"))


ANCHORS = {"click": "page", "purchase": "order", "view": "page", "signup": "partner", "error": "log"}
ROUTED = "concat('res.', event_type)"


@query("D29_detect_polymorphic", f"SELECT grp, round(CASE WHEN n_models >= 2 THEN 0.3 ELSE 0.15 END + 0.4 * known + 0.2 * numeric_ids + 0.1, 6) AS confidence, top_model, CASE WHEN CASE WHEN n_models >= 2 THEN 0.3 ELSE 0.15 END + 0.4 * known + 0.2 * numeric_ids + 0.1 < 0.75 OR n_models > 2 THEN true ELSE false END AS confirm FROM (SELECT user_id % 10 AS grp, count(DISTINCT event_type) AS n_models, count(*) FILTER (WHERE contains({ROUTED}, '.') AND event_type IN ('click', 'purchase')) / count(*) AS known, count(*) FILTER (WHERE regexp_matches(CAST(event_id AS VARCHAR), '^[0-9]+$')) / count(*) AS numeric_ids FROM events GROUP BY 1) JOIN (SELECT grp, top_model FROM (SELECT user_id % 10 AS grp, event_type AS top_model, row_number() OVER (PARTITION BY user_id % 10 ORDER BY count(*) DESC, event_type) AS r FROM events GROUP BY 1, 2) WHERE r = 1) USING (grp)")
def detect_polymorphic(spark, d):
    """A model and an id column per group: how many models, how many known, how many numeric ids."""
    e = table(spark, d, "events").withColumn("grp", c("user_id") % 10).withColumn("model", F.expr(ROUTED))
    per = e.groupBy("grp", "event_type").agg(F.count("*").alias("n"), F.count_if(F.contains("model", F.lit(".")) & c("event_type").isin("click", "purchase")).alias("k"), F.count_if(F.rlike(c("event_id").cast("string"), F.lit("^[0-9]+$"))).alias("i"))
    g = per.groupBy("grp").agg(F.count("*").alias("n_models"), (F.sum("k") / F.sum("n")).alias("known"), (F.sum("i") / F.sum("n")).alias("ids"), F.min(F.struct((-c("n")).alias("neg"), "event_type")).alias("b"))
    score = F.when(c("n_models") >= 2, 0.3).otherwise(0.15) + 0.4 * c("known") + 0.2 * c("ids") + 0.1
    return g.select("grp", F.round(score, 6).alias("confidence"), c("b.event_type").alias("top_model"), ((score < 0.75) | (c("n_models") > 2)).alias("confirm"))
