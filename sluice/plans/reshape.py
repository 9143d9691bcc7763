"""Queries of sources, sinks, projections and reshaping."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import keys, text
from ..operators import reshape as op
from ..sources import csvio
from ..sources.shared import fresh_path, stored
from .registry import PARTNERS, partners, query, table
from .scalars import boolean, gsub, null, slug, title, trim
from .scalars import date as date_sql
from .scalars import decimal as decimal_sql
from .scalars import phone as phone_sql

c = F.col


@query("A1_read_csv", "SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer")
def read_csv(spark, d):
    path = fresh_path(spark, "csv")
    csvio.write_csv(table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment"), path)
    return csvio.read_csv(spark, path, {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_mktsegment": "string"})


@query("A2_read_csv_raw", "SELECT CAST(n_nationkey AS VARCHAR) AS column_1, n_name AS column_2 FROM nation UNION ALL SELECT 'n_nationkey', 'n_name'")
def read_csv_raw(spark, d):
    path = fresh_path(spark, "csv")
    csvio.write_csv(table(spark, d, "nation").select("n_nationkey", "n_name").coalesce(1), path)
    return csvio.read_csv_raw(spark, path, 2).select("column_1", "column_2")


@query("A3_read_all_string", "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, o_orderpriority FROM orders")
def all_string(spark, d):
    return csvio.all_string(table(spark, d, "orders").drop("o_totalprice"))


@query("A4_preview", "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 40")
def preview(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_orderstatus").orderBy("o_orderkey").offset(40).limit(20)


SEEDS = {"status": {"canonical": {"won": "stage_won", "open": "stage_open"}, "synonyms_map": {"F": "stage_won", "O": "stage_open"}}, "people": {"teams": {"canonical": {"sales": "team_sales"}, "synonyms_map": {"P": "team_sales"}}}}


@query("A5_load_seed", """WITH seeds(seed, alias, canonical_id, kind) AS (VALUES ('status','won','stage_won','canonical'),('status','open','stage_open','canonical'),('status','F','stage_won','synonym'),('status','O','stage_open','synonym'),('people_teams','sales','team_sales','canonical'),('people_teams','P','team_sales','synonym'))
SELECT s.seed, s.alias, s.canonical_id, s.kind, count(*) AS n_orders FROM orders o JOIN seeds s ON o.o_orderstatus = s.alias GROUP BY ALL""")
def load_seed(spark, d):
    seeds = csvio.seed_table(spark, SEEDS)
    return table(spark, d, "orders").join(F.broadcast(seeds), c("o_orderstatus") == c("alias")).groupBy("seed", "alias", "canonical_id", "kind").agg(F.count("*").alias("n_orders"))


@query("A6_emit_csv", f"{PARTNERS} SELECT 'partner_' || id AS id, coalesce(name, '') AS name, coalesce(email, '') AS email FROM partners")
def emit_csv(spark, d):
    path = fresh_path(spark, "emit")
    csvio.emit(partners(spark, d).withColumn("id", F.concat(F.lit("partner_"), "id")), ["id", "name", "email"], path, single=False)
    got = spark.read.csv(path, header=True, schema="id string, name string, email string", escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return got.na.fill("")


@query("A8_write_cleaned", f"{PARTNERS} SELECT id, nullif({trim('name')}, '') AS name FROM partners")
def write_cleaned(spark, d):
    return stored(partners(spark, d).select("id", text.empty_to_null(text.trim(c("name"))).alias("name")), "cleaned")


@query("A9_write_import_csv", "SELECT 'product.product' AS model, CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, p_brand FROM part")
def write_import_csv(spark, d):
    path = fresh_path(spark, "import")
    csvio.write_csv(table(spark, d, "part").select(F.lit("product.product").alias("model"), "p_partkey", "p_name", "p_brand"), path)
    return spark.read.csv(path, header=True, schema="model string, p_partkey string, p_name string, p_brand string")


@query("A10_to_records", """SELECT '{"model":"log","event_id":' || event_id || ',"user_id":' || user_id || CASE WHEN event_id % 3 = 0 THEN '' ELSE ',"event_type":"' || event_type || '"' END || '}' AS record FROM events""")
def to_records(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", F.when(c("event_id") % 3 != 0, c("event_type")).alias("event_type"))
    return csvio.to_records(e, "log")


@query("A11_append_exceptions", f"{PARTNERS} SELECT model, error_code, count(*) AS n FROM (SELECT CASE WHEN id % 2 = 0 THEN 'res.partner' ELSE 'crm.lead' END AS model, CASE WHEN name IS NULL THEN 'REQ_MISSING' ELSE 'INVALID_EMAIL' END AS error_code FROM partners WHERE name IS NULL OR email = 'not-an-email') GROUP BY ALL")
def append_exceptions(spark, d):
    path = fresh_path(spark, "exceptions")
    p = partners(spark, d).where("name IS NULL OR email = 'not-an-email'")
    bad = p.select("source_ptr", F.when(c("id") % 2 == 0, "res.partner").otherwise("crm.lead").alias("model"), F.when(c("name").isNull(), "REQ_MISSING").otherwise("INVALID_EMAIL").alias("error_code"))
    for model in ("res.partner", "crm.lead"):
        bad.where(c("model") == model).write.mode("append").partitionBy("model").parquet(path)
    return spark.read.parquet(path).groupBy("model", "error_code").agg(F.count("*").alias("n"))


@query("A12_export_lookup", "SELECT DISTINCT w AS source_key, 'migr.word.' || regexp_replace(w, '[^a-zA-Z0-9_.-]', '_', 'g') AS external_id FROM (SELECT trim(unnest(string_split(p_name, ' '))) AS w FROM part) WHERE w <> ''")
def export_lookup(spark, d):
    return csvio.export_lookup(table(spark, d, "part"), "p_name", " ", "word")


MAPPING = [
    {"source": "name", "target": "name", "transforms": ["trim", "title_case"]},
    {"source": "email", "target": "email", "transforms": ["email_normalize"]},
    {"source": "phone", "target": "phone", "transforms": ["phone_us"]},
    {"source": "zip", "target": "zip", "confirmed": False},
]


@query("B1_apply_mapping", f"{PARTNERS} SELECT source_ptr, {title(trim('name'))} AS name, CASE WHEN contains(coalesce(email, ''), '@') THEN lower({trim('email')}) ELSE '' END AS email, CASE WHEN length({gsub('phone', '[^0-9]')}) = 10 THEN '1' || {gsub('phone', '[^0-9]')} WHEN length({gsub('phone', '[^0-9]')}) = 11 AND starts_with({gsub('phone', '[^0-9]')}, '1') THEN {gsub('phone', '[^0-9]')} END AS phone, 'en_US' AS lang FROM partners")
def apply_mapping(spark, d):
    return op.apply_mapping(partners(spark, d), MAPPING, {"lang": "en_US", "name": "?"})


@query("B2_attach_row_ptr", "SELECT c_custkey, 'row_' || (row_number() OVER (ORDER BY c_custkey) - 1) AS source_ptr FROM customer")
def attach_row_ptr(spark, d):
    return op.attach_pointer(table(spark, d, "customer").select("c_custkey"), "c_custkey")


@query("B3_project_by_model", """SELECT 'res.partner' AS model, count(*) AS n, count(DISTINCT c_custkey) AS ids FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
UNION ALL SELECT 'sale.order', count(*), count(DISTINCT o_orderkey) FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
UNION ALL SELECT 'sale.order.line', count(*), count(DISTINCT l_partkey) FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey""")
def project_by_model(spark, d):
    wide = table(spark, d, "lineitem").join(table(spark, d, "orders"), c("l_orderkey") == c("o_orderkey")).join(table(spark, d, "customer"), c("o_custkey") == c("c_custkey"))
    parts = op.project_by_model(wide, {"res.partner": {"id": "c_custkey", "name": "c_name"}, "sale.order": {"id": "o_orderkey", "status": "o_orderstatus"}, "sale.order.line": {"id": "l_partkey", "qty": "l_quantity"}})
    counts = [t.agg(F.lit(m).alias("model"), F.count("*").alias("n"), F.countDistinct("id").alias("ids")) for m, t in parts.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("B7_clean_column_names", 'SELECT r_regionkey AS "Region Key", r_name AS "Name", r_name AS "Name_2", r_regionkey AS "Unnamed" FROM region')
def clean_column_names(spark, d):
    r = table(spark, d, "region").select("r_regionkey", "r_name", c("r_name").alias("b"), c("r_regionkey").alias("e"))
    return r.toDF(*op.clean_names(["Region   Key (int)", "Name*", " Na?me #", "??"]))


LABELLED = "WITH dl AS (SELECT d.doc_id, d.lang, d.source, l.quality, l.toxic, CASE WHEN d.doc_id % 50 = 0 THEN 1 END AS rare FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"


def labelled(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "source")
    return docs.join(table(spark, d, "labels"), "doc_id", "left").withColumn("rare", F.when(c("doc_id") % 50 == 0, 1))


@query("B9_drop_empty_columns", f"{LABELLED} SELECT doc_id, lang, source, quality, toxic FROM dl")
def drop_empty_columns(spark, d):
    return op.drop_empty_columns(labelled(spark, d), 0.95)


@query("B10_fill_default", f"{LABELLED} SELECT doc_id, coalesce(quality, -1) AS quality, coalesce(toxic, 0) AS toxic FROM dl")
def fill_default(spark, d):
    return op.fill_defaults(labelled(spark, d), {"quality": -1, "toxic": 0, "absent": 1}).select("doc_id", "quality", "toxic")


@query("B11_add_missing_columns", "SELECT r_name, CAST(NULL AS VARCHAR) AS code, r_regionkey FROM region")
def add_missing_columns(spark, d):
    return op.with_headers(table(spark, d, "region"), ["r_name", "code", "r_regionkey"])


RULE = "isset(o_orderstatus) and (o_orderstatus == 'F' or o_orderpriority == '1-URGENT') ? 'hot' : 'cold'"


@query("B12_apply_rule", "SELECT o_orderkey, CASE WHEN o_orderstatus IS NOT NULL AND (o_orderstatus = 'F' OR o_orderpriority = '1-URGENT') THEN 'hot' ELSE 'cold' END AS heat, coalesce(NULL, o_orderstatus) AS first FROM orders")
def apply_rule(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.expr(op.rule_expression(RULE)).alias("heat"), F.expr(op.rule_expression("or(null, o_orderstatus)")).alias("first"))


@query("B13_apply_field_rules", f"{PARTNERS} SELECT id, coalesce(phone, 'none') AS phone, CASE WHEN coalesce(phone, 'none') = 'none' THEN false ELSE true END AS reachable FROM partners")
def apply_field_rules(spark, d):
    return op.apply_rules(partners(spark, d).select("id", "phone"), {"phone": "none"}, {"reachable": "phone == 'none' ? false : true"})


@query("B14_remap_exact", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'waiting' ELSE o_orderstatus END AS status FROM orders")
def remap_exact(spark, d):
    return table(spark, d, "orders").select("o_orderkey", op.remap_exact(c("o_orderstatus"), [(1, "open", "waiting"), (5, "O", "open"), (3, "F", "done")]).alias("status"))


@query("B15_remap_pattern", r"SELECT p_partkey, CASE WHEN regexp_matches(p_brand, '^Brand#(\d)') THEN regexp_replace(p_brand, '^Brand#(\d)', 'B\1-', 'g') ELSE p_brand END AS brand FROM part")
def remap_pattern(spark, d):
    return table(spark, d, "part").select("p_partkey", op.remap_pattern(c("p_brand"), r"^Brand#(\d)", "B$1-").alias("brand"))


@query("B16_remap_lookup", "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'construction' WHEN 'MACHINERY' THEN 'industry' ELSE c_mktsegment END AS segment FROM customer")
def remap_lookup(spark, d):
    return table(spark, d, "customer").select("c_custkey", op.remap_lookup(c("c_mktsegment"), {"BUILDING": "construction", "MACHINERY": "industry"}).alias("segment"))


@query("B17_remap_presets", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'United States' WHEN o_orderkey % 3 = 1 THEN 'United Kingdom' ELSE 'FR' END AS country, CASE o_orderstatus WHEN 'F' THEN 'Closed Won' WHEN 'O' THEN 'New' ELSE 'Closed Lost' END AS stage FROM orders")
def remap_presets(spark, d):
    country = F.element_at(F.array(F.lit("USA"), F.lit("GB"), F.lit("FR")), (c("o_orderkey") % 3 + 1).cast("int"))
    stage = F.when(c("o_orderstatus") == "F", "Won").when(c("o_orderstatus") == "O", "Lead").otherwise("Lost")
    return table(spark, d, "orders").select("o_orderkey", op.remap_lookup(country, op.COUNTRY).alias("country"), op.remap_lookup(stage, op.STAGE).alias("stage"))


@query("B18_business_rule", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE NOT (l_quantity <= 45 AND l_linenumber < 7)")
def business_rule(spark, d):
    return op.violations(table(spark, d, "lineitem"), "l_quantity <= 45 AND l_linenumber < 7").select("l_orderkey", "l_linenumber", "l_quantity")


@query("B19_null_prune", f"{LABELLED} SELECT doc_id, quality, toxic, rare FROM dl WHERE coalesce(quality, toxic, rare) IS NOT NULL")
def null_prune(spark, d):
    return op.null_prune(labelled(spark, d), ["quality", "toxic", "rare"]).select("doc_id", "quality", "toxic", "rare")


@query("B20_select_modules", "SELECT event_id, event_type FROM events WHERE event_type IN (SELECT m FROM (VALUES ('web', 'click'), ('web', 'view'), ('shop', 'purchase')) g(g, m) WHERE g = 'web')")
def select_modules(spark, d):
    groups = spark.createDataFrame([("web", "click"), ("web", "view"), ("shop", "purchase")], "grp string, event_type string").where("grp = 'web'")
    return table(spark, d, "events").join(F.broadcast(groups), "event_type", "left_semi").select("event_id", "event_type")


@query("B21_split_by_company_flag", f"{PARTNERS} SELECT id, CASE WHEN nation < 10 THEN 'company' ELSE 'contact' END AS kind, nation >= 10 AND CASE WHEN nation < 20 THEN nation - 10 END IS NULL AS orphan FROM partners")
def split_by_company_flag(spark, d):
    p = partners(spark, d).withColumn("is_company", c("nation") < 10).withColumn("parent", F.when(c("nation").between(10, 19), c("nation") - 10))
    companies = p.where("is_company").select("id", F.lit("company").alias("kind"), F.lit(False).alias("orphan"))
    return companies.unionByName(p.where("NOT is_company").select("id", F.lit("contact").alias("kind"), c("parent").isNull().alias("orphan")))


@query("B22_confidence_tier", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity / 50 >= 0.7 THEN 'high' WHEN l_quantity / 50 >= 0.4 THEN 'medium' END AS tier FROM lineitem WHERE l_quantity / 50 >= 0.4")
def confidence_tier(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", op.confidence_tier(c("l_quantity") / 50).alias("tier")).where("tier IS NOT NULL")


@query("B23_auto_confirm", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity / 50 >= 0.7 THEN 'CONFIRMED' ELSE 'PENDING' END AS status, l_quantity / 50 >= 0.7 AS chosen FROM lineitem")
def auto_confirm(spark, d):
    sure = op.confidence_tier(c("l_quantity") / 50) == "high"
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(sure, "CONFIRMED").otherwise("PENDING").alias("status"), F.coalesce(sure, F.lit(False)).alias("chosen"))


KINDS = {"name": "text", "email": "email", "phone": "phone", "money": "currency", "day": "date", "flag": "boolean", "zip": "numeric"}
CLEAN_SQL = {"name": trim("name"), "email": f"lower({trim('email')})", "phone": f"coalesce({phone_sql('phone')}, phone)", "money": f"coalesce(CAST(CAST({decimal_sql('money')} AS DECIMAL(38,2)) AS VARCHAR), {gsub('money', r'[$€£¥₹,\s]')})", "day": f"coalesce(strftime({date_sql('day')}, '%Y-%m-%d'), {trim('day')})", "flag": f"coalesce(CAST({boolean('flag')} AS VARCHAR), flag)", "zip": gsub("zip", r"[^\d.-]")}


@query("B24_clean_by_profile", f"{PARTNERS} SELECT id, {', '.join(f'{null(s)} AS {k}' for k, s in CLEAN_SQL.items())} FROM partners")
def clean_by_profile(spark, d):
    return op.clean_by_profile(partners(spark, d).select("id", *KINDS), KINDS)


WIDE = "WITH wide AS (SELECT l_orderkey, " + ", ".join(f"max(CASE WHEN l_linenumber = {i} THEN l_partkey END) AS part_{i}, max(CASE WHEN l_linenumber = {i} AND l_returnflag <> 'N' THEN l_returnflag END) AS flag_{i}" for i in (1, 2, 3)) + " FROM lineitem GROUP BY l_orderkey)"


def wide_lines(spark, d):
    at = [(i, c("l_linenumber") == i) for i in (1, 2, 3)]
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(*[F.max(F.when(x, c("l_partkey"))).alias(f"part_{i}") for i, x in at], *[F.max(F.when(x & (c("l_returnflag") != "N"), c("l_returnflag"))).alias(f"flag_{i}") for i, x in at])


UNPIVOT = " UNION ALL ".join(f"SELECT l_orderkey, {i} AS sequence, part_{i} AS part, flag_{i} AS flag FROM wide WHERE part_{i} IS NOT NULL OR coalesce(flag_{i}, '') <> ''" for i in (1, 2, 3))


@query("B25_unpivot_groups", f"{WIDE} {UNPIVOT}")
def unpivot_groups(spark, d):
    return op.unpivot_groups(wide_lines(spark, d), ["l_orderkey"], [{"part": f"part_{i}", "flag": f"flag_{i}"} for i in (1, 2, 3)])


@query("E3_sequence_in_parent", f"{WIDE}, long AS ({UNPIVOT}) SELECT l_orderkey, part, row_number() OVER (PARTITION BY l_orderkey ORDER BY sequence) AS position FROM long WHERE part IS NOT NULL")
def sequence_in_parent(spark, d):
    return unpivot_groups(spark, d).where("part IS NOT NULL").select("l_orderkey", "part", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("sequence")).alias("position"))


@query("B27_polymorphic_route", "SELECT event_id, CASE WHEN contains(lower(event_type), 'click') THEN 'page' WHEN contains(lower(event_type), 'purchase') THEN 'order' ELSE 'unknown' END AS anchor FROM events")
def polymorphic_route(spark, d):
    return table(spark, d, "events").select("event_id", op.route(c("event_type"), {"click": "page", "purchase": "order"}).alias("anchor"))


@query("E1_dedupe_ids", "SELECT event_id, substr(CASE WHEN n = 1 THEN base ELSE base || '_' || n END, 1, 64) AS unique_id FROM (SELECT event_id, 'user_' || user_id AS base, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)")
def dedupe_ids(spark, d):
    return op.dedupe_ids(table(spark, d, "events").select("event_id", F.concat(F.lit("user_"), "user_id").alias("uid")), "uid", "event_id").select("event_id", "unique_id")


@query("E2_flag_duplicates", "SELECT event_id, 'DUP_EXT_ID' AS error_code FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) WHERE n > 1")
def flag_duplicates(spark, d):
    return op.dedupe_ids(table(spark, d, "events").select("event_id", F.concat(F.lit("user_"), "user_id").alias("uid")), "uid", "event_id").where("occurrence > 1").select("event_id", F.lit("DUP_EXT_ID").alias("error_code"))


@query("E6_line_index", "SELECT l_orderkey, l_linenumber, 'sol_so_' || l_orderkey || '_' || (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1) AS line_id FROM lineitem")
def line_index(spark, d):
    i = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber")) - 1
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", keys.line_id(F.concat(F.lit("SO-"), "l_orderkey"), i).alias("line_id"))


@query("F1_sort_by_id", f"{PARTNERS} SELECT id, {slug('name')} AS slug FROM partners ORDER BY slug, id")
def sort_by_id(spark, d):
    return partners(spark, d).select("id", text.slug(c("name")).alias("slug")).orderBy("slug", "id")


@query("F3_random_sample", "SELECT o_orderkey, o_custkey IS NULL AS no_key FROM orders ORDER BY md5(concat('s1:', o_orderkey)) LIMIT 100")
def random_sample(spark, d):
    return table(spark, d, "orders").select("o_orderkey", c("o_custkey").isNull().alias("no_key"), F.md5(F.concat(F.lit("s1:"), "o_orderkey")).alias("h")).orderBy("h").limit(100).drop("h")


@query("G4_columns_dropped", "SELECT p_name AS value, count(*) AS n FROM part WHERE p_name NOT IN (SELECT p_name FROM part WHERE p_partkey % 97 = 0) GROUP BY p_name")
def columns_dropped(spark, d):
    p = table(spark, d, "part")
    gone = p.select(c("p_name").alias("value")).subtract(p.where("p_partkey % 97 = 0").select("p_name"))
    return p.join(gone, c("p_name") == c("value"), "left_semi").groupBy(c("p_name").alias("value")).agg(F.count("*").alias("n"))


CHAIN = [("replace", {"find": "Brand", "replace": "b "}), "trim", "upper", ("add_prefix", {"prefix": "x-"})]


@query("J5_transform_chain", "SELECT p_partkey, 'x-' || upper(replace(p_brand, 'Brand', 'b ')) AS brand, array_to_string(['migr.w.' || w FOR w IN string_split(p_name, ' ')], ';') AS words FROM part")
def transform_chain(spark, d):
    words = op.transform_chain(c("p_name"), [("split", {"delimiter": " "}), ("map", {"table": "w"}), "join"])
    return table(spark, d, "part").select("p_partkey", op.transform_chain(c("p_brand"), CHAIN).alias("brand"), words.alias("words"))


@query("J1_lambda_column", f"{PARTNERS} SELECT id, upper(segment) || '-' || nation AS tag, TRY_CAST(nation * 2 AS INTEGER) AS doubled, coalesce(nullif(city, ''), 'nowhere') AS place FROM partners")
def lambda_column(spark, d):
    return partners(spark, d).selectExpr("id", "concat(upper(segment), '-', nation) AS tag", "try_cast(nation * 2 AS int) AS doubled", "coalesce(nullif(city, ''), 'nowhere') AS place")


@query("J1b_apply_field_mappings", f"{PARTNERS} SELECT id, name AS full_name, balance > 0 AS has_credit, length(coalesce(name, '')) AS name_length FROM partners")
def apply_field_mappings(spark, d):
    specs = [("full_name", "name"), ("has_credit", "balance > 0"), ("name_length", "length(coalesce(name, ''))")]
    return partners(spark, d).select("id", *[F.expr(e).alias(k) for k, e in specs])


@query("J2_remap_function", "SELECT p_partkey, CASE WHEN p_size > 5 THEN 'size ' || CAST(100 // (p_size - 5) AS VARCHAR) WHEN p_size < 5 THEN 'below' ELSE '5' END AS out FROM part")
def remap_function(spark, d):
    """A user function that fails on one of the sizes, which stays as it was."""

    def user(x: str) -> str:
        share = 100 // (int(x) - 5)
        return f"size {share}" if share >= 0 else "below"

    return table(spark, d, "part").select("p_partkey", op.remap_function(c("p_size").cast("string"), user).alias("out"))


@query("D36_filter_group_mean", "SELECT l_returnflag, CAST(round(avg(CAST(l_quantity AS DECIMAL(15,2))), 4) AS DOUBLE) AS mean FROM lineitem WHERE l_quantity > 10 GROUP BY l_returnflag")
def filter_group_mean(spark, d):
    return table(spark, d, "lineitem").where("l_quantity > 10").groupBy("l_returnflag").agg(F.round(F.avg(c("l_quantity").cast("decimal(15,2)")), 4).cast("double").alias("mean"))
