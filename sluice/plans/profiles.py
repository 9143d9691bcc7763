"""Queries of profiling, summaries and integrity counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers
from ..operators import profile as op
from ..operators import reshape
from ..sources.shared import stored
from .registry import PARTNERS, partners, query, table
from .reshape import CLEAN_SQL, KINDS, LABELLED, labelled
from .scalars import date as date_sql
from .scalars import decimal, null, phone, trim

c = F.col
COLUMNS = ["name", "email", "phone", "money", "day", "flag", "zip"]


def each(select: str, columns=COLUMNS, source: str = "partners", cte: str = PARTNERS) -> str:
    """The SQL of a select per column, `{c}` standing for it."""
    return f"{cte} " + " UNION ALL ".join(f"SELECT '{x}' AS \"column\", {select.replace('{c}', x)} FROM {source}" for x in columns)


@query("D1_profile_nulls", each("count(*) FILTER (WHERE {c} IS NULL) AS n_null, round(count(*) FILTER (WHERE {c} IS NULL) / count(*), 6) AS share", ["quality", "toxic", "rare"], "dl", LABELLED))
def profile_nulls(spark, d):
    return op.aggregate(labelled(spark, d), ["quality", "toxic", "rare"], {"n_null": lambda x: F.count_if(x.isNull()), "share": lambda x: F.round(F.count_if(x.isNull()) / F.count("*"), 6)})


LINE = ["l_partkey", "l_suppkey", "l_returnflag", "l_linestatus"]


@query("D2_profile_distinct", each("count(DISTINCT {c}) + CAST(count(*) FILTER (WHERE {c} IS NULL) > 0 AS INT) AS n_distinct", LINE, "lineitem", ""))
def profile_distinct(spark, d):
    return op.aggregate(table(spark, d, "lineitem"), LINE, {"n_distinct": lambda x: F.countDistinct(x) + F.max(x.isNull().cast("int"))})


@query("D3_uniqueness_ratio", each("round(count(DISTINCT {c}) / count({c}), 6) AS uniqueness", ["o_orderkey", "o_custkey", "o_orderstatus"], "orders", ""))
def uniqueness(spark, d):
    return op.aggregate(table(spark, d, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus"], {"uniqueness": lambda x: F.round(F.countDistinct(x) / F.count(x), 6)})


NUM = ["l_quantity", "l_extendedprice", "l_discount"]


@query("D4_numeric_stats", each("min({c}) AS min, max({c}) AS max, CAST(round(avg(CAST({c} AS DECIMAL(18,4))), 4) AS DOUBLE) AS mean, median({c}) AS median", NUM, "lineitem", ""))
def numeric_stats(spark, d):
    return op.aggregate(table(spark, d, "lineitem"), NUM, {"min": F.min, "max": F.max, "mean": lambda x: F.round(F.avg(x.cast("decimal(18,4)")), 4).cast("double"), "median": lambda x: F.percentile(x, F.lit(0.5))})


@query("D5_top_values", "SELECT p_brand AS value, count(*) AS n FROM part WHERE p_brand IS NOT NULL GROUP BY 1 ORDER BY n DESC, value LIMIT 100")
def top_values(spark, d):
    return op.top_values(table(spark, d, "part"), "p_brand")


@query("D6_sample_values", "SELECT array_to_string(list_slice(list_sort(list(DISTINCT p_brand)), 1, 10), ',') AS brands, array_to_string(list_slice(list_sort(list(DISTINCT p_type)), 1, 10), ',') AS types FROM part")
def sample_values(spark, d):
    return table(spark, d, "part").agg(*[F.array_join(F.slice(F.array_sort(F.collect_set(x)), 1, 10), ",").alias(y) for x, y in (("p_brand", "brands"), ("p_type", "types"))])


@query("D7_pattern_ratios", each(", ".join(f"round(count(*) FILTER (WHERE regexp_matches({{c}}, '{p}')) / count({{c}}), 6) AS {k}" for k, p in op.PATTERNS.items())))
def pattern_ratios(spark, d):
    return op.aggregate(partners(spark, d), COLUMNS, {k: (lambda x, p=p: op.ratio(F.rlike(x, F.lit(p)), x)) for k, p in op.PATTERNS.items()})


@query("D8_pattern_ratios_strict", f"{PARTNERS} SELECT round(count({phone('phone')}) / count(phone), 6) AS phone, round(count({decimal('money')}) / count(money), 6) AS currency FROM partners")
def pattern_ratios_strict(spark, d):
    return partners(spark, d).agg(op.parse_ratios(c("phone"))["phone"].alias("phone"), op.parse_ratios(c("money"))["currency"].alias("currency"))


BOOLS = ", ".join(f"'{b}'" for b in op.BOOLS)


@query("D9_infer_type_sampled", "SELECT * FROM (" + each(f"CASE WHEN bool_and(lower({{c}}) IN ({BOOLS})) THEN 'boolean' WHEN (SELECT avg(CASE WHEN {date_sql('v')} IS NOT NULL THEN 1 ELSE 0 END) FROM (SELECT {{c}} AS v FROM partners WHERE {{c}} IS NOT NULL ORDER BY id LIMIT 10)) > 0.7 THEN 'date' WHEN (SELECT avg(CASE WHEN {decimal('v')} IS NOT NULL THEN 1 ELSE 0 END) FROM (SELECT {{c}} AS v FROM partners WHERE {{c}} IS NOT NULL ORDER BY id LIMIT 10)) > 0.7 THEN 'currency' ELSE 'string' END AS type", ["day", "zip", "source_ptr"]) + ")")
def infer_type_sampled(spark, d):
    p = partners(spark, d)
    parts = [op.sampled_type(p, x, "id") for x in ("day", "zip", "source_ptr")]
    return parts[0].union(parts[1]).union(parts[2])


TYPES = f"CASE WHEN count({{c}}) = 0 THEN 'null' WHEN bool_and(lower({{c}}) IN ({BOOLS})) THEN 'boolean' WHEN bool_and(regexp_full_match({{c}}, '[+-]?\\d+')) THEN 'integer' WHEN bool_and(regexp_matches({{c}}, '{numbers.NUMBER}')) THEN 'float' WHEN bool_and({date_sql('{c}')} IS NOT NULL) THEN 'date' ELSE 'string' END AS type"
TYPED = "WITH o AS (SELECT CAST(o_orderkey AS VARCHAR) AS a, o_orderstatus AS b, strftime(o_orderdate, '%Y-%m-%d') AS c, CASE WHEN o_orderkey % 2 = 0 THEN 'Y' ELSE 'no' END AS d, CAST(o_orderkey AS VARCHAR) || '.5' AS e, CAST(NULL AS VARCHAR) AS f FROM orders)"


@query("D10_infer_type_full", each(TYPES, list("abcdef"), "o", TYPED))
def infer_type_full(spark, d):
    k = c("o_orderkey")
    o = table(spark, d, "orders").select(k.cast("string").alias("a"), c("o_orderstatus").alias("b"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("c"), F.when(k % 2 == 0, "Y").otherwise("no").alias("d"), F.concat(k.cast("string"), F.lit(".5")).alias("e"), F.lit(None).cast("string").alias("f"))
    return op.inferred_types(o, list("abcdef"))


def _p(k: str) -> str:
    return f"round(count(*) FILTER (WHERE regexp_matches({{c}}, '{op.PATTERNS[k]}')) / count({{c}}), 6)"


PROFILED = "count(*) AS n, count(*) FILTER (WHERE {c} IS NULL) AS n_null, count(DISTINCT {c}) AS n_distinct, round(count(DISTINCT {c}) / count({c}), 6) AS uniqueness, " + TYPES + ", min(length({c})) AS min_length, max(length({c})) AS max_length, {num}, " + ", ".join(f"CASE WHEN {_p(k)} >= 0.2 THEN {_p(k)} END AS p_{k}" for k in ("email", "phone", "url", "currency")) + f", CASE WHEN greatest({_p('date_iso')}, {_p('date_us')}, {_p('date_eu')}) >= 0.2 THEN greatest({_p('date_iso')}, {_p('date_us')}, {_p('date_eu')}) END AS p_date"
MEDIAN = "median(CAST({c} AS DOUBLE)) AS median"
NO_STATS = "CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max, CAST(NULL AS DOUBLE) AS mean"
STATS = "min(CAST({c} AS DOUBLE)) AS min, max(CAST({c} AS DOUBLE)) AS max, CAST(round(avg(CAST({c} AS DECIMAL(18,4))), 4) AS DOUBLE) AS mean"
PROFILE = each(PROFILED.replace("{num}", NO_STATS))
TOP = "(SELECT string_agg(v || '=' || k, ';' ORDER BY k DESC, v) FROM (SELECT {c} AS v, count(*) AS k FROM partners WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY k DESC, v LIMIT 5)) AS top, (SELECT string_agg(v, ';' ORDER BY v) FROM (SELECT DISTINCT {c} AS v FROM partners WHERE {c} IS NOT NULL ORDER BY v LIMIT 10)) AS sample"


@query("D11_profile_table", each(PROFILED.replace("{num}", NO_STATS) + ", " + TOP))
def profile_table(spark, d):
    top = F.array_join(F.transform("top", lambda t: F.concat(t["value"], F.lit("="), t["n"])), ";")
    return op.profile(partners(spark, d), COLUMNS, top=5).withColumns({"top": F.when(F.size("top") > 0, top), "sample": F.when(F.size("sample") > 0, F.array_join("sample", ";"))})


NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
TEXTS = ["l_returnflag", "l_linestatus", "l_shipdate"]
LINES = "WITH l AS (SELECT " + ", ".join(f"CAST({x} AS VARCHAR) AS {x}" for x in NUMBERS + TEXTS) + " FROM lineitem)"


@query("D11_profile_lineitem", each(PROFILED.replace("{num}", f"{STATS}, {MEDIAN}"), NUMBERS, "l", LINES) + " UNION ALL " + each(PROFILED.replace("{num}", f"{NO_STATS}, CAST(NULL AS DOUBLE) AS median"), TEXTS, "l", ""))
def profile_lineitem(spark, d):
    return op.profile(table(spark, d, "lineitem"), NUMBERS + TEXTS, median=True)


@query("D12_profile_lengths", each("min(length({c})) AS min_length, max(length({c})) AS max_length, round(avg(length({c})), 6) AS mean_length", ["p_name", "p_brand", "p_type"], "part", ""))
def profile_lengths(spark, d):
    return op.aggregate(table(spark, d, "part"), ["p_name", "p_brand", "p_type"], {"min_length": lambda x: F.min(F.length(x)), "max_length": lambda x: F.max(F.length(x)), "mean_length": lambda x: F.round(F.avg(F.length(x)), 6)})


@query("D13_suggest_field_type", "WITH " + PROFILE.removeprefix("WITH ").replace(" SELECT 'name' AS", ", prof AS (SELECT 'name' AS", 1) + """) SELECT "column", kind AS field_type, CASE WHEN kind = 'Char' THEN CASE WHEN coalesce(p_email, 0) > 0.8 THEN 255 WHEN coalesce(p_phone, 0) > 0.8 THEN 32 ELSE least(greatest(max_length + 50, 64), 255) END END AS size, n_null / n < 0.1 AS required
FROM (SELECT *, CASE WHEN coalesce(p_email, 0) > 0.8 THEN 'Char' WHEN coalesce(p_phone, 0) > 0.8 THEN 'Char' WHEN coalesce(p_currency, 0) > 0.8 THEN 'Monetary' WHEN type = 'boolean' THEN 'Boolean' WHEN type = 'date' THEN 'Date'
WHEN n_distinct / n < 0.05 AND n_distinct <= 10 THEN 'Selection' WHEN type = 'integer' THEN 'Integer' WHEN type = 'float' THEN 'Float' WHEN max_length > 255 THEN 'Text' ELSE 'Char' END AS kind FROM prof)""")
def suggest_field_type(spark, d):
    return op.suggest_field(op.profile(partners(spark, d), COLUMNS))


@query("D14_duplicates", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id HAVING count(*) > 1")
def duplicates(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n")).where("n > 1")


@query("D15_duplicate_natural_keys", "SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL HAVING count(*) > 1")
def duplicate_natural_keys(spark, d):
    return table(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n")).where("n > 1")


@query("D16_reconcile_counts", "SELECT (SELECT count(*) FROM orders) AS staged, (SELECT count(*) FROM orders WHERE o_orderstatus <> 'P') AS canonical, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS difference, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') = 0 AS equal")
def reconcile_counts(spark, d):
    o = table(spark, d, "orders")
    return o.agg(F.count("*").alias("staged"), F.count_if(c("o_orderstatus") != "P").alias("canonical")).withColumn("difference", c("staged") - c("canonical")).withColumn("equal", c("difference") == 0)


@query("D17_account_for_rows", "SELECT o_orderpriority AS batch, count(*) AS processed, count(*) FILTER (WHERE o_orderstatus = 'F') AS created, count(*) FILTER (WHERE o_orderstatus = 'O') AS matched, count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O')) AS quarantined, true AS balanced FROM orders GROUP BY 1")
def account_for_rows(spark, d):
    action = F.when(c("o_orderstatus") == "F", "created").when(c("o_orderstatus") == "O", "matched").otherwise("quarantined")
    o = table(spark, d, "orders").groupBy(c("o_orderpriority").alias("batch")).agg(F.count("*").alias("processed"), *[F.count_if(action == a).alias(a) for a in ("created", "matched", "quarantined")])
    return o.withColumn("balanced", c("created") + c("matched") + c("quarantined") == c("processed"))


RULES = {"discount": "l_discount <= 0.05", "quantity": "l_quantity > 0", "flag": "l_returnflag IN ('A', 'N')"}


@query("D18_violation_counts", " UNION ALL ".join(f"SELECT '{k}' AS rule, count(*) FILTER (WHERE NOT ({r})) AS n, count(*) FILTER (WHERE NOT ({r})) = 0 AS passed FROM lineitem" for k, r in RULES.items()))
def violation_counts(spark, d):
    row = table(spark, d, "lineitem").agg(*[F.count_if(~F.expr(r)).alias(k) for k, r in RULES.items()])
    return row.select(F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), c(k).alias("n")) for k in RULES])).alias("r")).select("r.rule", "r.n", (c("r.n") == 0).alias("passed"))


@query("D19_validation_summary", "WITH v AS (" + " UNION ALL ".join(f"SELECT '{k}' AS rule, count(*) FILTER (WHERE NOT ({r})) AS n FROM lineitem" for k, r in RULES.items()) + ") SELECT count(*) AS checks, count(*) FILTER (WHERE n = 0) AS passed, round(count(*) FILTER (WHERE n = 0) / count(*), 6) AS pass_rate, string_agg(CASE WHEN n > 0 THEN rule END, ',' ORDER BY rule) AS failing FROM v")
def validation_summary(spark, d):
    v = violation_counts(spark, d)
    return v.agg(F.count("*").alias("checks"), F.count_if("passed").alias("passed"), F.round(F.count_if("passed") / F.count("*"), 6).alias("pass_rate"), F.array_join(F.array_sort(F.collect_list(F.when(~c("passed"), c("rule")))), ",").alias("failing"))


@query("D21_quarantine_stats", "SELECT coalesce(event_type, 'all') AS reason, CASE WHEN grouping(model) = 1 THEN 'all' ELSE model END AS model, count(*) AS total, count(*) FILTER (WHERE value > 50) AS pending, count(*) FILTER (WHERE NOT value > 50) AS resolved FROM (SELECT *, CASE WHEN user_id % 2 = 0 THEN 'lead' ELSE 'partner' END AS model FROM events) GROUP BY GROUPING SETS ((event_type), (model), ())".replace("coalesce(event_type, 'all')", "CASE WHEN grouping(event_type) = 1 THEN 'all' ELSE event_type END"))
def quarantine_stats(spark, d):
    e = table(spark, d, "events").withColumn("model", F.when(c("user_id") % 2 == 0, "lead").otherwise("partner"))
    g = e.groupingSets([["event_type"], ["model"], []], "event_type", "model").agg(F.grouping("event_type").alias("ge"), F.grouping("model").alias("gm"), F.count("*").alias("total"), F.count_if(c("value") > 50).alias("pending"), F.count_if(~(c("value") > 50)).alias("resolved"))
    return g.select(F.when(c("ge") == 1, "all").otherwise(c("event_type")).alias("reason"), F.when(c("gm") == 1, "all").otherwise(c("model")).alias("model"), "total", "pending", "resolved")


@query("D32_cleaning_report", each("0 AS x", [], "").strip() + " " + " UNION ALL ".join(f"SELECT '{k}' AS \"column\", count(*) FILTER (WHERE {k} IS DISTINCT FROM {null(s)}) AS changed FROM partners" for k, s in CLEAN_SQL.items()))
def cleaning_report(spark, d):
    p = partners(spark, d).select("id", *KINDS)
    return op.cleaning_report(p, reshape.clean_by_profile(p, KINDS), "id", list(KINDS))


CATEGORIES = (("timeout", "network"), ("denied", "access"), ("null", "data"))
MESSAGE = "concat(event_type, CASE event_id % 4 WHEN 0 THEN ' timeout' WHEN 1 THEN ' denied' WHEN 2 THEN ' null value' ELSE ' odd' END)"


@query("D34_error_categories", f"SELECT CASE {' '.join(f"WHEN contains({MESSAGE}, '{w}') THEN '{k}'" for w, k in CATEGORIES)} ELSE 'other' END AS category, count(*) AS n FROM events GROUP BY 1")
def error_categories(spark, d):
    m = F.expr(MESSAGE)
    category = F.lit("other")
    for word, name in reversed(CATEGORIES):
        category = F.when(F.contains(m, F.lit(word)), name).otherwise(category)
    return table(spark, d, "events").groupBy(category.alias("category")).agg(F.count("*").alias("n"))


@query("P1_profile_and_clean", f"{PARTNERS} SELECT id, {', '.join(f'{null(s)} AS {k}' for k, s in CLEAN_SQL.items() if k in ('name', 'phone', 'day'))} FROM partners".replace(CLEAN_SQL["day"], f"coalesce(strftime({date_sql('day')}, '%Y-%m-%d'), {trim('day')})"))
def profile_and_clean(spark, d):
    """The profile decides the cleaners: a pattern over 0.3 names the kind, else text is trimmed."""
    p = stored(partners(spark, d).select("id", "name", "phone", "day"), "raw")
    found = {r["column"]: r for r in op.profile(p, ["name", "phone", "day"]).collect()}
    kinds = {k: "phone" if (r["p_phone"] or 0) > 0.3 and k == "phone" else "date" if (r["p_date"] or 0) > 0.2 else "text" for k, r in found.items()}
    return stored(reshape.clean_by_profile(p, kinds), "cleaned")
