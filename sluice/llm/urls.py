"""URL filters: given rules first, then association rules mined by FP-growth (operator 4)."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checked_broadcast, saved, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path).
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
BAD = "label=bad"
MIN_SUPPORT, MIN_CONFIDENCE, MIN_LIFT = 0.002, 0.6, 2.0
#: A rule must hold for at least this many labelled urls, however few there are.
MIN_ROWS = 20


def host_of(url: Column) -> Column:
    """After the first ://, up to /, ?, # or the end, A-Z lower-cased; '' without one."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def given_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; nulls where none does."""
    rule = verdict = F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is tested first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def tokens(host: Column, path: Column) -> Column:
    """Distinct host labels, the last two of them together, and path segments without digits."""
    labels = F.split(host, r"\.")
    segments = F.filter(F.split(F.translate(path, UPPER, LOWER), "/"), lambda s: s != "")
    parts = F.concat(
        F.transform(F.filter(labels, lambda s: s != ""), lambda s: F.concat(F.lit("h="), s)),
        F.array(F.concat(F.lit("host="), host), F.concat(F.lit("depth="), F.least(F.size(segments), F.lit(6)).cast("string"))),
        F.transform(segments, lambda s: F.concat(F.lit("p="), F.regexp_replace(s, r"[0-9]+", "0"))),
    )
    return F.array_distinct(parts)


def mined_rules(pages: DataFrame, labels: DataFrame, support: float = MIN_SUPPORT, confidence: float = MIN_CONFIDENCE, lift: float = MIN_LIFT) -> DataFrame:
    """Rules (rule_id, n_tokens, token): token sets that FP-growth finds to imply a bad label.

    A labelled url is bad if its quality is 0 or it is toxic. All labelled urls are transactions;
    rules below the support, the confidence or the lift are pruned, and so is a rule that holds all
    tokens of a shorter kept one.
    """
    bad = F.when((F.max(F.coalesce(F.col("toxic"), F.lit(0))) == 1) | (F.min(F.coalesce(F.col("quality"), F.lit(1))) == 0), F.array(F.lit(BAD))).otherwise(F.array().cast("array<string>"))
    marks = labels.groupBy(F.col("doc_id").alias("page_id")).agg(bad.alias("mark"))
    baskets = saved(pages.join(marks, "page_id").select(F.concat("tokens", "mark").alias("items")), "url-baskets")
    spark, empty = pages.sparkSession, "rule_id long, n_tokens int, token string"
    n = baskets.count()
    if n < MIN_ROWS:
        return spark.createDataFrame([], empty)
    found = FPGrowth(itemsCol="items", minSupport=max(support, MIN_ROWS / n), minConfidence=confidence).fit(baskets).associationRules
    found = found.where((F.element_at("consequent", 1) == BAD) & (F.size("consequent") == 1) & (F.col("lift") >= lift))
    found = saved(found.select(F.xxhash64(F.array_sort("antecedent")).alias("rule_id"), F.size("antecedent").alias("n_tokens"), F.array_sort("antecedent").alias("tokens")), "url-rules")
    each = found.select("rule_id", "n_tokens", F.explode("tokens").alias("token"))
    small = each.select(F.col("rule_id").alias("by"), F.col("n_tokens").alias("of"), "token")
    shadowed = each.join(small, "token").where("of < n_tokens").groupBy("rule_id", "by", "of").count().where("count = of").select("rule_id").distinct()
    return saved(each.join(shadowed, "rule_id", "left_anti"), "url-index")


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, **how) -> DataFrame:
    """page_id, host, path, rule, verdict and n_mined of every url.

    The longest given rule that fits decides; else a url is blocked if all tokens of a mined rule
    are among its own, and allowed if not. The rules' inverted index (token to rules) is joined once
    per distinct host and path, so a hot url costs one lookup. Null urls and urls without :// have
    host and path '' and are allowed; pages that repeat a page_id are judged each; null page_ids
    stay; without labels nothing is mined.
    """
    url = F.col("url").cast("string")
    p = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    mined = mined_rules(p.withColumn("tokens", tokens(F.col("host"), F.col("path"))), labels, **how)
    rule, verdict = given_rule(F.col("host"), F.col("path"), rules)
    p = p.withColumn("rule", rule).withColumn("given", verdict)
    # Tokens come from the host and the digit-free path alone: one lookup for each such shape.
    p = p.withColumn("shape", F.regexp_replace(F.translate("path", UPPER, LOWER), r"[0-9]+", "0"))
    shapes = saved(p.where("given IS NULL").select("host", "shape").distinct(), "url-shapes")
    hits = shapes.withColumn("token", F.explode(tokens(F.col("host"), F.col("shape")))).join(checked_broadcast(mined), "token")
    hits = hits.groupBy("host", "shape", "rule_id").agg(F.count("*").alias("n"), F.first("n_tokens").alias("n_tokens")).where("n = n_tokens").groupBy("host", "shape").agg(F.count("*").alias("n_mined"))
    hits = saved(hits, "url-hits")
    p = p.join(checked_broadcast(hits), ["host", "shape"], "left")
    return p.select("page_id", "host", "path", "rule", F.coalesce("given", F.when(F.col("n_mined") > 0, "block").otherwise("allow")).alias("verdict"), F.coalesce("n_mined", F.lit(0)).alias("n_mined"))


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
