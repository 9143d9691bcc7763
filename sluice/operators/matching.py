"""Columns of a lake matched to a catalogue of fields, by joins (C25-C34, D22-D28)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

#: Catalogue types that a profiled type may go to.
COMPATIBLE = {
    "integer": ("integer", "float", "monetary", "char", "text", "many2one"),
    "float": ("float", "monetary", "char", "text"),
    "boolean": ("boolean", "selection", "char", "text"),
    "date": ("date", "datetime", "char", "text"),
    "string": ("char", "text", "selection", "many2one", "one2many", "many2many", "html", "binary", "reference"),
}
#: Words of headers, counted as metadata where they stand in a first line.
METADATA = r"exported|generated|report date|created on|©|copyright"


def exact_name(cols: DataFrame, kb: DataFrame) -> DataFrame:
    """The header is a field's name (1.0), or model and name together (0.95)."""
    h = text.slug(F.col("header"))
    c = cols.select("col_id", h.alias("h"))
    own = c.join(kb, F.col("h") == F.col("field")).select("col_id", "model", "field", F.lit(1.0).alias("confidence"))
    both = c.join(kb, F.col("h") == F.concat_ws("_", text.slug(F.col("model")), "field")).select("col_id", "model", "field", F.lit(0.95).alias("confidence"))
    return own.union(both).withColumn("strategy", F.lit("exact"))


def label(cols: DataFrame, kb: DataFrame) -> DataFrame:
    """Equal normalized labels."""
    k = kb.withColumn("l", text.normalize_header(F.col("label")))
    return cols.join(k, text.normalize_header(F.col("header")) == F.col("l")).select("col_id", "model", "field", F.lit(0.98).alias("confidence"), F.lit("label").alias("strategy"))


def tokens(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text.normalize_header(c), " "), lambda t: t != ""))


def context(cols: DataFrame, kb: DataFrame, least: float = 0.3) -> DataFrame:
    """Token Jaccard of header and field name, for pairs that share a token, by an equi join on tokens;
    0.85 of it is the confidence."""
    c = cols.select("col_id", tokens(F.col("header")).alias("ct"))
    k = kb.select("model", "field", tokens(F.col("field")).alias("kt"))
    shared = c.withColumn("t", F.explode("ct")).join(k.withColumn("t", F.explode("kt")), "t").groupBy("col_id", "model", "field").agg(F.count("*").alias("n"), F.first(F.size("ct")).alias("nc"), F.first(F.size("kt")).alias("nk"))
    score = F.col("n") / (F.col("nc") + F.col("nk") - F.col("n"))
    return shared.withColumn("s", score).where(F.col("s") >= least).select("col_id", "model", "field", F.round(F.col("s") * 0.85, 6).alias("confidence"), F.lit("context").alias("strategy"))


def merge_candidates(found: DataFrame) -> DataFrame:
    """The best confidence of a field, and up to 0.1 more for further strategies."""
    g = found.groupBy("col_id", "model", "field").agg(F.max("confidence").alias("best"), F.countDistinct("strategy").alias("n"), F.array_join(F.array_sort(F.collect_set("strategy")), ",").alias("strategies"))
    return g.select("col_id", "model", "field", "strategies", F.round(F.least(F.lit(1.0), F.col("best") + F.least(F.lit(0.1), (F.col("n") - 1) * 0.03)), 6).alias("confidence"))


def model_priority(merged: DataFrame, hint: Column, wanted: Column) -> DataFrame:
    """Confidence times 2 or 0.3 by a hint of the header, else times 1.5 or 0.5 by the context; 1 at most."""
    factor = F.when(hint.isNotNull(), F.when(F.col("model") == hint, 2.0).otherwise(0.3)).when(wanted.isNotNull(), F.when(F.col("model") == wanted, 1.5).otherwise(0.5)).otherwise(1.0)
    return merged.withColumn("confidence", F.round(F.least(F.lit(1.0), F.col("confidence") * factor), 6))


def top_candidates(merged: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("col_id").orderBy(F.desc("confidence"), "model", "field")
    return merged.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def header_scores(lines: DataFrame) -> DataFrame:
    """(file, line, values) rows to their scores as a header; values are text or NULL."""
    v = F.filter("values", lambda x: x.isNotNull())
    n, share = F.size(v), F.size(v) / F.size("values")
    mean = F.try_divide(F.aggregate(v, F.lit(0), lambda a, x: a + F.length(x)), n)
    unique = F.try_divide(F.size(F.array_distinct(F.transform(v, F.lower))), n)
    score = F.when(share > 0.8, 40).when(share > 0.5, 20).when(share < 0.1, -50).otherwise(0)
    score += F.when(n > 0, 30).otherwise(-20)
    score += F.when(n == 0, 0).when(mean.between(5, 50), 20).when(mean > 100, -20).when(mean < 3, -10).otherwise(0)
    score -= F.when(F.rlike(F.lower(F.array_join(v, " ")), F.lit(METADATA)), 40).otherwise(0)
    score += F.when(n == 0, 0).when(unique > 0.9, 15).when(unique < 0.5, -15).otherwise(0)
    score += F.when(F.col("line") == 0, 10).when(F.col("line") == 1, 5).when(F.col("line") > 5, -10).otherwise(0)
    return lines.withColumn("score", score)


def promote_header(lines: DataFrame, first: int = 10, accept: int = 50) -> DataFrame:
    """(file, header_line, header): the best of the first lines of each file, line 0 if none is accepted."""
    s = header_scores(lines.where(F.col("line") < first))
    best = s.groupBy("file").agg(F.max(F.struct("score", (-F.col("line")).alias("l"), "values")).alias("b"), F.min_by("values", "line").alias("v0"))
    ok = F.col("b.score") >= accept
    header = F.transform(F.when(ok, F.col("b.values")).otherwise(F.col("v0")), lambda x, i: F.coalesce(x, F.concat(F.lit("Column_"), i.cast("string"))))
    return best.select("file", F.when(ok, -F.col("b.l")).otherwise(0).cast("int").alias("header_line"), F.array_join(header, ",").alias("header"))


def evaluate(predicted: DataFrame, truth: DataFrame, by: str) -> DataFrame:
    """accuracy, precision and recall of predictions per case."""
    both = truth.join(predicted.select("col_id", F.col("model").alias("pm"), F.col("field").alias("pf")), "col_id", "left")
    hit = F.count_if((F.col("pm") == F.col("model")) & (F.col("pf") == F.col("field")))
    made, n = F.count("pf"), F.count(F.lit(1))
    return both.groupBy(by).agg(n.alias("n"), F.round(hit / n, 6).alias("accuracy"), F.round(F.coalesce(F.try_divide(hit, made), F.lit(0.0)), 6).alias("precision"), F.round(hit / n, 6).alias("recall"))


def _padded(c: str) -> Column:
    return F.concat(F.lit(" "), F.col(c), F.lit(" "))


def runs(c: Column, most: int) -> Column:
    """Every run of at most `most` consecutive words of a normalized text."""
    words, size = F.split(c, " "), F.size(F.split(c, " "))
    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), size), lambda i: F.transform(F.sequence(i, F.least(size, i + most - 1)), lambda j: F.array_join(F.slice(words, i, j - i + 1), " ")))))


def best_match(cols: DataFrame, kb: DataFrame) -> DataFrame:
    """The best field of each header: 1.0 for its name, 0.8 where one holds the other's words in a row,
    else the share of the header's words that the field has; ties go to the first model and field.
    Headers that share no word with any field give no row."""
    c = cols.select("col_id", text.normalize_header(F.col("header")).alias("h"), tokens(F.col("header")).alias("ct"))
    k = kb.select("model", "field", text.normalize_header(F.col("field")).alias("f"), tokens(F.col("field")).alias("kt"))
    met = c.withColumn("t", F.explode("ct")).join(k.withColumn("t", F.explode("kt")), "t")
    share = met.groupBy("col_id", "h", "model", "field", "f").agg((F.count("*") / F.first(F.size("ct"))).alias("s"))
    within = F.contains(_padded("h"), _padded("f")) | F.contains(_padded("f"), _padded("h"))
    scored = share.withColumn("confidence", F.when(F.col("h") == F.col("f"), 1.0).when(within, 0.8).otherwise(F.round("s", 6)))
    best = scored.groupBy("col_id").agg(F.min(F.struct((-F.col("confidence")).alias("neg"), "model", "field")).alias("b"))
    return best.select("col_id", "b.model", "b.field", (-F.col("b.neg")).alias("confidence"))


def hybrid(cols: DataFrame, kb: DataFrame, patterns: DataFrame) -> DataFrame:
    """The first of five tiers that hits, then the first model and field: the field's name (1.0), a known
    header of patterns (pattern, model, field) as it is (1.0) or as words in a row of the header (0.90),
    the label (0.95), model and name together (0.90). Headers without a hit give no row."""
    known = patterns.select(text.normalize_header(F.col("pattern")).alias("p"), "model", "field").where("p <> ''").distinct()
    h = cols.select("col_id", text.normalize_header(F.col("header")).alias("h"))
    longest = known.agg(F.max(F.size(F.split("p", " ")))).first()[0] or 1
    exact, part = h.join(known, F.col("h") == F.col("p")), h.withColumn("p", F.explode(runs(F.col("h"), longest))).join(known, "p")
    name = exact_name(cols, kb)
    tiers = [("field_name", 1.0, name.where("confidence = 1.0")), ("pattern", 1.0, exact), ("substring", 0.9, part), ("label", 0.95, label(cols, kb)), ("compound", 0.9, name.where("confidence < 1.0"))]
    hits = [t.select("col_id", F.lit(i).alias("tier"), "model", "field", F.lit(conf).alias("confidence"), F.lit(method).alias("method")) for i, (method, conf, t) in enumerate(tiers)]
    best = reduce(DataFrame.union, hits).groupBy("col_id").agg(F.min(F.struct("tier", "model", "field", "confidence", "method")).alias("b"))
    return best.select("col_id", "b.model", "b.field", "b.confidence", "b.method")
