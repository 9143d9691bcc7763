"""Schema matching in full: candidate models of a table, eight strategies on the pairs of a column and a
field of a candidate model, merging, priority, ranks (C26-C32, D22-D25, P3).

columns: tab, col_id, header, data_type, uniqueness, min, max, p_email .. p_date, values array<string>.
fields: model, field, label, ttype, options array<string>.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .matching import COMPATIBLE
from .resolve import small

#: Confidence of a profiled type for a field's type; what is compatible otherwise has
#: 0.60 for char and text, else 0.50.
TYPE_SCORES = {
    ("integer", "integer"): 0.95, ("float", "float"): 0.95, ("float", "monetary"): 0.90, ("boolean", "boolean"): 0.95, ("date", "date"): 0.95, ("date", "datetime"): 0.90,
    ("integer", "float"): 0.85, ("integer", "many2one"): 0.80, ("string", "char"): 0.85, ("string", "text"): 0.85, ("string", "selection"): 0.80, ("string", "many2one"): 0.75,
}
#: Fields and types that a pattern of values is known for.
PATTERN_FIELDS = {
    "email": ("email", "email_from", "partner_email", "user_email"),
    "phone": ("phone", "mobile", "telephone", "partner_phone"),
    "url": ("website", "url", "website_url", "link"),
    "currency": ("amount", "price", "cost", "total", "subtotal", "value"),
    "date": ("date", "create_date", "write_date", "date_order", "date_deadline"),
}
PATTERN_TYPES = {"email": ("char",), "phone": ("char",), "url": ("char",), "currency": ("monetary", "float"), "date": ("date", "datetime")}
#: Beginnings of the names of fields that are unique, that have few values, that are shares.
UNIQUE, FEW, SHARES = ("id", "_id", "ref", "reference", "code", "sequence"), ("state", "status", "type", "stage", "category"), ("percent", "percentage", "rate", "ratio")
#: Models of a table about which nothing is known.
DEFAULT_MODELS = ("res.partner", "product.product", "sale.order", "account.move")
#: Words of a header without which a family of models is unlikely, and the factor.
FAMILIES = (("hr.", ("employee",), 0.2), ("stock.", ("stock", "inventory", "warehouse"), 0.4), ("project.", ("project", "task", "milestone"), 0.4))
HIGH, MEDIUM = 0.7, 0.4
#: Prefix matches and fuzzy matches of a column that count.
NEAREST = 10


def plain(c: Column) -> Column:
    """Lower case, what isn't a letter or digit of ASCII as one blank."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9\s]", " "), r"\s+", " "))


def squeezed(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]", "")


def _words(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(plain(F.translate(c, "_", " ")), " "), lambda t: t != ""))


def _jaccard(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def _within(a: Column, b: Column) -> Column:
    """Length of the shorter text over that of the longer, if it is part of it; else NULL."""
    n, m = F.length(a), F.length(b)
    return F.when(F.contains(a, b) | F.contains(b, a), F.coalesce(F.try_divide(F.least(n, m), F.greatest(n, m)), F.lit(0.0)))


def label_similarity(header: Column, label: Column) -> Column:
    """1 for equal labels, else the share that is contained, else Jaccard of the words."""
    a, b = plain(header), plain(label)
    return F.when(a == b, 1.0).otherwise(F.coalesce(_within(a, b), _jaccard(F.split(a, " "), F.split(b, " "))))


def name_similarity(header: Column, field: Column) -> Column:
    """The same on names without separators."""
    a, b = squeezed(header), squeezed(field)
    return F.when(a == b, 1.0).otherwise(F.coalesce(_within(a, b), _jaccard(_words(header), _words(field))))


def type_confidence(data_type: Column, ttype: Column) -> Column:
    """How well a profiled type fits a field's type; NULL where it doesn't."""
    pair = F.concat_ws(">", data_type, ttype)
    known = F.create_map(*[F.lit(x) for (a, b), s in TYPE_SCORES.items() for x in (f"{a}>{b}", s)])
    fits = pair.isin([f"{a}>{b}" for a, bs in COMPATIBLE.items() for b in bs])
    return F.when(fits, F.coalesce(F.try_element_at(known, pair), F.when(ttype.isin("char", "text"), 0.60).otherwise(0.50)))


def pattern_confidence(least: float = 0.7) -> Column:
    """From a column's pattern ratios: 0.8 of it for fields known by name, a fifth more if their type fits,
    and 0.6 for any field of a fitting type; NULL without a pattern of enough values."""
    found = []
    for p in PATTERN_FIELDS:
        r, named, fits = F.col(f"p_{p}"), F.col("field").isin(*PATTERN_FIELDS[p]), F.col("ttype").isin(*PATTERN_TYPES[p])
        found.append(F.when(r >= least, F.when(named, r * 0.8 * F.when(fits, 1.2).otherwise(1.0)).when(fits, r * 0.6)))
    return F.greatest(*found)


def statistics_confidence() -> Column:
    """From uniqueness and range: unique values for fields like ids, few values for fields like states,
    numbers from 0 to 100 for shares; NULL where none fits."""
    u = F.col("uniqueness")
    begins = lambda words: reduce(lambda a, b: a | b, [F.startswith("field", F.lit(w)) for w in words])
    unique = F.when((u >= 0.95) & begins(UNIQUE), 0.70 * u)
    few = F.when((u <= 0.1) & begins(FEW), 0.60 * (1 - u) * F.when(F.col("ttype") == "selection", 1.2).otherwise(1.0))
    share = F.when(F.col("data_type").isin("integer", "float") & F.col("min").between(0, 100) & F.col("max").between(0, 100) & begins(SHARES) & F.col("ttype").isin("float", "integer"), 0.55)
    return F.greatest(unique, few, share)


def selection_confidence() -> Column:
    """From the share of a column's values among a field's options, a half at least."""
    both = F.size(F.array_intersect("values", "options"))
    share = F.try_divide(both, F.size("values"))
    return F.when(share >= 0.5, 0.7 * share + 0.3 * F.try_divide(both, F.size("options")))


def sequence_ratio(a: str | Column, b: str | Column) -> Column:
    """Twice the matching characters over all characters, where matches are the longest common run, then
    those left and right of it, and so on; an Arrow function in which all pairs of a batch advance
    together. Of runs of one length the first in a, then in b, counts. NULL for a NULL."""
    return F.pandas_udf(_ratios, "double")(a, b)


def _ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    known = (a.notna() & b.notna()).to_numpy()
    out = np.full(len(a), np.nan)
    x, y = a[known].to_numpy(str), b[known].to_numpy(str)
    at = np.flatnonzero(known)
    order = np.argsort(np.char.str_len(x) + np.char.str_len(y), kind="stable")
    for i in range(0, len(order), 1000):
        some = order[i : i + 1000]
        out[at[some]] = _sequence(x[some], y[some])
    return pd.Series(out).astype(object).where(known, None).astype("float64")


def _sequence(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    def codes(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = np.char.str_len(t)
        return t.astype(f"U{max(1, int(n.max()))}").view(np.uint32).reshape(len(t), -1), n

    (a, n), (b, m) = codes(x), codes(y)
    matched = np.zeros(len(a), np.int64)
    # Stretches still to be compared: pair, begin and end in a, begin and end in b.
    todo = np.stack([np.arange(len(a)), np.zeros(len(a), int), n, np.zeros(len(a), int), m], axis=1)
    place = np.arange(b.shape[1])
    while len(todo := todo[(todo[:, 1] < todo[:, 2]) & (todo[:, 3] < todo[:, 4])]):
        pair, a0, a1, b0, b1 = todo.T
        allowed = (place >= b0[:, None]) & (place < b1[:, None])
        size = np.zeros(len(todo), np.int64)
        best_a, best_b = a0.copy(), b0.copy()
        run = np.zeros((len(todo), b.shape[1] + 1), np.int64)
        for step in range(int((a1 - a0).max())):
            i = a0 + step
            inside = i < a1
            same = allowed & (b[pair] == a[pair, np.minimum(i, a.shape[1] - 1)][:, None]) & inside[:, None]
            run[:, 1:] = np.where(same, run[:, :-1] + 1, 0)
            j = run[:, 1:].argmax(axis=1)
            longest = run[np.arange(len(todo)), j + 1]
            better = longest > size
            size[better] = longest[better]
            best_a[better], best_b[better] = (i - longest + 1)[better], (j - longest + 1)[better]
        np.add.at(matched, pair, size)
        hit = size > 0
        left = np.stack([pair, a0, best_a, b0, best_b], axis=1)[hit]
        right = np.stack([pair, best_a + size, a1, best_b + size, b1], axis=1)[hit]
        todo = np.concatenate([left, right])
    return np.where(n + m > 0, 2 * matched / np.maximum(n + m, 1), 1.0)


def fuzzy_similarity(pairs: DataFrame, a: str, b: str, name: str, least: float) -> DataFrame:
    """pairs with 0.5 x sequence ratio + 0.3 x Jaccard of words + 0.2 x contained share of two columns of
    plain text. The ratio, at most twice the shorter length over both, is found only where the sum can
    reach `least`; elsewhere the similarity is NULL."""
    x, y = F.col(a), F.col(b)
    rest = 0.3 * _jaccard(F.split(x, " "), F.split(y, " ")) + 0.2 * F.coalesce(_within(x, y), F.lit(0.0))
    most = F.try_divide(2 * F.least(F.length(x), F.length(y)), F.length(x) + F.length(y))
    asked = (x != "") & (y != "") & (0.5 * most + rest >= least - 1e-9)
    return pairs.withColumn(name, 0.5 * sequence_ratio(F.when(asked, x), F.when(asked, y)) + rest)


def candidates(tables: DataFrame, *found: DataFrame, selected: DataFrame | None = None) -> DataFrame:
    """(tab, model): the models that any source names for a table, of the selected ones if any are given;
    the default four for tables that are left without."""
    named = reduce(DataFrame.union, [f.select("tab", "model") for f in found]).distinct()
    if selected is not None:
        named = named.join(selected.select("model").distinct(), "model", "left_semi").select("tab", "model")
    bare = tables.select("tab").distinct().join(named.select("tab").distinct(), "tab", "left_anti")
    return named.union(bare.select("tab", F.explode(F.array(*map(F.lit, DEFAULT_MODELS))).alias("model")))


def pairs(columns: DataFrame, fields: DataFrame, models: DataFrame) -> DataFrame:
    """Every column with every field of the candidate models of its table; models that no table asks for
    take no part."""
    return columns.join(models, "tab").join(small(fields), "model")


def scored(found: DataFrame, strategy: str, confidence: Column) -> DataFrame:
    return found.withColumn("confidence", F.round(confidence, 6)).where("confidence IS NOT NULL").select("col_id", "model", "field", "confidence", F.lit(strategy).alias("strategy"))


def exact(found: DataFrame) -> DataFrame:
    """The header is the field's name (1.0), or model and name together (0.95)."""
    h = F.replace(plain(F.col("header")), F.lit(" "), F.lit("_"))
    both = F.concat_ws("_", F.translate("model", ".", "_"), "field")
    return scored(found, "exact", F.when(h == F.col("field"), 1.0).when(h == both, 0.95))


def label(found: DataFrame, few: int = 5) -> DataFrame:
    """Equal labels (0.98), and for columns with fewer than `few` of those the nearest labels that begin
    with the header (0.85 of the similarity)."""
    h, x = plain(F.col("header")), plain(F.col("label"))
    asked = found.withColumn("equal", h == x).where(F.col("equal") | (F.startswith(x, h) & (h != "")))
    asked = asked.withColumn("similarity", label_similarity(F.col("header"), F.col("label")))
    n = F.count_if("equal").over(Window.partitionBy("col_id"))
    near = F.row_number().over(Window.partitionBy("col_id", "equal").orderBy(F.desc("similarity"), "model", "field"))
    kept = asked.withColumns({"n": n, "near": near}).where(F.col("equal") | ((F.col("n") < few) & (F.col("near") <= NEAREST)))
    return scored(kept, "label", F.col("similarity") * F.when(F.col("equal"), 0.98).otherwise(0.85))


def label_join(columns: DataFrame, fields: DataFrame, few: int = 5) -> DataFrame:
    """label() over a whole catalogue, without candidate models: every beginning of a distinct label that
    ends with any of its characters is a row, so prefixes meet headers by an equi join."""
    names = fields.select(plain(F.col("label")).alias("l")).where("l <> ''").distinct()
    begins = names.select("l", F.explode(F.transform(F.sequence(F.lit(1), F.length("l")), lambda i: F.substring(F.col("l"), F.lit(1), i))).alias("h"))
    met = columns.select("col_id", "header", plain(F.col("header")).alias("h")).join(begins, "h")
    return label(met.join(fields.withColumn("l", plain(F.col("label"))), "l"), few)


def dtype(found: DataFrame) -> DataFrame:
    return scored(found, "type", type_confidence(F.col("data_type"), F.col("ttype")))


def pattern(found: DataFrame) -> DataFrame:
    return scored(found, "pattern", pattern_confidence())


def statistics(found: DataFrame) -> DataFrame:
    return scored(found, "statistics", statistics_confidence())


def selection(found: DataFrame) -> DataFrame:
    return scored(found, "selection", selection_confidence())


def context(found: DataFrame, least: float = 0.3) -> DataFrame:
    s = name_similarity(F.col("header"), F.col("field"))
    return scored(found.withColumn("s", s).where(F.col("s") >= least), "context", F.col("s") * 0.85)


def fuzzy(found: DataFrame, least: float = 0.6) -> DataFrame:
    """The better of the similarities to name and label; the ten nearest fields of a column."""
    x = found.withColumns({"h": plain(F.col("header")), "f": plain(F.translate("field", "_", " ")), "l": plain(F.col("label"))})
    x = fuzzy_similarity(fuzzy_similarity(x, "h", "f", "by_name", least), "h", "l", "by_label", least)
    x = x.withColumn("s", F.greatest("by_name", "by_label")).where(F.col("s") >= least)
    near = F.row_number().over(Window.partitionBy("col_id").orderBy(F.desc(F.round("s", 9)), "model", "field"))
    return scored(x.withColumn("near", near).where(F.col("near") <= NEAREST), "fuzzy", F.col("s") * 0.85)


STRATEGIES = (exact, label, selection, dtype, pattern, statistics, context, fuzzy)


def priority(merged: DataFrame, columns: DataFrame, models: DataFrame, hints: dict[str, str]) -> DataFrame:
    """Merged candidates with their confidence changed: twice or 0.3 of it by the model that the first word
    of a compound header names, else 1.5 times or half by the table's candidate models; and less again
    for families of models that the header doesn't speak of. 1 at most."""
    words = F.split(plain(F.translate("header", "_", " ")), " ")
    named = F.when(F.size(words) > 1, F.try_element_at(F.create_map(*[F.lit(x) for kv in hints.items() for x in kv]), words[0])) if hints else F.lit(None).cast("string")
    told = columns.select("col_id", "tab", F.lower("header").alias("h"), named.alias("hint"))
    known = models.select("tab", "model", F.lit(True).alias("in_context"))
    x = merged.join(told, "col_id").join(known, ["tab", "model"], "left")
    factor = F.when(F.col("hint").isNotNull(), F.when(F.col("model") == F.col("hint"), 2.0).otherwise(0.3)).otherwise(F.when(F.col("in_context"), 1.5).otherwise(0.5))
    family = F.lit(1.0)
    for prefix, words_, f in FAMILIES:
        family = F.when(F.startswith("model", F.lit(prefix)) & ~reduce(lambda a, b: a | b, [F.contains("h", F.lit(w)) for w in words_]), f).otherwise(family)
    return x.withColumn("confidence", F.round(F.least(F.lit(1.0), F.col("confidence") * factor) * family, 6)).select("col_id", "model", "field", "confidence")


def tiered(prioritized: DataFrame, k: int = 10) -> DataFrame:
    """(col_id, model, field, confidence, rank, tier): the k best viable candidates of each column."""
    viable = prioritized.where(F.col("confidence") >= MEDIUM)
    rank = F.row_number().over(Window.partitionBy("col_id").orderBy(F.desc("confidence"), "model", "field"))
    return viable.withColumn("rank", rank).where(F.col("rank") <= k).withColumn("tier", F.when(F.col("confidence") >= HIGH, "high").otherwise("medium"))


def domain_scores(columns: DataFrame, signatures: dict[str, dict]) -> DataFrame:
    """(tab, domain, score): half for the share of a domain's required words that a header matches, 0.15
    for optional ones, 0.15 for patterns of values, 0.2 if the table's name holds one of its words;
    contacts with a name and a way to reach them have 0.8. Scores of the domain's threshold and more.

    A header matches a word if one holds the other or they share a part. Each distinct header is met
    with all words, which are parameters, in one projection; what matched is counted per table."""
    vocabulary = sorted({w for s in signatures.values() for kind in ("required", "optional") for w in s[kind]} | {"name", "email", "phone", "street", "address", "city", "country"})
    h = F.replace(plain(F.translate("header", "_", " ")), F.lit(" "), F.lit("_"))
    part = F.split("h", "_")
    fits = lambda w: F.contains("h", w) | F.contains(w, F.col("h")) | F.arrays_overlap(F.split(w, "_"), part)
    heads = columns.select("tab", h.alias("h")).where("h <> ''").distinct()
    words = heads.select("tab", F.explode(F.filter(F.array(*map(F.lit, vocabulary)), fits)).alias("w")).groupBy("tab").agg(F.collect_set("w").alias("ws"))
    low, numeric = F.lower("header"), F.col("data_type").isin("integer", "float")
    over = lambda p: F.count_if(F.col(f"p_{p}") > 0.5)
    money = reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in ("amount", "total", "revenue", "sales")])
    boosts = columns.groupBy("tab").agg(
        (0.2 * over("currency") + 0.1 * F.count_if(money & numeric)).alias("money"), (0.3 * over("email") + 0.2 * over("phone")).alias("reach"), (0.2 * over("date") + 0.3 * F.count_if(F.contains(low, F.lit("hour")) & numeric)).alias("time")
    )
    each = boosts.join(words, "tab", "left").withColumn("ws", F.coalesce("ws", F.array().cast("array<string>")))
    has = lambda *ws: F.arrays_overlap("ws", F.array(*map(F.lit, ws)))
    out = []
    for name, s in signatures.items():
        share = lambda kind, s=s: F.size(F.array_intersect("ws", F.array(*map(F.lit, s[kind])))) / len(s[kind])
        boost = F.least(F.lit(1.0), F.col("money") if s.get("boost") == "money" else F.col("reach") if s.get("boost") == "reach" else F.col("time") if s.get("boost") == "time" else F.lit(0.0))
        sheet = reduce(lambda a, b: a | b, [F.contains(F.lower("tab"), F.lit(w)) for w in s["sheet"]]).cast("double") if s["sheet"] else F.lit(0.0)
        score = F.least(F.lit(1.0), 0.5 * share("required") + 0.15 * share("optional") + 0.15 * boost + 0.2 * sheet)
        if s.get("boost") == "reach":
            score = F.when(has("name") & has("email", "phone", "street", "address", "city", "country"), 0.8).otherwise(score)
        out.append(F.struct(F.lit(name).alias("domain"), F.round(score, 6).alias("score"), F.lit(s.get("threshold", 0.5)).alias("least")))
    return each.select("tab", F.explode(F.array(*out)).alias("e")).select("tab", "e.*").where("score >= least").drop("least")


def model_scores(domains: DataFrame, signatures: dict[str, dict], least: float = 0.5, k: int = 10) -> DataFrame:
    """(tab, model, score): a domain's score counts for its models, a tenth less for each further one; over
    the table's best, `least` and more, the k best."""
    rows = [(d, m, i) for d, s in signatures.items() for i, m in enumerate(s["models"])]
    of = domains.sparkSession.createDataFrame(rows, "domain string, model string, pos int")
    total = domains.join(F.broadcast(of), "domain").groupBy("tab", "model").agg(F.sum(F.col("score") * (1 - 0.1 * F.col("pos"))).alias("total"))
    rank = F.row_number().over(Window.partitionBy("tab").orderBy(F.desc("score"), "model"))
    share = F.round(F.col("total") / F.max("total").over(Window.partitionBy("tab")), 6)
    return total.withColumn("score", share).where(F.col("score") >= least).withColumn("rank", rank).where(F.col("rank") <= k).select("tab", "model", "score")
