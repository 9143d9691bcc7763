"""What the values of columns mean, numbered groups of headers, and the load of a catalogue (D28, D30, C38)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .profile import _as_text, _of_columns, _type, value_counts
from .resolve import small

#: Words and patterns that tell what a value is.
COMPANY_SUFFIXES = ("inc", "corp", "corporation", "llc", "ltd", "limited", "co", "company", "group", "holdings", "partners", "associates", "gmbh", "sa", "spa", "srl", "ag", "nv", "bv", "plc")
COMPANY_WORDS = ("company", "corporation", "group")
PERSON_TITLES = ("mr", "mrs", "ms", "dr", "prof", "sir", "lord", "lady")
REFERENCES = {
    "invoice": (r"INV[-/]?\d+", r"INVOICE[-/]?\d+", r"\d{4}[-/]INV[-/]\d+"),
    "order": (r"SO[-/]?\d+", r"PO[-/]?\d+", r"ORDER[-/]?\d+", r"\d{4}[-/]ORD[-/]\d+"),
    "product": (r"[A-Z]{2,4}[-]?\d{3,}", r"PROD[-]?\d+", r"\d{5,12}$"),
    "account": (r"\d{3,4}[-.]?\d{3,4}", r"[A-Z]{2}\d{2}[-]?\d{4,}"),
}
SKU = r"^[A-Z]{2,4}[-]?\d{3,}"
COUNTRIES = ("united states", "usa", "canada", "mexico", "brazil", "argentina", "united kingdom", "uk", "france", "germany", "spain", "italy", "china", "japan", "india", "australia", "south africa")
STATES = {"draft": ("draft", "new", "pending"), "confirmed": ("confirmed", "approved", "validated"), "done": ("done", "completed", "finished", "delivered"), "cancel": ("cancelled", "canceled", "rejected", "void")}
BOOLEANS = (("yes", "no"), ("true", "false"), ("1", "0"), ("y", "n"), ("active", "inactive"), ("enabled", "disabled"))
HINTS = {
    "company": ("res.partner.name", "res.partner.company_name"), "person": ("res.partner.name", "hr.employee.name"), "product": ("product.product.name", "product.product.default_code"),
    "invoice": ("account.move.name", "account.move.ref"), "order": ("sale.order.name", "purchase.order.name"), "currency": ("amount", "price", "cost", "total"), "state": ("state", "status"),
    "country": ("res.partner.country_id", "res.country"), "city_or_region": ("res.partner.city", "res.partner.state_id"),
}


def analyze_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row per column: entity_type, reference_type, category, subtype, place, state_type, hints, confidence.

    Every distinct value that isn't blank counts once; all scores are sums and shares over them in one
    grouping of one scan. A column without values has the confidence 0 and nothing else."""
    kinds = [dict(df.dtypes)[c] for c in columns]
    counts = value_counts(df, columns).withColumn("t", _as_text(kinds))
    v = text.trim(F.col("t"))
    low = F.lower(v)
    known = F.col("t").isNotNull() & (v != "")
    total = lambda score: F.sum(F.when(known, score).otherwise(0))
    any_ = lambda cond: F.coalesce(F.bool_or(known & cond), F.lit(False))
    every = lambda cond: F.coalesce(F.bool_and(F.when(known, cond)), F.lit(False))
    holds = lambda words: reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words])
    words = F.filter(F.split(v, r"\s+"), lambda w: w != "")
    upper = F.forall(words, lambda w: F.rlike(w, F.lit(r"^\p{Lu}")))
    n_words = F.size(words)
    person = F.when(n_words.between(2, 3), F.when(F.lower(words[0]).isin(*PERSON_TITLES), 2).when(upper, 1).otherwise(0)).otherwise(0)
    company = F.when(holds(COMPANY_SUFFIXES), 2).otherwise(0) + F.when(holds(COMPANY_WORDS), 1).otherwise(0)
    product = F.when(F.rlike(v, F.lit(SKU)), 2).otherwise(0) + F.when(F.rlike(v, F.lit(r"^\d+$")) & F.length(v).isin(8, 10, 12, 13), 1).otherwise(0)
    number = v.try_cast("double")
    found = counts.groupBy("at").agg(
        total(F.lit(1)).alias("n"), total(company).alias("company"), total(person).alias("person"), total(product).alias("product"),
        *[total(F.when(F.rlike(v, F.lit(f"(?i)^({'|'.join(ps)})")), 1).otherwise(0)).alias(f"ref_{k}") for k, ps in REFERENCES.items()],
        _type(F.col("t"), kinds).alias("type"), F.try_divide(F.count("t"), F.sum(F.when(F.col("t").isNotNull(), F.col("times")))).alias("uniqueness"),
        F.min(F.when(known, number)).alias("low"), F.max(F.when(known, number)).alias("high"), any_(number % 0.01 == 0).alias("cents"), every(number == F.floor(number)).alias("whole"),
        *[any_(low.isin(*ws)).alias(f"state_{k}") for k, ws in STATES.items()], *[every(low.isin(*ws)).alias(f"bool_{i}") for i, ws in enumerate(BOOLEANS)],
        total(F.when(low.isin(*COUNTRIES), 1).otherwise(0)).alias("countries"), total(F.when(n_words.between(1, 3) & upper, 1).otherwise(0)).alias("cities"),
    )
    n = F.col("n")
    one = lambda score: F.least(F.lit(1.0), F.try_divide(F.col(score), n))
    best = F.greatest("company", "person", "product")
    entity = F.when(best == 0, None).when(F.col("company") == best, "company").when(F.col("person") == best, "person").otherwise("product")
    entity_conf = F.when(best == 0, 0.0).otherwise(F.least(F.lit(1.0), F.try_divide(best, n)))
    most = F.greatest(*[F.col(f"ref_{k}") for k in REFERENCES])
    reference = _first({k: F.col(f"ref_{k}") == most for k in REFERENCES})
    reference_conf = F.when(most == 0, 0.0).otherwise(F.least(F.lit(1.0), F.try_divide(most, n)))
    lo, hi = F.col("low"), F.col("high")
    numeric, few = F.col("type").isin("integer", "float"), F.col("uniqueness") < 0.1
    state_type = _first({k: F.col(f"state_{k}") for k in STATES})
    boolean = reduce(lambda a, b: a | b, [F.col(f"bool_{i}") for i in range(len(BOOLEANS))])
    classes = [  # category, subtype, confidence, condition: the first that holds
        ("financial", "currency", 0.8, numeric & (lo >= 0) & (hi < 1_000_000) & F.col("cents")),
        ("quantity", "integer", 0.7, numeric & F.col("whole") & (lo >= 0) & (hi < 10_000)),
        ("percentage", None, 0.6, numeric & lo.between(0, 100) & hi.between(0, 100)),
        ("numeric", None, 0.5, numeric),
        ("temporal", "date", 0.9, F.col("type") == "date"),
        ("selection", "state", 0.8, few & state_type.isNotNull()),
        ("boolean", None, 0.9, few & boolean),
        ("categorical", None, 0.6, few),
        ("text", None, 0.5, F.lit(True)),
    ]
    pick = lambda i: reduce(lambda out, c: out.when(c[3], c[i]) if out is not None else F.when(c[3], c[i]), classes, None)
    place = F.when(F.col("countries") > 0.3 * n, "country").when(F.col("cities") > 0.5 * n, "city_or_region")
    some = n > 0
    out = found.select(
        "at", F.when(some & (entity_conf > 0.5), entity).alias("entity_type"), F.when(some & (reference_conf > 0.5), reference).alias("reference_type"), F.when(some, pick(0)).alias("category"),
        F.when(some, pick(1)).alias("subtype"), F.when(some, place).alias("place"), F.when(some, state_type).alias("state_type"),
        F.when(some, F.greatest(entity_conf, reference_conf, pick(2), F.when(place == "country", 0.8).when(place.isNotNull(), 0.6).otherwise(0.0), F.when(state_type.isNotNull(), 0.7).otherwise(0.0))).otherwise(0.0).alias("confidence"),
    )
    named = F.create_map(*[x for k, hs in HINTS.items() for x in (F.lit(k), F.array(*map(F.lit, hs)))])
    told = F.array("entity_type", "reference_type", "subtype", "place")
    hints = F.flatten(F.transform(F.filter(told, lambda x: x.isin(*HINTS)), lambda x: named[x]))
    out = out.withColumn("hints", F.when(F.size(hints) > 0, F.array_join(hints, ","))).withColumn("confidence", F.round("confidence", 6))
    return _of_columns(out, columns, {"confidence": F.lit(0.0)})


def _first(conditions: dict[str, Column]) -> Column:
    out = None
    for name, cond in conditions.items():
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out


def pivot_groups(headers: DataFrame, fewest: int = 2, gap: int = 2) -> DataFrame:
    """Numbered headers of a table by prefix: `prefix_1`, `prefix_1_field`. A group has its indices from 0
    or 1 on, without steps over `gap`. confidence: 0.4 for indices that are there, 0.4 for fields with as
    many columns each, and 0.1 or 0.2 for two or more fields."""
    h = F.lower(text.trim(F.col("header")))
    both, bare = r"^([a-z_]+?)_(\d+)_([a-z_]+)$", r"^([a-z_]+?)_(\d+)$"
    get = lambda i: F.when(F.rlike(h, F.lit(both)), F.regexp_extract(h, both, i)).when(F.rlike(h, F.lit(bare)), F.regexp_extract(h, bare, i) if i < 3 else F.lit(""))
    parts = headers.select("table", get(1).alias("prefix"), get(2).try_cast("int").alias("i"), get(3).alias("child")).where("prefix IS NOT NULL AND i IS NOT NULL")
    # Columns of each field first, so that what a group gathers is its indices and fields.
    cells = parts.groupBy("table", "prefix", "child").agg(F.count("*").alias("n"), F.collect_set("i").alias("ix"))
    g = cells.groupBy("table", "prefix").agg(F.sum("n").alias("n"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("ix")))).alias("ix"), F.count("*").alias("fields"), F.min("n").alias("least"), F.max("n").alias("most"))
    steps = F.transform(F.sequence(F.lit(1), F.size("ix") - 1), lambda k: F.get("ix", k) - F.get("ix", k - 1))
    ok = (F.col("n") >= fewest) & F.get("ix", F.lit(0)).isin(0, 1) & ((F.size("ix") == 1) | F.forall(steps, lambda s: s <= gap))
    complete = F.size("ix") / (F.element_at("ix", -1) - F.get("ix", F.lit(0)) + 1)
    confidence = 0.4 * complete + 0.4 * F.col("least") / F.col("most") + F.when(F.col("fields") >= 3, 0.2).when(F.col("fields") == 2, 0.1).otherwise(0.0)
    p = F.col("prefix")
    target = (
        F.when(F.contains(p, F.lit("activity")) | F.contains(p, F.lit("task")), "mail.activity")
        .when(F.contains(p, F.lit("note")) | F.contains(p, F.lit("message")) | F.contains(p, F.lit("comment")), "mail.message")
        .when(F.contains(p, F.lit("line")) | F.contains(p, F.lit("item")), "sale.order.line")
        .when(F.contains(p, F.lit("tag")), "tags")
    )
    return g.where(ok).select("table", "prefix", "n", F.array_join(F.transform("ix", lambda x: x.cast("string")), ",").alias("indices"), "fields", F.round(F.least(F.lit(1.0), confidence), 6).alias("confidence"), target.alias("target"))


def load_catalogue(models: DataFrame, fields: DataFrame, selections: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Dictionary sheets resolved to models and fields: (fields, options, skipped).

    models: name, description. fields: model, field, label; `model` is a name or, in any case, a
    description. selections: field, value; `field` is `label (description)` or a label alone. A name goes
    before a description; a key that fits several has the last of them, and `targets` says how many.
    What fits nothing is skipped, with its kind and reason."""
    names = models.select(F.lower("name").alias("k"), F.col("name").alias("by_name")).distinct()
    told = models.where("description IS NOT NULL").groupBy(F.lower("description").alias("k")).agg(F.max("name").alias("by_description"), F.countDistinct("name").alias("targets"))
    keyed = fields.withColumn("k", F.lower("model")).join(small(names), "k", "left").join(small(told), "k", "left")
    target = F.coalesce("by_name", "by_description")
    loaded = keyed.where(target.isNotNull()).select(target.alias("model"), "field", "label", F.when(F.col("by_name").isNotNull(), F.lit(1)).otherwise(F.col("targets")).cast("long").alias("targets"))
    lost = keyed.where(target.isNull()).select(F.lit("field").alias("kind"), F.concat_ws(".", "model", "field").alias("key"), F.lit("no model").alias("reason"))
    of = models.groupBy(F.col("name").alias("model")).agg(F.max("description").alias("description"))
    known = loaded.select("model", "field", "label").distinct().join(small(of), "model")
    pair = F.struct("model", "field")
    full = known.select(F.concat(F.col("label"), F.lit(" ("), F.col("description"), F.lit(")")).alias("fk"), pair.alias("p")).groupBy("fk").agg(F.max("p").alias("full"), F.count("*").alias("n_full"))
    bare = known.groupBy(F.col("label").alias("lk")).agg(F.max(pair).alias("bare"), F.count("*").alias("n_bare"))
    met = selections.join(full, F.col("field") == F.col("fk"), "left").join(bare, F.col("field") == F.col("lk"), "left")
    hit = F.coalesce("full", "bare")
    options = met.where(hit.isNotNull()).select(hit["model"].alias("model"), hit["field"].alias("field"), "value", F.coalesce("n_full", "n_bare").alias("targets"))
    lost = lost.union(met.where(hit.isNull()).select(F.lit("selection"), F.concat_ws("=", "field", "value"), F.lit("no field")))
    return loaded, options, lost
