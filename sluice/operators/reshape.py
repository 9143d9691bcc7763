"""Projections, filters and reshaping of tables (B, E, F, G)."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import contact, dates, numbers, text
from ..sources.shared import stored

#: Named transforms of a mapping; an unknown name is an error.
TRANSFORMS = {
    "trim": text.trim,
    "lower": F.lower,
    "lowercase": F.lower,
    "upper": F.upper,
    "uppercase": F.upper,
    "titlecase": text.title_case,
    "title_case": text.title_case,
    "strip_special": text.strip_special,
    "replace": lambda c, find="", replace="": F.replace(c, F.lit(find), F.lit(replace)),
    "phone_normalize": contact.phone_e164,
    "phone_us": contact.phone_us,
    "email_normalize": contact.email_basic,
    "email_validate": contact.email_strict,
    "currency_to_float": numbers.currency_to_float,
    "parse_date": dates.parse_date,
    "parse_bool": numbers.parse_bool,
    "round": lambda c, decimals=0: numbers.round_even(c, decimals),
    "default_if_empty": lambda c, default="": text.default_if_empty(c, default),
    "add_prefix": lambda c, prefix="": F.concat(F.lit(prefix), c),
    "add_suffix": lambda c, suffix="": F.concat(c, F.lit(suffix)),
    "split": lambda c, delimiter=";": text.split_list(c, delimiter),
    "join": lambda c, delimiter=";": F.array_join(c, delimiter),
    "map": lambda c, table="": F.transform(c, lambda x: text.external_id(x, table)),
    "regex_extract": text.extract,
    "name_normalize": text.person_name,
    "empty_to_null": text.empty_to_null,
}


def transform_chain(c: Column, steps: list) -> Column:
    """Named transforms in order; a step is a name or (name, parameters)."""
    return reduce(lambda x, s: TRANSFORMS[s](x) if isinstance(s, str) else TRANSFORMS[s[0]](x, **s[1]), steps, c)


def apply_mapping(df: DataFrame, mapping: list[dict], defaults: dict[str, object] | None = None, pointer: str = "source_ptr") -> DataFrame:
    """One select: confirmed mappings renamed and transformed, defaults for fields without one."""
    used = [m for m in mapping if m.get("confirmed", True)]
    have = {m["target"] for m in used}
    cols = [F.col(pointer)] + [transform_chain(F.col(m["source"]), m.get("transforms", [])).alias(m["target"]) for m in used]
    return df.select(*cols, *[F.lit(v).alias(k) for k, v in (defaults or {}).items() if k not in have])


def attach_pointer(df: DataFrame, key: str, name: str = "source_ptr", n: int = 256) -> DataFrame:
    """row_<i> in order of a key, from 0, without sorting all rows in one task: ranges of the key are
    counted, and each adds what lies before it. The ranges are stored, as they are read twice."""
    ranged = stored(df.repartitionByRange(n, key).withColumn("_part", F.spark_partition_id()), "ranges")
    within = ranged.withColumn("_i", F.row_number().over(Window.partitionBy("_part").orderBy(key)))
    counts = within.groupBy("_part").count()
    before = counts.withColumn("_before", F.sum("count").over(Window.orderBy("_part")) - F.col("count")).select("_part", "_before")
    return within.join(F.broadcast(before), "_part").withColumn(name, F.concat(F.lit("row_"), (F.col("_i") - 1 + F.col("_before")).cast("string"))).drop("_part", "_i", "_before")


def project_by_model(df: DataFrame, fields: dict[str, dict[str, str]]) -> dict[str, DataFrame]:
    """One table per model from a wide one: {model: {target: source}}."""
    return {model: df.select([F.col(s).alias(t) for t, s in columns.items()]) for model, columns in fields.items()}


def clean_names(names: list[str]) -> list[str]:
    """Without parentheses and trailing marks, single spaces; later duplicates get _2, _3 …"""
    out, seen = [], {}
    for name in names:
        s = re.sub(r"[*?#.]+$", "", re.sub(r"\s*\([^)]*\)", "", name)).replace("?", "")
        s = re.sub(r"\s+", " ", s.strip()) or "Unnamed"
        seen[s] = seen.get(s, 0) + 1
        out.append(s if seen[s] == 1 else f"{s}_{seen[s]}")
    return out


def drop_empty_columns(df: DataFrame, most: float = 0.95) -> DataFrame:
    """Without columns that are NULL in more than `most` of the rows or in all of them."""
    row = df.agg(F.count("*").alias("_n"), *[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns]).first()
    return df.select([F.col(f"`{c}`") for c in df.columns if row["_n"] and row[c] and 1 - row[c] / row["_n"] <= most])


def fill_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items() if c in df.columns})


def with_headers(df: DataFrame, headers: list[str]) -> DataFrame:
    """Exactly these columns; those that are missing are NULL."""
    return df.select([F.col(h) if h in df.columns else F.lit(None).cast("string").alias(h) for h in headers])


def rule_expression(rule: str) -> str:
    """A field rule as a Spark expression: isset, ==, or(a, b) and `c ? a : b` are rewritten, and Spark
    gives and, or and parentheses their precedence."""
    if m := re.match(r"^(.+?)\?(.+):(.+)$", rule.strip()):
        return f"CASE WHEN {rule_expression(m[1])} THEN {rule_expression(m[2])} ELSE {rule_expression(m[3])} END"
    out = re.sub(r"(?<![\w`'])([A-Za-z_]\w*/\w+)", r"`\1`", rule.strip())
    return re.sub(r"\bor\s*\(", "coalesce(", re.sub(r"\bisset\s*\(", "isnotnull(", out)).replace("==", "=")


def apply_rules(df: DataFrame, defaults: dict[str, object], rules: dict[str, str]) -> DataFrame:
    """Defaults first, then one derived column per rule."""
    return fill_defaults(df, defaults).withColumns({k: F.expr(rule_expression(r)) for k, r in rules.items()})


def remap_exact(c: Column, rules: list[tuple[int, str, str]]) -> Column:
    """(priority, from, to): by falling priority, each on the result of the one before; NULL stays."""
    return reduce(lambda x, r: F.when(x == r[1], F.lit(r[2])).otherwise(x), sorted(rules, key=lambda r: -r[0]), c)


def remap_pattern(c: Column, pattern: str, to: str) -> Column:
    return F.when(F.rlike(c, F.lit(pattern)), F.regexp_replace(c, pattern, to)).otherwise(c)


def remap_lookup(c: Column, table: dict[str, str]) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[c], c)


#: Presets.
COUNTRY = {"US": "United States", "USA": "United States", "UK": "United Kingdom", "GB": "United Kingdom"}
STAGE = {"Lead": "New", "Opportunity": "Qualified", "Won": "Closed Won", "Lost": "Closed Lost"}


def violations(df: DataFrame, condition: str) -> DataFrame:
    """Rows for which the condition is false; not those for which it is unknown."""
    return df.where(~F.expr(condition))


def null_prune(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.where(F.coalesce(*[F.col(c).cast("string") for c in columns]).isNotNull())


def confidence_tier(c: Column) -> Column:
    return F.when(c >= 0.7, "high").when(c >= 0.4, "medium")


def unpivot_groups(df: DataFrame, keys: list[str], groups: list[dict[str, str]]) -> DataFrame:
    """Wide numbered groups to long: {child field: column} of each group, with its sequence from 1;
    children whose values are all NULL or empty are dropped."""
    child = [F.struct(F.lit(i + 1).alias("sequence"), *[F.col(s).alias(t) for t, s in g.items()]) for i, g in enumerate(groups)]
    long = df.select(*keys, F.explode(F.array(*child)).alias("c")).select(*keys, "c.*")
    return long.where(reduce(lambda a, b: a | b, [text.blank(F.col(t).cast("string")) != "" for t in groups[0]]))


def route(c: Column, anchors: dict[str, str]) -> Column:
    """The anchor of the first name that the model contains, else `unknown`."""
    out = F.lit("unknown")
    for name, anchor in reversed(list(anchors.items())):
        out = F.when(F.contains(F.lower(c), F.lit(name)), anchor).otherwise(out)
    return out


def dedupe_ids(df: DataFrame, column: str, order: str) -> DataFrame:
    """Adds occurrence and unique_id: the first of an id keeps it, later ones get _2, _3 …; 64 characters."""
    base = F.substring(F.col(column), 1, 60)
    n = F.row_number().over(Window.partitionBy(base).orderBy(order))
    return df.withColumn("occurrence", n).withColumn("unique_id", F.substring(F.when(F.col("occurrence") == 1, base).otherwise(F.concat(base, F.lit("_"), F.col("occurrence").cast("string"))), 1, 64))


def clean_by_profile(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """One select with a cleaner per column, by the kind its profile gave; text is trimmed, '' is NULL."""
    cleaners = {"email": lambda c: F.lower(text.trim(c)), "phone": contact.phone_e164, "currency": numbers.clean_currency, "date": dates.clean, "boolean": numbers.normalize_bool, "numeric": numbers.clean_numeric, "text": text.trim}
    return df.select([text.empty_to_null(cleaners[kinds[c]](F.col(c))).alias(c) if c in kinds else F.col(c) for c in df.columns])


def remap_function(c: Column, fn: Callable[[str], str | None]) -> Column:
    """fn of every text, in Arrow batches; a NULL, and a value for which fn fails or gives None, stays as it is."""

    def kept(x: str | None) -> str | None:
        try:
            return None if x is None else fn(x)
        except Exception:  # a user's function may fail in any way
            return None

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(kept).astype(object)

    return F.coalesce(run(c), c)
