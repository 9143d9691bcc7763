"""Keys, vocabularies and entities resolved by joins (C)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..sources.shared import stored

#: Thresholds (automatic, review) per entity.
THRESHOLDS = {"company": (0.85, 0.70), "contact": (0.80, 0.65), "lead": (0.75, 0.60)}
SMALL = 20_000


def small(df: DataFrame, rows: int = SMALL) -> DataFrame:
    """df, marked for broadcast if it has at most `rows` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def resolve_fk(df: DataFrame, keymap: DataFrame, column: str, model: str) -> DataFrame:
    """The target id of (model, source key), or the original where there is none."""
    k = keymap.where(F.col("model") == model).select(F.col("source_key").alias("_k"), F.col("target_id").alias("_t"))
    return df.join(k, F.col(column).cast("string") == F.col("_k"), "left").withColumn(column, F.coalesce("_t", F.col(column).cast("string"))).drop("_k", "_t")


def unresolved(df: DataFrame, column: str, parents: DataFrame, key: str) -> DataFrame:
    """Rows whose non-NULL key has no parent."""
    return df.where(F.col(column).isNotNull()).join(parents.select(F.col(key).alias("_k")), F.col(column) == F.col("_k"), "left_anti")


def cycles(edges: DataFrame) -> DataFrame:
    """Nodes of (node, parent) that reach themselves, over cycles of any length; a node has one parent.

    Steps are doubled: each round holds one row per node, where it gets in 1, 2, 4 … steps; paths that
    end drop out. Once the places reached are as many as the round before, a step permutes them, so
    they are the cycles' nodes."""
    reach = stored(edges.where("parent IS NOT NULL").select("node", F.col("parent").alias("at")), "reach")
    places = None
    while True:
        count = reach.select("at").distinct().count()
        if count == places:
            return reach.select(F.col("at").alias("node")).distinct()
        places = count
        onward = reach.select(F.col("node").alias("at"), F.col("at").alias("next"))
        reach = stored(reach.join(onward, "at").select("node", F.col("next").alias("at")), "reach")


def resolve_enum(df: DataFrame, column: str, seeds: DataFrame, inline: dict[str, str] | None = None) -> DataFrame:
    """Adds resolved: a synonym, else the inline map, else the value itself if it is canonical."""
    v = text.trim(F.col(column))
    syn = seeds.where("kind = 'synonym'").select(F.col("alias").alias("_a"), F.col("canonical_id").alias("_s"))
    canon = seeds.select(F.col("canonical_id").alias("_c")).distinct()
    names = seeds.where("kind = 'canonical'").select(F.col("alias").alias("_n"), F.col("canonical_id").alias("_i"))
    out = df.join(small(syn), v == F.col("_a"), "left").join(small(canon), v == F.col("_c"), "left").join(small(names), v == F.col("_n"), "left")
    pairs = [F.lit(x) for kv in (inline or {}).items() for x in kv]
    mapped = F.create_map(*pairs)[v] if pairs else F.lit(None).cast("string")
    return out.withColumn("resolved", F.coalesce("_s", mapped, "_c", "_i")).drop("_a", "_s", "_c", "_n", "_i")


def vocab_alias(df: DataFrame, column: str, company: str, aliases: DataFrame) -> DataFrame:
    """Adds canonical: the alias of the company, else the global one. Both are equi joins."""
    v = text.normalize_string(F.col(column))
    a = aliases.select(text.normalize_string(F.col("alias")).alias("_a"), F.col("company_id").alias("_co"), F.col("canonical_value").alias("_v"))
    own = a.where("_co IS NOT NULL")
    shared = a.where("_co IS NULL").select(F.col("_a").alias("_ga"), F.col("_v").alias("_gv"))
    out = df.join(small(own), (v == F.col("_a")) & (F.col(company) == F.col("_co")), "left").join(small(shared), v == F.col("_ga"), "left")
    return out.withColumn("canonical", F.coalesce("_v", "_gv")).drop("_a", "_co", "_v", "_ga", "_gv")


def levenshtein_ratio(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def decide(candidates: DataFrame, source: str, score: str, entity: str) -> DataFrame:
    """(source, n_auto, n_review, decision): one automatic match decides, several or only reviewable
    ones don't, none creates."""
    auto, review = THRESHOLDS[entity]
    n = candidates.groupBy(source).agg(F.count_if(F.col(score) >= auto).alias("n_auto"), F.count_if(F.col(score).between(review, auto) & (F.col(score) < auto)).alias("n_review"))
    return n.withColumn("decision", F.when(F.col("n_auto") == 1, "fuzzy_match").when((F.col("n_auto") > 1) | (F.col("n_review") > 0), "multi_match").otherwise("create"))


def upsert(source: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """The merged table: source values win, op says create, update, skip or keep."""
    values = [x for x in source.columns if x != key]
    s = source.select(key, *[F.col(x).alias(f"s_{x}") for x in values], F.lit(True).alias("_s"))
    t = target.select(key, *[F.col(x).alias(f"t_{x}") for x in values], F.lit(True).alias("_t"))
    both = s.join(t, key, "full_outer")
    same = F.lit(True)
    for x in values:
        same = same & F.col(f"s_{x}").eqNullSafe(F.col(f"t_{x}"))
    label = F.when(F.col("_t").isNull(), "create").when(F.col("_s").isNull(), "keep").when(same, "skip").otherwise("update")
    return both.select(key, *[F.when(F.col("_s"), F.col(f"s_{x}")).otherwise(F.col(f"t_{x}")).alias(x) for x in values], label.alias("op"))


def cross_source(df: DataFrame, key: str, content: str, order: list[str]) -> DataFrame:
    """Adds action: the first row of a natural key creates, later ones update if their content differs
    from the one before, else skip."""
    w = Window.partitionBy(key).orderBy(*order)
    before = F.lag(content).over(w)
    return df.withColumn("action", F.when(F.row_number().over(w) == 1, "create").when(F.col(content) == before, "skip").otherwise("update"))
