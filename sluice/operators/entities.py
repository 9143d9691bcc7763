"""Entity resolution: name blocks, pair scores, and staged decisions with key map and quarantine."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored
from .resolve import THRESHOLDS, levenshtein_ratio, small

#: Rows of one side of a block beyond which it is cut into cells.
HOT = 500
#: Characters of a name that a prefix key holds: of a company's, without blanks, and of a lead's. Common
#: first words are longer than few characters, and blocks should not grow with the table.
LONG_PREFIX, PREFIX = 12, 8
#: Candidates that a quarantined row names.
SHOWN = 10



def name_keys(name: Column, scope: Column) -> Column:
    """Block keys of a normalized name: its sound and its prefix within a scope (a country, say), and the
    name without blanks, whole and with each character left out once. Names that are one edit apart, or
    one swap of neighbours, share one of the last; no key for an empty name."""
    parts = F.struct(name.alias("name"), F.replace(name, F.lit(" "), F.lit("")).alias("squeezed"), scope.alias("scope"))

    def keys(p: Column) -> Column:
        squeezed = p["squeezed"]
        sound = F.array_join(F.transform(F.split(p["name"], " "), F.soundex), "")
        less = F.transform(F.sequence(F.lit(0), F.when(F.length(squeezed) > 1, F.length(squeezed)).otherwise(0)), lambda i: F.xxhash64(F.concat(F.substring(squeezed, F.lit(1), i - 1), F.substr(squeezed, i + 1))))
        scoped = F.filter(F.array(F.concat(F.lit("s|"), sound, F.lit("|"), p["scope"]), F.concat(F.lit("p|"), F.substring(squeezed, 1, LONG_PREFIX), F.lit("|"), p["scope"])), lambda k: k.isNotNull())
        return F.when(squeezed != "", F.array_sort(F.array_distinct(F.concat(F.transform(scoped, lambda k: F.xxhash64(k)), less)))).otherwise(F.array().cast("array<long>"))

    # One level more, so that the name isn't made anew for every character.
    return F.flatten(F.transform(F.array(parts), keys))


def paired(source: DataFrame, canon: DataFrame, id: str, keys: str = "keys", hot: int = HOT) -> DataFrame:
    """Pairs of rows that share a key: columns of source, and those of canon with the prefix c_; each pair
    once, by its least common key. Keys are arrays of longs.

    Keys that many rows of a side have are cut into cells: a row goes to one slice of its own side and
    meets every slice of the other, so no task takes a whole hot block, and no pair is lost."""
    left, right = (df.withColumn("_key", F.explode(keys)) for df in (source, canon))
    n = left.select("_key", F.lit(1).alias("s"), F.lit(0).alias("c")).union(right.select("_key", F.lit(0), F.lit(1)))
    n = n.groupBy("_key").agg(F.sum("s").alias("_s"), F.sum("c").alias("_c")).where((F.greatest("_s", "_c") > hot) & (F.least("_s", "_c") > 0))
    cells = stored(n.select("_key", F.ceil(F.col("_s") / hot).cast("int").alias("_s"), F.ceil(F.col("_c") / hot).cast("int").alias("_c")), "hot-blocks")
    slice_ = lambda of: F.pmod(F.xxhash64(id), F.coalesce(F.col(of), F.lit(1))).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.coalesce(F.col(of), F.lit(1)) - 1))
    left = left.join(small(cells), "_key", "left").withColumn("_i", slice_("_s")).withColumn("_j", every("_c")).drop("_s", "_c")
    right = right.join(small(cells), "_key", "left").withColumn("_j", slice_("_c")).withColumn("_i", every("_s")).drop("_s", "_c")
    right = right.select("_key", "_i", "_j", *[F.col(x).alias(f"c_{x}") for x in canon.columns])
    both = left.join(right, ["_key", "_i", "_j"]).where(F.col("_key") == F.array_min(F.array_intersect(keys, f"c_{keys}")))
    return both.drop("_key", "_i", "_j", keys, f"c_{keys}")


def jaro_winkler(a: str | Column, b: str | Column) -> Column:
    """Jaro–Winkler similarity, prefix scale 0.1 over at most four characters from a Jaro of 0.7; an
    Arrow function, as Spark has none. All pairs of a batch advance together."""
    return F.pandas_udf(_similarities, "double")(a, b)


def jaro_winkler_bound(a: Column, b: Column) -> Column:
    """No Jaro–Winkler similarity of texts of these lengths is above it; a built-in expression, to drop
    pairs before the Arrow function."""
    share = F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b), F.lit(1))
    jaro = (F.lit(2) + share) / 3
    return F.when(a == b, 1.0).otherwise(jaro + 0.4 * (1 - jaro))


def _similarities(a: pd.Series, b: pd.Series) -> pd.Series:
    known = (a.notna() & b.notna()).to_numpy()
    out = np.full(len(a), np.nan)
    x, y = a[known].to_numpy(str), b[known].to_numpy(str)
    size = np.maximum(np.char.str_len(x), np.char.str_len(y))
    at = np.flatnonzero(known)
    order = np.argsort(size, kind="stable")  # texts of about one length share a matrix
    for i in range(0, len(order), 2000):
        some = order[i : i + 2000]
        out[at[some]] = _jaro_winkler(x[some], y[some])
    return pd.Series(out).astype(object).where(known, None).astype("float64")


def _matrix(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.char.str_len(x)
    width = max(1, int(n.max()))
    return x.astype(f"U{width}").view(np.uint32).reshape(len(x), width), n


def _jaro_winkler(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    (a, la), (b, lb) = _matrix(x), _matrix(y)
    reach = np.maximum(np.maximum(la, lb) // 2 - 1, 0)
    place, rows = np.arange(b.shape[1]), np.arange(len(a))
    free = place < lb[:, None]
    left = np.zeros(a.shape, bool)
    for i in range(a.shape[1]):
        # The first free equal character within reach is taken.
        may = free & (b == a[:, i : i + 1]) & (np.abs(place - i) <= reach[:, None])
        j = may.argmax(axis=1)
        hit = may[rows, j] & (i < la)
        left[hit, i] = True
        free[rows[hit], j[hit]] = False
    right = ~free & (place < lb[:, None])
    m = left.sum(axis=1)
    front = lambda c, taken: np.take_along_axis(c, np.argsort(~taken, axis=1, kind="stable"), 1)
    width = min(a.shape[1], b.shape[1])
    apart = (front(a, left)[:, :width] != front(b, right)[:, :width]) & (np.arange(width) < m[:, None])
    swaps = apart.sum(axis=1) // 2
    with np.errstate(divide="ignore", invalid="ignore"):
        jaro = (m / la + m / lb + (m - swaps) / m) / 3
    jaro = np.where(m > 0, jaro, 0.0)
    head = min(4, width)
    same = (a[:, :head] == b[:, :head]) & (np.arange(head) < np.minimum(la, lb)[:, None])
    prefix = np.cumprod(same, axis=1).sum(axis=1)
    score = np.where(jaro > 0.7, jaro + prefix * 0.1 * (1 - jaro), jaro)
    return np.where(x == y, 1.0, score)


def _equal(a: str) -> Column:
    """1 if both sides have this value and it is the same but for case, else 0."""
    return F.when(F.lower(a) == F.lower(f"c_{a}"), 1.0).otherwise(0.0)


def _ranked(scored: DataFrame, id: str, review: float) -> DataFrame:
    """Candidates of at least the score of a review, ranked per source row, ties by id."""
    best = Window.partitionBy(id).orderBy(F.desc("score"), f"c_{id}")
    return scored.where(F.col("score") >= review).withColumn("rank", F.row_number().over(best))


def company_scores(source: DataFrame, canon: DataFrame, id: str = "id") -> DataFrame:
    """(id, c_id, score, rank) from 0.7 x Jaro–Winkler of the normalized names + 0.3 x Levenshtein ratio
    of street and city, 0 where either side lacks one. Candidates share a key of their names."""
    review = THRESHOLDS["company"][1]
    where = F.when(F.col("street").isNotNull() & F.col("city").isNotNull() & F.col("c_street").isNotNull() & F.col("c_city").isNotNull(), levenshtein_ratio(F.lower(F.concat_ws(" ", "street", "city")), F.lower(F.concat_ws(" ", "c_street", "c_city")))).otherwise(0.0)
    pairs = paired(source, canon, id).withColumn("near", where)
    pairs = pairs.where(0.7 * jaro_winkler_bound(F.col("name"), F.col("c_name")) + 0.3 * F.col("near") >= review - 1e-9)
    score = F.round(0.7 * jaro_winkler("name", "c_name") + 0.3 * F.col("near"), 6)
    return _ranked(pairs.select(id, f"c_{id}", score.alias("score")), id, review)


def contact_scores(source: DataFrame, canon: DataFrame, id: str = "id") -> DataFrame:
    """(id, c_id, score, rank) from 0.5 x Jaro–Winkler of the names + 0.5 for equal e-mails, among
    contacts of one `parent`."""
    keyed = lambda df: df.withColumn("keys", F.when(F.col("parent").isNull(), F.array().cast("array<long>")).otherwise(F.array(F.xxhash64(F.col("parent").cast("string")))))
    review = THRESHOLDS["contact"][1]
    pairs = paired(keyed(source), keyed(canon), id).withColumn("mail", _equal("email"))
    pairs = pairs.where(0.5 * jaro_winkler_bound(F.col("name"), F.col("c_name")) + 0.5 * F.col("mail") >= review - 1e-9)
    return _ranked(pairs.select(id, f"c_{id}", F.round(0.5 * jaro_winkler("name", "c_name") + 0.5 * F.col("mail"), 6).alias("score")), id, review)


def lead_scores(source: DataFrame, canon: DataFrame, id: str = "id") -> DataFrame:
    """(id, c_id, score, rank) from 0.4 x Jaro–Winkler + 0.4 for equal e-mails + 0.2 x max(0, 1 - days /
    30), among leads with one e-mail address or one name prefix."""
    key = lambda kind, x: F.when(x != "", F.xxhash64(F.concat(F.lit(kind), x)))
    keys = F.array_distinct(F.array_compact(F.array(key("e|", F.lower("email")), key("n|", F.substring("name", 1, PREFIX)))))
    review = THRESHOLDS["lead"][1]
    near = F.coalesce(F.greatest(F.lit(0.0), 1 - F.abs(F.datediff("created", "c_created")) / 30), F.lit(0.0))
    pairs = paired(source.withColumn("keys", keys), canon.withColumn("keys", keys), id).withColumn("rest", 0.4 * _equal("email") + 0.2 * near)
    pairs = pairs.where(0.4 * jaro_winkler_bound(F.col("name"), F.col("c_name")) + F.col("rest") >= review - 1e-9)
    return _ranked(pairs.select(id, f"c_{id}", F.round(0.4 * jaro_winkler("name", "c_name") + F.col("rest"), 6).alias("score")), id, review)


Scores = Callable[[DataFrame, DataFrame], DataFrame]


def resolved(source: DataFrame, canon: DataFrame, entity: str, model: str, scores: Scores, natural: str = "natural_key") -> tuple[DataFrame, DataFrame]:
    """Key map and quarantine rows of one entity.

    First equal natural keys (the smallest id of several), then scores for what is left: a single
    automatic match decides, several, or only some worth a review, wait in quarantine with their best
    candidates, and none creates. What a stage settles leaves by an anti join."""
    auto, _ = THRESHOLDS[entity]
    known = canon.groupBy(natural).agg(F.min("id").alias("target"))
    exact = stored(source.select("id", natural).join(known, natural).select("id", "target"), "exact")
    left = stored(source.join(exact.select("id"), "id", "left_anti"), "unmatched")
    found = stored(scores(left, canon), "scored")
    sure = F.col("score") >= auto
    each = found.groupBy("id").agg(F.count_if(sure).alias("n_auto"), F.count_if(~sure).alias("n_review"), F.max("score").alias("best"), F.min_by("c_id", "rank").alias("target"))
    # Few rows wait, and each shows a few candidates: those that are sure if there are any.
    shown = found.where(F.col("rank") <= SHOWN).groupBy("id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "c_id"))).alias("c"))
    decided = left.select("id").join(each, "id", "left").join(shown, "id", "left")
    one, several = F.col("n_auto") == 1, (F.col("n_auto") != 1) & (F.col("n_auto") + F.col("n_review") > 0)
    row = lambda target, method, confidence: [F.lit(model).alias("model"), F.col("id").cast("string").alias("source_key"), target.cast("string").alias("target_id"), F.lit(method).alias("method"), confidence.cast("double").alias("confidence")]
    decided = stored(decided, "decided")
    keymap = exact.select(*row(F.col("target"), "exact_match", F.lit(1.0)))
    keymap = keymap.union(decided.where(one).select(*row(F.col("target"), "fuzzy_match", F.col("best"))))
    keymap = keymap.union(decided.where("n_auto IS NULL").select(*row(F.concat(F.lit("new_"), "id"), "create", F.lit(0.0))))
    n = F.when(F.col("n_auto") > 1, F.col("n_auto")).otherwise(F.col("n_review"))
    listed = F.transform(F.filter("c", lambda x: F.when(F.col("n_auto") > 1, -x["s"] >= auto).otherwise(F.lit(True))), lambda x: F.struct(x["c_id"].cast("string").alias("id"), (-x["s"]).alias("score")))
    waiting = decided.where(several).select(F.lit(model).alias("model"), F.col("id").cast("string").alias("source_key"), F.lit("quarantined").alias("action"), F.lit("multi_match").alias("reason"), n.alias("n_candidates"), listed.alias("candidates"))
    return keymap, waiting


def unparented(rows: DataFrame, keymap: DataFrame, model: str, column: str) -> tuple[DataFrame, DataFrame]:
    """Rows with their parent's target id in place of its source key, and quarantine rows of those whose
    parent is in no key map (it waits itself, or isn't known); rows without a parent stay."""
    of = keymap.where(F.col("model") == model).select(F.col("source_key").alias("_k"), F.col("target_id").alias("_t"))
    joined = rows.join(of, F.col(column).cast("string") == F.col("_k"), "left")
    lost = F.col(column).isNotNull() & F.col("_t").isNull()
    waiting = joined.where(lost).select(F.col("id").cast("string").alias("source_key"), F.lit("fk_unresolved").alias("reason"))
    return joined.where(~lost).withColumn(column, F.col("_t")).drop("_k", "_t"), waiting
