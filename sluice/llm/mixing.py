"""Mixing sources to target weights (operator 7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, checked_broadcast, saved, table

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0


def word_count(text: Column) -> Column:
    """Words in a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit_hash(key: Column, seed: str) -> Column:
    """A number in [0, 1) that depends only on the seed and the key: 52 bits of an MD5."""
    hexed = F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("null")))), 1, 13)
    return F.conv(hexed, 16, 10).cast("double") / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, size) rows to (source, source_size, target): the level of water that fills all.

    A source's target is least(most * size, level * weight). The level is found among the sources in
    order of most * size / weight: below it they are full, from it on they share what is left.
    The windows run over one row per source, not over documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("weight", pick)
    s = s.withColumn("most", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    up_to, everything = order.rowsBetween(Window.unboundedPreceding, Window.currentRow), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    wanted = F.sum("source_size").over(everything) * F.lit(float(share))
    full = F.sum("most").over(up_to) - F.col("most")
    open_weight = F.sum("weight").over(everything) - F.sum("weight").over(up_to) + F.col("weight")
    s = s.withColumn("level", (wanted - full) / open_weight)
    s = s.withColumn("level", F.min(F.when(F.col("level") <= F.col("most") / F.col("weight"), F.struct(F.col("most") / F.col("weight"), "level"))).over(everything)["level"])
    return s.select("source", "source_size", F.least("most", F.col("level") * F.col("weight")).alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = "mix-1") -> DataFrame:
    """Repetition plan of documents: doc_id, source, size, source_size, target, copies, taken.

    A source's rate is target / source_size. Each document is taken floor(rate) times, and once more
    if its seeded hash falls below the fraction, so reruns and repeated rows agree. Null text has
    size 0; null sources are one source, after the others; a source without words has target 0 and
    rate 0; an empty table gives no rows. Other columns of docs are ignored.
    """
    sizes = saved(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    targets = saved(source_targets(sizes, weights, share, most).withColumnRenamed("source", "of"), "mix-targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    d = sizes.join(checked_broadcast(targets), F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("rate", rate)
    d = d.withColumn("copies", (F.floor("rate") + F.when(unit_hash(F.col("doc_id"), seed) < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("long"))
    return d.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The documents themselves, each as many times as the plan says.

    The rate depends on the source alone, so only the targets are joined, never the plan's rows.
    """
    seed = how.pop("seed", "mix-1")
    targets = saved(source_targets(docs.select("source", word_count(F.col("text")).alias("size")), **how), "mix-targets")
    t = checked_broadcast(targets.select(F.col("source").alias("of"), F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("rate")))
    copies = F.floor("rate") + F.when(unit_hash(F.col("row.doc_id"), seed) < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    d = docs.select(F.struct(*docs.columns).alias("row")).join(t, F.col("row.source").eqNullSafe(F.col("of"))).withColumn("copies", copies.cast("int"))
    return d.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


#: The sums are of whole numbers, so both engines get the same doubles.
SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), by_source AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight
  FROM sizes GROUP BY source
), ordered AS (
  SELECT *, source_size * 2.0::DOUBLE AS most, source_size * 2.0::DOUBLE / weight AS ratio,
         (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS wanted,
         (sum(source_size) OVER o)::DOUBLE * 2.0::DOUBLE - source_size * 2.0::DOUBLE AS before,
         (sum(weight) OVER ())::BIGINT - (sum(weight) OVER o)::BIGINT + weight AS open_weight
  FROM by_source
  WINDOW o AS (ORDER BY source_size * 2.0::DOUBLE / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), levels AS (
  SELECT *, (wanted - before) / open_weight AS here FROM ordered
), filled AS (
  SELECT source, source_size, weight, most, (SELECT arg_min(here, ratio) FROM levels WHERE here <= ratio) AS level FROM levels
), targets AS (
  SELECT source, source_size, least(most, level * weight) AS target FROM filled
), rates AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate,
         CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(s.doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT)::DOUBLE / 4503599627370496.0::DOUBLE AS u
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, size * CAST(floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS taken FROM rates
"""
