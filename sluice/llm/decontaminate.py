"""Benchmark decontamination with DataFrame functions only (operator 10).

SimHash fingerprints of item-sized windows are matched to those of the items by multi-index Hamming
blocks; what lies within the radius is verified by exact weighted-shingle similarity.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checked_broadcast, saved, table

SHINGLE = 5
SIMILARITY = 0.75
#: Bits in which fingerprints may differ. Weighted similarity 0.75 means an angle that flips 11 of 64
#: bits on average with a deviation of 3.
RADIUS = 20
LANES = 0x0000000100000001
#: Distinct shingles of items, and ids of documents, that are broadcast at most; more are met in a
#: shuffled join.
KNOWN = 1_000_000


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def shingles_of(words: Column, size: int = SHINGLE) -> Column:
    """Hashes of all runs of `size` words, in order; none if there are fewer words."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    n = F.size(hashes) - (size - 1)
    # Two levels, so that the words' hashes are made once and not at every place.
    return F.flatten(F.transform(F.array(F.struct(hashes.alias("h"), n.alias("n"))), lambda s: F.when(s["n"] > 0, F.transform(F.sequence(F.lit(0), s["n"] - 1), lambda i: F.xxhash64(*[F.get(s["h"], i + k) for k in range(size)]))).otherwise(F.array().cast("array<bigint>"))))


def fingerprint(of: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, shingle) rows to keys and a 64-bit SimHash: each bit is that of most shingles.

    Thirty-two sums hold two bit counts each, in lanes of 32 bits, so this is one plain aggregation.
    """
    sums = [F.sum(F.shiftrightunsigned("shingle", b).bitwiseAND(F.lit(LANES))).alias(f"s{b}") for b in range(32)]
    counted = of.groupBy(*keys).agg(F.count("*").alias("total"), *sums)
    bit = lambda b, lane: F.when(F.shiftrightunsigned(f"s{b}", 32 * lane).bitwiseAND(F.lit(0xFFFFFFFF)) * 2 > F.col("total"), F.shiftleft(F.lit(1).cast("long"), b + 32 * lane)).otherwise(F.lit(0).cast("long"))
    return counted.select(*keys, reduce(lambda x, y: x.bitwiseOR(y), [bit(b, lane) for b in range(32) for lane in range(2)]).alias("print"))


def blocks(fp: Column, radius: int = RADIUS) -> Column:
    """(number, bits) of radius + 1 blocks: fingerprints within the radius agree in one at least."""
    cuts = [round(i * 64 / (radius + 1)) for i in range(radius + 2)]
    return F.array(*[F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("bits")) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))])


def find_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """Best window per document and item: doc_id, item_id, start, n_words, hamming, similarity.

    A window has as many words as an item; a document shorter than the item is one window as a whole.
    Its similarity to the item is the weighted Jaccard of their five-word shingles: sum of the
    smaller counts over sum of the larger. Windows whose similarity is `similarity` or more and whose
    fingerprint is within `radius` of the item's are found. start is the window's first word, from 0,
    and n_words the words it has.

    A window of that similarity lacks fewer than a seventh of the item's shingles (a document shorter
    than the item fewer than a quarter), so it holds one of any larger choice of them. The choice is of
    those that are in few places of documents and in few items: sentences that many items or documents
    share put no window anywhere. All windows that hold a chosen shingle are fingerprinted, and their
    blocks are compared with those of the items that chose it, not with all items'.

    Null and empty texts, items and texts of fewer than five words match nothing. Rows that repeat a
    doc_id or item_id give one row, the best of their texts; ties go to the earliest start. Rows
    with a null id are left out. Other columns are ignored.
    """
    items = benchmark.where("item_id IS NOT NULL").select("item_id", words_of(F.col("text").cast("string")).alias("w")).distinct()
    items = saved(items.select("item_id", F.xxhash64(F.array_join("w", " ")).alias("version"), F.size("w").alias("n"), shingles_of(F.col("w")).alias("shingles")).where(F.size("shingles") > 0), "leak-items")
    item_shingles = saved(items.select("item_id", "version", "n", F.posexplode("shingles").alias("q", "shingle")), "leak-shingles")

    # Places in documents of shingles that items have. A document's shingles are hashed once, kept
    # nowhere, and met by the items' distinct shingles, which are broadcast if they are few.
    d = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.col("text").cast("string").alias("text"))
    shingled = d.select("doc_id", F.xxhash64("text").alias("row"), shingles_of(words_of(F.col("text"))).alias("shingles"))
    each = shingled.select("doc_id", "row", F.size("shingles").alias("m"), F.posexplode("shingles").alias("p", "shingle"))
    known = saved(item_shingles.select("shingle").distinct(), "leak-known")
    hits = saved(each.join(checked_broadcast(known, KNOWN), "shingle").distinct(), "leak-hits")

    # The rarest shingles of each item, as many as a leak can't lack all of: places in documents times
    # items tell what a shingle costs.
    of, at = ["item_id", "version", "n"], ["doc_id", "row"]
    of_item = F.col("n") - (SHINGLE - 1)
    cost = hits.groupBy("shingle").agg(F.count("*").alias("places"))
    cost = item_shingles.groupBy("shingle").agg(F.countDistinct("item_id", "version").alias("items")).join(cost, "shingle", "left").select("shingle", (F.coalesce("places", F.lit(0)) * F.col("items")).alias("cost"))
    ranked = item_shingles.join(cost, "shingle").withColumn("rank", F.row_number().over(Window.partitionBy(*of).orderBy("cost", "shingle", "q")))
    lacking = lambda least: of_item - F.ceil(F.round(of_item * least, 9)) + 1
    whole, part = 2 * similarity / (1 + similarity), similarity
    chosen = ranked.where(F.col("rank") <= lacking(part)).groupBy("shingle", *of).agg(F.min("rank").alias("rank"))
    chosen = saved(chosen.withColumn("for_whole", F.col("rank") <= lacking(whole)).drop("rank"), "leak-chosen")

    # Windows: all that hold a chosen shingle. A shorter document is one window; it has similarity m over
    # the item's shingles at most.
    short = F.col("m") < of_item
    met = hits.join(chosen, "shingle").where(F.when(short, F.col("m") / of_item >= similarity).otherwise(F.col("for_whole")))
    first = F.when(short, F.lit(0)).otherwise(F.greatest(F.col("p") - (F.col("n") - SHINGLE), F.lit(0)))
    starts = met.select(*at, *of, F.explode(F.sequence(first, F.when(short, F.lit(0)).otherwise(F.col("p")))).alias("start"))
    starts = saved(starts.distinct(), "leak-starts")
    wanted = saved(starts.groupBy("doc_id", "row").agg(F.collect_set(F.struct("start", "n")).alias("windows")), "leak-wanted")
    # Texts without a window are left behind before texts are shuffled.
    texts = d.withColumn("row", F.xxhash64("text")).join(checked_broadcast(wanted.select(*at), KNOWN), at, "left_semi").dropDuplicates(at)
    found = texts.join(wanted, at).select(*at, shingles_of(words_of(F.col("text"))).alias("shingles"), "windows")
    fits = F.filter("windows", lambda w: (w["start"] == 0) | (w["start"] + w["n"] <= F.size("shingles") + (SHINGLE - 1)))
    cut = F.transform(fits, lambda w: F.struct(w["start"].alias("start"), w["n"].alias("n"), F.slice("shingles", w["start"] + 1, w["n"] - (SHINGLE - 1)).alias("shingles")))
    windows = saved(found.select("doc_id", "row", F.explode(cut).alias("w")).select("doc_id", "row", "w.start", "w.n", "w.shingles"), "leak-windows")

    key = ["doc_id", "row", "start", "n"]
    prints = fingerprint(windows.select(*key, F.explode("shingles").alias("shingle")), key)
    item_prints = fingerprint(item_shingles.select("item_id", "version", "n", "shingle"), ["item_id", "version", "n"])
    ours = starts.join(prints, key).select(*key, "item_id", "version", "print", F.inline(blocks(F.col("print"), radius)))
    theirs = item_prints.select(*of, F.col("print").alias("item_print"), F.inline(blocks(F.col("print"), radius)))
    near = ours.join(theirs, [*of, "block", "bits"]).withColumn("hamming", F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))).cast("int"))
    near = near.where(F.col("hamming") <= radius).select(*key, "item_id", "version", "hamming").distinct()

    # Weighted similarity, by counts of each common shingle.
    pair = [*key, "item_id", "version", "hamming", "m"]
    whole = near.join(windows, key).withColumn("m", F.size("shingles"))
    ours = whole.select(*pair, F.explode("shingles").alias("shingle")).groupBy(*pair, "shingle").agg(F.count("*").alias("k"))
    theirs = item_shingles.groupBy(*of, "shingle").agg(F.count("*").alias("k_item"))
    common = ours.join(theirs, [*of, "shingle"]).groupBy(*pair).agg(F.sum(F.least("k", "k_item")).alias("common"))
    of_both = F.col("m") + F.col("n") - (SHINGLE - 1)
    scored = common.withColumn("similarity", F.col("common") / (of_both - F.col("common"))).where(F.col("similarity") >= similarity)
    best = scored.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("hamming")).alias("closer"), (-F.col("start")).alias("earlier"), (F.col("m") + (SHINGLE - 1)).alias("n"))).alias("b"))
    return best.select("doc_id", "item_id", (-F.col("b.earlier")).alias("start"), F.col("b.n").alias("n_words"), (-F.col("b.closer")).alias("hamming"), "b.similarity")


def clean_documents(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """docs without the rows whose document holds a benchmark item; null doc_ids stay."""
    leaks = saved(find_leaks(docs, benchmark, **how).select("doc_id").distinct(), "leak-docs")
    return docs.join(checked_broadcast(leaks), "doc_id", "left_anti").select(*docs.columns)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
