"""Size-aware heavy-light Jaccard join of documents on five-word shingles (operator 3).

Sets are classes of documents with equal shingles, so copies count once. The join runs in these
steps, all on Spark:

1. One pass hashes every text's set and writes, per document, the class, the size, a sketch and the
   set's first shingles in the order of hashes: the prefix that any linked set must meet, and some more.
2. The prefixes' shingles are counted. Those in many documents go last in the order, by a filter of
   bounded size; few sets need their text a second time for their new prefix.
3. Keys: small sets enumerate the pairs (fixed-size subsets) of their prefix and large sets enter the
   inverted lists of theirs. The boundary is the size with the least cost by the histogram of sizes and
   the measured length of the lists.
4. Short lists are joined in full, and a pair must share as many keys as its sizes ask for. Long lists,
   those of large groups of near copies, first link each member to the most central ones of about its
   size, the smallest ones, or one drawn member, then the components that this has made meet again, in
   rounds; only lists that stay mixed are joined in full, between components.
5. Pairs whose sketches allow it are verified by the exact similarity of whole sets.

The order of shingles, the draws and the boundary decide only how much work it takes, never what is
found.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import comb
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Filter, WordHash, by_batch, components, discard, gram_hashes, mixed, release, saved, table, tune

SHINGLE = 5
#: Links have NUMERATOR * union <= DENOMINATOR * intersection: a similarity of 0.75 or more.
NUMERATOR, DENOMINATOR = 75, 100
THRESHOLD = NUMERATOR / DENOMINATOR
#: Shingles per bucket of a sketch.
PER_BUCKET = 4
#: Subset size of small sets, and the sizes among which the boundary is chosen. Sets up to the largest
#: are kept whole by the survey; of others it keeps the prefix and one EXTRA-th more.
SUBSET, BOUNDARIES, EXTRA = 2, range(0, 49, 4), 4
#: Shingles in more prefixes than this go last in the order; lists with more sets than this are long.
LONG_LIST = 16
#: Counts of keys, by the low bits of the key: TAILS longs of four lanes of 16 bits. Sets of as many
#: shingles as a lane can't count are met without them.
TAILS = ("t0", "t1", "t2", "t3")
#: Sizes of sets in steps, STEPS of them to the least size that a set can link to.
STEPS = 4
#: Rounds in which the members of long lists meet one drawn member, before lists are joined in full.
ROUNDS = 4
#: Rounds end when not even one of so many pairs links: what is still apart then hardly has links.
FRUITFUL = 10
#: Ids of nodes (8 bytes each) that are broadcast at most.
FEW = 200_000


def shingle_set(text: bytes | None, table: WordHash) -> np.ndarray:
    """Sorted distinct hashes of a text's five-word shingles, A-Z in lower case."""
    words = table.of(text.lower().split()) if text else np.zeros(0, np.uint64)
    return np.unique(gram_hashes(words, SHINGLE))


def overlap_needed(n: int) -> int:
    """Shingles that a set of n must share with any set it links to."""
    return -(-NUMERATOR * n // DENOMINATOR)


def linked(a: np.ndarray, b: np.ndarray) -> tuple[bool, float]:
    """Whether two sorted sets link, and their Jaccard distance."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    union = len(a) + len(b) - both
    return union > 0 and DENOMINATOR * both >= NUMERATOR * union, 1 - both / union if union else 1.0


def _ids(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))


def sketch_of(s: np.ndarray) -> bytes:
    """Members of the set per range of hashes, about PER_BUCKET each; a power of two of ranges."""
    bits = max(2, (len(s) // PER_BUCKET).bit_length())
    return np.minimum(np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()


def most_similar(a: bytes, b: bytes) -> float:
    """No sets with these sketches are more similar than this: ranges share their lesser count."""
    x, y = np.frombuffer(a, np.uint8).astype(np.int64), np.frombuffer(b, np.uint8).astype(np.int64)
    if x.max() == 255 or y.max() == 255:  # counts stop there, so they say nothing
        return 1.0
    width = min(len(x), len(y))
    x, y = x.reshape(width, -1).sum(1), y.reshape(width, -1).sum(1)
    both = int(np.minimum(x, y).sum())
    return both / (int(x.sum()) + int(y.sum()) - both)


SURVEYED = "doc_id long, of long, n int, class long, digest long, sketch binary, firsts array<long>"
NAMES = [x.split()[0] for x in SURVEYED.split(", ")]


def prefix(n: int) -> int:
    """How many of a set's first shingles, in any fixed order, meet those of any set it links to."""
    return n - overlap_needed(n) + 1


def class_of(s: np.ndarray, seed: int) -> tuple[int, int]:
    """Two 64-bit hashes of a set: its class, and a digest that must be equal within a class."""
    both = xxhash.xxh3_128_intdigest(s.tobytes(), seed)
    return (both >> 64) - (1 << 63), (both & ((1 << 64) - 1)) - (1 << 63)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    flat = np.concatenate([*arrays, np.zeros(0, np.uint64)]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def survey(docs: DataFrame, seed: int) -> DataFrame:
    """Step 1: a row per document."""
    most = max(BOUNDARIES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHash()
        for batch in batches:
            rows, firsts = [], []
            for text in batch.column(1).to_pylist():
                s = shingle_set(text, words)
                n = len(s)
                rows.append((n, *class_of(s, seed), sketch_of(s)) if n else (0, None, None, None))
                firsts.append(s if n <= most else s[: prefix(n) * (EXTRA + 1) // EXTRA])
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *[pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], _lists(firsts)], NAMES)

    return saved(_ids(docs).withColumn("of", F.xxhash64("text")).mapInArrow(run, SURVEYED), "jaccard-survey")


def shingle_places(key: Column, width: int) -> list[Column]:
    """Places of a shingle in a filter; shingles are hashes already, so their low bits do."""
    return [key.bitwiseAND(F.lit(width - 1)), F.shiftrightunsigned(key, 27).bitwiseAND(F.lit(width - 1))]


def ordered(s: np.ndarray, last: Filter) -> tuple[np.ndarray, int]:
    """The shingles with those of the filter last, and how many aren't in it."""
    often = last.has([(s & np.uint64(last.width - 1)).astype(np.int64), (s >> np.uint64(27) & np.uint64(last.width - 1)).astype(np.int64)])
    return np.concatenate([s[~often], s[often]]), len(s) - int(often.sum())


def keys_of(s: np.ndarray, n: int, limit: int) -> np.ndarray:
    """Step 3: the keys of a set of n whose first shingles in the order are s."""
    keys, p = [np.zeros(0, np.uint64)], prefix(n)
    if n > limit or n >= overlap_needed(limit + 1):
        keys.append(s[:p])  # the shingle itself
    if SUBSET < n <= limit:
        x = s[: p + SUBSET - 1]
        i, j = np.triu_indices(len(x), 1)
        keys.append(mixed(np.minimum(x[i], x[j]) * np.uint64(5) + mixed(np.maximum(x[i], x[j]))))
    return np.concatenate(keys)


def boundary(sizes: list[tuple[int, int]], listed: float) -> int:
    """The largest size whose sets enumerate subsets: that with the least keys and lookups.

    sizes: (set size, number of sets), of small sets; listed: mean length of the lists that an entry
    of theirs meets. A subset costs its key; an entry costs its key and the list. Large sets near the
    boundary are met by small ones in the lists, so those enter both.
    """

    def cost(limit: int) -> float:
        total = 0.0
        for n, times in sizes:
            p = prefix(n)
            if SUBSET < n <= limit:
                total += times * comb(p + SUBSET - 1, SUBSET)
            if n > limit or n >= overlap_needed(limit + 1):
                total += times * p * (1 + listed)
        return total

    return min(BOUNDARIES, key=cost)


def entries(docs: DataFrame, surveyed: DataFrame, classes: DataFrame) -> tuple[DataFrame, int, Filter]:
    """Steps 2 and 3: (key, class), once each, the boundary, and the shingles that go last."""
    most, spark = max(BOUNDARIES), docs.sparkSession
    each = surveyed.where("n > 0").select(F.explode("firsts").alias("key"), (F.col("n") <= most).cast("int").alias("small"))
    counts = saved(each.groupBy("key").agg(F.count("*").alias("m"), F.sum("small").alias("small")).where("m > 1"), "jaccard-counts")
    release(spark)
    sizes = [(r[0], r[1]) for r in surveyed.where(f"n > 0 AND n <= {most}").groupBy("n").count().collect()]
    met = counts.where(F.col("m") <= LONG_LIST).agg(F.coalesce(F.sum(F.col("small") * (F.col("m") - 1)), F.lit(0))).first()[0]
    limit = boundary(sizes, 1 + met / max(1, sum(n * times for n, times in sizes)))
    often = saved(counts.where(F.col("m") > LONG_LIST).select("key"), "jaccard-often")
    discard(counts)
    whole = surveyed.where("n > 0").select("class", "n", "firsts")

    def beyond(last: Filter) -> DataFrame:
        """Whole sets of the classes whose kept shingles don't hold their prefix."""
        held = spark.sparkContext.broadcast(last)

        def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                need = [len(f) < n and ordered(f.values.to_numpy().view(np.uint64), held.value)[1] < prefix(n) for n, f in zip(batch.column(1).to_pylist(), batch.column(2), strict=True)]
                yield batch.select([0]).filter(pa.array(need, pa.bool_()))

        redo = whole.mapInArrow(again, "class long").distinct().join(classes.select("class", "lo", "of"), "class")
        return saved(sets_of(docs, saved(redo, "jaccard-redo")), "jaccard-beyond")

    # The shingles of those sets that the survey didn't keep are counted too.
    sets = beyond(Filter.of(often, "key", shingle_places))
    more = by_batch(sets.select("items"), _shingles, "keys array<long>").select(F.explode("keys").alias("key")).groupBy("key").count().where(F.col("count") > LONG_LIST).select("key")
    last = Filter.of(often.union(more).distinct(), "key", shingle_places)
    sets = beyond(last)
    held = spark.sparkContext.broadcast(last)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = []
            for n, f in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                s, first = ordered(f.values.to_numpy().view(np.uint64), held.value)
                keys.append(keys_of(s, n, limit) if len(s) == n or first >= prefix(n) else s[:0])
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(keys)], ["class", "keys"])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.frombuffer(x, np.uint64) for x in batch.column(1).to_pylist()]
            keys = [keys_of(ordered(s, held.value)[0], len(s), limit) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(keys)], ["class", "keys"])

    keyed = "class long, keys array<long>"
    both = whole.mapInArrow(kept, keyed).union(sets.select("class", "items").mapInArrow(made, keyed))
    return saved(both.select(F.explode("keys").alias("key"), "class").distinct(), "jaccard-entries"), limit, last


def _shingles(batch: pa.RecordBatch) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([_lists([np.frombuffer(x, np.uint64) for x in batch.column(0).to_pylist()])], ["keys"])


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(class, items): sorted sets as bytes of the documents lo of wanted (class, lo, of). Texts aren't
    shuffled for it: a filter of ids finds them, and the join drops what it lets through besides."""
    keep = Filter.of(wanted, "lo")
    held = docs.sparkSession.sparkContext.broadcast(keep)
    first, second = Filter.places(F.col("doc_id"), keep.width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHash()
        for batch in batches:
            batch = batch.filter(pa.array(held.value.has([batch.column("p").to_numpy(), batch.column("q").to_numpy()]), pa.bool_()))
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(t, words).tobytes() for t in batch.column(1).to_pylist()], pa.binary()), batch.column("of")], ["doc_id", "items", "of"])

    # A doc_id with several texts has several sets: the text's own hash tells which is meant.
    found = _ids(docs).select("doc_id", "text", first.alias("p"), second.alias("q"), F.xxhash64("text").alias("of")).mapInArrow(run, "doc_id long, items binary, of long")
    return found.join(wanted.select(F.col("lo").alias("doc_id"), "class", "of"), ["doc_id", "of"]).select("class", "items").dropDuplicates(["class"])


def possible(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """pairs (a, b) whose sketches allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [most_similar(x, y) >= THRESHOLD - 1e-9 for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    pairs = saved(pairs, "jaccard-pairs")
    of = few_of(classes.select("class", "sketch"), pairs)
    both = pairs.join(of.toDF("a", "x"), "a").join(of.toDF("b", "y"), "b")
    return saved(both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "jaccard-possible")


def few_of(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows (class, ...) of the classes in pairs, cut down before they are shuffled if few."""
    ids = saved(pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct(), "jaccard-ids")
    return rows.join(F.broadcast(ids), "class", "left_semi") if ids.limit(FEW + 1).count() <= FEW else rows


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that link, by their whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64))[0] for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    pairs = saved(pairs, "jaccard-asked")
    of = few_of(sets, pairs)
    both = pairs.join(of.toDF("a", "x"), "a").join(of.toDF("b", "y"), "b")
    return saved(both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "jaccard-links")


def fits(n: str, m: str) -> Column:
    """Whether sets of n and m can link by their sizes."""
    return F.least(n, m) * DENOMINATOR >= F.greatest(n, m) * NUMERATOR


def shared_keys() -> Column:
    """Prefix shingles that sets of na and nb share at least if they link: the one whose prefix ends
    first in the order has all but its rest's share of the overlap within both."""
    overlap = F.expr(f"int(((na + nb) * {NUMERATOR}L + {NUMERATOR + DENOMINATOR - 1}) div {NUMERATOR + DENOMINATOR})")
    rest = F.expr(f"int((greatest(na, nb) * {NUMERATOR}L + {DENOMINATOR - 1}) div {DENOMINATOR}) - 1")
    return overlap - rest


def close_pairs(lists: DataFrame, limit: int) -> DataFrame:
    """Pairs (a, b, c) of classes in short lists with c common keys, as many as a link needs; keys in
    long lists, which aren't joined here, are taken as shared."""
    short, long = lists.where(F.col("m") <= LONG_LIST), lists.where(F.col("m") > LONG_LIST)
    x, y = short.select("key", F.col("class").alias("a"), F.col("n").alias("na")), short.select("key", F.col("class").alias("b"), F.col("n").alias("nb"))
    met = x.join(y, "key").where((F.col("a") < F.col("b")) & fits("na", "nb")).groupBy("a", "b", "na", "nb").agg(F.count("*").alias("c"))
    beyond = saved(long.groupBy("class").agg(F.count("*").alias("l")), "jaccard-beyond")
    few = beyond.limit(FEW + 1).count() <= FEW
    for side in "ab":
        of = beyond.select(F.col("class").alias(side), F.col("l").alias(f"l{side}"))
        met = met.join(F.broadcast(of) if few else of, side, "left")
    enough = F.col("c") + F.least(F.coalesce("la", F.lit(0)), F.coalesce("lb", F.lit(0))) >= shared_keys()
    return met.where(enough | (F.least("na", "nb") <= limit)).select("a", "b", "c")


def telling(lists: DataFrame, limit: int) -> DataFrame:
    """The entries (key, class, n, *TAILS) of long lists by which each class must meet those it links to.

    Of a class's keys, the rarest first, the last T - 1 may go if it shares T keys or more with any
    set it links to: the first common key of such a pair has the others after it in both. T is the
    least that the sizes in the class's long lists allow; keys in short lists count, too. TAILS
    count the class's keys from this one on, by four bits of the key.
    """
    ratio = f"{NUMERATOR}D / {NUMERATOR + DENOMINATOR}"
    long = lists.where(F.col("m") > LONG_LIST)
    sizes = long.groupBy("key").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    lo, hi = f"greatest(lo, ceil(n * {THRESHOLD}D))", f"least(hi, floor(n / {THRESHOLD}D))"
    least = F.expr(f"least((n + {lo}) * {ratio} - n * {THRESHOLD}D, (n + {hi}) * {ratio} - {hi} * {THRESHOLD}D)")
    shared = long.join(sizes, "key").groupBy("class").agg(F.greatest(F.lit(1), F.floor(F.min(least) - 1e-9) + 1).alias("t"))
    own = Window.partitionBy("class")
    ranked = lists.join(shared, "class").withColumn("r", F.row_number().over(own.orderBy("m", "key"))).withColumn("l", F.count("*").over(own))
    rest = own.orderBy("m", "key").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    for i, name in enumerate(TAILS):
        one = F.expr(f"CASE WHEN (key & 12) = {4 * i} THEN shiftleft(1L, int(16 * (key & 3))) ELSE 0L END")
        ranked = ranked.withColumn(name, F.sum(one).over(rest))
    return ranked.where((F.col("m") > LONG_LIST) & ((F.col("n") <= limit) | (F.col("r") <= F.col("l") - F.col("t") + 1))).select("key", "class", "n", *TAILS)


def central(sets: DataFrame, last: Filter) -> DataFrame:
    """(class, central): the share of a set's shingles that are in the filter of frequent ones. An unedited
    copy has most of its group's."""
    held = sets.sparkSession.sparkContext.broadcast(last)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [np.frombuffer(x, np.uint64) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([1 - ordered(s, held.value)[1] / len(s) for s in each], pa.float64())], ["class", "central"])

    return saved(sets.select("class", "items").mapInArrow(run, "class long, central double"), "jaccard-central")


def links(docs: DataFrame, surveyed: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges (a, b) between linked classes, enough of them to join what is linked."""
    spark = docs.sparkSession
    made, limit, last = entries(docs, surveyed, classes)
    discard(surveyed)
    release(spark)
    # Lists of one set go; the others' lengths are counted before the join, so a hot list can be split.
    lengths = made.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    lists = made.join(lengths, "key").join(classes.select("class", "n"), "class").select("key", "class", "n", "m")
    lists = saved(lists, "jaccard-lists")
    discard(made)
    release(spark)
    near = possible(close_pairs(lists, limit).select("a", "b"), classes)
    long = saved(telling(lists, limit), "jaccard-long")
    wanted = near.select(F.explode(F.array("a", "b")).alias("class")).union(long.select("class")).distinct()
    sets = saved(sets_of(docs, saved(wanted.join(classes.select("class", "lo", "of"), "class"), "jaccard-wanted")), "jaccard-sets")
    release(spark)

    # First each class meets one neighbour of the short lists, and one drawn member of each long list.
    ways = near.union(near.select("b", "a"))
    best = ways.groupBy("a").agg(F.min_by("b", F.xxhash64(F.least("a", "b"), F.greatest("a", "b"))).alias("b"))
    first = best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    found = verified(first, sets)
    at = long.join(central(sets, last), "class").select("key", "class", "n", "central", *TAILS, F.col("class").alias("component"))
    for k in range(ROUNDS):
        if k and at.isEmpty():
            break
        hub, step = F.struct("class", "n", "component"), F.floor(F.log("n") / float(np.log(1 / THRESHOLD)) * STEPS).cast("int")
        if k % 2:  # any member: right for copies with edits, which are about equally near
            drawn = at.groupBy("key").agg(F.min_by(hub, F.xxhash64("class", "key", F.lit(k))).alias("d"))
            met = at.join(drawn, "key")
        else:  # the most central of about its size, what a group's edits are edits of; then the smallest: right for a common passage with more or less beside it
            best = F.struct("n", F.xxhash64("class", "key", F.lit(k))) if k else F.struct(-F.col("central"), F.xxhash64("class"))
            drawn = at.groupBy("key", step.alias("at")).agg(F.min_by(hub, best).alias("d"))
            met = at.withColumn("at", F.explode(F.array(*[step - i for i in range(STEPS + 1)]))).join(drawn, ["key", "at"])
        pairs = met.where((F.col("component") != F.col("d.component")) & fits("n", "d.n"))
        pairs = pairs.select(F.least("class", "d.class").alias("a"), F.greatest("class", "d.class").alias("b")).distinct()
        pairs = possible(pairs, classes)
        new = verified(pairs, sets)
        linking = new.count()
        if linking or not k:
            found = found.union(new)
            joined = components(found)
            at = saved(still_mixed(at, joined), "jaccard-mixed")
            release(spark)
        if k and linking * FRUITFUL < pairs.count():
            break
    rest = apart(near, joined)
    x, y = (at.select("key", F.col("class").alias(c), F.col("n").alias(f"n{c}"), F.col("component").alias(f"c{c}"), *[F.col(t).alias(t + c) for t in TAILS]) for c in "ab")
    # If this key is the first common one, no more are common than either has from here on.
    count = lambda name, i: F.shiftrightunsigned(name, 16 * i).bitwiseAND(F.lit(0xFFFF))
    most = reduce(add, [F.least(count(t + "a", i), count(t + "b", i)) for t in TAILS for i in range(4)])
    enough = (most >= shared_keys()) | (F.least("na", "nb") <= limit) | (F.least("na", "nb") >= 0xFFFF)
    full = x.join(y, "key").where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & fits("na", "nb") & enough).select("a", "b").distinct()
    return found.union(verified(rest.select("a", "b").union(possible(full, classes)), sets))


def _labels(joined: DataFrame, name: str) -> DataFrame:
    of = joined.select(F.col("node").alias(name), F.col("component").alias(f"at_{name}"))
    return F.broadcast(of) if joined.limit(FEW + 1).count() <= FEW else of


def apart(pairs: DataFrame, joined: DataFrame) -> DataFrame:
    """Pairs whose classes aren't in one component."""
    both = pairs.join(_labels(joined, "a"), "a", "left").join(_labels(joined, "b"), "b", "left")
    return both.where(F.coalesce("at_a", "a") != F.coalesce("at_b", "b")).select(*pairs.columns)


def still_mixed(lists: DataFrame, joined: DataFrame) -> DataFrame:
    """The lists (key, class, n, central, *TAILS, component) that hold more than one component yet."""
    of = lists.select("key", "class", "n", "central", *TAILS).join(_labels(joined, "class"), "class", "left")
    of = saved(of.select("key", "class", "n", "central", *TAILS, F.coalesce("at_class", "class").alias("component")), "jaccard-at")
    mixed = of.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
    return of.join(mixed, "key")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links) of every document.

    Two documents link when 100 * intersection >= 75 * union of their sets of five-word shingles;
    with fewer words the whole sequence is one shingle. Null, empty and blank texts have no shingles
    and link with nothing. Rows that repeat a doc_id are one node, whose links are those of any of
    its texts; each row keeps its own n_shingles. A row with a null doc_id has a null component.
    Other columns are ignored; an empty table gives no rows.
    """
    tune(docs.sparkSession)
    for seed in range(8):  # sets with equal 64-bit classes and other digests are all but impossible
        surveyed = survey(docs, seed)
        rows = saved(surveyed.select("doc_id", "n", "class"), "jaccard-rows")
        grouped = surveyed.where("n > 0").groupBy("class").agg(F.min(F.struct("doc_id", "of")).alias("lo"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), (F.min("digest") < F.max("digest")).alias("clash"))
        classes = saved(grouped.select("class", F.col("lo.doc_id").alias("lo"), F.col("lo.of").alias("of"), "n", "sketch", "clash"), "jaccard-classes")
        if classes.where("clash").isEmpty():
            break
        discard(surveyed)
    else:
        raise ValueError("hashes of different sets clash under every seed")
    edges = links(docs, surveyed, classes)
    # A doc_id with several texts joins their classes.
    several = rows.where("n > 0").groupBy("doc_id").agg(F.min("class").alias("a"), F.max("class").alias("hi")).where("a < hi").select("doc_id", "a")
    edges = edges.union(rows.where("n > 0").join(several, "doc_id").where("class <> a").select("a", F.col("class").alias("b")))
    joined = components(edges)
    labelled = classes.select("class", "lo").join(joined.withColumnRenamed("node", "class"), "class", "left").select("class", "lo", F.coalesce("component", "class").alias("component"))
    labelled = saved(labelled, "jaccard-labelled")
    least = labelled.groupBy("component").agg(F.min("lo").alias("component_id"))
    of = saved(labelled.join(least, "component").select("class", "component_id"), "jaccard-least")
    # A row of a doc_id without shingles belongs to the component of the doc_id's other texts.
    ids = rows.where("n > 0").join(of, "class").select("doc_id", "component_id")
    moved = ids.where("doc_id <> component_id").distinct()
    result = rows.select("doc_id", F.col("n").cast("long").alias("n_shingles")).join(moved, "doc_id", "left")
    result = result.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    without = docs.where("doc_id IS NULL").select(F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return result.union(without)


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one document of each group of linked ones, that with the smallest doc_id."""
    found = near_duplicates(docs).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(saved(found, "jaccard-dropped"), "doc_id", "left_anti").select(*docs.columns)


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
