"""Helpers that the corpus operators share: tables, the shared folder, checked broadcasts, words."""

from __future__ import annotations

import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pa_fs
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space, tab, line feed, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows that a side may have to be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession, rows: int = 2000) -> None:
    """Arrow batches of at most `rows` rows, so that very long texts don't pile up in one worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in tests, where that is
    unset, a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = _own_dir()
    return path.rstrip("/")


@functools.cache
def _own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="sluice-")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: a cut of lineage that outlives executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a saved table that nothing will read again, on the stores that pyarrow
    reaches; elsewhere they stay until spark.checkpoint.dir is cleaned."""
    for folder in {path.rpartition("/")[0] for path in df.inputFiles()}:
        try:
            store, path = pa_fs.FileSystem.from_uri(folder.replace("file:///", "/", 1) if folder.startswith("file:///") else folder)
            store.delete_dir(path)
        except (pa.ArrowException, OSError):
            pass


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of finished jobs now, not at some later collection
    of the driver's garbage. Only for disk; results don't depend on it."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def checked_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast only if it has at most `rows` rows; df should be a saved table."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): rows (node, component), component the smallest node.

    Every round each node takes the smallest label among its neighbours', then that label's own
    label (pointer jumping), so stars need two rounds and chains a logarithmic number. Labels are
    kept in the shared folder; nothing but a count of changes comes to the driver.
    """
    both = edges.select("a", "b").where("a <> b").distinct()
    both = saved(both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    labels = saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "cc")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = saved(labels.join(near, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("was")), "cc")
        jump = step.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = saved(step.join(jump, "label").select("node", F.least("label", "next").alias("label"), "was"), "cc")
        if new.where("label <> was").isEmpty():
            return new.select("node", F.col("label").alias("component"))
        labels = new.select("node", "label")


def by_batch(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


class WordHash(dict):
    """64-bit hashes of words, remembered; it starts anew when it is full, so memory is bounded."""

    def __init__(self, limit: int = 600_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD1B54A32D192ED03)
    return x ^ (x >> np.uint64(32))


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` word hashes, in order; with fewer words, one of the whole run;
    with none, none. A sum with odd factors, as the words' hashes are scrambled already."""
    if not len(words):
        return words
    size = min(size, len(words))
    n = len(words) - size + 1
    total = np.full(n, size * 0x9FB21C651E98DF25 % (1 << 64), np.uint64)
    for i in range(size):
        total += words[i : i + n] * np.uint64(0xA24BAED4963EE407 * (2 * i + 1) * (i + 3) % (1 << 64) | 1)
    return mixed(total)


class Filter:
    """A Bloom filter of longs with at most MOST bits, so its size is bounded whatever it holds; what
    it lets through by mistake must be dropped by a join later."""

    MOST = 1 << 27

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def places(ids, width: int) -> list[Column]:
        return [F.pmod(F.xxhash64(ids.cast("long"), F.lit(k)), F.lit(width)) for k in (1, 2)]

    @classmethod
    def of(cls, ids: DataFrame, column: str, places: Callable[[Column, int], list[Column]] | None = None) -> Filter:
        """Built on the executors; the driver gets the words of bits, at most MOST / 64."""
        n = ids.count()
        width = min(cls.MOST, 1 << max(10, (16 * max(n, 1) - 1).bit_length()))
        place = ids.select(F.explode(F.array(*(places or cls.places)(F.col(column), width))).alias("p"))
        words = place.groupBy(F.shiftright("p", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("bits")).toPandas()
        bits = np.zeros(width // 64, np.int64)
        bits[words["w"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
        return cls(bits)

    @property
    def width(self) -> int:
        return len(self.bits) * 64

    def has(self, places: list[np.ndarray]) -> np.ndarray:
        ok = True
        for p in places:
            ok = ok & ((self.bits[p >> 6] >> (p & 63)) & 1 == 1)
        return ok
