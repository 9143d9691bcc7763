"""Substring dedup by suffix automata of reference shards (operator 9).

A window is 13 consecutive words of a document; every word that a window covers goes if the window's
words also start in a document with a smaller id.

The reference is cut down before it is sharded. Each window has a minimizer, the five-word run in it
with the least hash; equal windows have equal minimizers, so a window can only recur where its
minimizer does. Consecutive windows with one minimizer form a segment. Segments whose minimizer is
in two documents or more are the reference: equal ones are one, with the smallest doc_id, and
segments with equal minimizers fall into one shard, unless they are too many for one. A shard's segments make one suffix automaton, and
the distinct segments are streamed through it: the matching statistics at each word give the state
of the window that ends there, and the state holds the smallest doc_id of all places it occurs at.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Filter, WordHash, checked_broadcast, discard, gram_hashes, release, saved, table, tune

WINDOW, GRAM = 13, 5
#: Distinct segments per shard aimed at; bounds the automaton of a task.
SHARD = 4000
MATCHES = "gram long, key long, least array<long>"


class SuffixAutomaton:
    """A suffix automaton of word sequences, each with a label; states keep the smallest label."""

    def __init__(self):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length, self.least = [-1], [0], [1 << 63]

    def _state(self, length: int, least: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        self.least.append(least)
        return len(self.length) - 1

    def _clone(self, p: int, word: bytes, q: int) -> int:
        c = self._state(self.length[p] + 1, self.least[q])
        self.next[c], self.link[c] = dict(self.next[q]), self.link[q]
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = c
            p = self.link[p]
        self.link[q] = c
        return c

    def add(self, words: list[bytes], label: int) -> None:
        last = 0
        for word in words:
            p, q = last, self.next[last].get(word)
            if q is not None:  # the sequence so far is known from another one
                last = q if self.length[q] == self.length[p] + 1 else self._clone(p, word, q)
            else:
                last = self._state(self.length[p] + 1, label)
                while p >= 0 and word not in self.next[p]:
                    self.next[p][word] = last
                    p = self.link[p]
                if p >= 0:
                    q = self.next[p][word]
                    self.link[last] = q if self.length[q] == self.length[p] + 1 else self._clone(p, word, q)
            self.least[last] = min(self.least[last], label)

    def finish(self) -> None:
        """Smallest labels go up the suffix links, from the longest states to the shortest."""
        for s in sorted(range(1, len(self.length)), key=lambda s: -self.length[s]):
            p = self.link[s]
            if self.least[s] < self.least[p]:
                self.least[p] = self.least[s]

    def matches(self, words: list[bytes], size: int) -> list[int | None]:
        """For each place where `size` words end: the smallest label with those words, or None."""
        out: list[int | None] = []
        state = matched = 0
        for i, word in enumerate(words):
            while state and word not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if word in self.next[state]:
                state = self.next[state][word]
                matched += 1
            at = state
            while at and self.length[self.link[at]] >= size:
                at = self.link[at]
            if i + 1 >= size:
                out.append(self.least[at] if matched >= size else None)
        return out


def minimizers(words: np.ndarray) -> np.ndarray:
    """The minimizer of each window: the least hash of the five-word runs in it."""
    if len(words) < WINDOW:
        return np.zeros(0, np.uint64)
    least, width, span = gram_hashes(words, GRAM), 1, WINDOW - GRAM + 1
    while width < span:  # least holds the minimum of `width` runs
        step = min(width, span - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    return least


def changes(least: np.ndarray) -> np.ndarray:
    """First windows of the segments."""
    return np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))


def _documents(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))


def _row_key(text: Column) -> Column:
    """Tells rows of one doc_id apart."""
    return F.xxhash64(text)


def _recurring(docs: DataFrame) -> DataFrame:
    """(doc_id, grams): each document's minimizers that lie in another document too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordHash()
        for batch in batches:
            ids, out = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                least = minimizers(table.of(text.split()))
                if len(least):
                    out.append(np.unique(least[changes(least)]))
                    ids.append(np.full(len(out[-1]), doc_id))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(out).view(np.int64))], ["doc_id", "gram"])

    each = _documents(docs).mapInArrow(run, "doc_id long, gram long")
    same = Window.partitionBy("gram")
    twice = each.select("doc_id", "gram", F.min("doc_id").over(same).alias("lo"), F.max("doc_id").over(same).alias("hi")).where("lo < hi")
    return twice.groupBy("doc_id").agg(F.collect_set("gram").alias("grams"))


def _segments(docs: DataFrame) -> DataFrame:
    """(doc_id, row, at, gram, key, words): segments with a recurring minimizer; minimizer and key
    together, 128 bits of hashes, stand for the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordHash()
        for batch in batches:
            rows = []
            for doc_id, text, row, wanted in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), strict=True):
                words = text.split()
                least = minimizers(table.of(words))
                if not len(least):
                    continue
                start = changes(least)
                grams = least[start].view(np.int64)
                known = np.sort(wanted.values.to_numpy())
                held = np.flatnonzero(known[np.minimum(np.searchsorted(known, grams), len(known) - 1)] == grams)
                end = np.append(start[1:], len(least))
                for a, b, gram in zip(start[held].tolist(), end[held].tolist(), grams[held].tolist(), strict=True):
                    segment = b" ".join(words[a : b + WINDOW - 1])
                    rows.append((doc_id, row, a, gram, xxhash.xxh3_64_intdigest(segment) - (1 << 63), segment))
            for i in range(0, len(rows), 50_000):
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i : i + 50_000], strict=True), kinds, strict=True)], ["doc_id", "row", "at", "gram", "key", "words"])

    recurring = saved(_recurring(docs), "recurring")
    release(docs.sparkSession)
    found = _documents(docs).join(recurring, "doc_id").select("doc_id", "text", _row_key(F.col("text")).alias("row"), "grams")
    segments = saved(found.mapInArrow(run, "doc_id long, row long, at int, gram long, key long, words binary"), "segments")
    discard(recurring)
    return segments


def _matched(segments: DataFrame) -> DataFrame:
    """(gram, key, least): for each distinct segment the smallest doc_id of each of its windows."""
    release(segments.sparkSession)
    distinct = saved(segments.groupBy("gram", "key", "words").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")), "reference")
    shards = max(1, distinct.count() // SHARD)

    def shard(group: pa.Table) -> pa.Table:
        grams, labels = group.column("gram").to_pylist(), group.column("lo").to_pylist()
        words = [w.split(b" ") for w in group.column("words").to_pylist()]
        times = Counter(grams)
        # The only segment of a minimizer shares no window with another: it needs no automaton.
        shared = [i for i, g in enumerate(grams) if times[g] > 1]
        automaton = SuffixAutomaton()
        for i in shared:
            automaton.add(words[i], labels[i])
        automaton.finish()
        least = [[lo] * (len(w) - WINDOW + 1) for w, lo in zip(words, labels, strict=True)]
        for i in shared:
            least[i] = automaton.matches(words[i], WINDOW)
        keep = [i for i, (x, hi) in enumerate(zip(least, group.column("hi").to_pylist(), strict=True)) if any(y < hi for y in x)]
        at = pa.array(keep, pa.int64())
        return pa.table({"gram": group.column("gram").take(at), "key": group.column("key").take(at), "least": pa.array([least[i] for i in keep], pa.list_(pa.int64()))})

    # A minimizer with more distinct segments than a shard should hold isn't one shard: its windows
    # meet one by one, pre-aggregated.
    hot = saved(distinct.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") > SHARD).select("gram"), "hot-minimizers")
    some = not hot.isEmpty()
    rest = distinct.join(checked_broadcast(hot), "gram", "left_anti") if some else distinct
    cut = rest.withColumn("shard", F.pmod(F.xxhash64("gram"), F.lit(shards))).groupBy("shard")
    release(segments.sparkSession)
    found = cut.applyInArrow(shard, MATCHES)
    if some:
        found = found.union(_window_by_window(distinct.join(checked_broadcast(hot), "gram", "left_semi")))
    found = saved(found, "matches")
    discard(distinct)
    release(segments.sparkSession)
    return found


def _window_by_window(distinct: DataFrame) -> DataFrame:
    """(gram, key, least) as from a shard, for minimizers with too many segments for one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for gram, key, lo, segment in zip(*(batch.column(c).to_pylist() for c in ("gram", "key", "lo", "words")), strict=True):
                words = segment.split(b" ")
                for i in range(len(words) - WINDOW + 1):
                    both = xxhash.xxh3_128_intdigest(b" ".join(words[i : i + WINDOW]))
                    rows.append((gram, key, i, (both >> 64) - (1 << 63), (both & ((1 << 64) - 1)) - (1 << 63), lo))
            for i in range(0, len(rows), 50_000):
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i : i + 50_000], strict=True), kinds, strict=True)], ["gram", "key", "i", "x", "y", "lo"])

    windows = saved(distinct.select("gram", "key", "lo", "words").mapInArrow(run, "gram long, key long, i int, x long, y long, lo long"), "hot-windows")
    least = windows.groupBy("x", "y").agg(F.min("lo").alias("least"))
    of = windows.join(least, ["x", "y"]).groupBy("gram", "key").agg(F.array_sort(F.collect_list(F.struct("i", "least"))).alias("w"))
    return of.select("gram", "key", F.col("w.least").alias("least"))


def repeated_windows(docs: DataFrame) -> DataFrame:
    """(doc_id, row, places): first words of the windows that start in a smaller document too."""
    segments = _segments(docs)
    hit = segments.select("doc_id", "row", "at", "gram", "key").join(_matched(segments), ["gram", "key"])
    places = F.transform(F.filter(F.sequence(F.lit(0), F.size("least") - 1), lambda i: F.get("least", i) < F.col("doc_id")), lambda i: i + F.col("at"))
    found = hit.select("doc_id", "row", places.alias("places")).where(F.size("places") > 0).groupBy("doc_id", "row").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"))
    found = saved(found, "repeats")
    discard(segments)
    release(docs.sparkSession)
    return found


def without_repeats(docs: DataFrame, text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, with `text`, kept: the words that stay, joined by one
    space.

    Null and empty texts have no words. Windows are judged on the input. Rows that repeat a doc_id
    are one document as to what is smaller, and each gets its own result. A row with a null doc_id
    is neither compared nor cut. Other columns are ignored; an empty table gives no rows.
    """
    tune(docs.sparkSession, 1000)
    found = repeated_windows(docs)
    keep = Filter.of(found.select("doc_id").distinct(), "doc_id")
    held = docs.sparkSession.sparkContext.broadcast(keep)
    names = ["n_words", "n_removed", "kept_sha256", *["kept"] * text]

    def result(words: list[bytes], places: np.ndarray | None) -> tuple:
        n = len(words)
        if places is not None:
            change = np.zeros(n + 1, np.int64)
            np.add.at(change, places, 1)
            np.add.at(change, places + WINDOW, -1)
            words = [words[i] for i in np.flatnonzero(np.cumsum(change)[:-1] == 0).tolist()]
        kept = b" ".join(words)
        return (n, n - len(words), hashlib.sha256(kept).hexdigest(), *[kept.decode()] * text)

    def table_of(rows: list[tuple]) -> list[pa.Array]:
        return [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), pa.int64(), *[pa.string()] * (1 + text)], strict=True)]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Results of documents that surely stay whole; the others keep their text for the join."""
        for batch in batches:
            if not batch.num_rows:
                continue
            known = batch.column("p").is_valid().to_numpy(zero_copy_only=False)
            places = [batch.column(c).fill_null(0).to_numpy() for c in ("p", "q")]
            cut = (held.value.has(places) & known).tolist()
            texts = batch.column("text").to_pylist()
            rows = [(None,) * len(names) if c else result(t.split(), None) for t, c in zip(texts, cut, strict=True)]
            open_ = pa.array([t if c else None for t, c in zip(texts, cut, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), open_, *table_of(rows)], ["doc_id", "row", "text", *names])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            done = [batch.column(c).to_pylist() for c in names]
            rows = [r if t is None else result(t.split(), p.values.to_numpy() if p.is_valid else None) for t, p, *r in zip(batch.column("text").to_pylist(), batch.column("places"), *done, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *table_of(rows)], ["doc_id", *names])

    schema = "n_words long, n_removed long, kept_sha256 string" + ", kept string" * text
    body = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    first, second = Filter.places(F.col("doc_id"), keep.width)
    known = F.col("doc_id").isNotNull()
    body = body.select("doc_id", "text", _row_key(F.col("text")).alias("row"), F.when(known, first).alias("p"), F.when(known, second).alias("q"))
    body = body.mapInArrow(whole, f"doc_id long, row long, text binary, {schema}")
    found = found.select(F.col("doc_id").alias("of"), F.col("row").alias("of_row"), "places")
    # A document has few rows; the places are of the one with its text.
    joined = body.join(found, (F.col("doc_id") == F.col("of")) & (F.col("row") == F.col("of_row")), "left")
    return joined.select("doc_id", "text", "places", *names).mapInArrow(cut, f"doc_id long, {schema}")


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"), text=False)
