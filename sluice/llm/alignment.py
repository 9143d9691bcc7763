"""Cross-tokenizer alignment (operator 11).

Both tokenizers' ids of a batch of documents become list arrays. Flattened, with parent indices, token
lengths summed up within each document are byte offsets; an Acero join of the two sides on document and
end finds the offsets at which both have a token end, and these cut the tokens into groups. A join on
the group makes the links. What a batch holds of each id pair is counted by Table.group_by, and Spark
sums the counts.

Counts come back to the documents in two ways: those of the most frequent pairs, FREQUENT at most, as a
broadcast; of the others by a join on the pair, which few of a document's links need.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, saved, table, tune

#: Folder of the public tokenizers.
TOKENIZERS = "/opt/tokenizers"
#: Pairs whose counts are broadcast, at most.
FREQUENT = 1 << 20
#: Bytes of text that are aligned in one go; a longer document is one by itself.
TEXT = 1 << 20
#: More than the ids of the second tokenizer: a pair is one number of 31 bits.
WIDE = 1 << 15
ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<int>, weights array<long>"


class ByteLevel:
    """The byte-level tokenizer: ids of texts, and each id's bytes."""

    def __init__(self, folder: str):
        import tiktoken
        from public_tokenizers import PATTERN

        with open(f"{folder}/byte_bpe_50k.tiktoken", "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.encoder = tiktoken.Encoding("byte_bpe_50k", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.tokens = pa.array(tokens, pa.binary())

    def ids(self, texts: list[str]) -> list[list[int]]:
        return [self.encoder.encode_ordinary(" " + t) for t in texts]


class Pieces:
    """The piece tokenizer, which adds the leading space itself."""

    def __init__(self, folder: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/piece_bpe_32k.model")
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        byte = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.tokens = pa.array(byte, pa.binary())

    def ids(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class Side:
    """A tokenizer with arrays of its ids' byte lengths and decimal names."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.lengths = pc.binary_length(tokenizer.tokens).cast(pa.int64())
        self.names = pa.array(map(str, range(len(tokenizer.tokens))), pa.string())

    def lists(self, texts: list[str]) -> pa.ListArray:
        return pa.array(self.tokenizer.ids(texts), pa.list_(pa.int32()))

    def joined(self, ids: pa.ListArray) -> pa.Array:
        """The bytes of each list of ids."""
        return pc.binary_join(pa.ListArray.from_arrays(ids.offsets, self.tokenizer.tokens.take(ids.values)), b"")

    def ends(self, ids: pa.ListArray) -> pa.Table:
        """`end, at` of all tokens: their list and the byte offset of their end in it as one key, and place."""
        flat, doc = pc.list_flatten(ids), pc.list_parent_indices(ids)
        length = self.lengths.take(flat)
        total = pc.cumulative_sum(length)
        before = pc.subtract(total, length).take(ids.offsets[:-1].take(doc)) if len(flat) else total
        key = pc.add(pc.shift_left(doc.cast(pa.int64()), pa.scalar(40, pa.int64())), pc.subtract(total, before))
        return pa.table({"end": key, "at": pa.array(np.arange(len(flat)))})


@cache
def sides(folder: str) -> tuple[Side, Side]:
    return Side(ByteLevel(folder)), Side(Pieces(folder))


def _join(left: pa.Table, right: pa.Table, key: str) -> pa.Table:
    return left.join(right, key, join_type="inner", use_threads=False)


def _flags(n: int, places: pa.ChunkedArray) -> np.ndarray:
    out = np.zeros(n, bool)
    out[places.to_numpy()] = True
    return out


def _named(side: Side, ids: pa.Array, last: np.ndarray) -> pa.Array:
    """The ids of each group, joined by commas."""
    offsets = np.concatenate([[0], np.flatnonzero(last) + 1]).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), side.names.take(ids)), ",")


def aligned(folder: str, texts: list[str]) -> pa.Table:
    """For each text n_a, n_b, n_groups, groups_sha256, and its linked id pairs with their numbers of links.

    Tokens of a text count only if both sides' bytes are those of the text with a leading space.
    """
    one, two = sides(folder)
    want = pa.array([f" {t}".encode() for t in texts], pa.binary())
    a, b = one.lists(texts), two.lists(texts)
    right = pc.and_(pc.equal(one.joined(a), want), pc.equal(two.joined(b), want)).to_numpy(zero_copy_only=False)
    right &= np.array([len(t) > 0 for t in texts], bool)
    if not right.all():
        keep = pa.array(np.flatnonzero(right))
        a, b = a.take(keep), b.take(keep)
    doc = np.flatnonzero(right)
    # Ends of both sides: the last tokens of groups, which are numbered alike on both sides.
    cuts = _join(one.ends(a), two.ends(b).rename_columns(["end", "at_b"]), "end")
    x, y = a.flatten(), b.flatten()
    x_last, y_last = _flags(len(x), cuts["at"]), _flags(len(y), cuts["at_b"])
    x_group, y_group = np.cumsum(x_last) - x_last, np.cumsum(y_last) - y_last
    x_doc = pc.list_parent_indices(a).to_numpy().astype(np.int64)
    group_doc = x_doc[x_last]
    groups = np.bincount(group_doc, minlength=len(doc))
    name = pc.binary_join_element_wise(_named(one, x, x_last), _named(two, y, y_last), "|")
    offsets = np.concatenate([[0], np.cumsum(groups)]).astype(np.int32)
    lines = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), name), ";")
    # Links: of groups of two tokens at once, of others by a join on the group; equal ids of a group are one
    # row there with their number, so a long group of few ids stays small.
    x, y = x.to_numpy().astype(np.int64), y.to_numpy().astype(np.int64)
    two_only = (np.bincount(x_group, minlength=len(group_doc)) == 1) & (np.bincount(y_group, minlength=len(group_doc)) == 1)
    more_x, more_y = ~two_only[x_group], ~two_only[y_group]
    pair = [group_doc[two_only] << 31 | x[~more_x] * WIDE + y[~more_y]]
    times = [np.ones(len(pair[0]), np.int64)]
    counted = lambda t: t.group_by(t.column_names, use_threads=False).aggregate([([], "count_all")])
    left = counted(pa.table({"group": x_group[more_x], "a": x[more_x]}))
    right = counted(pa.table({"group": y_group[more_y], "b": y[more_y]})).rename_columns(["group", "b", "times"])
    links = _join(left, right, "group")
    pair.append(group_doc[links["group"].to_numpy()] << 31 | links["a"].to_numpy() * WIDE + links["b"].to_numpy())
    times.append(pc.multiply(links["count_all"], links["times"]).to_numpy())
    pairs = pa.table({"pair": np.concatenate(pair), "n": np.concatenate(times)}).group_by("pair", use_threads=False).aggregate([("n", "sum")])
    keys = pairs["pair"].to_numpy()
    order = np.argsort(keys)
    of = keys >> 31
    n = np.zeros((len(texts), 4), np.int64)
    n[doc] = np.stack([np.bincount(x_doc, minlength=len(doc)), np.diff(b.offsets.to_numpy()), groups, np.bincount(of, minlength=len(doc))], axis=1)
    digests = [""] * len(texts)
    for d, line in zip(doc.tolist(), lines.to_pylist(), strict=True):
        digests[d] = hashlib.sha256(line.encode()).hexdigest()
    offsets = pa.array(np.concatenate([[0], np.cumsum(n[:, 3])]).astype(np.int32))
    values = [pa.array((keys[order] & ((1 << 31) - 1)).astype(np.int32)), pa.array(pairs["n_sum"].to_numpy()[order])]
    columns = [*(pa.array(n[:, i]) for i in range(3)), pa.array(digests, pa.string()), *(pa.ListArray.from_arrays(offsets, v) for v in values)]
    return pa.table(columns, names=["n_a", "n_b", "n_groups", "groups_sha256", "pairs", "weights"])


def alignments(docs: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """ALIGNED rows: one per document, `row` telling rows of one doc_id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) <= TEXT):
                    size += len(texts[end])
                    end += 1
                found = aligned(folder, texts[at:end])
                yield from pa.table([batch.column(0)[at:end], batch.column(1)[at:end], *found.columns], names=["row", "doc_id", *found.column_names]).combine_chunks().to_batches()
                at = end

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    each = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    return saved(each.mapInArrow(run, ALIGNED), "aligned")


def pair_counts(each: DataFrame) -> DataFrame:
    """(pair, n, best): in how many documents a pair is linked, and whether no pair of its first id is in
    more. Each task counts batches by Table.group_by; Spark sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Array] = []
        size = 0

        def counted() -> pa.RecordBatch:
            out = pa.table({"pair": pa.chunked_array(held, pa.int32())}).group_by("pair", use_threads=False).aggregate([([], "count_all")])
            return out.rename_columns(["pair", "n"]).combine_chunks().to_batches()[0]

        for batch in batches:
            held.append(batch.column(0).flatten())
            size += len(held[-1])
            if size >= 4_000_000:
                yield counted()
                held, size = [], 0
        if size:
            yield counted()

    sums = saved(each.select("pairs").mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")
    first = F.shiftright("pair", WIDE.bit_length() - 1)
    most = sums.groupBy(first.alias("first")).agg(F.max("n").alias("most"))
    return saved(sums.withColumn("first", first).join(most, "first").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pair-ranks")


def _frequent(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """The most frequent pairs, `most` at most, with counts and ranks, by pair; and whether they are all."""
    size = F.floor(F.log2("n") * 16)
    histogram = sorted(((r[0], r[1]) for r in counts.groupBy(size.alias("size")).count().collect()), reverse=True)
    total, least = 0, None
    for bucket, n in histogram:
        if total + n > most:
            break
        total, least = total + n, bucket
    if least is None:
        return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, bool), not histogram
    top = counts.where(size >= least).toPandas().sort_values("pair")
    return top["pair"].to_numpy(np.int32), top["n"].to_numpy(np.int64), top["best"].to_numpy(bool), total == sum(n for _, n in histogram)


def linked(docs: DataFrame, folder: str = TOKENIZERS, frequent: int | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each document.

    Null and empty texts, and texts that a tokenizer doesn't give back byte by byte, have no tokens:
    zeros and an empty digest. Every row is a document, rows that repeat a doc_id or have none included.
    Other columns are ignored; an empty table gives no rows. A document's tokens are held at once.
    """
    tune(docs.sparkSession, 1000)
    each = alignments(docs, folder)
    counts = pair_counts(each)
    pairs, n, best, all_ = _frequent(counts, FREQUENT if frequent is None else frequent)
    known = docs.sparkSession.sparkContext.broadcast((pairs, n, best))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = known.value
        for batch in batches:
            if not batch.num_rows:
                continue
            flat, weight = batch.column("pairs").flatten().to_numpy(), batch.column("weights").flatten().to_numpy()
            row = pc.list_parent_indices(batch.column("pairs")).to_numpy()
            at = np.minimum(np.searchsorted(pairs, flat), max(0, len(pairs) - 1))
            hit = pairs[at] == flat if len(pairs) else np.zeros(len(flat), bool)
            at, sums = at[hit], np.zeros((3, batch.num_rows), np.int64)
            np.add.at(sums[0], row, weight)
            np.add.at(sums[1], row[hit], weight[hit] * best[at])
            np.add.at(sums[2], row[hit], weight[hit] * n[at])
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[~hit], minlength=batch.num_rows))]).astype(np.int32))
            rest = [pa.ListArray.from_arrays(offsets, pa.array(v[~hit])) for v in (flat, weight)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:6]), *map(pa.array, sums), *rest], names)

    schema = "row long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, n_links long, n_best long, count_sum long, pairs array<int>, weights array<long>"
    names = [c.split()[0] for c in schema.split(", ")]
    found = each.mapInArrow(run, schema)
    if all_:
        return found.drop("row", "pairs", "weights")
    found = saved(found, "linked")
    discard(each)
    rest = found.select("row", F.explode(F.arrays_zip("pairs", "weights")).alias("p")).select("row", "p.pairs", "p.weights")
    more = rest.join(counts, rest["pairs"] == counts["pair"]).groupBy("row").agg(F.sum(F.expr("IF(best, weights, 0L)")).alias("more_best"), F.sum(F.col("weights") * F.col("n")).alias("more"))
    both = found.drop("pairs", "weights").join(more, "row", "left")
    return both.withColumns({"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more", F.lit(0))}).drop("row", "more_best", "more")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "documents"))
