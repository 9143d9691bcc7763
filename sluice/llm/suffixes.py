"""Suffix-array dedup of byte strings (operator 12).

A window is WINDOW consecutive bytes of a document. Every byte goes that lies in a window whose bytes also
start somewhere else, in the same document or another.

What a suffix array must order is found first. Each window has a minimizer, the 16-byte gram in it with
the least hash (the leftmost of equal ones). Equal windows have equal minimizers at equal places, so all
copies of a window meet under its gram. Consecutive windows with one gram are a segment; equal segments
are one, with a count. Segments that are not alone under their gram are dealt into shards by gram; the
suffix array of a gram's segments, by linear grouping, brings equal windows together: a window recurs if
its neighbour in the array has the same first WINDOW bytes, or if its segment does. The arrays of a
shard are built side by side.

A gram with more than a few segments, be it a hot one, is split by what equal windows must share: windows
whose gram lies about equally deep (to STEPS bytes) hold the same bytes around it, so pieces of segments
are dealt anew by a hash of those bytes, in ever finer steps, down to single windows. Pieces that are all
equal recur as they are, if there are two.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Filter, discard, mixed, release, saved, table, tune

WINDOW, GRAM = 400, 16
#: Grams of a window.
SPAN = WINDOW - GRAM + 1
#: Windows of a segment at most; bytes that are looked at in one go.
LONGEST, CHUNK = WINDOW, 1 << 22
#: Bytes of a shard aimed at.
SHARD = 2_000_000
#: Pieces that a part may have before it is split, and depths of a gram that count as one when it is; after
#: the last split a part is a single window.
STEPS = ((3, 49), (8, 7), (8, 1))


def suffix_arrays(texts: list[np.ndarray]) -> list[np.ndarray]:
    """The suffix array of each text, a least end symbol after it, by linear grouping construction.

    First phase: suffixes are grouped by first symbol, and groups are taken from the highest to the
    lowest. Each member's previous smaller suffix, the nearest one to its left that is still in a lower
    group, is found by jumping over what is higher. The suffixes that are pointed at leave their group
    for new ones right above it, one per number of pointers. In the end each group holds the suffixes
    of one Lyndon prefix. Second phase: taken in order, each suffix puts its left neighbour, and along
    the pointers those that it precedes, at the front of what is left of their groups.

    The texts advance side by side: a round takes one group of each.
    """
    lengths = np.array([len(t) for t in texts], np.int64)
    base = np.cumsum(lengths + 1) - lengths  # position 0 and the one after each text are ends
    n = int((lengths + 1).sum()) + 1
    symbol = np.zeros(n, np.int16)
    for at, t in zip(base, texts, strict=True):
        symbol[at : at + len(t)] = t
    inner = symbol != 0
    of = np.repeat(np.arange(len(texts)), lengths + 1)
    key = of * 1000 + symbol[1:]
    members = np.argsort(key, kind="stable")
    key = key[members]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    lane = of[members[first]]
    del of, key, symbol
    count = len(first)
    pool = np.empty(2 * n, np.int64)
    pool[: n - 1] = members + 1
    del members
    start, size, above, below, free = (np.full(count + n, -1, np.int64) for _ in range(5))
    start[:count], size[:count] = first, np.diff(np.append(first, n - 1))
    group = np.zeros(n, np.int64)
    group[pool[: n - 1]] = np.repeat(np.arange(count), size[:count])
    above[:count] = np.arange(1, count + 1)
    above[:count][np.append(lane[1:] != lane[:-1], True)] = -1
    below[:count] = np.arange(-1, count - 1)
    below[:count][np.append(True, lane[1:] != lane[:-1])] = -1
    jump = np.arange(-1, n - 1)
    previous = np.zeros(n, np.int64)
    high = np.zeros(n, bool)
    current = np.flatnonzero(above[:count] < 0)
    room = base + lengths + 1  # where what isn't placed yet ends
    lanes = np.arange(len(texts))
    top = n - 1
    while True:
        going = below[current] >= 0
        if not going.all():
            current, lanes = current[going], lanes[going]
        if not len(current):
            break
        k = size[current]
        ends = np.cumsum(k)
        m = pool[np.arange(ends[-1]) - np.repeat(ends - k - start[current], k)]
        owner = np.repeat(np.arange(len(current)), k)
        still = group[m] == current[owner]
        m, owner = m[still], owner[still]
        room[lanes] -= np.bincount(owner, minlength=len(current))
        free[current] = room[lanes]
        high[m] = True
        p = m - 1
        on = np.flatnonzero(high[p])
        while len(on):
            q = jump[p[on]]
            p[on] = q
            jump[m[on]] = q
            on = on[high[q]]
        previous[m] = jump[m] = p
        p = p[inner[p]]
        if len(p):
            at = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
            times, p = np.diff(np.append(at, len(p))), p[at]
            old = group[p]
            key = old * (times.max() + 1) + times
            order = np.argsort(key, kind="stable")
            p, old, key = p[order], old[order], key[order]
            at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            many = np.diff(np.append(at, len(p)))
            new = np.arange(count, count + len(at))
            start[new], size[new] = top + at, many
            pool[top : top + len(p)] = p
            group[p] = np.repeat(new, many)
            old = old[at]
            begins = np.concatenate([[True], old[1:] != old[:-1]])
            under = np.where(begins, old, new - 1)
            over = above[old]
            last = np.append(begins[1:], True)
            above[under[begins]] = new[begins]
            above[new] = np.where(last, over, new + 1)
            below[new] = under
            capped = last & (over >= 0)
            below[over[capped]] = new[capped]
            count, top = count + len(at), top + len(p)
        current = below[current]
    del pool, start, size, above, below, jump, high
    order = np.zeros(n, np.int64)
    placed = ~inner
    order[base] = base + lengths
    i, end = base.copy(), base + lengths
    j = order[i] - 1
    while True:
        stuck = np.flatnonzero(placed[j])
        i[stuck] += 1
        gone = i > end
        if gone.any():
            going = ~gone
            i, j, end = i[going], j[going], end[going]
            if not len(i):
                break
            stuck = np.flatnonzero(placed[j])
        j[stuck] = order[i[stuck]] - 1
        put = np.flatnonzero(~placed[j])
        what = j[put]
        g = group[what]
        f = free[g]
        order[f] = what
        free[g] = f + 1
        placed[what] = True
        j[put] = previous[what]
    return [order[a : a + k + 1] - a for a, k in zip(base, lengths, strict=True)]


def recurring(pieces: list[bytes], times: list[int], lanes: list[int]) -> list[np.ndarray]:
    """For each piece the places whose windows recur in it, in another of its lane, or with the piece
    itself. The pieces of a lane are one text, with an end symbol after each."""
    of = defaultdict(list)
    for k, lane in enumerate(lanes):
        of[lane].append(k)
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(pieces)
    texts, all_ = [], sorted(of.values(), key=lambda ks: -sum(len(pieces[k]) for k in ks))
    for ks in all_:
        text = np.frombuffer(b"".join(pieces[k] + b"\0" for k in ks), np.uint8).astype(np.int16) + 2
        text[np.cumsum([len(pieces[k]) + 1 for k in ks]) - 1] = 1  # less than any byte
        texts.append(text)
    for ks, order in zip(all_, suffix_arrays(texts) if texts else [], strict=True):
        data = b"\0".join(pieces[k] for k in ks)
        ends = np.cumsum([len(pieces[k]) + 1 for k in ks])
        starts = ends - [len(pieces[k]) + 1 for k in ks]
        whole = np.zeros(len(data) + 2, bool)
        again = np.zeros(len(data) + 2, bool)
        for k, a, b in zip(ks, starts, ends, strict=True):
            whole[a : b - WINDOW] = True
            again[a : b - WINDOW] = times[k] > 1
        pair = np.flatnonzero(whole[order[:-1]] & whole[order[1:]] & ~(again[order[:-1]] & again[order[1:]]))
        same = [data[a : a + WINDOW] == data[b : b + WINDOW] for a, b in zip(order[pair].tolist(), order[pair + 1].tolist(), strict=True)]
        met = pair[np.array(same, bool)]
        again[order[met]] = again[order[met + 1]] = True
        for k, a, b in zip(ks, starts, ends, strict=True):
            out[k] = np.flatnonzero(again[a:b])
    return out


def minimizers(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For every window of data: the place of its minimizer and the gram's hash."""
    n = len(data) - GRAM + 1
    eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    hashes = mixed(mixed(eight[:n].copy()) + eight[GRAM - 8 :][:n] * np.uint64(0x9FB21C651E98DF25))
    least = (hashes >> np.uint64(24) << np.uint64(24)) | np.arange(n, dtype=np.uint64)
    width = 1
    while width < SPAN:
        step = min(width, SPAN - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    place = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
    return place, hashes[place]


def segments(data: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """First windows, numbers of windows, grams and numbers of places of the gram of the segments of data."""
    for base in range(0, len(data) - WINDOW + 1, CHUNK):
        place, gram = minimizers(data[base : base + CHUNK + WINDOW - 1])
        start = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
        moved = np.cumsum(np.concatenate([[0], place[1:] != place[:-1]]))
        end = np.append(start[1:], len(gram))
        if (end - start).max() > LONGEST:
            start = np.concatenate([np.arange(a, b, LONGEST) for a, b in zip(start, end, strict=True)])
            end = np.append(start[1:], len(gram))
        yield start + base, end - start, gram[start].view(np.int64), moved[end - 1] - moved[start] + 1


def parts(data: bytes, step: int) -> Iterator[tuple[int, int, int]]:
    """(first window, windows, hash of the bytes that they share) of the parts of a piece."""
    place, _ = minimizers(data)
    depth = (place - np.arange(len(place))) // step
    start = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (depth[1:] != depth[:-1])]))
    end = np.append(start[1:], len(place))
    for a, b in zip(start.tolist(), end.tolist(), strict=True):
        last = int(place[a]) - int(depth[a]) * step  # the last window of this depth, cut off or not
        yield a, b - a, _signed(xxhash.xxh3_64_intdigest(data[last : last - step + 1 + WINDOW], seed=int(depth[a])))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _hash(data: bytes) -> int:
    return _signed(xxhash.xxh3_64_intdigest(data))


def _texts(docs: DataFrame) -> DataFrame:
    """(x, y, text): the bytes of each text and two hashes that stand for it; equal texts lose the same."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return docs.select(text.alias("text")).select(F.xxhash64("text").alias("x"), F.xxhash64(F.lit(1), F.col("text")).alias("y"), "text")


def _batches(rows: list[tuple], schema: str) -> Iterator[pa.RecordBatch]:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
    names, types = zip(*(c.split() for c in schema.split(", ")), strict=True)
    for i in range(0, len(rows), 20_000):
        yield pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(zip(*rows[i : i + 20_000], strict=True), types, strict=True)], list(names))


SEGMENT = "x long, y long, at int, windows int, gram long, key long, places int"
PIECE = "part long, kind long, n long, bytes binary"
MATCH = "part long, kind long, starts array<int>, ends array<int>"


def _segments(texts: DataFrame) -> DataFrame:
    """Segments of every text, equal texts counted in n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in SEGMENT.split(", ")]
        for batch in batches:
            held: list[tuple] = []
            for x, y, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                for at, w, gram, places in segments(text):
                    keys = [xxhash.xxh3_64_intdigest(text[a:b]) for a, b in zip(at.tolist(), (at + w + WINDOW - 1).tolist(), strict=True)]
                    held.append((np.full(len(at), x), np.full(len(at), y), at.astype(np.int32), w.astype(np.int32), gram, np.array(keys, np.uint64).view(np.int64), places.astype(np.int32)))
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names)

    found = texts.where(F.octet_length("text") >= WINDOW).mapInArrow(run, SEGMENT)
    return saved(found.groupBy("x", "y", "at", "windows", "gram", "key", "places").agg(F.count("*").alias("n")), "segments")


def _with_bytes(segments: DataFrame, texts: DataFrame) -> DataFrame:
    """PIECE rows of distinct segments `gram, key, n, x, y, at, windows`: those of one text travel to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows += [(p["gram"], p["key"], p["n"], text[p["at"] : p["at"] + p["windows"] + WINDOW - 1]) for p in wanted]
            yield from _batches(rows, PIECE)

    of = saved(segments.groupBy("x", "y").agg(F.collect_list(F.struct("at", "windows", "gram", "key", "n")).alias("wanted")), "wanted")
    one = texts.where(_among(texts, of)).dropDuplicates(["x", "y"])
    out = saved(one.join(of, ["x", "y"]).select("text", "wanted").mapInArrow(run, PIECE), "pieces")
    discard(of)
    release(texts.sparkSession)
    return out


def _among(texts: DataFrame, keys: DataFrame) -> Column:
    """Whether a text's x may be one of keys' (a filter of bounded size; a join must follow)."""
    keep = Filter.of(keys.select("x"), "x")
    bits = texts.sparkSession.sparkContext.broadcast(keep.bits)
    width = keep.width

    @F.pandas_udf("boolean")
    def has(p, q):
        import pandas as pd

        ok = True
        for x in (p.to_numpy(), q.to_numpy()):
            ok = ok & ((bits.value[x >> 6] >> (x & 63)) & 1 == 1)
        return pd.Series(ok)

    return has(*Filter.places(F.col("x"), width))


def _split(pieces: DataFrame, step: int) -> tuple[DataFrame, DataFrame]:
    """The distinct parts of pieces, dealt by the bytes that their windows share, and where they come from:
    `part, kind, of_part, of_kind, at`. Parts that are single windows need no bytes."""
    schema = f"{PIECE}, of_part long, of_kind long, at int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for of_part, of_kind, n, data in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                for at, w, shared in parts(data, step):
                    part = data[at : at + w + WINDOW - 1]
                    rows.append((shared, _hash(part), n, part if step > 1 else None, of_part, of_kind, at))
            yield from _batches(rows, schema)

    each = saved(pieces.mapInArrow(run, schema), "parts")
    origin = saved(each.select("part", "kind", "of_part", "of_kind", "at"), "part-origins")
    distinct = saved(each.groupBy("part", "kind").agg(F.sum("n").alias("n"), F.first("bytes").alias("bytes")), "pieces")
    discard(each)
    return distinct, origin


def _runs(places: np.ndarray) -> tuple[list[int], list[int]]:
    """Byte ranges that windows at these places cover, runs of places as one."""
    cut = np.flatnonzero(np.diff(places) > 1)
    first, last = places[np.append(0, cut + 1)], places[np.append(cut, len(places) - 1)]
    return first.tolist(), (last + WINDOW).tolist()


def _by_suffixes(pieces: DataFrame) -> DataFrame:
    """MATCH rows from the suffix arrays of shards; all pieces of a part are in one shard."""
    total = pieces.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    shards = max(1, total // SHARD)

    def shard(group: pa.Table) -> pa.Table:
        part, kind, n, data = (group.column(c).to_pylist() for c in ("part", "kind", "n", "bytes"))
        found = recurring(data, n, part)
        out = [(p, k, *_runs(f)) for p, k, f in zip(part, kind, found, strict=True) if len(f)]
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
        columns = zip(*out, strict=True) if out else [[]] * 4
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["part", "kind", "starts", "ends"])

    return pieces.withColumn("shard", F.pmod(F.xxhash64("part"), F.lit(shards))).groupBy("shard").applyInArrow(shard, MATCH)


def _classed(pieces: DataFrame, most: int) -> DataFrame:
    """pieces with `class`: only one of its part, with or without copies, of a small part, or a large one."""
    of = pieces.groupBy("part").agg(F.count("*").alias("k"))
    kind = F.when(F.col("k") > most, "large").when(F.col("k") > 1, "small").when(F.col("n") > 1, "equal").otherwise("alone")
    out = saved(pieces.join(of, "part").withColumn("class", kind).drop("k"), "classed")
    discard(pieces)
    release(pieces.sparkSession)
    return out


def _lifted(matches: DataFrame, origin: DataFrame) -> DataFrame:
    """Matches of parts as those of the pieces that they come from."""
    shift = lambda c: F.transform(c, lambda v: v + F.col("at")).alias(c)
    return origin.join(matches, ["part", "kind"]).select(F.col("of_part").alias("part"), F.col("of_kind").alias("kind"), shift("starts"), shift("ends"))


def _matches(pieces: DataFrame) -> DataFrame:
    """MATCH rows of distinct segments (their gram is the part, their key the kind): byte ranges, from the
    segment's start, of windows that recur.

    A segment that is alone under its gram is here because its gram is in it twice, so it goes into a
    suffix array, too; pieces that come from splits hold their gram once, so a piece that is alone in its
    part recurs as it is, if it has copies."""
    found, origins = [], []
    for level, (most, step) in enumerate(STEPS):
        classed = _classed(pieces, most)
        few = classed.where("class = 'small'" if level else "class <> 'large'").drop("class")
        out = _by_suffixes(few)
        found.append(saved(out.union(_whole(classed)) if level else out, "suffix-matches"))
        hot = classed.where("class = 'large'").drop("class")
        done = hot.isEmpty()
        if not done:
            pieces, origin = _split(hot, step)
            origins.append(origin)
        discard(classed)
        release(pieces.sparkSession)
        if done:
            break
    else:  # single windows
        found.append(_whole(pieces.withColumn("class", F.when(F.col("n") > 1, "equal"))))
    out = found.pop()
    while origins:
        out = found.pop().union(_lifted(out, origins.pop()))
    return out


def _whole(pieces: DataFrame) -> DataFrame:
    return pieces.where("class = 'equal'").select("part", "kind", F.array(F.lit(0)).alias("starts"), F.array(F.coalesce(F.octet_length("bytes"), F.lit(WINDOW))).alias("ends"))


def repeated_bytes(docs: DataFrame) -> DataFrame:
    """(x, y, starts, ends): the byte ranges of each text that windows which recur cover."""
    texts = _texts(docs)
    each = _segments(texts)
    grams = each.groupBy("gram").agg(F.sum(F.col("n") * F.col("places")).alias("times"), F.min("key").alias("one"), F.max("key").alias("other")).where("times > 1")
    again = saved(each.join(grams, "gram").withColumn("alone", F.expr("one = other AND places = 1")).drop("one", "other", "times"), "recurring")
    discard(each)
    release(docs.sparkSession)
    # A segment that is alone under its gram has copies of its own, all of it.
    alone = again.where("alone").select("x", "y", F.array("at").alias("starts"), F.array(F.col("at") + F.col("windows") + WINDOW - 1).alias("ends"))
    rest = again.where("NOT alone")
    pieces = rest.groupBy("gram", "key").agg(F.sum("n").alias("n"), F.min(F.struct("x", "y", "at", "windows")).alias("p")).select("gram", "key", "n", "p.*")
    held = _with_bytes(pieces, texts)
    matches = _matches(held)
    met = rest.join(matches.withColumnsRenamed({"part": "gram", "kind": "key"}), ["gram", "key"])
    shift = lambda c: F.transform(c, lambda v: v + F.col("at")).alias(c)
    ranges = alone.union(met.select("x", "y", shift("starts"), shift("ends")))
    found = saved(ranges.groupBy("x", "y").agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends")), "repeated")
    discard(again)
    return found


def without_repeated_bytes(docs: DataFrame, kept: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with `kept`, the bytes that stay.

    Null and empty texts have no bytes; texts shorter than a window stay whole. Every row is a document,
    rows that repeat a doc_id or have none included. Removed ranges that touch are one span. Other
    columns are ignored; an empty table gives no rows. What stays may cut a character in two, so it is
    binary. Texts of any length are read whole, in chunks of windows.
    """
    tune(docs.sparkSession, 1000)
    found = repeated_bytes(docs)
    schema = "n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * kept

    def result(text: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple:
        change = np.zeros(len(text) + 1, np.int64)
        np.add.at(change, starts, 1)
        np.add.at(change, ends, -1)
        stays = np.cumsum(change)[:-1] == 0
        left = np.frombuffer(text, np.uint8)[stays].tobytes()
        spans = int(np.count_nonzero(~stays[1:] & stays[:-1])) + int(len(stays) > 0 and not stays[0])
        return (len(text), len(text) - len(left), spans, hashlib.sha256(left).hexdigest(), *[left] * kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        for batch in batches:
            rows = []
            for doc_id, text, starts, ends in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                at = (starts.values.to_numpy(), ends.values.to_numpy()) if starts.is_valid else (none, none)
                rows.append((doc_id, *result(text, *at)))
            yield from _batches(rows, f"doc_id long, {schema}")

    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    body = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    body = body.withColumns({"x": F.xxhash64("text"), "y": F.xxhash64(F.lit(1), F.col("text"))})
    body = body.withColumn("cut", _among(body, found))
    # Texts that surely stay whole don't travel.
    nothing = F.lit(None).cast("array<int>")
    whole = body.where("NOT cut").select("doc_id", "text", nothing.alias("starts"), nothing.alias("ends"))
    cut = body.where("cut").join(found, ["x", "y"], "left").select("doc_id", "text", "starts", "ends")
    return whole.union(cut).mapInArrow(run, f"doc_id long, {schema}")


def op12_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeated_bytes(table(spark, sf_dir, "documents"), kept=False)
