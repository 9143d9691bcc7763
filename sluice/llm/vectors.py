"""Embedding near-duplicates by an inverted multi-index (operator 5)."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checked_broadcast, components, saved, table, tune

COSINE = 0.95
#: Vectors that codebooks are fitted on, and queries that the traversal is calibrated on (expected numbers).
SAMPLE, PROBES = 16_384, 512
#: Vectors per cell aimed at, entries of a codebook at most, rounds of k-means.
PER_CELL, MOST_CODES, ROUNDS = 8, 1024, 12
#: Vectors made at the least cosine to each probe.
NEIGHBOURS = 4
#: Share of the probes' links whose cell must be visited, and cells visited at least.
RECALL, LEAST_CELLS = 0.995, 24
#: Vectors of a cell that are compared at once; larger cells are cut into blocks.
BLOCK = 1024
#: Visits of a cell that one group takes; those of more visited cells are dealt over copies of the cell.
VISITS = 4096
#: Cells are worked on by the shelf, of about this many vectors at LEAST_CELLS, fewer beyond.
SHELF = 2048


def unit(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.float64)
    x = x / np.abs(x).max(-1, keepdims=True)  # so that no square overflows
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def _stack(column, kind: type) -> np.ndarray:
    return np.stack([np.frombuffer(b, kind) for b in column.to_pylist()])


def kind_of(vectors: DataFrame) -> type:
    """float32 holds floats exactly; other numbers are kept in double precision."""
    return np.float32 if dict(vectors.dtypes)["embedding"] == "array<float>" else np.float64


def usable_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, vec): usable vectors as bytes."""
    kind = kind_of(vectors)
    ok = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>" if kind is np.float32 else "array<double>").alias("embedding"))

    def usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = v.values
                if len(x) and not x.null_count and np.isfinite(y := x.to_numpy()).all() and y.any():
                    ids.append(i)
                    out.append((y + kind(0)).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["vec_id", "vec"])

    return saved(ok.mapInArrow(usable, "vec_id long, vec binary"), "vectors")


def fit_codebook(x: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """k-means on a bounded sample."""
    rng = np.random.default_rng(seed)
    codes = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(ROUNDS):
        near = squares(x, codes).argmin(1)
        n = np.bincount(near, minlength=len(codes))
        sums = np.zeros_like(codes)
        np.add.at(sums, near, x)
        codes = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], codes)
    return codes


def squares(x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ codes.T + (codes * codes).sum(1)


def nearest_cells(first: np.ndarray, second: np.ndarray, cells: int) -> np.ndarray:
    """The `cells` nearest cells of the grid for each query, by the sum of both halves' distances.

    Both halves' distances are sorted. A cell that is i-th and j-th (from 0) is preceded by
    (i + 1) * (j + 1) - 1 others, so the traversal stays within (i + 1) * (j + 1) <= cells.
    """
    k1, k2 = first.shape[1], second.shape[1]
    cells = min(cells, k1 * k2)
    i, j = np.divmod(np.arange(min(k1, cells) * min(k2, cells)), min(k2, cells))
    inside = (i + 1) * (j + 1) <= cells
    i, j = i[inside], j[inside]
    o1, o2 = np.argsort(first, 1)[:, : min(k1, cells)], np.argsort(second, 1)[:, : min(k2, cells)]
    d = np.take_along_axis(first, o1, 1)[:, i] + np.take_along_axis(second, o2, 1)[:, j]
    best = np.argpartition(d, cells - 1, 1)[:, :cells]
    rows = np.arange(len(d))[:, None]
    return o1[rows, i[best]].astype(np.int64) * k2 + o2[rows, j[best]]


def rank_of(first: np.ndarray, second: np.ndarray, c1: int, c2: int) -> int:
    """How many cells are nearer to a query than (c1, c2)."""
    bound = first[c1] + second[c2]
    return int(np.searchsorted(np.sort(second), bound - first, side="left").sum())


def neighbours(x: np.ndarray, cosine: float, seed: int = 1) -> np.ndarray:
    """A vector of random direction at the given cosine to each unit vector."""
    turn = np.random.default_rng(seed).normal(size=x.shape)
    turn -= (turn * x).sum(1)[:, None] * x
    turn /= np.maximum(np.linalg.norm(turn, axis=1), 1e-30)[:, None]
    return unit(cosine * x + (1 - cosine * cosine) ** 0.5 * turn)


def block_labels(hit: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest node of the component of each row and column among the hits of one block."""
    a, b, top = left, right, np.iinfo(np.int64).max
    while True:
        a2 = np.minimum(a, np.where(hit, b[None, :], top).min(1))
        b2 = np.minimum(b, np.where(hit, a2[:, None], top).min(0))
        if (a2 == a).all() and (b2 == b).all():
            return a, b
        a, b = a2, b2


class Index:
    """Codebooks of both halves, and how many cells a query visits."""

    def __init__(self, sample: np.ndarray, k: int):
        self.dim = sample.shape[1]
        x = unit(sample)
        self.codes = fit_codebook(x[:, : self.dim // 2], k), fit_codebook(x[:, self.dim // 2 :], k)
        self.cells = LEAST_CELLS

    def ranks(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many cells each x visits before that of its y."""
        (a, b), (c, d) = self.distances(x), self.distances(y)
        return np.array([rank_of(a[s], b[s], c[s].argmin(), d[s].argmin()) for s in range(len(x))])

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = self.dim // 2
        return squares(x[:, :h], self.codes[0]), squares(x[:, h:], self.codes[1])


def build_index(classes: DataFrame, cosine: float = COSINE, recall: float = RECALL, kind: type = np.float32) -> Index:
    """The index of classes (node, weight, vec) of one length. Fits codebooks on about SAMPLE vectors and calibrates the traversal on about PROBES queries.

    Cells are visited until `recall` is reached of each of three: pairs of a probe and a vector made
    at the least cosine to it, in both directions, so that recall doesn't rest on links that the
    probes happen to have; the probes' links among all vectors; and those with equal weight for each
    probe, so that a dense group counts no more than another.
    """
    n = classes.count()
    part = lambda rows, seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(1 << 30)) < min(1 << 30, int((1 << 30) * rows / n) + 1)
    sample = np.stack([np.frombuffer(r[0], kind) for r in classes.where(part(SAMPLE, 1)).select("vec").collect()] or [np.frombuffer(classes.first()["vec"], kind)])
    index = Index(sample, int(min(max(2, (n / PER_CELL) ** 0.5), MOST_CODES, len(sample))))
    probes = classes.where(part(PROBES, 2)).select("node", "vec").collect()
    if probes:
        probes.sort()
        ids, x = np.array([r[0] for r in probes]), unit(np.stack([np.frombuffer(r[1], kind) for r in probes]))
        made = [(x, neighbours(x, cosine, seed)) for seed in range(NEIGHBOURS)]
        made = np.sort(np.concatenate([index.ranks(*pair) for x_y in made for pair in (x_y, x_y[::-1])]))
        index.cells = max(LEAST_CELLS, int(made[math.ceil(recall * len(made)) - 1]) + 1)
        held = classes.sparkSession.sparkContext.broadcast((index.codes, index.dim, ids, x))

        def ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            (c1, c2), dim, ids, q = held.value
            q1, q2 = squares(q[:, : dim // 2], c1), squares(q[:, dim // 2 :], c2)
            for batch in batches:
                y = unit(_stack(batch.column(1), kind))
                a, b = squares(y[:, : dim // 2], c1).argmin(1), squares(y[:, dim // 2 :], c2).argmin(1)
                i, j = np.nonzero((q @ y.T >= cosine) & (ids[:, None] != batch.column(0).to_numpy()[None, :]))
                yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array([rank_of(q1[s], q2[s], a[t], b[t]) for s, t in zip(i, j, strict=True)], pa.int64())], ["probe", "rank"])

        found = classes.select("node", "vec").mapInArrow(ranks, "probe long, rank long").groupBy("probe", "rank").count().orderBy("rank", "probe").collect()
        if found:
            probe, rank, count = np.array([tuple(r) for r in found]).T
            for weight in (count, count / np.bincount(probe, count)[probe]):
                links = np.cumsum(weight)
                index.cells = max(index.cells, int(rank[np.searchsorted(links, recall * links[-1])]) + 1)
    return index


def link_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector.

    Vectors link at a cosine of `cosine` or more in double precision. Each looks into its nearest
    cells of the grid and is compared with what lies there; no pair below the threshold is linked, and
    a link that either finds counts for both. Equal vectors are one entry with a weight, so copies cost
    nothing. Vectors of each length have a grid of their own; those of different lengths have no cosine
    and don't link. Null, empty and zero vectors, and those with null or non-finite components, link
    with nothing. Rows that repeat a vec_id are one node of the components; a null vec_id has a null
    component. Other columns are ignored; an empty table gives no rows.
    """
    tune(vectors.sparkSession, 4096)
    kind = kind_of(vectors)
    each = usable_vectors(vectors)
    classes = saved(each.groupBy("vec").agg(F.min("vec_id").alias("node"), F.count("*").alias("weight")), "vector-classes")
    ids = vectors.select(F.col("vec_id").cast("long").alias("vec_id"))
    lengths = [r[0] for r in classes.groupBy(F.length("vec").alias("bytes")).count().where("count > 1").orderBy("bytes").collect()]
    found = [found_links(classes.where(F.length("vec") == n), cosine, kind) for n in lengths]
    found = reduce(DataFrame.union, found or [vectors.sparkSession.createDataFrame([], "node long, links long, near long")])
    total = found.groupBy("node").agg(F.sum("links").alias("links"))
    edges = found.where("near <> node").select(F.col("node").alias("a"), F.col("near").alias("b"))
    of = each.join(classes, "vec").select("vec_id", "node", "weight")
    edges = edges.union(of.where("vec_id <> node").select(F.col("vec_id").alias("a"), F.col("node").alias("b")))
    labels = components(edges)
    counted = of.join(total, "node", "left").groupBy("vec_id").agg(F.max(F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    out = ids.join(counted, "vec_id", "left").join(labels.select(F.col("node").alias("vec_id"), "component"), "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def found_links(right: DataFrame, cosine: float, kind: type) -> DataFrame:
    """(node, links, near) of classes of one length, several rows a node: links found, each once for
    either side, and a node of the same component."""
    index = build_index(right, cosine, kind=kind)
    held = right.sparkSession.sparkContext.broadcast(index)
    shelves = max(1, right.count() * index.cells // (SHELF * LEAST_CELLS))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = held.value
        for batch in batches:
            d1, d2 = ix.distances(unit(_stack(batch.column("vec"), kind)))
            home = d1.argmin(1).astype(np.int64) * d2.shape[1] + d2.argmin(1)
            visits = nearest_cells(d1, d2, ix.cells)
            offsets = np.arange(len(visits) + 1, dtype=np.int32) * visits.shape[1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home), pa.ListArray.from_arrays(pa.array(offsets), pa.array(visits.ravel()))], ["node", "weight", "vec", "home", "visits"])

    at = saved(right.select("node", "weight", "vec").mapInArrow(placed, "node long, weight long, vec binary, home long, visits array<long>"), "vector-cells")
    # Large cells are cut into g blocks of vectors and s of visits, every pair of blocks compared by its
    # own group.
    own, visits = at.groupBy(F.col("home").alias("cell")).agg(F.count("*").alias("n")), at.select(F.explode("visits").alias("cell")).groupBy("cell").agg(F.count("*").alias("v"))
    large = own.join(visits, "cell").where((F.col("n") > BLOCK) | (F.col("v") > VISITS))
    large = saved(large.select("cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("g"), F.ceil(F.col("v") / VISITS).cast("int").alias("s")), "vector-large")
    large = checked_broadcast(large)
    mine = lambda g: F.pmod(F.xxhash64("node"), g).cast("int")
    others = lambda g: F.explode(F.sequence(F.lit(0), g - 1))
    g, s = F.coalesce("g", F.lit(1)), F.coalesce("s", F.lit(1))
    stored = at.select("node", "weight", "vec", "home", "visits", F.col("home").alias("cell")).join(large, "cell", "left").select(F.lit(True).alias("stored"), "cell", "node", "weight", "vec", "home", "visits", mine(g).alias("i"), others(s).alias("j"))
    asked = at.select("node", "weight", "vec", "home", F.explode("visits").alias("cell")).join(large, "cell", "left").select(F.lit(False).alias("stored"), "cell", "node", "weight", "vec", "home", F.lit(None).cast("array<bigint>").alias("visits"), others(g).alias("i"), mine(s).alias("j"))
    shelf = F.when((F.col("i") == 0) & (F.col("j") == 0), F.pmod(F.xxhash64("cell"), F.lit(shelves))).otherwise(F.col("cell") + shelves)

    index_cells = min(index.cells, len(index.codes[0]) * len(index.codes[1]))

    def compared(batch: pa.Table) -> pa.Table:
        stored, cell = batch.column("stored").to_numpy(), batch.column("cell").to_numpy()
        node, weight = batch.column("node").to_numpy(), batch.column("weight").to_numpy()
        x = unit(np.frombuffer(b"".join(batch.column("vec").to_pylist()), kind).reshape(len(node), -1))
        home = batch.column("home").to_numpy()
        seen = np.full((len(node), index_cells), -1)
        seen[stored] = batch.column("visits").combine_chunks().drop_null().flatten().to_numpy().reshape(-1, index_cells)
        order = np.lexsort((node, stored, cell))
        out: list[tuple[np.ndarray, ...]] = []
        for part in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1):
            s, q = part[stored[part]], part[~stored[part]]
            for a in range(0, len(q) if len(s) else 0, BLOCK):
                some = q[a : a + BLOCK]
                hit = (x[some] @ x[s].T >= cosine) & (node[some][:, None] != node[s][None, :])
                if hit.any():
                    a, b = block_labels(hit, node[some], node[s])
                    out.append((node[some], hit @ weight[s], a))
                    back = np.zeros(len(s), np.int64)  # what s doesn't find, as its traversal doesn't come to q's cell
                    linked = hit.any(1)
                    for cell_of_q in np.unique(home[some[linked]]):
                        rows = linked & (home[some] == cell_of_q)
                        back += (weight[some[rows]] @ hit[rows]) * ~(seen[s] == cell_of_q).any(1)
                    out.append((node[s], back, b))
        cols = [np.concatenate([o[i] for o in out]) if out else np.zeros(0, np.int64) for i in range(3)]
        keep = (cols[2] != cols[0]) | (cols[1] > 0)
        return pa.table({"node": cols[0][keep], "links": cols[1][keep].astype(np.int64), "near": cols[2][keep]})

    return saved(stored.union(asked).withColumn("shelf", shelf).groupBy("shelf", "i", "j").applyInArrow(compared, "node long, links long, near long"), "vector-links")


def op5_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(table(spark, sf_dir, "embeddings"))
