"""Problem 2: the k most similar vectors of every vector, through a forest of random-projection trees.

Fitting: on a sample of at most about SAMPLE different vectors the driver grows TREES trees; a node parts its vectors by the
hyperplane between the centres of a few steps of two-means from two random vectors. The forest (hyperplanes and leaf means) has
a size bounded by the sample and is what tasks get. Indexing: every vector is put into its leaf of every tree. Searching: all leaves
of all trees stand in one queue: a vector's home leaves, then MARGIN leaves by the least margin on the way to them (the usual
order, which finds near copies across a hyperplane), then by the mean cosine of the leaf's fitted vectors, as at equal work
margins alone find less of the ten nearest; the first PROBES are visited.
Vectors meet by a shuffle on leaves, many packed into a row; within a leaf the candidates are ranked by cosine of vectors that
travel as 16-bit integers with a scale of their own (error of a cosine below 1e-5).

Leaves have about 1/32 of the vectors, at least 64 and at most 14,000. Beyond 450,000 vectors there are more leaves instead,
and probes grow with them, so that the searched share of the vectors, and with it recall, holds at every size; work per vector
grows likewise. A leaf's queries are then parted among several tasks, each with all of the
leaf's items, so memory per task does not grow.

Equal vectors form one class (a hash of the values); a class takes one place in a leaf however many ids it has, and its ids
come in again when pairs of classes have been ranked. Defined results: rows with a NULL id, a NULL or wrongly sized vector, NULL,
NaN or infinite values or length zero take no part; repeated rows count once; equal similarities are ranked by id; empty tables
give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textarrays as ta
from .runs import column, whole_runs

SAMPLE, TREES, PROBES, MARGIN, STARTS = 8192, 2, 6, 1, 6
SHARE, LEAST_LEAF, MOST_LEAF = 32, 64, 14000
#: Vectors that are placed at a time, parts of the queries for each shuffle partition, and tasks for each shuffle partition beyond which leaves share one.
ROWS, PARTS, MOST_TASKS = 8192, 4, 8


def sizes(n: int, probes: int) -> tuple[int, int, int]:
    """Vectors in a leaf, leaves to visit (probes, and more as soon as leaves stop growing), and tasks that share a leaf's queries."""
    leaf = min(MOST_LEAF, max(LEAST_LEAF, n // SHARE))
    chunks = max(1, -(-(n // SHARE) // leaf))
    return leaf, max(probes, -(-probes * (n // SHARE) // leaf)), chunks


class Tree:
    """Hyperplanes in the order parents first; a child below zero is the leaf -child - 1."""

    def __init__(self, x: np.ndarray, leaf: int, rng: np.random.Generator):
        self.normal: list[np.ndarray] = []
        self.offset: list[float] = []
        self.child: list[list[int]] = []
        self.leaves = 0
        waiting = [(np.arange(len(x)), -1, 0)]
        while waiting:
            own, parent, side = waiting.pop(0)
            if len(own) <= leaf or (plane := self._plane(x[own], rng)) is None:
                self.leaves += 1
                node = -self.leaves
            else:
                node = len(self.normal)
                self.normal.append(plane[0])
                self.offset.append(plane[1])
                self.child.append([0, 0])
                right = x[own] @ plane[0] >= plane[1]
                waiting += [(own[~right], node, 0), (own[right], node, 1)]
            if parent >= 0:
                self.child[parent][side] = node

    @staticmethod
    def _plane(x: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, float] | None:
        """Of STARTS runs of two-means from random vectors the plane that takes most of the scatter away; else a random median plane."""
        best: tuple[float, np.ndarray, float] | None = None
        for _ in range(STARTS):
            a, b = x[rng.choice(len(x), 2, replace=False)]
            for _ in range(10):
                right = x @ (b - a) >= (b - a) @ (a + b) / 2
                if right.all() or not right.any():
                    break
                a, b = x[~right].mean(0), x[right].mean(0)
            if (size := float(np.linalg.norm(b - a))) > 1e-6:
                n = ((b - a) / size).astype(np.float32)
                at = float(n @ (a + b) / 2)
                share = float((x @ n >= at).mean())
                gain = share * (1 - share) * size * size
                if 0.05 < share < 0.95 and (best is None or gain > best[0]):
                    best = gain, n, at
        if best:
            return best[1:]
        n = rng.standard_normal(x.shape[1]).astype(np.float32)
        n /= np.linalg.norm(n)
        at = float(np.median(x @ n))
        return (n, at) if 0 < (x @ n >= at).mean() < 1 else None

    def priorities(self, x: np.ndarray) -> np.ndarray:
        """For each vector and leaf the least margin on the way to it."""
        out = np.full((self.leaves, len(x)), np.inf, np.float32)
        if self.normal:
            margin = np.stack(self.normal) @ x.T - np.array(self.offset, np.float32)[:, None]
            way = np.full_like(margin, np.inf)
            for node, kids in enumerate(self.child):
                for kid, m in zip(kids, (-margin[node], margin[node])):
                    least = np.minimum(way[node], m)
                    if kid >= 0:
                        way[kid] = least
                    else:
                        out[-kid - 1] = least
        return out


class Forest:
    """Trees, and for each leaf of all trees the mean of the vectors it was fitted on."""

    def __init__(self, x: np.ndarray, leaf: int, trees: int = TREES, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.trees = [Tree(x, max(2, leaf), rng) for _ in range(trees)]
        self.first = np.concatenate([[0], np.cumsum([t.leaves for t in self.trees])])
        home = self.homes(x)
        self.mean = np.stack([x[(home == i).any(1)].mean(0) if (home == i).any() else np.zeros(x.shape[1], np.float32) for i in range(self.first[-1])]).astype(np.float32)

    def homes(self, x: np.ndarray) -> np.ndarray:
        """Each vector's leaf in each tree: the one on whose way no margin is negative."""
        return np.stack([t.priorities(x).argmax(0) + a for t, a in zip(self.trees, self.first)], 1)

    def route(self, x: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
        """Home leaf in each tree, and whether each leaf is among the first probes of the shared queue (vectors x leaves)."""
        margin = np.concatenate([t.priorities(x) for t in self.trees]).T
        row = np.arange(len(x))
        home = np.stack([margin[:, a:b].argmax(1) + a for a, b in zip(self.first[:-1], self.first[1:])], 1)
        queue = x @ self.mean.T
        probes = min(max(probes, len(self.trees)), queue.shape[1])
        for leaf in [*home.T, *[None] * min(MARGIN, probes - len(self.trees))]:
            leaf = margin.argmax(1) if leaf is None else leaf
            queue[row, leaf], margin[row, leaf] = np.inf, -np.inf
        visit = np.zeros(queue.shape, bool)
        visit[row[:, None], np.argpartition(-queue, probes - 1, axis=1)[:, :probes]] = True
        return home, visit


def vectors(col: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows with usable vectors, and these vectors at unit length."""
    row = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(col), dim), False).to_numpy(zero_copy_only=False))
    x = col.take(pa.array(row)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    with np.errstate(all="ignore"):
        size = np.linalg.norm(x, axis=1)
        ok = np.isfinite(size) & (size > 0)
        return row[ok], (x[ok] / size[ok, None]).astype(np.float32)


def entries(dim: int) -> np.dtype:
    """What travels of a vector: its class, what it is in the leaf (1 item, 2 query, 4 reports itself), and its values."""
    return np.dtype([("v", "<i8"), ("part", "u1"), ("scale", "<f4"), ("x", "<i2", dim)])


def packed(v: np.ndarray, x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), entries(x.shape[1]))
    scale = np.abs(x).max(1, initial=1e-30) / 32767
    out["v"], out["scale"], out["x"] = v, scale, np.rint(x / scale[:, None])
    return out


def unpacked(e: np.ndarray) -> np.ndarray:
    x = e["x"] * e["scale"][:, None]
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def grouped(key: np.ndarray, e: np.ndarray, name: str) -> pa.RecordBatch:
    """Entries packed into one row for each key."""
    order = np.argsort(key, kind="stable")
    key, data = key[order], np.ascontiguousarray(e[order])
    border = np.flatnonzero(np.diff(key, prepend=-1, append=-1))
    blobs = pa.Array.from_buffers(pa.large_binary(), len(border) - 1, [None, pa.py_buffer((border * e.dtype.itemsize).astype(np.int64)), pa.py_buffer(data.view(np.uint8))])
    return pa.record_batch({name: pa.array(key[border[:-1]], pa.int32()), "blob": blobs.cast(pa.binary())})


def ungrouped(batches: Iterator[pa.RecordBatch], name: str, dtype: np.dtype) -> Iterator[np.ndarray]:
    """The entries of each key, from rows sorted by it."""
    for t in whole_runs(batches, name):
        at = column(t, name)
        border = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1], [True]]))
        for lo, hi in zip(border[:-1], border[1:]):
            yield np.frombuffer(b"".join(x.as_py() for x in t.column("blob").slice(lo, hi - lo)), dtype)


def _place(forest: Forest, dim: int, probes: int, chunks: int = 1):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, ROWS):
                batch = whole.slice(lo, ROWS)
                row, x = vectors(batch.column("vector"), dim)
                v, once = np.unique(batch.column("v").to_numpy()[row], return_index=True)
                if not len(v):
                    continue
                x = x[once]
                home, visit = forest.route(x, probes)
                part = visit.astype(np.int8) * 2
                for t in range(home.shape[1]):
                    part[np.arange(len(x)), home[:, t]] |= 1
                part[np.arange(len(x)), home[:, 0]] |= 4
                i, leaf = np.nonzero(part)
                what, chunk = part[i, leaf], v[i] % chunks
                if chunks > 1:  # items go to all chunks of a leaf, queries to one
                    own = np.flatnonzero(what & 1)
                    other = np.repeat(chunk[own], chunks - 1) + np.tile(np.arange(1, chunks), len(own))
                    i, leaf = np.append(i, np.repeat(i[own], chunks - 1)), np.append(leaf, np.repeat(leaf[own], chunks - 1))
                    what, chunk = np.append(what, np.ones(len(other), np.int8)), np.append(chunk, other % chunks)
                key, data = leaf * chunks + chunk, packed(v, x)
                for at in range(0, len(i), 4 * ROWS):
                    e = data[i[at : at + 4 * ROWS]]
                    e["part"] = what[at : at + 4 * ROWS]
                    yield grouped(key[at : at + 4 * ROWS], e, "leaf")

    return run


def _leaf(e: np.ndarray, k: int, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Query class, item class and similarity of the best k items for each query of a leaf, queries in order."""
    v, once, at = np.unique(e["v"], return_index=True, return_inverse=True)
    part = np.zeros(len(v), np.uint8)
    np.bitwise_or.at(part, at, e["part"])
    x = unpacked(e[once])
    items, queries = np.flatnonzero(part & 1), np.flatnonzero(part & 2)
    first = v[part & 4 > 0]
    if len(first):
        yield first, first, np.ones(len(first), np.float32)
    y = np.ascontiguousarray(x[items].T)
    for lo in range(0, len(queries), 512):
        q = queries[lo : lo + 512]
        s = x[q] @ y
        s[v[items] == v[q][:, None]] = -2
        if least > -1:
            i, j = np.nonzero(s >= least)
            if len(i) > k * len(q):
                order = np.lexsort((-s[i, j], i))
                i, j = i[order], j[order]
                rank = np.arange(len(i)) - np.searchsorted(i, i)
                i, j = i[rank < k], j[rank < k]
        else:
            m = min(k, s.shape[1])
            j = np.argpartition(-s, m - 1, axis=1)[:, :m].ravel() if m else np.empty(0, np.int64)
            i = np.repeat(np.arange(len(q)), m)
            real = s[i, j] > -2
            i, j = i[real], j[real]
        yield v[q[i]], v[items[j]], s[i, j].astype(np.float32)


def _rank(dim: int, k: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for e in ungrouped(batches, "leaf", entries(dim)):
            for q, n, s in _leaf(e, k, least):
                yield pa.record_batch({"q": q, "n": n, "similarity": s})

    return run


def found(k: int) -> np.dtype:
    """The best k of a query in one leaf; unused places have the similarity -2."""
    return np.dtype([("q", "<i8"), ("n", "<i8", k), ("s", "<f4", k)])


def _rank_packed(dim: int, k: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for e in ungrouped(batches, "leaf", entries(dim)):
            for q, n, s in _leaf(e, k, -1.0):
                if not len(q):
                    continue
                new = np.flatnonzero(np.diff(q, prepend=q[0] ^ 1) != 0)
                own = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(q))))
                out = np.zeros(len(new), found(k))
                out["q"], out["s"] = q[new], -2
                out["n"][own, np.arange(len(q)) - new[own]] = n
                out["s"][own, np.arange(len(q)) - new[own]] = s
                yield grouped((ta.mix(out["q"].view(np.uint64)) % np.uint64(parts)).astype(np.int64), out, "share")

    return run


def _best(k: int):
    """The k + 1 best classes of each query, itself among them, from those of its leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for e in ungrouped(batches, "share", found(k)):
            q, n, s = np.repeat(e["q"], k), e["n"].ravel(), e["s"].ravel()
            q, n, s = q[s > -2], n[s > -2], s[s > -2]
            order = np.lexsort((-s, n, q))
            q, n, s = q[order], n[order], s[order]
            new = np.ones(len(q), bool)
            new[1:] = (q[1:] != q[:-1]) | (n[1:] != n[:-1])
            q, n, s = q[new], n[new], s[new]
            order = np.lexsort((n, -s, q))
            q, n, s = q[order], n[order], s[order]
            keep = np.arange(len(q)) - np.searchsorted(q, q) <= k
            yield pa.record_batch({"q": q[keep], "n": n[keep], "similarity": s[keep]})

    return run


def neighbours(df: DataFrame, id_col: str, vector_col: str, k: int = 10, dim: int = 384, least: float = -1.0, trees: int = TREES, probes: int = PROBES) -> DataFrame:
    """(id, neighbour, similarity, rank): for every id with a usable vector the k ids with the most similar vectors.

    With least, only neighbours of at least that similarity; the k are the same, cut off there. probes is the number of leaves
    to visit while leaves have 1/SHARE of the vectors; it grows as their share shrinks.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<float>").alias("vector")).where(F.col("id").isNotNull() & (F.size("vector") == dim))
    n = rows.count()
    leaf, probes, chunks = sizes(n, probes)
    # each different vector is drawn or not, so that copies neither count nor travel
    sample = rows.where(F.pmod(F.xxhash64("vector"), F.lit(max(n, 1))) < SAMPLE).select("vector").distinct().toArrow()
    x = vectors(sample.column("vector").combine_chunks(), dim)[1] if sample.num_rows else np.zeros((0, dim), np.float32)
    forest = Forest(np.unique(x, axis=0), max(2, min(leaf * SAMPLE // max(n, SAMPLE), len(x))), trees) if len(x) > 1 else Forest(np.zeros((1, dim), np.float32), 2, 1)
    hashed = rows.select("id", F.xxhash64("vector").alias("v"), "vector")
    placed = hashed.select("v", "vector").mapInArrow(_place(forest, dim, probes, chunks), "leaf int, blob binary")
    n_tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(n_tasks, min(int(forest.first[-1]) * chunks, MOST_TASKS * n_tasks))
    leaves = placed.repartition(tasks, "leaf").sortWithinPartitions("leaf")
    if least <= -1:
        parts = PARTS * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        near = leaves.mapInArrow(_rank_packed(dim, k, parts), "share int, blob binary").repartition("share").sortWithinPartitions("share")
        near = near.mapInArrow(_best(k), "q long, n long, similarity float")
    else:
        near = leaves.mapInArrow(_rank(dim, k, least), "q long, n long, similarity float").groupBy("q", "n").agg(F.max("similarity").alias("similarity"))
    ids = hashed.select("v", "id").distinct()
    first = ids.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("r") <= k + 1).select(F.col("v").alias("n"), F.col("id").alias("neighbour"))
    pairs = near.join(first, "n").join(ids.withColumnRenamed("v", "q"), "q").where("id <> neighbour").select("id", "neighbour", "similarity").repartition("id").groupBy("id", "neighbour").agg(F.max("similarity").alias("similarity"))
    best = Window.partitionBy("id").orderBy(F.desc("similarity"), "neighbour")
    return pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("id", "neighbour", F.col("similarity").cast("double").alias("similarity"), "rank")


def similar_pairs(df: DataFrame, id_col: str, vector_col: str, least: float, k: int = 10, dim: int = 384) -> DataFrame:
    """(id_a, id_b, similarity), id_a < id_b: one is among the k most similar of the other, with at least this similarity."""
    near = neighbours(df, id_col, vector_col, k, dim, least)
    return near.groupBy(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).agg(F.max("similarity").alias("similarity"))
