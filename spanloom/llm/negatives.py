"""Hard negatives by a vector-approximation file: bounds of scores by table lookup, exact scores of what they leave.

Vectors are packed into blocks. A block knows, for each dimension, the marks of its cells and each vector's cell in a byte. A cell's
two marks say how little and how much it can add to a score; products of an anchor with the marks of a block's cells bound
the scores of its vectors, and only those that may enter a result are scored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cluster import durable, shared_folder

CELLS = 64
#: Bytes of a block's vectors at most, and its rows.
BLOCK_BYTES, BLOCK_ROWS = 4 << 20, 4096
#: Anchors that are held against a block at once, and that a pass over all blocks takes along.
CHUNK, PASS = 64, 8192


def usable(vectors: DataFrame) -> DataFrame:
    """id, label, v (doubles, floor(256 * x)) of rows that have an id, a label and a vector of finite components alone."""
    finite = "forall(v, x -> x is not null and not isnan(x) and abs(x) <= 1.7976931348623157E308D)"
    own = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.expr("transform(embedding, x -> cast(x as double))").alias("v"))
    return own.filter(f"id is not null and label is not null and v is not null and {finite}").withColumn("v", F.expr("transform(v, x -> floor(256 * cast(x as double)))").cast("array<double>"))


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """ids, labels and vectors of a batch's rows, apart by how many dimensions they have."""
    lists = batch.column("v")
    size = np.asarray(lists.value_lengths())
    flat, off = np.asarray(lists.flatten()), np.concatenate(([0], np.cumsum(size)))
    ids, labels = np.asarray(batch.column("id")), np.asarray(batch.column("label"))
    for n in np.unique(size):
        rows = np.flatnonzero(size == n)
        step = max(1, min(BLOCK_ROWS, BLOCK_BYTES // max(8 * int(n), 1)))
        for k in range(0, len(rows), step):
            own = rows[k : k + step]
            yield ids[own], labels[own], flat[off[own][:, None] + np.arange(n)]


def approximations(rows: DataFrame) -> DataFrame:
    """rows: id, label, v. Blocks of them: n, dims, ids, labels, vectors, marks (the least and largest value of each dimension's cells) and
    cells, as bytes. Cells hold about as many of a block's values each."""

    def kernel(batches):
        for batch in batches:
            out = []
            for ids, labels, v in _matrices(batch):
                cells = np.empty(v.shape, np.uint8)
                marks = np.zeros((v.shape[1], CELLS, 2))
                edges = np.quantile(v, np.arange(1, CELLS) / CELLS, axis=0, method="lower") if v.size else np.zeros((CELLS - 1, v.shape[1]))
                for d in range(v.shape[1]):
                    cells[:, d] = at = np.searchsorted(edges[:, d], v[:, d], "right")
                    low, high = np.full(CELLS, np.inf), np.full(CELLS, -np.inf)
                    np.minimum.at(low, at, v[:, d])
                    np.maximum.at(high, at, v[:, d])
                    used = low <= high
                    marks[d, used, 0], marks[d, used, 1] = low[used], high[used]
                out.append((len(ids), v.shape[1], *(np.ascontiguousarray(x).tobytes() for x in (ids, labels, v, marks, cells.T))))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)] if out else [pa.array([], t) for t in (pa.int64(), pa.int64(), *[pa.binary()] * 5)], _PACKED)

    return rows.mapInArrow(kernel, "n long, dims long, ids binary, labels binary, vectors binary, marks binary, cells binary")


_PACKED = ["n", "dims", "ids", "labels", "vectors", "marks", "cells"]


class Block:
    def __init__(self, row: dict):
        n, dims = row["n"], row["dims"]
        self.ids, self.labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
        self.v = np.frombuffer(row["vectors"], np.float64).reshape(n, dims)
        self.marks = np.frombuffer(row["marks"], np.float64).reshape(dims, CELLS, 2)
        self.cells = np.frombuffer(row["cells"], np.uint8).reshape(dims, n)
        self._ends: tuple[np.ndarray, np.ndarray] | None = None

    def bounds(self, anchors: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the largest score that each of the rows can have with each anchor."""
        least, largest = self.ends(rows)
        up, down = np.maximum(anchors, 0.0), np.minimum(anchors, 0.0)  # what a cell adds least it adds at one of its two ends
        low, high = up @ least.T + down @ largest.T, up @ largest.T + down @ least.T
        most = self.largest(anchors)
        if most < 2**53:  # sums of smaller whole numbers are exact
            return low, high
        slack = most * (2 + anchors.shape[1]) * 2.0**-51
        return np.nan_to_num(low - slack, nan=-np.inf, posinf=np.inf, neginf=-np.inf), np.nan_to_num(high + slack, nan=np.inf, posinf=np.inf, neginf=-np.inf)

    def ends(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the largest vector that each of the rows can be by its cells; looked up once a block."""
        if self._ends is None:
            d = np.arange(len(self.cells))[:, None]
            self._ends = tuple(np.ascontiguousarray(self.marks[d, self.cells, k].T) for k in (0, 1))
        return self._ends[0][rows], self._ends[1][rows]

    def largest(self, anchors: np.ndarray) -> float:
        """No score is larger, nor any sum on the way to it."""
        return float(np.abs(anchors).max() * np.abs(self.v).max() * anchors.shape[1]) if anchors.size and self.v.size else 0.0

    def scores(self, anchors: np.ndarray, at: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The exact score of each pair of an anchor and a row; beyond 64 bits the nearest that a long holds."""
        a, b = anchors[at], self.v[rows]
        if not a.size:
            return np.zeros(len(at), np.int64)
        if self.largest(anchors) < 2**53:
            return np.einsum("ij,ij->i", a, b).astype(np.int64)
        whole = [sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for p, q in zip(a, b, strict=True)]
        return np.array([min(max(x, -(2**63) + 1), 2**63 - 1) for x in whole], np.int64)


class Best:
    """The k best distinct (score, id) of each of n lists: higher scores first, then smaller ids."""

    def __init__(self, n: int, k: int):
        self.k, self.of = k, np.full(n, -np.inf)
        self.list, self.score, self.id = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, lists: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        if not len(lists):
            return
        a, s, i = np.concatenate((self.list, lists)), np.concatenate((self.score, scores)), np.concatenate((self.id, ids))
        order = np.lexsort((i, ~s, a))
        a, s, i = a[order], s[order], i[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (s[1:] != s[:-1]) | (i[1:] != i[:-1])
        a, s, i = a[new], s[new], i[new]
        place = np.arange(len(a)) - np.searchsorted(a, a)
        keep = place < self.k
        self.list, self.score, self.id = a[keep], s[keep], i[keep]
        last = place == self.k - 1
        self.of[a[last]] = s[last]  # the score that a row needs by now

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (self.list, self.id, self.score)], ["list", "id", "score"])


def _kth(x: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row; minus infinity where there are fewer."""
    return -np.partition(-x, k - 1, axis=1)[:, k - 1] if x.shape[1] >= k else np.full(len(x), -np.inf)


def _positives(blocks: DataFrame, ids: np.ndarray, labels: np.ndarray, vectors: list[np.ndarray], k: int) -> DataFrame:
    """anchor_id, list (the anchor's place), id, score: the best k rows of each anchor's label within what a task reads."""

    def kernel(batches):
        best = Best(len(ids), k)
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row)
                for own, a in _chunks(labels, vectors, row["dims"]):
                    rows = np.flatnonzero(block.labels == labels[own[0]])
                    low, high = block.bounds(a, rows)
                    other = ids[own][:, None] != block.ids[rows]
                    need = np.maximum(_kth(_distinct(np.where(other, low, -np.inf), block.ids[rows]), k), best.of[own])
                    at, r = np.nonzero(other & (high >= need[:, None]))
                    best.add(own[at], block.scores(a, at, rows[r]), block.ids[rows[r]])
        found = best.batch()
        yield pa.RecordBatch.from_arrays([pa.array(ids[best.list]), *found.columns], ["anchor_id", *found.schema.names])

    return blocks.mapInArrow(kernel, "anchor_id long, list long, id long, score long")


def _distinct(low: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Bounds in which a repeated id counts once: a row that repeats it can't raise what others need."""
    first = np.unique(ids, return_index=True)[1]
    if len(first) == len(ids):
        return low
    out = np.full(low.shape, -np.inf)
    out[:, first] = low[:, first]
    return out


def _chunks(labels: np.ndarray, vectors: list[np.ndarray], dims: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and vectors of the anchors of so many dimensions, CHUNK of one label at a time."""
    fit = np.array([len(v) == dims for v in vectors], bool)
    for label in np.unique(labels[fit]):
        own = np.flatnonzero(fit & (labels == label))
        for k in range(0, len(own), CHUNK):
            yield own[k : k + CHUNK], np.array([vectors[i] for i in own[k : k + CHUNK]])


def _negatives(blocks: DataFrame, labels: np.ndarray, vectors: list[np.ndarray], windows: np.ndarray, k: int) -> DataFrame:
    """windows: anchors x positives x 2, the least and largest score, an empty one where there is no such positive. list (place of
    the anchor times positives, and the positive), id, score: the best k rows of other labels in each window within what a task reads."""
    m = windows.shape[1]

    def kernel(batches):
        best = Best(len(labels) * m, k)
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row)
                for own, a in _chunks(labels, vectors, row["dims"]):
                    rows = np.flatnonzero(block.labels != labels[own[0]])
                    low, high = block.bounds(a, rows)
                    may = np.zeros(low.shape, bool)
                    for p in range(m):
                        least, most = windows[own, p, :1], windows[own, p, 1:]
                        fit = (high >= np.maximum(least, best.of[own * m + p][:, None])) & (low <= most)
                        if fit.sum() > CHUNK * k * len(own):  # so many that it pays to find what scores the block makes sure of
                            sure = np.where((low >= least) & (high <= most), low, -np.inf)
                            fit &= high >= _kth(_distinct(sure, block.ids[rows]), k)[:, None]
                        may |= fit
                    at, r = np.nonzero(may)
                    scores, found = block.scores(a, at, rows[r]), block.ids[rows[r]]
                    for p in range(m):
                        w = windows[own[at], p]
                        inside = (scores >= w[:, 0]) & (scores <= w[:, 1])
                        best.add(own[at[inside]] * m + p, scores[inside], found[inside])
        yield best.batch()

    return blocks.mapInArrow(kernel, "list long, id long, score long")


def _merged(parts: DataFrame, k: int) -> DataFrame:
    """The best k of each list, with their rank from 1."""
    line = Window.partitionBy("list").orderBy(F.col("score").desc(), "id")
    return parts.distinct().withColumn("rank", F.row_number().over(line)).filter(F.col("rank") <= k)


SCHEMA = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def hard_negatives(vectors: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95) -> DataFrame:
    """SCHEMA of each anchor (a row whose vec_id is divisible by ``every``), positive (its ``positives`` best other rows of its
    label) and negative: the ``negatives`` best rows of other labels whose score is from ``least`` to ``most`` percent of the
    positive's. vectors: vec_id, embedding, label. Scores are inner products of floor(256 * x); higher come first, then smaller vec_ids.

    Rows without id, label or vector, or with a component that isn't finite, take no part; no rows give none. Vectors of other
    lengths than the anchor's aren't compared with it. Rows that repeat a vec_id are rows of their own, but what they would give
    twice is given once; none is an anchor's own positive. Other columns aren't read. Scores beyond 64 bits are the nearest long.

    Vectors are packed and approximated once and written to the shared folder. Anchors are taken in passes of about PASS, whose vectors
    go along with the tasks, so what the driver holds is bounded; each pass reads the blocks twice, for positives
    and for negatives in their windows, and its result is written before the next."""
    spark = vectors.sparkSession
    folder = f"{shared_folder(spark)}/negatives-{uuid.uuid4().hex}"
    rows = usable(vectors)
    approximations(rows).write.parquet(f"{folder}/blocks")
    blocks = spark.read.parquet(f"{folder}/blocks")
    anchors = durable(rows.filter(F.col("id") % every == 0).distinct())
    passes = -(-anchors.count() // PASS)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{folder}/found")
    for p in range(passes):
        held = anchors.filter(F.pmod(F.xxhash64(F.lit(5), "id", "label", F.hash("v")), F.lit(passes)) == p).toArrow()
        if not held.num_rows:
            continue
        ids, labels = np.asarray(held["id"]), np.asarray(held["label"])
        own = [np.asarray(v) for chunk in held["v"].chunks if len(chunk) for v in np.split(np.asarray(chunk.flatten()), np.cumsum(np.asarray(chunk.value_lengths()))[:-1])]
        best = durable(_merged(_positives(blocks, ids, labels, own, positives), positives))
        windows = np.zeros((len(ids), positives, 2), np.int64)
        windows[..., 1] = -1
        for r in best.collect():
            windows[r.list, r.rank - 1] = -(-least * r.score // 100), most * r.score // 100
        found = _merged(_negatives(blocks, labels, own, windows, negatives), negatives).withColumnRenamed("id", "negative_id").withColumnRenamed("score", "negative_score")
        lists = best.select((F.col("list") * positives + F.col("rank") - 1).alias("list"), "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        found.join(lists, "list").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score").write.mode("append").parquet(f"{folder}/found")
    return spark.read.parquet(f"{folder}/found")
