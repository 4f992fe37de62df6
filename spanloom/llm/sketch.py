"""A count-min sketch that is merged by shards of its counters, and the exact stage behind it.

Documents are dealt into chunks by a hash of doc_id. A chunk reports each of its distinct keys
once, as counters of a wide count-min sketch: sorted counters as byte planes of their gaps, about
two bytes each, and where it is asked for how often it has them. A shard of counters merges what all
chunks report and answers each chunk with one bit for each of its counters: set if two chunks or more
hold it; and of those that are set with one more: set if all chunks together have it HOT times or more,
so that what belongs to one key is too much for a task. A key whose counters are all set may be repeated (an
overestimate); a key with a counter that is not set surely is not. Nothing is collected: the
sketch's width follows the input, and its shards are groups of a shuffle. Their number is bounded, as
that of messages is chunks times shards: beyond SHARDS of them a shard has more counters, which it
merges slice by slice.

Keys that may be repeated go, with what the operator says of them, to shards by key, which answer
in the same way with one bit for each thing asked. A chunk is determined by its documents alone, so
a task that is run again asks for the same things in the same order.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import partitions, text_bytes
from .textkit import distinct, mix

DEPTH = 2
SHARD_BITS = 24
SHARDS = 1 << 16
HOT = 1 << 20
ASKED = pa.schema([("k", pa.int64()), ("g", pa.int64()), ("asked", pa.binary())])
ANSWER = pa.schema([("g", pa.int64()), ("k", pa.int64()), ("answer", pa.binary())])


def chunked(docs: DataFrame, chunk_bytes: int = 2 << 20) -> tuple[DataFrame, int]:
    """Documents as (g, doc_id, text), all of a chunk g in one task. Chunks grow with the root of the input,
    as far as a task's memory bears."""
    spark = docs.sparkSession
    total = text_bytes(docs)
    each = int(min(64 << 20, chunk_bytes * max(1.0, math.sqrt(total / 1e9))))
    n = partitions(spark, total, 16 << 20)
    chunks = max(-(-total // each), 2 * n)
    g = F.pmod(F.when(F.col("doc_id").isNotNull(), F.xxhash64(F.lit(17), "doc_id")).otherwise(F.xxhash64(F.lit(18), "text")), F.lit(chunks))
    return docs.select(g.alias("g"), F.col("doc_id").cast("long").alias("doc_id"), "text").repartition(n, "g"), total


def planes(x: np.ndarray) -> bytes:
    """Bytes of uint32 values, all low bytes first: the zeros of small values compress away."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def unplanes(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(4, -1).T).view("<u4").ravel()


class Sketch:
    """bits: log2 of the counters in a row of the sketch; shard_bits: of those in a shard, below 32; weigh: whether
    chunks say how often they have a key, up to 255 times a chunk, so that hot keys are known."""

    def __init__(self, keys: int, load: int = 8, shard_bits: int = SHARD_BITS, shards: int = SHARDS, weigh: bool = False, hot: int = HOT):
        self.bits = max(16, math.ceil(math.log2(max(keys, 1) * load)))
        self.slice_bits = min(self.bits, shard_bits)
        self.shard_bits = min(31, max(self.slice_bits, self.bits - int(math.log2(shards))))
        self.weigh, self.hot = weigh, hot

    def counters(self, keys: np.ndarray, row: int) -> np.ndarray:
        return mix(keys, 101 + row) >> np.uint64(64 - self.bits)

    def cut(self, counters: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(shard, from, to) over sorted counters."""
        shards = 1 << (self.bits - self.shard_bits)
        at = np.searchsorted(counters, np.arange(shards + 1, dtype=np.uint64) << np.uint64(self.shard_bits))
        for s in np.flatnonzero(np.diff(at)):
            yield int(s), int(at[s]), int(at[s + 1])

    def report(self, g: int, keys: np.ndarray) -> pa.Table:
        """keys: as often as the chunk has them, or distinct ones."""
        k, asked = [], []
        for row in range(DEPTH):
            every = np.sort(self.counters(keys, row))
            first = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1]))) if len(every) else np.zeros(0, np.int64)
            c, times = every[first], np.minimum(np.diff(np.append(first, len(every))), 255).astype(np.uint8)
            for s, i, j in self.cut(c):
                own = (c[i:j] & np.uint64((1 << self.shard_bits) - 1)).astype(np.uint32)
                k.append(row << 40 | s)
                asked.append(planes(np.diff(own, prepend=np.uint32(0))) + (times[i:j].tobytes() if self.weigh and not row else b""))
        return pa.table([pa.array(k, pa.int64()), pa.array([g] * len(k), pa.int64()), pa.array(asked, pa.binary())], schema=ASKED)

    def merge(self, table: pa.Table) -> pa.Table:
        """One shard, slice by slice: how many chunks have each counter, as far as two, and how often they do."""
        weigh = self.weigh and table["k"][0].as_py() >> 40 == 0
        told, times = [], []
        for b in table["asked"]:
            b = b.as_buffer()
            n = len(b) // (5 if weigh else 4)
            told.append(np.cumsum(unplanes(b[: 4 * n]), dtype=np.uint32))
            times.append(np.frombuffer(b, np.uint8, n, 4 * n) if weigh else None)
        edges = np.arange((1 << (self.shard_bits - self.slice_bits)) + 1, dtype=np.uint64) << np.uint64(self.slice_bits)
        cuts = [np.searchsorted(own, edges) for own in told]
        several, hot = [np.empty(len(own), bool) for own in told], [np.zeros(len(own), bool) for own in told]
        for s in range(len(edges) - 1):
            seen, often = np.zeros(1 << self.slice_bits, np.uint8), np.zeros(1 << self.slice_bits if weigh else 0, np.uint32)
            inside = [own[at[s] : at[s + 1]] - np.uint32(edges[s]) for own, at in zip(told, cuts, strict=True)]
            for own, t, at in zip(inside, times, cuts, strict=True):
                so_far = seen[own]
                seen[own] = so_far + (so_far < 2)
                if weigh:
                    so_far = often[own]
                    often[own] = np.minimum(so_far + t[at[s] : at[s + 1]], np.uint32(self.hot))
            for k, (own, at) in enumerate(zip(inside, cuts, strict=True)):
                several[k][at[s] : at[s + 1]] = seen[own] > 1
                if weigh:
                    hot[k][at[s] : at[s + 1]] = often[own] >= self.hot
        bits = [np.packbits(x).tobytes() + np.packbits(y[x]).tobytes() for x, y in zip(several, hot, strict=True)]
        return pa.table([table["g"], table["k"], pa.array(bits, pa.binary())], schema=ANSWER)

    def repeated(self, keys: np.ndarray, answers: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Which of the keys may be held by another chunk too, and which are hot.

        Counters that are set are looked up in a bit table of their low bits, which may only add to them;
        hot ones in themselves, so that all chunks say the same of a key."""
        out, hot = np.ones(len(keys), bool), np.zeros(len(keys), bool)
        low = _low(keys)
        for row in range(DEPTH):
            c = self.counters(keys, row)
            u = distinct(c)
            often, most = np.zeros(int(low) + 1, bool), []
            for s, i, j in self.cut(u):
                answer, n = np.frombuffer(answers[row << 40 | s], np.uint8), (j - i + 7) // 8
                several = u[i:j][np.unpackbits(answer[:n], count=j - i).astype(bool)]
                often[several & low] = True
                most.append(several[np.unpackbits(answer[n:], count=len(several)).astype(bool)])
            out &= often[c & low]
            if not row and len(most := np.concatenate([u[:0], *most])):
                hot = most[np.minimum(np.searchsorted(most, c), len(most) - 1)] == c
        return out, hot


def _low(keys: np.ndarray) -> np.uint64:
    """The bits of a hash that a bit table of these keys goes by: eight entries a key or more."""
    return np.uint64((1 << max(16, len(keys).bit_length() + 3)) - 1)


def inside_twice(keys: np.ndarray) -> np.ndarray:
    """Which keys may be there more than once: those that are, and a few others."""
    s, low = np.sort(keys), _low(keys)
    often = np.zeros(int(low) + 1, bool)
    often[s[1:][s[1:] == s[:-1]] & low] = True
    return often[keys & low]


def answers_of(table: pa.Table, exact: bool) -> dict[int, bytes]:
    """Answers by k; those of the exact stage have negative k."""
    return {(-1 - k if exact else k): a for k, a in zip(table["k"].to_pylist(), table["answer"].to_pylist(), strict=True) if (k < 0) == exact}


def dealt(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, places of what goes there), by shard."""
    order = np.argsort(shard, kind="stable")
    cut = np.flatnonzero(np.diff(shard[order], prepend=-1))
    for i, j in zip(cut, [*cut[1:], len(order)], strict=True) if len(order) else ():
        yield int(shard[order[i]]), order[i:j]


def two_pass(
    docs: DataFrame,
    keys_per_byte: float,
    keys_of: Callable[[pa.Table], np.ndarray],
    ask: Callable[[int, pa.Table, Sketch, dict[int, bytes], int], pa.Table],
    settle: Callable[[pa.Table], pa.Table],
    finish: Callable[[pa.Table, Sketch, dict[int, bytes], dict[int, bytes], int], pa.Table],
    schema: str,
    shard_bytes: int = 4 << 20,
    **sketch_options,
) -> DataFrame:
    """The whole job as one lazy plan: sketch, merge, ask the exact shards, settle, finish.

    The shuffle of the texts and that of the sketch's answers are each written once and read again."""
    chunks, total = chunked(docs)
    sketch = Sketch(int(total * keys_per_byte), **sketch_options)
    shards = min(max(-(-total // shard_bytes), 1), 2 * SHARDS)

    def report(key, table):
        return sketch.report(key[0].as_py(), keys_of(table))

    def asking(key, left, right):
        if not len(left):
            return ASKED.empty_table()
        return ask(left["g"][0].as_py(), left, sketch, answers_of(right, False), shards)

    def ending(key, left, right):
        return finish(left, sketch, answers_of(right, False), answers_of(right, True), shards)

    told = (
        chunks.groupBy("g").applyInArrow(report, "k long, g long, asked binary")
        .groupBy("k").applyInArrow(lambda table: sketch.merge(table), "g long, k long, answer binary")
    )
    asked = chunks.groupBy("g").cogroup(told.groupBy("g")).applyInArrow(asking, "k long, g long, asked binary")
    settled = asked.groupBy("k").applyInArrow(lambda table: settle(table), "g long, k long, answer binary")
    both = told.unionByName(settled.select("g", (-1 - F.col("k")).alias("k"), "answer"))
    return chunks.groupBy("g").cogroup(both.groupBy("g")).applyInArrow(ending, schema)


def ordered(table: pa.Table) -> tuple[list[int | None], list[str | None], np.ndarray, pa.Array, np.ndarray]:
    """doc_ids and texts of a chunk's rows, each row's place among the distinct (doc_id, text) in order, and the
    texts and doc_ids in that order.

    Rows without doc_id have no place in the order: place -1."""
    ids, texts = table["doc_id"].to_pylist(), table["text"].fill_null("").to_pylist()
    known = sorted({(i, t) for i, t in zip(ids, texts, strict=True) if i is not None})
    at = {x: n for n, x in enumerate(known)}
    place = np.array([at.get((i, t), -1) for i, t in zip(ids, texts, strict=True)], np.int64)
    return ids, texts, place, pa.array([t for _, t in known], pa.large_string()), np.array([i for i, _ in known], np.int64)
