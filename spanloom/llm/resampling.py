"""Importance resampling towards a target: tries of words count hashed features, and score documents.

Features are all words and all pairs of consecutive words of a text, hashed by CRC-32 into buckets. A partition
keeps them as a trie: a node below the root is a word, a node below that the word that follows it. A node holds how
often its feature came and the CRC after it, so the CRC of a pair goes on where its first word's ended. Words' nodes last
over a partition's texts, those of pairs over a group of texts, whose counts then join the totals of buckets.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cluster import durable
from .textkit import PUNCT

BUCKETS = 10_000
#: Words that a trie keeps over groups of texts; beyond, it begins anew, which bounds a task's memory and changes no sum.
MOST_WORDS = 200_000
#: Texts are read in parts of about so many bytes, and walked in groups of about so many words.
PART, GROUP = 1 << 22, 1 << 18
#: The CRC goes on over a word of so many bytes or fewer by tables.
TABLED = 64

#: Letters A-Z in lower case, and a blank for all bytes that end a word.
_FOLDED = bytes(32 if PUNCT[b + 32 if 65 <= b <= 90 else b] else b + 32 if 65 <= b <= 90 else b for b in range(256))


def _zero_bytes(most: int) -> np.ndarray:
    """What n more zero bytes make of a CRC, n to ``most``: by n, place of the byte in the CRC, and byte. It is linear in its bytes."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = (step >> np.uint32(1)) ^ np.where(step & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    out = np.empty((most + 1, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32) << (np.arange(4, dtype=np.uint32) * 8)[:, None]
    for n in range(most):
        out[n + 1] = (out[n] >> np.uint32(8)) ^ step[out[n] & np.uint32(255)]
    return out


class Trie:
    """Two levels: words, and below each the words that follow it. A word's node holds its CRC, and the CRC and length of it
    with a blank before it, by which the CRC of a pair goes on from its first word's."""

    def __init__(self):
        self.zero = _zero_bytes(TABLED)
        self.clear()

    def clear(self) -> None:
        self.words: dict[bytes, int] = {}
        self.state, self.after, self.length = array("I"), array("I"), array("q")

    def _places(self, words: list[bytes]) -> np.ndarray:
        """The node of each word; nodes that lack are made."""
        known = self.words
        for w in set(words).difference(known):
            known[w] = len(self.state)
            self.state.append(crc32(w))
            self.after.append(crc32(b" " + w))
            self.length.append(len(w) + 1)
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def walk(self, group: list[tuple[int, list[bytes], bool]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the nodes that the group's texts reach: the CRC and how often its feature comes; and of each feature its node and row."""
        if len(self.state) > MOST_WORDS:
            self.clear()
        size = np.array([len(ws) for _, ws, _ in group])
        words = list(chain.from_iterable(ws for _, ws, _ in group))
        at, rows = self._places(words), np.repeat([row for row, _, _ in group], size)
        begins, again = np.zeros(len(at), bool), np.zeros(len(at), bool)
        first = np.cumsum(size) - size
        begins[first] = True
        again[first[[more for _, _, more in group]]] = True
        second = np.flatnonzero(~begins)
        keys, seen, pair, times = np.unique(at[second - 1] << 32 | at[second], return_index=True, return_inverse=True, return_counts=True)
        state, after, length = np.array(self.state), np.array(self.after), np.array(self.length)
        a, b = state[keys >> 32], keys & 0xFFFFFFFF
        n = np.minimum(length[b], TABLED)
        child = after[b]
        for k in range(4):
            child = child ^ self.zero[n, k, (a >> np.uint32(8 * k)) & np.uint32(255)]
        for k in np.flatnonzero(length[b] > TABLED).tolist():
            child[k] = crc32(b" " + words[second[seen[k]]], int(a[k]))
        own = at[~again]
        nodes = np.concatenate((own, pair + len(state)))
        return np.concatenate((state, child)).astype(np.int64), np.concatenate((np.bincount(own, minlength=len(state)), times)), nodes, np.concatenate((rows[~again], rows[second]))


def _parts(text: bytes) -> Iterator[tuple[list[bytes], bool]]:
    """The words of a text, a long one's in several lists: each begins with the last word of the one before."""
    data, at, last = text.translate(_FOLDED), 0, None
    while at < len(data):
        end = data.find(b" ", at + PART) if at + PART < len(data) else -1
        end = len(data) if end < 0 else end
        words = data[at:end].split()
        if words:
            yield ([last, *words], True) if last is not None else (words, False)
            last = words[-1]
        at = end


def _groups(texts: Iterable[pa.LargeBinaryScalar]) -> Iterator[list[tuple[int, list[bytes], bool]]]:
    """Lists of (row, words, whether the first word was the last one of the row's list before), bounded in words."""
    held, n = [], 0
    for row, text in enumerate(texts):
        for words, more in _parts(text.as_py() or b""):
            held.append((row, words, more))
            n += len(words)
            if n >= GROUP:
                yield held
                held, n = [], 0
    if held:
        yield held


def feature_totals(docs: DataFrame, n: int = BUCKETS) -> DataFrame:
    """bucket, n: how many features of all texts fall into each bucket that has any. A null text has none."""

    def kernel(batches):
        trie = Trie()
        totals = np.zeros(n, np.int64)
        for batch in batches:
            for group in _groups(batch.column(0).cast(pa.large_binary())):
                states, times, _, _ = trie.walk(group)
                totals += np.bincount(states % n, times, n).astype(np.int64)
        has = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(totals[has])], ["bucket", "n"])

    return docs.select("text").mapInArrow(kernel, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, n: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket: a thousand times the logarithm of how much likelier the target has it, each bucket seen once more.

    What comes to the driver are two numbers a bucket."""
    sums = []
    for df in (docs, target):
        per = np.zeros(n)
        for r in feature_totals(df, n).collect():
            per[r.bucket] = r.n
        sums.append(per)
    s, t = sums
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def weights(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, row (a hash of the text), n_words, n_features, weight of each row: the floored mean gain of its features, 0 without any."""

    def kernel(batches):
        trie = Trie()
        for batch in batches:
            m = batch.num_rows
            features, total = np.zeros(m, np.int64), np.zeros(m, np.int64)
            for group in _groups(batch.column(2).cast(pa.large_binary())):
                states, _, nodes, rows = trie.walk(group)
                features += np.bincount(rows, minlength=m)
                total += np.bincount(rows, gain[states % len(gain)][nodes], m).astype(np.int64)
            out = [batch.column(0), batch.column(1), (features + 1) // 2, features, total // np.maximum(features, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in out], ["doc_id", "row", "n_words", "n_features", "weight"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("row"), "text")
    return own.mapInArrow(kernel, "doc_id long, row long, n_words long, n_features long, weight long")


def _luck(seed: int) -> Column:
    """Gumbel noise of a document, in thousandths, from a hash of its id; of its text's hash where it has no id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("row "), F.col("row").cast("string"))))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least: int = 20, seed: int = 7, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_features, weight, score, rank of each row of docs (doc_id, text); target: text.

    Of the rows with at least ``least`` words the floor(``percent`` * rows / 100) of the highest scores are drawn: rank 1, 2, ...
    by falling score, then doc_id; others have no rank. The score is the weight plus Gumbel noise, so a draw takes documents in
    proportion to how much likelier the target makes their features.

    A null text is an empty one: no features, weight 0, never drawn while ``least`` is over 0. Rows without doc_id come after others
    of their score, by a hash of the text, from which their noise comes too. Rows that repeat a doc_id are judged each by its own text.
    No rows give none; an empty target gives every bucket the gain that its rarity makes. Columns other than these two aren't read.

    Texts are read twice: for the totals, then for the scores. A score is a whole number between bounds that 64-bit counts set
    (about 44,000 for the weight, 23,000 for the noise), so a table of how many rows have each is small whatever the input, and ranks begin at its sums."""
    scored = durable(weights(docs, gains(docs, target, buckets)).withColumn("score", (F.col("weight") + _luck(seed)).cast("long")))
    fit = scored.filter(F.col("n_words") >= least)
    line = Window.orderBy(F.col("score").desc())
    per = fit.groupBy("score").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(line) - F.col("n"))
    most = (F.sum("n").over(Window.partitionBy()) * percent / 100).cast("decimal(38,6)")
    per = per.withColumn("most", F.floor(most)).filter("before < most").select("score", "before", "most")
    out = ["doc_id", "n_features", "weight", "score"]
    placed = scored.join(F.broadcast(per), "score", "left").withColumn("before", F.when(F.col("n_words") >= least, F.col("before")))
    near = placed.filter("before is not null")
    place = F.row_number().over(Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "row"))
    near = near.withColumn("rank", (F.col("before") + place).cast("long")).withColumn("rank", F.when(F.col("rank") <= F.col("most"), F.col("rank")))
    return placed.filter("before is null").select(*out, F.lit(None).cast("long").alias("rank")).unionByName(near.select(*out, "rank"))
