"""Near copies by a chosen-path similarity join over minwise tokens.

A document is the set of its distinct word shingles. Documents with equal sets are one class, and one
of each class is joined with the others. In each of several independent trees a class goes to the
node that two of its minwise tokens, chosen by the tree, name; nodes with more members than a leaf may
have branch again by two tokens that their path chooses, so a similar pair keeps its chance to meet. Where
a branch would hold nearly all of its node again, as in a large group of near copies, the node is dealt into parts instead.
Small nodes are compared exhaustively by all minwise tokens. First each member is paired with the one
most alike and with the two in the middle of its node, and pairs are confirmed on full sets; what is not
linked by then and still may be similar is compared within its nodes on full sets. So large groups of
near copies bring about as many pairs as members, and no link between them is lost. The number of trees follows from the recall wanted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import durable
from .components import labels, stars
from .textkit import BLANK, FOLD, flat, grams, mix, pieces, whole, word_hashes, words

TOKENS = 64
PIECE = 1 << 20
_rng = np.random.default_rng(20240501)
_ODD = _rng.integers(0, 1 << 32, TOKENS, np.uint32) | np.uint32(1)
_XOR = _rng.integers(0, 1 << 32, TOKENS, np.uint32)


def shingle_sets(texts: pa.Array, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of runs of texts: the sorted distinct shingle hashes one set after another, and where each begins."""
    data, off = flat(texts)
    for i, j in pieces(off, PIECE):
        own, o = FOLD[data[off[i] : off[j]]], off[i : j + 1] - off[i]
        s, e, woff = words(own, o, BLANK)
        w = word_hashes(own, s, e)
        g = mix(grams(w, n), n)
        count = np.maximum(np.diff(woff) - n + 1, 0)
        sets = []
        for d in range(j - i):
            a, m = int(woff[d]), int(woff[d + 1] - woff[d])
            if m >= n:
                sets.append(np.unique(g[a : a + count[d]]))
            elif m:
                short = grams(w[a : a + m], m)
                sets.append(mix(short, 1000 + m))
            else:
                sets.append(np.zeros(0, np.uint64))
        yield (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.concatenate(([0], np.cumsum([len(x) for x in sets]))).astype(np.int64)


def minwise(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """TOKENS smallest values of each set under so many orders; empty sets get zeros."""
    out = np.zeros((len(off) - 1, TOKENS), np.uint32)
    full = np.flatnonzero(np.diff(off))
    v = (values >> np.uint64(32)).astype(np.uint32)
    for i, j in pieces(off, 1 << 15):
        own = full[(full >= i) & (full < j)]
        if len(own):
            x, at = v[off[i] : off[j]], off[own] - off[i]
            for t in range(TOKENS):
                out[own, t] = np.minimum.reduceat((x ^ _XOR[t]) * _ODD[t], at)
    return out


def digests(values: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """Two independent 64-bit sums over each set."""
    total = (np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(values, k), dtype=np.uint64))) for k in (1, 2))
    return [(t[off[1:]] - t[off[:-1]]).view(np.int64) for t in total]


def trees_for(threshold: float, recall: float) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold * threshold))


def _six(x: np.ndarray) -> bytes:
    """The low 48 bits of sorted hashes, low 32 and then high 16."""
    return x.astype(np.uint32).tobytes() + (x >> np.uint64(32)).astype(np.uint16).tobytes()


def _unsix(b) -> np.ndarray:
    m = len(b) // 6
    return np.frombuffer(b, np.uint32, m).astype(np.uint64) | np.frombuffer(b, np.uint16, m, 4 * m).astype(np.uint64) << np.uint64(32)


def _minority(labels: np.ndarray, native: np.ndarray) -> np.ndarray:
    """Places of the members that don't have the commonest label of the native ones."""
    values, count = np.unique(labels[native], return_counts=True)
    return np.flatnonzero(labels != values[np.argmax(count)]) if len(values) else np.arange(len(labels))


def _by_node(rows: DataFrame, each, schema: str) -> DataFrame:
    """Runs each(batch, cut) over whole nodes: cut has where each node of the batch begins, and its end."""

    def cuts(batch):
        node = batch.column(0).to_numpy()
        return np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1], [True])))

    def kernel(batches):
        rest = None
        for batch in batches:
            rest = batch if rest is None else pa.concat_batches([rest, batch])
            if len(rest):
                cut = cuts(rest)
                if len(cut) > 2:
                    yield from each(rest.slice(0, cut[-2]), cut[:-1])
                    rest = rest.slice(cut[-2])
        if rest is not None and len(rest):
            yield from each(rest, cuts(rest))

    return rows.repartition("node").sortWithinPartitions("node", "id").mapInArrow(kernel, schema)


class NearCopies:
    """shingle: words of a shingle; links are pairs with intersection * den >= num * union."""

    def __init__(self, shingle: int = 5, num: int = 80, den: int = 100, recall: float = 0.99999, leaf: int = 2000, levels: int = 8):
        self.shingle, self.num, self.den, self.leaf, self.levels = shingle, num, den, leaf, levels
        self.threshold = num / den
        self.trees = trees_for(self.threshold, recall)
        if 2 * self.trees > TOKENS:
            raise ValueError(f"{self.trees} trees take {2 * self.trees} minwise tokens of {TOKENS}: ask for less recall or more similarity")
        t = self.threshold
        self.least = max(1, math.floor(TOKENS * t - 4.5 * math.sqrt(TOKENS * t * (1 - t))))

    def sketches(self, docs: DataFrame, by_text: bool = False) -> DataFrame:
        """doc_id, n (size of the set), s1, s2 (its digest), tokens (minwise, 4 bytes each); by_text: and row, a hash of the text."""
        shingle, own = self.shingle, [F.xxhash64("text").alias("row")] if by_text else []

        def kernel(batches):
            for batch in batches:
                ids, done = batch.column(0), 0
                for values, off in shingle_sets(batch.column(1), shingle):
                    s1, s2 = digests(values, off)
                    m = len(off) - 1
                    tokens = minwise(values, off)
                    yield pa.RecordBatch.from_arrays(
                        [ids.slice(done, m), pa.array(np.diff(off)), pa.array(s1), pa.array(s2), pa.array([x.tobytes() for x in tokens], pa.binary()), *(c.slice(done, m) for c in batch.columns[2:])],
                        ["doc_id", "n", "s1", "s2", "tokens", *batch.schema.names[2:]],
                    )
                    done += m

        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *own).mapInArrow(kernel, "doc_id long, n long, s1 long, s2 long, tokens binary" + (", row long" if by_text else ""))

    def _child(self, path: str):
        """The child of a node below a tree's root: a hash of its path and of the minwise token that the path chooses."""
        return F.xxhash64(F.col(path), F.expr(f"substring(tokens, cast(1 + 4 * pmod(shiftright({path}, 3), {TOKENS}) as int), 4)"))

    def nodes(self, classes: DataFrame) -> tuple[DataFrame, bool]:
        """node, base, id, native, n, tokens: members of the leaves with two members or more; and whether any large node
        was dealt into parts: one whose members share the token that its path chose as near copies do, so that a
        branch would hold them all again, or one that is large at the last level. base: the node before that; native: false
        where a member is a guest in a part that isn't its own."""
        root = F.expr(f"transform(sequence(0, {self.trees - 1}), t -> xxhash64(t, substring(tokens, 1 + 8 * t, 8)))")
        named, found = classes.select("id", F.explode(root).alias("node")), None
        dense = False
        for level in range(self.levels):
            size = named.groupBy("node").agg(F.count("*").alias("size")).filter("size > 1")
            named = durable(named.join(size, "node"))
            leaves = named.filter(F.col("size") <= self.leaf).select("node", F.col("node").alias("base"), "id", F.lit(True).alias("native"))
            found = leaves if found is None else found.unionByName(leaves)
            large = named.filter(F.col("size") > self.leaf)
            if large.isEmpty():
                break
            if level + 1 == self.levels:
                found, dense = found.unionByName(self._dealt(large)), True
                break
            paths = F.explode(F.array(F.xxhash64(F.lit(0), "node"), F.xxhash64(F.lit(1), "node")))
            below = large.select("id", "node", "size", paths.alias("path")).join(classes.select("id", "tokens"), "id").select("id", "node", "size", self._child("path").alias("child"))
            below = durable(below)
            share = below.groupBy("node", "size", "child").agg(F.count("*").alias("m")).groupBy("node", "size").agg(F.max("m").alias("m"))
            alike = durable(share.filter(F.col("m") >= F.col("size") * self.threshold).select("node"))
            if not alike.isEmpty():  # branching doesn't part near copies: it would only repeat them
                found, dense = found.unionByName(self._dealt(large.join(alike, "node", "left_semi"))), True
            named = below.join(alike, "node", "left_anti").select("id", F.col("child").alias("node"))
        return durable(found.join(classes.select("id", "n", "tokens"), "id")), dense

    def _dealt(self, large: DataFrame) -> DataFrame:
        """Members of large nodes in parts of a leaf's size; the member with the smallest id is a guest in those that aren't its own."""
        part = F.pmod(F.xxhash64(F.lit(5), "id"), F.ceil(F.col("size") / self.leaf))
        hub = large.groupBy("node", "size").agg(F.min("id").alias("id"))
        guests = hub.select("node", "id", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("size") / self.leaf) - 1)).alias("part"), F.lit(False).alias("native"))
        parts = large.select("node", "id", part.alias("part"), F.lit(True).alias("native")).unionByName(guests)
        parts = parts.groupBy("node", "id", "part").agg(F.max("native").alias("native"))
        return parts.select(F.xxhash64("node", "part").alias("node"), F.col("node").alias("base"), "id", "native")

    def _similar(self, n: np.ndarray, tokens: np.ndarray, i: int) -> tuple[np.ndarray, np.ndarray]:
        """How many minwise tokens each member shares with the i-th, and which may be similar to it."""
        like = (tokens == tokens[i]).sum(1)
        return like, (like >= self.least) & (np.minimum(n, n[i]) * self.den >= self.num * np.maximum(n, n[i]))

    def _likely(self, nodes: DataFrame) -> DataFrame:
        """Pairs a < b that link most of what is similar: of each member of a node the one most alike, and
        the node's two members that are most like all others."""

        def node(_, ids, __, n, tokens):
            m = len(ids)
            best, middle = np.full(m, -1), np.zeros(m, np.int64)
            for i in range(m):
                like, ok = self._similar(n, tokens, i)
                ok[i] = False
                if ok.any():
                    j = np.flatnonzero(ok)
                    best[i] = j[np.lexsort((ids[j], -like[j]))[0]]
                    middle[i] = like[j].sum()
            some = best >= 0
            a, b = [np.flatnonzero(some)], [best[some]]
            for i in np.lexsort((ids, -middle))[: 2 if m > 3 else 0]:
                j = np.flatnonzero(self._similar(n, tokens, i)[1])
                a.append(j[j != i])
                b.append(np.full(len(a[-1]), i))
            return [np.concatenate(a), np.concatenate(b)]

        def each(batch, cut):
            node_of, ids, labels, n = (batch.column(k).to_numpy() for k in range(4))
            tokens = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint32).reshape(-1, TOKENS).astype(np.uint16)
            size, out = np.diff(cut), set()
            two = cut[:-1][size == 2]  # most nodes
            ok = ((tokens[two] == tokens[two + 1]).sum(1) >= self.least) & (np.minimum(n[two], n[two + 1]) * self.den >= self.num * np.maximum(n[two], n[two + 1]))
            pairs = [(ids[two[ok]], ids[two[ok] + 1])]
            for i, m in zip(cut[:-1][size > 2].tolist(), size[size > 2].tolist(), strict=True):
                s = slice(i, i + m)
                a, b = node(node_of[i], ids[s], labels[s], n[s], tokens[s])
                pairs.append((ids[s][a], ids[s][b]))
            for a, b in pairs:
                out.update(zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist(), strict=True))
            if out:
                a, b = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        return _by_node(nodes.select("node", "id", "label", "n", "tokens"), each, "a long, b long").distinct()

    def _open(self, nodes: DataFrame) -> DataFrame:
        """node, id, label, native of members that may be similar to a member of the node with another label. A guest is
        compared with native members alone: every two members meet where one of them is native."""

        def each(batch, cut):
            ids, labels, n = (batch.column(k).to_numpy() for k in range(1, 4))
            tokens = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint32).reshape(-1, TOKENS).astype(np.uint16)
            native = batch.column(5).to_numpy(zero_copy_only=False)
            keep = np.zeros(len(ids), bool)
            for i, m in zip(cut[:-1].tolist(), np.diff(cut).tolist(), strict=True):
                s = slice(i, i + m)
                for k in _minority(labels[s], native[s]):
                    hit = self._similar(n[s], tokens[s], k)[1] & (labels[s] != labels[i + k]) & native[s]
                    if hit.any():
                        keep[s] |= hit
                        keep[i + k] = True
            at = pa.array(np.flatnonzero(keep))
            yield batch.select([0, 1, 2, 5]).take(at)

        return _by_node(nodes.select("node", "id", "label", "n", "tokens", "native"), each, "node long, id long, label long, native boolean")

    def _exact(self, members: DataFrame) -> DataFrame:
        """members: node, id, label, own, native. Links a, b between labels that full sets confirm, as few as join
        the labels of a node: each member outside of the commonest label is compared with all native ones."""

        def each(batch, cut):
            ids, labels = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            natives = batch.column(4).to_numpy(zero_copy_only=False)
            out = []
            for i, m in zip(cut[:-1].tolist(), np.diff(cut).tolist(), strict=True):
                sets = [_unsix(x.as_buffer()) for x in batch.column(3).slice(i, m)]
                size = np.array([len(x) for x in sets])
                values, at = np.unique(np.concatenate(sets), return_inverse=True)
                off = np.concatenate(([0], np.cumsum(size)))
                label, native, mark = labels[i : i + m].copy(), natives[i : i + m], np.zeros(len(values), np.int32)
                for k in _minority(label, native):
                    own = at[off[k] : off[k + 1]]
                    mark[own] = 1
                    both = np.add.reduceat(mark[at], off[:-1])
                    mark[own] = 0
                    hit = (both * self.den >= self.num * (size + size[k] - both)) & native
                    for other in np.unique(label[hit & (label != label[k])]):
                        j = int(np.flatnonzero(hit & (label == other))[0])
                        out.append((int(ids[i + k]), int(ids[i + j])))
                        label[label == other] = label[k]
            if out:
                a, b = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        return _by_node(members.select("node", "id", "label", "own", "native"), each, "a long, b long")

    def _sets(self, docs: DataFrame, classes: DataFrame, ends: DataFrame) -> DataFrame:
        """id, own: the full sets of the classes in ends."""
        shingle = self.shingle

        def kernel(batches):
            for batch in batches:
                for values, off in shingle_sets(batch.column(0), shingle):
                    s1, s2 = digests(values, off)
                    own = [_six(np.sort(values[a:b] & np.uint64(0xFFFFFFFFFFFF))) for a, b in zip(off[:-1], off[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(s1), pa.array(s2), pa.array(np.diff(off)), pa.array(own, pa.binary())], ["s1", "s2", "n", "own"])

        first = classes.join(ends, "id", "left_semi").select("doc_id").distinct()
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(first, "doc_id", "left_semi").select("text")
        own = texts.mapInArrow(kernel, "s1 long, s2 long, n long, own binary").dropDuplicates(["s1", "s2", "n"])
        return durable(own.join(classes.join(ends, "id", "left_semi").select("s1", "s2", "n", "id"), ["s1", "s2", "n"]).select("id", "own"))

    def _confirmed(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        num, den = self.num, self.den

        def kernel(batches):
            for batch in batches:
                keep = []
                for x, y in zip(batch.column(2), batch.column(3), strict=True):
                    x, y = _unsix(x.as_buffer()), _unsix(y.as_buffer())
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(both * den >= num * (len(x) + len(y) - both))
                yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

        full = pairs.join(sets.select(F.col("id").alias("a"), F.col("own").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("own").alias("y")), "b")
        return full.select("a", "b", "x", "y").mapInArrow(kernel, "a long, b long")

    def run(self, docs: DataFrame, by_text: bool = False) -> DataFrame:
        """docs: doc_id, text; other columns are not read. Returns doc_id, n_shingles, component_id, kept.
        by_text: and row, a hash of the text, and component, which tells groups with one smallest doc_id apart.

        component_id: the smallest doc_id that links reach, equal sets included. A null or empty text
        has no shingles and is linked with nothing: it is its own component. So is a row without
        doc_id, whose component_id is null. Rows that repeat a doc_id are judged each by its own text.
        An empty table gives none."""
        sk = durable(self.sketches(docs, by_text))
        known = sk.filter("doc_id is not null and n > 0")
        classes = known.groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("doc_id"), F.first("tokens").alias("tokens"))
        classes = durable(classes.withColumn("id", F.monotonically_increasing_id()))
        nodes, dense = self.nodes(classes)
        label, ends, found = None, None, None
        pairs = durable(self._likely(nodes.withColumn("label", F.col("id"))))
        if not pairs.isEmpty():
            ends = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
            sets = self._sets(docs, classes, ends)
            found = stars(durable(self._confirmed(pairs, sets)))
            label = labels(found)
        if dense or label is not None:
            rest = durable(self._open(self._members(nodes, label, dense)))
            if not rest.isEmpty():
                new = rest.select("id").distinct()
                if dense:  # members that met nobody in their own part
                    sets = self._sets(docs, classes, new) if ends is None else sets.unionByName(self._sets(docs, classes, new.join(ends, "id", "left_anti")))
                more = durable(self._exact(rest.join(sets, "id")))
                if not more.isEmpty():
                    label = labels(stars(more if found is None else found.unionByName(more)))
        smallest = classes.select("id", "doc_id", "s1", "s2", "n")
        if label is not None:
            of = durable(smallest.join(label, "id", "left").withColumn("component", F.coalesce("component", "id")).drop("id"))
            smallest = of.join(of.groupBy("component").agg(F.min("doc_id").alias("least")), "component").drop("doc_id").withColumnRenamed("least", "doc_id")
        else:
            smallest = smallest.withColumnRenamed("id", "component")
        own = ["row", "component"] if by_text else []
        same = known.select("doc_id", "s1", "s2", "n", *own[:1]).join(smallest.withColumnRenamed("doc_id", "component_id"), ["s1", "s2", "n"]).withColumnRenamed("n", "n_shingles")
        alone = sk.filter("doc_id is null or n = 0").withColumn("component", F.lit(None).cast("long"))
        same = same.select("doc_id", "n_shingles", "component_id", *own)
        alone = alone.select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), *own)
        return same.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))

    def _members(self, nodes: DataFrame, label: DataFrame | None, dense: bool) -> DataFrame:
        """Members of nodes with their labels so far. Where a large node was dealt into parts, the members
        whose label isn't that of its first are guests in all of its parts."""
        if label is None:
            members = nodes.withColumn("label", F.col("id"))
        else:
            members = nodes.join(label.withColumnRenamed("component", "label"), "id", "left").withColumn("label", F.coalesce("label", "id"))
        if not dense:
            return members
        parts = members.filter("node <> base")
        main = parts.groupBy("base").agg(F.min(F.struct("id", "label")).alias("h")).select("base", F.col("h.label").alias("main"))
        odd = parts.filter("native").join(main, "base").filter("label <> main").drop("main", "node", "native")
        again = odd.join(parts.select("base", "node").distinct(), "base").withColumn("native", F.lit(False)).select(members.columns)
        return members.unionByName(again.join(members.filter("native").select("node", "id"), ["node", "id"], "left_anti"))
