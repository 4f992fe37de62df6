"""A convolutional text classifier for toxicity, trained in numpy by the tasks that hold the labelled rows, on all of them."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .cluster import MOST_PARTITIONS, durable
from .textkit import FOLD, PUNCT, flat, mix, pieces, whole, word_hashes, words

WORD_BUCKETS, HEAD_BUCKETS = 1 << 15, 1 << 14
PIECE = 1 << 20
#: Rows and bytes of text of about one part, which one task fits on at a time; epochs where all rows are one part, rounds where they are more.
PART_ROWS, PART_BYTES, EPOCHS, ROUNDS = 8192, 64 << 20, 10, 3
#: Steps of a parameter are added as whole numbers, so that sums don't depend on their order.
UNIT = 1 << 24
#: Logits are counted in steps of 1 / FINE, calibrated scores in steps of 1 / CUTS.
FINE, CUTS = 256, 10_000
MODELS = 3


def tokens(texts: pa.Array):
    """Of runs of texts: row of the embedding table of each word and of each word's first four bytes, and where each text begins."""
    data, off = flat(texts)
    for i, j in pieces(off, PIECE):
        own, o = FOLD[data[off[i] : off[j]]], off[i : j + 1] - off[i]
        s, e, woff = words(own, o, PUNCT)
        head = np.zeros(len(s), np.uint64)
        for k in range(4):
            at = s + k
            head = head << np.uint64(8) | np.where(at < e, own[np.minimum(at, max(len(own) - 1, 0))], 0).astype(np.uint64)
        ids = np.empty((len(s), 2), np.int32)
        ids[:, 0] = word_hashes(own, s, e) % np.uint64(WORD_BUCKETS)
        ids[:, 1] = mix(head, 9) % np.uint64(HEAD_BUCKETS) + np.uint64(WORD_BUCKETS)
        yield ids, woff


@dataclass
class Convolution:
    """Embeddings of hashed words, filters of several widths, max pooling over the whole text, one dense unit.

    The widest filters have one weight for all their places: they see how dense a passage is."""

    size: int = 8
    widths: tuple[int, ...] = (1, 2, 3)
    wide: int = 24
    filters: int = 12
    seed: int = 7
    p: dict[str, np.ndarray] = field(default_factory=dict)

    def begin(self) -> None:
        r = np.random.default_rng(self.seed)
        self.p["E"] = r.normal(0, 0.01, (WORD_BUCKETS + HEAD_BUCKETS, self.size)).astype(np.float32)
        for w in self.widths:
            self.p[f"W{w}"] = r.normal(0, 0.3, (w, self.size, self.filters)).astype(np.float32)
        self.p["V"] = r.normal(0, 0.3, (self.size, self.filters)).astype(np.float32)
        n = self.filters * (len(self.widths) + 1)
        self.p["B"] = np.zeros(n, np.float32)
        self.p["D"] = r.normal(0, 0.2, n).astype(np.float32)
        self.p["d"] = np.zeros(1, np.float32)

    def maps(self, x: np.ndarray, woff: np.ndarray) -> list[np.ndarray]:
        """Of each kind of filter its value at each word, -inf where it doesn't fit into the text."""
        out = []
        n = len(x)
        for w in self.widths:
            z = np.full((n, self.filters), -np.inf, np.float32)
            m = n - w + 1
            if m > 0:
                v = x[:m] @ self.p[f"W{w}"][0]
                for o in range(1, w):
                    v += x[o : o + m] @ self.p[f"W{w}"][o]
                v[~whole(woff, w, m)] = -np.inf
                z[:m] = v
            out.append(z)
        total = np.zeros((n + 1, self.filters))
        np.cumsum(x @ self.p["V"], axis=0, out=total[1:], dtype=np.float64)
        last = np.minimum(np.arange(n) + self.wide, np.repeat(woff[1:], np.diff(woff)))
        out.append((total[last] - total[:-1]).astype(np.float32))
        return out

    def embed(self, ids: np.ndarray) -> np.ndarray:
        return self.p["E"][ids[:, 0]] + self.p["E"][ids[:, 1]]

    def pooled(self, ids: np.ndarray, woff: np.ndarray) -> np.ndarray:
        out = np.zeros((len(woff) - 1, len(self.p["B"])), np.float32)
        full = np.flatnonzero(np.diff(woff))
        if len(full):
            for k, z in enumerate(self.maps(self.embed(ids), woff)):
                own = slice(k * self.filters, (k + 1) * self.filters)
                out[full, own] = np.maximum(np.maximum.reduceat(z, woff[full], axis=0) + self.p["B"][own], 0)
        return out

    def logits(self, ids: np.ndarray, woff: np.ndarray) -> np.ndarray:
        return self.pooled(ids, woff) @ self.p["D"] + self.p["d"][0]

    def gradients(self, ids: np.ndarray, woff: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss; only the places that won the pooling get any."""
        x = self.embed(ids)
        maps = self.maps(x, woff)
        n, f = len(y), self.filters
        best = np.zeros((n, len(maps) * f), np.int64)
        pool = np.full((n, len(maps) * f), -np.inf, np.float32)
        for i in np.flatnonzero(np.diff(woff)):
            for k, z in enumerate(maps):
                own = z[woff[i] : woff[i + 1]]
                at = own.argmax(0)
                best[i, k * f : (k + 1) * f] = at + woff[i]
                pool[i, k * f : (k + 1) * f] = own[at, np.arange(f)]
        h = np.maximum(pool + self.p["B"], 0)
        logit = h @ self.p["D"] + self.p["d"][0]
        dl = ((1 / (1 + np.exp(-logit)) - y) / n).astype(np.float32)
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["D"], g["d"][0] = h.T @ dl, dl.sum()
        dh = np.where(h > 0, dl[:, None] * self.p["D"][None], 0).astype(np.float32)
        g["B"] = dh.sum(0)
        doc, col = np.nonzero(dh)
        v, at = dh[doc, col], best[doc, col]
        places, steps = [], []
        for k, w in enumerate([*self.widths, self.wide]):
            here = (col // f) == k
            c, a, d, end = col[here] % f, at[here], v[here], woff[doc[here] + 1]
            by_filter = np.zeros((len(c), f), np.float32)
            by_filter[np.arange(len(c)), c] = d
            for o in range(w):
                ok = a + o < end
                if k < len(self.widths):
                    g[f"W{w}"][o] = x[a[ok] + o].T @ by_filter[ok]
                    back = self.p[f"W{w}"][o]
                else:
                    g["V"] += x[a[ok] + o].T @ by_filter[ok]
                    back = self.p["V"]
                places.append(a[ok] + o)
                steps.append(by_filter[ok] @ back.T)
        place, step = np.concatenate(places), np.concatenate(steps)
        used, own = np.unique(place, return_inverse=True)
        dx = np.stack([np.bincount(own, step[:, j], len(used)) for j in range(self.size)], axis=1).astype(np.float32)
        for side in (0, 1):
            np.add.at(g["E"], ids[used, side], dx)
        return g

    def fit(self, docs: list[np.ndarray], y: np.ndarray, epochs: int = 10) -> None:
        self.begin()
        self.descend(docs, y, epochs, self.seed + 1)

    def descend(self, docs: list[np.ndarray], y: np.ndarray, epochs: int, seed: int, batch: int = 32, rate: float = 0.01) -> None:
        """Goes on from what the model is."""
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        t = 0
        for _ in range(epochs):
            order = r.permutation(len(docs))
            for i in range(0, len(order), batch):
                own = order[i : i + batch]
                ids = np.concatenate([docs[k] for k in own])
                woff = np.concatenate(([0], np.cumsum([len(docs[k]) for k in own])))
                t += 1
                for k, g in self.gradients(ids, woff, y[own]).items():
                    m[k] += 0.1 * (g - m[k])
                    s[k] += 0.001 * (g * g - s[k])
                    self.p[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)

    def rows(self) -> np.ndarray:
        """All parameters as rows of one width: first the embeddings, then the rest."""
        rest = np.concatenate([self.p[k].ravel() for k in sorted(self.p) if k != "E"])
        return np.concatenate((self.p["E"], np.pad(rest, (0, -len(rest) % self.size)).reshape(-1, self.size)))

    def take(self, rows: np.ndarray) -> Convolution:
        """Sets all parameters from such rows."""
        if not self.p:
            self.begin()
        n = len(self.p["E"])
        rest, at = rows[n:].ravel(), 0
        for k in sorted(self.p):
            if k == "E":
                self.p[k] = rows[:n].astype(np.float32)
            else:
                size = self.p[k].size
                self.p[k], at = rest[at : at + size].reshape(self.p[k].shape).astype(np.float32), at + size
        return self


def _parts(batches):
    """Of each part in a task its halves, labels and texts, and languages, by doc_id."""
    own: dict[int, list] = {}
    for batch in batches:
        for part, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own.setdefault(part, []).append(row)
    for part in sorted(own):
        rows = sorted(own.pop(part), key=lambda r: r[0])
        packed = [np.frombuffer(r[4], np.int32) for r in rows]
        ids = [np.stack((x & (WORD_BUCKETS - 1), (x >> 15) + WORD_BUCKETS), axis=1) for x in packed]
        yield part, np.array([r[1] for r in rows]), np.array([r[2] > 0 for r in rows], np.float32), [r[3] for r in rows], ids


@dataclass
class Toxicity:
    """Three models are fitted at once: one on all labelled rows, which scores, and one on each half of them, whose scores of the
    other half calibrate it and choose thresholds. Parts of the rows are fitted on in tasks, in rounds: a round goes on from the parameters
    of the last one, and adds to each the mean step of the parts that moved it. The driver holds the parameters and counts.

    max_train, max_words: where given, the most labelled documents, and the most words in all, that are fitted on, those with the
    smallest hash of doc_id. By default all are. languages: whether to choose thresholds by language."""

    max_train: int | None = None
    max_words: int | None = None
    threshold: float = 0.3
    least_of_language: int = 20
    languages: bool = True
    model: Convolution | None = None
    scale: tuple[float, float] = (1.0, 0.0)
    prior: float = 0.0
    fitted: int = 0
    by_lang: dict[str, float] = field(default_factory=dict)

    def fit(self, docs: DataFrame, labels: DataFrame) -> Toxicity:
        """docs: doc_id, text, lang (for thresholds alone); labels: doc_id, toxic. Rows whose held_out is
        true, null labels and labels of missing rows teach nothing; of labels that disagree the toxic one holds; of rows that
        repeat a doc_id the one whose words have the least hash. Without labels every score is 0, where all are alike their
        share. Empty texts teach as texts of no words."""
        lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
        known = labels.filter("doc_id is not null and toxic is not null").filter(~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("y"))
        if self.max_train is not None:
            known = known.orderBy(F.xxhash64(F.lit(3), "doc_id"), "doc_id").limit(self.max_train)

        def kernel(batches):
            for batch in batches:
                done = 0
                for ids, woff in tokens(batch.column(1)):
                    n = len(woff) - 1
                    packed = ids[:, 0] | ((ids[:, 1] - WORD_BUCKETS) << 15)
                    own = [packed[a:b].tobytes() for a, b in zip(woff[:-1], woff[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, n), batch.column(2).slice(done, n), pa.array(own, pa.binary())], ["doc_id", "lang", "ids"])
                    done += n

        rows = docs.filter("doc_id is not null").filter(~held_out()).select(F.col("doc_id").cast("long").alias("doc_id"), "text", lang.alias("lang"))
        seen = rows.agg(F.count("*").alias("rows"), F.sum(F.octet_length("text")).alias("bytes")).first()
        taught = known.count()
        size = int((seen.bytes or 0) * min(1.0, taught / max(1, seen.rows)))
        parts = max(-(-taught // PART_ROWS), -(-size // PART_BYTES), 1)
        tasks = min(parts, MOST_PARTITIONS)
        rows = rows.mapInArrow(kernel, "doc_id long, lang string, ids binary").join(known, "doc_id")
        rows = rows.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("ids").alias("h"), "ids", "y", "lang")).alias("r")).select("doc_id", "r.ids", "r.y", "r.lang")
        if self.max_words is not None:
            rows = durable(rows)
            words = rows.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n"), F.xxhash64(F.lit(3), "doc_id").alias("h"))
            upto = F.sum("n").over(Window.orderBy("h", "doc_id"))
            rows = rows.join(words.withColumn("upto", upto).filter(F.col("upto") <= self.max_words).select("doc_id"), "doc_id")
        part, half = F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(parts)).cast("int"), F.pmod(F.xxhash64(F.lit(6), "doc_id"), F.lit(2)).cast("int")
        rows = rows.select(part.alias("part"), "doc_id", half.alias("half"), "y", "lang", "ids")
        rows = durable(rows.repartitionById(tasks, F.col("part") % tasks))
        counts = {(r.half, r.toxic): r.n for r in rows.groupBy("half", (F.col("y") > 0).alias("toxic")).agg(F.count("*").alias("n")).collect()}
        self.fitted = sum(counts.values())
        if not counts:
            return self
        self.prior = sum(n for (_, toxic), n in counts.items() if toxic) / self.fitted
        if 0 < self.prior < 1:
            apart = len(counts) == 4  # else too few of a label to part them
            models = self._descend(rows, parts)
            self.model = Convolution().take(models[-1])
            self._calibrate(rows, models if apart else [models[-1]] * MODELS)
        return self

    @staticmethod
    def _descend(rows: DataFrame, parts: int) -> list[np.ndarray]:
        """Parameters of the models of each half's other rows and, as the last one, of all rows."""
        first = Convolution()
        first.begin()
        models = [first.rows() for _ in range(MODELS)]
        steps = [f"s{j}" for j in range(first.size)]
        context = rows.sparkSession.sparkContext
        for turn in range(1 if parts == 1 else ROUNDS):
            shared = context.broadcast(models)
            epochs = EPOCHS if parts == 1 else 1

            def kernel(batches, shared=shared, turn=turn, epochs=epochs):
                for part, half, y, _, ids in _parts(batches):
                    for k, before in enumerate(shared.value):
                        own = np.flatnonzero(half != k)  # no row is of the half of the last model
                        model = Convolution().take(before)
                        model.descend([ids[i] for i in own], y[own], epochs, (model.seed + 1, turn, part, k))
                        step = np.rint((model.rows() - before) * UNIT).astype(np.int64)
                        moved = np.flatnonzero(step.any(axis=1))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(moved), k, np.int32)), pa.array(moved.astype(np.int32)), *map(pa.array, step[moved].T.copy())], ["model", "row", *steps])

            moved = rows.mapInArrow(kernel, "model int, row int, " + ", ".join(f"{x} long" for x in steps))
            mean = moved.groupBy("model", "row").agg(*((F.sum(x) / F.count("*") / UNIT).cast("float").alias(x) for x in steps))
            models = [m.copy() for m in models]
            for batch in mean.toArrow().to_batches():
                of, row, step = batch.column(0).to_numpy(), batch.column(1).to_numpy(), np.stack([c.to_numpy() for c in batch.columns[2:]], axis=1)
                for k in range(MODELS):
                    models[k][row[of == k]] += step[of == k]
            shared.unpersist()
        return models

    def _calibrate(self, rows: DataFrame, models: list[np.ndarray]) -> None:
        """Scale of the scores, and thresholds, from the logits that every fitted row has of a model that didn't see it."""
        shared = rows.sparkSession.sparkContext.broadcast(models)

        def kernel(batches):
            own = [Convolution().take(m) for m in shared.value]
            for _, half, y, langs, ids in _parts(batches):
                logits = [own[h].logits(x, np.array([0, len(x)]))[0] for h, x in zip(half, ids, strict=True)]
                step = np.rint(np.clip(logits, -64, 64) * FINE).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(half.astype(np.int32)), pa.array(y > 0), pa.array(step)], ["lang", "half", "toxic", "step"])

        found = durable(rows.mapInArrow(kernel, "lang string, half int, toxic boolean, step int").groupBy("lang", "half", "toxic", "step").agg(F.count("*").alias("n")))
        counts = found.groupBy("half", "toxic", "step").agg(F.sum("n").alias("n")).orderBy("half", "toxic", "step").toArrow()
        of_half, toxic, step, n = (counts.column(c).to_numpy() for c in ("half", "toxic", "step", "n"))
        of = lambda own: self._platt(step[own] / FINE, toxic[own].astype(float), n[own].astype(float))
        self.scale = of(slice(None))
        if self.languages:
            by_half = [of(of_half == k) for k in (0, 1)]
            self.by_lang = self._by_language(found, by_half)

    @staticmethod
    def _platt(logits: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
        """Scale and shift of least log loss on smoothed labels, of logits that n rows have each."""
        a, b = 1.0, 0.0
        toxic, rest = (n * y).sum(), (n * (1 - y)).sum()
        goal = np.where(y > 0, (toxic + 1) / (toxic + 2), 1 / (rest + 2))
        for _ in range(300):
            q = 1 / (1 + np.exp(-np.clip(a * logits + b, -30, 30)))
            w = n * np.maximum(q * (1 - q), 1e-6)
            h = np.array([[np.sum(w * logits**2) + 1e-3, np.sum(w * logits)], [np.sum(w * logits), np.sum(w) + 1e-3]])
            step = np.linalg.solve(h, [np.sum(n * (q - goal) * logits), np.sum(n * (q - goal))])
            a, b = max(a - float(np.clip(step[0], -0.5, 0.5)), 0.05), b - float(np.clip(step[1], -0.5, 0.5))
        return a, b

    def _by_language(self, found: DataFrame, scales: list[tuple[float, float]]) -> dict[str, float]:
        """Of each language the threshold of most F1, of thresholds in steps of 1 / CUTS, between the scores that it parts."""
        by_half = [F.lit(a) * F.col("step") / FINE + F.lit(b) for a, b in scales]
        logit = F.when(F.col("half") == 0, by_half[0]).otherwise(by_half[1])
        cut = F.floor(CUTS / (1 + F.exp(-F.least(F.greatest(logit, F.lit(-30.0)), F.lit(30.0))))).cast("int")
        cuts = found.filter("lang is not null").groupBy("lang", cut.alias("cut")).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("t"))
        line = Window.partitionBy("lang").orderBy("cut")  # at most CUTS + 1 rows a language
        over, all_of = line.rowsBetween(0, Window.unboundedFollowing), line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        cuts = cuts.select(
            "lang", "cut", F.lag("cut").over(line).alias("below"), F.sum("n").over(over).alias("n"), F.sum("t").over(over).alias("t"),
            F.sum("t").over(all_of).alias("toxic"), F.sum(F.col("n") - F.col("t")).over(all_of).alias("rest"),
        )
        cuts = cuts.filter(F.least("toxic", "rest") >= self.least_of_language)
        best = F.struct((2 * F.col("t") / (F.col("n") + F.col("toxic"))).alias("f1"), (-F.col("cut")).alias("low"), F.coalesce("below", "cut").alias("below"))
        chosen = cuts.groupBy("lang").agg(F.max(best).alias("x")).collect()
        return {r.lang: (r.x.below - r.x.low) / 2 / CUTS for r in sorted(chosen, key=lambda r: r.lang)}

    def chances(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * logits + self.scale[1], -30, 30)))

    def score(self, docs: DataFrame) -> DataFrame:
        """All columns of docs and, as the last one, score, with underscores before it where docs has that name. A null or
        empty text is scored as a text of no words; repeated rows get equal scores; no rows give none."""
        shared = docs.sparkSession.sparkContext.broadcast(self)
        names, text = docs.columns, docs.columns.index("text")
        name, used = "score", {c.lower() for c in names}
        while name in used:
            name = f"_{name}"

        def kernel(batches):
            own = shared.value
            for batch in batches:
                out = []
                for ids, woff in tokens(batch.column(text)):
                    out.append(own.chances(own.model.logits(ids, woff)) if own.model else np.full(len(woff) - 1, own.prior))
                s = np.concatenate(out) if out else np.zeros(0)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s.astype(np.float64))], [*names, name])

        plain = docs.toDF(*(f"c{k}" for k in range(len(names))))  # names with dots can't be referred to below
        return plain.mapInArrow(kernel, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def held_out(doc_id: str = "doc_id"):
    """Rows that are kept for measuring: crc32 of doc_id as text leaves 2 by 4. Null doc_ids aren't."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= 0.3), lang_threshold, flagged (score >= its language's
    threshold, or 0.3 where calibration saw too few of a language) of each row of docs.

    Repeated rows are scored alike, ties of a score and a threshold count as toxic; columns of docs besides doc_id, text
    and lang are not read. No rows give none; without labels every score is 0. Texts are scored whole."""
    model = Toxicity(**parameters).fit(docs, labels)
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    out = model.score(docs.select("doc_id", "text", lang.alias("lang"))).drop("text")
    cut = F.lit(model.threshold)
    if model.by_lang:
        cut = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in model.by_lang.items() for x in pair)), F.col("lang")), cut)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= model.threshold).cast("int").alias("predicted"), cut.alias("lang_threshold"), (F.col("score") >= cut).alias("flagged"))
