"""Weights of signals by coordinate search, over all episodes or over all but one, and the rankings that they make.

A search is a row: its weights by now, what they reach, and where it goes on. In a round every episode's pool is scored once for
each distinct vector that a search may move to from where it is; sums over episodes, less the one that a search leaves out,
tell each search its next move. So searches that agree share their work, and leaving each episode out costs no more passes than one search."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.plans.durable import durable

# Names of signals, the values that a weight may take, passes, places that count, and how much better is better.
SIGNALS = ("hook", "payoff", "clarity", "emotion", "novelty", "pace", "fit")
GRID = (0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0)
PASSES, TOP, BETTER = 3, 6, 1e-9
#: Vectors that a round looks around; searches at others wait for the next round.
AROUND = 256


def _episodes(pools: DataFrame, matches: DataFrame, graded: DataFrame) -> DataFrame:
    """src, signals (one array an item, by start), hits (place of the item, moment, gain, cover): a row an episode whose pool meets a
    moment. A pool is bounded, and so is the row."""
    gains = graded.select("src", F.col("id").alias("mid"), (F.pow(F.lit(2.0), F.col("grade")) - 1).alias("gain")).filter("gain > 0")
    place = F.row_number().over(Window.partitionBy("src").orderBy("since", "id")) - 1
    items = pools.select("src", "id", place.alias("place"), F.array(*(F.col(k).cast("double") for k in SIGNALS)).alias("x"))
    hits = matches.select("src", F.col("cid").alias("id"), "mid", "cover").join(gains, ["src", "mid"]).join(items.select("src", "id", "place"), ["src", "id"])
    hits = hits.groupBy("src").agg(F.collect_list(F.struct("place", "mid", "gain", "cover")).alias("hits"))
    listed = items.groupBy("src").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "x"))), lambda i: i["x"]).alias("signals"))
    return listed.join(hits, "src")


def pool_ndcg(signals: np.ndarray, hits: list, weights: np.ndarray, k: int = TOP) -> np.ndarray:
    """The nDCG of a pool ordered by each row of weights. Equal means keep the pool's order; a place credits one moment that was
    not credited: the one of most gain, then cover, then least id."""
    mean = np.floor(signals @ weights.T / weights.sum(1) * 100 + 0.5)
    orders = np.argsort(-mean, axis=0, kind="stable")[:k].T
    of: dict[int, list] = {}
    for h in hits:
        of.setdefault(h["place"], []).append((-h["gain"], -h["cover"], h["mid"]))
    best = sorted({h["mid"]: h["gain"] for h in hits}.values(), reverse=True)[:k]
    ideal = sum(g / np.log2(r + 2) for r, g in enumerate(best))
    known: dict[bytes, float] = {}
    for order in orders:
        if order.tobytes() not in known:
            credited, got = set(), 0.0
            for r, item in enumerate(order.tolist()):
                new = [h for h in sorted(of.get(item, [])) if h[2] not in credited]
                if new:
                    credited.add(new[0][2])
                    got -= new[0][0] / np.log2(r + 2)
            known[order.tobytes()] = got / ideal
    return np.array([known[o.tobytes()] for o in orders])


def around(w: np.ndarray) -> np.ndarray:
    """All vectors that one signal's other value makes of w, signal by signal in the grid's order, w itself among them."""
    out = np.repeat(w[None], len(SIGNALS) * len(GRID), 0)
    for s in range(len(SIGNALS)):
        out[s * len(GRID) : (s + 1) * len(GRID), s] = GRID
    return out


def advance(w: list, best: float | None, at: int, turn: int, changed: bool, mean: np.ndarray) -> tuple:
    """A search's next state, given the means of the vectors around w: after the first signal that takes another value, or at the end."""
    w, mean = list(w), mean.reshape(len(SIGNALS), len(GRID))
    best = float(mean[0, GRID.index(w[0])]) if best is None else best
    for s in range(at, len(SIGNALS)):
        value = w[s]
        for v, score in zip(GRID, mean[s].tolist(), strict=True):
            if v != value and score > best + BETTER:
                best, value = score, v
        if value != w[s]:
            w[s] = value
            return w, best, s + 1, turn, True, False
    return (w, best, 0, turn + 1, False, False) if changed and turn + 1 < PASSES else (w, best, 0, turn, changed, True)


def search(pools: DataFrame, matches: DataFrame, graded: DataFrame, leave_out: bool = False) -> DataFrame:
    """held, w, best: the weights of one search (held is null), or of one for each episode (src) of pools, which is left out of it.

    pools: src, id, since and the signals; matches: src, cid, mid, cover; graded: src, id, grade. Episodes without a match teach
    nothing; without any all weights stay 1 and best is 0. The driver holds AROUND vectors at most; each round's searches are checkpointed."""
    episodes = durable(_episodes(pools, matches, graded))
    start = [f"array_repeat(1D, {len(SIGNALS)}) as w", "cast(null as double) as best", "0 as at", "0 as turn", "false as changed", "false as done"]
    kind = pools.schema["src"].dataType.simpleString()
    held = pools.select(F.col("src").alias("held")).distinct() if leave_out else pools.sparkSession.range(1).select(F.lit(None).cast(kind).alias("held"))
    state = durable(held.selectExpr("held", *start))
    schema = f"held {kind}, w array<double>, best double, at int, turn int, changed boolean, done boolean"
    while rows := state.filter("not done").groupBy("w").count().orderBy(F.col("count").desc(), "w").limit(AROUND).collect():
        vectors = [list(r.w) for r in rows]
        trials = np.concatenate([around(np.array(v)) for v in vectors])
        each = len(SIGNALS) * len(GRID)

        def scored(frames, trials=trials, each=each):
            for frame in frames:
                out = [(r.src, v, x.tolist()) for r in frame.itertuples() for v, x in enumerate(pool_ndcg(np.stack(r.signals), r.hits, trials).reshape(-1, each))]
                yield pd.DataFrame(out, columns=["src", "v", "own"])

        own = durable(episodes.mapInPandas(scored, f"src {kind}, v int, own array<double>"))
        sums = own.select("v", F.posexplode("own")).groupBy("v", "pos").agg(F.sum("col").alias("total"), F.count("*").alias("n"))
        sums = sums.groupBy("v").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "total"))), lambda t: t["total"]).alias("total"), F.max("n").alias("n"))
        table = pools.sparkSession.createDataFrame([(v, w) for v, w in enumerate(vectors)], "v int, w array<double>")
        near = state.join(F.broadcast(table), "w", "left").join(F.broadcast(sums), "v", "left").join(own.withColumnRenamed("src", "held"), ["held", "v"], "left")

        def moved(frames):
            for frame in frames:
                out = []
                for r in frame.itertuples():
                    if r.done or pd.isna(r.v):
                        out.append((r.held, list(r.w), r.best, r.at, r.turn, r.changed, r.done))
                        continue
                    mine = r.own is not None
                    n = 0 if pd.isna(r.n) else int(r.n) - mine
                    mean = (np.asarray(r.total) - (np.asarray(r.own) if mine else 0)) / n if n else np.zeros(each)
                    out.append((r.held, *advance(r.w, None if pd.isna(r.best) else r.best, r.at, r.turn, r.changed, mean)))
                yield pd.DataFrame(out, columns=["held", "w", "best", "at", "turn", "changed", "done"])

        state = durable(near.mapInPandas(moved, schema))
    return state.select("held", "w", F.coalesce("best", F.lit(0.0)).alias("best"))


def fit_weights(pools: DataFrame, matches: DataFrame, graded: DataFrame, leave_out: bool = False) -> DataFrame:
    """signal, weight, score (the mean nDCG reached); leave_out: and held, the episode that they were learned without."""
    found = search(pools, matches, graded, leave_out)
    out = found.select("held", F.posexplode("w"), (F.floor(F.col("best") * 1e6 + 0.5) / 1e6).alias("score"))
    out = out.select("held", F.element_at(F.lit(list(SIGNALS)), F.col("pos") + 1).alias("signal"), F.col("col").alias("weight"), "score")
    return out if leave_out else out.drop("held")


def ranked_by(pools: DataFrame, found: DataFrame) -> DataFrame:
    """Src, id, composite, pos: each episode's pool by the weights that were found without it, then by start, then id."""
    terms = [F.col(k) * F.get("w", F.lit(i)) for i, k in enumerate(SIGNALS)]
    mean = sum(terms[1:], terms[0]) / F.expr("aggregate(w, 0D, (a, x) -> a + x)")
    scored = pools.join(found.select(F.col("held").alias("src"), "w"), "src").withColumn("composite", F.floor(mean * 100 + 0.5) / 100)
    pos = F.row_number().over(Window.partitionBy("src").orderBy(F.col("composite").desc(), "since", "id"))
    return scored.select("src", "id", "composite", pos.alias("pos"))
