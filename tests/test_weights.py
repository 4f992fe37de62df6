"""The search for weights against one that goes step by step over each training set, and intervals against resampling in order."""

import math
import random

import pytest

from spanloom.operators import folds, weights

SIGNALS = weights.SIGNALS
POOL = "src long, id long, since double, " + ", ".join(f"{k} double" for k in SIGNALS)


def ordered(pool, w):
    mean = lambda x: math.floor(sum(a * b for a, b in zip(x[2:], w, strict=True)) / sum(w) * 100 + 0.5) / 100
    return sorted(pool, key=lambda x: (-mean(x), x[1], x[0]))


def ndcg(pool, hits, w):
    """hits: (item, moment, gain, cover)."""
    done, got = set(), 0.0
    for place, item in enumerate(ordered(pool, w)[:6]):
        free = sorted((-g, -c, m) for i, m, g, c in hits if i == item[0] and m not in done)
        if free:
            done.add(free[0][2])
            got -= free[0][0] / math.log2(place + 2)
    best = sorted({m: g for _, m, g, _ in hits}.values(), reverse=True)[:6]
    return got / sum(g / math.log2(r + 2) for r, g in enumerate(best))


def fitted(train):
    score = lambda w: sum(ndcg(p, h, w) for p, h in train) / len(train) if train else 0.0
    w = [1.0] * 7
    best = score(w)
    for _ in range(3):
        changed = False
        for s in range(7):
            for v in (0.25, 0.5, 0.75, 1, 1.5, 2, 3):
                if v != w[s]:
                    trial = [*w[:s], v, *w[s + 1 :]]
                    if (x := score(trial)) > best + 1e-9:
                        best, w, changed = x, trial, True
        if not changed:
            break
    return w, best


def episodes(seed, n=5):
    r = random.Random(seed)
    pools = {s: [(i, float(r.randint(0, 5)), *(float(r.randint(0, 10)) for _ in SIGNALS)) for i in range(12)] for s in range(n)}
    grades = {(s, m): r.randint(1, 3) for s in range(n - 1) for m in range(4)}
    hits = {s: [(i, m, 2.0 ** grades[s, m] - 1, r.choice([0.4, 0.9])) for m in range(4) for i in r.sample(range(12), 2)] for s in range(n - 1)}
    return pools, grades, {**hits, n - 1: []}


def tables(spark, pools, grades, hits):
    return (
        spark.createDataFrame([(s, *x) for s, p in pools.items() for x in p], POOL),
        spark.createDataFrame([(s, i, m, c) for s, h in hits.items() for i, m, _, c in h], "src long, cid long, mid long, cover double"),
        spark.createDataFrame([(s, m, g) for (s, m), g in grades.items()], "src long, id long, grade int"),
    )


def test_searches_equal_those_of_one_training_set_after_the_other(spark):
    pools, grades, hits = episodes(1)
    taught = tables(spark, pools, grades, hits)
    train = {s: (pools[s], hits[s]) for s in pools if hits[s]}
    found = weights.search(*taught, leave_out=True)
    got = {r.held: (list(r.w), r.best) for r in found.collect()}
    want = {s: fitted([t for k, t in train.items() if k != s]) for s in pools}
    assert {s: w for s, (w, _) in got.items()} == {s: w for s, (w, _) in want.items()}
    assert all(abs(got[s][1] - want[s][1]) < 1e-9 for s in pools) and len({tuple(w) for w, _ in want.values()}) > 1
    ranks = {}
    for r in weights.ranked_by(taught[0], found).orderBy("src", "pos").collect():
        ranks.setdefault(r.src, []).append(r.id)
    assert ranks == {s: [x[0] for x in ordered(pools[s], want[s][0])] for s in pools}


def test_searches_that_wait_for_each_other_and_one_over_all(spark, monkeypatch):
    """Rounds that look around one vector."""
    monkeypatch.setattr(weights, "AROUND", 1)
    pools, grades, hits = episodes(4, 3)
    taught = tables(spark, pools, grades, hits)
    train = {s: (pools[s], hits[s]) for s in pools if hits[s]}
    assert {r.held: list(r.w) for r in weights.search(*taught, leave_out=True).collect()} == {s: fitted([t for k, t in train.items() if k != s])[0] for s in pools}
    (one,) = weights.search(*taught).collect()
    assert (one.held, list(one.w)) == (None, fitted(list(train.values()))[0])


def test_nothing_to_learn_from(spark):
    pools, grades, hits = episodes(2)
    p, m, g = tables(spark, pools, grades, hits)
    assert {(r.weight, r.score) for r in weights.fit_weights(p, m.filter("cid < 0"), g, leave_out=True).collect()} == {(1.0, 0.0)}
    assert weights.fit_weights(p.filter("id < 0"), m, g, leave_out=True).collect() == []
    one = p.filter("src = 0")
    assert {r.weight for r in weights.fit_weights(one, m, g, leave_out=True).collect()} == {1.0}  # no other episode


def stepwise(xs, runs, seed):
    a, means = seed, []
    for _ in range(runs):
        total = 0.0
        for _ in xs:
            a = (a + 0x6D2B79F5) % 2**32
            t = (a ^ a >> 15) * (a | 1) % 2**32
            t = (t + (t ^ t >> 7) * (t | 61)) % 2**32 ^ t
            total += xs[int((t ^ t >> 14) / 2**32 * len(xs))]
        means.append(total / len(xs))
    means.sort()
    mean = sum(xs) / len(xs)
    return len(xs), mean, min(means[runs * 25 // 1000], mean), max(means[max(0, -(-runs * 975 // 1000) - 1)], mean)


@pytest.mark.parametrize("block,draws", [(1 << 20, 4_000_000), (7, 90), (1, 1)])
def test_intervals_of_blocks_and_ranges_equal_one_stream(spark, monkeypatch, block, draws):
    """block: values that a task holds; draws: draws that a range of runs takes at most."""
    monkeypatch.setattr(folds, "BLOCK", block)
    monkeypatch.setattr(folds, "DRAWS", draws)
    r = random.Random(3)
    groups = {"a": [r.random() for _ in range(40)], "b": [0.25], "c": [r.gauss(0, 5) for _ in range(9)]}
    rows = [(k, 10 * i, x) for k, xs in groups.items() for i, x in enumerate(xs)] + [("a", 5, None), ("none", 1, None)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, src long, x double").repartition(3)
    got = {g.k: tuple(g)[1:] for g in folds.intervals(df, ["k"], 200, 9).collect()}
    assert got.pop("none") == (0, None, None, None) and set(got) == set(groups)
    for k, xs in groups.items():
        want = stepwise(xs, 200, 9)
        assert got[k][0] == want[0] and all(abs(a - b) <= 1.000001e-6 for a, b in zip(got[k][1:], want[1:], strict=True)), k


def test_rank_correlation_of_counts_equals_that_of_average_ranks(spark):
    from spanloom.operators.learning import rank_correlation
    from spanloom.plans.dialect import Relational

    r = random.Random(1)
    rows = [(k, float(r.randint(0, 5)), r.choice([r.gauss(0, 1), round(r.gauss(0, 1), 1)])) for k in "abc" for _ in range(120)]
    rows += [("flat", 1.0, r.random()) for _ in range(9)] + [("one", 3.0, -2.5)]

    def rho(pairs):
        ranks = [[sorted(v).index(x) + (v.count(x) - 1) / 2 for x in v] for v in map(list, zip(*pairs, strict=True))]
        mean = (len(pairs) - 1) / 2
        a, b = ([x - mean for x in v] for v in ranks)
        spread = sum(x * x for x in a) * sum(x * x for x in b)
        return sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(spread) if spread else 0.0

    spark.createDataFrame(rows, "signal string, x double, y double").createOrReplaceTempView("ranked_pairs")
    got = {x.signal: (x.n, x.rho) for x in Relational(rank_correlation("SELECT * FROM ranked_pairs"), {})(spark).collect()}
    for k in ("a", "b", "c", "flat", "one"):
        own = [(x, y) for s, x, y in rows if s == k]
        assert got[k][0] == len(own) and abs(got[k][1] - rho(own)) < 1e-12
