"""Figures of rankings against official moments: metrics of an episode, their intervals, and what a variant must pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.operators import folds
from spanloom.operators.folds import _SIX_OF_MEAN, _ansi, _view, intervals, six
from spanloom.operators.weights import fit_weights, ranked_by, search
from spanloom.plans.durable import durable

# Names of metrics and of the base variant.
METRICS = ("ndcg_pool", "ndcg_all", "precision", "recall", "mrr", "pool_recall")
BASE = "V0"


def episode_metrics(rankings: DataFrame, matches: DataFrame, graded: DataFrame, k: int = 6) -> DataFrame:
    """rankings: key, src, id, pos (the whole pool in the key's order); matches: src, cid, mid, cover; graded: src, id, grade.

    key, src, n_official, n_matched, pool_recall, ndcg_pool (null where the pool reaches no moment), ndcg_all, precision, recall,
    mrr. A place credits one moment that was not credited: the one of most gain, then cover, then least id."""
    gains = graded.select("src", F.col("id").alias("mid"), (F.pow(F.lit(2.0), F.col("grade")) - 1).alias("gain"))
    hits = rankings.join(matches.select("src", F.col("cid").alias("id"), "mid", "cover"), ["src", "id"]).join(gains, ["src", "mid"])
    top = F.col("pos") <= k
    counts = hits.groupBy("key", "src").agg(F.countDistinct("mid").alias("n_matched"), F.min("pos").alias("first"), F.countDistinct(F.when(top, F.col("pos"))).alias("relevant"), F.countDistinct(F.when(top, F.col("mid"))).alias("found"))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("gain")).alias("g"), (-F.col("cover")).alias("c"), "mid")))
    places = hits.filter(top).groupBy("key", "src", "pos").agg(listed.alias("ms")).groupBy("key", "src").agg(F.array_sort(F.collect_list(F.struct("pos", "ms"))).alias("xs"))
    pick = "get(filter(x.ms, m -> not array_contains(acc.done, m.mid)), 0)"
    start = "named_struct('done', cast(array() as array<bigint>), 'dcg', 0D)"
    fold = f"aggregate(xs, {start}, (acc, x) -> if({pick} is null, acc, named_struct('done', array_append(acc.done, {pick}.mid), 'dcg', acc.dcg - {pick}.g / log2(x.pos + 1)))).dcg"
    dcg = places.select("key", "src", F.expr(fold).alias("dcg"))
    pool = _ideal(hits.select("key", "src", "mid", "gain").distinct(), ["key", "src"], k, "ideal_pool")
    every = _ideal(gains, ["src"], k, "ideal_all").join(gains.groupBy("src").agg(F.count("*").alias("n_official")), "src")
    out = rankings.groupBy("key", "src").agg(F.count("*").alias("n")).join(every, "src", "left")
    for part in (counts, dcg, pool):
        out = out.join(part, ["key", "src"], "left")
    share = lambda x, n: six(F.coalesce(F.try_divide(F.coalesce(x, F.lit(0)), n), F.lit(0.0)))
    got, official = F.coalesce("dcg", F.lit(0.0)), F.coalesce("n_official", F.lit(0))
    return out.select(
        "key", "src", official.alias("n_official"), F.coalesce("n_matched", F.lit(0)).alias("n_matched"), share(F.col("n_matched"), official).alias("pool_recall"),
        six(F.when(F.col("ideal_pool") > 0, got / F.col("ideal_pool"))).alias("ndcg_pool"), six(F.when(F.col("ideal_all") > 0, got / F.col("ideal_all")).otherwise(0.0)).alias("ndcg_all"),
        share(F.col("relevant"), F.least(F.lit(k), F.col("n"))).alias("precision"), share(F.col("found"), official).alias("recall"), six(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"),
    )


def _ideal(gains: DataFrame, by: list[str], k: int, name: str) -> DataFrame:
    """by and the DCG of the k largest gains in order."""
    r = gains.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(F.col("gain").desc(), "mid")))
    return r.filter(F.col("r") <= k).groupBy(*by).agg(F.sum(F.col("gain") / F.log2(F.col("r") + 1)).alias(name))


def paired(a: DataFrame, b: DataFrame) -> DataFrame:
    """a, b: src, x. src, x: differences where both have a value. Episodes that only one of them was scored on are an error."""
    both = a.select("src", F.col("x").alias("a"), F.lit(1).alias("_a")).join(b.select("src", F.col("x").alias("b"), F.lit(1).alias("_b")), "src", "full")
    alike = F.when(F.col("_a").isNull() | F.col("_b").isNull(), F.raise_error(F.lit("both variants must be scored on the same episodes"))).otherwise(F.col("a") - F.col("b"))
    return both.select("src", alike.alias("x")).filter("x is not null")


def long_metrics(metrics: DataFrame) -> DataFrame:
    """key, src, metric, x: a row a metric."""
    return metrics.select("key", "src", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("x")) for m in METRICS))).alias("v")).select("key", "src", "v.metric", "v.x")


def variants(metrics: DataFrame, runs: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """key, metric, n, mean, lo, hi, cost, ms: a row a variant and metric, nulls skipped; cost and ms of a run on the mean.

    runs: key, src, cost, ms. more: metrics of a synthetic variant (a random order), which has no runs."""
    every = durable(metrics if more is None else metrics.unionByName(more.select(metrics.columns)))
    spent = runs.groupBy("key").agg(six(F.avg("cost")).alias("cost"), six(F.avg("ms")).alias("ms"))
    zero = [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("cost", "ms")]
    return intervals(long_metrics(every), ["key", "metric"]).join(spent, "key", "left").select("key", "metric", "n", "mean", "lo", "hi", *zero)


def comparisons(metrics: DataFrame, runs: DataFrame, young: DataFrame, dear: float = 1.5) -> DataFrame:
    """Of each variant but the base and its repeats (base@...): the paired differences from the base of ndcg_pool, recall and
    ndcg_pool on settled episodes (d_*: n, mean, lo, hi), cost_ratio, noise (the most that a repeat's mean differs from the
    base's by, null without repeats), the four checks and promote, which is all of them.

    young: src, young. Episodes that one of the two lacks are skipped, as are null figures."""
    x = durable(long_metrics(metrics).filter("metric in ('ndcg_pool', 'recall')"))
    base = x.filter(F.col("key") == BASE).select("src", "metric", F.col("x").alias("base"))
    diffs = x.filter(F.col("key") != BASE).join(base, ["src", "metric"], "left").withColumn("x", F.col("x") - F.col("base")).drop("base")
    settled = diffs.filter("metric = 'ndcg_pool'").join(young, "src", "left").filter("young is null or not young").select("key", "src", F.lit("settled").alias("metric"), "x")
    repeats = F.col("key").startswith(f"{BASE}@")
    noise = diffs.filter(repeats & (F.col("metric") == "ndcg_pool")).groupBy("key").agg(F.avg("x").alias("m")).agg(six(F.max(F.abs("m"))).alias("noise"))
    found = intervals(diffs.unionByName(settled).filter(~repeats), ["key", "metric"])
    own = found.groupBy("key").agg(*(F.max(F.when(F.col("metric") == m, F.col(c))).alias(f"d_{m}_{c}") for m in ("ndcg_pool", "recall", "settled") for c in ("n", "mean", "lo", "hi")))
    cost = runs.groupBy("key").agg(F.avg("cost").alias("c"))
    first = cost.filter(F.col("key") == BASE).select(F.col("c").alias("base_cost"))
    own = own.join(cost, "key", "left").join(F.broadcast(first), F.lit(True), "left").join(F.broadcast(noise), F.lit(True), "left")  # one row each
    own = own.withColumn("cost_ratio", six(F.when(F.col("base_cost") > 0, F.coalesce("c", F.lit(0.0)) / F.col("base_cost")))).drop("c", "base_cost")
    no = F.lit(False)
    checks = {
        "beats_base": F.coalesce((F.col("d_ndcg_pool_lo") > 0) & (F.col("d_ndcg_pool_mean") > F.coalesce("noise", F.lit(0.0))), no),
        "recall_not_worse": F.coalesce(F.col("d_recall_hi") >= 0, no),
        "holds_on_settled": F.coalesce(F.col("d_settled_lo") > 0, no),
        "cost_ok": F.coalesce(F.col("cost_ratio") <= dear, F.lit(True)),
    }
    own = own.select("*", *(c.alias(k) for k, c in checks.items()))
    return own.withColumn("promote", F.expr(" and ".join(checks)))


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    return episode_metrics(*(durable(_view(v, spark, d)) for v in ("rankings", "matches", "graded")))


def _random(spark: SparkSession, d: str) -> DataFrame:
    return folds.random_baseline(_view("ranked", spark, d), _view("matches", spark, d), _view("graded", spark, d)).withColumn("key", F.lit("B-rand"))


def _taught(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return _view("pool_signals", spark, d), _view("matches", spark, d), _view("graded", spark, d)


QUERIES = {
    "bench_metrics": _metrics,  # I1-I4, D23
    "bench_variants": lambda s, d: variants(_metrics(s, d), _view("runs", s, d)),  # D30, D27, D26
    "bench_variants_random": lambda s, d: variants(_metrics(s, d).filter("key = 'V0'"), _view("runs", s, d), _random(s, d)),  # D30 with I5
    "bench_comparisons": lambda s, d: comparisons(_metrics(s, d), _view("runs", s, d), _view("young", s, d)),  # I7, I10, I11, I14
    "bench_weights": lambda s, d: fit_weights(*_taught(s, d)),  # I8
    "bench_weights_held_out": lambda s, d: fit_weights(*_taught(s, d), leave_out=True),  # I9
    "bench_ranked_held_out": lambda s, d: ranked_by(_view("pool_signals", s, d), search(*_taught(s, d), leave_out=True)),  # I9
}

_SIX = "floor(({0}) * 1e6 + 0.5) / 1e6"
_IMUL = "(({0}) * ({1}) % 4294967296)"
_T1 = _IMUL.format("xor(a, a >> 15)", "a | 1")
_T2 = "xor((t + " + _IMUL.format("xor(t, t >> 7)", "t | 61") + ") % 4294967296, t)"

_SQL_METRICS = f"""graded AS MATERIALIZED ({_ansi("graded")}), rankings AS MATERIALIZED ({_ansi("rankings")}), matches AS MATERIALIZED ({_ansi("matches")}),
h AS MATERIALIZED (SELECT r.key, r.src, r.pos, m.mid, power(2, grade) - 1 AS gain, cover FROM matches m JOIN graded g ON g.src = m.src AND g.id = m.mid JOIN rankings r ON r.src = m.src AND r.id = m.cid),
p AS MATERIALIZED (SELECT key, src, pos, list({{'gain': gain, 'mid': mid}} ORDER BY gain DESC, cover DESC, mid) AS ms FROM h WHERE pos <= 6 GROUP BY key, src, pos),
f AS (SELECT DISTINCT key, src, 0::BIGINT AS pos, []::BIGINT[] AS done, 0e0 AS dcg FROM rankings
  UNION ALL SELECT key, src, pos, CASE WHEN x IS NULL THEN done ELSE list_append(done, x.mid) END, CASE WHEN x IS NULL THEN dcg ELSE dcg + x.gain / log2(pos + 1) END
  FROM (SELECT f.key, f.src, f.pos + 1 AS pos, done, dcg, list_filter(p.ms, lambda m: NOT list_contains(done, m.mid))[1] AS x FROM f LEFT JOIN p ON p.key = f.key AND p.src = f.src AND p.pos = f.pos + 1 WHERE f.pos < 6)),
ip AS (SELECT key, src, sum(gain / log2(r + 1)) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY key, src ORDER BY gain DESC, mid) AS r FROM (SELECT DISTINCT key, src, mid, gain FROM h)) WHERE r <= 6 GROUP BY key, src),
ia AS (SELECT src, sum(CASE WHEN r <= 6 THEN (power(2, grade) - 1) / log2(r + 1) END) AS ideal, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY grade DESC, id) AS r FROM graded) GROUP BY src),
c AS (SELECT key, src, count(DISTINCT mid) AS reached, min(pos) AS first, count(DISTINCT CASE WHEN pos <= 6 THEN pos END) AS relevant, count(DISTINCT CASE WHEN pos <= 6 THEN mid END) AS found FROM h GROUP BY key, src),
metrics AS MATERIALIZED (
  SELECT f.key, f.src, coalesce(ia.n, 0) AS n_official, coalesce(reached, 0) AS n_matched, {_SIX.format("coalesce(reached / ia.n, 0e0)")} AS pool_recall, {_SIX.format("CASE WHEN ip.ideal > 0 THEN dcg / ip.ideal END")} AS ndcg_pool,
    {_SIX.format("CASE WHEN ia.ideal > 0 THEN dcg / ia.ideal ELSE 0 END")} AS ndcg_all, {_SIX.format("coalesce(relevant, 0) / least(6, z.n)")} AS precision, {_SIX.format("coalesce(found / ia.n, 0e0)")} AS recall, {_SIX.format("coalesce(1 / first, 0e0)")} AS mrr
  FROM (SELECT * FROM f WHERE pos = 6) f JOIN (SELECT key, src, count(*) AS n FROM rankings GROUP BY key, src) z ON z.key = f.key AND z.src = f.src
  LEFT JOIN ia ON ia.src = f.src LEFT JOIN ip ON ip.key = f.key AND ip.src = f.src LEFT JOIN c ON c.key = f.key AND c.src = f.src)"""

#: From v (k, src, x without nulls): b (k, n, mean, lo, hi) by 10,000 resampled means of the generator's stream.
_SQL_INTERVALS = f"""
w AS MATERIALIZED (SELECT k, row_number() OVER (PARTITION BY k ORDER BY src) - 1 AS i, count(*) OVER (PARTITION BY k) AS n, x FROM v),
n AS MATERIALIZED (SELECT k, max(n) AS n, avg(x) AS mean FROM w GROUP BY k),
u AS MATERIALIZED (SELECT n, it, q, ((1 + (it * n + q + 1)::UBIGINT * 1831565813) % 4294967296)::UBIGINT AS a FROM (SELECT DISTINCT n FROM n), range(10000) r(it), unnest(range(n)) t(q)),
d AS MATERIALIZED (SELECT n, it, floor(xor(t, t >> 14) / 4294967296e0 * n)::BIGINT AS i FROM (SELECT n, it, {_T2} AS t FROM (SELECT n, it, {_T1} AS t FROM u))),
m AS (SELECT k, m, row_number() OVER (PARTITION BY k ORDER BY m) AS r FROM (SELECT w.k, it, avg(x) AS m FROM d JOIN w ON w.n = d.n AND w.i = d.i GROUP BY w.k, it)),
b AS MATERIALIZED (SELECT n.k, n.n, {_SIX_OF_MEAN.format("mean")} AS mean, {_SIX_OF_MEAN.format("least(lo, mean)")} AS lo, {_SIX_OF_MEAN.format("greatest(hi, mean)")} AS hi
  FROM n JOIN (SELECT k, min(CASE WHEN r = 251 THEN m END) AS lo, min(CASE WHEN r = 9750 THEN m END) AS hi FROM m GROUP BY k) q ON n.k = q.k)"""
_SQL_LONG = "(" + " UNION ALL ".join(f"SELECT key, src, '{m}' AS metric, {m} AS x FROM metrics" for m in METRICS) + ")"

ORACLE = {
    "bench_metrics": f"WITH RECURSIVE {_SQL_METRICS} SELECT * FROM metrics",
    "bench_variants": f"""
WITH RECURSIVE {_SQL_METRICS}, v AS MATERIALIZED (SELECT key || '/' || metric AS k, src, x FROM {_SQL_LONG} WHERE x IS NOT NULL), {_SQL_INTERVALS},
s AS (SELECT key, {_SIX.format("avg(cost)")} AS cost, {_SIX.format("avg(ms)")} AS ms FROM ({_ansi("runs")}) GROUP BY key)
SELECT split_part(k, '/', 1) AS key, split_part(k, '/', 2) AS metric, n, mean, lo, hi, coalesce(cost, 0) AS cost, coalesce(ms, 0) AS ms FROM b LEFT JOIN s ON s.key = split_part(k, '/', 1)""",
    "bench_comparisons": f"""
WITH RECURSIVE {_SQL_METRICS}, young AS ({_ansi("young")}),
df AS MATERIALIZED (SELECT l.key, l.src, l.metric, l.x - o.x AS x FROM {_SQL_LONG} l JOIN {_SQL_LONG} o ON o.key = 'V0' AND o.src = l.src AND o.metric = l.metric WHERE l.key <> 'V0' AND l.metric IN ('ndcg_pool', 'recall') AND l.x - o.x IS NOT NULL),
v AS MATERIALIZED (SELECT key || '/' || metric AS k, src, x FROM df WHERE NOT starts_with(key, 'V0@')
  UNION ALL SELECT key || '/settled', df.src, x FROM df LEFT JOIN young y ON y.src = df.src WHERE metric = 'ndcg_pool' AND NOT starts_with(key, 'V0@') AND NOT coalesce(young, false)), {_SQL_INTERVALS},
s AS (SELECT key, avg(cost) AS cost FROM ({_ansi("runs")}) GROUP BY key),
noise AS (SELECT {_SIX.format("max(abs(m))")} AS noise FROM (SELECT avg(x) AS m FROM df WHERE metric = 'ndcg_pool' AND starts_with(key, 'V0@') GROUP BY key)),
o AS (SELECT split_part(k, '/', 1) AS key, {", ".join(f"max(CASE WHEN split_part(k, '/', 2) = '{m}' THEN {c} END) AS d_{m}_{c}" for m in ("ndcg_pool", "recall", "settled") for c in ("n", "mean", "lo", "hi"))} FROM b GROUP BY 1),
a AS (SELECT o.*, noise, {_SIX.format("CASE WHEN z.cost > 0 THEN coalesce(s.cost, 0) / z.cost END")} AS cost_ratio FROM o LEFT JOIN s ON s.key = o.key, noise, (SELECT cost FROM s WHERE key = 'V0') z),
k AS (SELECT *, coalesce(d_ndcg_pool_lo > 0 AND d_ndcg_pool_mean > coalesce(noise, 0), false) AS beats_base, coalesce(d_recall_hi >= 0, false) AS recall_not_worse, coalesce(d_settled_lo > 0, false) AS holds_on_settled, coalesce(cost_ratio <= 1.5, true) AS cost_ok FROM a)
SELECT *, beats_base AND recall_not_worse AND holds_on_settled AND cost_ok AS promote FROM k""",
}
