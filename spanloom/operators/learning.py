"""Performance of a listing, outcomes, weights and findings."""


def rank_correlation(pairs: str) -> str:
    """signal, n, rho of pairs (signal, x, y): the correlation of average ranks, 0 without any spread.

    Ranks come from counts: how often each value is there, and sums of those before it, less their mean, which is known. What is sorted for a signal are its distinct
    x, and hundredths of y, which say where the distinct y of a hundredth begin; never a signal's rows."""
    return f"""
          WITH g AS (SELECT signal, x, y, floor(y * 1e2) AS part, count(*) AS c FROM ({pairs}) j GROUP BY signal, x, y),
          a AS (SELECT signal, x, sum(c) OVER (PARTITION BY signal ORDER BY x) - (c - 1) / 2e0 - (sum(c) OVER (PARTITION BY signal) + 1) / 2e0 AS a FROM (SELECT signal, x, sum(c) AS c FROM g GROUP BY signal, x) h),
          p AS (SELECT signal, part, sum(c) OVER (PARTITION BY signal ORDER BY part) - c - (sum(c) OVER (PARTITION BY signal) + 1) / 2e0 AS before FROM (SELECT signal, part, sum(c) AS c FROM g GROUP BY signal, part) h),
          b AS (SELECT h.signal, h.y, before + sum(c) OVER (PARTITION BY h.signal, h.part ORDER BY y) - (c - 1) / 2e0 AS b FROM (SELECT signal, part, y, sum(c) AS c FROM g GROUP BY signal, part, y) h JOIN p ON p.signal = h.signal AND p.part = h.part)
          SELECT g.signal, I(sum(c)) AS n, coalesce(DIV(sum(c * a * b), sqrt(sum(c * a * a) * sum(c * b * b))), 0e0) AS rho FROM g JOIN a ON a.signal = g.signal AND a.x = g.x JOIN b ON b.signal = g.signal AND b.y = g.y GROUP BY g.signal"""


OPERATORS = {
    "mine_perf": "SELECT id, channel, R6(perf) AS perf FROM {perf} p",  # D3, C2, H20
    # Quartiles, the rate of cold opens in all and in the best third, and those of tightened ones and of those that start after a pause
    "learn_stats": """
        SELECT creator, count(*) AS n, R6(PCT(dur, 0.25e0)) AS q1, R6(PCT(dur, 0.5e0)) AS q2, R6(PCT(dur, 0.75e0)) AS q3, R6(avg(cold)) AS cold_rate, R6(avg(tightened)) AS tightened_rate, R6(avg(paused)) AS pause_rate,
          R6(avg(CASE WHEN r > floor(2 * n / 3e0) THEN cold * 1e0 END)) AS top_cold_rate FROM (
          SELECT creator, dur, cold, tightened, paused, row_number() OVER (PARTITION BY creator ORDER BY y, id) AS r, count(*) OVER (PARTITION BY creator) AS n FROM {outcomes} o) a GROUP BY creator""",
    "learn_median": "SELECT channel, R6(coalesce(PCT(CASE WHEN views > 0 THEN views END, 0.5e0), 0e0)) AS med FROM {listing} l GROUP BY channel",  # D1
    "learn_outcomes": "SELECT id, R6(y) AS y FROM {outcomes} o",  # D15, D12
    # Rank correlation of each signal with the outcome, and the weight that it gives
    "learn_weights": f"""
        SELECT signal, n, R6(rho) AS rho, CASE WHEN n < 8 THEN 1e0 ELSE R6(least(3e0, greatest(25e-2, 1 + 2 * rho * n / (n + 20)))) END AS weight FROM (
          {rank_correlation("SELECT s.signal, s.x, R6(o.y) AS y FROM {signals} s JOIN {outcomes} o ON s.id = o.id")}) l""",
    # Means by feature and value, three of each at least
    "learn_buckets": "SELECT feature, v, n, R6(mean_y) AS mean_y FROM {buckets} b",
    # Buckets of five or more whose mean is .3 or more off, as a line
    "learn_findings": """
        SELECT feature, v, n, R6(mean_y) AS mean_y, concat(CASE feature WHEN 'coldOpen' THEN CASE v WHEN 'yes' THEN 'Clips with cold opens' ELSE 'Clips without cold opens' END WHEN 'duration' THEN concat('Clips ', v, 's')
          WHEN 'hookPattern' THEN concat('Clips with the "', v, '" hook pattern') ELSE concat('Clips with "', v, '" layout') END, ': ', CASE WHEN mean_y >= 0 THEN '+' ELSE '-' END,
          STR(I(floor(floor(abs(mean_y) * 100 + 5e-1) / 100))), '.', lpad(STR(I(floor(abs(mean_y) * 100 + 5e-1) - floor(floor(abs(mean_y) * 100 + 5e-1) / 100) * 100)), 2, '0'), ' vs median (n=', STR(n), ')') AS line
        FROM {buckets} b WHERE n >= 5 AND abs(mean_y) >= 3e-1""",
    "learn_latest": "SELECT src, ARGMAX(id, s) AS id, R6(max(s)) AS s FROM {spans} a GROUP BY src",  # E8
    # the last 20 reviews
    "learn_reviews": "SELECT creator, id, CASE WHEN quality = 1 THEN 1 ELSE -1 END * 1e0 AS y FROM (SELECT *, row_number() OVER (PARTITION BY creator ORDER BY hours, id DESC) AS r FROM {clips} c) a WHERE r <= 20",
    # Flags of several segments of one item
    "learn_segment_flags": """
        SELECT src, count(*) AS n, R6(max(e) - min(s)) AS span, max(e) - min(s) - sum(e - s) > 2 OR count(*) >= 3 AS tightened, max(CASE WHEN r = 1 THEN s END) > max(CASE WHEN r = 2 THEN s END) + 1 AS cold_open FROM (
          SELECT src, s, e, row_number() OVER (PARTITION BY src ORDER BY id) AS r FROM {moments} m) a GROUP BY src""",
    # Titles from the first of two lists that knows the id, else a name made of it
    "learn_titles": """
        SELECT o.o_orderkey AS id, coalesce(c.c_name, n.n_name, concat('Short ', STR(o.o_orderkey))) AS title FROM {orders} o LEFT JOIN (SELECT * FROM {customer} WHERE c_acctbal > 0) c ON o.o_custkey = c.c_custkey
        LEFT JOIN {customer} k ON o.o_custkey = k.c_custkey LEFT JOIN (SELECT * FROM {nation} WHERE n_regionkey < 3) n ON k.c_nationkey = n.n_nationkey""",
    "learn_young": "SELECT id, (now - since) / 864e2 < 700 AS young FROM {listing} l, {now} n",  # H20, I14
    # Long ones only
    "learn_long": "SELECT channel, count(*) AS n FROM {listing} l WHERE dur >= 900 AND views > 0 GROUP BY channel",
    # Of equal ids the first with a date
    "learn_first_dated": "SELECT k, id FROM (SELECT o_orderkey % 400 AS k, o_orderkey AS id, row_number() OVER (PARTITION BY o_orderkey % 400 ORDER BY CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END, o_orderkey) AS r FROM {orders}) a WHERE r = 1",
}
