"""Pools, rankings and how good they are."""

from spanloom.operators.learning import rank_correlation



def _fixed(x: str) -> str:
    """A number with two decimals, half away from zero."""
    whole = f"floor(abs({x}) * 100 + 5e-1)"
    return f"concat(CASE WHEN {x} < 0 THEN '-' ELSE '' END, STR(I(floor({whole} / 100))), '.', lpad(STR(I({whole} - floor({whole} / 100) * 100)), 2, '0'))"


_TOP = "SELECT src, id, score, s, e, pos FROM {ranked} r WHERE pos <= 25"

OPERATORS = {
    "rank_top_pool": "SELECT src, id, R6(score) AS score, I(pos) AS pos FROM (" + _TOP + ") a",  # F1, F5, E23
    # Those with a rank first, then by score
    "rank_final_order": """
        SELECT src, id, I(row_number() OVER (PARTITION BY src ORDER BY CASE WHEN r IS NULL THEN 1 ELSE 0 END, r, score DESC, id)) AS place FROM (
          SELECT c.src, c.id, c.score, m.r FROM {candidates} c LEFT JOIN (SELECT src, cid, row_number() OVER (PARTITION BY src ORDER BY max(cover) DESC, cid) AS r FROM {matches} x GROUP BY src, cid) m ON c.src = m.src AND c.id = m.cid) a""",
    # the items with the best performance
    "rank_audience": "SELECT id, channel, R6(perf) AS perf FROM {perf} p ORDER BY p.perf DESC, id LIMIT 20",
    # the best 12 and the worst 8
    "rank_examples": """
        SELECT channel, id, R6(perf) AS perf FROM (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY perf DESC, id) AS a, row_number() OVER (PARTITION BY channel ORDER BY perf, id DESC) AS b FROM {perf} p) x WHERE a <= 12 OR b <= 8""",
    # Valid picks once in their order, then the rest by score
    "rank_complete": """
        WITH picks AS (SELECT src, id, min(k) AS k FROM (SELECT src, CASE WHEN id % 4 = 0 THEN -id ELSE id END AS id, row_number() OVER (PARTITION BY src ORDER BY s) AS k FROM {candidates} c WHERE id % 3 = 0) a GROUP BY src, id)
        SELECT c.src, c.id, I(row_number() OVER (PARTITION BY c.src ORDER BY CASE WHEN p.k IS NULL THEN 1 ELSE 0 END, p.k, c.score DESC, c.s, c.id)) AS place FROM {candidates} c LEFT JOIN picks p ON c.src = p.src AND c.id = p.id""",
    # F8: of each fold the first source with a transcript: settled ones, then those not known, then young ones
    "rank_pilots": "SELECT fold, src FROM (SELECT fold, f.src, row_number() OVER (PARTITION BY fold ORDER BY CASE WHEN young THEN 2 WHEN young IS NULL THEN 1 ELSE 0 END, f.src) AS r FROM {folds} f JOIN (SELECT doc_id FROM {documents} WHERE length(text) > 0) d ON f.src = d.doc_id LEFT JOIN {young} y ON f.src = y.src) a WHERE r = 1",
    # A candidate as a line
    "rank_candidate_lines": """
        SELECT r.src, r.id, concat(STR(r.id), ' | ', STR(I(floor(floor(greatest(0e0, e - s) + 5e-1) / 60))), ':', lpad(STR(I(floor(greatest(0e0, e - s) + 5e-1) - floor(floor(greatest(0e0, e - s) + 5e-1) / 60) * 60)), 2, '0'), ' | ', STR(I(floor(composite + 5e-1))), '/10') AS line
        FROM {ranked} r JOIN {judged} j ON r.src = j.src AND r.id = j.id""",
    # What a creator's audience liked best, as lines of a prompt
    "rank_audience_block": f"""
        SELECT creator, concat('What this channel''s audience responded to most (official Shorts, by performance vs channel median):', chr(10), TEXTAGG(concat('- "', title, '" (perf ', {_fixed("y")}, ' vs channel median)'), r, chr(10)), chr(10), chr(10)) AS block
        FROM (SELECT creator, concat('Short ', STR(id)) AS title, y, row_number() OVER (PARTITION BY creator ORDER BY y DESC, id) AS r FROM {{outcomes}} o) a WHERE r <= 10 GROUP BY creator""",
    # An item as an example of what did well or badly
    "rank_example_blocks": f"""
        SELECT o.id, concat('### ', STR(o.id), ' perf=', CASE WHEN y >= 0 THEN '+' ELSE '' END, {_fixed("y")}, ' dur=', STR(I(floor(dur + 5e-1))), 's coldOpen=', CASE WHEN cold = 1 THEN 'true' ELSE 'false' END, ' tightened=', CASE WHEN tightened = 1 THEN 'true' ELSE 'false' END,
          ' startsAfterPause=', CASE WHEN paused = 1 THEN 'true' ELSE 'false' END, chr(10), 'SHORT: ', coalesce(d.text, '')) AS block FROM {{outcomes}} o JOIN {{documents}} d ON o.id = d.doc_id""",
    # the base variant first
    "rank_variants": "SELECT kind, count(*) AS n, I(row_number() OVER (ORDER BY CASE WHEN kind = 'view' THEN 0 ELSE 1 END, kind)) AS place FROM {spans} a GROUP BY kind",
    # batches of 200
    "rank_batches": "SELECT batch, count(*) AS n, min(id) AS first FROM (SELECT id, I(floor((row_number() OVER (PARTITION BY creator ORDER BY id) - 1) / 2e2)) AS batch FROM {clips} c) a GROUP BY batch",
    # Folds by hash of the id, and what each has; none is left out for having nothing
    "bench_folds": """
        SELECT k.fold, count(f.src) AS sources, I(coalesce(sum(n), 0)) AS moments, I(coalesce(sum(CASE WHEN young THEN 1 ELSE 0 END), 0)) AS young, I(sum(CASE WHEN f.src IS NOT NULL AND n IS NULL THEN 1 ELSE 0 END)) AS missing, R6(PCT(density, 0.5e0)) AS density
        FROM (SELECT 0 AS fold UNION ALL SELECT 1 UNION ALL SELECT 2) k LEFT JOIN {folds} f ON f.fold = k.fold LEFT JOIN (SELECT src, count(*) AS n FROM {moments} m GROUP BY src) m ON f.src = m.src LEFT JOIN {young} y ON f.src = y.src
        LEFT JOIN (SELECT src, density FROM {transcript_stats} t) t ON f.src = t.src GROUP BY k.fold""",
    # Sources out of each fold
    "bench_out_of_fold": "SELECT k.fold AS held, f.src FROM {folds} f JOIN (SELECT DISTINCT fold FROM {folds} g) k ON f.fold <> k.fold",
    # What each fold holds out
    "bench_held_out": "SELECT fold, m.src, m.id FROM {moments} m JOIN {folds} f ON m.src = f.src",
    # Grades and gains
    "bench_grades": "SELECT src, id, I(grade) AS grade, I(power(2, grade) - 1) AS gain FROM {graded} g",
    # Precision and recall in the first six, and the place of the first hit in the whole list
    "bench_precision": """
        SELECT r.src, R6(sum(CASE WHEN pos <= 6 AND m.cid IS NOT NULL THEN 1e0 ELSE 0e0 END) / sum(CASE WHEN pos <= 6 THEN 1e0 ELSE 0e0 END)) AS precision_at, R6(coalesce(1e0 / min(CASE WHEN m.cid IS NOT NULL THEN pos END), 0e0)) AS mrr
        FROM {ranked} r LEFT JOIN (SELECT DISTINCT src, cid FROM {matches} x) m ON r.src = m.src AND r.id = m.cid GROUP BY r.src""",
    # Ideal gain of all moments
    "bench_ideal": "SELECT src, R6(sum((power(2, grade) - 1) / LOG2(r + 1e0))) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY grade DESC, id) AS r FROM {graded} g) a WHERE r <= 6 GROUP BY src",
    # I4: moments that any candidate reaches
    "bench_pool_recall": "SELECT m.src, R6(count(DISTINCT x.mid) / (count(DISTINCT m.id) * 1e0)) AS pool_recall FROM {moments} m LEFT JOIN {matches} x ON m.src = x.src GROUP BY m.src",
    # Per signal the rank correlation with the most gain of a moment that a candidate matches, 0 without any
    "bench_signals": f"SELECT signal, R6(rho) AS rho, n FROM ({rank_correlation('SELECT signal, x, y FROM {credited} s')}) z",
    # One row a source, a column a variant
    "bench_matrix": "SELECT src, " + ", ".join(f"R6(avg(CASE WHEN kind = '{k}' THEN score END)) AS m_{k}" for k in ("click", "error", "purchase", "signup", "view")) + " FROM {spans} s GROUP BY src",
    # Moments of a source with grades, its fold, and whether it is young
    "bench_dataset": """
        SELECT g.src, fold, young, count(*) AS moments, I(sum(CASE WHEN grade = 3 THEN 1 ELSE 0 END)) AS top_grade, I(sum(CASE WHEN perf IS NULL THEN 1 ELSE 0 END)) AS without_perf FROM {graded} g JOIN {folds} f ON g.src = f.src
        LEFT JOIN {young} y ON g.src = y.src GROUP BY g.src, fold, young""",
    # And the moments themselves, which are what is held out of their fold; those without segments aren't there
    "bench_dataset_items": """
        SELECT g.src, fold, young, g.id AS mid, grade, R6(g.perf) AS perf, I(segments) AS segments FROM {graded} g JOIN {folds} f ON g.src = f.src JOIN (SELECT src, mid, count(*) AS segments FROM {segments} s GROUP BY src, mid) k ON g.src = k.src AND g.id = k.mid
        LEFT JOIN {young} y ON g.src = y.src""",
    # I16: calls go on as long as what went before is under the cap; cached ones cost nothing and always go on
    "bench_budget": """
        SELECT purpose, id, R6(spent) AS spent, cached FROM (SELECT purpose, id, cached, coalesce(sum(CASE WHEN cached THEN 0e0 ELSE cost END) OVER (PARTITION BY purpose ORDER BY since, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS spent FROM {ledger} l) a
        WHERE cached OR spent < 100""",
    # Figures of the pools
    "bench_pools": "SELECT R6(avg(n)) AS mean_size, R6(sum(total)) AS score, R6(avg(dur)) AS dur FROM (SELECT src, count(*) * 1e0 AS n, sum(score) AS total, sum(e - s) AS dur FROM {ranked} r WHERE pos <= 25 GROUP BY src) a",
    # What was proposed twice; selection.assert_unique fails on it
    "rank_duplicates": "SELECT src, sid, count(*) AS n FROM {openings} o GROUP BY src, sid HAVING count(*) > 1",
    # Distinct sources; the last of equal ids with the place of the first
    "rank_last_wins": "SELECT k, id, first FROM (SELECT id % 700 AS k, id, min(id) OVER (PARTITION BY id % 700) AS first, row_number() OVER (PARTITION BY id % 700 ORDER BY id DESC) AS r FROM {spans} s) a WHERE r = 1",
    # C20: newest listing without what is there already, long ones only
    "rank_scout": "SELECT l.channel, l.id FROM (SELECT channel, id, row_number() OVER (PARTITION BY channel ORDER BY since DESC, id) AS r FROM {listing} x WHERE dur >= 900 AND NOT EXISTS (SELECT 1 FROM {lineitem} y WHERE y.l_orderkey = x.id AND y.l_returnflag = 'R')) l WHERE r <= 5",
    # What is to be resumed
    "rank_resume": "SELECT a.id, b.status FROM {clips} a LEFT JOIN (SELECT id, status FROM {clips} x WHERE quality = 0) b ON a.id = b.id WHERE b.status IS NULL OR b.status NOT IN ('approved', 'published')",
    # Ids by hash, and weighted means of signals
    "rank_composite": "SELECT id, concat('cand_', substr(sha1(concat(STR(id), ':', status)), 1, 8)) AS cand, floor((hook * 3 + payoff + clarity + emotion + novelty + pace + fit) / 9e0 * 100 + 5e-1) / 1e2 AS composite FROM {clips} c",
    # Points off for visual faults, which are named; what a vision check found takes up to three more; a candidate under five
    # loses .4 of its composite for each point that is missing
    "rank_visual_score": """
        SELECT src, id, v AS score, issues, CASE WHEN v < 5 THEN floor((composite - (5 - v) * 4e-1) * 100 + 5e-1) / 1e2 ELSE composite END AS composite FROM (
          SELECT f.src, p.id, p.composite, issues, greatest(0e0, greatest(0e0, points) - least(3, found)) AS v FROM (
            SELECT src, 10e0 - CASE WHEN coverage < 6e-1 THEN 3 ELSE 0 END - CASE WHEN fit_ratio > 4e-1 THEN 2 ELSE 0 END - CASE WHEN no_face > 8 THEN 2 ELSE 0 END - CASE WHEN cuts_per_min > 20 THEN 1 ELSE 0 END - CASE WHEN median_h < 12e-2 THEN 1 ELSE 0 END AS points,
              concat_ws(',', CASE WHEN coverage < 6e-1 THEN 'few faces' END, CASE WHEN fit_ratio > 4e-1 THEN 'no subject' END, CASE WHEN no_face > 8 THEN 'long without face' END, CASE WHEN cuts_per_min > 20 THEN 'jittery' END, CASE WHEN median_h < 12e-2 THEN 'small' END) AS issues
            FROM {visual_figures} g) f JOIN {judged} p ON f.src = p.src) x""",
    # Valid ranges in the band of lengths
    "rank_valid": "SELECT src, id FROM {candidates} c WHERE e - s BETWEEN 85e-2 * 20 AND 115e-2 * 1200 AND s >= 0 AND s <= e",
    # hooks of 1 to 70 characters when trimmed, by falling score, equal ones in their order
    "rank_hooks": "SELECT src, p, hook, I(row_number() OVER (PARTITION BY src ORDER BY score DESC, p)) AS place FROM (SELECT src, p, trim(hook) AS hook, score FROM {hooks} x) y WHERE length(hook) BETWEEN 1 AND 70",
    # new listings of a channel in their order, the first so many
    "rank_new": "SELECT channel, id, I(r) AS place FROM (SELECT channel, id, row_number() OVER (PARTITION BY channel ORDER BY id) AS r FROM {listing} x WHERE dur >= 930 AND NOT EXISTS (SELECT 1 FROM {lineitem} y WHERE y.l_orderkey = x.id AND y.l_returnflag = 'R')) z WHERE r <= 3",
    # A cold open is a sentence after the clip's first and up to its last, 1.5 to 7 seconds long; else none
    "rank_cold_open": """
        SELECT o.src, o.id, CASE WHEN o.sid > o.a AND o.sid <= o.b AND s.e - s.s BETWEEN 15e-1 AND 7e0 THEN o.sid END AS cold_open FROM {openings} o LEFT JOIN {sentences} s ON o.src = s.src AND o.sid = s.id""",
}
