"""Spans on a time line: overlap, coverage, nearest, merging, runs, splits."""

OPERATORS = {
    # Share of a moment that a candidate covers
    "span_coverage": "SELECT src, cid, mid, R6(cover) AS cover FROM {matches} o",
    # Share of a moment, as one span, that a candidate covers
    "span_overlap_ratio": "SELECT src, cid, mid, R6(cover) AS cover FROM {official_covers} o",
    # Of each moment the candidate that covers most of its one span, .3 at least, the first of equals
    "span_best_match": "SELECT src, mid, cid, R6(cover) AS cover FROM (SELECT *, row_number() OVER (PARTITION BY src, mid ORDER BY cover DESC, cid) AS r FROM {official_matches} o) a WHERE r = 1",
    # Candidates of the shortlist with a moment that they match
    "span_matched_candidates": "SELECT c.src, c.id FROM {shortlist} c WHERE EXISTS (SELECT 1 FROM {official_matches} m WHERE m.src = c.src AND m.cid = c.id)",
    # Recall over all candidates and precision over the shortlist; 0 without any in it
    "span_eval": """
        SELECT a.src, n, found, R6(found / (n * 1e0)) AS recall, R6(coalesce(hit / (listed * 1e0), 0e0)) AS precision FROM
          (SELECT m.src, count(*) AS n, I(sum(CASE WHEN k.mid IS NOT NULL THEN 1 ELSE 0 END)) AS found FROM {moments} m LEFT JOIN (SELECT DISTINCT src, mid FROM {official_matches} x) k ON m.src = k.src AND m.id = k.mid GROUP BY m.src) a
          LEFT JOIN (SELECT c.src, count(*) AS listed, I(sum(CASE WHEN k.cid IS NOT NULL THEN 1 ELSE 0 END)) AS hit FROM {shortlist} c LEFT JOIN (SELECT DISTINCT src, cid FROM {official_matches} x) k ON c.src = k.src AND c.id = k.cid GROUP BY c.src) b ON a.src = b.src""",
    # A row a moment: its performance (0 if unknown), its span, the candidate that matches it and whether that is in the shortlist
    "span_eval_rows": """
        SELECT m.src, m.id AS mid, R6(coalesce(m.perf, 0e0)) AS perf, R6(o.s) AS s, R6(o.e) AS e, b.cid, l.id IS NOT NULL AS shortlisted FROM {moments} m LEFT JOIN {official} o ON m.src = o.src AND m.id = o.mid
        LEFT JOIN (SELECT src, mid, cid FROM (SELECT *, row_number() OVER (PARTITION BY src, mid ORDER BY cover DESC, cid) AS r FROM {official_matches} y) a WHERE r = 1) b ON m.src = b.src AND m.id = b.mid
        LEFT JOIN {shortlist} l ON b.src = l.src AND b.cid = l.id""",
    # Pairs of one source with half of their union in common; they meet in the stretch of time where their overlap begins
    "span_iou": """
        SELECT * FROM (SELECT a.src, a.id AS a, b.id AS b, R6(greatest(0e0, least(a.e, b.e) - greatest(a.s, b.s)) / (greatest(a.e, b.e) - least(a.s, b.s))) AS iou
          FROM {candidate_bins} a JOIN {candidate_bins} b ON a.src = b.src AND a.bin = b.bin AND a.id < b.id AND a.s < b.e AND b.s < a.e WHERE a.bin = floor(greatest(a.s, b.s) / 36e2)) x WHERE iou >= 5e-1""",
    # Union of spans that overlap or touch
    "span_merge": """
        SELECT src, R6(min(s)) AS s, R6(max(e)) AS e, count(*) AS n FROM (
          SELECT *, sum(brk) OVER (PARTITION BY src ORDER BY s, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS isle FROM (
            SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY src ORDER BY s, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS brk FROM {spans} a) b) c GROUP BY src, isle""",
    # Longest run of samples without a face
    "span_longest_run": """
        SELECT src, max(n) AS longest, R6(max(len)) AS seconds FROM (
          SELECT src, count(*) AS n, max(t) - min(t) AS len FROM (
            SELECT src, t, faces, row_number() OVER (PARTITION BY src ORDER BY t) - row_number() OVER (PARTITION BY src, faces ORDER BY t) AS isle FROM {samples} a) b WHERE faces = 0 GROUP BY src, isle) c GROUP BY src""",
    # Shots clipped to a range
    "span_clip": """
        SELECT s.src, s.id, R6(greatest(s.s, r.a)) AS s, R6(least(s.e, r.b)) AS e FROM {shots} s
        JOIN (SELECT src, min(s) + 1000000 AS a, min(s) + 9000000 AS b FROM {spans} x GROUP BY src) r ON s.src = r.src AND s.s < r.b AND s.e > r.a""",
    # Samples in shots, both ends in, and the length of the source's middle shot
    "span_samples": """
        SELECT c.src, c.id, samples, with_face, with_two, R6(median) AS median_shot FROM {shot_samples} c JOIN (SELECT src, PCT(e - s, 0.5e0) AS median FROM {shots} y GROUP BY src) m ON c.src = m.src""",
    # C11: of shots without samples the two nearest to their middle, the earlier of equals: among the two before and the two after
    "span_nearest": """
        SELECT src, id, t, I(r) AS r FROM (SELECT m.src, m.id, R6(x.t) AS t, row_number() OVER (PARTITION BY m.src, m.id ORDER BY abs(x.t - m.mid), x.t) AS r
          FROM (SELECT z.*, n + o AS k FROM {shot_middles} z, (SELECT -1 AS o UNION ALL SELECT 0 UNION ALL SELECT 1 UNION ALL SELECT 2) y) m JOIN {numbered_samples} x ON m.src = x.src AND m.k = x.k) a WHERE r <= 2""",
    # C14: the first shot that holds a piece's middle, ends in; where none does the first that holds its start. C24: and where none does, the start itself.
    # Both probes look in one pass, in the stretch of time that each lies in
    "span_point": """
        SELECT m.src, m.id AS pid, f.id, R6(coalesce(f.s, m.s)) AS since FROM {moments} m LEFT JOIN (
          SELECT src, pid, id, s FROM (SELECT p.src, p.id AS pid, s.id, s.s, row_number() OVER (PARTITION BY p.src, p.id ORDER BY probe, s.s, s.id) AS r
            FROM (SELECT *, floor(t / 36e2) AS bin FROM (SELECT src, id, probe, CASE probe WHEN 0 THEN (s + e) / 2 ELSE s END AS t FROM {moments} q, (SELECT 0 AS probe UNION ALL SELECT 1) k) w) p
            JOIN {shot_bins} s ON p.src = s.src AND p.bin = s.bin AND s.s <= p.t AND p.t <= s.e) a WHERE r = 1) f ON m.src = f.src AND m.id = f.pid""",
    # Each word to the piece it overlaps most, the earliest of equals
    "span_most_overlap": """
        SELECT src, cid, mid, R6(cover) AS cover FROM (SELECT *, row_number() OVER (PARTITION BY src, cid ORDER BY cover DESC, mid) AS r FROM {overlaps} o) a WHERE r = 1""",
    # Spans split at the starts of shots inside them, but not within .3 s of an end
    "span_split": """
        SELECT src, id, R6(since) AS s, R6(coalesce(lead(since) OVER (PARTITION BY src, id ORDER BY since), e)) AS e FROM (
          SELECT src, id, e, s AS since FROM {moments} m UNION
          SELECT m.src, m.id, m.e, x.s FROM {moment_bins} m JOIN {shot_starts} x ON m.src = x.src AND m.bin = x.bin AND x.s > m.s + 3e-1 AND x.s < m.e - 3e-1) a""",
    # What merged spans leave free
    "span_gaps": """
        SELECT src, R6(done) AS s, R6(s) AS e FROM (SELECT src, s, max(e) OVER (PARTITION BY src ORDER BY s, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS done FROM {spans} a) b WHERE s > done""",
    # Visual figures of a source: faces that qualify, two of them, the middle height, the share of time laid out to fit
    "span_visual": """
        SELECT v.src, R6(coverage) AS coverage, R6(two_shot) AS two_shot, R6(median_h) AS median_h, samples, R6(coalesce(fit_ratio, 0e0)) AS fit_ratio FROM (
          SELECT src, avg(CASE WHEN {qualifies} THEN 1e0 ELSE 0e0 END) AS coverage, coalesce(avg(CASE WHEN {qualifies} THEN CASE WHEN faces >= 2 THEN 1e0 ELSE 0e0 END END), 0e0) AS two_shot,
            coalesce(PCT(CASE WHEN {qualifies} THEN h END, 0.5e0), 0e0) AS median_h, count(*) AS samples FROM {samples} a GROUP BY src) v
        LEFT JOIN (SELECT src, sum(CASE WHEN kind = 'fit' THEN e - s ELSE 0e0 END) / sum(e - s) AS fit_ratio FROM {layouts} l WHERE e > s GROUP BY src) l ON v.src = l.src""",
    # Cuts a minute, boundaries strictly inside
    "span_cuts": """
        SELECT m.src, m.id, coalesce(cuts, 0) AS cuts, R6(coalesce(cuts, 0) / ((m.e - m.s) / 60)) AS per_minute FROM {moments} m LEFT JOIN (
          SELECT b.src, b.id, count(*) AS cuts FROM {moment_bins} b JOIN {shot_starts} x ON b.src = x.src AND b.bin = x.bin AND x.s > b.s AND x.s < b.e GROUP BY b.src, b.id) c ON m.src = c.src AND m.id = c.id WHERE m.e > m.s""",
    # The kind with most time, the first seen of equals
    "span_dominant": """
        SELECT src, kind, R6(dur) AS dur FROM (SELECT src, kind, dur, row_number() OVER (PARTITION BY src ORDER BY dur DESC, first) AS r FROM (SELECT src, kind, sum(e - s) AS dur, min(s) AS first FROM {spans} a GROUP BY src, kind) b) c WHERE r = 1""",
    # How many of each kind
    "span_kinds": "SELECT src, count(*) AS n, " + ", ".join(f"I(sum(CASE WHEN kind = '{k}' THEN 1 ELSE 0 END)) AS n_{k}" for k in ("click", "error", "purchase", "signup", "view")) + " FROM {spans} a GROUP BY src",
    # Thresholds of cuts, the median of the 25 values before, 14 at least
    "span_cut_threshold": """
        SELECT src, id, R6(greatest(14e0, 4 * coalesce(PCT(score, 0.5e0) OVER (PARTITION BY src ORDER BY s, id ROWS BETWEEN 25 PRECEDING AND 1 PRECEDING), 0e0))) AS threshold, score AS d FROM {spans} a""",
    # F16: four middles of a span
    "span_stills": "SELECT src, id, I(k) AS k, R6(s + (k + 5e-1) * (e - s) / 4) AS t FROM {moments} m, (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) n",
    # F16: the places of a clip that its check looks at, in bounds
    "qc_stills": "SELECT id, I(k) AS k, R6(least(greatest(CASE k WHEN 0 THEN 5e-1 WHEN 1 THEN dur * 25e-2 WHEN 2 THEN dur * 6e-1 ELSE dur * 9e-1 END, 0e0), greatest(dur - 5e-2, 0e0))) AS t FROM {measures} m, (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) n",
    # five samples at even places of a source's samples with faces, of all if it has fewer than five of those; a place that comes twice counts once
    "span_even_samples": """
        SELECT src, I(min(k)) AS k, R6(t) AS t FROM (SELECT src, id, t, row_number() OVER (PARTITION BY src ORDER BY t, id) - 1 AS r, count(*) OVER (PARTITION BY src) AS n FROM (
            SELECT *, count(CASE WHEN faces > 0 THEN 1 END) OVER (PARTITION BY src) AS seen FROM {samples} a) b WHERE faces > 0 OR seen < 5) c
        JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) d ON r = least(n - 1, floor((k + 5e-1) * n / 5)) GROUP BY src, id, t""",
    # A crop of .316 of the width around a face, inside of the picture
    "span_crop": "SELECT src, id, R6(least(greatest(cx - 158203e-6, 0e0), 1 - 316406e-6)) AS x, R6(least(greatest(cy - 5e-1 / zoom, 0e0), 1 - 1 / zoom)) AS y, R6(316406e-6 / zoom) AS w, R6(1 / zoom) AS h FROM {layouts} l WHERE kind = 'face'",
    # A fade of a tenth of a second at both ends
    "span_fade": "SELECT src, id, R6(least(1e0, greatest(0e0, least(place, length - place) / 1e-1))) AS volume FROM (SELECT src, id, e - s AS length, score / 1e2 * (e - s) AS place FROM {spans} a) b",
    # At a frame of a segment: its volume (two frames in and two out, flat under six frames); the opacity of a text that fades out over the
    # last six frames, or all that it has; how long an entry of eight frames may take
    "span_envelopes": """
        SELECT src, id, frames, frame, R6(CASE WHEN frames < 6 THEN 1e0 WHEN frame <= 2 THEN greatest(0e0, frame / 2e0) WHEN frame >= frames - 2 THEN greatest(0e0, (frames - frame) / 2e0) ELSE 1e0 END) AS volume,
          R6(least(1e0, greatest(0e0, (frames - frame) / (fade * 1e0)))) AS opacity, greatest(1, least(8, frames)) AS entry
        FROM (SELECT src, id, frames, frame, greatest(1, least(6, frames)) AS fade FROM (SELECT src, id, I(floor(score / 4)) AS frames, I(id % 27 - 1) AS frame FROM {spans} a) b) c""",
    # Layout by the faces of a shot that qualify: none, or scattered ones, are fitted; two at once are split; else the face, nearer if small
    "span_layout": "SELECT src, id, kind, R6(cx) AS cx, R6(cy) AS cy, R6(zoom) AS zoom FROM {layouts} l",
    # A layout that is asked for goes before what the faces say, with its own place
    "span_layout_override": "SELECT src, id, coalesce(asked, kind) AS kind, R6(CASE WHEN asked IS NULL THEN cx ELSE asked_x END) AS cx, R6(CASE WHEN asked IS NULL THEN cy ELSE asked_y END) AS cy, R6(CASE WHEN asked IS NULL THEN zoom ELSE asked_zoom END) AS zoom FROM {asked_layouts} l",
}

_OFFICIAL = """
candidates AS MATERIALIZED (SELECT user_id AS src, event_id AS id, value AS score, epoch_us(ts) / 1e6 - 1704067200e0 AS s, epoch_us(ts) / 1e6 - 1704067200e0 + value * 36 AS e FROM events WHERE event_type = 'view'),
mid AS (SELECT median(value) AS mid FROM events WHERE event_type = 'purchase' AND value > 0),
moments AS MATERIALIZED (SELECT user_id AS src, event_id AS id, epoch_us(ts) / 1e6 - 1704067200e0 AS s, epoch_us(ts) / 1e6 - 1704067200e0 + value * 36 AS e, CASE WHEN value > 0 THEN ln(value / mid) END AS perf FROM events, mid WHERE event_type = 'purchase'),
official AS (SELECT src, id AS mid, s, greatest(s + (e - s) * 8e-1, e + 5e2 + (e - s) * 2e-1) AS e FROM moments WHERE e > s),
covers AS MATERIALIZED (SELECT c.src, c.id AS cid, o.mid, (least(c.e, o.e) - greatest(c.s, o.s)) / (o.e - o.s) AS cover FROM candidates c JOIN official o ON c.src = o.src AND c.s < o.e AND o.s < c.e AND c.e > c.s AND o.e > o.s),
best AS (SELECT src, mid, min(cid) FILTER (cover = most) AS cid, max(most) AS cover FROM (SELECT *, max(cover) OVER (PARTITION BY src, mid) AS most FROM covers) WHERE cover >= 3e-1 GROUP BY src, mid),
shortlist AS (SELECT src, id FROM candidates QUALIFY row_number() OVER (PARTITION BY src ORDER BY score DESC, s, id) <= 10),
hits AS (SELECT DISTINCT l.src, l.id FROM shortlist l JOIN covers c ON c.src = l.src AND c.cid = l.id WHERE cover >= 3e-1)"""
#: Relations that an operator's query reads in place of its own: of all candidates the ones that match, not of ten a source.
WHOLE = {"span_matched_candidates": {"shortlist": "SELECT src, id, score, s, e FROM {candidates} a"}}
_SIX = "floor(({0}) * 1e6 + 0.5) / 1e6"

#: Of what stands on a moment's one span: texts apart from the operators', without their stretches of time.
ORACLE = {
    "span_overlap_ratio": f"WITH {_OFFICIAL} SELECT src, cid, mid, {_SIX.format('cover')} AS cover FROM covers",
    "span_best_match": f"WITH {_OFFICIAL} SELECT src, mid, cid, {_SIX.format('cover')} AS cover FROM best",
    "span_matched_candidates": f"WITH {_OFFICIAL} SELECT DISTINCT src, cid AS id FROM covers WHERE cover >= 3e-1",
    "span_eval": f"""
WITH {_OFFICIAL}, l AS (SELECT src, count(*) AS listed FROM shortlist GROUP BY src), h AS (SELECT src, count(*) AS hit FROM hits GROUP BY src)
SELECT m.src, count(*) AS n, count(b.cid) AS found, {_SIX.format("count(b.cid) / count(*)")} AS recall, {_SIX.format("coalesce(coalesce(any_value(hit), 0) / any_value(listed), 0)")} AS precision
FROM moments m LEFT JOIN best b ON b.src = m.src AND b.mid = m.id LEFT JOIN l ON l.src = m.src LEFT JOIN h ON h.src = m.src GROUP BY m.src""",
    "span_eval_rows": f"""
WITH {_OFFICIAL} SELECT m.src, m.id AS mid, {_SIX.format("coalesce(perf, 0)")} AS perf, {_SIX.format("o.s")} AS s, {_SIX.format("o.e")} AS e, cid, l.id IS NOT NULL AS shortlisted
FROM moments m LEFT JOIN official o ON o.src = m.src AND o.mid = m.id LEFT JOIN best b ON b.src = m.src AND b.mid = m.id LEFT JOIN shortlist l ON l.src = b.src AND l.id = b.cid""",
}
