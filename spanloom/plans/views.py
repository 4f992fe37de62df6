"""Named relations: how tables stand in for transcripts, spans, moments, shots, clips, ledgers and listings."""

from spanloom.plans import inplace
from spanloom.plans.dialect import Twofold

VIEWS = {
    # Words of a transcript: half a second each, with a pause of 1.5 s after each 37th.
    "words": "SELECT src, CAST(p AS BIGINT) AS p, w, p * 5e-1 + floor(p / 37e0) * 15e-1 AS s, p * 5e-1 + floor(p / 37e0) * 15e-1 + 4e-1 AS e FROM {doc_words} x",
    "tokens": "SELECT src, i, t, p * 5e-1 + floor(p / 37e0) * 15e-1 AS s, p * 5e-1 + floor(p / 37e0) * 15e-1 + 4e-1 AS e FROM {doc_tokens} a",
    "short_tokens": "SELECT src, i, t, p * 5e-1 AS s, p * 5e-1 + 4e-1 AS e FROM {item_tokens} a",
    # A sentence ends at end punctuation, before a pause over 1.2 s, and at 45 words.
    "sentence_words": """
        SELECT src, p, w, s, e, seg, CAST(floor((row_number() OVER (PARTITION BY src, seg ORDER BY p) - 1) / 45e0) AS BIGINT) AS sub FROM (
          SELECT *, sum(brk) OVER (PARTITION BY src ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seg FROM (
            SELECT *, CASE WHEN RX(lag(w) OVER (PARTITION BY src ORDER BY p), '[.?!]["'')]?$') OR s - lag(e) OVER (PARTITION BY src ORDER BY p) > 12e-1 THEN 1 ELSE 0 END AS brk
            FROM {words} a) b) c""",
    "sentences": """
        SELECT src, row_number() OVER (PARTITION BY src ORDER BY w0) - 1 AS id, w0, w1, s, e, txt FROM (
          SELECT src, min(p) AS w0, max(p) AS w1, min(s) AS s, max(e) AS e, TEXTAGG(w, p, ' ') AS txt FROM {sentence_words} a GROUP BY src, seg, sub) b""",
    # Time spans of a user.
    "spans": "SELECT user_id AS src, event_id AS id, event_type AS kind, value AS score, SECS(ts) AS s, SECS(ts) + value * 36 AS e FROM {events}",
    "candidates": "SELECT src, id, score, s, e FROM {spans} a WHERE kind = 'view'",
    "middle": "SELECT PCT(value, 0.5e0) AS mid FROM {events} WHERE event_type = 'purchase' AND value > 0",
    "moments": "SELECT src, id, s, e, CASE WHEN score > 0 THEN ln(score / (SELECT mid FROM {middle} m)) END AS perf FROM {spans} a WHERE kind = 'purchase'",
    "shots": "SELECT src, id, s, e FROM {spans} a WHERE kind = 'click'",
    "samples": "SELECT src, id, s AS t, CAST(id % 3 AS BIGINT) AS faces, (id % 40) / 1e2 AS h, (id % 10) / 1e1 AS face_score, 3e-1 + (id % 17) / 5e1 AS cx, 4e-1 + (id % 7) / 1e2 AS cy FROM {spans} a WHERE kind <> 'click'",
    # A face counts from these on.
    "qualifies": "faces > 0 AND face_score >= 7e-1 AND h >= 6e-2",
    # Spans by the stretches of time that they touch, and points by the one that they lie in.
    "candidate_bins": "SELECT *, BINS(s, e) AS bin FROM {candidates} a WHERE e > s",
    "moment_bins": "SELECT *, BINS(s, e) AS bin FROM {moments} a WHERE e > s",
    "shot_bins": "SELECT *, BINS(s, e) AS bin FROM {shots} a WHERE e >= s",
    "shot_starts": "SELECT src, id, s, floor(s / 36e2) AS bin FROM {shots} a",
    "sample_bins": "SELECT *, floor(t / 36e2) AS bin FROM {samples} a",
    "shot_samples": "SELECT s.src, s.id, count(*) AS samples, I(sum(CASE WHEN x.faces >= 1 THEN 1 ELSE 0 END)) AS with_face, I(sum(CASE WHEN x.faces >= 2 THEN 1 ELSE 0 END)) AS with_two FROM {shot_bins} s JOIN {sample_bins} x ON s.src = x.src AND s.bin = x.bin AND x.t >= s.s AND x.t <= s.e GROUP BY s.src, s.id",
    "numbered_samples": "SELECT src, t, id, row_number() OVER (PARTITION BY src ORDER BY t, id) AS k FROM {samples} a",
    # Middles of shots without samples, and how many samples lie before or at them.
    "shot_middles": """
        SELECT src, id, t AS mid, n FROM (SELECT src, id, t, shot, sum(1 - shot) OVER (PARTITION BY src ORDER BY t, shot, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM (
          SELECT src, id, t, 0 AS shot FROM {samples} a UNION ALL
          SELECT s.src, s.id, (s.s + s.e) / 2, 1 FROM {shots} s LEFT JOIN {shot_samples} c ON s.src = c.src AND s.id = c.id WHERE c.id IS NULL) b) d WHERE shot = 1""",
    "layouts": """
        SELECT src, id, s, e, kind, CASE WHEN kind = 'face' THEN mid_x END AS cx, CASE WHEN kind = 'face' THEN CASE WHEN mid_h < 16e-2 THEN mid_y + 8e-2 ELSE 5e-1 END END AS cy, CASE WHEN kind = 'face' THEN CASE WHEN mid_h < 16e-2 THEN 135e-2 ELSE 1e0 END END AS zoom FROM (
          SELECT *, CASE WHEN n = 0 THEN 'fit' WHEN two / n >= 5e-1 THEN 'split' WHEN spread > 316406e-6 THEN 'fit' ELSE 'face' END AS kind FROM (
            SELECT s.src, s.id, max(s.s) AS s, max(s.e) AS e, sum(CASE WHEN {qualifies} THEN 1e0 ELSE 0e0 END) AS n, sum(CASE WHEN {qualifies} AND faces >= 2 THEN 1e0 ELSE 0e0 END) AS two,
              max(CASE WHEN {qualifies} THEN cx END) - min(CASE WHEN {qualifies} THEN cx END) AS spread, PCT(CASE WHEN {qualifies} THEN cx END, 0.5e0) AS mid_x, PCT(CASE WHEN {qualifies} THEN cy END, 0.5e0) AS mid_y, PCT(CASE WHEN {qualifies} THEN h END, 0.5e0) AS mid_h
            FROM {shot_bins} s LEFT JOIN {sample_bins} x ON s.src = x.src AND s.bin = x.bin AND x.t >= s.s AND x.t <= s.e GROUP BY s.src, s.id) a) b""",
    "asked_layouts": "SELECT *, CASE WHEN id % 5 = 0 THEN 'face' WHEN id % 5 = 1 THEN 'split' WHEN id % 5 = 2 THEN 'fit' END AS asked, CASE WHEN id % 5 = 0 THEN 25e-2 END AS asked_x, CASE WHEN id % 5 = 0 THEN 5e-1 END AS asked_y, CASE WHEN id % 5 = 0 THEN 2e0 END AS asked_zoom FROM {layouts} l",
    # A channel's listing: views and upload day.
    "listing": "SELECT o_orderkey AS id, c_nationkey AS channel, o_totalprice - 1000 AS views, DAY(o_orderdate) AS day, SECS(o_orderdate) AS since, 900 + o_custkey % 60 AS dur FROM {orders} JOIN {customer} ON o_custkey = c_custkey",
    "now": "SELECT max(SECS(o_orderdate)) + 86400e0 AS now FROM {orders}",
    "perf": """
        SELECT id, channel, ln(views / PCT_MID) AS perf FROM (
          SELECT id, channel, views, m AS PCT_MID FROM {eligible} a JOIN (SELECT channel AS c, PCT(views, 0.5e0) AS m FROM {eligible} b GROUP BY channel) d ON channel = c) e""",
    "eligible": "SELECT id, channel, views FROM {listing} a, {now} n WHERE views > 0 AND (now - since) / 864e2 >= 7",
    "ledger": "SELECT event_id AS id, event_type AS purpose, value AS cost, JSONINT(props, k) % 2 = 0 AS cached, SECS(ts) AS since, 1000 + event_id % 977 AS ms FROM {events}",
    # Clips with status, outcome and seven signals, from labelled documents.
    "clips": """
        SELECT d.doc_id AS id, source AS creator, CASE WHEN quality = 1 THEN 'approved' WHEN toxic = 1 THEN 'rejected' WHEN d.doc_id % 5 = 0 THEN 'qc_failed' WHEN d.doc_id % 5 = 1 THEN 'published' ELSE 'ready' END AS status,
          CAST(d.doc_id % 2 AS BIGINT) AS cold, n_chars / 20e0 AS dur, 100 + d.doc_id * 37 % 5000 AS views, CASE WHEN d.doc_id % 7 > 0 THEN (d.doc_id * 13 % 100) / 1e0 END AS pct, (d.doc_id * 11 % 200) / 1e0 AS hours, quality, toxic, lang,
          d.doc_id * 3 % 11 / 1e0 AS hook, n_chars % 11 / 1e0 AS payoff, d.doc_id * 7 % 11 / 1e0 AS clarity, 5e0 AS emotion, d.doc_id * 5 % 7 / 1e0 AS novelty, n_chars * 3 % 9 / 1e0 AS pace, quality * 4e0 + d.doc_id % 3 AS fit
        FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id""",
    # What reviewers ask for: the clip's language and source make texts, its figures numbers.
    "requests": """
        SELECT c.id, status, act, quality = 0 AND toxic = 0 AS forced, status = 'published' OR hours < 24 AND status = 'approved' AS public, payoff AS n, hook AS hooks, CASE WHEN novelty = 0 THEN '' ELSE concat(lang, ' ', creator) END AS reason,
          CASE WHEN pace < 3 THEN '2026-01-05 10:00:00' WHEN pace < 6 THEN 'soon' END AS due
        FROM {clips} c, (SELECT 'approve' AS act UNION ALL SELECT 'reject' UNION ALL SELECT 'hook' UNION ALL SELECT 'title' UNION ALL SELECT 'schedule') x""",
    "publishing": "SELECT id, creator, status, status = 'published' OR NOT dry AS public, dry, hours, hook > 1 OR payoff > 8 AS passed, quality = 0 AND toxic = 0 AS forced FROM (SELECT *, NOT (status = 'approved' AND hours < 50) AS dry FROM {clips} c) a",
    "caps": "SELECT id, CASE WHEN quality = 1 THEN ' ' WHEN toxic = 1 THEN creator WHEN hours > 150 THEN STR(-hook) WHEN hours > 100 THEN 'nan' ELSE STR(hook) END AS raw FROM {clips} c",
    "timeouts": "SELECT id, CASE WHEN hook = 0 THEN NULL WHEN hook < 3 THEN ' ' WHEN hook < 5 THEN 'soon' WHEN hook < 6 THEN '-2' ELSE concat(' ', STR(hook), ' ') END AS stall_raw, CASE WHEN payoff < 2 THEN '0' WHEN payoff < 3 THEN 'nan' WHEN payoff < 4 THEN NULL ELSE STR(payoff) END AS hard_raw FROM {clips} c",
    # What is uploaded: the text's beginning up to a sentence as the title, the language as a tag.
    "uploads": "SELECT c.id, concat(' ', substr(coalesce(text, ''), 1, 60 + CAST(c.id % 60 AS INT)), ' ') AS title, CASE WHEN c.id % 2 = 0 THEN concat('#', c.lang) ELSE concat(c.lang, '#') END AS tag, CASE WHEN clarity > 5 THEN '2026-01-05T10:00:00Z' END AS due FROM {clips} c JOIN {documents} d ON c.id = d.doc_id",
    "attributed": "SELECT c.id, concat(c.lang, ' ', STR(c.id)) AS title, creator AS name, CASE WHEN c.id % 3 > 0 THEN STR(c.id) END AS video, CASE WHEN c.id % 3 = 0 AND c.id % 2 = 0 THEN concat('https://host/x?t=', STR(c.id)) END AS url FROM {clips} c",
    "mastered": "SELECT id, -12 - hook / 2 AS lufs, payoff - 5 AS tp, novelty > 3 AS retried FROM {clips} c",
    "descriptions": "SELECT doc_id AS id, concat(coalesce(text, ''), CASE WHEN source IS NULL THEN '' ELSE concat(chr(10), chr(10), 'From \"', source, '\"') END) AS t FROM {documents} d",
    # What was measured of a rendered clip, and of it what a content check and a vision check said.
    "measures": """
        SELECT id, status, CASE WHEN novelty = 6 THEN 720 ELSE 1080 END AS width, 1920 AS height, 'h264' AS vcodec, CASE WHEN pace = 8 THEN 'yuv444p' ELSE 'yuv420p' END AS pix_fmt, 30 + hook / 1e3 AS fps, CASE WHEN hook < 10 THEN 'aac' END AS acodec,
          dur, dur + (payoff - 5) / 19 AS want, -12 - hook / 2 AS lufs, payoff - 8 AS tp, clarity / 6 AS silence, novelty / 11 AS black, pace / 3 AS frozen, hook * 3 AS caption_chars,
          quality IS NOT NULL AS judged, toxic = 0 AS standalone, payoff >= 3 AS clean_ending, hook >= 2 AS hook_matches, pace > 5 AS issues,
          novelty >= 2 AS seen, clarity > 3 AS framing_ok, pace < 7 AS captions_ok, fit > 3 AS covers, CASE WHEN quality = 1 THEN 'keep' WHEN toxic = 1 THEN 'reject' ELSE 'improve' END AS verdict FROM {clips} c""",
    "face_checks": "SELECT id, k AS segment, hook + k * 3 > 6 AS ok, payoff + k > 9 AS fit FROM {clips} c, (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) n WHERE clarity > k",
    # What a fix may change: bounds with the next sentences' (null without any), the hook, the style, what was done before.
    "fix_context": """
        SELECT id, hook AS hook_index, payoff + 2 AS hook_count, hours AS s, hours + dur AS e, 15e0 AS lo, 60e0 AS hi, CASE WHEN pace > 0 THEN hours + dur + pace * 2 END AS next_end, CASE WHEN novelty > 0 THEN hours + novelty END AS next_start,
          CASE WHEN clarity = 7 THEN 'hook-high' ELSE 'default' END AS style, CASE WHEN emotion + novelty > 9 THEN 'loosen_pauses' ELSE '' END AS history,
          CASE WHEN novelty = 2 THEN 'fit_layout' WHEN novelty = 3 THEN 'trim_start' WHEN novelty = 4 THEN 'move_hook_up' ELSE 'extend_end' END AS v1, CASE WHEN hook < 5 THEN 'next_hook' WHEN hook < 8 THEN 'fit_layout' END AS v2, CASE WHEN hook = 3 THEN 'trim_start' END AS v3 FROM {clips} c""",
    "signals": " UNION ALL ".join(f"SELECT id, creator, status, dur, '{k}' AS signal, {k} AS x, quality FROM {{clips}} a" for k in ("hook", "payoff", "clarity", "emotion", "novelty", "pace", "fit")),
    # Outcomes of clips that are public for three days: log ratio to the creator's median, blended with retention where all have it.
    "outcomes": """
        SELECT id, creator, dur, cold, CASE WHEN pace > 4 THEN 1 ELSE 0 END AS tightened, CASE WHEN clarity < 4 THEN 1 ELSE 0 END AS paused, lang, CASE WHEN all_pct THEN 5e-1 * y0 + 5e-1 * coalesce(DIV(pct - mean_pct, sd_pct), 0e0) ELSE y0 END AS y FROM (
          SELECT a.*, ln(greatest(views, 1) / greatest(m, 1e0)) AS y0, avg(pct) OVER (PARTITION BY creator) AS mean_pct, STDPOP(pct) OVER (PARTITION BY creator) AS sd_pct, BOOLAND(pct IS NOT NULL) OVER (PARTITION BY creator) AS all_pct
          FROM {clips} a JOIN (SELECT creator AS c, PCT(views, 0.5e0) AS m FROM {clips} b WHERE hours >= 72 GROUP BY creator) k ON creator = c WHERE hours >= 72) d""",
    # Outcomes by feature: cold open, length, the pattern of the hook, the layout that most of the clip has.
    "buckets": """
        SELECT feature, v, count(*) AS n, avg(y) AS mean_y FROM (
          SELECT 'coldOpen' AS feature, CASE WHEN cold = 1 THEN 'yes' ELSE 'no' END AS v, y FROM {outcomes} a UNION ALL SELECT 'hookPattern', coalesce(lang, 'unknown'), y FROM {outcomes} b
          UNION ALL SELECT 'layout', concat(coalesce(lang, 'unknown'), CASE WHEN cold = 1 THEN ' split' ELSE ' face' END), y FROM {outcomes} d
          UNION ALL SELECT 'duration', CASE WHEN dur < 30 THEN '<30' WHEN dur < 45 THEN '30-45' WHEN dur < 60 THEN '45-60' ELSE '>=60' END, y FROM {outcomes} c) x GROUP BY feature, v HAVING count(*) >= 3""",
    # What a moment is made of: most of it, and a piece that was lifted from later on.
    "segments": "SELECT src, id AS mid, 0 AS k, s, s + (e - s) * 8e-1 AS e FROM {moments} m WHERE e > s UNION ALL SELECT src, id, 1, e + 5e2, e + 5e2 + (e - s) * 2e-1 FROM {moments} n WHERE e > s",
    # Share of a moment's segments that a candidate of its source covers. Spans meet in the stretch of time where their
    # overlap begins, so a source of many spans is many keys.
    "overlaps": """
        SELECT o.src, cid, o.mid, max(score) AS score, max(perf) AS perf, sum(part) / max(total) AS cover FROM (
          SELECT c.src, c.id AS cid, g.mid, c.score, least(c.e, g.e) - greatest(c.s, g.s) AS part
          FROM (SELECT *, BINS(s, e) AS bin FROM {candidates} x WHERE e > s) c JOIN (SELECT *, BINS(s, e) AS bin FROM {segments} y) g
          ON c.src = g.src AND c.bin = g.bin AND c.s < g.e AND g.s < c.e WHERE c.bin = floor(greatest(c.s, g.s) / 36e2)) o
        JOIN (SELECT src, id AS mid, perf FROM {moments} m) p ON o.src = p.src AND o.mid = p.mid JOIN (SELECT src, mid, sum(e - s) AS total FROM {segments} z GROUP BY src, mid) t ON o.src = t.src AND o.mid = t.mid
        GROUP BY o.src, cid, o.mid""",
    # A moment as one span, from the least start to the largest end of its segments, and the share of it that a candidate covers.
    "official": "SELECT src, mid, min(s) AS s, max(e) AS e FROM {segments} z GROUP BY src, mid",
    "official_covers": """
        SELECT c.src, c.id AS cid, o.mid, (least(c.e, o.e) - greatest(c.s, o.s)) / (o.e - o.s) AS cover
        FROM (SELECT *, BINS(s, e) AS bin FROM {candidates} x WHERE e > s) c JOIN (SELECT *, BINS(s, e) AS bin FROM {official} y WHERE e > s) o
        ON c.src = o.src AND c.bin = o.bin AND c.s < o.e AND o.s < c.e WHERE c.bin = floor(greatest(c.s, o.s) / 36e2)""",
    "official_matches": "SELECT * FROM {official_covers} o WHERE cover >= 3e-1",
    # The ten best candidates of a source are its shortlist.
    "shortlist": "SELECT src, id, score, s, e FROM {ranked} r WHERE pos <= 10",
    "matches": "SELECT * FROM {overlaps} o WHERE cover >= 3e-1",
    "ranked": "SELECT src, id, score, s, e, row_number() OVER (PARTITION BY src ORDER BY score DESC, s, id) AS pos FROM {candidates} c",
    "graded": "SELECT *, CASE WHEN perf >= ln(2e0) - 1e-12 THEN 3 WHEN perf >= 0 THEN 2 ELSE 1 END AS grade FROM {moments} m",
    # Rankings of a pool by variant: by score, the same by a second hand (the score in whole tens), by length, by time.
    "rankings": """
        SELECT key, src, id, CASE key WHEN 'V0' THEN p0 WHEN 'V0@1' THEN p1 WHEN 'B-length' THEN p2 ELSE p3 END AS pos FROM (
          SELECT src, id, row_number() OVER (PARTITION BY src ORDER BY score DESC, s, id) AS p0, row_number() OVER (PARTITION BY src ORDER BY floor(score / 10) DESC, s, id) AS p1,
            row_number() OVER (PARTITION BY src ORDER BY e - s DESC, id) AS p2, row_number() OVER (PARTITION BY src ORDER BY s, id) AS p3 FROM {candidates} c) r,
          (SELECT 'V0' AS key UNION ALL SELECT 'V0@1' UNION ALL SELECT 'B-length' UNION ALL SELECT 'B-time') k""",
    # What a run of a variant cost: what was spent on the source's events of one kind.
    "runs": " UNION ALL ".join(f"SELECT '{k}' AS key, src, sum(score) AS cost, sum(score) * 1e1 AS ms FROM {{spans}} a WHERE kind = '{e}' GROUP BY src" for k, e in (("V0", "signup"), ("V0@1", "signup"), ("B-length", "error"), ("B-time", "click"))),
    # Sources whose first span starts later than that of half of them.
    "young": "SELECT src, first > (SELECT PCT(first, 0.5e0) FROM (SELECT min(s) AS first FROM {spans} a GROUP BY src) b) AS young FROM (SELECT src, min(s) AS first FROM {spans} c GROUP BY src) d",
    # Seven signals of the best 25 candidates of a source, from 0 to 10: of the score, the length and the words that the id makes.
    "pool_signals": """
        SELECT r.src, fold, id, s AS since, floor(score / 10) AS hook, least(10e0, floor((e - s) / 36e1)) AS payoff, abs(floor(score / 10) - 5) AS clarity, 5e0 AS emotion, floor(score * 7) - floor(score * 7 / 11) * 11 AS novelty,
          least(10e0, floor((e - s) / 1e2) - floor((e - s) / 1e3) * 10) AS pace, floor(score * 3) - floor(score * 3 / 10) * 10 AS fit FROM {ranked} r JOIN {folds} f ON r.src = f.src WHERE pos <= 25""",
    # Of a source's pictures: share of samples with a face, of time without a subject, longest time without a face, cuts a minute, height of faces.
    "visual_figures": """
        SELECT v.src, coverage, fit_ratio, median_h, coalesce(seconds, 0e0) AS no_face, coalesce(rate, 0e0) AS cuts_per_min FROM {visuals} v LEFT JOIN (SELECT src, seconds FROM {faceless} x) n ON v.src = n.src
        LEFT JOIN (SELECT src, avg(per_minute) AS rate FROM {cut_rates} y GROUP BY src) c ON v.src = c.src""",
    "judged": "SELECT src, id, floor((hook * 3 + payoff + clarity + emotion + novelty + pace + fit) / 9e0 * 100 + 5e-1) / 1e2 AS composite, I(floor(fit / 2)) AS found FROM {pool_signals} p",
    "credited": "SELECT signal, x, coalesce(y, 0e0) AS y FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS signal, src, id, {k} AS x FROM {{pool_signals}} a" for k in ("hook", "payoff", "clarity", "emotion", "novelty", "pace", "fit")) + ") s LEFT JOIN (SELECT x.src AS ms, cid, max(power(2, grade) - 1) AS y FROM {matches} x JOIN {graded} g ON x.src = g.src AND x.mid = g.id GROUP BY x.src, cid) m ON s.src = ms AND s.id = cid",
    "hooks": "SELECT src, p, text AS hook, n - floor(n / 11e0) * 11 AS score FROM {speeches} a WHERE role = 'user'",
    # Cold opens that were proposed for a clip of ten sentences: the sentence that the first one's length names.
    "openings": "SELECT src, id, id AS a, id + 9 AS b, id + length(txt) - 20 AS sid FROM {sentences} x",
    "speeches": "SELECT conv_id AS src, CAST(turn AS BIGINT) AS p, role, text, CAST(length(text) AS BIGINT) AS n FROM {conversations}",
    "folds": "SELECT DISTINCT src, HASHINT(STR(src)) % 3 AS fold FROM {candidates} c",
}

VIEWS |= {k: Twofold(VIEWS[k], text) for k, text in inplace.VIEWS.items()}
