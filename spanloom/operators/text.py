"""Words, sentences, windows and alignment of short texts with long ones."""

OPERATORS = {
    # Words to tokens with times, ordinals after empties went
    "text_tokenize": "SELECT src, I(i) AS i, t, R6(s) AS s, R6(e) AS e FROM {tokens} a",
    # E2, H3, H4
    "text_sentences": "SELECT src, I(id) AS id, w0, w1, R6(s) AS s, R6(e) AS e, txt FROM {sentences} a",
    # Words, share that ends a sentence, sentences, median words, way of segmentation
    "text_transcript_stats": """
        SELECT a.src, words, R6(dens) AS density, n AS sentences, R6(med) AS median_words, CASE WHEN dens < 2e-2 THEN 'gaps' ELSE 'punctuation' END AS segmentation
        FROM (SELECT src, count(*) AS words, avg(CASE WHEN RX(w, '[.?!]["'')]?$') THEN 1e0 ELSE 0e0 END) AS dens FROM {words} x GROUP BY src) a
        JOIN (SELECT src, count(*) AS n, PCT(CAST(w1 - w0 + 1 AS DOUBLE), 0.5e0) AS med FROM {sentences} y GROUP BY src) b ON a.src = b.src""",
    # At most three sentences back while the one before is unfinished, and three on while the own end is
    "text_merge_fragments": """
        SELECT src, I(id) AS id, I(id - CASE WHEN id >= 1 AND NOT b1 THEN CASE WHEN id >= 2 AND NOT b2 THEN CASE WHEN id >= 3 AND NOT b3 THEN 3 ELSE 2 END ELSE 1 END ELSE 0 END) AS first_id,
          I(id + CASE WHEN NOT f0 AND id + 1 < n THEN CASE WHEN NOT f1 AND id + 2 < n THEN CASE WHEN NOT f2 AND id + 3 < n THEN 3 ELSE 2 END ELSE 1 END ELSE 0 END) AS last_id
        FROM (SELECT src, id, done AS f0, lead(done, 1) OVER w AS f1, lead(done, 2) OVER w AS f2, lag(done, 1) OVER w AS b1, lag(done, 2) OVER w AS b2, lag(done, 3) OVER w AS b3, count(*) OVER (PARTITION BY src) AS n
              FROM (SELECT src, id, RX(txt, '[.?!]["'')]?[ ]*$') AS done FROM {sentences} s) a WINDOW w AS (PARTITION BY src ORDER BY id)) b""",
    # Bounds padded by .12 and .3 s, but clear of the neighbouring words by .02 s
    "text_snap_bounds": """
        SELECT s.src, I(s.id) AS id, R6(greatest(s.s - 12e-2, coalesce(b.e + 2e-2, 0e0), 0e0)) AS s, R6(least(s.e + 3e-1, coalesce(a.s - 2e-2, 1e9))) AS e
        FROM {sentences} s LEFT JOIN {words} b ON b.src = s.src AND b.p = s.w0 - 1 LEFT JOIN {words} a ON a.src = s.src AND a.p = s.w1 + 1""",
    # The first and the last two sentences
    "text_opening_closing": """
        SELECT src, max(CASE WHEN id = 0 THEN txt || coalesce(' ' || nx, '') END) AS opening, max(CASE WHEN id = n - 1 THEN coalesce(pv || ' ', '') || txt END) AS closing FROM (
          SELECT src, id, txt, count(*) OVER (PARTITION BY src) AS n, lead(txt) OVER (PARTITION BY src ORDER BY id) AS nx, lag(txt) OVER (PARTITION BY src ORDER BY id) AS pv FROM {sentences} s) a
        WHERE id = 0 OR id = n - 1 GROUP BY src""",
    # The first sentence that ends, and that starts, after a point
    "text_next_sentence": """
        SELECT s.src, min(CASE WHEN s.e > x.at THEN R6(s.e) END) AS next_end, min(CASE WHEN s.s > x.at THEN R6(s.s) END) AS next_start
        FROM {sentences} s JOIN (SELECT src, avg(s) AS at FROM {sentences} y GROUP BY src) x ON s.src = x.src GROUP BY s.src""",
    # Words in the 20 s before a point, the last word before it, whether a pause of .4 s precedes it, and where it lies
    "text_context_before": """
        SELECT a.src, TEXTAGG(a.w, a.p, ' ') AS context, max(a.p) AS last_p, R6(max(x.at) - max(a.e)) AS gap, max(x.at) - max(a.e) >= 4e-1 AS after_pause, R6(max(x.at) / max(x.dur)) AS position
        FROM {words} a JOIN (SELECT src, max(s) / 2 AS at, max(e) AS dur FROM {words} y GROUP BY src) x ON a.src = x.src WHERE a.e < x.at + 5e-2 AND a.s >= x.at - 20 GROUP BY a.src""",
    # The first 150 words
    "text_first_words": "SELECT src, TEXTAGG(w, p, ' ') AS txt FROM {words} a WHERE p < 150 GROUP BY src",
    # E3, G3, C1, 2.9 (1-5), E5, E6, D21: the flagship
    "mine_align": """
        WITH short AS (SELECT src, i, g FROM {item_shingles} a), ep AS (SELECT src, i, g, wp, wl FROM {doc_shingles} b),
        known AS (SELECT ep.* FROM ep JOIN (SELECT DISTINCT g FROM short) k ON ep.g = k.g),
        rare AS (SELECT k.* FROM known k JOIN (SELECT g FROM known GROUP BY g HAVING count(*) <= 25) r ON k.g = r.g),
        hits AS (SELECT s.src AS short, s.i, e.src AS ep, e.i AS p, e.i - s.i AS o, wp, wl FROM short s JOIN rare e ON s.g = e.g),
        won AS (SELECT short, ep, hits FROM (
            SELECT short, ep, count(*) AS hits, row_number() OVER (PARTITION BY short ORDER BY count(*) DESC, min(i), ep) AS r FROM hits GROUP BY short, ep) a WHERE r = 1 AND hits >= 6),
        near AS (SELECT h.short, h.ep, w.hits, i, p, o, wp, wl, count(*) OVER (PARTITION BY h.short ORDER BY o RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS support FROM hits h JOIN won w ON h.short = w.short AND h.ep = w.ep),
        best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY short, i ORDER BY support DESC, p) AS r FROM near) a WHERE r = 1),
        cut AS (SELECT *, CASE WHEN abs(o - lag(o) OVER (PARTITION BY short ORDER BY i)) <= 3 AND i - lag(i) OVER (PARTITION BY short ORDER BY i) <= 7 THEN 0 ELSE 1 END AS brk FROM best),
        chain AS (SELECT *, sum(brk) OVER (PARTITION BY short ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM cut),
        seg AS (SELECT short, ep, hits, c, min(i) AS i0, max(i) + 4 AS i1, ARGMAX(wp, -i) AS w0, ARGMAX(wl, i) AS w1 FROM chain GROUP BY short, ep, hits, c HAVING count(*) >= 2),
        done AS (SELECT *, max(i1) OVER (PARTITION BY short ORDER BY i0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM seg),
        timed AS (SELECT d.short, d.ep, d.hits, greatest(0, d.i1 - greatest(d.i0, coalesce(d.before + 1, 0)) + 1) AS held, w0 * 5e-1 + floor(w0 / 37e0) * 15e-1 AS s, w1 * 5e-1 + floor(w1 / 37e0) * 15e-1 + 4e-1 AS e FROM done d),
        size AS (SELECT src, count(*) AS n FROM {short_tokens} a GROUP BY src)
        SELECT short, ep, I(hits) AS hits, count(*) AS segments, R6(sum(held) / (max(n) * 1e0)) AS coverage, R6(min(s)) AS src_start, R6(max(e)) AS src_end
        FROM timed JOIN size ON short = src GROUP BY short, ep, hits HAVING sum(held) / (max(n) * 1e0) >= 25e-2""",
    # C17, H2: openings (the first 12 words, 6 at least) of held-out items that a text holds, between word boundaries; items have
    # no titles. Texts and openings meet in six words, and what follows is compared
    "bench_leaks": """
        SELECT DISTINCT i.src AS item, d.src AS src FROM (SELECT src, g, tail FROM {item_openings} a WHERE i = 0) i
        JOIN (SELECT src, g, tail FROM {doc_openings} b) d ON i.g = d.g WHERE substr(concat(d.tail, ' '), 1, length(i.tail) + 1) = concat(i.tail, ' ')""",
    # C17: of those leaks the ones within a fold: what is held out of a fold may not be in the texts made for it
    "bench_fold_leaks": """
        SELECT DISTINCT i.fold, i.src AS item, d.src AS src FROM (SELECT src, g, tail, HASHINT(STR(src)) % 3 AS fold FROM {item_openings} a WHERE i = 0) i
        JOIN (SELECT src, g, tail, HASHINT(STR(src)) % 3 AS fold FROM {doc_openings} b) d ON i.g = d.g AND i.fold = d.fold WHERE substr(concat(d.tail, ' '), 1, length(i.tail) + 1) = concat(i.tail, ' ')""",
    # A range of sentences as numbered lines with their times
    "text_format_window": """
        SELECT src, part, TEXTAGG(concat('[', STR(id), '] (', STR(I(floor(floor(s) / 60))), ':', lpad(STR(I(floor(s) - floor(floor(s) / 60) * 60)), 2, '0'), ') ', txt), id, chr(10)) AS block
        FROM (SELECT *, I(floor(id / 2e1)) AS part FROM {sentences} a) b GROUP BY src, part""",
    # How many items are there, have words, align, match nothing, and align with a text whose source is known
    "mine_report": """
        SELECT count(*) AS shorts, count(w.src) AS with_subs, count(*) - count(w.src) AS no_subs, count(a.short) AS aligned, count(w.src) - count(a.short) AS no_match, count(d.doc_id) AS with_features, I(coalesce(sum(a.segments), 0)) AS segments
        FROM {benchmark} b LEFT JOIN (SELECT DISTINCT src FROM {item_tokens} t) w ON b.item_id = w.src LEFT JOIN {aligned} a ON b.item_id = a.short LEFT JOIN (SELECT doc_id FROM {documents} WHERE source IS NOT NULL) d ON a.ep = d.doc_id""",
    # Most characters of a page of text
    "text_longest_turn": "SELECT src, I(max(n)) AS longest, count(*) AS turns FROM {speeches} a GROUP BY src",
    # Exclusive running sum of durations
    "text_timeline": "SELECT src, p, I(coalesce(sum(n) OVER (PARTITION BY src ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS starts, n FROM {speeches} a",
    # Frames by cumulative rounding, none of length 0
    "text_frames": """
        SELECT src, p, f0, f1 FROM (SELECT src, p, I(floor((c - n) / 75e0 * 30 + 5e-1)) AS f0, I(floor(c / 75e0 * 30 + 5e-1)) AS f1 FROM (
          SELECT src, p, n, sum(n) OVER (PARTITION BY src ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM {speeches} a) b) d WHERE f1 > f0""",
    # What fits into 600: whole pieces, the one across the limit cut, and of each that stays when it begins and ends
    "text_truncate": "SELECT src, p, I(least(n, 600 - c)) AS n, I(c) AS s, I(least(c + n, 600)) AS e FROM (SELECT src, p, n, coalesce(sum(n) OVER (PARTITION BY src ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM {speeches} a) b WHERE c < 600",
    # Captions that begin before the cut, their ends cut with it
    "text_truncate_captions": "SELECT src, p, R6(s) AS s, R6(least(e, 6e1)) AS e FROM {words} a WHERE s < 6e1",
    # Pages of three words that end punctuation or a gap over .3 s closes
    "text_caption_pages": """
        SELECT src, seg, sub, min(p) AS p0, max(p) AS p1, TEXTAGG(w, p, ' ') AS txt, R6(least(max(e) + 4e-1, max(nx))) AS until FROM (
          SELECT src, p, w, e, I(seg) AS seg, nx, I(floor((row_number() OVER (PARTITION BY src, seg ORDER BY p) - 1) / 3e0)) AS sub FROM (
            SELECT *, sum(brk) OVER (PARTITION BY src ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seg FROM (
              SELECT *, coalesce(lead(s) OVER (PARTITION BY src ORDER BY p), 1e9) AS nx, CASE WHEN RX(lag(w) OVER (PARTITION BY src ORDER BY p), '[.?!,]$') OR s - lag(e) OVER (PARTITION BY src ORDER BY p) > 3e-1 THEN 1 ELSE 0 END AS brk
              FROM {words} a) b) c) d GROUP BY src, seg, sub""",
    # Minutes and seconds in lines of text
    "text_mmss": "SELECT src, I(id) AS id, concat(STR(I(floor(floor(s + 5e-1) / 60))), ':', lpad(STR(I(floor(s + 5e-1) - floor(floor(s + 5e-1) / 60) * 60)), 2, '0'), ' ', txt) AS line FROM {sentences} a",
}
