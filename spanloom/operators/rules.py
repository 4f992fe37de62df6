"""Ledgers, checks, verdicts, publishing and review."""

OPERATORS = {
    # The ledger by purpose, and in all
    "ledger_summary": "SELECT purpose, count(*) AS calls, I(sum(CASE WHEN cached THEN 1 ELSE 0 END)) AS cached, R6(sum(cost)) AS cost FROM {ledger} l GROUP BY GROUPING SETS ((purpose), ())",
    # What was spent between two points
    "ledger_delta": "SELECT purpose, R6(sum(CASE WHEN since < x.m THEN cost ELSE 0e0 END)) AS before, R6(sum(CASE WHEN since >= x.m THEN cost ELSE 0e0 END)) AS after FROM {ledger} l, (SELECT (min(since) + max(since)) / 2 AS m FROM {ledger} y) x GROUP BY purpose",
    "ledger_cost": "SELECT purpose, R6(avg(cost)) AS mean_cost, R6(avg(ms)) AS mean_ms FROM {ledger} l GROUP BY purpose",  # D27
    # Every status, with 0 where none has it
    "clip_status_counts": """
        SELECT s.status, coalesce(n, 0) AS n FROM (SELECT 'planned' AS status UNION ALL SELECT 'rendered' UNION ALL SELECT 'qc_failed' UNION ALL SELECT 'ready' UNION ALL SELECT 'approved' UNION ALL SELECT 'rejected' UNION ALL SELECT 'published' UNION ALL SELECT 'all') s
        LEFT JOIN (SELECT coalesce(status, 'all') AS status, count(*) AS n FROM {clips} c GROUP BY GROUPING SETS ((status), ())) k ON s.status = k.status""",
    # Clips of one status, the oldest first
    "clip_list": "SELECT id, status, hours AS age FROM {clips} c WHERE status = 'ready' ORDER BY hours DESC, id",
    # B1: what a list shows: how many segments, title, and the lengths that suit the creator; null where one isn't found
    "clip_api": """
        SELECT c.id, c.status, c.creator, d.n_chars, segments, d.text AS title, ideal_lo, ideal_hi FROM {clips} c LEFT JOIN {documents} d ON c.id = d.doc_id LEFT JOIN (SELECT id AS k, count(*) AS segments FROM {face_checks} f GROUP BY id) g ON c.id = g.k
        LEFT JOIN (SELECT creator AS who, q1 AS ideal_lo, q3 AS ideal_hi FROM {playbook} p WHERE n >= 3) p ON c.creator = p.who""",
    # Who may be published, and why others may not: public ones, not approved ones, QC without override, the daily cap
    # less what went public within a day; the cap's places go in the clips' order
    "publish_eligible": """
        SELECT id, CASE WHEN public THEN 'already published' WHEN status <> 'approved' THEN 'not approved' WHEN NOT passed AND NOT forced THEN 'qc' WHEN r > greatest(0, cap - recent) THEN 'cap' ELSE 'ok' END AS reason FROM (
          SELECT a.*, cap, recent, sum(CASE WHEN NOT public AND status = 'approved' AND (passed OR forced) THEN 1 ELSE 0 END) OVER (PARTITION BY creator ORDER BY id) AS r FROM {publishing} a
          JOIN (SELECT creator AS k, I(sum(CASE WHEN NOT dry AND hours < 24 THEN 1 ELSE 0 END)) AS recent, 40 AS cap FROM {publishing} b GROUP BY creator) c ON creator = k) d""",
    # What a request makes of a clip: its status and code, and why it is refused; nothing changes then
    "review_transitions": """
        SELECT id, act, status, CASE WHEN code = 200 AND act = 'approve' THEN 'approved' WHEN code = 200 AND act = 'reject' THEN 'rejected' WHEN code = 200 AND act = 'hook' THEN 'planned' ELSE status END AS next, code,
          CASE WHEN code = 200 AND act = 'approve' AND status = 'qc_failed' THEN concat('override: ', reason) WHEN code = 200 AND act = 'reject' THEN reason END AS review
        FROM (SELECT r.*, CASE
          WHEN act = 'approve' THEN CASE WHEN status = 'ready' OR status = 'qc_failed' AND forced THEN 200 ELSE 409 END
          WHEN act = 'reject' THEN CASE WHEN reason = '' THEN 400 WHEN status = 'published' THEN 409 ELSE 200 END
          WHEN act = 'hook' THEN CASE WHEN public THEN 409 WHEN n IS NULL OR n < 0 OR n >= hooks OR n <> floor(n) THEN 400 ELSE 200 END
          WHEN act = 'title' THEN CASE WHEN reason = '' OR length(reason) > 100 THEN 400 ELSE 200 END
          WHEN act = 'schedule' THEN CASE WHEN status = 'published' THEN 409 WHEN due IS NULL OR DAYOF(due) IS NOT NULL THEN 200 ELSE 400 END ELSE 404 END AS code FROM {requests} r) x""",
    # A daily cap from text: blank is 10; what is no number from 0 up is an error
    "publish_cap": "SELECT id, raw, CASE WHEN trim(raw) = '' THEN 10e0 WHEN TRYD(trim(raw)) >= 0 AND NOT isnan(TRYD(trim(raw))) THEN TRYD(trim(raw)) END AS cap, NOT coalesce(trim(raw) = '' OR TRYD(trim(raw)) >= 0 AND NOT isnan(TRYD(trim(raw))), false) AS error FROM {caps} c",
    # What to do about a delivered loudness: once more with a lower peak, then never again
    "master_retry": "SELECT id, CASE WHEN lufs BETWEEN -155e-1 AND -125e-1 AND tp <= -1 THEN 'accept' WHEN NOT retried THEN 'retry' ELSE 'fail' END AS plan, CASE WHEN NOT (lufs BETWEEN -155e-1 AND -125e-1 AND tp <= -1) AND NOT retried THEN -3e0 END AS next_tp FROM {mastered} m",
    # Lengths in bounds, in order
    "clamp_duration": "SELECT id, least(a, b) AS lo, greatest(a, b) AS hi FROM (SELECT id, greatest(12e0, least(180e0, dur)) AS a, greatest(12e0, least(180e0, hours)) AS b FROM {clips} c) x",
    # Timeouts from texts, in minutes: what is no positive number gives the default, and a warning if it isn't blank; a stall is no longer than all
    "render_timeouts": """
        SELECT id, least(stall, hard) * 6e4 AS stall_ms, hard * 6e4 AS hard_ms,
          concat(CASE WHEN NOT stall_ok THEN concat('stall="', stall_raw, '" is not a positive number of minutes - using 5') ELSE '' END, CASE WHEN NOT stall_ok AND NOT hard_ok THEN chr(10) ELSE '' END,
            CASE WHEN NOT hard_ok THEN concat('timeout="', hard_raw, '" is not a positive number of minutes - using 60') ELSE '' END) AS warnings
        FROM (SELECT id, stall_raw, hard_raw, CASE WHEN stall_n > 0 AND stall_n < 1e300 THEN stall_n ELSE 5e0 END AS stall, CASE WHEN hard_n > 0 AND hard_n < 1e300 THEN hard_n ELSE 6e1 END AS hard,
            coalesce(trim(stall_raw), '') = '' OR coalesce(stall_n > 0 AND stall_n < 1e300, false) AS stall_ok, coalesce(trim(hard_raw), '') = '' OR coalesce(hard_n > 0 AND hard_n < 1e300, false) AS hard_ok
          FROM (SELECT *, TRYD(trim(stall_raw)) AS stall_n, TRYD(trim(hard_raw)) AS hard_n FROM {timeouts} t) a) b""",
    # What an upload asks for: a title of 100 characters at most, marked where that fits, tags without their mark; always private, at a time if one is given
    "upload_requests": """
        SELECT id, CASE WHEN length(cut) + 8 <= 100 THEN concat(cut, ' #shorts') ELSE cut END AS title, STRIP(tag, '^#', '') AS tag, 'private' AS privacy, due AS publish_at FROM (SELECT id, substr(trim(title), 1, 100) AS cut, tag, due FROM {uploads} u) a""",
    # The attribution that ends a description, with the plain address of a video whose id is known
    "attributions": "SELECT id, concat(chr(10), chr(10), 'From \"', title, '\" — ', name, chr(10), 'Full episode: ', CASE WHEN video IS NOT NULL THEN concat('https://www.youtube.com/watch?v=', video) ELSE coalesce(url, '') END) AS t FROM {attributed} a",
    # A description of 4,900 characters at most; only the body before its last attribution is cut, and marked. An
    # attribution too long by itself is what stays, from its start
    "clamp_description": """
        SELECT id, CASE WHEN length(t) <= 4900 THEN t WHEN mark = 0 THEN concat(substr(t, 1, 4899), '…') WHEN length(t) - mark + 1 >= 4900 THEN substr(t, mark, 4900)
          ELSE concat(substr(t, 1, I(4899 - (length(t) - mark + 1))), '…', substr(t, mark)) END AS description
        FROM (SELECT id, t, LASTOF(t, concat(chr(10), chr(10), 'From "')) AS mark FROM {descriptions} d) x""",
    # H8: keys of caches
    "cache_keys": "SELECT doc_id AS id, SHA256(coalesce(text, '')) AS h FROM {documents}",
    # Rows with and without their clip
    "stats_attach": "SELECT l.doc_id AS id, c.id IS NULL AS missing, c.views FROM {labels} l LEFT JOIN {clips} c ON l.doc_id = c.id AND c.hours >= 72",
    # Half up
    "round3": "SELECT event_id AS id, floor(value * 1e3 + 5e-1) / 1e3 AS r FROM {events}",
}
