"""Checks of a rendered clip, the verdict on it, and the fixes that a round of repairs makes.

Inputs are the relations measures, face_checks and fix_context of plans/views.py; the texts hold no data of their own."""

#: name, severity, condition, and when the check is made at all.
# Names of checks, how bad a failure is, and the limits that they are judged by.
_CHECKS = (
    ("resolution", "error", "width = 1080 AND height = 1920", ""),
    ("codec", "error", "vcodec = 'h264' AND pix_fmt = 'yuv420p'", ""),
    ("fps", "error", "abs(fps - 30) < 1e-2", ""),
    ("audio", "error", "coalesce(acodec = 'aac', false)", ""),
    ("duration", "error", "abs(dur - want) <= 25e-2", ""),
    ("loudness", "error", "lufs BETWEEN -155e-1 AND -125e-1", ""),
    ("true_peak", "error", "tp <= -1", ""),
    ("dead_air", "error", "silence < 12e-1", ""),
    ("black_frames", "error", "black < 5e-1", ""),
    ("frozen_video", "warn", "frozen < 25e-1", ""),
    ("framing", "error", "framed >= 6e-1", "framed IS NOT NULL"),
    ("captions_length", "warn", "caption_chars <= 24", ""),
    ("standalone", "warn", "standalone", "judged"),
    ("clean_ending", "error", "clean_ending", "judged"),
    ("hook_matches", "error", "hook_matches", "judged"),
    ("content_issues", "warn", "NOT issues", "judged"),
    ("vision_framing", "warn", "framing_ok", "seen"),
    ("vision_captions", "warn", "captions_ok", "seen"),
    ("vision_verdict", "error", "verdict = 'keep'", "seen"),
)

_NAMES = " UNION ALL ".join(f"SELECT '{n}' AS name, '{s}' AS severity" for n, s, *_ in _CHECKS)
_OK = " ".join(f"WHEN '{n}' THEN " + (f"CASE WHEN {when} THEN {ok} END" if when else ok) for n, _, ok, when in _CHECKS)

#: The longest of a clip's silences, black and frozen stretches stand for all; faces that are framed count by share.
_TOLD = f"""SELECT id, name, severity, ok FROM (SELECT m.id, n.name, n.severity, CASE n.name {_OK} END AS ok
    FROM (SELECT x.*, framed FROM {{measures}} x LEFT JOIN (SELECT id AS k, avg(CASE WHEN ok THEN 1e0 ELSE 0e0 END) AS framed FROM {{face_checks}} y GROUP BY id) f ON x.id = f.k) m, ({_NAMES}) n) c WHERE ok IS NOT NULL"""


def _failing(name: str) -> str:
    return f"max(CASE WHEN name = '{name}' AND NOT ok THEN 1 ELSE 0 END) = 1"


#: What fails, and what may be done: a later end within 1.15 times the longest, a later start that leaves the shortest.
_STATE = f"""SELECT f.*, c.*, coalesce(m.seen AND m.verdict <> 'keep', false) AS vis, coalesce(m.covers, false) AS covers, coalesce(g.bad, 0) AS bad,
      coalesce(next_end - s <= hi * 115e-2, false) AS may_extend, coalesce(next_start < e AND e - next_start >= lo, false) AS may_trim, hook_index + 1 < hook_count AS may_hook, style <> 'hook-high' AS may_move
    FROM (SELECT id AS k, {", ".join(f"{_failing(n)} AS {a}" for n, a in (("loudness", "f_loud"), ("true_peak", "f_peak"), ("clean_ending", "f_end"), ("hook_matches", "f_hook"), ("framing", "f_frame"), ("dead_air", "f_dead")))} FROM ({_TOLD}) t GROUP BY id) f
    JOIN {{fix_context}} c ON f.k = c.id JOIN (SELECT id AS mk, seen, verdict, covers FROM {{measures}} z) m ON f.k = m.mk
    LEFT JOIN (SELECT id AS gk, sum(CASE WHEN ok THEN 0 ELSE 1 END) AS bad FROM {{face_checks}} w GROUP BY id) g ON f.k = g.gk"""


def _turns() -> str:
    """One bounds change and one hook change a round at most: each step sees whether the steps before took them."""
    text = f"SELECT *, f_end AND may_extend AS b0, f_hook AND may_hook AS g0 FROM ({_STATE}) s0"
    text = f"SELECT *, vis AND covers AND may_move AND NOT g0 AS move0, b0 AS b1, g0 OR vis AND covers AND may_move AS g1 FROM ({text}) s1"
    for k in (1, 2, 3):
        steps = {
            "extend": f"vis AND coalesce(v{k} = 'extend_end', false) AND NOT b{k} AND may_extend",
            "trim": f"vis AND coalesce(v{k} = 'trim_start', false) AND NOT b{k} AND may_trim",
            "next": f"vis AND coalesce(v{k} = 'next_hook', false) AND NOT g{k} AND may_hook",
            "move": f"vis AND coalesce(v{k} = 'move_hook_up', false) AND NOT g{k} AND may_move",
            "layout": f"vis AND coalesce(v{k} = 'fit_layout', false)",
        }
        taken = f"b{k} OR {steps['extend']} OR {steps['trim']} AS b{k + 1}, g{k} OR {steps['next']} OR {steps['move']} AS g{k + 1}"
        text = f"SELECT *, {', '.join(f'{c} AS {n}{k}' for n, c in steps.items())}, {taken} FROM ({text}) s{k + 1}"
    return text


_STEPS = [("f_loud OR f_peak", "remaster"), ("b0", "extend_end"), ("g0", "next_hook"), ("f_dead AND history <> 'loosen_pauses'", "loosen_pauses"), ("move0", "move_hook_up")]
_STEPS += [(f"{n}{k}", kind) for k in (1, 2, 3) for n, kind in (("extend", "extend_end"), ("trim", "trim_start"), ("next", "next_hook"), ("move", "move_hook_up"))]

#: Segments that aren't fitted yet: those with a bad face where framing fails, and where the critic asks for it; all, where no face is bad.
_SEGMENTS = "SELECT f.id AS sk, TEXTAGG(STR(f.segment), f.segment, ' ') AS segments FROM (SELECT DISTINCT id, segment, ok FROM {face_checks} q WHERE NOT fit) f JOIN {fix_turns} t ON f.id = t.id WHERE f_frame AND NOT ok OR (layout1 OR layout2 OR layout3) AND (NOT ok OR bad = 0) GROUP BY f.id"

VIEWS = {
    "checks": _TOLD,
    "fix_turns": _turns(),
    "fix_segments": _SEGMENTS,
    "fix_plans": "SELECT t.*, segments, concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for c, n in _STEPS) + ", CASE WHEN segments IS NOT NULL THEN concat('fit_segments ', segments) END) AS plan FROM {fix_turns} t LEFT JOIN {fix_segments} g ON t.id = g.sk",
}

_EXTENDS, _TRIMS = "(b0 OR extend1 OR extend2 OR extend3)", "(trim1 OR trim2 OR trim3)"

OPERATORS = {
    "qc_checks": "SELECT id, name, severity, ok FROM {checks} c",  # K1, K2
    # K3: no failing check that is an error
    "qc_verdict": "SELECT id, BOOLAND(ok OR severity <> 'error') AS ok, I(sum(CASE WHEN ok THEN 0 ELSE 1 END)) AS failed, count(*) AS checks FROM {checks} c GROUP BY id",
    # All fixes of a round that go together, in their order
    "qc_fix_plan": "SELECT id, plan FROM {fix_plans} p",
    # K5: what they make of the clip
    "qc_fix_applied": f"""
        SELECT id, R6(CASE WHEN {_TRIMS} THEN next_start ELSE s END) AS s, R6(CASE WHEN {_EXTENDS} THEN next_end ELSE e END) AS e, hook_index + CASE WHEN plan LIKE '%next_hook%' THEN 1 ELSE 0 END AS hook_index,
          CASE WHEN plan LIKE '%move_hook_up%' THEN 'hook-high' ELSE style END AS style, coalesce(segments, '') AS fitted, plan LIKE '%loosen_pauses%' AS loosened,
          concat_ws(',', CASE WHEN history <> '' THEN history END, CASE WHEN plan <> '' THEN STRIP(plan, ' [0-9 ]+$', '') END) AS history, plan <> '' AS again FROM {{fix_plans}} p""",
}
