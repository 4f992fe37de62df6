"""All queries outside spanloom.llm by name, and the SQL that says the same."""

from __future__ import annotations

from spanloom.operators import evaluation, folds, frames, intervals, keyed, learning, quality, ranking, rules, selection, text
from spanloom.plans import inplace
from spanloom.plans.dialect import Relational, Twofold
from spanloom.plans.views import VIEWS
from spanloom.sources import queries as sources, stored

NAMED = {**VIEWS, **quality.VIEWS, "aligned": Twofold(text.OPERATORS["mine_align"], inplace.aligned(text.OPERATORS["mine_align"])), "visuals": intervals.OPERATORS["span_visual"], "faceless": intervals.OPERATORS["span_longest_run"], "cut_rates": intervals.OPERATORS["span_cuts"], "transcript_stats": text.OPERATORS["text_transcript_stats"], "playbook": learning.OPERATORS["learn_stats"]}
INPLACE = {**inplace.OPERATORS, "mine_align": NAMED["aligned"].spark}
RELATIONAL: dict[str, Relational] = {k: Relational(Twofold(v, INPLACE[k]) if k in INPLACE else v, NAMED | intervals.WHOLE.get(k, {})) for m in (text, intervals, ranking, learning, rules, quality) for k, v in m.OPERATORS.items()}

OTHERS = (folds, evaluation, frames, keyed, selection, sources, stored)
QUERIES: dict = {**RELATIONAL, **{k: q for m in OTHERS for k, q in m.QUERIES.items()}}
ORACLE: dict[str, str] = {**{k: q.ansi() for k, q in RELATIONAL.items()}, **intervals.ORACLE, **{k: q for m in OTHERS for k, q in m.ORACLE.items()}}
