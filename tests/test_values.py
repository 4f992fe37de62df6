"""Hand-computed cases: a moment's one span, probes, samples, stills, envelopes, timeouts, uploads, keys, pictures."""

import hashlib
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from spanloom.functions.canonical import canonical_json, short_key
from spanloom.operators import folds, frames, intervals, ranking, rules, text
from spanloom.operators.keyed import with_key
from spanloom.plans import catalog
from spanloom.plans.dialect import Relational


def run(spark, sql, **relations):
    for name, df in relations.items():
        df.createOrReplaceTempView(f"v_{name}")
    return Relational(sql, {**catalog.NAMED, **{k: f"SELECT * FROM v_{k}" for k in relations}})(spark).collect()


@pytest.fixture(scope="module")
def moments(spark):
    """Moment 1: two segments with a gap of 6 s between, 100 to 114 in all. Moment 2 has no candidate, moment 3 no length."""
    segments = spark.createDataFrame([(1, 1, 100.0, 102.0), (1, 1, 108.0, 114.0), (1, 2, 500.0, 510.0), (1, 3, 50.0, 50.0)], "src long, mid long, s double, e double")
    own = spark.createDataFrame([(1, 1, 100.0, 114.0, 0.5), (1, 2, 500.0, 510.0, None), (1, 3, 50.0, 50.0, 0.1), (2, 4, 0.0, 1.0, 0.2)], "src long, id long, s double, e double, perf double")
    # 1 covers the gap alone (6 of 14), 2 five seconds of the end (5 of 14), 3 a fourteenth, 4 all; the shortlist holds the ten best.
    found = [(1, 1, 9.0, 102.0, 108.0), (1, 2, 8.0, 109.0, 200.0), (1, 3, 7.0, 90.0, 101.0), (1, 4, 0.5, 0.0, 120.0)] + [(1, 10 + k, 5.0, 1000.0, 1010.0) for k in range(8)]
    return {"segments": segments, "moments": own, "candidates": spark.createDataFrame(found, "src long, id long, score double, s double, e double")}


def test_a_moment_is_judged_by_its_one_span(spark, moments):
    got = {(r.cid, r.mid): r.cover for r in run(spark, intervals.OPERATORS["span_overlap_ratio"], **moments)}
    assert {k: round(v * 14) for k, v in got.items()} == {(1, 1): 6, (2, 1): 5, (3, 1): 1, (4, 1): 14}
    assert [(r.mid, r.cid, r.cover) for r in run(spark, intervals.OPERATORS["span_best_match"], **moments)] == [(1, 4, 1.0)]
    assert sorted(r.id for r in run(spark, intervals.OPERATORS["span_matched_candidates"], **moments)) == [1, 2]  # 4 isn't in the shortlist
    one, two = sorted(run(spark, intervals.OPERATORS["span_eval"], **moments), key=lambda r: r.src)
    assert (one.n, one.found, round(one.recall * 3, 4), one.precision) == (3, 1, 1.0, 0.2) and (two.n, two.found, two.recall, two.precision) == (1, 0, 0.0, 0.0)
    shown = {r.mid: (r.s, r.e, r.cid, r.shortlisted, r.perf) for r in run(spark, intervals.OPERATORS["span_eval_rows"], **moments)}
    assert shown[1] == (100.0, 114.0, 4, False, 0.5) and shown[2] == (500.0, 510.0, None, False, 0.0) and shown[4] == (None, None, None, False, 0.2)


def test_the_query_of_matched_candidates_asks_all_of_them(spark, tmp_path):
    """Fourteen candidates that all match; the ten best are no bound."""
    rows = [(1, 7, "purchase", 100.0, "2024-01-01")] + [(2 + k, 7, "view", 90.0 + k, "2024-01-01") for k in range(14)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(f"{tmp_path}/events.parquet")
    assert sorted(r.id for r in catalog.QUERIES["span_matched_candidates"](spark, str(tmp_path)).collect()) == list(range(2, 16))


def test_a_piece_takes_the_shot_of_its_middle_then_of_its_start(spark):
    shots = spark.createDataFrame([(1, 1, 0.0, 4.0), (1, 2, 4.0, 9.0), (1, 3, 9.0, 20.0), (1, 4, 30.0, 40.0)], "src long, id long, s double, e double")
    pieces = spark.createDataFrame([(1, 1, 3.0, 8.0), (1, 2, 3.0, 5.0), (1, 3, 19.0, 29.0), (1, 4, 22.0, 24.0)], "src long, id long, s double, e double")
    got = {r.pid: (r.id, r.since) for r in run(spark, intervals.OPERATORS["span_point"], shots=shots, moments=pieces)}
    assert got == {1: (2, 4.0), 2: (1, 0.0), 3: (3, 9.0), 4: (None, 22.0)}  # a middle on a cut is in the first shot, ends are in


def test_samples_with_faces_go_before(spark):
    sample = lambda src, faces: [(src, i, float(i), f) for i, f in enumerate(faces)]
    rows = sample(1, [0, 1, 0, 1, 1, 0, 2, 1]) + sample(2, [1, 0, 0, 0, 0, 0, 0, 0, 0, 1]) + sample(3, [0, 0])
    got = {}
    for r in run(spark, intervals.OPERATORS["span_even_samples"], samples=spark.createDataFrame(rows, "src long, id long, t double, faces int")):
        got.setdefault(r.src, []).append((r.k, r.t))
    assert {k: sorted(v) for k, v in got.items()} == {1: list(enumerate([1.0, 3.0, 4.0, 6.0, 7.0])), 2: list(enumerate([1.0, 3.0, 5.0, 7.0, 9.0])), 3: [(0, 0.0), (2, 1.0)]}


def test_stills_of_a_check(spark):
    m = spark.createDataFrame([(1, 20.0), (2, 0.3), (3, 0.0)], "id long, dur double")
    got = {}
    for r in run(spark, intervals.OPERATORS["qc_stills"], measures=m):
        got.setdefault(r.id, []).append(r.t)
    assert got == {1: [0.5, 5.0, 12.0, 18.0], 2: [0.25, 0.075, 0.18, 0.25], 3: [0.0] * 4}


def test_envelopes(spark):
    """frames is a quarter of the score, frame the id modulo 27 less one."""
    cases = [(40.0, 1), (40.0, 2), (40.0, 3), (40.0, 10), (40.0, 12), (20.0, 1), (12.0, 2), (0.0, 1)]
    s = spark.createDataFrame([(1, 27 * k + i, v) for k, (v, i) in enumerate(cases)], "src long, id long, score double")
    got = [(r.frames, r.frame, r.volume, round(r.opacity, 4), r.entry) for r in sorted(run(spark, intervals.OPERATORS["span_envelopes"], spans=s), key=lambda r: r.id)]
    assert got == [(10, 0, 0.0, 1.0, 8), (10, 1, 0.5, 1.0, 8), (10, 2, 1.0, 1.0, 8), (10, 9, 0.5, 0.1667, 8), (10, 11, 0.0, 0.0, 8), (5, 0, 1.0, 1.0, 5), (3, 1, 1.0, 0.6667, 3), (0, 0, 1.0, 0.0, 1)]


def test_orphans_share_a_quarter_of_a_second(spark):
    """Two words of a cut share the piece's first .25 s; where the piece's own word begins after .1 s they share that."""
    pieces = spark.createDataFrame([(1, 0, 10.0, 12.0, 0.0), (2, 0, 10.0, 12.0, 5.0), (3, 0, 10.0, 10.2, 0.0)], "src long, k long, s double, e double, at double")
    words = [(1, 1, 8.0, 8.5), (1, 2, 9.0, 9.5), (1, 3, 10.5, 10.9), (2, 1, 8.0, 8.5), (2, 2, 10.1, 10.4), (3, 1, 9.0, 9.2)]
    got = {(r.src, r.p): (round(r.s, 4), round(r.e, 4)) for r in folds.place_words(spark.createDataFrame(words, "src long, p long, s double, e double"), pieces).collect()}
    assert got == {(1, 1): (0.0, 0.125), (1, 2): (0.125, 0.25), (1, 3): (0.5, 0.9), (2, 1): (5.0, 5.1), (2, 2): (5.1, 5.4), (3, 1): (0.0, 0.2)}


def test_timeouts(spark):
    t = spark.createDataFrame([(1, None, " "), (2, "2", "90"), (3, "soon", "-1"), (4, "30", "10"), (5, "nan", None)], "id long, stall_raw string, hard_raw string")
    got = {r.id: (r.stall_ms, r.hard_ms, r.warnings) for r in run(spark, rules.OPERATORS["render_timeouts"], timeouts=t)}
    assert got[1] == (3e5, 36e5, "") and got[2] == (12e4, 54e5, "") and got[4] == (6e5, 6e5, "") and got[5][:2] == (3e5, 36e5)
    assert got[3] == (3e5, 36e5, 'stall="soon" is not a positive number of minutes - using 5\ntimeout="-1" is not a positive number of minutes - using 60')


def test_uploads_and_attributions(spark):
    u = spark.createDataFrame([(1, "  " + "a" * 92 + " ", "#x", None), (2, "b" * 93, "y#", "now"), (3, "c" * 150, "##z", None)], "id long, title string, tag string, due string")
    got = {r.id: (r.title, r.tag) for r in run(spark, rules.OPERATORS["upload_requests"], uploads=u)}
    assert got == {1: ("a" * 92 + " #shorts", "x"), 2: ("b" * 93, "y#"), 3: ("c" * 100, "#z")}
    a = spark.createDataFrame([(1, "T", "N", "v1", "https://h/?list=1"), (2, "T", "N", None, None)], "id long, title string, name string, video string, url string")
    assert {r.id: r.t for r in run(spark, rules.OPERATORS["attributions"], attributed=a)} == {1: '\n\nFrom "T" — N\nFull episode: https://www.youtube.com/watch?v=v1', 2: '\n\nFrom "T" — N\nFull episode: '}


def test_prompt_blocks(spark):
    o = spark.createDataFrame([(k, "c", float(30 + k), 1, 0, 1, [1.005, -0.5, 2.0][k % 3]) for k in range(12)], "id long, creator string, dur double, cold int, tightened int, paused int, y double")
    (r,) = run(spark, ranking.OPERATORS["rank_audience_block"], outcomes=o)
    lines = r.block.split("\n")
    assert lines[1] == '- "Short 2" (perf 2.00 vs channel median)' and len(lines) == 13 and lines[9] == '- "Short 1" (perf -0.50 vs channel median)' and lines[11:] == ["", ""]
    d = spark.createDataFrame([(1, "said\nso")], "doc_id long, text string")
    text_ = Relational(ranking.OPERATORS["rank_example_blocks"], {**catalog.NAMED, "outcomes": "SELECT * FROM v_outcomes"})
    assert text_(spark, documents=d).first().block == "### 1 perf=-0.50 dur=31s coldOpen=true tightened=false startsAfterPause=true\nSHORT: said\nso"
    s = spark.createDataFrame([(1, 0, 0.0, "A."), (1, 1, 61.9, "B."), (1, 20, 3600.0, "C.")], "src long, id long, s double, txt string")
    assert {r.part: r.block for r in run(spark, text.OPERATORS["text_format_window"], sentences=s)} == {0: "[0] (0:00) A.\n[1] (1:01) B.", 1: "[20] (60:00) C."}


def test_canonical_json_doesnt_depend_on_order(spark):
    kinds = "b struct<z:double,a:array<string>>, a long, m map<string,int>, t string"
    row = ((1.0, ["x", None, 'q"\n\\é']), 7, {"k2": 2, "k1": None}, None)
    df = spark.createDataFrame([row, ((float("nan"), None), None, None, "")], kinds)
    out = df.select(canonical_json(F.struct("b", "a", "m", "t"), df.schema).alias("j"), canonical_json(F.struct("t", "m", "b", "a"), StructType([df.schema[k] for k in ("t", "m", "b", "a")])).alias("k")).collect()
    want = json.dumps({"a": 7, "b": {"a": ["x", None, 'q"\n\\é'], "z": 1}, "m": {"k1": None, "k2": 2}, "t": None}, ensure_ascii=False, separators=(",", ":"))
    assert [r.j for r in out] == [r.k for r in out] == [want, '{"a":null,"b":{"a":null,"z":null},"m":null,"t":""}']
    keyed = with_key(df, "a", "b").select("key", short_key(F.lit("abc")).alias("s")).first()
    assert keyed.key == hashlib.sha256('{"a":7,"b":{"a":["x",null,"q\\"\\n\\\\é"],"z":1}}'.encode()).hexdigest() and keyed.s == hashlib.sha1(b"abc").hexdigest()[:12]


@pytest.mark.parametrize("w,h,tw,th", [(4, 4, 2, 2), (7, 5, 3, 2), (3, 2, 5, 4)])
def test_thumbs_are_means_of_blocks(spark, w, h, tw, th):
    a = np.random.default_rng(w).integers(0, 256, (h, w, 3))
    want = []
    for ty in range(th):
        for tx in range(tw):
            y, x = ty * h // th, tx * w // tw
            block = a[y : max(y + 1, (ty + 1) * h // th), x : max(x + 1, (tx + 1) * w // tw)].reshape(-1, 3)
            want.append(math.floor(int((block @ np.array([299, 587, 114])).sum()) / (len(block) * 1000) + 0.5))
    df = spark.createDataFrame([([int(v) for v in a.ravel()],)], "rgb array<int>")
    assert df.select(frames.gray_thumb("rgb", w, h, tw, th)).first()[0] == want


def test_boxes_pad_evenly_and_put_colours_apart(spark):
    rgb = list(range(2 * 2 * 3))
    df = spark.createDataFrame([(rgb,)], "rgb array<int>")
    got = np.array(df.select(frames.letterbox("rgb", 2, 2, 2, 5)).first()[0]).reshape(3, 5, 2)
    want = np.full((3, 5, 2), -127 / 128)
    want[:, 1:3] = (np.array(rgb).reshape(2, 2, 3).transpose(2, 0, 1) - 127) / 128
    assert (got == want).all()
    got = np.array(df.select(frames.pillarbox("rgb", 2, 2, 6, 2)).first()[0]).reshape(3, 2, 6)
    assert (got[:, :, 2:4] == want[:, 1:3]).all() and (got[:, :, :2] == -127 / 128).all()
    for bad in (lambda: frames.letterbox("rgb", 3, 2, 2, 5), lambda: frames.letterbox("rgb", 2, 6, 2, 5), lambda: frames.pillarbox("rgb", 2, 3, 6, 2)):
        with pytest.raises(ValueError, match="wanted|fit"):
            bad()
