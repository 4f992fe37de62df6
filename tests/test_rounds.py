"""Suppression in rounds and windows by doubling, against looking at one row after the other."""

import random

import pytest

from spanloom.operators import chains, folds
from spanloom.operators.suppression import suppress

SPAN = "src long, id long, score double, s double, e double"


def greedy(rows, iou):
    kept = {}
    for r in sorted(rows, key=lambda r: (r[2] is None, -(r[2] or 0), r[1], r[3], r[4])):
        mine = kept.setdefault(r[0], [])
        both = lambda x: min(r[4], x[4]) - max(r[3], x[3])  # noqa: E731, B023
        if all(both(x) <= 0 or both(x) < iou * (max(r[4], x[4]) - min(r[3], x[3])) for x in mine):  # noqa: B023
            mine.append(r)
    return sorted(r for x in kept.values() for r in x)


@pytest.mark.parametrize("seed,iou", [(1, 0.5), (2, 0.3), (3, 0.75)])
def test_local_winners_are_those_of_one_pass(spark, seed, iou):
    r = random.Random(seed)
    rows = []
    for i in range(900):
        s = r.choice([r.uniform(0, 200), float(r.randint(0, 40))])
        rows.append((r.randint(0, 2), i, float(r.randint(0, 15)), s, s + r.choice([r.uniform(0.01, 90), 8.0, 16.0, 32.0, 0.0])))
    assert sorted(tuple(x) for x in suppress(spark.createDataFrame(rows, SPAN).repartition(5), iou).collect()) == greedy(rows, iou)


def test_a_crowd_in_one_place_and_equal_rows(spark):
    """Half of all spans lie about one place, and of spans of equal bounds one stays, with its own columns."""
    r = random.Random(7)
    rows = [(1, i, r.random(), 1000 + r.uniform(0, 3), 1060 + r.uniform(0, 3)) for i in range(1500)]
    rows += [(1, 5000 + i, r.random(), 100.0 * i, 100.0 * i + 60) for i in range(20)] + [(2, 9000 + i, 0.5, 5.0, 9.0) for i in range(1000)]
    got = sorted(tuple(x) for x in suppress(spark.createDataFrame(rows, SPAN)).collect())
    assert got == greedy(rows, 0.5) and [x[1] for x in got if x[0] == 2] == [9000]


def test_spans_without_a_score_a_bound_a_source_or_a_length(spark):
    rows = [(1, 1, None, 0.0, 10.0, "a"), (1, 2, -5.0, 1.0, 10.0, "b"), (1, 3, 9.0, 4.0, 4.0, "c"), (1, 4, 9.0, None, 4.0, "d"), (None, 5, 1.0, 0.0, 10.0, "e"), (None, 6, 2.0, 0.0, 10.0, "f"), (1, 7, 1.0, 1e9, 1e9 + 1e-3, "g")]
    df = spark.createDataFrame(rows, SPAN + ", p string")
    assert sorted(x.p for x in suppress(df).collect()) == ["b", "c", "d", "f", "g"]
    assert suppress(df.filter("id < 0")).collect() == []


def one_by_one(starts, length, step):
    out, i, n = [], 0, len(starts)
    while True:
        last = max(k for k in range(n) if k == i or starts[k] < starts[i] + length)
        out.append((i, last))
        if last == n - 1:
            return out
        i = next((k for k in range(n) if starts[k] >= starts[i] + step), n - 1)


@pytest.mark.parametrize("length,overlap", [(100.0, 20.0), (100.0, 0.0), (30.0, 29.0), (50.0, -40.0)])
def test_windows_are_those_of_stepping(spark, length, overlap):
    r = random.Random(5)
    rows, want = [], []
    for src in range(25):
        t, starts = 0.0, []
        for _ in range(r.choice([1, 2, 7, 90])):
            starts.append(t)
            t += r.choice([0.0, 1.0, 5.0, 20.0, 130.0])
        rows += [(src, k, x) for k, x in enumerate(starts)]
        want += [(src, a, b) for a, b in one_by_one(starts, length, length - overlap)]
    got = chains.windows(spark.createDataFrame(rows, "src long, id long, s double").repartition(3), length, overlap)
    assert sorted(tuple(x) for x in got.collect()) == sorted(want)


def test_windows_end_with_the_last_sentence_and_need_a_step(spark):
    df = spark.createDataFrame([(1, i, i * 30.0) for i in range(20)], "src long, id long, s double")
    assert sorted((x.first, x.last) for x in folds.windows(df, 600.0, 60.0).collect()) == [(0, 19)]  # the second would hold nothing new
    with pytest.raises(ValueError, match="longer than its overlap"):
        chains.windows(df, 60.0, 60.0)
    assert chains.windows(df.filter("id < 0")).collect() == []


def test_links_are_followed_from_their_starts_alone(spark):
    links = spark.createDataFrame([(1, k, k + 3) for k in range(200)] + [(2, 0, 1), (2, 5, 6)], "src long, i long, j long")
    starts = spark.createDataFrame([(1, 0), (2, 0), (2, 0)], "src long, i long")
    got = sorted(tuple(x) for x in chains.follow(links, starts).collect())
    assert got == [(1, k) for k in range(0, 203, 3)] + [(2, 0), (2, 1)]
