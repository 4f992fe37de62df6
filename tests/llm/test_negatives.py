"""Hard negatives against scoring every pair, and on edges."""

import math
import random

import numpy as np
import pytest

from spanloom.llm import negatives
from spanloom.llm.negatives import Block, approximations, hard_negatives, usable

SCHEMA = "vec_id long, embedding array<float>, label int, score double, id string"


def table(spark, rows, partitions=3):
    return spark.createDataFrame([(*r, 0.5, "x") for r in rows], SCHEMA).repartition(partitions)


def brute(rows, positives=5, count=3):
    """rows: distinct vec_ids."""
    own = [(i, [math.floor(256 * float(np.float32(x))) for x in v], y) for i, v, y in rows if None not in (i, v, y) and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for i, v, y in own:
        if i % 50:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(v, w, strict=True)), j, z) for j, w, z in own if j != i and len(w) == len(v)))
        for p, j, _ in [s for s in scored if s[2] == y][:positives]:
            fit = [(n, k) for n, k, z in scored if z != y and 50 * -p <= 100 * -n <= 95 * -p]
            out |= {(i, j, r + 1, k, -p, -n) for r, (n, k) in enumerate(fit[:count])}
    return out


def vectors(seed, n, dims=6, labels=3):
    r = random.Random(seed)
    centre = [[r.gauss(0, 0.3) for _ in range(dims)] for _ in range(4)]
    return [(i, [c + r.gauss(0, 0.2) for c in r.choice(centre)], r.randrange(labels)) for i in range(n)]


def edges(dims=6):
    bad = [0.1] * dims
    return [(900, None, 1), (901, bad, None), (902, [*bad[1:], None], 1), (903, [*bad[1:], math.nan], 1), (904, [*bad[1:], math.inf], 1), (None, bad, 1), (950, [0.0] * dims, 1), (951, [0.3], 0), (1000, [0.4], 0), (1001, [0.2], 1), (1050, [], 2), (1051, [], 2), (1052, [], 1)]


@pytest.mark.parametrize("seed,limit", [(1, None), (2, 3)])
def test_against_every_pair(spark, monkeypatch, seed, limit):
    """limit: passes of a few anchors; equal vectors make ties."""
    if limit:
        monkeypatch.setattr(negatives, "PASS", limit)
    rows = vectors(seed, 400)
    rows += [(500 + k, rows[50][1], k % 3) for k in range(60)] + edges()
    got = [tuple(r) for r in hard_negatives(table(spark, rows)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows) and got


def test_nothing_and_repeated_rows(spark):
    assert hard_negatives(table(spark, [])).collect() == []
    rows = vectors(3, 120)
    once = sorted(map(tuple, hard_negatives(table(spark, rows)).collect()))
    assert sorted(map(tuple, hard_negatives(table(spark, rows + rows[:60])).collect())) == once


def test_scores_beyond_doubles_are_exact(spark):
    big = 2.0**22
    rows = [(0, [big, 1.0], 0), (1, [big, 0.0], 0), *((k, [big * 0.75, float(-k)], 1) for k in range(2, 9))]
    assert {tuple(r) for r in hard_negatives(table(spark, rows, 1)).collect()} == brute(rows)
    huge = [(0, [3e38, 1.0], 0), (1, [3e38, 0.0], 0), (2, [3e38, 5.0], 1)]
    assert hard_negatives(table(spark, huge, 1)).collect() == []  # all scores are the largest long


def test_bounds_hold_every_score_and_are_narrow(spark):
    for row in approximations(usable(table(spark, vectors(5, 300), 1))).toArrow().to_pylist():
        block = Block(row)
        anchors = block.v[:20]
        low, high = block.bounds(anchors, np.arange(len(block.ids)))
        exact = anchors @ block.v.T
        assert (low <= exact).all() and (exact <= high).all() and (high - low).mean() < exact.std() / 2


def test_bounds_are_products_with_what_cells_leave(spark):
    """The same bounds as the sums of each cell's least and largest product, and none that isn't a number where products leave the doubles."""
    r = np.random.default_rng(1)
    row = approximations(usable(spark.createDataFrame([(i, [float(x) for x in v], 1) for i, v in enumerate(r.normal(0, 0.2, (512, 64)))], "vec_id long, embedding array<double>, label int").coalesce(1))).collect()[0].asDict()
    block, rows = Block(row), np.arange(row["n"])
    anchors = np.floor(256 * r.normal(0, 0.2, (64, 64)))
    low, high = block.bounds(anchors, rows)
    d = np.arange(64)[:, None]
    ends = anchors[:, :, None, None] * block.marks[d, block.cells].transpose(0, 1, 2)[None]
    assert (low == ends.min(3).sum(1)).all() and (high == ends.max(3).sum(1)).all()
    exact = anchors @ block.v.T
    assert (low <= exact).all() and (exact <= high).all()
    huge = Block({**row, "vectors": (block.v * 1e305).tobytes(), "marks": (block.marks * 1e305).tobytes()})
    with np.errstate(all="ignore"):
        low, high = huge.bounds(anchors * 1e305, rows)
    assert not np.isnan(low).any() and not np.isnan(high).any() and (low <= high).all()
