"""Importance resampling against a plain count of features, and on edges."""

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import pytest

from spanloom.llm import resampling
from spanloom.llm.resampling import resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, score double, rank string, n_words int"


def features(text):
    w = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    return w, [*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))]


def brute(docs, target, percent=25, least=20):
    """(doc_id, n_features, weight, score, rank) by doc_id; doc_ids are distinct."""
    total = [Counter(crc32(f.encode()) % 10000 for t in ts for f in features(t)[1]) for ts in ([t for _, t in docs], target)]
    s, t = total
    gain = [math.floor(1000 * math.log((t[k] + 1) * (s.total() + 10000) / ((s[k] + 1) * (t.total() + 10000)))) for k in range(10000)]
    out = {}
    for i, text in docs:
        w, f = features(text)
        weight = sum(gain[crc32(x.encode()) % 10000] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
        out[i] = [len(w), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))]
    drawn = sorted((i for i in out if out[i][0] >= least), key=lambda i: (-out[i][3], i))
    rank = {i: k + 1 for k, i in enumerate(drawn[: percent * len(drawn) // 100])}
    return {i: (*v[1:], rank.get(i)) for i, v in out.items()}


def got(df):
    return {r.doc_id: (r.n_features, r.weight, r.score, r.rank) for r in df.collect()}


@pytest.mark.parametrize("percent,least,small", [(25, 20, False), (100, 1, True), (40, 0, True)])
def test_against_brute_force(spark, monkeypatch, percent, least, small):
    """small: tries of a few words, parts of a few bytes and groups of a few words, as in very long texts."""
    if small:
        for name, value in (("MOST_WORDS", 7), ("PART", 11), ("GROUP", 5), ("TABLED", 4)):
            monkeypatch.setattr(resampling, name, value)
    r = random.Random(4)
    vocabulary = ["The", "été", "漢字", "x1", "a" * 70, "ii", *(f"w{k}" for k in range(60))]
    text = lambda: r.choice([" ", ", ", "\n"]).join(r.choices(vocabulary, k=r.randint(0, 60)))
    docs = [(i, text()) for i in range(70)] + [(100, None), (101, ""), (102, " .,; "), (103, "one")]
    docs += [(200 + i, docs[3][1]) for i in range(30)]  # copies
    target = [text() for _ in range(5)] + [None, ""]
    if small:  # functions that tasks use are sent along, module settings aren't
        trie, mine, theirs = resampling.Trie(), Counter(), Counter()
        for group in resampling._groups(__import__("pyarrow").array([(t or "").encode() for _, t in docs], "large_binary")):
            states, times, _, _ = trie.walk(group)
            for s, n in zip(states.tolist(), times.tolist(), strict=True):
                mine[s] += n
        for _, t in docs:
            theirs.update(crc32(f.encode()) for f in features(t)[1])
        assert +mine == theirs
    df = spark.createDataFrame([(i, t, 0.5, "x", 1) for i, t in docs], SCHEMA).repartition(3)
    assert got(resample(df, spark.createDataFrame([(t,) for t in target], "text string"), percent, least)) == brute(docs, target, percent, least)


def test_edges(spark):
    none = spark.createDataFrame([], SCHEMA)
    nothing = spark.createDataFrame([], "text string")
    assert resample(none, nothing).collect() == []
    long = " ".join(f"w{i % 977}" for i in range(30000))
    rows = [(None, long), (None, long), (None, None), (5, long), (5, long), (5, "other words"), (6, None)]
    df = spark.createDataFrame([(i, t, 0.5, "x", 1) for i, t in rows], SCHEMA)
    out = resample(df, nothing, percent=100, least=1).collect()
    assert len(out) == 7 and sorted(r.rank for r in out if r.rank) == [1, 2, 3, 4, 5]
    assert len({(r.score, r.weight) for r in out if r.doc_id == 5 and r.n_features == 59999}) == 1
    assert out == resample(df, nothing, percent=100, least=1).collect() or sorted(map(repr, out)) == sorted(map(repr, resample(df, nothing, percent=100, least=1).collect()))
