"""Operators over whole inputs, against plain models of the reference's rules."""

import math
import random
import re

import pytest

from spanloom.functions.prng import stream
from spanloom.operators import folds
from spanloom.plans import catalog

LONG = " ".join(f"w{k}{'.' if k % 11 == 5 else ',' if k % 17 == 3 else ''}" for k in range(1000))


@pytest.fixture(scope="module")
def documents(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(1, LONG, "web"), (2, "one. two three", "web"), (3, "", "web"), (4, None, "web")], "doc_id long, text string, source string").write.parquet(f"{d}/documents.parquet")
    return d


def words_of(text):
    at = [(w, p * 0.5 + p // 37 * 1.5) for p, w in enumerate(text.split())]
    return [(p, w, s, s + 0.4) for p, (w, s) in enumerate(at)]


def pages_of(text):
    words, pages, page = words_of(text), [], []
    for k, w in enumerate(words):
        page.append(w)
        after = words[k + 1] if k + 1 < len(words) else None
        if len(page) >= 3 or re.search(r"[.?!,]$", w[1]) or after is None or after[2] - w[3] > 0.3:
            pages.append(page)
            page = []
    starts = [p[0][2] for p in pages[1:]] + [float("inf")]
    return [(p[0][0], p[-1][0], " ".join(w[1] for w in p), round(min(p[-1][3] + 0.4, nx), 6)) for p, nx in zip(pages, starts, strict=True)]


def test_caption_pages_reach_the_end_of_a_text(spark, documents):
    got = catalog.QUERIES["text_caption_pages"](spark, documents).collect()
    for src, text in ((1, LONG), (2, "one. two three")):
        mine = sorted((r.p0, r.p1, r.txt, round(r.until, 6)) for r in got if r.src == src)
        assert mine == pages_of(text)


def test_caption_words_reach_the_end_of_a_text(spark, documents):
    got = sorted((r.src, r.s, r.w) for r in catalog.QUERIES["text_caption_words"](spark, documents).collect())
    want = []
    for src, text in ((1, LONG), (2, "one. two three")):
        for p, w, s, _ in words_of(text):
            if p and p % 3 == 0:
                want[-1] = (*want[-1][:2], want[-1][2] + w)
            else:
                want.append((src, s, w))
    assert got == want


def test_leaks_are_found_by_the_first_twelve_words(spark, tmp_path):
    long = [f"Considerable{k}" for k in range(14)]
    items = [("long", " ".join(long)), ("six", "One two, three-four five six!"), ("five", "just five words of text"), ("none", ""), ("null", None)]
    docs = [(1, "So: " + "  ".join(long[:12]) + " and on"), (2, " ".join(long[:11]) + " and on"), (3, "zone two three four five six"), (4, "is one two three four five six"), (5, "just five words of text"), (6, None)]
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    flat = {k: re.sub("[^a-z0-9]+", " ", (t or "").lower()).strip() for k, t in items + docs}
    want = {(i, d) for i, _ in items for d, _ in docs if len(w := flat[i].split(" ")) >= 6 and f" {' '.join(w[:12])} " in f" {flat[d]} "}
    assert want == {("long", 1), ("six", 4)}
    assert {tuple(r) for r in catalog.QUERIES["bench_leaks"](spark, str(tmp_path)).select("item", "src").collect()} == want


def test_descriptions_are_cut_over_4900_characters_only_and_in_the_body(spark, tmp_path):
    docs = [(1, "a" * 81, "web"), (2, "b" * 4894, "web"), (3, "c" * 4895, "web"), (4, "d" * 20000, "web"), (5, "e", "s" * 5000), (6, "f", None)]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.id: r.description for r in catalog.QUERIES["clamp_description"](spark, str(tmp_path)).collect()}
    web, long = '\n\nFrom "web"', '\n\nFrom "' + "s" * 5000 + '"'
    cut = {k: f"{c * (4899 - len(web))}…{web}" for k, c in ((2, "b"), (3, "c"), (4, "d"))}
    assert got == {1: "a" * 81 + web, 5: long[:4900], 6: "f", **cut}


def test_hooks_over_70_characters_go_and_none_is_cut(spark, tmp_path):
    turns = [(1, 0, "user", "  fits "), (1, 1, "user", "x" * 70), (1, 2, "user", "y" * 71), (1, 3, "user", " "), (1, 4, "assistant", "no")]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = [(r.p, r.hook) for r in catalog.QUERIES["rank_hooks"](spark, str(tmp_path)).orderBy("p").collect()]
    assert got == [(0, "fits"), (1, "x" * 70)]


def mulberry(seed):
    a = seed
    while True:
        a = (a + 0x6D2B79F5) % 2**32
        t = (a ^ a >> 15) * (a | 1) % 2**32
        t = (t + (t ^ t >> 7) * (t | 61)) % 2**32 ^ t
        yield (t ^ t >> 14) / 2**32


def test_streams_equal_the_sequential_generator():
    g = mulberry(3)
    assert list(stream(3, 1, 4000)) == [next(g) for _ in range(4000)]


def metrics(order, moments, cover, k=6):
    """order: candidates; moments: [(id, gain)] by id; cover: {(cid, mid): share} of matches."""
    done, got = set(), 0.0
    for c, cid in enumerate(order[:k]):
        open_ = [(-g, -cover[cid, m], m) for m, g in moments if (cid, m) in cover and m not in done]
        if open_:
            g, _, m = min(open_)
            done.add(m)
            got += -g / math.log2(c + 2)

    def ideal(gains):
        return sum(g / math.log2(c + 2) for c, g in enumerate(sorted(gains, reverse=True)[:k]))

    hit = [any((cid, m) in cover for m, _ in moments) for cid in order]
    reached = [g for m, g in moments if any((cid, m) in cover for cid in order)]
    top = [m for m, _ in moments if any((cid, m) in cover for cid in order[:k])]
    return [
        len(moments), len(reached), len(reached) / len(moments) if moments else 0.0, got / ideal(reached) if reached else None, got / ideal([g for _, g in moments]) if moments else 0.0,
        sum(hit[:k]) / len(hit[:k]) if hit else 0.0, len(top) / len(moments) if moments else 0.0, 1 / (hit.index(True) + 1) if any(hit) else 0.0,
    ]


def test_random_baseline_equals_the_sequential_shuffles(spark):
    rand = random.Random(5)
    ranked, graded, matches = [], [], []
    for src, n, m in ((1, 12, 5), (2, 3, 2), (3, 1, 1), (4, 9, 0), (5, 0, 3), (6, 8, 2)):
        ranked += [(src, src * 100 + (i * 7) % 13, i + 1) for i in range(n)]
        graded += [(src, src * 1000 + j, rand.randint(1, 3)) for j in range(m)]
        matches += [(src, c, j, rand.choice([0.5, 0.7, 1.0])) for s, c, _ in ranked if s == src for r, j, _ in graded if r == src and src != 6 and rand.random() < 0.3]
    args = (spark.createDataFrame(x, t) for x, t in ((ranked, "src long, id long, pos int"), (matches, "src long, cid long, mid long, cover double"), (graded, "src long, id long, grade int")))
    got = {r[0]: list(r)[1:] for r in folds.random_baseline(*args).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6]
    for src, mine in got.items():
        pool, g, runs = [i for s, i, _ in ranked if s == src], mulberry(1), []
        moments, cover = [(i, 2**x - 1) for s, i, x in graded if s == src], {(c, j): v for s, c, j, v in matches if s == src}
        for _ in range(2000):
            order = list(pool)
            for i in range(len(order) - 1, 0, -1):
                j = int(next(g) * (i + 1))
                order[i], order[j] = order[j], order[i]
            runs.append(metrics(order, moments, cover))
        want = [None if x[0] is None else sum(x) / 2000 for x in zip(*runs, strict=True)]
        assert mine == pytest.approx(want, abs=1e-9), src


def test_bootstrap_equals_ten_thousand_sequential_resamples(spark):
    xs = [round(math.sin(i) * 10, 3) for i in range(23)]
    g = mulberry(1)
    means = sorted(sum(xs[int(next(g) * len(xs))] for _ in xs) / len(xs) for _ in range(10000))
    got = folds.bootstrap(spark.createDataFrame(list(enumerate(xs)), "i long, x double")).first()
    assert list(got) == pytest.approx([23, sum(xs) / 23, means[250], means[9749]], abs=1e-6)
