"""Hand-computed cases of the operators, and each text against DuckDB on the smallest tables."""

import os
import random
from concurrent.futures import ThreadPoolExecutor

import duckdb
import pytest

from spanloom.functions.prng import draw
from spanloom.operators import folds
from spanloom.plans import catalog
from spanloom.sources import files

SMALL = "/root/testdata/sf0.001"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_dedupe_keeps_the_better_of_overlapping_spans(spark):
    df = spark.createDataFrame([(1, 1, 6.0, 0.0, 40.0), (1, 2, 7.0, 5.0, 45.0), (1, 3, 5.0, 100.0, 140.0)], "src long, id long, score double, s double, e double")
    assert [r[1] for r in rows(folds.dedupe(df))] == [2, 3]


def test_merge_short(spark):
    df = spark.createDataFrame([(1, 0.0, 2.0), (1, 2.0, 2.2), (1, 5.0, 5.1)], "src long, s double, e double")
    assert rows(folds.merge_short(df)) == [(1, 0.0, 2.2), (1, 5.0, 5.1)]


def test_merging_short_pieces_again_and_again(spark):
    """Against merging one piece at a time, from the first short one on, until none is left that touches another."""
    r, table, want = random.Random(3), [], {}
    for src in range(40):
        t, xs = 0.0, []
        for _ in range(r.randint(1, 15)):
            t += r.random() < 0.3
            xs.append([t, t + r.choice([0.125, 0.25, 0.375, 0.5, 1.0])])
            t = xs[-1][1]
        table += [(src, *x) for x in xs]
        while found := [(k, j) for k, x in enumerate(xs) if x[1] - x[0] < 0.5 for j in (k - 1, k + 1) if 0 <= j < len(xs) and (xs[j][1] == x[0] if j < k else xs[j][0] == x[1])]:
            a, b = sorted(found[0])
            xs[a : b + 1] = [[xs[a][0], xs[b][1]]]
        want[src] = [tuple(x) for x in xs]
    got = {}
    for x in folds.merge_short(spark.createDataFrame(table, "src long, s double, e double")).orderBy("src", "s").collect():
        got.setdefault(x.src, []).append((x.s, x.e))
    assert got == want


def test_caption_words_glue_and_markers(spark):
    df = spark.createDataFrame([(1, 0, " hand", 0.0, 1.0), (1, 1, "ful", 1.0, 2.0), (1, 2, "[MUSIC]", 2.0, 3.0), (1, 3, " on", 3.0, 4.0)], "src long, i long, t string, s double, e double")
    assert [r[1] for r in rows(folds.caption_words(df))] == ["handful", "on"]


def test_windows_step_from_sentence_to_sentence(spark):
    df = spark.createDataFrame([(1, i, i * 30.0, i * 30.0 + 29) for i in range(100)], "src long, id long, s double, e double")
    got = rows(folds.windows(df))
    assert got[0] == (1, 0, 19) and got[1][1] == 18 and got[-1][2] == 99


def test_shots(spark):
    d = [(1, i, i * 0.2, 60.0 if i in (40, 80) else 3.0 + i % 3) for i in range(100)]
    assert [r[1] for r in rows(folds.shots(spark.createDataFrame(d, "src long, id long, t double, d double")))] == [40, 80]


def test_draws_equal_the_sequential_generator(spark):
    def sequential(seed, n):
        out, a = [], seed
        for _ in range(n):
            a = (a + 0x6D2B79F5) % 2**32
            t = (a ^ a >> 15) * (a | 1) % 2**32
            t = (t + (t ^ t >> 7) * (t | 61)) % 2**32 ^ t
            out.append((t ^ t >> 14) / 2**32)
        return out

    got = [r[0] for r in spark.range(1, 501).orderBy("id").select(draw(7, __import__("pyspark").sql.functions.col("id"))).collect()]
    assert got == sequential(7, 500)


def test_bootstrap_of_equal_values(spark):
    df = spark.createDataFrame([(i, 0.5) for i in range(3)], "i long, x double")
    assert rows(folds.bootstrap(df, 500)) == [(3, 0.5, 0.5, 0.5)]


def test_subtitles(spark):
    json = '{"events":[{"tStartMs":1000,"dDurationMs":2000,"segs":[{"utf8":"so"},{"utf8":" the","tOffsetMs":400},{"utf8":" point","tOffsetMs":900}]},{"tStartMs":3000,"segs":[{"utf8":"\\n"}]},{"tStartMs":3100,"dDurationMs":900,"segs":[{"utf8":"is"}]}]}'
    got = {r[1]: (round(r[2], 3), round(r[3], 3)) for r in files.parse_subtitles(spark.createDataFrame([(1, json)], "src long, json string")).collect()}
    assert got == {"so": (1.0, 1.4), "the": (1.4, 1.9), "point": (1.9, 3.0), "is": (3.1, 4.0)}


def test_probe_listing_report_silences(spark):
    probe = [(k, f'{{"streams":[{{"codec_type":"audio"}},{{"codec_type":"video","width":4,"height":3,"rotation":{r}}}]}}') for k, r in ((1, 90), (2, -270), (3, 180))] + [(4, '{"streams":[]}')]
    assert rows(files.parse_probe(spark.createDataFrame(probe, "src long, json string"))) == [(1, 3, 4), (2, 3, 4), (3, 4, 3), (4, None, None)]
    got = rows(files.parse_listing(spark.createDataFrame([("u", '{"entries":[{"id":"a","view_count":null}]}')], "url string, json string")))
    assert got == [("a", "", 0, "", 0.0, "u")]
    got = rows(files.parse_report(spark.createDataFrame([(1, '{"columnHeaders":[{"name":"v"},{"name":"p"}],"rows":[["x",3]]}')], "src long, json string")))
    assert got == [(1, 0, {"v": "x", "p": "3"})]
    log = "silence_start: 1.5\nsilence_end: 2.25 | d\nsilence_start: 9"
    assert rows(files.parse_silences(spark.createDataFrame([(1, log)], "src long, log string"))) == [(1, 1.5, 2.25)]


def test_stats_import(spark):
    lines = spark.createDataFrame([(1, "clipId,views,avgViewPct"), (2, "a, 10 ,50"), (3, ",5,1"), (4, "b,-1,2"), (5, "b,1,200"), (6, "zz,3,")], "line long, raw string")
    good, bad = files.parse_stats(lines)
    assert rows(good) == [(2, "a", 10.0, 50.0), (6, "zz", 3.0, None)]
    assert [r[0] for r in rows(bad)] == [3, 4, 5]
    clips = spark.createDataFrame([("a", None)], "id string, metrics array<struct<views:double,avgViewPct:double,source:string>>")
    merged, missing = files.import_stats(good, clips)
    assert merged.first().metrics[0].views == 10.0 and rows(missing) == [(6, "zz", "no such clip")]


def test_document_store(spark, tmp_path):
    p = str(tmp_path / "store")
    files.write_documents(spark.createDataFrame([("a", 1)], "id string, n int"), p)
    files.append_lines(spark.createDataFrame([("b", 2)], "id string, n int"), p)
    assert rows(files.read_lines(spark, p, "id string, n int")) == [("a", 1), ("b", 2)]
    default = spark.createDataFrame([("d", 0)], "id string, n int")
    assert rows(files.read_documents_or(spark, p + "-none", "id string, n int", default)) == [("d", 0)]
    assert files.list_files(spark, p, "part-").count() >= 2
    old = spark.createDataFrame([("a", 1), ("b", 2)], "id string, n int")
    assert rows(files.upsert(old, spark.createDataFrame([("b", 9)], "id string, n int"), "id")) == [("a", 1), ("b", 9)]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {t[:-8]} AS SELECT * FROM '{SMALL}/{t}'")
    return con


@pytest.fixture(scope="module")
def answers(spark, request):
    """Rows and columns of each query asked for, a few at a time: small jobs leave cores idle."""
    names = [i.callspec.params["name"] for i in request.session.items if i.name.startswith("test_against_sql[")]

    def ask(name):
        df = catalog.QUERIES[name](spark, SMALL)
        return df.columns, [tuple(r) for r in df.collect()]

    with ThreadPoolExecutor(4) as pool:
        yield {n: pool.submit(ask, n) for n in names}
        pool.shutdown(cancel_futures=True)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_against_sql(answers, duck, name):
    columns, found = answers[name].result()
    cols = sorted(columns)
    b = duck.execute(catalog.ORACLE[name])
    at = {d[0]: k for k, d in enumerate(b.description)}
    assert sorted(at) == cols
    got = sorted((tuple(r[columns.index(c)] for c in cols) for r in found), key=repr)
    want = sorted((tuple(r[at[c]] for c in cols) for r in b.fetchall()), key=repr)
    assert len(got) == len(want)
    for x, y in zip(got, want, strict=True):
        assert all(p == q or (isinstance(p, float) and abs(p - q) <= 2e-6 * max(1, abs(p))) for p, q in zip(x, y, strict=True)), (x, y)
