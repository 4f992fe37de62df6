"""The pool that is made of a text's one row against that of rows and against SQL."""

import random
from pathlib import Path

import duckdb
import pyarrow as pa
import pytest

from spanloom.operators import selection, textpool
from spanloom.plans import catalog

ODD = ["yes.", "[Music]", 'no?"', "it's,", "(so!)", "über", "end.'", "x", ".", '"', "a.\f", "\f", 'q."\f', "é!)"]


def odd_texts():
    r = random.Random(3)
    own = lambda: ODD + [f"w{k}" for k in range(r.choice([1, 20, 150]))]
    return [None, "", " \n", "one", *("\t \r".join(r.choice(own()) for _ in range(r.choice([20, 80, 300, 1500]))) for _ in range(30))]


def asked(texts, sql):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", texts)
    return sorted(con.execute(sql).fetchall(), key=repr)


def checkpoints(spark):
    folder = spark.sparkContext._jsc.sc().getCheckpointDir()
    return set(Path(folder.get().removeprefix("file:")).rglob("*")) if folder.isDefined() else set()


def test_pool_is_that_of_rows(spark, tmp_path):
    spark.createDataFrame([(k * 7, t) for k, t in enumerate(odd_texts())], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got, want = (q(spark, str(tmp_path)) for q in (catalog.QUERIES["select_pool"], selection._pool_of_rows))
    assert got.dtypes == want.dtypes
    got, want = (sorted(map(tuple, x.collect()), key=repr) for x in (got, want))
    assert got and got == want


def test_pool_in_one_pass(spark, tmp_path):
    """No row of a sentence or range is shuffled or checkpointed, and the pool is that of SQL where texts and keys are odd."""
    texts = [(k * 10**12 - 7 if k % 3 else -k * 7, t) for k, t in enumerate(odd_texts())] + [(None, " ".join(ODD * 40))]
    spark.createDataFrame(texts, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    before = checkpoints(spark)
    got = catalog.QUERIES["select_pool"](spark, str(tmp_path))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect()), key=repr) == asked(texts, catalog.ORACLE["select_pool"])
    assert checkpoints(spark) == before


def test_pool_where_ids_are_shared_and_packs_are_small(monkeypatch):
    """Ids of one digit: a range is then judged by all checks of its id. Any pack gives the same."""
    texts = [(k * 5, t) for k, t in enumerate(odd_texts()) if t]
    hashed = textpool._hashed
    monkeypatch.setattr(textpool, "_hashed", lambda *x: hashed(*x) >> 28)
    found = []
    for pack in (1, 5000, 1 << 20):
        monkeypatch.setattr(textpool, "PACK", pack)
        batch = pa.RecordBatch.from_arrays([pa.array([k for k, _ in texts]), pa.array([t for _, t in texts])], ["doc_id", "text"])
        out = []
        for src, t, at in textpool._packs(batch.slice(2)):
            x = textpool.Sentences(t, at)
            if len(x.doc):
                out += textpool.Pack(src, x, selection.WEIGHTS, 8.5, 69.0, 25).pool(*textpool.windows(x, 120.0, 20.0)).to_pylist()
        found.append(sorted((tuple(r.values()) for r in out), key=repr))
    assert found[0] == found[1] == found[2]
    want = asked(texts[2:], catalog.ORACLE["select_pool"].replace(", 1, 8)", ", 1, 1)"))
    assert sorted((r[0], r[2][-1], *r[3:10]) for r in found[0]) == sorted((r[0], r[2][-1], *r[3:10]) for r in want)


def test_pool_of_keys_too_large_for_its_numbers_is_refused(spark, tmp_path):
    spark.createDataFrame([(1 << 60, " ".join(ODD * 40))], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    with pytest.raises(Exception, match="a doc_id beyond"):
        catalog.QUERIES["select_pool"](spark, str(tmp_path)).collect()


def test_boundary_counts_shuffle_counts_alone(spark, tmp_path):
    texts = [(k * 11 - 40, t) for k, t in enumerate(odd_texts())]
    spark.createDataFrame(texts, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    before = checkpoints(spark)
    got = catalog.QUERIES["select_boundary_counts"](spark, str(tmp_path))
    plan = got._jdf.queryExecution().executedPlan()
    assert plan.toString().count("Exchange hashpartitioning(src") == plan.toString().count("Exchange") == 1
    assert sorted(map(tuple, got.collect()), key=repr) == asked(texts, catalog.ORACLE["select_boundary_counts"])
    assert checkpoints(spark) == before
