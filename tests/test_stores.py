"""Stores while they are replaced, changed by key and appended to."""

import os

import pytest
from pyspark.sql import functions as F

from spanloom.sources import files, store


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_a_reader_sees_the_old_version_or_the_new_one(spark, tmp_path):
    path = str(tmp_path / "store")
    default = spark.createDataFrame([("none", 0)], "id string, n int")
    assert rows(store.current(spark, path, default)) == [("none", 0)]
    with pytest.raises(FileNotFoundError):
        store.current(spark, path)
    assert store.replace(spark.createDataFrame([("a", 1)], "id string, n int"), path) == 1
    began = store.current(spark, path)
    store.replace(spark.createDataFrame([("b", 2)], "id string, n int"), path)
    assert rows(began) == [("a", 1)] and rows(store.current(spark, path)) == [("b", 2)]
    failing = spark.range(3).select(F.raise_error(F.lit("broken")).cast("string").alias("id"), F.lit(1).alias("n"))
    with pytest.raises(Exception, match="broken"):
        store.replace(failing, path)
    assert rows(store.current(spark, path)) == [("b", 2)] and 3 not in store.versions(spark, path)
    (tmp_path / "store" / "version=9").mkdir()  # a writer that was lost midway
    assert rows(store.current(spark, path)) == [("b", 2)]
    assert store.replace(spark.createDataFrame([("c", 3)], "id string, n int"), path) == 10
    assert store.versions(spark, path) == [2, 10]


def test_an_upsert_touches_the_folders_of_its_keys_alone(spark, tmp_path):
    path = str(tmp_path / "keyed")
    store.create_keyed(spark.range(200).select("id", (F.col("id") * 2).alias("n")), path, "id", 16)
    before = {f: os.stat(f).st_mtime_ns for d, _, fs in os.walk(path) for f in (os.path.join(d, x) for x in fs) if f.endswith(".parquet")}
    store.upsert_keyed(spark.createDataFrame([(7, -1), (1007, -2)], "id long, n long"), path, "id", 16)
    now = {f for d, _, fs in os.walk(path) for f in (os.path.join(d, x) for x in fs) if f.endswith(".parquet")}
    assert len({os.path.dirname(f) for f in set(before) - now}) <= 2 and all(os.stat(f).st_mtime_ns == before[f] for f in now & set(before))
    want = {i: 2 * i for i in range(200)} | {7: -1, 1007: -2}
    assert {r.id: r.n for r in spark.read.parquet(path).collect()} == want
    assert [r.n for r in store.read_key(spark, path, "id", 1007, 16).collect()] == [-2] and store.read_key(spark, path, "id", 5000, 16).collect() == []
    store.upsert_keyed(spark.createDataFrame([], "id long, n long"), path, "id", 16)
    assert spark.read.parquet(path).count() == 201 and not [x for x in os.listdir(tmp_path) if "staged" in x]


def test_appended_lines_come_once_however_often_the_stream_is_started(spark, tmp_path):
    kinds, at = "id long, v string", [str(tmp_path / x) for x in ("in", "out", "progress")]
    for part in range(3):
        spark.createDataFrame([(part * 10 + k, "x") for k in range(5)], kinds).repartition(2).write.mode("append").json(at[0])
        for _ in range(2):
            store.append_stream(spark, at[0], kinds, at[1], at[2], files=1)
        assert sorted(r.id for r in files.read_lines(spark, at[1], kinds).collect()) == [p * 10 + k for p in range(part + 1) for k in range(5)]


def test_documents_that_dont_parse(spark, tmp_path):
    for name, text in (("a", '{"id": "a",\n "n": 1}'), ("b", '{"id": "b", "n"')):
        (tmp_path / f"{name}.json").write_text(text)
    assert [r.id for r in files.read_documents_or(spark, str(tmp_path), "id string, n int").collect()] == ["a"]
    with pytest.raises(Exception, match="(?i)malformed|corrupt"):
        files.read_documents(spark, str(tmp_path), "id string, n int").collect()


def test_a_probe_without_video_is_an_error_if_asked_for(spark):
    docs = spark.createDataFrame([(1, '{"streams":[{"codec_type":"video","width":4,"height":3}]}'), (2, '{"streams":[{"codec_type":"audio"}]}')], "src long, json string")
    assert rows(files.parse_probe(docs.filter("src = 1"), strict=True)) == [(1, 4, 3)]
    with pytest.raises(Exception, match="no video stream: 2"):
        files.parse_probe(docs, strict=True).collect()
