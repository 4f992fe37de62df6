"""Each stage of the pipeline on nulls, empties, long texts, ties, repeats, empty tables and columns of clashing names."""

import pytest

import corpus_pipeline
from spanloom.llm.cluster import shared_folder

EXTRA = ["times", "_id", "_row", "row", "row_of_text", "_text", "_copy", "doc", "id", "hash", "_hash", "key", "score", "component", "bucket", "side", "a b", "x.y"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"
LONG = " ".join(f"w{k * k % 7919}" for k in range(40_000))
ROWS = [(1, "plain words here"), (2, None), (3, ""), (4, " \t"), (5, LONG), (6, LONG), (6, LONG), (None, LONG), (None, None), (7, "tie"), (7, "tie"), (7, "another text")]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([("i", " ".join(f"item{k}" for k in range(20))), (None, None), ("e", "")], "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0), (5, 0, 0), (None, 1, 1), (9, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def table(spark, rows=ROWS, extra=True):
    d = spark.createDataFrame([(i, t, "en", None if i == 1 else "web", 1) for i, t in rows], SCHEMA)
    return d.selectExpr("*", *(f"cast(coalesce(doc_id, -1) as long) as `{c}`" for c in EXTRA)) if extra else d


def kept(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


#: What a stage keeps of ROWS: all but the last keep rows as they are.
WANT = {
    "toxicity": sorted(ROWS, key=repr),
    "near_dedup": sorted([(1, "plain words here"), (2, None), (3, ""), (4, " \t"), (5, LONG), (None, LONG), (None, None), (7, "tie"), (7, "another text")], key=repr),
    "decontamination": sorted(ROWS, key=repr),
}


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_edges_and_on_nothing(spark, sf_dir, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = table(spark)
    out = stage(spark, docs, sf_dir)
    if name != "sharding":
        assert out.columns == docs.columns
        assert all(r["a b"] == (-1 if r.doc_id is None else r.doc_id) for r in out.collect())
    if name in WANT:
        assert kept(out) == WANT[name]
    elif name == "mixing":
        assert set(kept(out)) <= set(ROWS) and kept(stage(spark, docs.repartition(3), sf_dir)) == kept(out)
    else:
        assert out.count() == len(ROWS)
    none = stage(spark, table(spark, []), sf_dir)
    assert none.collect() == [] and (name == "sharding" or none.columns == docs.columns)


def test_the_choice_among_equal_rows_is_the_same_on_a_rerun(spark, sf_dir):
    rows = [(k, "the same text here", "en", f"s{j}", j) for k in (8, 9) for j in range(5)]
    picks = {tuple(corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, SCHEMA).repartition(n), sf_dir).collect()[0]) for n in (1, 3, 5)}
    assert len(picks) == 1 and next(iter(picks))[0] == 8


def test_mixing_repeats_and_drops_whole_documents(spark, sf_dir):
    rows = [(i, "word " * 10, "a" if i < 6 else "b") for i in range(200)]
    d = spark.createDataFrame([(i, t, "en", s, 1) for i, t, s in rows], SCHEMA)
    out = corpus_pipeline.mixing(spark, d, sf_dir).collect()
    small, large = (sum(r.source == s for r in out) for s in "ab")
    assert small == 18 and abs(large - 182) <= 1  # three times the small source, the rest of the sum of all from the other


def test_run_keeps_one_folder(spark, sf_dir, tmp_path):
    import os
    import shutil

    path = f"{tmp_path}/all"
    shutil.copytree(sf_dir, path)
    table(spark, extra=False).write.parquet(f"{path}/documents.parquet")
    out = corpus_pipeline.run(spark, path)
    assert out.count() > 5 and "shard" in out.columns
    (folder,) = [x for x in os.listdir(shared_folder(spark).removeprefix("file:")) if x.startswith("pipeline-") and os.listdir(f"{shared_folder(spark).removeprefix('file:')}/{x}")][-1:]
    assert os.listdir(f"{shared_folder(spark).removeprefix('file:')}/{folder}") == ["4-sharding"]


def test_a_cluster_without_a_shared_folder_is_refused():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, *_):
            return None

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session())
