"""Stages of the pipeline decide on rows, also where doc_ids are missing or repeat."""

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"
ITEM = " ".join(f"item{k}" for k in range(20))


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in rows], SCHEMA)


def kept(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def test_decontamination_drops_contaminated_rows_only(spark, tmp_path):
    spark.createDataFrame([("a", ITEM)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = [(None, "clean one"), (None, None), (7, "clean two"), (8, "")]
    docs = table(spark, [*clean, (None, ITEM), (7, ITEM)])
    assert kept(corpus_pipeline.decontamination(spark, docs, str(tmp_path))) == sorted(clean, key=repr)


def test_near_dedup_judges_rows_by_their_own_text(spark):
    a, b = (" ".join(f"{w}{k * k % 997}" for k in range(200)) for w in "ab")
    docs = table(spark, [(1, a), (5, a + " end"), (5, b), (9, b), (None, a), (6, "short"), (6, ""), (6, "short")])
    assert kept(corpus_pipeline.near_dedup(spark, docs, "")) == sorted([(1, a), (5, b), (None, a), (6, "short"), (6, "")], key=repr)


def test_near_dedup_keeps_one_of_near_copies_with_one_doc_id(spark):
    a = " ".join(f"a{k * k % 997}" for k in range(200))
    got = kept(corpus_pipeline.near_dedup(spark, table(spark, [(5, a), (5, a + " end"), (5, "another text of its own")]), ""))
    assert len(got) == 2 and (5, "another text of its own") in got
