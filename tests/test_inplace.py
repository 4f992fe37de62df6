"""What Spark makes of a text's one row against the operators that take its words and sentences as rows."""

import pytest
from pyspark.sql import functions as F

from spanloom.operators import chains, folds, text
from spanloom.operators.folds import _view, six
from spanloom.plans import catalog, views
from spanloom.plans.dialect import Relational

PLAIN = {**catalog.NAMED, **{k: str(v) for k, v in views.VIEWS.items()}}
ONE_PASS = ["text_sentences", "text_windows", "text_snap_bounds", "text_next_sentence", "text_format_window", "rank_cold_open", "text_caption_pages", "text_caption_words", "edit_words", "edit_pieces"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    words = ["yes.", "[Music]", 'no?"', "it's,", "[a", "b]", "(so!)", "über", "end.'", "x", "."]
    texts = [None, "", " \n", "one", "a b", "\t".join(words), " ".join(words[k * 7 % 11] for k in range(700)), " ".join(f"w{k}" for k in range(400)), "[x] [y] z [w] q."]
    d = str(tmp_path_factory.mktemp("texts"))
    spark.createDataFrame([(k * 3 + 1, t) for k, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    return d


def same(a, b):
    assert a.columns == b.columns
    a, b = (sorted((tuple(r) for r in x.collect()), key=repr) for x in (a, b))
    assert a and a == b


@pytest.mark.parametrize("name", ["text_sentences", "text_snap_bounds", "text_next_sentence", "text_format_window", "text_caption_pages"])
def test_texts_in_one_pass(spark, tables, name):
    same(catalog.QUERIES[name](spark, tables), Relational(text.OPERATORS[name], PLAIN)(spark, tables))


def test_cold_opens_in_one_pass(spark, tables):
    from spanloom.operators import ranking

    same(catalog.QUERIES["rank_cold_open"](spark, tables), Relational(ranking.OPERATORS["rank_cold_open"], PLAIN)(spark, tables))


def test_windows_in_one_pass(spark, tables):
    sentences = _view("sentences", spark, tables).withColumn("id", F.col("id").cast("long"))
    same(catalog.QUERIES["text_windows"](spark, tables), chains.windows(sentences, 120.0, 20.0))


def test_caption_words_in_one_pass(spark, tables):
    w = _view("words", spark, tables)
    tokens = w.select("src", F.col("p").alias("i"), F.when(F.col("p") % 3 == 0, F.col("w")).otherwise(F.concat(F.lit(" "), "w")).alias("t"), "s", "e")
    same(catalog.QUERIES["text_caption_words"](spark, tables), folds.caption_words(tokens))


def test_shown_words_and_pieces_in_one_pass(spark, tables):
    words, pieces = folds._shown(spark, tables)
    same(catalog.QUERIES["edit_words"](spark, tables), folds.place_words(words, pieces).select("src", "p", six(F.col("s")).alias("s"), six(F.col("e")).alias("e")))
    same(catalog.QUERIES["edit_pieces"](spark, tables), pieces.select("src", "k", *(six(F.col(c)).alias(c) for c in ("s", "e", "at"))))


@pytest.mark.parametrize("name", ONE_PASS)
def test_no_word_is_shuffled(spark, tables, name):
    plan = catalog.QUERIES[name](spark, tables)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_alignment_of_runs_made_in_place(spark, tables):
    spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(50, 90))), (2, "none of it")], "item_id long, text string").write.mode("overwrite").parquet(f"{tables}/benchmark.parquet")
    assert [(r.short, r.ep, r.hits, r.segments) for r in catalog.QUERIES["mine_align"](spark, tables).collect()] == [(1, 22, 36, 1)]
