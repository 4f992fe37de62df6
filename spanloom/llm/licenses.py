"""License scan: votes of rolling word grams for places in license templates, by offset diagonal."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .license_texts import BASE, PASSAGES, PHRASES
from .native import folded, same_row, with_row, words

SHORT, LONG = 2, 5


def _grams(spark) -> DataFrame:
    """hash, k, gram, template, label, base, tpos, grams (of the template): some two thousand rows, fixed."""
    rows = []
    texts = [("base", SHORT, label, text, text) for text, label in BASE.items()] + [("phrase", SHORT, label, text, text) for text, label in PHRASES.items()]
    texts += [("passage", LONG, label, f"{label} {name}", text) for label, name, text in PASSAGES]
    for kind, k, label, name, text in texts:
        w = re.findall(r"[a-z0-9]+", text.lower())
        rows += [(kind, label, f"{kind}:{name}", k, w[i : i + k], i, len(w) - k + 1) for i in range(len(w) - k + 1)]
    table = spark.createDataFrame(rows, "kind string, label string, template string, k int, gram array<string>, tpos int, grams int")
    return table.withColumn("hash", F.when(F.col("k") == SHORT, _hash("gram", SHORT)).otherwise(_hash("gram", LONG)))


def _hash(array: str, k: int, at: str = "0"):
    return F.xxhash64(F.lit(k), *[F.expr(f"xxhash64(get({array}, {at} + {o}))") for o in range(k)])


def _within() -> dict[str, list[tuple[str, int]]]:
    """Of each phrase that holds other ones: their templates, and the word of it that each begins with."""
    found = {}
    for longer in PHRASES:
        w = longer.split()
        held = [(f"phrase:{p}", k) for p in PHRASES if p != longer for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        if held:
            found[f"phrase:{longer}"] = held
    return found


def _longest(spans: DataFrame) -> DataFrame:
    """Without spans of phrases that lie within one of a longer phrase: of ``cc by nc`` the ``cc by`` goes. Base ones stay."""
    none = "cast(array() as array<struct<template:string,at:int>>)"
    cases = " ".join(f"when '{t}' then array({', '.join(f"named_struct('template', '{p}', 'at', cast({k} as int))" for p, k in held)})" for t, held in _within().items())
    shadows = F.expr(f"transform(case template {cases} else {none} end, x -> named_struct('template', x.template, 'first', first + x.at, 'own', false))")
    own = F.expr("array(named_struct('template', template, 'first', first, 'own', true))")
    marks = spans.select("doc_id", "row", F.struct("kind", "label", "template", "grams", "first", "last", "held").alias("span"), F.explode(F.concat(own, shadows)).alias("m"))
    kept = marks.groupBy("doc_id", "row", "m.template", "m.first").agg(F.max_by("span", "m.own").alias("span"), F.bool_and("m.own").alias("kept"))
    return kept.filter("kept").select("doc_id", "row", "span.*")


def scan_licenses(docs: DataFrame, neighbours: int = 6, least_share: float = 0.6) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans of each row of docs.

    All rolling grams of 2 and of 5 words are joined with the places that the templates have them at, by
    hash and then by the words. Hits are counted by template and diagonal (place in the document less
    place in the template); diagonals within ``neighbours`` of each other are one span, so a word put in
    or left out does not cut it. A phrase's span is one diagonal that holds all of its grams; a passage
    must hold ``least_share`` of its grams. Of phrases within each other the longest at a place gives its label. spans: template, first and last word, share of grams.

    A null or empty text has no words, places or labels and score 0; a very long text is read whole, its grams as rows.
    Repeated rows get equal results. An empty table gives none."""
    d = with_row(docs)
    w = d.select("doc_id", "row", words(folded(F.col("text"))).alias("w"))
    w = w.withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))
    at = w.select("doc_id", "row", "w", "h", F.posexplode("h").alias("p", "_"))
    hashed = [F.xxhash64(F.lit(k), *[F.expr(f"get(h, p + {o})") for o in range(k)]) for k in (SHORT, LONG)]
    at = at.select("doc_id", "row", "w", "p", F.explode(F.array(*hashed)).alias("hash"))
    hits = at.join(F.broadcast(_grams(docs.sparkSession)), "hash").filter("slice(w, p + 1, k) = gram")
    hits = hits.select("doc_id", "row", "kind", "label", "template", "grams", "k", "p", "tpos", (F.col("p") - F.col("tpos")).alias("diagonal")).distinct()
    lines = hits.groupBy("doc_id", "row", "kind", "label", "template", "grams", "k", "diagonal").agg(
        F.min("p").alias("a"), F.max(F.col("p") + F.col("k")).alias("b"), F.collect_set("tpos").alias("places")
    )
    along = Window.partitionBy("doc_id", "row", "template").orderBy("diagonal")
    gap = F.when(F.col("kind") != "passage", 0).otherwise(neighbours)
    lines = lines.withColumn("new", F.coalesce((F.col("diagonal") - F.lag("diagonal").over(along) > gap).cast("int"), F.lit(1)))
    lines = lines.withColumn("span", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    spans = lines.groupBy("doc_id", "row", "kind", "label", "template", "grams", "span").agg(
        F.min("a").alias("first"), F.max("b").alias("last"), F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("held")
    )
    spans = spans.filter(F.when(F.col("kind") == "passage", F.col("held") / F.col("grams") >= least_share).otherwise(F.col("held") == F.col("grams")))
    spans = _longest(spans).withColumn("share", F.col("held") / F.col("grams"))
    base = F.col("kind") == "base"
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    found = spans.groupBy("doc_id", "row").agg(
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("first"))).cast("long").alias("last_word"),
        joined(F.when(base, F.col("label"))).alias("base_labels"),
        joined(F.col("label")).alias("labels"),
        F.max("share").alias("score"),
        F.array_sort(F.collect_list(F.struct("template", F.col("first").alias("first_word"), (F.col("last") - 1).alias("last_word"), "share"))).alias("spans"),
    )
    rows = d.select("doc_id", "row", F.size(words(folded(F.col("text")))).cast("long").alias("n_words"))
    out = rows.join(found, same_row(rows, found), "left")
    return out.select(
        rows["doc_id"], "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"), "spans",
    )
