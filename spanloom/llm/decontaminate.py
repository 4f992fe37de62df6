"""Benchmark decontamination by winnowing, on built-in functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .native import folded, same_row, with_row, words

GRAM = 8


def _winner(g: str, p: str, places: int) -> Column:
    """The smallest gram hash among ``places`` places from p, with the place in its low 3 bits: of equal ones the first."""
    return F.expr(f"least({', '.join(f'shiftleft(shiftrightunsigned(get({g}, {p} + {o}), 3), 3) | {o}L' for o in range(places))})")


def _gram_hashes(t: DataFrame) -> DataFrame:
    """Adds g: at each place the hash of GRAM words, from hashes of half as many, of their halves, and so on.

    Lambdas run once a place here, before places become rows, so the method that makes rows of places and
    probes the join stays small enough to be compiled."""
    k, of = 1, "h"
    while k < GRAM:
        t = _held(t, f"g{2 * k}", F.expr(f"transform({of}, (x, i) -> xxhash64(x, get({of}, i + {k})))"))
        k, of = 2 * k, f"g{2 * k}"
    return t.withColumnRenamed(of, "g")


def _held(t: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column as a generator of one row: the optimiser can't put its expression in the places that use it, to run there once an element."""
    return t.select("*", F.explode(F.array(value)).alias(name))


def _agree(x: str, at: str, y: str, to: str, n: int, step: int) -> Column:
    """How many words agree, of at most n, from x[at] and y[to] on in steps of ``step``; a place outside of either doesn't."""
    first = 1 if step < 0 else 0
    return F.expr(
        f"aggregate(sequence({first}, {first + n - 1}), 0, (r, k) -> if(r = k - {first} and "
        f"coalesce(get({x}, {at} + {step} * k) = get({y}, {to} + {step} * k), false), r + 1, r))"
    )


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20, block_rows: int = 100_000, by_text: bool = False, scans: int = 8) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of each row of docs; by_text: and row, the text's hash as in with_row.

    A word of a document is hit if any ``window`` consecutive words of an item that cover it occur there;
    an item of fewer words is one window. Contaminated: a hit, and ``share`` * n_hit >= n_words.

    Winnowing keeps the smallest hash of GRAM words of each window, in documents and items alike, so each
    window that they share brings a fingerprint that they share, at the same place in it. A hit is
    extended over the words around it as far as windows with this fingerprint reach. Fingerprints of
    items are broadcast in blocks of ``block_rows``, so what is broadcast is bounded however large the
    benchmark is; documents are read once for each block and not shuffled. A benchmark of more than ``scans`` blocks
    is joined by a shuffle of fingerprints instead, and the words are fetched for hits alone: the same hits.

    Null and empty texts have no words and hit nothing. Items that repeat an item_id count once; an
    item without item_id hits words but is not counted. Repeated rows of docs get equal results."""
    spark, d = docs.sparkSession, with_row(docs)
    places = window - GRAM + 1
    w = d.select("doc_id", "row", words(folded(F.col("text"))).alias("w"))
    w = _held(w, "h", F.transform("w", lambda x: F.xxhash64(x)))
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words(folded(F.col("text"))).alias("iw")).filter(F.size("iw") > 0)
    items = _held(items, "h", F.transform("iw", lambda x: F.xxhash64(x)))

    def windows(t: DataFrame, *keep: str) -> DataFrame:
        at = _gram_hashes(t.filter(F.size("h") >= window)).select(*keep, "g", F.posexplode("g").alias("p", "_"))
        at = at.filter(F.col("p") <= F.size("g") - window).withColumn("m", _winner("g", "p", places))
        return at.select(*keep, F.expr("shiftleft(shiftrightunsigned(m, 3), 3)").alias("fp"), F.expr("p + cast(m & 7 as int)").alias("p"))

    left, right = places - 1, window
    prints = windows(items, "item", "iw").select(
        "fp", "item",
        F.expr(f"slice(iw, greatest(p - {left}, 0) + 1, least(p, {left}) + {right})").alias("near"), F.expr(f"least(p, {left})").alias("q"),
    ).distinct()
    short = items.filter(F.size("h") < window).select(F.size("h").alias("n"), "item", "iw").distinct()
    lengths = sorted(r.n for r in short.select("n").distinct().collect())

    def met(at, table: DataFrame) -> list[DataFrame]:
        """Rows of at("doc_id", "row", ..., "w") that share a fingerprint with the table's, with their document's words."""
        parts = _blocks(table, block_rows)
        if len(parts) <= scans:
            return [at("doc_id", "row", "w").join(F.broadcast(part), "fp") for part in parts]
        own = w.select(F.col("doc_id").alias("_doc"), F.col("row").alias("_row"), "w").dropDuplicates(["_doc", "_row"])
        hit = at("doc_id", "row").join(table, "fp")
        return [hit.join(own, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("row") == F.col("_row"))).drop("_doc", "_row")]

    found = []
    for hit in met(lambda *keep: windows(w, *keep), prints):
        hit = hit.select(
            "doc_id", "row", "item", "p", "near", "q",
            F.expr(f"slice(w, greatest(p - {left}, 0) + 1, least(p, {left}) + {right})").alias("here"), F.expr(f"least(p, {left})").alias("c"),
        )
        # As a generator: a filter on its columns stays above the join, whose rows then are as short as a window.
        reach = F.struct(_agree("here", "c", "near", "q", left, -1).alias("before"), _agree("here", "c", "near", "q", right, 1).alias("after"))
        hit = hit.select("doc_id", "row", "item", "p", F.inline(F.array(reach))).filter(F.col("before") + F.col("after") >= window)
        found.append(hit.select("doc_id", "row", "item", (F.col("p") - F.col("before")).alias("a"), (F.col("p") + F.col("after")).alias("b")))
    for n in lengths:
        whole = F.xxhash64(*[F.expr(f"get(h, p + {k})") for k in range(n)]).alias("fp")
        mine = short.filter(F.col("n") == n).select(F.xxhash64(*[F.expr(f"xxhash64(get(iw, {k}))") for k in range(n)]).alias("fp"), "item", "iw")

        def places_of(*keep: str, n: int = n, whole=whole) -> DataFrame:
            at = w.filter(F.size("h") >= n).select(*keep, "h", F.posexplode("h").alias("p", "_")).filter(F.col("p") <= F.size("h") - n)
            return at.select(*keep, "p", whole)

        for hit in met(places_of, mine):
            hit = hit.filter(F.slice("w", F.col("p") + 1, n) == F.col("iw"))
            found.append(hit.select("doc_id", "row", "item", F.col("p").alias("a"), (F.col("p") + n).alias("b")))
    rows = d.select("doc_id", "row", F.size(words(folded(F.col("text")))).cast("long").alias("n_words"))
    if found:
        spans = found[0]
        for x in found[1:]:
            spans = spans.unionByName(x)
    else:
        spans = spark.createDataFrame([], "doc_id long, row long, item string, a int, b int")
    # By one struct: a union of parts that were shuffled by row isn't always shuffled alike, though Spark 4.1 takes it for that.
    along = Window.partitionBy("at").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.groupBy(F.struct("doc_id", "row").alias("at"), "a", "b").agg(F.collect_set("item").alias("items"))
    spans = spans.withColumn("done", F.coalesce(F.max("b").over(along), F.col("a")))
    spans = spans.withColumn("more", F.greatest(F.lit(0), F.col("b") - F.greatest("a", "done")))
    per = spans.groupBy("at").agg(F.sum("more").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")).select("at.*", "n_hit", "items")
    out = rows.join(per, same_row(rows, per), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(
        rows["doc_id"], "n_words", n_hit.alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")).cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"), *([rows["row"]] if by_text else []),
    )


def _blocks(table: DataFrame, rows: int) -> list[DataFrame]:
    """The table in parts of about ``rows`` rows; none if it has none. Only the count comes to the driver."""
    n = -(-table.count() // rows)
    return [table] if n == 1 else [table.filter(F.pmod(F.xxhash64(F.lit(11), *table.columns), F.lit(n)) == k) for k in range(n)]
