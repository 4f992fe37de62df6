"""Document fingerprints of spot signatures, on built-in functions alone, and the join of them.

A signature is a common word with the chain of content words that follow it. A document's fingerprint
is the sorted set of its signatures' hashes; likeness is the Jaccard similarity of two such sets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cluster import durable, partitions
from .native import folded, words

# Common words of English, French, German and Spanish that chains follow.
ANCHORS = (
    "a an and are as at be by for from has he in is it its of on or that the this to was were will with "
    "au aux avec ce ces dans de des du elle en et est il la le les ou par pas pour que qui sur un une "
    "als auf aus bei das dem den der die ein eine im ist mit nicht sich sie und von zu "
    "al con como del el es esta los las lo no o para por se su una y"
).split()
CHAIN, REACH = 3, 12
#: Documents are dealt by runs of about so many neighbours, within at most so many ranges of doc_ids that hold about as many rows each.
RUN, RANGES = 256, 1024
#: Of at most so many signatures, the most common, tasks know how many classes have them; the others pass for equally rare.
COMMON = 1 << 20


def _held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column as a generator of one row: the optimiser can't put its expression in the lambdas that use it, to run there once an element."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def with_signatures(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds the sorted distinct 64-bit hashes of the signatures of a text that isn't null. A chain is the first CHAIN
    content words within REACH words of its anchor. Words without any chain are one signature, of 128 bits in two; so is a
    text that isn't empty but has no words; an empty text has none.

    Content words are looked for once a text. As many of them come before an anchor as its place is beyond its number among
    the anchors, which says where its chain begins: each anchor costs one hash."""
    common = "in (" + ", ".join(f"'{x}'" for x in dict.fromkeys(ANCHORS)) + ")"
    df = _held(df, "_w", words(folded(F.col(text))))
    df = _held(df, "_c", F.expr(f"filter(sequence(0, size(_w)), i -> i < size(_w) and get(_w, i) not {common})"))
    df = _held(df, "_a", F.expr("array_except(sequence(0, size(_w)), _c)"))  # and past the last word one place that has none
    at = [f"get(_c, i - j + {x})" for x in range(CHAIN)]  # i - j content words come before the j-th anchor
    full = f"xxhash64(get(_w, i), {', '.join(f'get(_w, {c})' for c in at)})"
    part = f"xxhash64(get(_w, i), {', '.join(f'if({c} <= i + {REACH}, get(_w, {c}), null)' for c in at)})"
    chain = f"if(coalesce({at[-1]} <= i + {REACH}, false), {full}, if(coalesce({at[0]} <= i + {REACH}, false), {part}, null))"
    df = _held(df, "_s", F.expr(f"array_compact(transform(_a, (i, j) -> {chain}))"))
    twice = lambda c: F.array(F.xxhash64(c), F.xxhash64(F.lit(17), c))
    bare = F.when(F.size("_w") > 0, twice("_w")).when(F.col(text) != "", twice(text)).otherwise(F.expr("cast(array() as array<bigint>)"))
    return df.withColumn(name, F.sort_array(F.array_distinct(F.when(F.size("_s") > 0, F.col("_s")).otherwise(bare)))).drop("_w", "_c", "_a", "_s")


def as_string(sigs: str) -> Column:
    return F.expr(f"array_join(transform({sigs}, x -> lpad(lower(hex(x)), 16, '0')), '')")


def likeness(a: str, b: str) -> Column:
    """Jaccard similarity of two sets; of two empty sets 1."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, 1.0).otherwise(both / union)


def _next_bucket(buckets: DataFrame) -> DataFrame:
    """Adds to each bucket the next larger one, and to the largest the smallest; by ranges, so that what is sorted in
    one task are a range's buckets, and RANGES rows."""
    own = buckets.withColumn("k", F.col("b.k"))
    groups = own.groupBy("k").agg(F.min("b").alias("low"))
    line = Window.orderBy("k")
    low = F.min("low").over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    groups = groups.select("k", F.coalesce(F.lead("low").over(line), low).alias("after"))
    inner = F.lead("b").over(Window.partitionBy("k").orderBy("b"))
    return own.withColumn("inner", inner).join(groups, "k").select("b", F.coalesce("inner", "after").alias("above"))


def _bucket(rows: int, quantiles: list[int]) -> Column:
    """The bucket of a row (doc_id, row), in the order of doc_ids: k, the range between quantiles of the doc_ids that it lies in; p, its place
    there in steps that hold about RUN rows where the range's ids are spread evenly; h, for ids that fill whole ranges, and for rows without
    one, a part of the text's hash."""
    bounds = sorted(set(quantiles))
    hot = sorted({x for x, y in zip(quantiles, quantiles[1:], strict=False) if x == y})
    each = max(1, rows // max(1, len(quantiles)))
    steps = [max(1, (b - a) * RUN // each) for a, b in zip(bounds, [*bounds[1:], bounds[-1] + 1], strict=True)] if bounds else []
    side = 32
    listed = lambda xs: F.array(*map(F.lit, xs)).cast("array<bigint>")
    below = lambda xs: F.size(F.filter(xs, lambda x: x <= F.col("doc_id")))
    first = (F.greatest(below(listed(bounds[::side])), F.lit(1)) - 1) * side  # of every 32nd bound, then among those after it
    k = first + F.greatest(below(F.slice(listed(bounds), first + 1, side)), F.lit(1)) - 1
    p = F.floor((F.col("doc_id") - F.get(listed(bounds), k)) / F.get(listed(steps), k))
    part = F.shiftright("row", 54)
    h = F.when(F.col("doc_id").isin(hot), part).otherwise(0) if hot else F.lit(0).cast("long")
    none = F.struct(F.lit(-1).alias("k"), F.lit(0).cast("long").alias("p"), part.alias("h"))
    return F.when(F.col("doc_id").isNull(), none).otherwise(F.struct(k.cast("int").alias("k"), p.cast("long").alias("p"), h.alias("h"))) if bounds else none


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_signatures of each row.

    The next document is the next smaller doc_id, after the smallest the largest; the edited text is the
    text with its last floor(n_chars / 2) code points replaced by the first as many of the next document.
    Documents are shuffled once, by runs of about RUN neighbours; a run's last document gets its next one from a
    table of the runs' first documents. How wide runs are is learned from the quantiles of doc_ids, so that ids may be sparse.

    A null text is empty, and its fingerprint too. Rows without doc_id come last. Rows that repeat a
    doc_id are ordered by a hash of the text; so are rows without one. A document that is alone is its own next one."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    places = F.lit([i / RANGES for i in range(RANGES)])
    seen = d.agg(F.count("*").alias("rows"), F.sum(F.octet_length("text")).alias("bytes"), F.percentile_approx("doc_id", places, 16 * RANGES).alias("at")).first()
    n = partitions(docs.sparkSession, seen.bytes or 0, 16 << 20)
    d = d.withColumn("row", F.xxhash64("text"))
    dealt = _held(d, "b", _bucket(seen.rows, list(seen.at or [])))
    buckets = _next_bucket(dealt.select("b").distinct())
    dealt = dealt.repartition(n, "b")
    line = Window.partitionBy("b").orderBy(F.col("doc_id").desc_nulls_last(), F.col("row").desc())
    first = dealt.withColumn("place", F.row_number().over(line)).filter("place = 1").select("b", F.col("text").alias("first_text"))
    first = first.join(buckets, "b").select(F.col("above").alias("b"), "first_text")
    first = with_signatures(first, "first_text", "first_sigs")
    own = with_signatures(dealt, "text", "sigs")
    own = own.withColumn("next_text", F.lead("text").over(line)).withColumn("next_sigs", F.lead("sigs").over(line))
    own = own.join(first, "b")
    own = own.withColumn("next_sigs", F.coalesce("next_sigs", "first_sigs")).withColumn("next_text", F.coalesce("next_text", "first_text"))
    own = own.withColumn("n_chars", F.char_length("text"))
    edited = F.expr("concat(substring(text, 1, n_chars - n_chars div 2), substring(next_text, 1, cast(n_chars div 2 as int)))")
    own = with_signatures(own.withColumn("edited", edited), "edited", "edited_sigs")
    return own.select(
        "doc_id", F.col("n_chars").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_string("sigs").alias("fingerprint"), as_string("edited_sigs").alias("edited_fingerprint"),
        likeness("sigs", "edited_sigs").alias("near_edited"), likeness("sigs", "next_sigs").alias("near_next"),
        F.size("sigs").cast("long").alias("n_signatures"),
    )


def _common(sigs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The signatures that most rows have, at most COMMON of them and none that one row alone has, sorted, and how many rows have each."""
    counts = durable(sigs.groupBy("sig").agg(F.count("*").alias("df")).filter("df > 1"))
    least, room = None, COMMON
    for r in counts.groupBy("df").agg(F.count("*").alias("n")).orderBy(F.col("df").desc()).limit(COMMON).toLocalIterator():
        room -= r.n
        if room < 0:
            break
        least = r.df
    found = counts.filter(F.col("df") >= least if least is not None else F.lit(False)).toArrow()
    sig, df = found.column("sig").to_numpy(), found.column("df").to_numpy()
    order = np.argsort(sig)
    return sig[order], df[order]


def _heads(classes: DataFrame, t: float) -> DataFrame:
    """id, n, sig: of each class the rarest of its n signatures, as many as a partner at the threshold can't all miss."""
    shared = classes.sparkSession.sparkContext.broadcast(_common(classes.select(F.explode("sigs").alias("sig"))))

    def kernel(batches):
        common, df = shared.value
        for batch in batches:
            sets = batch.column(1)
            n = sets.value_lengths().to_numpy()
            sig, row = sets.flatten().to_numpy(), np.repeat(np.arange(len(n)), n)
            at = np.minimum(np.searchsorted(common, sig), max(len(common) - 1, 0))
            rank = np.where(common[at] == sig, df[at], 0) if len(common) else np.zeros(len(sig), np.int64)
            order = np.lexsort((sig, rank, row))  # by row, in the one order that all tasks go by
            place = np.arange(len(sig)) - np.repeat(np.cumsum(n) - n, n)
            own = order[place < np.repeat(n - np.ceil(t * n - 1e-9).astype(np.int64) + 1, n)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[own])), pa.array(n[row[own]].astype(np.int32)), pa.array(sig[own])], ["id", "n", "sig"])

    return classes.select("id", "sigs").mapInArrow(kernel, "id long, n int, sig long")


def near_pairs(docs: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): pairs of classes (a, b, likeness) at or over the threshold, and each doc_id's class.

    A class is the documents of one fingerprint, named by its smallest doc_id, so copies give no pairs; documents meet by 128
    bits of a hash of it. A class's signatures are ordered by how many classes have them, the rarest first; it is filed under the first of
    them (as many as a partner at the threshold can't all miss) and the partitions of set length that a partner can lie
    in, so what a common passage leaves in many texts brings few of them together. Filed classes whose lengths allow the
    threshold are compared by full Jaccard.

    Sets of signatures are shuffled to make classes and for what is compared; a signature alone is, to count it and where it is filed.

    Texts without signatures pair with none, rows without doc_id are left out, a doc_id that repeats with other texts
    is a member of several classes. No rows give none."""
    t = F.lit(threshold)
    own = with_signatures(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).filter("doc_id is not null"), "text", "sigs")
    own = durable(own.select("doc_id", F.xxhash64("sigs").alias("k"), F.xxhash64(F.lit(17), "sigs").alias("l"), "sigs"))
    first = own.groupBy("k", "l").agg(F.min(F.struct("doc_id", "sigs")).alias("x"))
    classes = durable(first.select("k", "l", F.col("x.doc_id").alias("first"), F.col("x.sigs").alias("sigs"), F.monotonically_increasing_id().alias("id")))
    members = own.select("doc_id", "k", "l").distinct().join(classes.select("k", "l", "first"), ["k", "l"]).select("doc_id", F.col("first").alias("class_id"))
    part = F.floor(F.log("n") / -F.log(t)).cast("int")
    filed = durable(_heads(classes, threshold).withColumn("p", part))
    left = filed.select(F.col("id").alias("a"), F.col("n").alias("na"), "sig", "p", F.col("p").alias("pa"))
    right = filed.select(F.col("id").alias("b"), F.col("n").alias("nb"), "sig", F.explode(F.array(F.col("p"), F.col("p") + 1)).alias("p"), F.col("p").alias("pb"))
    lengths = F.least("na", "nb") >= t * F.greatest("na", "nb") - 1e-9
    once = (F.col("a") < F.col("b")) | (F.col("pa") > F.col("pb"))
    pairs = left.join(right, ["sig", "p"]).filter(once & lengths).select("a", "b").distinct()
    side = lambda k, sigs: classes.select(F.col("id").alias(k), F.col("first").alias(f"{k}_first"), F.col("sigs").alias(sigs))
    pairs = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").withColumn("likeness", likeness("x", "y")).filter(F.col("likeness") >= threshold - 1e-9)
    return pairs.select(F.least("a_first", "b_first").alias("a"), F.greatest("a_first", "b_first").alias("b"), "likeness"), members


def near_classes(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of the same fingerprint), n_links (classes that are like it) of each document that has an id."""
    pairs, members = near_pairs(docs, threshold)
    ends = pairs.select(F.col("a").alias("class_id")).unionByName(pairs.select(F.col("b").alias("class_id")))
    return members.join(ends.groupBy("class_id").agg(F.count("*").alias("n_links")), "class_id", "left").select("doc_id", "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
