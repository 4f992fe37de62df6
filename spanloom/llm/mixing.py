"""Mixing of sources to target weights by Efraimidis-Spirakis sampling, after complete epochs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cluster import durable
from .native import SPACES, words

#: Buckets of keys to a doubling: each holds under 3 in 10,000 of the documents of any one weight.
FINE = 1024


def targets(sources: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), most: float = 3.0) -> DataFrame:
    """sources: source, source_size. Adds target: the sum of all sizes shared by weight (repeating, in code
    point order, null last), none above ``most`` times its size, the excess reshared by weight.

    Sources are few names, ordered and summed as one small table.

    In the order of size by weight, the sources that reach their limit come first: the share per weight
    that remains is that of the first one that does not reach it."""
    by_name, all_rows = Window.orderBy(F.col("source").asc_nulls_last()), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = sources.withColumn("w", F.get(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))))
    s = s.withColumn("cap", F.col("source_size") * F.lit(most)).withColumn("total", F.sum("source_size").over(all_rows))
    line = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, after = line.rowsBetween(Window.unboundedPreceding, -1), line.rowsBetween(0, Window.unboundedFollowing)
    s = s.withColumn("share", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after))
    s = s.withColumn("level", F.max(F.when(F.col("share") * F.col("w") <= F.col("cap"), F.col("share"))).over(all_rows))
    return s.select("source", "source_size", F.least("cap", F.coalesce("level", F.lit(0.0)) * F.col("w")).alias("target"))


def mix(docs: DataFrame, quality: DataFrame | None = None, weights: tuple[float, ...] = (5.0, 2.0, 1.0), most: float = 3.0, seed: int = 1) -> DataFrame:
    """doc_id, source, size, source_size, target, epochs, chosen, taken, row of each row of docs; row: a hash of the text.

    quality: doc_id, weight (> 0; documents without one weigh 1). A source is taken whole as often as its
    target allows. For the rest each of its documents has an exponential key -ln(u) / weight, u a hash of
    seed, doc_id and text; documents are chosen by smallest key until their sizes add up to the rest. ``taken``
    counts the words: of the last document only its first ones, up to the rest. ``chosen`` is for takers
    of whole documents: the last one is, if that brings the sum nearer. Sums are made by buckets of the key's logarithm, which
    hold alike shares at every weight, then by a thousand buckets inside the one where a source's rest
    ends, and documents are sorted only inside the last of these; no source is sorted or summed in one task.

    A null text has size 0; a null source is a source. Repeated rows are documents of their own and
    get results that are equal or differ only as ties of one key must. Reruns agree. No rows give none."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.size(words(F.col("text"), SPACES)).cast("long").alias("size"), F.xxhash64("text").alias("row"))
    if quality is not None:
        q = quality.filter("doc_id is not null and weight > 0").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("weight").alias("weight"))
        d = d.join(q, "doc_id", "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    else:
        d = d.withColumn("weight", F.lit(1.0))
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "row"), 11) + 0.5) / float(1 << 53)
    d = d.withColumn("key", -F.log(u) / F.col("weight"))
    place = F.log2("key") * FINE
    d = d.withColumn("bucket", F.floor(place)).withColumn("inner", F.floor((place - F.floor(place)) * 1000))
    d = durable(d.drop("weight"))
    sources = targets(d.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    sources = sources.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-9)).otherwise(0))
    sources = sources.withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("epochs") * F.col("source_size"))).withColumn("below", F.lit(0).cast("long"))
    sources = durable(sources.withColumnRenamed("source", "_source"))
    ends = _ends(d, sources, "bucket")
    within = d.join(ends.select("_source", "bucket_end"), F.col("source").eqNullSafe(F.col("_source")) & (F.col("bucket") == F.col("bucket_end"))).drop("_source", "bucket_end")
    ends = durable(_ends(within, ends, "inner"))
    d = d.join(ends, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    side = F.when(F.col("bucket") != F.col("bucket_end"), F.signum(F.col("bucket_end") - F.col("bucket"))).otherwise(F.signum(F.col("inner_end") - F.col("inner")))
    d = d.withColumn("side", side)
    sure = d.filter("side <> 0").withColumn("chosen", F.col("side") > 0).withColumn("part", F.when(F.col("chosen"), F.col("size")).otherwise(0))
    inside = Window.partitionBy("source").orderBy("key", "doc_id", "row").rowsBetween(Window.unboundedPreceding, 0)
    cut = d.filter("side = 0").withColumn("upto", F.col("below") + F.sum("size").over(inside))
    cut = cut.withColumn("chosen", F.col("upto") - F.col("size") / 2 <= F.col("rest"))
    left = F.floor(F.col("rest") + 0.5) - (F.col("upto") - F.col("size"))
    cut = cut.withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), left))).drop("upto")
    out = sure.unionByName(cut).withColumn("chosen", F.col("chosen") & (F.col("rest") > 0))
    return out.select("doc_id", "source", "size", "source_size", "target", "epochs", "chosen", (F.col("size") * F.col("epochs") + F.col("part")).cast("long").alias("taken"), "row")


def _ends(d: DataFrame, sources: DataFrame, bucket: str) -> DataFrame:
    """Of each source the first bucket at whose end the sizes reach the rest, else the last (bucket_end), and the sizes before it (below)."""
    sums = d.groupBy("source", bucket).agg(F.sum("size").alias("sum"))
    up_to = Window.partitionBy("source").orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("upto", F.sum("sum").over(up_to)).join(sources, F.col("source").eqNullSafe(F.col("_source")))
    sums = sums.withColumn("late", F.col("below") + F.col("upto") < F.col("rest"))
    first = sums.groupBy(F.col("_source").alias("_s")).agg(F.min(F.struct("late", F.when(F.col("late"), -F.col(bucket)).otherwise(F.col(bucket)).alias("order"), bucket, (F.col("below") + F.col("upto") - F.col("sum")).alias("before"))).alias("end"))
    found = sources.drop("below").join(first, F.col("_source").eqNullSafe(F.col("_s")))
    return found.select("*", F.col(f"end.{bucket}").alias(f"{bucket}_end"), F.col("end.before").alias("below")).drop("_s", "end")


def by_labels(labels: DataFrame) -> DataFrame:
    """Weights from quality labels: good documents are drawn four times as readily as unlabelled ones, bad ones a quarter."""
    return labels.select("doc_id", F.when(F.col("quality") == 1, 4.0).when(F.col("quality") == 0, 0.25).otherwise(1.0).alias("weight"))
