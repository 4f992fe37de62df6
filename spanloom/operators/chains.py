"""Chains of links that each point from a row of a source to a later one, followed by doubling."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.plans.durable import durable


def follow(links: DataFrame, starts: DataFrame) -> DataFrame:
    """links: src, i, j (at most one j an i, no cycles); starts: src, i. src, i of all that the links lead to from the starts, and they.

    Links of 1, 2, 4, ... steps are joined with themselves, so a chain of n links takes log n rounds however
    long one source's is. Each round is checkpointed; the driver asks only whether a link is left."""
    reached = starts.select("src", "i").distinct()
    step = durable(links.select("src", "i", "j").filter("j is not null"))
    while not step.isEmpty():
        twice = _composed(step, step)
        reached = reached.unionByName(_moved(reached, step))
        reached = durable(reached.unionByName(_moved(reached, twice)))
        step = durable(_composed(twice, twice))
    return reached


def _composed(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("src", "i", F.col("j").alias("m")).join(b.select("src", F.col("i").alias("m"), "j"), ["src", "m"]).select("src", "i", "j")


def _moved(nodes: DataFrame, step: DataFrame) -> DataFrame:
    return nodes.join(step, ["src", "i"]).select("src", F.col("j").alias("i"))


def windows(sentences: DataFrame, length: float = 600.0, overlap: float = 60.0) -> DataFrame:
    """Src, first, last: windows of whole sentences (src, id, s), ids in order of s. A window holds the sentences that begin within
    ``length`` of its first one's start; the next begins with the first sentence at or after that start plus length - overlap, or with
    the last one where none is so late, until a window holds the source's last sentence.

    Where a sentence's window would end and the next begin is found in one sorted pass of its source; which
    sentences begin windows follows from there."""
    if not (overlap < length < math.inf and overlap > -math.inf):
        raise ValueError("a window must be longer than its overlap, and both must be finite")
    own = sentences.select("src", F.col("id").cast("long").alias("i"), F.col("s").cast("double").alias("s"))
    mark = lambda t, kind, i, of: F.struct(t.alias("t"), F.lit(kind).alias("kind"), i.cast("long").alias("i"), of.cast("long").alias("of"))
    s, i, none = F.col("s"), F.col("i"), F.lit(None)
    # At equal times the next window's begin comes after sentences, looking back from the end, and the window's end before them.
    marks = own.select("src", F.explode(F.array(mark(s, 1, i, none), mark(s + length, 0, none, i), mark(s + (length - overlap), 0, none, -1 - i))).alias("m")).select("src", "m.*")
    line = Window.partitionBy("src").orderBy("t", "kind", "i", "of")
    upto, from_ = line.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("src").orderBy(F.col("t").desc(), F.col("kind").desc(), F.col("i").desc(), "of").rowsBetween(Window.unboundedPreceding, 0)
    found = marks.select("src", "of", F.last("i", ignorenulls=True).over(upto).alias("before"), F.last("i", ignorenulls=True).over(from_).alias("after"), F.max("i").over(Window.partitionBy("src")).alias("end")).filter("of is not null")
    per = found.groupBy("src", F.when(F.col("of") >= 0, F.col("of")).otherwise(-1 - F.col("of")).alias("i")).agg(F.max(F.when(F.col("of") >= 0, F.col("before"))).alias("last"), F.max(F.when(F.col("of") < 0, F.col("after"))).alias("next"), F.max("end").alias("end"))
    per = durable(per)
    begin = follow(per.select("src", "i", F.when(F.col("last") < F.col("end"), F.coalesce("next", "end")).alias("j")), per.groupBy("src").agg(F.min("i").alias("i")))
    return begin.join(per, ["src", "i"]).select("src", F.col("i").alias("first"), "last")
