"""Connected components of a table of links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import durable


def _both(df: DataFrame, first: tuple[str, str], second: tuple[str, str], names: tuple[str, str]) -> DataFrame:
    """Two pairs of each row, from one pass over the rows."""
    pairs = [F.struct(F.col(a).alias(names[0]), F.col(b).alias(names[1])) for a, b in (first, second)]
    return df.select(F.inline(F.array(*pairs)))


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links: u > v. Large: each node's larger neighbours are linked to its smallest; small: so are its smaller ones and itself."""
    both = _both(links, ("u", "v"), ("v", "u"), ("u", "v")) if large else links
    out = both.join(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "u")
    if large:
        return out.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    return _both(out, ("v", "m"), ("u", "m"), ("u", "v")).filter("u <> v").distinct()


def _done(now: DataFrame) -> bool:
    """Whether every node is linked to one smaller node that is linked to none."""
    ends = now.select(F.inline(F.array(F.struct(F.col("u").alias("id"), F.lit(1).alias("up")), F.struct(F.col("v").alias("id"), F.lit(0).alias("up")))))
    return ends.groupBy("id").agg(F.sum("up").alias("ups"), F.min("up").alias("least")).filter("ups > 1 or ups > least").isEmpty()


def stars(links: DataFrame) -> DataFrame:
    """links: a, b of any one orderable type. Returns a, b: each linked id that isn't the smallest reachable, and that one.

    Each round is a few shuffles of the links and is checkpointed; that all are stars is seen without another round, and
    only whether they are comes to the driver. Stars found before may be among the links."""
    now = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    while True:
        now = durable(_star(_star(now, True), False))
        if _done(now):
            return now.select(F.col("u").alias("a"), F.col("v").alias("b"))


def labels(found: DataFrame) -> DataFrame:
    """Of stars: id and component (the smallest id reachable), of linked ids."""
    return _both(found, ("a", "b"), ("b", "b"), ("id", "component")).distinct()


def components(links: DataFrame) -> DataFrame:
    """links: a, b of any one orderable type. Returns id and component (the smallest id reachable), of linked ids."""
    return labels(stars(links))
