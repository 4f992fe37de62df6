"""G1: greedy suppression of overlapping spans in rounds of local winners, without an order of a whole source.

Spans are filed in cells: a class of lengths, and a place on the time line about as wide as the lengths of the class. Only spans of
neighbouring classes and places can overlap as much as is asked, so a cell has a bounded number of neighbours. In a round
the best span of each cell stays if no better span of a neighbouring cell overlaps it; what overlaps those that stay goes. The
result is that of looking at all spans of a source one after the other, the best first."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.plans.durable import durable

#: Lengths of a class differ by a little more than the share that an overlap can leave, so that rounding can't part two that are near.
SPREAD = 1.001
_UNORDERED = re.compile("map<|variant")


def _classes(iou: float) -> float:
    return SPREAD / iou


def _overlap(a: str, b: str, iou: float) -> str:
    """Whether two spans of one source have an IoU of ``iou`` or more."""
    both, union = f"(least({a}.e, {b}.e) - greatest({a}.s, {b}.s))", f"(greatest({a}.e, {b}.e) - least({a}.s, {b}.s))"
    return f"({both} > 0 and {both} >= {iou}D * {union} and {a}.src <=> {b}.src)"


def _class(span: str, iou: float) -> str:
    return f"cast(floor(ln({span}.e - {span}.s) / {math.log(_classes(iou))!r}D) as bigint)"


def _cell(span: str, iou: float) -> Column:
    """The cell of a span, as a hash: cells that share one cost time and change nothing."""
    return F.expr(f"xxhash64({span}.src, {_class(span, iou)}, cast(floor({span}.s / power({_classes(iou)!r}D, {_class(span, iou)} + 1)) as bigint))")


def _around(span: str, iou: float) -> Column:
    """The cells in which spans may lie that overlap this one by ``iou``: their starts are at most (1 - iou) / iou of the shorter length apart."""
    base, reach = _classes(iou), (1 - iou) / iou * (1 + 1e-9)
    width = f"power({base!r}D, {_class(span, iou)} + 1 + j)"
    far = f"({reach!r}D * least({span}.e - {span}.s, {width}) + 1e-9D)"
    cells = [f"transform(sequence(cast(floor(({span}.s - {far}) / {width}) as bigint), cast(floor(({span}.s + {far}) / {width}) as bigint)), c -> xxhash64({span}.src, {_class(span, iou)} + j, c))".replace(" + j", f" + {j}") for j in (-1, 0, 1)]
    return F.expr(f"concat({', '.join(cells)})")


def suppress(spans: DataFrame, iou: float = 0.5, score: str = "score") -> DataFrame:
    """The rows of spans (src, id, s, e, the score, and more) that stay: by falling score, then id, a span goes if its IoU with one that
    stays is ``iou`` or more. Spans without a score come last; of rows equal in source and bounds the best one is looked at alone, of
    equally good ones that of the least columns; a span that doesn't last, or lacks a bound, overlaps nothing. Sources that are null are one source.

    Each round is a few shuffles by cell and is checkpointed; what comes to the driver is whether spans are undecided. A cell's rows
    meet the best spans of its neighbours, a bounded number, so no group is compared with itself, and a crowded cell can be split."""
    row = F.struct(*(F.col(f"`{c}`") for c in spans.columns))
    best = F.struct(F.coalesce(-F.col(score).cast("double"), F.lit(math.inf)).alias("k"), "id", F.col("s").cast("double").alias("s"), F.col("e").cast("double").alias("e"), "src")
    own = spans.select(best.alias("p"), row.alias("row"))
    order = F.struct("p", *(F.col(f"row.`{f.name}`") for f in spans.schema.fields if not _UNORDERED.search(f.dataType.simpleString())))
    open_ = own.filter("p.e > p.s").groupBy(F.struct("p.src", "p.s", "p.e").alias("same")).agg(F.min("p").alias("p"), F.min_by("row", order).alias("row"))
    open_, kept = durable(open_.select(_cell("p", iou).alias("cell"), "p", "row")), [own.filter("not coalesce(p.e > p.s, false)").select("row")]
    while not open_.isEmpty():
        first = open_.groupBy("cell").agg(F.min("p").alias("p"), F.min_by("row", "p").alias("row"))
        near = first.select(F.col("cell").alias("of"), F.col("p").alias("q"), F.explode(_around("p", iou)).alias("cell"))
        beaten = open_.select("cell", "p").join(near, "cell").filter(f"p < q and {_overlap('p', 'q', iou)}").select(F.col("of").alias("cell")).distinct()
        won = durable(first.join(beaten, "cell", "left_anti"))
        kept.append(won.select("row"))
        gone = won.select(F.col("p").alias("q"), F.explode(_around("p", iou)).alias("at"))
        open_ = durable(open_.join(gone, (F.col("cell") == F.col("at")) & F.expr(_overlap("p", "q", iou)), "left_anti"))
    out = kept[0]
    for part in kept[1:]:
        out = out.unionByName(part)
    return out.select("row.*")
