"""Kernels on pictures: arrays of red, green and blue in turn (from 0 to 255), a row of pixels after the other; built-in functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Thousandths of red, green and blue in a pixel's luma, and what makes a value of a network's input.
LUMA = (299, 587, 114)
MIDDLE, SCALE = 127, 128


def gray_thumb(rgb: str, w: int, h: int, tw: int, th: int) -> Column:
    """The picture's luma in tw x th blocks, the mean of each, half up. Block (x, y) is the pixels from floor(x * w / tw) on to before the next
    block's first, at least one; one that lies outside has none and is 0."""
    luma = "(" + " + ".join(f"{f}L * get({rgb}, (y * {w} + x) * 3 + {k})" for k, f in enumerate(LUMA)) + ")"
    row = f"aggregate(filter(sequence(x0, x1 - 1), x -> x < {w}), 0L, (a, x) -> a + {luma})"
    total = f"aggregate(filter(sequence(y0, y1 - 1), y -> y < {h}), 0L, (a, y) -> a + {row})"
    # Bounds of a block, put in by name: first and last of its rows and columns.
    bounds = {"y1": f"greatest(y0 + 1, (i div {tw} + 1) * {h} div {th})", "y0": f"(i div {tw}) * {h} div {th}", "x1": f"greatest(x0 + 1, (i % {tw} + 1) * {w} div {tw})", "x0": f"(i % {tw}) * {w} div {tw}"}
    count = f"(least(y1, {h}) - y0) * (least(x1, {w}) - x0)"
    value = f"if({count} > 0, floor({total} / ({count} * 1000D) + 0.5D), 0)"
    for name, text in bounds.items():
        value = value.replace(name, f"({text})")
    return F.expr(f"transform(sequence(0, {tw * th - 1}), i -> cast({value} as int))")


def boxed(rgb: str, w: int, h: int, into_w: int, into_h: int) -> Column:
    """The picture in the middle of a larger one, black around it (the odd pixel below or right), as a network takes it: all reds, then greens,
    then blues, each (v - MIDDLE) / SCALE. A picture that is larger is an error, as cutting it would lose pixels."""
    if w > into_w or h > into_h:
        raise ValueError(f"a picture of {w} x {h} does not fit into {into_w} x {into_h}")
    top, left, plane = (into_h - h) // 2, (into_w - w) // 2, into_w * into_h
    y, x = f"(i % {plane} div {into_w} - {top})", f"(i % {into_w} - {left})"
    value = f"if({y} between 0 and {h - 1} and {x} between 0 and {w - 1}, get({rgb}, cast(({y} * {w} + {x}) * 3 + i div {plane} as int)), 0)"
    return F.expr(f"transform(sequence(0, {3 * plane - 1}), i -> ({value} - {MIDDLE}) / {float(SCALE)}D)")


def letterbox(rgb: str, w: int, h: int, into_w: int = 320, into_h: int = 240) -> Column:
    """A picture as wide as the input, with bars above and below."""
    if w != into_w:
        raise ValueError(f"a picture {into_w} wide is wanted, not {w}")
    return boxed(rgb, w, h, into_w, into_h)


def pillarbox(rgb: str, w: int, h: int, into_w: int = 320, into_h: int = 240) -> Column:
    """A picture as high as the input, with bars left and right."""
    if h != into_h:
        raise ValueError(f"a picture {into_h} high is wanted, not {h}")
    return boxed(rgb, w, h, into_w, into_h)


def _pictures(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as pictures of 8 x 8: pixel p is components p, 63 - p and 7 p modulo 64, of whole vectors."""
    level = lambda k: f"cast(least(255, greatest(0, floor((get(embedding, {k}) + 1) * 127.5D))) as int)"
    rgb = F.expr(f"flatten(transform(sequence(0, 63), p -> array({level('p')}, {level('63 - p')}, {level('p * 7 % 64')})))")
    return spark.read.parquet(f"{d}/embeddings.parquet").filter("size(embedding) = 64").select(F.col("vec_id").alias("id"), rgb.alias("rgb"))


def _digest(values: str) -> Column:
    """The values' sum, each by its place."""
    return F.expr(f"aggregate(zip_with({values}, sequence(1, size({values})), (x, k) -> cast(x as double) * k), 0D, (a, x) -> a + x)")


def _thumbs(spark: SparkSession, d: str) -> DataFrame:
    t = _pictures(spark, d).select("id", gray_thumb("rgb", 8, 8, 3, 5).alias("small"), gray_thumb("rgb", 8, 8, 10, 9).alias("large"))
    return t.select("id", F.array_join("small", " ").alias("small"), _digest("large").alias("large"))


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    t = _pictures(spark, d).select("id", letterbox("rgb", 8, 8, 8, 13).alias("l"), pillarbox("rgb", 8, 8, 11, 8).alias("p"))
    return t.select("id", _digest("l").alias("letterboxed"), _digest("p").alias("pillarboxed"))


QUERIES = {"frame_thumbs": _thumbs, "frame_boxes": _boxes}

_PIXELS = """
c AS (SELECT vec_id AS id, generate_subscripts(embedding, 1) - 1 AS k, least(255, greatest(0, floor((unnest(embedding)::DOUBLE + 1) * 127.5)))::INT AS v FROM embeddings WHERE len(embedding) = 64),
p AS MATERIALIZED (SELECT r.id, r.k % 8 AS x, r.k // 8 AS y, r.v AS r, g.v AS g, b.v AS b FROM c r JOIN c g ON g.id = r.id AND g.k = 63 - r.k JOIN c b ON b.id = r.id AND b.k = r.k * 7 % 64)"""


def _sql_thumb(name: str, tw: int, th: int) -> str:
    """A row a block: the mean of the pixels that lie in it."""
    return f"""{name} AS (SELECT id, ty * {tw} + tx AS i, floor(sum(299 * r + 587 * g + 114 * b) / (count(*) * 1000e0) + 0.5)::INT AS v FROM p, range({tw}) a(tx), range({th}) o(ty)
  WHERE x >= tx * 8 // {tw} AND x < greatest(tx * 8 // {tw} + 1, (tx + 1) * 8 // {tw}) AND y >= ty * 8 // {th} AND y < greatest(ty * 8 // {th} + 1, (ty + 1) * 8 // {th}) GROUP BY id, ty, tx)"""


def _sql_box(name: str, w: int, h: int) -> str:
    plane, top, left = w * h, (h - 8) // 2, (w - 8) // 2
    places = " + ".join(f"((v.{c} - 127) / 128e0 + 127 / 128e0) * ({k} * {plane} + (v.y + {top}) * {w} + v.x + {left} + 1)" for k, c in enumerate("rgb"))
    return f"{name} AS (SELECT id, sum({places}) - {3 * plane * (3 * plane + 1) // 2} * 127 / 128e0 AS s FROM p v GROUP BY id)"


ORACLE = {
    "frame_thumbs": f"""WITH {_PIXELS}, {_sql_thumb("s", 3, 5)}, {_sql_thumb("l", 10, 9)}
SELECT id, small, large FROM (SELECT id, string_agg(v::VARCHAR, ' ' ORDER BY i) AS small FROM s GROUP BY id) JOIN (SELECT id, sum(v * (i + 1))::DOUBLE AS large FROM l GROUP BY id) USING (id)""",
    "frame_boxes": f"WITH {_PIXELS}, {_sql_box('l', 8, 13)}, {_sql_box('q', 11, 8)} SELECT id, l.s AS letterboxed, q.s AS pillarboxed FROM l JOIN q USING (id)",
}
