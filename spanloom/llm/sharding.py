"""Shards by fixed virtual slots and a versioned map from slots to shards, on built-in functions alone."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .cluster import durable, shared_folder

SLOTS = 4096


def slot_of(slots: int = SLOTS) -> Column:
    """The virtual slot of a record: a hash of doc_id and text, so that no key is hot, not even null."""
    return F.pmod(F.xxhash64(F.lit(29), "doc_id", "text"), F.lit(slots)).cast("int")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, vslot of each row: all that sharding reads of the documents."""
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32")
    return docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), crc, slot_of().alias("vslot"))


def slot_table(rows: DataFrame) -> DataFrame:
    """vslot, bytes, rows: at most SLOTS rows, summed on each side of the shuffle. rows: of sized()."""
    return rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))


def first_map(slots: DataFrame, shards: int) -> DataFrame:
    """version 1, vslot, shard, bytes, rows: slots by falling size, each to the shard that has least so far.

    One row holds the table of slots, whose number is fixed; a fold over it keeps the shards' sums."""
    start = f"named_struct('load', transform(sequence(1, {shards}), x -> 0L), 'at', cast(array() as array<int>))"
    least = "cast(array_position(acc.load, array_min(acc.load)) as int)"
    fold = f"""aggregate(s, {start}, (acc, x) -> named_struct(
        'load', transform(acc.load, (v, i) -> if(i = {least} - 1, v + x.bytes, v)),
        'at', array_append(acc.at, {least} - 1))).at"""
    row = slots.groupBy().agg(F.expr("array_sort(collect_list(struct(bytes, vslot, rows)), (x, y) -> case when x.bytes <> y.bytes then if(x.bytes > y.bytes, -1, 1) when x.vslot < y.vslot then -1 when x.vslot > y.vslot then 1 else 0 end)").alias("s"))
    return row.select(F.explode(F.expr(f"zip_with(s, {fold}, (x, k) -> struct(x.vslot, k as shard, x.bytes, x.rows))")).alias("m")).select(F.lit(1).alias("version"), "m.*")


def grown_map(old: DataFrame, shards: int) -> DataFrame:
    """The next version of a map for one shard more than its ``shards``: each shard gives slots, the smallest
    first, as far as what it has is over the new mean; no slot moves between old shards."""
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    mean = F.sum("bytes").over(every) / (shards + 1)
    has = F.sum("bytes").over(Window.partitionBy("shard"))
    given = F.sum("bytes").over(Window.partitionBy("shard").orderBy("bytes", "vslot").rowsBetween(Window.unboundedPreceding, 0))
    goes = given <= has - mean
    return old.select((F.col("version") + 1).alias("version"), "vslot", F.when(goes, shards).otherwise(F.col("shard")).alias("shard"), "bytes", "rows")


def save_map(table: DataFrame, path: str) -> None:
    """Adds a version to the stored maps; older versions stay readable. A version that is there already is an error."""
    versions = [r[0] for r in table.select("version").distinct().collect()]
    for v in versions or [1]:  # an empty map is a first version without slots
        table.filter(F.col("version") == v).drop("version").coalesce(1).write.mode("error").parquet(f"{path}/version={v}")


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A stored version of the map, the newest unless one is named."""
    maps = spark.read.parquet(path)
    newest = maps.agg(F.max("version")).first()[0] if version is None else version
    return maps.filter(F.col("version") == newest).select("version", "vslot", "shard", "bytes", "rows")


def shard(docs: DataFrame, shards: int = 8, maps: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, vslot, version of each row of docs.

    maps: a folder of stored maps, whose newest is followed; without one the first map is made from these rows, stored
    as version 1 in the shared folder and read from there. Sizes of shards differ by no
    more than the largest slot (law ``bytes``). slot: the row's place in its shard, from 0 without gaps:
    the places of a virtual slot follow those of the smaller slots of its shard. The documents are read once.

    A null text has size 1 and the checksum of no bytes; rows without doc_id go by their text. Repeated rows have
    places of their own. An empty table gives none; a slot that a given map lacks goes to the shard that its number names."""
    spark = docs.sparkSession
    d = durable(sized(docs))
    slots = slot_table(d)
    if maps is None:
        maps = f"{shared_folder(spark)}/slot-maps-{uuid.uuid4().hex}"
        save_map(first_map(slots, shards), maps)
    m = slots.select("vslot", F.col("rows").alias("n")).join(load_map(spark, maps).select("version", "vslot", "shard"), "vslot", "left")
    m = m.withColumn("shard", F.coalesce("shard", F.pmod("vslot", F.lit(shards))))
    m = m.withColumn("before", F.sum("n").over(Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    place = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "size", "text_crc32")) - 1
    out = d.withColumn("place", place).join(F.broadcast(m), "vslot")  # m: at most SLOTS rows
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("before") + F.col("place")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "vslot", "version")
