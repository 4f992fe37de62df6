"""Stores that are replaced whole, changed by key, or appended to by a stream, while others read them."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .files import upsert


def _fs(spark: SparkSession, path: str):
    """The file system of a path, and the path as it knows it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete versions of a store, in order: those whose writer's job was committed."""
    fs, root = _fs(spark, path)
    if not fs.exists(root):
        return []
    names = [s.getPath() for s in fs.listStatus(root) if s.isDirectory() and s.getPath().getName().startswith("version=")]
    done = spark._jvm.org.apache.hadoop.fs.Path
    return sorted(int(p.getName()[8:]) for p in names if fs.exists(done(p, "_SUCCESS")))


def replace(df: DataFrame, path: str, keep: int = 2) -> int:
    """A3: writes df as the store's next version and gives its number. A reader sees the old version until the new one is complete, and
    one that began before can go on reading the old one: ``keep`` versions stay. A writer that fails leaves no version."""
    spark = df.sparkSession
    have = versions(spark, path)
    fs, root = _fs(spark, path)
    taken = [int(s.getPath().getName()[8:]) for s in fs.listStatus(root) if s.getPath().getName().startswith("version=")] if fs.exists(root) else []
    new = max(taken, default=0) + 1
    df.write.mode("errorifexists").parquet(f"{path}/version={new}")
    for old in [*have, new][:-keep]:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version={old}"), True)
    return new


def current(spark: SparkSession, path: str, default: DataFrame | None = None) -> DataFrame:
    """The store's newest complete version; the default where it has none."""
    have = versions(spark, path)
    if not have:
        if default is None:
            raise FileNotFoundError(path)
        return default
    return spark.read.parquet(f"{path}/version={have[-1]}")


def create_keyed(df: DataFrame, path: str, key: str, buckets: int = 64) -> None:
    """A store whose rows are filed by a hash of their key in so many folders."""
    df.withColumn("bucket", _bucket(key, buckets)).repartition("bucket").write.partitionBy("bucket").parquet(path)


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")


def upsert_keyed(new: DataFrame, path: str, key: str, buckets: int = 64, stamp: Column | None = None) -> None:
    """Puts new's rows (one a key) in place of those of their keys. Only folders that new's keys fall into are read and
    written; what they will hold is staged first, since a folder can't be read while it is replaced. Rows get ``updatedAt``, if a stamp is
    given. Nothing new changes nothing; the driver learns which of the bounded number of folders are touched."""
    spark = new.sparkSession
    staged = f"{path}-staged-{uuid.uuid4().hex}"
    old = spark.read.parquet(path)
    fresh = new if stamp is None else new.withColumn("updatedAt", stamp)
    fresh.withColumn("bucket", _bucket(key, buckets)).write.parquet(f"{staged}/new")
    fresh = spark.read.parquet(f"{staged}/new")
    touched = [r.bucket for r in fresh.select("bucket").distinct().collect()]
    if touched:
        upsert(old.filter(F.col("bucket").isin(touched)), fresh, key).write.parquet(f"{staged}/merged")
        merged = spark.read.parquet(f"{staged}/merged")
        merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    fs, at = _fs(spark, staged)
    fs.delete(at, True)


def read_key(spark: SparkSession, path: str, key: str, value, buckets: int = 64) -> DataFrame:
    """The rows of one key, from its folder alone."""
    kind = spark.read.parquet(path).schema[key].dataType
    at = spark.range(1).select(F.pmod(F.xxhash64(F.lit(value).cast(kind).cast("string")), F.lit(buckets)).cast("int")).first()[0]
    return spark.read.parquet(path).filter((F.col("bucket") == at) & (F.col(key) == F.lit(value))).drop("bucket")


def append_stream(spark: SparkSession, incoming: str, schema: str | StructType, path: str, progress: str, files: int | None = None) -> None:
    """A4: appends the JSON lines of new files under ``incoming`` to the lines under ``path`` and ends when there are no more. What was
    taken is noted under ``progress``, so a run that was lost is taken up where it was, and no line comes twice. files: how many a batch."""
    source = spark.readStream.schema(schema)
    source = source.option("maxFilesPerTrigger", files) if files else source
    run = source.json(incoming).writeStream.format("json").option("path", path).option("checkpointLocation", progress).trigger(availableNow=True).start()
    run.awaitTermination()
