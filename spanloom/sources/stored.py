"""Queries that write files into the shared folder, as tools and earlier runs leave them, and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.plans.durable import shared_folder

from . import files, store


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _nations(spark: SparkSession, d: str, broken: bool = False) -> str:
    """A document a nation, below a folder of its own, that lists its suppliers; those of each fourth nation are cut short, if asked for."""
    entry = F.struct("s_suppkey", "s_acctbal")
    docs = _table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.collect_list(entry).alias("suppliers"))
    text = F.when(F.col("nation") % 4 == 0, F.expr("left(text, length(text) - 3)")).otherwise(F.col("text")) if broken else F.col("text")
    path = _folder(spark)
    docs.withColumn("text", F.to_json(F.struct("nation", "suppliers"), {"pretty": "true"})).select("nation", text.alias("text")).repartition("nation").write.partitionBy("nation").text(path)
    return path


_NATION = "nation long, suppliers array<struct<s_suppkey:long,s_acctbal:double>>"


def _listed(docs: DataFrame) -> DataFrame:
    return docs.select("nation", F.explode("suppliers").alias("s")).select("nation", "s.s_suppkey", "s.s_acctbal")


def scan_documents(spark: SparkSession, d: str) -> DataFrame:
    """Whole documents; the folder that a document lies in is its key."""
    docs = files.read_documents(spark, f"{_nations(spark, d)}/*/*.txt", _NATION)
    return _listed(docs.withColumn("nation", F.regexp_extract("path", "nation=([0-9]+)", 1).cast("long")))


def scan_documents_or(spark: SparkSession, d: str) -> DataFrame:
    """Documents that parse, and where there are none a default."""
    docs = files.read_documents_or(spark, f"{_nations(spark, d, broken=True)}/*/*.txt", _NATION)
    default = _table(spark, d, "region").select(F.col("r_regionkey").alias("nation"), F.expr("array(named_struct('s_suppkey', -1L, 's_acctbal', 0D))").alias("suppliers"))
    return _listed(docs).unionByName(_listed(files.read_documents_or(spark, f"{_folder(spark)}/none", _NATION, default.withColumn("nation", F.col("nation").cast("long")))))


def scan_tree(spark: SparkSession, d: str) -> DataFrame:
    """What lies below a folder, by names alone: a key for each folder that holds documents."""
    found = files.list_files(spark, _nations(spark, d), "part-")
    return found.groupBy(F.regexp_extract("path", "nation=([0-9]+)", 1).cast("long").alias("nation")).agg(F.count("*").alias("n"), F.min(F.col("size") > 0).alias("filled"))


def scan_ledger(spark: SparkSession, d: str) -> DataFrame:
    """Lines that were appended in two runs, with blank ones between."""
    e, path = _table(spark, d, "events").select("event_id", "event_type", F.col("value").alias("cost")), _folder(spark)
    files.append_lines(e.filter("event_id % 2 = 0"), path)
    files.append_lines(e.filter("event_id % 2 = 1"), path)
    spark.range(3).select(F.lit("").alias("value")).write.mode("append").text(path)
    return files.read_lines(spark, path, "event_id long, event_type string, cost double")


def scan_replaced(spark: SparkSession, d: str) -> DataFrame:
    """A3: a store replaced twice: what a reader who began before the last time goes on reading, and what one reads after it."""
    c, path = _table(spark, d, "customer").select("c_custkey", "c_acctbal"), _folder(spark)
    store.replace(c.filter("c_acctbal < 0"), path)
    store.replace(c.filter("c_acctbal >= 0"), path)
    before = store.current(spark, path)
    store.replace(c.withColumn("c_acctbal", -F.col("c_acctbal")), path)
    return before.withColumn("seen", F.lit("before")).unionByName(store.current(spark, path).withColumn("seen", F.lit("after")))


def scan_upsert_keyed(spark: SparkSession, d: str) -> DataFrame:
    """A keyed store into which rows of other and of new keys are put."""
    c, path = _table(spark, d, "customer").select("c_custkey", "c_acctbal"), _folder(spark)
    store.create_keyed(c, path, "c_custkey")
    spent = _table(spark, d, "orders").filter("o_custkey % 9 = 0").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("c_acctbal"))
    more = c.select((-1 - F.col("c_custkey")).alias("c_custkey"), (F.col("c_acctbal") * 0).alias("c_acctbal")).filter("c_custkey % 9 = 0")
    store.upsert_keyed(spent.unionByName(more), path, "c_custkey")
    return spark.read.parquet(path).select("c_custkey", "c_acctbal")


def scan_append_stream(spark: SparkSession, d: str) -> DataFrame:
    """Files that come in are appended by a stream, which is stopped and started again; then files are added."""
    e, path = _table(spark, d, "events").select("event_id", "event_type", "value"), _folder(spark)
    kinds = "event_id long, event_type string, value double"
    for part in (0, 1):
        e.filter(F.col("event_id") % 2 == part).write.mode("append").json(f"{path}/in")
        for _ in range(2):  # the second run finds nothing that is new
            store.append_stream(spark, f"{path}/in", kinds, f"{path}/out", f"{path}/progress")
    return files.read_lines(spark, f"{path}/out", kinds)


def scan_rankings(spark: SparkSession, d: str) -> DataFrame:
    """Rankings of suppliers by balance, a file a variant and nation; those of one nation can't be read."""
    path, s = _folder(spark), _table(spark, d, "supplier")
    for key, order in (("V0", -F.col("s_acctbal")), ("B-comp", F.col("s_acctbal"))):
        ranked = s.groupBy("s_nationkey").agg(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), "s_suppkey"))), lambda x: x["s_suppkey"].cast("string")).alias("ranked"))
        text = F.to_json(F.struct(F.col("s_nationkey").cast("string").alias("episodeId"), "ranked", F.lit(0.5).alias("costUsd"), F.lit(3.0).alias("durationMs")))
        ranked.select(F.when(F.col("s_nationkey") == 3, "{").otherwise(text).alias("value"), "s_nationkey").repartition("s_nationkey").write.partitionBy("s_nationkey").text(f"{path}/written/{key}")
    fs, root = store._fs(spark, f"{path}/written")
    make = spark._jvm.org.apache.hadoop.fs.Path
    for key in ("V0", "B-comp"):  # named by their episodes, as their writers do
        fs.mkdirs(make(f"{path}/rankings/{key}"))
        for folder in fs.globStatus(make(f"{path}/written/{key}/s_nationkey=*")):
            (part,) = fs.globStatus(make(folder.getPath(), "part-*"))
            fs.rename(part.getPath(), make(f"{path}/rankings/{key}/{folder.getPath().getName()[12:]}.json"))
    return files.read_rankings(spark, path).select("key", "episodeId", F.posexplode("ranked").alias("place", "id"))


def scan_cached_words(spark: SparkSession, d: str) -> DataFrame:
    """Cached words of conversations, a line each with its key; where there are none, a tombstone."""
    c = _table(spark, d, "conversations").groupBy(F.col("conv_id").alias("src")).agg(F.array_sort(F.collect_list(F.struct(F.col("turn").cast("double").alias("start"), F.col("role").alias("w")))).alias("ws"))
    words = F.transform("ws", lambda x: F.struct(x["w"].alias("w"), x["start"].alias("start"), (x["start"] + 1).alias("end")))
    path = _folder(spark)
    c.select("src", F.when(F.col("src") % 5 == 0, '{"none":true}').otherwise(F.to_json(words)).alias("json")).write.json(path)
    return files.cached_words(files.read_lines(spark, path, "src long, json string")).select("src", F.coalesce(F.size("words"), F.lit(-1)).alias("n"), F.expr("get(words, 0).w").alias("first"))


def scan_report_lines(spark: SparkSession, d: str) -> DataFrame:
    """A report, written as text and read again; a figure a kind of event."""
    e = _table(spark, d, "events").groupBy(F.col("event_type").alias("key")).agg(F.count("*").alias("n"), F.floor(F.avg("value")).cast("double").alias("mean"), F.floor(F.min("value")).cast("double").alias("lo"), F.ceil(F.max("value")).cast("double").alias("hi"))
    path = _folder(spark)
    files.write_text(files.report_lines(e.withColumn("metric", F.lit("mrr"))), path)
    return spark.read.text(path).withColumnRenamed("value", "line")


def scan_fresh_listings(spark: SparkSession, d: str) -> DataFrame:
    """The newest cached listing of a customer under a day old, of those that were enriched whole."""
    o = _table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("url"), F.col("o_orderdate").cast("timestamp").alias("fetched"), (F.col("o_orderstatus") != "P").alias("complete"), F.col("o_orderkey").alias("entries"))
    path = _folder(spark)
    o.groupBy("url", "fetched", "complete").agg(F.max("entries").alias("entries")).write.parquet(path)
    return files.fresh_listings(spark.read.parquet(path), F.lit("1998-01-01").cast("timestamp"), 24.0 * 900).select("url", "entries")


QUERIES = {f.__name__: f for f in (scan_documents, scan_documents_or, scan_tree, scan_ledger, scan_replaced, scan_upsert_keyed, scan_append_stream, scan_rankings, scan_cached_words, scan_report_lines, scan_fresh_listings)}

ORACLE = {
    "scan_documents": "SELECT s_nationkey::BIGINT AS nation, s_suppkey::BIGINT AS s_suppkey, s_acctbal FROM supplier",
    "scan_documents_or": "SELECT s_nationkey::BIGINT AS nation, s_suppkey::BIGINT AS s_suppkey, s_acctbal FROM supplier WHERE s_nationkey % 4 <> 0 UNION ALL SELECT r_regionkey, -1, 0 FROM region",
    "scan_tree": "SELECT DISTINCT s_nationkey::BIGINT AS nation, 1::BIGINT AS n, true AS filled FROM supplier",
    "scan_ledger": "SELECT event_id, event_type, value AS cost FROM events",
    "scan_replaced": "SELECT c_custkey, c_acctbal, 'before' AS seen FROM customer WHERE c_acctbal >= 0 UNION ALL SELECT c_custkey, -c_acctbal, 'after' FROM customer",
    "scan_upsert_keyed": "SELECT c_custkey, coalesce(m, c_acctbal) AS c_acctbal FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS m FROM orders WHERE o_custkey % 9 = 0 GROUP BY o_custkey) ON o_custkey = c_custkey UNION SELECT o_custkey, max(o_totalprice) FROM orders WHERE o_custkey % 9 = 0 GROUP BY o_custkey UNION ALL SELECT -1 - c_custkey, c_acctbal * 0 FROM customer WHERE (-1 - c_custkey) % 9 = 0",
    "scan_append_stream": "SELECT event_id, event_type, value FROM events",
    "scan_rankings": "SELECT key, s_nationkey::VARCHAR AS \"episodeId\", (row_number() OVER (PARTITION BY key, s_nationkey ORDER BY CASE key WHEN 'V0' THEN -s_acctbal ELSE s_acctbal END, s_suppkey) - 1)::INTEGER AS place, s_suppkey::VARCHAR AS id FROM supplier, (VALUES ('V0'), ('B-comp')) k(key) WHERE s_nationkey <> 3",
    "scan_cached_words": "SELECT conv_id AS src, CASE WHEN conv_id % 5 = 0 THEN -1 ELSE count(*) END::INTEGER AS n, CASE WHEN conv_id % 5 <> 0 THEN arg_min(role, turn) END AS first FROM conversations GROUP BY conv_id",
    "scan_report_lines": """
SELECT '| variant | ndcg_pool | ndcg_all | precision | recall | mrr |' AS line UNION ALL SELECT '|---|---|---|---|---|---|'
UNION ALL SELECT '| ' || event_type || ' | – | – | – | – | ' || floor(avg(value))::BIGINT || '.00 [' || floor(min(value))::BIGINT || '.00, ' || ceil(max(value))::BIGINT || '.00] |' FROM events GROUP BY event_type""",
    "scan_fresh_listings": "SELECT o_custkey::VARCHAR AS url, max(o_orderkey) AS entries FROM (SELECT *, max(o_orderdate) OVER (PARTITION BY o_custkey) AS newest FROM orders WHERE o_orderstatus <> 'P' AND epoch_us(o_orderdate::TIMESTAMP) > epoch_us(TIMESTAMP '1998-01-01') - 900 * 864e8) WHERE o_orderdate = newest GROUP BY o_custkey",
}
