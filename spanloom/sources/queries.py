"""Queries over what the scans of spanloom.sources give, made of the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import files


def _lines(spark, d):
    raw = F.concat_ws(",", F.when(F.col("o_orderkey") % 50 == 0, "").otherwise(F.col("o_orderkey").cast("string")), F.when(F.col("o_orderkey") % 7 == 0, "-5").otherwise(F.col("o_custkey").cast("string")), F.when(F.col("o_orderkey") % 11 == 0, "101").otherwise((F.col("o_orderkey") % 100).cast("string")))
    return spark.read.parquet(f"{d}/orders.parquet").select((F.col("o_orderkey") + 1).alias("line"), raw.alias("raw"))


_RAW = "SELECT o_orderkey AS k, o_orderkey + 1 AS line, concat(CASE WHEN o_orderkey % 50 = 0 THEN '' ELSE o_orderkey::VARCHAR END, ',', CASE WHEN o_orderkey % 7 = 0 THEN '-5' ELSE o_custkey::VARCHAR END, ',', CASE WHEN o_orderkey % 11 = 0 THEN '101' ELSE (o_orderkey % 100)::VARCHAR END) AS raw, o_custkey FROM orders"


def _json(spark, d):
    entry = F.struct(F.col("o_orderkey").cast("string").alias("id"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_custkey")).alias("view_count"))
    o = spark.read.parquet(f"{d}/orders.parquet").groupBy((F.col("o_custkey") % 20).alias("k")).agg(F.collect_list(entry).alias("entries"))
    return o.select(F.col("k").cast("string").alias("url"), F.to_json(F.struct("entries")).alias("json"))


def _logs(spark, d):
    """Tool logs of sources, made of their events: a mark for each, at seconds that its value gives."""
    e = spark.read.parquet(f"{d}/events.parquet").groupBy(F.col("user_id").alias("src")).agg(F.array_sort(F.collect_list(F.struct("event_id", "event_type", "value"))).alias("xs"))
    at = lambda x: F.format_string("%.2f", x["value"])
    mark = lambda x: F.when(x["event_type"] == "view", F.concat(F.lit("silence_start: "), at(x))).when(x["event_type"] == "click", F.concat(F.lit("silence_end: "), at(x), F.lit(" | x"))).when(x["event_type"] == "signup", F.concat(F.lit("black_start:"), at(x))).when(x["event_type"] == "error", F.concat(F.lit("black_end:"), at(x)))
    return e.select("src", F.array_join(F.filter(F.transform("xs", mark), lambda x: x.isNotNull()), "\n").alias("log"))


def _loud(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").filter("event_type = 'purchase'")
    block = F.concat(F.lit("{old} {\"input_i\":\"-"), F.format_string("%.2f", "value"), F.lit('","input_tp":"-'), F.format_string("%.1f", F.col("event_id") % 30 / 10), F.lit('"} \n Summary:\n\n  Integrated loudness:\n    I:         -'), F.format_string("%.1f", "value"), F.lit(" LUFS\n  True peak:\n    Peak:       -"), F.format_string("%.1f", F.col("event_id") % 70 / 10), F.lit(" dBFS"))
    return e.select(F.col("event_id").alias("src"), block.alias("log"))


def _clips(spark, d):
    metrics = "array<struct<views:double,avgViewPct:double,source:string>>"
    clips = spark.read.parquet(f"{d}/orders.parquet").filter("o_orderkey % 5 > 0").select(F.col("o_orderkey").cast("string").alias("id"), F.lit(None).cast(metrics).alias("metrics"))
    return files.import_stats(files.parse_stats(_lines(spark, d))[0], clips)


def _subtitles(spark, d):
    words = F.transform(F.split("text", " "), lambda w, i: F.struct(F.concat(F.lit(" "), w).alias("utf8"), (i * 400).cast("double").alias("tOffsetMs")))
    event = F.struct((F.col("turn") * 5000).cast("double").alias("tStartMs"), F.lit(5000.0).alias("dDurationMs"), words.alias("segs"))
    c = spark.read.parquet(f"{d}/conversations.parquet").filter("text is not null").groupBy(F.col("conv_id").alias("src")).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", event.alias("ev")))), lambda x: x["ev"]).alias("events"))
    return files.parse_subtitles(c.select("src", F.to_json(F.struct("events")).alias("json")))


def _files(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    name = F.concat(F.col("o_orderkey").cast("string"), F.when(F.col("o_orderstatus") == "F", ".en.json3").when(F.col("o_orderstatus") == "O", ".en-GB.json3").otherwise(".de.json3"))
    return files.pick_subtitles(o.select(F.col("o_custkey").alias("id"), name.alias("name")), spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("id")))


def _probes(spark, d):
    streams = F.array(F.struct(F.lit("audio").alias("codec_type"), F.lit(0).alias("width"), F.lit(0).alias("height"), F.lit(0.0).alias("rotation")), F.struct(F.lit("video").alias("codec_type"), F.col("p_size").alias("width"), F.lit(9).alias("height"), (F.col("p_partkey") % 4 * 90).cast("double").alias("rotation")))
    return files.parse_probe(spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("src"), F.to_json(F.struct(streams.alias("streams"))).alias("json")))


_PAIRS = """(SELECT src, {kind}, t, row_number() OVER (PARTITION BY src, {kind} ORDER BY event_id) AS k FROM (SELECT user_id AS src, event_id, round(value, 2) AS t, event_type AS {kind} FROM events WHERE event_type IN ('{a}', '{b}')))"""

QUERIES = {
    "scan_upsert": lambda s, d: files.upsert(s.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_acctbal"), s.read.parquet(f"{d}/orders.parquet").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("c_acctbal")), "c_custkey"),  # A8
    "stats_import": lambda s, d: _clips(s, d)[0].select("id", F.size(F.coalesce("metrics", F.array())).alias("snapshots"), F.element_at("metrics", -1)["views"].alias("views")),  # A11
    "stats_unknown": lambda s, d: _clips(s, d)[1],  # A11
    "scan_subtitles": lambda s, d: _subtitles(s, d).groupBy("src").agg(F.count("*").alias("words"), (F.floor(F.min("s") * 1000 + 0.5) / 1000).alias("s")),  # A12
    "scan_pick_subtitles": _files,  # A15
    "scan_probes": _probes,  # A19
    "scan_silences": lambda s, d: files.parse_silences(_logs(s, d)),  # A20
    "scan_black": lambda s, d: files.parse_intervals(_logs(s, d), "black"),  # A20
    "scan_loudness": lambda s, d: files.parse_ebur128(_loud(s, d)),  # A20
    "scan_loudnorm": lambda s, d: files.parse_loudnorm(_loud(s, d)).select("src", "input_i", "input_tp"),  # A20
    "scan_rates": lambda s, d: files.parse_rates(s.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("src"), F.concat(F.col("p_size").cast("string"), F.lit("/"), (F.col("p_partkey") % 3).cast("string")).alias("rate"))),  # A20
    "scan_report": lambda s, d: files.parse_report(s.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").alias("src"), F.concat(F.lit('{"columnHeaders":[{"name":"n"},{"name":"r"}],"rows":[["'), "n_name", F.lit('",'), F.col("n_regionkey").cast("string"), F.lit("]]}")).alias("json"))).select("src", F.col("v")["n"].alias("n"), F.col("v")["r"].alias("r")),  # A16
    "stats_rows": lambda s, d: files.parse_stats(_lines(s, d))[0],  # A10
    "stats_errors": lambda s, d: files.parse_stats(_lines(s, d))[1],  # A10
    "listing_entries": lambda s, d: files.parse_listing(_json(s, d)).select("id", "title", "views", "uploadDate", "durationSec", "channelUrl"),  # A13
}
ORACLE = {
    "scan_upsert": "SELECT c_custkey, coalesce(m, c_acctbal) AS c_acctbal FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS m FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey UNION SELECT o_custkey, max(o_totalprice) FROM orders GROUP BY o_custkey",
    "stats_import": f"SELECT o_orderkey::VARCHAR AS id, CASE WHEN r.k IS NULL THEN 0 ELSE 1 END::INTEGER AS snapshots, r.o_custkey::DOUBLE AS views FROM orders o LEFT JOIN (SELECT * FROM ({_RAW}) WHERE line > 1 AND k % 50 <> 0 AND k % 7 <> 0 AND k % 11 <> 0) r ON r.k = o.o_orderkey WHERE o_orderkey % 5 > 0",
    "stats_unknown": f"SELECT line, k::VARCHAR AS \"clipId\", 'no such clip' AS message FROM ({_RAW}) WHERE line > 1 AND k % 50 <> 0 AND k % 7 <> 0 AND k % 11 <> 0 AND k % 5 = 0",
    "scan_subtitles": "SELECT conv_id AS src, sum(len(list_filter(string_split_regex(text, '[ \\t\\n\\r]+'), lambda x: x <> '')))::BIGINT AS words, min(turn) * 5e0 AS s FROM conversations WHERE text IS NOT NULL GROUP BY conv_id",
    "scan_pick_subtitles": "SELECT c_custkey AS id, f.name AS name, f.name IS NULL AS none FROM customer LEFT JOIN (SELECT o_custkey, name FROM (SELECT o_custkey, n AS name, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END, n) AS r FROM (SELECT o_custkey, o_orderstatus, o_orderkey::VARCHAR || CASE o_orderstatus WHEN 'F' THEN '.en.json3' ELSE '.en-GB.json3' END AS n FROM orders WHERE o_orderstatus IN ('F', 'O'))) WHERE r = 1) f ON f.o_custkey = c_custkey",
    "scan_probes": "SELECT p_partkey AS src, CASE WHEN p_partkey % 2 = 1 THEN 9 ELSE p_size END AS width, CASE WHEN p_partkey % 2 = 1 THEN p_size ELSE 9 END AS height FROM part",
    "scan_silences": "SELECT src, s, t AS e FROM (SELECT user_id AS src, event_type, round(value, 2) AS t, lag(event_type) OVER w AS was, lag(round(value, 2)) OVER w AS s FROM events WHERE event_type IN ('view', 'click') WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE event_type = 'click' AND was = 'view'",
    "scan_black": f"SELECT a.src, a.t AS s, b.t AS e FROM {_PAIRS.format(kind='kind', a='signup', b='error')} a JOIN {_PAIRS.format(kind='kind', a='signup', b='error')} b ON a.src = b.src AND a.k = b.k AND a.kind = 'signup' AND b.kind = 'error'",
    "scan_loudness": "SELECT event_id AS src, -round(value, 1) AS lufs, -(event_id % 70 / 10e0) AS peak FROM events WHERE event_type = 'purchase'",
    "scan_loudnorm": "SELECT event_id AS src, -round(value, 2) AS input_i, -(event_id % 30 / 10e0) AS input_tp FROM events WHERE event_type = 'purchase'",
    "scan_rates": "SELECT p_partkey AS src, CASE WHEN p_partkey % 3 = 0 THEN p_size::DOUBLE ELSE p_size / (p_partkey % 3)::DOUBLE END AS fps FROM part",
    "scan_report": "SELECT n_nationkey AS src, n_name AS n, n_regionkey::VARCHAR AS r FROM nation",
    "stats_rows": f"SELECT line, k::VARCHAR AS \"clipId\", o_custkey::DOUBLE AS views, (k % 100)::DOUBLE AS \"avgViewPct\" FROM ({_RAW}) WHERE line > 1 AND k % 50 <> 0 AND k % 7 <> 0 AND k % 11 <> 0",
    "stats_errors": f"SELECT line, raw, CASE WHEN k % 50 = 0 THEN 'no clip id' WHEN k % 7 = 0 THEN 'bad views' ELSE 'bad percentage' END AS message FROM ({_RAW}) WHERE line > 1 AND (k % 50 = 0 OR k % 7 = 0 OR k % 11 = 0)",
    "listing_entries": "SELECT o_orderkey::VARCHAR AS id, '' AS title, CASE WHEN o_orderkey % 3 > 0 THEN o_custkey ELSE 0 END::BIGINT AS views, '' AS \"uploadDate\", 0e0 AS \"durationSec\", (o_custkey % 20)::VARCHAR AS \"channelUrl\" FROM orders",
}
