"""Scans and sinks of document stores: whole JSON documents, JSON lines, statistics in CSV, tool logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_BAD = "_corrupt_record"

# How tools print a number, and the titles, names and units of the figures in a loudness summary.
_NUMBER = r"(-?[0-9]+(?:\.[0-9]+)?)"
_SUMMARY = "Summary:"
_LOUDNESS = ("Integrated loudness", "I", "LUFS")
_PEAK = ("True peak", "Peak", "dBFS")


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A1: whole JSON documents; a document that does not parse fails the scan. Adds path."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path).withColumn("path", F.col("_metadata.file_path"))


def read_documents_or(spark: SparkSession, path: str, schema: str, default: DataFrame | None = None) -> DataFrame:
    """Documents that parse; where there are none, the default."""
    try:
        rows = spark.read.schema(f"{schema}, {_BAD} string").option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    except Exception as e:
        if default is None or "PATH_NOT_FOUND" not in str(e):
            raise
        return default
    good = rows.filter(F.col(_BAD).isNull()).drop(_BAD)
    return good if default is None else good.unionByName(default.join(good.limit(1).select(F.lit(1).alias("_one")), F.lit(True), "left_anti"))


def write_documents(df: DataFrame, path: str) -> None:
    """A3: replaces a store; readers see the old one or the new one."""
    df.write.mode("overwrite").json(path)


def append_lines(df: DataFrame, path: str) -> None:
    """A4: adds JSON lines."""
    df.write.mode("append").json(path)


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines, blank ones dropped."""
    return spark.read.schema(schema).json(path)


def list_files(spark: SparkSession, path: str, prefix: str = "", older_than_s: float | None = None) -> DataFrame:
    """Path, name, modified, size of files; by prefix and age if asked for. Contents are not read."""
    m = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    out = m.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("modificationTime").alias("modified"), F.col("length").alias("size")).filter(F.col("name").startswith(prefix))
    return out if older_than_s is None else out.filter(F.unix_micros(F.current_timestamp()) / 1e6 - F.unix_micros("modified") / 1e6 > older_than_s)


def upsert(old: DataFrame, new: DataFrame, key: str, stamp: F.Column | None = None) -> DataFrame:
    """Rows of old whose key new lacks, and new's, stamped."""
    return old.join(new.select(key), key, "left_anti").select(old.columns).unionByName(new if stamp is None else new.withColumn("updatedAt", stamp), allowMissingColumns=True)


def parse_stats(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A10: (rows, errors) of CSV lines: line (1 is the header, blank lines not counted), raw. No quoting; fields are trimmed."""
    f = F.transform(F.split("raw", ","), lambda x: F.trim(x))
    x = lines.filter("line > 1").select("line", "raw", F.get(f, F.lit(0)).alias("clipId"), F.get(f, F.lit(1)).alias("v"), F.get(f, F.lit(2)).alias("p"))
    x = x.withColumn("views", F.expr("try_cast(v as double)")).withColumn("avgViewPct", F.expr("try_cast(nullif(p, '') as double)"))
    message = (
        F.when(F.coalesce("clipId", F.lit("")) == "", "no clip id")
        .when(F.col("views").isNull() | (F.col("views") < 0), "bad views")
        .when((F.coalesce("p", F.lit("")) != "") & (F.col("avgViewPct").isNull() | ~F.col("avgViewPct").between(0, 100)), "bad percentage")
    )
    x = x.withColumn("message", message)
    return x.filter("message is null").select("line", "clipId", "views", "avgViewPct"), x.filter("message is not null").select("line", "raw", "message")


def import_stats(rows: DataFrame, clips: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(clips with their new snapshots, errors of rows that no clip has)."""
    new = rows.groupBy(F.col("clipId").alias("id")).agg(F.array_sort(F.collect_list(F.struct("line", "views", "avgViewPct"))).alias("_new"))
    snaps = F.transform("_new", lambda x: F.struct(x["views"].alias("views"), x["avgViewPct"].alias("avgViewPct"), F.lit("csv").alias("source")))
    merged = clips.join(new, "id", "left").withColumn("metrics", F.when(F.col("_new").isNull(), F.col("metrics")).otherwise(F.concat(F.coalesce("metrics", F.array().cast("array<struct<views:double,avgViewPct:double,source:string>>")), snaps))).drop("_new")
    return merged, rows.join(clips.select(F.col("id").alias("clipId")), "clipId", "left_anti").select("line", "clipId", F.lit("no such clip").alias("message"))


def parse_subtitles(docs: DataFrame) -> DataFrame:
    """Src, json -> src, w, s, e. An event's segments are words with offsets in ms; a word ends where the
    next begins, the last at the next event that has text or at the event's own end, whichever is first."""
    schema = "struct<events:array<struct<tStartMs:double,dDurationMs:double,segs:array<struct<utf8:string,tOffsetMs:double>>>>>"
    ev = docs.select("src", F.posexplode(F.from_json("json", schema)["events"]).alias("n", "ev"))
    text = F.array_join(F.transform(F.coalesce("ev.segs", F.array()), lambda s: F.coalesce(s["utf8"], F.lit(""))), "")
    ev = ev.filter(F.regexp_replace(text, r"(?U)\s", "") != "").select("src", "n", "ev.*")
    ev = ev.withColumn("next", F.lead("tStartMs").over(Window.partitionBy("src").orderBy("n")))
    ev = ev.withColumn("until", F.least("next", F.col("tStartMs") + F.coalesce("dDurationMs", F.lit(0.0))))
    seg = ev.select("src", "n", "until", "tStartMs", F.posexplode("segs").alias("k", "g")).filter(F.trim(F.col("g.utf8")) != "")
    seg = seg.withColumn("s", F.col("tStartMs") + F.coalesce("g.tOffsetMs", F.lit(0.0)))
    seg = seg.withColumn("e", F.coalesce(F.lead("s").over(Window.partitionBy("src", "n").orderBy("k")), F.col("until")))
    words = F.filter(F.split(F.trim("g.utf8"), r"\s+"), lambda x: x != "")
    w = seg.withColumn("ws", words).select("src", "n", "k", "s", "e", F.size("ws").alias("m"), F.posexplode("ws").alias("j", "w"))
    step = (F.col("e") - F.col("s")) / F.col("m")
    return w.select("src", "w", ((F.col("s") + step * F.col("j")) / 1000).alias("s"), ((F.col("s") + step * (F.col("j") + 1)) / 1000).alias("e"))


def parse_listing(docs: DataFrame) -> DataFrame:
    """Url, json -> one row an entry; missing counts are 0, missing dates ''."""
    schema = "struct<entries:array<struct<id:string,title:string,view_count:double,upload_date:string,duration:double>>>"
    e = docs.select("url", F.explode(F.from_json("json", schema)["entries"]).alias("e"))
    return e.select(F.col("e.id").alias("id"), F.coalesce("e.title", F.lit("")).alias("title"), F.coalesce(F.col("e.view_count").cast("long"), F.lit(0)).alias("views"), F.coalesce("e.upload_date", F.lit("")).alias("uploadDate"), F.coalesce("e.duration", F.lit(0.0)).alias("durationSec"), F.col("url").alias("channelUrl"))


def parse_report(docs: DataFrame) -> DataFrame:
    """Src, json with columnHeaders and rows -> src, row, a map from header to value."""
    schema = "struct<columnHeaders:array<struct<name:string>>,rows:array<array<string>>>"
    r = docs.select("src", F.from_json("json", schema).alias("r")).select("src", "r", F.posexplode("r.rows").alias("row", "v"))
    return r.select("src", "row", F.map_from_arrays(F.transform("r.columnHeaders", lambda h: h["name"]), F.col("v")).alias("v"))


def parse_probe(docs: DataFrame, strict: bool = False) -> DataFrame:
    """Src, json -> src, width, height as shown (a quarter turn swaps them); where no video stream is null, or an error if strict."""
    v_type = "struct<codec_type:string,width:int,height:int,rotation:double>"
    schema = f"struct<streams:array<{v_type}>>"
    v = F.get(F.filter(F.from_json("json", schema)["streams"], lambda s: s["codec_type"] == "video"), F.lit(0))
    if strict:
        v = F.coalesce(v, F.raise_error(F.concat(F.lit("no video stream: "), F.col("src").cast("string"))).cast(v_type))
    turned = F.abs(F.floor(F.coalesce(v["rotation"], F.lit(0.0)) + 0.5)) % 180 == 90
    return docs.select("src", F.when(turned, v["height"]).otherwise(v["width"]).alias("width"), F.when(turned, v["width"]).otherwise(v["height"]).alias("height"))


def parse_silences(logs: DataFrame) -> DataFrame:
    """Src, log -> src, s, e. An end counts if the mark before it is a start; a last start alone is dropped."""
    marks = F.regexp_extract_all("log", F.lit(r"(silence_(?:start|end): -?[0-9.]+)"), F.lit(1))
    m = logs.select("src", F.posexplode(marks).alias("n", "m")).select("src", "n", F.col("m").contains("start").alias("begin"), F.element_at(F.split("m", " "), -1).cast("double").alias("t"))
    w = Window.partitionBy("src").orderBy("n")
    return m.withColumn("was", F.lag("begin").over(w)).withColumn("s", F.lag("t").over(w)).filter(~F.col("begin") & F.col("was")).select("src", "s", F.col("t").alias("e"))


def parse_intervals(logs: DataFrame, kind: str) -> DataFrame:
    """Src, log -> src, s, e of kind_start and kind_end marks (black, freeze, silence), paired in order; one too many has no partner."""
    every = lambda end: F.regexp_extract_all("log", F.lit(rf"{kind}_{end}:\s*{_NUMBER}"), F.lit(1))
    pairs = F.arrays_zip(every("start").alias("s"), every("end").alias("e"))
    out = logs.select("src", F.explode(pairs).alias("p")).select("src", F.col("p.s").cast("double").alias("s"), F.col("p.e").cast("double").alias("e"))
    return out.filter("s is not null and e is not null")


def parse_loudnorm(logs: DataFrame) -> DataFrame:
    """Src, log -> src, input_i, input_tp, input_lra, input_thresh, target_offset of the last {...} block; a log without one is an error."""
    names = ("input_i", "input_tp", "input_lra", "input_thresh", "target_offset")
    blocks = F.regexp_extract_all("log", F.lit(r"(\{[^{}]*\})"), F.lit(1))
    last = F.when(F.size(blocks) > 0, F.element_at(blocks, -1)).otherwise(F.raise_error(F.lit("no JSON block in the log")))
    j = logs.select("src", F.from_json(last.cast("string"), ", ".join(f"{n} string" for n in names)).alias("j"))
    return j.select("src", *(F.col(f"j.{n}").try_cast("double").alias(n) for n in names))


def parse_ebur128(logs: DataFrame) -> DataFrame:
    """Src, log -> src, lufs, peak of what follows the last ``Summary:``, or of all without one; missing figures are an error."""
    lines = F.transform(F.split(F.element_at(F.split("log", _SUMMARY), -1), "\n"), lambda x: F.trim(x))

    def figure(title, name, unit):
        """The number in the line that follows the title's."""
        at = F.array_position(lines, f"{title}:")
        return F.regexp_extract(F.when(at > 0, F.get(lines, at.cast("int"))).otherwise(""), rf"^{name}:\s*{_NUMBER}\s*{unit}", 1)

    i, peak = figure(*_LOUDNESS), figure(*_PEAK)
    must = lambda c: F.when(c != "", c.try_cast("double")).otherwise(F.raise_error(F.lit("no loudness or true peak in the log")).cast("double"))
    return logs.select("src", must(i).alias("lufs"), must(peak).alias("peak"))


def parse_rates(rows: DataFrame) -> DataFrame:
    """Src, rate ("30/1", "30000/1001", "25") -> src, fps; without a divisor, or one of 0, the number itself; 0 where there is none."""
    part = F.split(F.coalesce("rate", F.lit("")), "/")
    n, d = F.get(part, F.lit(0)).try_cast("double"), F.get(part, F.lit(1)).try_cast("double")
    return rows.select("src", F.coalesce(F.when(d != 0, n / d).otherwise(n), F.lit(0.0)).alias("fps"))


def fresh_listings(entries: DataFrame, now: F.Column, hours: float = 12.0) -> DataFrame:
    """Url, fetched, complete, entries -> the cached listings that may be used: the newest of a url under ``hours`` old, and none
    that was enriched in part."""
    newest = Window.partitionBy("url").orderBy(F.col("fetched").desc())
    usable = entries.filter("complete").filter((F.unix_micros(now) - F.unix_micros("fetched")) / 3.6e9 < hours)
    return usable.withColumn("_r", F.row_number().over(newest)).filter("_r = 1").drop("_r")


def pick_subtitles(files_: DataFrame, wanted: DataFrame) -> DataFrame:
    """Id, name of files; ids wanted -> id, name, none: of each id the English subtitles, else the first in a variety of English;
    ids without any are tombstones (none is true), so they are not asked for again."""
    english = files_.filter(F.col("name").rlike(r"\.en[^.]*\.json3$"))
    first = Window.partitionBy("id").orderBy(F.col("name").endswith(".en.json3").desc(), "name")
    best = english.withColumn("_r", F.row_number().over(first)).filter("_r = 1").select("id", "name")
    return wanted.select("id").distinct().join(best, "id", "left").withColumn("none", F.col("name").isNull())


def cached_words(docs: DataFrame) -> DataFrame:
    """Src, json (an array of words, or a tombstone) -> src, words; null where it isn't an array."""
    words = F.from_json("json", "array<struct<w:string,start:double,end:double>>")
    return docs.select("src", F.when(F.ltrim("json").startswith("["), words).alias("words"))


def read_rankings(spark: SparkSession, path: str) -> DataFrame:
    """rankings/<key>/<episode>.json below path -> key, episodeId, ranked; unreadable ones are skipped, no file at all is an error."""
    schema = "episodeId string, ranked array<string>, costUsd double, durationMs double"
    rows = spark.read.schema(f"{schema}, {_BAD} string").option("multiLine", True).option("mode", "PERMISSIVE").json(f"{path}/rankings/*/*.json")
    key = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return rows.select(key.alias("key"), "*").filter(F.col(_BAD).isNull() & F.col("episodeId").isNotNull()).drop(_BAD)


def report_lines(variants: DataFrame) -> DataFrame:
    """Key, metric, n, mean, lo, hi -> a table's lines in Markdown, in order (line, text): a row a variant, the base first."""
    shown = F.when(F.col("n") == 0, F.lit("–")).otherwise(F.format_string("%.2f [%.2f, %.2f]", "mean", "lo", "hi"))
    names = ("ndcg_pool", "ndcg_all", "precision", "recall", "mrr")
    wide = variants.groupBy("key").agg(*(F.max(F.when(F.col("metric") == m, shown)).alias(m) for m in names))
    place = F.row_number().over(Window.orderBy(F.col("key") != "V0", "key")) + 2
    body = wide.select(place.cast("long").alias("line"), F.concat(F.lit("| "), F.concat_ws(" | ", "key", *(F.coalesce(m, F.lit("–")) for m in names)), F.lit(" |")).alias("text"))
    spark = variants.sparkSession
    head = spark.createDataFrame([(1, "| variant | " + " | ".join(names) + " |"), (2, "|---" * 6 + "|")], "line long, text string")
    return head.unionByName(body)


def write_text(lines: DataFrame, path: str) -> None:
    """The lines in order, as one file of text."""
    lines.orderBy("line").select("text").coalesce(1).write.mode("overwrite").text(path)
