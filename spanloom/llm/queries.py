"""The queries of the training-data operators, each over its whole table, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import format_conversations, read_back
from .chosenpath import NearCopies
from .decontaminate import contamination
from .langid import language_id
from .licenses import scan_licenses
from .mixing import by_labels, mix
from .negatives import hard_negatives
from .resampling import resample
from .sharding import shard
from .spotsigs import fingerprints, near_classes
from .substring import remove_repeated_windows
from .suffixes import remove_repeated_bytes
from .toxicity import toxicity

Query = Callable[[SparkSession, str], DataFrame]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(read(spark, sf_dir, "documents"))


def spot_near_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The join of op4's operator: partitioned by set length, compared through pruned Jaccard."""
    return near_classes(read(spark, sf_dir, "documents"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return NearCopies(shingle=3, num=85, den=100).run(read(spark, sf_dir, "documents"))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_bytes(read(spark, sf_dir, "documents"), least=50)


#: The conversation whose texts look like markup; every run formats it with the others.
HOSTILE = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hostile = spark.createDataFrame(HOSTILE, "conv_id long, turn int, role string, text string")
    return read_back(format_conversations(turns.unionByName(hostile)))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(read(spark, sf_dir, "documents"), by_labels(read(spark, sf_dir, "labels")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "epochs", "chosen")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(read(spark, sf_dir, "documents"), shards=8)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_windows(read(spark, sf_dir, "documents"), n=20)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(read(spark, sf_dir, "embeddings").withColumn("label", moved))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_license_scan, op2_toxicity, op3_decontamination, op4_fingerprints, op5_near_dedup,
        op6_suffix_array_dedup, op7_chat_format, op8_mixing, op9_sharding, op10_substring_dedup,
        op11_importance_resampling, op12_hard_negatives, op13_language_id, spot_near_classes,
    )
}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE: dict[str, str] = {
    "op3_decontamination": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
iw AS (
  SELECT item_id, w[k:k + 12] AS g, 13 AS n FROM i, unnest(range(1, len(w) - 11)) AS t(k) WHERE len(w) >= 13
  UNION ALL SELECT item_id, w, len(w) FROM i WHERE len(w) BETWEEN 1 AND 12),
n AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, k, n, w[k:k + n - 1] AS g FROM d, n, unnest(range(1, len(w) - n + 2)) AS t(k)),
hit AS (SELECT doc_id, k, dw.n, item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.g = iw.g),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(range(k, k + n)) AS t(p) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items
      FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op11_importance_resampling": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
f AS MATERIALIZED (SELECT doc_id, unnest(list_concat(w, list_transform(w[2:], lambda x, k: w[k] || ' ' || x))) AS f FROM d),
b AS MATERIALIZED (SELECT unnest(list_concat(w, list_transform(w[2:], lambda x, k: w[k] || ' ' || x))) AS f FROM (SELECT {_WORDS} AS w FROM benchmark)),
half AS (SELECT list(list_reduce(range(8), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)), i) ORDER BY i) AS t FROM range(256) r(i)),
h AS (SELECT f, hex(encode(f)) AS x FROM (SELECT f FROM f UNION SELECT f FROM b)),
c AS MATERIALIZED (SELECT f, xor(list_reduce(list_transform(range(length(x) // 2), lambda k: ('0x' || x[2 * k + 1:2 * k + 2])::BIGINT), lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1]), 4294967295), 4294967295) % 10000 AS k FROM h, half),
s AS (SELECT k, count(*) AS s FROM f JOIN c USING (f) GROUP BY k), t AS (SELECT k, count(*) AS t FROM b JOIN c USING (f) GROUP BY k),
g AS MATERIALIZED (SELECT r.k, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM f) + 10000) / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM b) + 10000))))::BIGINT AS gain
  FROM range(10000) r(k) LEFT JOIN s ON s.k = r.k LEFT JOIN t ON t.k = r.k),
m AS (SELECT doc_id, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM f JOIN c USING (f) JOIN g USING (k) GROUP BY doc_id),
v AS (SELECT d.doc_id, len(w)::BIGINT AS n, coalesce(weight, 0) AS weight, ('0x' || substr(sha256('7:' || d.doc_id), 1, 8))::BIGINT AS h FROM d LEFT JOIN m USING (doc_id)),
x AS (SELECT *, (weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))))::BIGINT AS score FROM v),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM x WHERE n >= 20)
SELECT x.doc_id, greatest(2 * x.n - 1, 0) AS n_features, weight, score, CASE WHEN rank <= 25 * r.n // 100 THEN rank END AS rank FROM x LEFT JOIN r USING (doc_id)""",
    "op12_hard_negatives": """
WITH r AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS s FROM r a JOIN r b ON a.vec_id % 50 = 0 AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id),
p AS (SELECT a, b, s FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS k FROM s WHERE same) WHERE k <= 5),
n AS (SELECT p.a, p.b, p.s AS ps, s.b AS n, s.s AS ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.s DESC, s.b) AS k
      FROM p JOIN s ON s.a = p.a AND NOT same AND 50 * p.s <= 100 * s.s AND 100 * s.s <= 95 * p.s)
SELECT a AS anchor_id, b AS positive_id, k::INT AS rank, n AS negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE k <= 3""",
    "op10_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, k, md5(array_to_string(w[k:k + 19], ' ')) AS g FROM d, unnest(range(1, len(w) - 18)) AS t(k) WHERE len(w) >= 20),
later AS (SELECT doc_id, k FROM (SELECT doc_id, k, row_number() OVER (PARTITION BY g ORDER BY doc_id, k) AS r FROM g) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, p FROM later, unnest(range(k, k + 20)) AS t(p)),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS s
         FROM (SELECT doc_id, p, w[p] AS x FROM d, unnest(range(1, len(w) + 1)) AS t(p)) ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)""",
}
