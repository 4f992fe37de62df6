"""H8: keys of cached answers and of versions, from canonical JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.canonical import canonical_json, key, short_key
from spanloom.operators.learning import OPERATORS as LEARNED
from spanloom.plans.dialect import Relational
from spanloom.plans.views import VIEWS


def with_key(asked: DataFrame, *fields: str) -> DataFrame:
    """Adds key: sha256 of the fields as canonical JSON, so that what is asked alike is found again in whatever order it is put."""
    one = asked.select(F.struct(*(F.col(f"`{f}`") for f in fields)).alias("v"))
    return asked.withColumn("key", key(F.struct(*(F.col(f"`{f}`") for f in fields)), one.schema["v"].dataType))


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """Documents as prompts: the language as the model, the source as the system, a nested schema."""
    schema = F.struct(F.array(F.col("n_chars"), F.lit(None).cast("long")).alias("sizes"), (F.col("n_chars") / 4).alias("quarter"), (F.col("doc_id") % 2 == 0).alias("even"))
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.col("lang").alias("model"), F.col("source").alias("system"), F.col("text").alias("prompt"), schema.alias("schema"))
    return with_key(docs, "system", "schema", "model", "prompt").select("doc_id", "key")


def _versions(spark: SparkSession, d: str) -> DataFrame:
    """Twelve digits of each signal's weights as they were learned: what they name changes with them."""
    w = Relational(LEARNED["learn_weights"], VIEWS)(spark, d).select("signal", F.create_map(F.lit("weight"), F.col("weight"), F.lit("n"), F.col("n").cast("double")).alias("m"))
    return w.select("signal", short_key(canonical_json(F.col("m"), w.schema["m"].dataType)).alias("version"))


QUERIES = {"cache_keys_json": _asked, "weight_versions": _versions}
ORACLE = {
    "cache_keys_json": """
SELECT doc_id, sha256('{"model":' || coalesce(to_json(lang)::VARCHAR, 'null') || ',"prompt":' || coalesce(to_json(text)::VARCHAR, 'null') || ',"schema":{"even":' || (doc_id % 2 = 0)::VARCHAR || ',"quarter":' || CASE WHEN n_chars % 4 = 0 THEN (n_chars // 4)::VARCHAR ELSE (n_chars / 4)::VARCHAR END
  || ',"sizes":[' || n_chars || ',null]},"system":' || coalesce(to_json(source)::VARCHAR, 'null') || '}') AS key FROM documents""",
    "weight_versions": f"SELECT signal, substr(sha1('{{\"n\":' || n || ',\"weight\":' || CASE WHEN weight = floor(weight) THEN weight::BIGINT::VARCHAR ELSE weight::VARCHAR END || '}}'), 1, 12) AS version FROM ({Relational(LEARNED['learn_weights'], VIEWS).ansi()})",
}
