"""A corpus pipeline of five stages, each over all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each as Parquet in the
shared checkpoint folder and rereads it as the next one's docs, and then removes what came before. All but
the last return the columns of docs. Near copies are judged on five-word shingles at a similarity of 0.8 or more.

Decisions are made on rows, told apart by doc_id and a hash of the text; a document's columns travel as one
struct, so extra columns of any name are kept and clash with nothing. In every stage: a null or empty
text is a document without words; very long texts are read whole; a row without doc_id is judged by its own text;
an empty table gives an empty one. What that means for what a stage keeps is said there.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from spanloom.llm.chosenpath import NearCopies
from spanloom.llm.cluster import checkpointed, passing, remove, shared_folder
from spanloom.llm.decontaminate import contamination
from spanloom.llm.mixing import by_labels, mix
from spanloom.llm.sharding import shard
from spanloom.llm.toxicity import Toxicity

REJECT_AT = 0.3


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _keyed(docs: DataFrame) -> DataFrame:
    """doc (all columns), id, hash (of the text, null as empty)."""
    every = [F.col(f"`{c}`") for c in docs.columns]
    return docs.select(F.struct(*every).alias("doc"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"))


def _judged(found: DataFrame, *more) -> DataFrame:
    return found.select(F.col("doc_id").alias("_id"), F.col("row").alias("_hash"), *more)


_SAME = "id <=> _id and hash = _hash"


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores under REJECT_AT; learned from the labels of documents that came in.

    Repeated rows get equal scores. A text without words is scored as such. Without labels nothing is
    rejected, unless all labels are toxic."""
    model = Toxicity(languages=False).fit(docs, _read(spark, sf_dir, "labels"))
    scored = model.score(docs)
    return scored.filter(F.col(scored.columns[-1]) < REJECT_AT).select([f"`{c}`" for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest doc_id, once. Documents without doc_id stay.

    Rows that repeat a doc_id are judged each by its own text: texts that aren't near copies of each other stay
    both, and of those of one group the one with the least hash stays. Of rows equal in doc_id and
    text the one whose other columns have the least hash stays. Texts without words are near to nothing."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    with passing(spark):
        judged = NearCopies(shingle=5, num=80, den=100).run(texts, by_text=True).filter("kept and doc_id is not null")
        stay = checkpointed(judged.groupBy("doc_id", F.coalesce("component", "row").alias("component")).agg(F.min("row").alias("row")))
    other = [F.col(f"doc.`{f.name}`") for f in docs.schema.fields if not isinstance(f.dataType, (MapType, VariantType))]
    known = _keyed(docs).filter("id is not null").join(_judged(stay), F.expr("id = _id and hash = _hash"), "left_semi")
    known = known.groupBy("id", "hash").agg(F.min_by("doc", F.xxhash64(*other)).alias("doc"))
    return known.select("doc.*").unionByName(docs.filter("doc_id is null"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without contamination by the benchmark. Only doc_ids and text hashes of contaminated ones are joined.

    Of rows that repeat a doc_id only those with a contaminated text go, with or without doc_id."""
    found = contamination(docs.select("doc_id", "text"), _read(spark, sf_dir, "benchmark"), by_text=True).filter("contaminated")
    return _keyed(docs).join(_judged(found).distinct(), F.expr(_SAME), "left_anti").select("doc.*")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; those that it doesn't take go. Texts without words have no
    size, so the mix takes them as often as it takes their source whole. Rows equal in doc_id and text are taken alike."""
    times = (F.col("epochs") + F.col("chosen").cast("int")).cast("int")
    taken = mix(docs.withColumn("text", F.coalesce("text", F.lit(""))), by_labels(_read(spark, sf_dir, "labels"))).select("doc_id", "row", times.alias("times"))
    taken = taken.groupBy("doc_id", "row").agg(F.max("times").alias("times")).filter("times > 0")
    out = _keyed(docs).join(_judged(taken, "times"), F.expr(_SAME))
    return out.select("doc", F.explode(F.expr("sequence(1, times)"))).select("doc.*")


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and place of each document of the mix; copies that the mix made have places of their own."""
    return shard(docs, shards=8)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

#: The classifier's scores cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage, read from where it was written. A stage's folder goes once the next is complete."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = _read(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        own = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(own)
        docs = spark.read.parquet(own)
        if before:
            remove(spark, before)
        before = own
    return docs
