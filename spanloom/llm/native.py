"""Column expressions that the operators on built-in functions share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What ends a word in lower-cased text, and what ends one that white space alone ends.
NOT_WORD, SPACES = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[\x20\x09-\x0D]+"


def folded(text: Column) -> Column:
    """A-Z in lower case and nothing else; lower() where the text is ASCII, which is several times faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column, ends: str = NOT_WORD) -> Column:
    """Words of a text; none of null. Only the ends of what split() gives can be empty."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), ends), "")


def same_row(a: DataFrame, b: DataFrame) -> Column:
    """Joins results to rows by doc_id, null too, and a hash of the text, so rows that repeat a doc_id keep apart."""
    return a["doc_id"].eqNullSafe(b["doc_id"]) & a["row"].eqNullSafe(b["row"])


def with_row(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("row"))
