"""Language identification by compression: a text is in the language whose dictionary makes it shortest."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .toxicity import held_out

_NO_LETTERS = re.compile(r"[\W\d_]+")
UNKNOWN = "und"


def letters(text: str) -> str:
    """The text's runs of letters in lower case, a blank around each."""
    return f" {_NO_LETTERS.sub(' ', text.lower()).strip()} "


class Languages:
    """A raw-content dictionary of zstandard a language: the words that most of its documents have, the commonest last, where
    a reference to them costs least.

    most_docs: how many documents of a language it is learned from, chosen by a hash of their texts, so of copies of a text
    one at most (a bound of the fit); dictionary: bytes of a dictionary; piece: a text is compressed in pieces of so many bytes,
    so a long text leans on the dictionary as a short one does; margin: where the second shortest is less than this share longer
    than the shortest, the language is rejected."""

    def __init__(self, most_docs: int = 4000, dictionary: int = 16_000, level: int = 9, piece: int = 4096, margin: float = 0.01):
        self.most_docs, self.dictionary, self.level, self.piece, self.margin = most_docs, dictionary, level, piece, margin
        self.content: dict[str, bytes] = {}

    def fit(self, docs: DataFrame) -> Languages:
        """docs: text, lang. Rows without a language and texts without letters teach nothing.

        What comes to the driver are a count and a dictionary a language; words are counted in the documents chosen."""
        known = docs.select("text", F.col("lang").cast("string").alias("lang")).filter("lang is not null and text rlike '\\\\p{L}'")
        rows = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
        if not rows:
            return self
        share = F.create_map(*[F.lit(x) for lang, n in rows.items() for x in (lang, min(1.0, self.most_docs / n))])
        place = F.pmod(F.xxhash64(F.lit(13), "text"), F.lit(1 << 30)) / float(1 << 30)
        chosen = known.filter(place < share[F.col("lang")]).distinct()

        def kernel(batches):
            for batch in batches:
                langs, words = [], []
                for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    own = set(letters(text).split())
                    words += own
                    langs += [lang] * len(own)
                yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.string())], ["lang", "word"])

        counted = chosen.mapInArrow(kernel, "lang string, word string").groupBy("lang", "word").agg(F.count("*").alias("n"))
        line = Window.partitionBy("lang").orderBy(F.col("n").desc(), "word")
        upto = F.sum(F.octet_length("word") + 1).over(line.rowsBetween(Window.unboundedPreceding, 0))
        best = counted.withColumn("upto", upto).filter(F.col("upto") < self.dictionary).collect()
        for lang in sorted(rows, key=lambda x: (-rows[x], x)):  # of equal lengths the language of most rows wins
            words = [r.word for r in sorted((r for r in best if r.lang == lang), key=lambda r: (r.n, r.word))]
            if words:
                self.content[lang] = f" {' '.join(words)} ".encode()
        return self

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        raw = [zstandard.ZstdCompressionDict(c, dict_type=zstandard.DICT_TYPE_RAWCONTENT) for c in self.content.values()]
        return [zstandard.ZstdCompressor(level=self.level, dict_data=d, write_content_size=False, write_dict_id=False) for d in raw]

    def sizes(self, text: str, compressors: list[zstandard.ZstdCompressor]) -> list[int]:
        """Bytes of the whole text's letters under each dictionary."""
        data = letters(text).encode()
        pieces = [data[k : k + self.piece] for k in range(0, len(data), self.piece)]
        return [sum(len(c.compress(p)) for p in pieces) for c in compressors]

    def predict(self, docs: DataFrame) -> DataFrame:
        """All columns of docs (one is text), which are not to have these names: lang_pred, score, rejected."""
        own = self

        def kernel(batches):
            compressors, names = own.compressors(), [*own.content]
            for batch in batches:
                *kept, text, lettered = batch.columns
                pred, score, rejected = [], np.zeros(batch.num_rows), np.ones(batch.num_rows, bool)
                for k, (t, some) in enumerate(zip(text.to_pylist(), lettered.to_pylist(), strict=True)):
                    if not some or not names:
                        pred.append(UNKNOWN)
                        continue
                    sizes = own.sizes(t, compressors)
                    at = int(np.argmin(sizes))
                    second = min((s for j, s in enumerate(sizes) if j != at), default=2 * sizes[at])
                    pred.append(names[at])
                    score[k] = 1 - sizes[at] / second
                    rejected[k] = second - sizes[at] < own.margin * sizes[at]
                out = [*kept, pa.array(pred, pa.string()), pa.array(score), pa.array(rejected)]
                yield pa.RecordBatch.from_arrays(out, [*(f"c{k}" for k in range(len(kept))), "lang_pred", "score", "rejected"])

        lettered = F.coalesce(F.expr("text rlike '\\\\p{L}'"), F.lit(False))
        others = [c for c in docs.columns if c != "text"]
        plain = docs.select(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(others)), "text", lettered.alias("lettered"))
        kinds = ", ".join(f"c{k} {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(others))
        out = plain.mapInArrow(kernel, f"{kinds + ', ' if kinds else ''}lang_pred string, score double, rejected boolean")
        return out.toDF(*others, "lang_pred", "score", "rejected")


def language_id(docs: DataFrame, **parameters) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of each row of docs (doc_id, text, lang), learned from rows that aren't held out.

    lang_pred is the language of the smallest size, of equal ones that of more rows; UNKNOWN where the text is null or has no letter, or
    nothing was learned. score: the share that it saves against the second smallest, 0 of an unknown language. rejected:
    that share is narrow, or the language unknown. Texts are read whole; repeated rows get equal results, rows without doc_id
    teach and are judged as others; no rows give none. doc_id, lang and other columns are no part of a prediction."""
    model = Languages(**parameters).fit(docs.filter(~held_out()).select("text", "lang"))
    return model.predict(docs.select("doc_id", held_out().alias("held_out"), "text"))
