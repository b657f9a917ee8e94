"""Language identification by compression: the language whose zstandard dictionary makes a text smallest.

The dictionaries are raw content, taken from a bounded sample of labelled texts: at most `sample_docs` documents and
`dictionary_bytes` bytes for each language, so the model has a fixed size for each language and can be broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import tidy

UNKNOWN = "und"
#: Bytes that are compressed at a time, so that a long text is held against the dictionary and not against itself.
PART = 2048


def learn(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = 256, dictionary_bytes: int = 98_304, max_languages: int = 256) -> dict[str, bytes]:
    """A dictionary for each non-null language: the heads of the sample_docs documents with the smallest hashed ids.

    Of more than max_languages tags those of most documents (the first by name on a tie) are learnt, so stray tags can't make the
    model large. Only the sample is bounded this way; classification reads whole texts.
    """
    share = dictionary_bytes // sample_docs * 2
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("text is not null and lang is not null and doc_id is not null")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    # a hash bound leaves some times sample_docs rows of each language for the window, however many there are; one row for each class
    share_of = rows.groupBy("lang").agg(F.count("*").alias("docs")).orderBy(F.desc("docs"), "lang").limit(max_languages).select("lang", (F.lit(8.0 * sample_docs) / F.col("docs")).alias("share"))
    likely = rows.select("lang", "doc_id").join(F.broadcast(share_of), "lang").filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) <= F.col("share") * (1 << 30)).drop("share")
    chosen = likely.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= sample_docs).select("lang", "doc_id").distinct()
    # sample_docs ids for each language
    heads = rows.join(F.broadcast(chosen), ["lang", "doc_id"]).groupBy("lang", "doc_id").agg(F.max(F.substring("text", 1, share)).alias("head"))
    parts: dict[str, list[tuple[int, str]]] = {}
    for row in heads.collect():
        parts.setdefault(row.lang, []).append((row.doc_id, row.head))
    return {lang: _cut("\n".join(head.lower() for _, head in sorted(parts[lang])).encode(), dictionary_bytes) for lang in sorted(parts)}


def _cut(data: bytes, size: int) -> bytes:
    return data[-size:]


class Classifier:
    """Compressors with digested dictionaries, made once for each task."""

    def __init__(self, dictionaries: dict[str, bytes], level: int = 6):
        self.names, self.squeezers = sorted(dictionaries), []
        for name in self.names:
            words = zstandard.ZstdCompressionDict(dictionaries[name].ljust(16, b" "), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            words.precompute_compress(level=level)
            self.squeezers.append(zstandard.ZstdCompressor(level=level, dict_data=words, write_checksum=False, write_content_size=False, write_dict_id=False))

    def classify(self, text: str | None, min_margin: float) -> tuple[str, float, bool]:
        if not self.names or not text or not any(c.isalpha() for c in text):
            return UNKNOWN, 0.0, True
        data = text.lower().encode("utf-8", "surrogatepass")
        parts = [data[i : i + PART] for i in range(0, len(data), PART)]
        sizes = [sum(len(s.compress(x)) for x in parts) for s in self.squeezers]
        best = min(range(len(sizes)), key=lambda i: (sizes[i], self.names[i]))
        others = sizes[:best] + sizes[best + 1 :]
        weight = 1 + sum(np.exp((sizes[best] - x) / 2) for x in others)
        margin = (min(others) - sizes[best]) / sizes[best] if others else 1.0
        return self.names[best], round(float(1 / weight), 6), margin < min_margin


def identify(docs: DataFrame, dictionaries: dict[str, bytes], *, id_col: str = "doc_id", text_col: str = "text", min_margin: float = 0.01) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) for every row.

    The language of the smallest result, the first by name on a tie; `und` for null texts and texts without a letter, and where
    nothing was learnt. rejected: the second smallest is less than min_margin larger, or the language is `und`.
    """
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)

    @tidy

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(shared.value)
        for batch in batches:
            found = [classifier.classify(text.as_py(), min_margin) for text in batch.column(1)]
            langs, scores, rejected = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], names=["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(work, "doc_id long, lang_pred string, score double, rejected boolean")
