"""The corpus pipeline: stages from documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import decontamination, line_dedup, ngram_join, packing, quality
from tessella.llm.common import Scratch, fresh, maybe

#: A document goes if its quality score is below this: only clear rejects.
REJECT_BELOW = 0.5


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; it learns from all labels of the stage's documents. Statistics for learning
    are taken of labelled documents alone."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    labelled = maybe(docs, labels.filter("quality in (0, 1)").select("doc_id"), "doc_id")
    return quality.keep_good(docs, quality.fit(quality.document_statistics(labelled), labels), threshold=REJECT_BELOW)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; n_chars follows the text."""
    kept = fresh("kept_text", docs.columns)
    clean = line_dedup.dedup_lines(docs)
    changed = {"text": F.col(kept)} | ({"n_chars": F.length(kept).cast("long")} if "n_chars" in docs.columns else {})
    return clean.select(*(changed[c].alias(c) if c in changed else F.col(c) for c in docs.columns))


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id."""
    return ngram_join.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go."""
    return decontamination.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's ids in sequences of 2048."""
    file = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack_documents(docs, vocabulary=public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern=public_tokenizers.PATTERN, added=packing.added_tokens(file), file=file)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_copies_stage),
    ("benchmark decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: The classifier and the tokenizer can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder before the next."""
    docs, tmp = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = tmp.write(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
