"""Repeated sentences, paragraphs and word n-grams of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.text import is_code_fragment, is_complex_math, is_math_or_code, is_multi_line, is_short_phrase, is_structured_list, is_transition, once, paragraphs, sentences

#: Shortest block that counts, by kind: for any repetition and for consecutive ones.
LEAST = {"line": (5, 10), "paragraph": (10, 20)}


#: Repeats that count, for (paragraphs, sentences anywhere, sentences in a run): the usual setting, and that of a first look.
USUAL, FIRST_LOOK = (10, 40, 4), (25, 40, 20)


def blocks(docs: DataFrame, kind: str, least: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, listed, pos, item): sentences or paragraphs of `least` characters or more with their places among all; listed:
    whether the whole text is a list."""
    split = sentences(F.col(text_col)) if kind == "line" else paragraphs(F.col(text_col))
    # only documents with some block twice are exploded
    some = docs.select(F.col(id_col).alias("doc_id"), split.alias("items"), F.col(text_col).alias("whole")).filter(F.size(F.array_distinct("items")) < F.size("items"))
    listed = some.select("doc_id", "items", once(is_structured_list(F.col("whole"))).alias("listed"))
    return listed.select("doc_id", "listed", F.posexplode("items").alias("pos", "item")).filter(F.length("item") >= least)


def repetitions(docs: DataFrame, kind: str, **columns: str) -> DataFrame:
    """(doc_id, item, total, consecutive, first_pos, listed): blocks that occur twice or more, with the longest consecutive run."""
    rows = blocks(docs, kind, LEAST[kind][0], **columns)
    place = Window.partitionBy("doc_id", "item").orderBy("pos")
    runs = rows.withColumn("run", F.col("pos") - F.row_number().over(place)).groupBy("doc_id", "item", "run").agg(F.count("*").alias("n"), F.min("pos").alias("first"), F.max("listed").alias("listed"))
    return runs.groupBy("doc_id", "item").agg(F.sum("n").alias("total"), F.max("n").alias("consecutive"), F.min("first").cast("long").alias("first_pos"), F.max("listed").alias("listed")).filter("total > 1")


def consecutive_repetitions(docs: DataFrame, kind: str, **columns: str) -> DataFrame:
    """(doc_id, item, start, n): runs of two or more equal neighbours, by gaps and islands."""
    rows = blocks(docs, kind, LEAST[kind][1], **columns)
    place = Window.partitionBy("doc_id", "item").orderBy("pos")
    runs = rows.withColumn("run", F.col("pos") - F.row_number().over(place)).groupBy("doc_id", "item", "run").agg(F.count("*").alias("n"), F.min("pos").cast("long").alias("start"))
    return runs.filter("n > 1").select("doc_id", "item", "start", "n")


def ngram_repetitions(docs: DataFrame, n: int = 3, least: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ngram, n, first_pos): lower-cased word n-grams that occur `least` times or more, twice at least."""
    words = F.array_remove(F.split(F.lower(text_col), r"\s+"), "")
    grams = F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(0), F.size("w") - n), lambda i: F.array_join(F.slice("w", i + 1, n), " ")))
    rows = docs.select(F.col(id_col).alias("doc_id"), once(words).alias("w")).select("doc_id", once(grams).alias("g")).select("doc_id", "g", once(F.sort_array("g")).alias("s"))
    # what is there twice stands next to itself in order; only such n-grams are exploded and shuffled
    again = F.array_distinct(F.filter(F.zip_with("s", F.slice("s", 2, F.greatest(F.size("s") - 1, F.lit(0))), lambda a, b: F.when(a == b, a)), lambda x: x.isNotNull()))
    some = rows.select("doc_id", "g", once(again).alias("again")).filter(F.size("again") > 0)
    found = some.select("doc_id", "again", F.posexplode("g").alias("pos", "ngram")).filter(F.array_contains("again", F.col("ngram")))
    return found.groupBy("doc_id", "ngram").agg(F.count("*").alias("n"), F.min("pos").cast("long").alias("first_pos")).filter(F.col("n") >= least)


def block_verdict(docs: DataFrame, paragraphs: int = USUAL[0], anywhere: int = USUAL[1], in_run: int = USUAL[2], **columns: str) -> DataFrame:
    """(doc_id, has_repetition, repetition_reason, repetition_examples) of every document: the first block that is repeated too often,
    paragraphs before sentences; without one the reason is "" and there are no examples.

    Code, complex mathematics and transition words never count. Thresholds are three times as high where the whole text is a
    list, twice as high for blocks with mathematics, four times for paragraphs of several lines; the highest factor holds. A
    paragraph that is never next to itself needs 20 characters and twice the repeats, 30 at most. Sentences of one word never
    count; short phrases count in runs of twice in_run alone, whatever else they are.
    """
    item, total, run = F.col("item"), F.col("total"), F.col("consecutive")
    ignored = is_code_fragment(item) | is_complex_math(item) | is_transition(item)
    listed, mathematical = F.when(F.col("listed"), 3).otherwise(1), F.when(is_math_or_code(item), 2).otherwise(1)

    due = paragraphs * F.greatest(listed, F.when(is_multi_line(item), 4).otherwise(1), mathematical)
    due = F.when(run == 1, F.least(due * 2, F.lit(30))).otherwise(due)
    scattered = (run == 1) & (F.length(item) < 20)
    of_paragraph = F.when(~ignored & ~scattered & (total >= due), F.concat(F.lit("paragraph_repeated_"), total, F.lit("x")))

    factor, said = F.greatest(mathematical, listed), F.concat(F.lit("line_repeated_"), total, F.lit("x"))
    of_line = (
        F.when(~item.rlike(r"\s"), F.lit(None))
        .when(is_short_phrase(item), F.when(run >= in_run * 2, F.concat(said, F.lit("_consecutive_short_phrase"))))
        .when(ignored, F.lit(None))
        .when((run >= in_run * factor) & (F.length(item) >= 5), F.concat(said, F.lit("_consecutive")))
        .when((total >= anywhere * factor) & (F.length(item) >= 10), said)
    )

    def judged(kind: str, order: int, least: int, reason: Column) -> DataFrame:
        # what has too few repeats for any rule isn't matched against patterns
        rows = repetitions(docs, kind, **columns).filter(F.col("total") >= least)
        return rows.select("doc_id", F.lit(order).alias("kind"), "first_pos", reason.alias("reason"), "item").filter("reason is not null")

    found = judged("paragraph", 0, paragraphs, of_paragraph).union(judged("line", 1, min(anywhere, in_run), of_line))
    found = found.groupBy("doc_id").agg(F.min(F.struct("kind", "first_pos", "reason", "item")).alias("m"))
    ids = docs.select(F.col(columns.get("id_col", "doc_id")).alias("doc_id"))
    examples = F.when(F.col("m").isNull(), F.array().cast("array<string>")).otherwise(F.array("m.item"))
    return ids.join(found, "doc_id", "left").select("doc_id", F.col("m").isNotNull().alias("has_repetition"), F.coalesce("m.reason", F.lit("")).alias("repetition_reason"), examples.alias("repetition_examples"))
