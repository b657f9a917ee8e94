"""Filters and renderings of conversations, as rows (conv_id, turn, role, text), and of documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.text import SPECIAL_TOKENS, has_keyword, names_provider, replace_all

# Roles and how they are shown.
SHOWN = {"user": "User", "human": "User", "assistant": "Assistant", "ai": "Assistant"}
CTRL_C = r"(?i)\x03|ctrl[_-]?c"


def last_assistant(turns: DataFrame) -> DataFrame:
    """The text of the last assistant turn of each conversation that has one."""
    return turns.filter("role = 'assistant'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"))


def keep_reject(df: DataFrame, predicate: Column) -> tuple[DataFrame, DataFrame]:
    """Rows for which the predicate holds and all others; null counts as false, so no row is in neither."""
    sure = F.coalesce(predicate, F.lit(False))
    return df.filter(sure), df.filter(~sure)


def without_ids(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return df.join(gone.select(key).distinct(), key, "left_anti")


def flags(turns: DataFrame) -> DataFrame:
    """Per conversation: whether an assistant names a provider, uses a listed keyword, and whether any turn is blank or null."""
    spoken = F.col("role") == "assistant"
    any_true = lambda c: F.max(F.coalesce(c, F.lit(False)))
    return turns.groupBy("conv_id").agg(any_true(spoken & names_provider(F.col("text"))).alias("provider"), any_true(spoken & has_keyword(F.col("text"))).alias("keyword"), F.max(F.trim(F.coalesce("text", F.lit(""))) == "").alias("blank"))


def render(turns: DataFrame) -> DataFrame:
    """`Role: text` paragraphs of each conversation in order, without special tokens; null and empty texts are left out, blank ones
    are not. Other roles are shown by name, the first letter large."""
    role = F.lower(F.coalesce("role", F.lit("")))
    shown = F.concat(F.upper(F.substring(role, 1, 1)), F.substring(role, 2, 1 << 30))
    for name, as_ in SHOWN.items():
        shown = F.when(role == name, as_).otherwise(shown)
    said = F.concat(shown, F.lit(": "), replace_all(F.col("text"), SPECIAL_TOKENS))
    rows = turns.filter("text <> ''").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", said.alias("said")))).alias("t"))
    return rows.select("conv_id", F.array_join(F.transform("t", lambda x: x["said"]), "\n\n").alias("text"))


def removal_counts(df: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    """(step, before, after) of filters one after another, in one scan."""
    passed, sums = F.lit(True), []
    for name, keep in steps:
        before, passed = passed, passed & F.coalesce(keep, F.lit(False))
        sums += [F.count_if(before).alias(f"{name}_b"), F.count_if(passed).alias(f"{name}_a")]
    row = df.agg(*sums)
    return reduce(DataFrame.union, [row.select(F.lit(name).alias("step"), F.col(f"{name}_b").alias("before"), F.col(f"{name}_a").alias("after")) for name, _ in steps])


def replace_subsets(df: DataFrame, more: DataFrame, sources: list[str]) -> DataFrame:
    """Without the named sources and with further rows; columns that these lack are null."""
    return df.filter(~F.col("source").isin(sources)).unionByName(more, allowMissingColumns=True)


def correctness_band(rows: DataFrame, key: str, passed: Column, low: float, high: float, bins: int = 100) -> DataFrame:
    """Histogram of the pass rates of keys whose rate is within [low, high]."""
    rates = rows.groupBy(key).agg(F.avg(F.when(passed, 1.0).otherwise(0.0)).alias("rate")).filter(F.col("rate").between(low, high))
    return rates.groupBy(F.least(F.floor(F.col("rate") * bins), F.lit(bins - 1)).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def alternates(turns: DataFrame, roles: tuple[str, str] = ("user", "assistant")) -> DataFrame:
    """Whether the turns of a conversation take turns, the first role first."""
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    due = F.when(F.col("place") % 2 == 1, roles[0]).otherwise(roles[1])
    return turns.withColumn("place", place).groupBy("conv_id").agg(F.min(F.col("role") == due).alias("valid"))


def has_ctrl_c(text: Column) -> Column:
    return text.rlike(CTRL_C)


def leaked(docs: DataFrame, canaries: DataFrame, window: int = 5) -> DataFrame:
    """(doc_id, n): documents that hold canary texts, and how many.

    The words of a canary but the first and last stand in a document as they are, so hashes of `window` of them are joined
    and `contains` confirms. Canaries of fewer words are held against every document.
    """
    listed = canaries.filter("canary is not null").groupBy("canary").agg(F.count("*").alias("times")).withColumn("w", F.split("canary", " "))
    run = lambda w, i: F.xxhash64(F.slice(w, i, window))
    long, short = listed.filter(F.size("w") >= window + 2), listed.filter(F.size("w") < window + 2)
    keys = long.select(F.xxhash64("canary").alias("canary_id"), run(F.col("w"), F.lit(2)).alias("hash"))
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("row"), F.split("text", " ").alias("w"))
    runs = F.when(F.size("w") >= window, F.transform(F.sequence(F.lit(1), F.size("w") - window + 1), lambda i: run(F.col("w"), i)))
    near = rows.select("doc_id", "row", F.explode(F.array_distinct(runs)).alias("hash")).join(keys, "hash").select(F.col("doc_id").alias("id"), F.col("row").alias("text_id"), "canary_id").distinct()
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("row") == F.col("text_id"))
    texts = rows.select("doc_id", "row", "text").distinct()
    found = texts.join(near, same).join(long.select(F.xxhash64("canary").alias("canary_id"), "canary", "times"), "canary_id").filter(F.contains("text", "canary")).select("doc_id", "row", "times")
    found = found.unionByName(texts.join(short, F.contains("text", "canary")).select("doc_id", "row", "times"))
    counts = found.groupBy(F.col("doc_id").alias("id"), F.col("row").alias("text_id")).agg(F.sum("times").cast("long").alias("n"))
    return rows.join(counts, same).select("doc_id", "n")
