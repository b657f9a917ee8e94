"""Named transforms, chains of them, and results kept under a key of their configuration."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import conversion as C

Transform = Callable[..., DataFrame]
TRANSFORMS: dict[str, tuple[Transform, str]] = {}


def transform(name: str, kind: str = "map") -> Callable[[Transform], Transform]:
    def register(f: Transform) -> Transform:
        TRANSFORMS[name] = (f, kind)
        return f

    return register


@transform("drop_trailing_answer")
def drop_trailing_answer(df: DataFrame) -> DataFrame:
    return df.withColumn("messages", C.prompt_of(F.col("messages")))


@transform("system_prompt")
def system_prompt(df: DataFrame, prompt: str) -> DataFrame:
    return df.withColumn("messages", C.inject_system(F.col("messages"), prompt))


@transform("max_turns", "filter")
def max_turns(df: DataFrame, most: int) -> DataFrame:
    return df.filter(F.size("messages") <= most)


@transform("no_blank_turns", "filter")
def no_blank_turns(df: DataFrame) -> DataFrame:
    return df.filter(F.forall("messages", lambda m: F.trim(F.coalesce(m["content"], F.lit(""))) != ""))


@transform("rendered")
def rendered(df: DataFrame) -> DataFrame:
    return df.withColumn("text", C.joined(F.col("messages")))


def run_chain(df: DataFrame, source: str, chain: list[tuple[str, dict]], keep: list[str] | None = None) -> DataFrame:
    """Transforms in order as one lazy plan, with dataset_source; `keep` names the columns of the result that are wanted."""
    unknown = [n for n, _ in chain if n not in TRANSFORMS]
    if unknown:
        raise ValueError(f"unknown transforms: {unknown}")
    out = reduce(lambda d, step: TRANSFORMS[step[0]][0](d, **step[1]), chain, df.withColumn("dataset_source", F.lit(source)))
    return out.select(*[c for c in keep if c in out.columns], "dataset_source") if keep else out


def config_key(config: dict, length: int = 10) -> str:
    """The head of the SHA-256 of a configuration, whatever the order of its keys."""
    return hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()[:length]


def _place(spark: SparkSession, path: str) -> tuple:
    """A path and its file system, whatever store it is in."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    where, files = _place(spark, path)
    out = files.create(where, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def statistics(df: DataFrame) -> dict:
    """Columns and number of rows, and rows for each dataset_source where there is that column."""
    if "dataset_source" not in df.columns:
        return {"columns": df.columns, "num_rows": df.count()}
    by = {r.dataset_source: r["count"] for r in df.groupBy("dataset_source").count().collect()}
    return {"columns": df.columns, "num_rows": sum(by.values()), "num_rows_by_source": {str(k): by[k] for k in sorted(by, key=str)}}


def cached(build: Callable[[], DataFrame], spark: SparkSession, folder: str, config: dict) -> DataFrame:
    """The table kept under the configuration's key, built and written if it isn't there.

    Below the key: data (Parquet), config.json and statistics.json. What a write left without finishing (no _SUCCESS among the
    data) is removed and built anew; any other failure to read is an error.
    """
    path = f"{folder.rstrip('/')}/{config_key(config)}"
    done, files = _place(spark, f"{path}/data/_SUCCESS")
    if not files.exists(done):
        files.delete(_place(spark, path)[0], True)
        build().write.mode("errorifexists").parquet(f"{path}/data")
    table = spark.read.parquet(f"{path}/data")
    # statistics.json comes last, so where it is the others are, too
    if not files.exists(_place(spark, f"{path}/statistics.json")[0]):
        _write_text(spark, f"{path}/config.json", json.dumps(config, sort_keys=True))
        _write_text(spark, f"{path}/statistics.json", json.dumps(statistics(table)))
    return table
