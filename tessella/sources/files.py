"""Readers and writers: JSON lines, Parquet, TSV, text, run folders, event logs, checkpoints and token chunks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines by an explicit schema; lines that don't parse have nulls and their text in `_bad`."""
    return spark.read.schema(f"{schema}, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON document for each file; unreadable ones are left out."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)


def read_many(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Parquet files of like schemas as one table; columns that some lack are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [spark.read.parquet(p) for p in paths])


def read_runs(spark: SparkSession, folder: str, tag: str, schema: str) -> DataFrame:
    """JSON lines of the run folders `<tag>-r<number>-traj`, with the run's name."""
    rows = spark.read.schema(schema).json(f"{folder}/{tag}-r*-traj/*.jsonl").withColumn("run", F.regexp_extract(F.col("_metadata.file_path"), rf"/({tag}-r\d+)-traj/", 1))
    return rows.filter("run <> ''")


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("sep", "\t").option("header", True).csv(path)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.option("sep", "\t").option("header", True).csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.option("ignoreNullFields", False).json(path)


def write_with_statistics(df: DataFrame, path: str, by: str) -> None:
    """Parquet, and beside it the row counts by one column."""
    df.write.parquet(f"{path}/data")
    df.sparkSession.read.parquet(f"{path}/data").groupBy(by).agg(F.count("*").alias("n")).write.json(f"{path}/statistics")


EVENT = "type string, step int, message struct<role:string, content:string, tool_calls:array<struct<id:string, name:string, arguments:string>>, tool_call_id:string>"


def session_messages(lines: DataFrame, session: str, line_no: str, value: str) -> DataFrame:
    """(session, line_no, role, content): messages of event logs. Lines that are no JSON are skipped; of raw user events the first
    counts; assistant copies with equal step and start are one."""
    e = lines.withColumn("e", F.from_json(value, EVENT, {"mode": "PERMISSIVE"})).filter("e.type is not null")
    role = F.when(F.col("e.type") == "system", "system").when(F.col("e.type") == "raw_user", "user").when(F.col("e.type").isin("assistant", "raw_assistant"), "assistant").when(F.col("e.type") == "raw_tool", "tool")
    rows = e.withColumn("role", role).filter(F.col("role").isNotNull()).withColumn("content", F.coalesce("e.message.content", F.lit("")))
    same = F.when(F.col("role") == "user", F.lit("user")).when(F.col("role") == "assistant", F.concat_ws("|", F.lit("a"), F.col("e.step").cast("string"), F.substring("content", 1, 200))).otherwise(F.concat_ws("|", "role", F.col(line_no).cast("string")))
    first = Window.partitionBy(session, same).orderBy(line_no)
    return rows.withColumn("k", F.row_number().over(first)).filter("k = 1").select(session, line_no, "role", "content")


def message_tracks(records: DataFrame, session: str, up_to_step: int) -> DataFrame:
    """(session, line_no, role, raw, effective): what was recorded first and what the model saw.

    records: session, line_no, type, step, tool_call_id, content. Only records after the last context_snapshot and before up_to_step count.
    An `assistant` record changes the raw_assistant of its step, a `tool` record the raw_tool of its call; other raw records stay.
    """
    w = Window.partitionBy(session)
    snapshot = F.coalesce(F.max(F.when(F.col("type") == "context_snapshot", F.col("line_no"))).over(w), F.lit(-1))
    live = records.withColumn("after__", snapshot).filter((F.col("line_no") > F.col("after__")) & (F.col("step") < up_to_step))
    raw = F.startswith("type", F.lit("raw_"))
    role = F.replace("type", F.lit("raw_"), F.lit(""))
    key = F.when(role == "user", F.concat(F.lit("u"), F.col("line_no").cast("string"))).when(role == "tool", F.concat(F.lit("t"), F.coalesce("tool_call_id", F.lit("")))).otherwise(F.concat(F.lit("a"), F.col("step").cast("string")))
    g = live.filter(role.isin("user", "assistant", "tool")).withColumn("role", role).withColumn("raw__", raw).groupBy(session, "role", key.alias("key__"))
    first = lambda value, when: F.min_by(F.when(when, F.col(value)), F.when(when, F.col("line_no")))
    tracks = g.agg(F.min(F.when(F.col("raw__"), F.col("line_no"))).alias("line_no"), first("content", F.col("raw__")).alias("raw"), F.max_by(F.when(~F.col("raw__"), F.col("content")), F.when(~F.col("raw__"), F.col("line_no"))).alias("delta"))
    return tracks.filter("line_no is not null").select(session, "line_no", "role", "raw", F.coalesce("delta", "raw").alias("effective"))


def latest_checkpoint(rows: DataFrame, run: str, step: str, values: list[str]) -> DataFrame:
    """The state of each run's last step; of equal steps the last written counts."""
    return rows.groupBy(run).agg(F.max_by(F.struct(step, *values), F.struct(step, "ts")).alias("s")).select(run, "s.*")


def search_sessions(turns: DataFrame, term: str, around: int, page: int, size: int) -> DataFrame:
    """One page of conversations that a user's turn of holds the term: first hit with its surroundings, latest first, and the total."""
    at = F.instr(F.lower("text"), term.lower())
    hits = turns.filter((F.col("role") == "user") & (at > 0)).withColumn("at", at).withColumn("from", F.greatest(F.col("at") - around, F.lit(1)))
    cut = F.substr(F.col("text"), F.col("from"), F.col("at") + len(term) + around - F.col("from"))
    snippet = F.concat(F.when(F.col("from") > 1, "...").otherwise(""), cut, F.when(F.col("at") + len(term) + around <= F.length("text"), "...").otherwise(""))
    found = hits.groupBy("conv_id").agg(F.min_by(snippet, "turn").alias("snippet"), F.max("turn").alias("updated"))
    total = found.agg(F.count("*").alias("total"))  # one row
    return found.crossJoin(F.broadcast(total)).orderBy(F.desc("updated"), "conv_id").offset(page * size).limit(size)


def recent_days(rows: DataFrame, day: Column, today: str, days: int) -> DataFrame:
    return rows.filter(day >= F.date_sub(F.lit(today).cast("date"), days)).filter(day <= F.lit(today).cast("date"))


def token_chunks(docs: DataFrame, key: str, size: Column, chunk: int) -> DataFrame:
    """(key, chunk, start, end): where documents lie in fixed chunks of one long token array, a row for each chunk that one touches,
    with boundaries counted from the chunk's start and clipped to it."""
    from tessella.operators.joins import dense_index

    placed = dense_index(docs.select(key, size.cast("long").alias("n")), [key]).withColumn("block", F.floor(F.col("index") / 4096))
    blocks = placed.groupBy("block").agg(F.sum("n").alias("total"))
    before = blocks.withColumn("before", F.coalesce(F.sum("total").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("total")  # a row for each 4096 documents
    inside = F.sum("n").over(Window.partitionBy("block").orderBy("index").rowsBetween(Window.unboundedPreceding, 0))
    at = placed.withColumn("inside", inside).join(before, "block").withColumn("end", F.col("before") + F.col("inside")).withColumn("start", F.col("end") - F.col("n")).filter("n > 0")
    each = at.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("start") / chunk), F.floor((F.col("end") - 1) / chunk))))
    base = F.col("chunk") * chunk
    return each.select(key, "chunk", F.greatest(F.col("start") - base, F.lit(0)).alias("start"), F.least(F.col("end") - base, F.lit(chunk)).alias("end"))


def log_metrics(text: Column, names: list[str]) -> Column:
    """A map of the metrics that a log panel names first, without terminal colours."""
    plain = F.regexp_replace(text, "\x1b\\[[0-9;]*m", "")
    return F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*(F.regexp_extract(plain, rf"{n}\s*[:=]\s*([-+0-9.eE]+)", 1).try_cast("double") for n in names)))


def _small(rows: DataFrame, most: int) -> list[list[str]]:
    """All rows as strings; more than `most` are a ValueError and not cut off."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} rows; write them with another sink")
    return [[str(v) for v in r] for r in found]


def markdown_table(rows: DataFrame, most: int = 1000) -> str:
    """A small result as a Markdown table."""
    names = rows.columns
    return "\n".join(["| " + " | ".join(names) + " |", "|" + "---|" * len(names), *("| " + " | ".join(x) + " |" for x in _small(rows, most))])


def latex_table(rows: DataFrame, most: int = 1000) -> str:
    """A small result as a LaTeX table."""
    lines = [" & ".join(r) + r" \\" for r in [rows.columns, *_small(rows, most)]]
    return "\n".join([r"\begin{tabular}{" + "l" * len(rows.columns) + "}", *lines, r"\end{tabular}"])


def tool_calls(lines: DataFrame, key: str, line: str) -> DataFrame:
    """(key, tool, calls) of event log lines: the tools that assistant events call, by name or by their function's name, else `unknown`.
    Lines that are no JSON are skipped."""
    event = F.from_json(line, "type string, message struct<tool_calls: array<struct<name: string, function: struct<name: string>>>>")
    calls = lines.select(key, event.alias("e")).filter("e.type = 'raw_assistant'").select(key, F.explode("e.message.tool_calls").alias("c"))
    name = F.coalesce(F.nullif("c.name", F.lit("")), F.nullif("c.function.name", F.lit("")), F.lit("unknown"))
    return calls.groupBy(key, name.alias("tool")).agg(F.count("*").alias("calls"))


def pass_map(results: DataFrame, folder: str, result: str) -> DataFrame:
    """(task, passed) of JSON results of trial folders: a reward above zero. The task is the result's, or the folder's name up to `__`;
    folders that begin with `_` and results that are no JSON are skipped, and of a task's folders the last by name counts."""
    found = F.from_json(result, "task_name string, verifier_result struct<rewards: struct<reward: double>>, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    rows = results.filter(~F.startswith(folder, F.lit("_"))).select(F.col(folder).alias("folder"), found.alias("r")).filter("r is not null and r._bad is null")
    task = F.coalesce(F.nullif("r.task_name", F.lit("")), F.substring_index("folder", "__", 1))
    passed = F.coalesce(F.col("r.verifier_result.rewards.reward") > 0, F.lit(False))
    return rows.groupBy(task.alias("task")).agg(F.max_by(passed, "folder").alias("passed"))


# The form of a trainer's log panels.
ANSI = "\x1b\\[[0-9;]*m"
BOX = "[│╭╮╰╯─]"
PANEL = "Metrics"
PAIR = r"([A-Za-z][\w/]*(?:_[\w/]+)*)\s*:\s*(-?\d+\.?\d*(?:[eE][+-]?\d+)?)"


def log_panels(logs: DataFrame, key: str, text: str, names: list[str], needed: str = "training_step") -> DataFrame:
    """(key, panel, metrics): a map of the named metrics for each panel of a log that has the needed one; a panel's first value counts."""
    parts = F.split(F.regexp_replace(text, ANSI, ""), PANEL)
    panels = logs.select(key, F.posexplode(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))).alias("panel", "flat"))
    flat = F.regexp_replace("flat", BOX, " ")
    pairs = F.struct(F.regexp_extract_all(flat, F.lit(PAIR), F.lit(1)).alias("k"), F.regexp_extract_all(flat, F.lit(PAIR), F.lit(2)).alias("v"))
    read = panels.select(key, "panel", F.explode(F.array(pairs)).alias("p"))
    value = lambda n: F.get("p.v", (F.array_position("p.k", n) - 1).cast("int")).cast("double")
    metrics = read.select(key, "panel", F.explode(F.array(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*map(value, names))))).alias("metrics"))
    return metrics.filter(F.col("metrics")[needed].isNotNull())
