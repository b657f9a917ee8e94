"""Conversions between layouts of examples: messages arrays, prompts, preferences and training records."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.text import let

MESSAGES = "array<struct<role:string,content:string>>"
ROLE_KEYS = {"human": "user", "gpt": "assistant"}


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def from_fields(user: Column, assistant: Column, system: Column | None = None, context: Column | None = None) -> Column:
    """Messages of an instruction row; a blank context adds nothing, a null or blank system no turn."""
    asked = user if context is None else F.when(F.trim(F.coalesce(context, F.lit(""))) == "", user).otherwise(F.concat_ws("\n\n", user, context))
    turns = F.array(message("user", asked), message("assistant", assistant))
    if system is None:
        return turns
    return F.when(F.trim(F.coalesce(system, F.lit(""))) == "", turns).otherwise(F.concat(F.array(message("system", system)), turns))


def nested(turns: DataFrame) -> DataFrame:
    """(conv_id, messages) from rows of turns."""
    g = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("t"))
    return g.select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))


def rename_keys(conversations: Column) -> Column:
    """from/value entries as role/content, with usual role names."""

    def role(x: Column) -> Column:
        out = x["from"]
        for other, usual in ROLE_KEYS.items():
            out = F.when(x["from"] == other, usual).otherwise(out)
        return out

    return F.transform(conversations, lambda x: F.struct(role(x).alias("role"), x["value"].alias("content")))


def inject_system(messages: Column, prompt: str) -> Column:
    """One system turn first, in place of any others."""
    return F.concat(F.array(message("system", F.lit(prompt))), F.filter(messages, lambda m: m["role"] != "system"))


def prompt_of(messages: Column) -> Column:
    """Messages without a trailing assistant turn."""
    return F.when(F.element_at(messages, -1)["role"] == "assistant", F.slice(messages, 1, F.size(messages) - 1)).otherwise(messages)


def joined(messages: Column) -> Column:
    return F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")


def mask_labels(ids: Column, starts: Column, ends: Column, ignore: int = -100) -> Column:
    """Ids inside any [start, end) span, all others replaced."""
    spans = F.arrays_zip(starts.alias("a"), ends.alias("b"))
    return F.transform(ids, lambda x, i: F.when(F.exists(spans, lambda s: (i >= s["a"]) & (i < s["b"])), x).otherwise(ignore))


def trainable(ids: Column, labels: Column, most: int, ignore: int = -100) -> Column:
    """Short enough and with some label that counts."""
    return (F.size(ids) <= most) & F.exists(labels, lambda x: x != ignore)


def split_dialogue(text: Column, human: str = "\n\nHuman: ", assistant: str = "\n\nAssistant: ") -> Column:
    """Messages of a marked dialogue. Markers pair up by number, so roles alternate and a surplus of either kind is left in its text."""
    def places(marker: str) -> Column:
        n = ((F.length(text) - F.length(F.replace(text, F.lit(marker), F.lit("")))) / len(marker)).cast("int")
        return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.length(F.call_function("substring_index", text, F.lit(marker), i)))).otherwise(F.array().cast("array<int>"))

    def turn(role: str, begin: Column, marker: str, end: Column) -> Column:
        at = begin + len(marker)
        return F.struct(F.lit(role).alias("role"), F.substring(text, at + 1, F.greatest(end - at, F.lit(0))).alias("content"))

    def pairs(p: Column) -> Column:
        ends = F.concat(F.transform(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), lambda x: x["h"]), F.array(F.length(text)))
        return F.flatten(F.transform(F.arrays_zip(p.alias("p"), ends.alias("end")), lambda x: F.array(turn("user", x["p"]["h"], human, x["p"]["a"]), turn("assistant", x["p"]["a"], assistant, x["end"]))))

    both = F.filter(F.arrays_zip(places(human).alias("h"), places(assistant).alias("a")), lambda x: x["h"].isNotNull() & x["a"].isNotNull())
    return let(both, lambda p: F.when(F.size(p) > 0, pairs(p)).otherwise(F.array().cast("array<struct<role:string,content:string>>")))


def complete_dialogue(messages: Column) -> Column:
    """No empty turn, and the assistant speaks last."""
    return (F.size(messages) > 0) & F.forall(messages, lambda m: m["content"] != "") & (F.element_at(messages, -1)["role"] == "assistant")


def unknown_tools(rows: DataFrame, key: str, tools: str, known: DataFrame) -> DataFrame:
    """(tool, kind): tools that rows use but nobody defined, and defined ones that no row uses."""
    used, defined = rows.select(F.explode(tools).alias("tool")).distinct(), known.select("tool").distinct()
    return used.join(defined, "tool", "left_anti").withColumn("kind", F.lit("unknown")).union(defined.join(used, "tool", "left_anti").withColumn("kind", F.lit("unused")))


def rating(text: Column) -> Column:
    """The text as a whole number, -1 where it is none."""
    return F.coalesce(text.try_cast("int"), F.lit(-1))


def mean_ratings(rows: DataFrame, key: str, ratings: str) -> DataFrame:
    """(key, pos, mean): the mean over a key's rows at each place of ragged arrays, NaN and null left out."""
    each = rows.select(key, F.posexplode(ratings).alias("pos", "value")).filter(~F.isnan("value"))
    return each.groupBy(key, "pos").agg(F.avg("value").alias("mean"))


def elapsed_seconds(start: Column, end: Column, whole_start: Column, whole_end: Column) -> Column:
    """Seconds of the phase, else of the whole trial; null unless positive."""
    span = lambda a, b: (F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))) / 1e6
    positive = lambda x: F.when(x > 0, x)
    return F.coalesce(positive(span(start, end)), positive(span(whole_start, whole_end)))


def container_fields(text: Column) -> dict[str, Column]:
    """Base image, work directory and installed packages of a container file."""
    return {
        "base": F.regexp_extract(text, r"(?im)^\s*from:?\s+(\S+)", 1),
        "workdir": F.regexp_extract(text, r"(?im)^\s*workdir\s+(\S+)", 1),
        "packages": F.regexp_extract(text, r"(?im)apt-get install (?:-y )?([^\n&]+)", 1),
    }


def step_records(steps: DataFrame, run: str, order: list[str], shown: Column, acts: Column) -> DataFrame:
    """One record for each act with the history of its run before it."""
    w = Window.partitionBy(run).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return steps.withColumn("history", F.array_join(F.collect_list(shown).over(w), "\n")).filter(acts)


def tool_arguments(text: Column) -> Column:
    """Arguments as a JSON object string: {} for nothing, `_raw` for what is no JSON, `value` for JSON that is no object."""
    parsed = F.get_json_object(text, "$")
    return (
        F.when(F.trim(F.coalesce(text, F.lit(""))) == "", "{}")
        .when(parsed.isNull(), F.to_json(F.struct(text.alias("_raw"))))
        .when(F.startswith(F.ltrim(text), F.lit("{")), parsed)
        .otherwise(F.concat(F.lit('{"value":'), parsed, F.lit("}")))
    )


def _calls_as_text(messages: str | None) -> str | None:
    try:
        rows = json.loads(messages) if messages is not None else None
    except ValueError:
        return None
    if not isinstance(rows, list) or not all(isinstance(m, dict) for m in rows):
        return None
    for call in (c for m in rows if isinstance(m.get("tool_calls"), list) for c in m["tool_calls"] if isinstance(c, dict)):
        function = call.get("function")
        if isinstance(function, dict) and "arguments" in function:
            given = function["arguments"]
            if isinstance(given, dict):
                function["arguments"] = {k: v if isinstance(v, str) else str(v) for k, v in given.items()}
            elif not isinstance(given, str):
                function["arguments"] = json.dumps(given)
    return json.dumps(rows, ensure_ascii=False, separators=(",", ":"))


def tool_calls_as_text(messages: Column) -> Column:
    """Messages as a JSON array whose tool calls have arguments of one type: each value of an object as Python prints it, strings as they
    are; arguments that are neither object nor string as JSON text. What nests in a value becomes part of its text, whatever its depth.
    Null for what is no JSON array of objects. Values of any depth need a walk that column functions don't have, so it is an Arrow batch function.
    """
    return F.pandas_udf(lambda s: s.map(_calls_as_text, na_action="ignore").astype(object).where(lambda x: x.notna(), None), "string")(messages)


def clipped(text: Column, most: int, mark: str = "\n...[truncated]...") -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(mark))).otherwise(text)


# The tool that every row of a shell corpus offers.
SHELL_TOOL = {"type": "function", "function": {"name": "bash", "description": "Execute a bash command. Each command runs in a new subshell.", "parameters": '{"type": "object", "properties": {"command": {"type": "string", "description": "The bash command to execute."}}, "required": ["command"]}'}}


def with_tools(df: DataFrame, tools: list[dict] | None = None, name: str = "tools") -> DataFrame:
    """The rows with one constant column of tool definitions; parameters are JSON text."""
    made = [F.struct(F.lit(t["type"]).alias("type"), F.struct(*(F.lit(v).alias(k) for k, v in t["function"].items())).alias("function")) for t in (tools or [SHELL_TOOL])]
    return df.withColumn(name, F.array(*made))


def reply_paths(messages: DataFrame, view: str, top_k: int | None = None) -> DataFrame:
    """(id, depth, trail): paths from a root to each assistant's message that nobody replied to, without deleted ones and what hangs on them.

    messages: id, parent, role, quality (null: 0), deleted (null: no). Only the top_k replies by quality, then by id, go on. A message whose replies are all
    deleted is no end of a path, as it has replies. The recursion has Spark's limits of levels and rows. view: a name for the temporary view.
    """
    from tessella.operators.joins import lineage

    alive = messages.filter(~F.coalesce("deleted", F.lit(False)))
    replies = alive.filter("parent is not null")
    if top_k is not None:
        best = Window.partitionBy("parent").orderBy(F.desc(F.coalesce("quality", F.lit(0.0))), "id")
        replies = replies.withColumn("k__", F.row_number().over(best)).filter(F.col("k__") <= top_k)
    columns = ["id", "parent", "role"]
    alive.filter("parent is null").select(*columns).unionByName(replies.select(*columns)).createOrReplaceTempView(view)
    paths = lineage(messages.sparkSession.sql, view, "id", "parent", "parent IS NULL").select("id", "depth", "trail")
    ends = alive.filter("role = 'assistant'").select("id").join(messages.filter("parent is not null").select(F.col("parent").alias("id")).distinct(), "id", "left_anti")
    return paths.join(ends, "id", "left_semi")


def _qa(question: Column, truth: Column, prompt: str, suffix: str = "") -> list[Column]:
    user = message("user", F.concat(F.lit(prompt), question, F.lit(suffix)))
    return [F.array(user).alias("messages"), truth.alias("ground_truth"), F.lit("re_search").alias("dataset")]


def _after_thinking(text: Column) -> Column:
    return F.substring_index(text, "</think>", -1)


#: Columns of a question-answering layout as messages, ground_truth and dataset: one answer, lists of answers as JSON (without
#: blanks) with a question mark added, and aliases inside the answer. The second argument is a prompt before the question.
QA_LAYOUTS: dict[str, Callable[[str], list[Column]]] = {
    "one_answer": lambda prompt: _qa(F.col("question"), F.col("answer").cast("string"), prompt),
    "answers": lambda prompt: _qa(F.col("question"), F.to_json("answer"), prompt, "?"),
    "aliases": lambda prompt: _qa(F.col("question"), F.to_json("answer.aliases"), prompt),
}


def qa_rows(rows: DataFrame, key: str, layout: str, prompt: str = "") -> DataFrame:
    """(key, messages, ground_truth, dataset) of question-answering rows of a named layout."""
    return rows.select(key, *QA_LAYOUTS[layout](prompt))


def long_form_rows(rows: DataFrame, key: str, prompt: str = "") -> DataFrame:
    """(key, messages, ground_truth, no_reasoning_ground_truth, dataset) of rows with prompt and response; the prompt follows the question."""
    user = F.array(message("user", F.concat("prompt", F.lit(prompt))))
    return rows.select(key, user.alias("messages"), F.col("response").alias("ground_truth"), _after_thinking(F.col("response")).alias("no_reasoning_ground_truth"), F.lit("long_re_search").alias("dataset"))


def long_form_messages(rows: DataFrame, key: str) -> DataFrame:
    """The same columns of rows that have messages already: the last one is the truth, and no messages have none."""
    last = F.try_element_at("messages", F.lit(-1))["content"]
    return rows.select(key, "messages", last.alias("ground_truth"), last.alias("no_reasoning_ground_truth"), F.lit("long_re_search").alias("dataset"))
