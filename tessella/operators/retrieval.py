"""Retrieval: capability tokens, TF-IDF similarity, keyword ranking with time decay, fingerprints."""

from __future__ import annotations

import fnmatch
import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.text import strip

# Where capabilities are named in a text.
COMMAND = r"(?m)(?:^|\||&&|;|\$\()\s*([a-z][a-z0-9_.+-]{1,24})\b"
IMPORT = r"(?m)^\s*(?:import|from)\s+([a-zA-Z_][\w.]*)"
EXTENSION = r"\.(c|cpp|h|hpp|py|pyx|rs|go|java|sql|db|sqlite3?|json|yaml|yml|csv|tsv|toml|pem|crt|key|md|tex|gcode|mjcf|xml|so|a|tar|gz|zip|png|jpg|mp4|log)\b"
PIP = r"(?:pip3?|uv pip)\s+install\s+([^\n|&;]+)"
APT = r"apt(?:-get)?\s+install[^\n|&;]*?((?:\s+-\w+)*\s+[\w+.-]+(?:\s+[\w+.-]+)*)"
STOP_TOOLS = ["cd", "ls", "cat", "echo", "pwd", "mkdir", "rm", "cp", "mv", "touch", "true", "false", "set", "export", "source", "then", "else", "fi", "do", "done", "if", "for", "while", "head", "tail", "wc", "sleep", "exit", "chmod", "which", "printf", "test", "eval", "read", "local", "return", "function", "sh", "bash"]


def capability_tokens(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, token, tf): commands, imports, installed packages and file extensions with their counts."""
    low, group = F.lower(text), F.lit(1)
    commands = F.transform(F.filter(F.regexp_extract_all(low, F.lit(COMMAND), group), lambda x: ~x.isin(STOP_TOOLS)), lambda x: F.concat(F.lit("cmd:"), x))
    modules = F.transform(F.regexp_extract_all(F.col(text), F.lit(IMPORT), group), lambda x: F.concat(F.lit("py:"), F.lower(F.substring_index(x, ".", 1))))
    files = F.transform(F.regexp_extract_all(low, F.lit(EXTENSION), group), lambda x: F.concat(F.lit("ext:"), x))

    def packages(pattern: str, divider: str, kind: str) -> Column:
        named = F.flatten(F.transform(F.regexp_extract_all(low, F.lit(pattern), group), lambda x: F.split(strip(x), divider)))
        return F.transform(F.filter(named, lambda x: (x != "") & ~F.startswith(x, F.lit("-"))), lambda x: F.concat(F.lit(kind), x))

    installed = F.concat(packages(PIP, r"[\s,]+", "py:"), packages(APT, r"\s+", "apt:"))
    return docs.select(key, F.explode(F.concat(commands, modules, installed, files)).alias("token")).groupBy(key, "token").agg(F.count("*").alias("tf"))


def word_counts(docs: DataFrame, key: str, text: str, least: int = 3) -> DataFrame:
    """(key, token, tf): lower-cased ASCII words of some length."""
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+"), F.lit(0)), lambda x: F.length(x) >= least)
    return docs.select(key, F.explode(words).alias("token")).groupBy(key, "token").agg(F.count("*").alias("tf"))


def idf(counts: DataFrame, key: str, n: int) -> DataFrame:
    """(token, idf): ln((n + 1) / (df + 1)) + 1; counts: one row for each (key, token)."""
    return counts.groupBy("token").agg((F.log(F.lit(n + 1.0) / (F.count(key) + 1.0)) + 1.0).alias("idf"))


def weights(counts: DataFrame, idfs: DataFrame, key: str) -> DataFrame:
    """(key, token, w) of unit length: (1 + ln tf) * idf; tokens without an idf count with 1."""
    w = counts.join(idfs, "token", "left").select(key, "token", ((1.0 + F.log("tf")) * F.coalesce("idf", F.lit(1.0))).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return w.filter(F.col(key).isNotNull()).select(key, "token", (F.col("w") / norm).alias("w"))


def retrieve(left: DataFrame, right: DataFrame, left_key: str, right_key: str, least: float, k: int, few: bool = False) -> DataFrame:
    """(left, right, sim): the k most similar rights of each left, through the tokens they share; never a cross join.

    Both sides are unit weights (key, token, w). Few lefts are broadcast: the weights of a right stay together, and pairs are summed where
    they arise, so that frequent tokens shuffle nothing."""
    a, b = left.withColumnRenamed("w", "wa"), right.withColumnRenamed("w", "wb")
    a = F.broadcast(a) if few else a
    sims = a.join(b, "token").groupBy(left_key, right_key).agg(F.sum(F.col("wa") * F.col("wb")).alias("sim")).filter(F.col("sim") >= least)
    order = Window.partitionBy(left_key).orderBy(F.desc(F.round("sim", 9)), right_key)
    return sims.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(left_key, right_key, "sim", "rank")


def keyword_rank(docs: DataFrame, key: str, text: str, keywords: list[str]) -> DataFrame:
    """(key, score): sum of ln(1 + tf) * ln(1 + N / df), where N counts the documents with any of the keywords."""
    counts = [F.regexp_count(F.lower(text), F.lit(rf"\Q{k}\E")).alias(f"k{i}") for i, k in enumerate(keywords)]
    hits = docs.filter(F.lower(text).rlike("|".join(rf"\Q{k}\E" for k in keywords))).select(key, *counts)
    df = hits.agg(F.count("*").alias("n"), *(F.count_if(F.col(f"k{i}") > 0).alias(f"d{i}") for i in range(len(keywords))))  # one row
    parts = [F.log(1.0 + F.col(f"k{i}")) * F.log(1.0 + F.col("n") / F.greatest(F.col(f"d{i}"), F.lit(1))) for i in range(len(keywords))]
    return hits.crossJoin(F.broadcast(df)).select(key, sum(parts[1:], parts[0]).alias("score"))


def decayed(importance: Column, updated: Column, now: Column, half_life_days: float) -> Column:
    """importance * 2 ** (-days / half-life); an unknown date changes nothing, a future one counts as now."""
    days = F.greatest((F.unix_micros(now.cast("timestamp")) - F.unix_micros(updated.cast("timestamp"))) / 86_400_000_000.0, F.lit(0.0))
    return F.when(updated.isNull(), importance).otherwise(importance * F.exp(-F.log(F.lit(2.0)) * days / max(1.0, half_life_days)))


def relevant_lines(docs: DataFrame, key: str, text: str, pattern: str, around: int) -> DataFrame:
    """(key, line_no, line, hit): matching lines with their neighbours."""
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    hit = F.lower("line").rlike(pattern)
    near = F.max(hit).over(Window.partitionBy(key).orderBy("line_no").rowsBetween(-around, around))
    return lines.withColumn("hit", hit).withColumn("near__", near).filter("near__").drop("near__")


def front_matter(text: Column) -> Column:
    """Key-value pairs between `---` lines at the start as a map; the first of equal keys counts."""
    block = F.regexp_extract(text, r"(?s)^---\n(.*?)\n---", 1)
    pairs = F.filter(F.transform(F.split(block, "\n"), lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("v"), (F.instr(x, ":") > 0).alias("ok"))), lambda p: p["ok"])
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.filter(pairs, lambda p: p["k"] == k)[0]["v"]))


def fingerprint(*columns: Column, length: int = 64) -> Column:
    """A prefix of the SHA-256 of the columns' JSON."""
    return F.substring(F.sha2(F.to_json(F.struct(*columns)), 256), 1, length)


# English words that are no keywords.
STOP_WORDS = ["the", "and", "for", "with", "that", "this", "from", "are", "was", "not", "but", "have", "has", "you", "your", "all", "can", "will", "its", "our", "out", "use", "how", "what", "when", "which", "who", "most", "should", "other", "there", "after", "then", "only", "those", "these"]


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility composition, which Spark has no function for."""
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def keywords(text: Column) -> Column:
    """Distinct keywords, sorted: ASCII words of three characters or more but stop words, and pairs of neighbouring Han characters."""
    low = F.lower(nfkc(text))
    latin = F.filter(F.regexp_extract_all(low, F.lit("[a-z0-9_-]+"), F.lit(0)), lambda x: (F.length(x) > 2) & ~x.isin(STOP_WORDS))
    runs = F.regexp_extract_all(low, F.lit("[\\u4e00-\\u9fff\\u3400-\\u4dbf]+"), F.lit(0))
    pairs = F.flatten(F.transform(runs, lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substr(r, i, F.lit(2))))))
    return F.array_sort(F.array_distinct(F.concat(latin, pairs)))


def capped_selection(candidates: DataFrame, quotas: DataFrame, keep: Callable[[DataFrame], DataFrame], per_env: int, rounds: int = 1000) -> DataFrame:
    """(task, env, cand): what tasks pick one after another, best candidates first, up to their need, while no env gives more than per_env.

    candidates: (task, task_order, rank, env, cand), one row for each (task, env, cand); quotas: (task, need). All tasks propose at once; an env keeps the proposals of
    the earliest tasks and turns the others down, and tasks then propose their next ones. Envs rank tasks alike, so the end is
    what picking in order gives. A full env only ever changes its worst proposal for an earlier one, so every candidate after that one goes
    at once, proposed or not. keep: writes a table and reads it again, to cut the plan of each round.
    """
    left = keep(candidates.join(quotas.filter("need > 0"), "task"))
    by_task, by_env = Window.partitionBy("task").orderBy("rank", "cand", "env"), Window.partitionBy("env").orderBy("task_order", "rank", "cand", "task")
    place = F.struct("task_order", "rank", "cand", "task")
    for _ in range(rounds):
        asked = left.withColumn("p", F.row_number().over(by_task)).filter("p <= need")
        held = keep(asked.withColumn("q", F.row_number().over(by_env)).filter(F.col("q") <= per_env).drop("p"))
        full = held.filter(F.col("q") == per_env).select("env", place.alias("worst"))  # a row for each full env
        rest = keep(left.join(full, "env", "left").filter(F.col("worst").isNull() | (place <= F.col("worst"))).drop("worst"))
        if rest.count() == left.count():
            return held.select("task", "env", "cand")
        left = rest
    raise RuntimeError("more rounds than allowed")


def relevant_text(docs: DataFrame, key: str, text: str, words: list[str], around: int, head: int = 20) -> DataFrame:
    """(key, shown): lines that hold any of the words, whatever the case, with their neighbours and `...` for each gap; of a text without such a
    line the first ones, and `...` if there are more. A null text stays null."""
    lines = docs.select(key, F.explode(F.array(F.split(text, "\n"))).alias("lines"))
    hit = F.transform("lines", lambda x: F.exists(F.array(*map(F.lit, [w.lower() for w in words])), lambda w: F.contains(F.lower(x), w)))
    hits = lines.select(key, "lines", F.explode(F.array(hit)).alias("hits"))
    near = lambda i: F.array_contains(F.slice("hits", F.greatest(i - around, F.lit(1)), i + around + 1 - F.greatest(i - around, F.lit(1))), True)
    kept = F.filter(F.sequence(F.lit(1), F.greatest(F.size("lines"), F.lit(1))), near)
    placed = hits.select(key, "lines", F.explode(F.array(kept)).alias("kept"))
    gap = lambda i, n: (n > 0) & (F.get("kept", n - 1) < i - 1)
    found = F.array_join(F.transform("kept", lambda i, n: F.concat(F.when(gap(i, n), "...\n").otherwise(""), F.element_at("lines", i))), "\n")
    first = F.concat(F.array_join(F.slice("lines", 1, head), "\n"), F.when(F.size("lines") > head, "\n...").otherwise(""))
    return placed.select(key, F.when(F.col("lines").isNull(), None).when(F.size("kept") > 0, found).otherwise(first).alias("shown"))


def entity_names(prompt: str) -> list[str]:
    """Capitalised words of a prompt, each once, in order."""
    return list(dict.fromkeys(re.findall(r"\b[A-Z][a-z]{2,}\b", prompt)))


def entity_hits(memories: DataFrame, key: str, field: str, names: list[str], most: int) -> DataFrame:
    """(key, match): how many of the names the keyword field holds, whatever the case, for the `most` best; ties by key."""
    score = sum((F.contains(F.lower(field), F.lit(n.lower())).cast("int") for n in names), F.lit(0))
    return memories.select(key, score.cast("double").alias("match")).filter("match > 0").orderBy(F.desc("match"), key).limit(most)


def search_rank(hits: DataFrame, entities: DataFrame, memories: DataFrame, key: str, now: Column, half_life_days: float) -> DataFrame:
    """(key, match, decay, place) of active memories by match, then by decayed importance, then by key.

    hits: (key, match), the best of a text search; entities: keys found by entity names alone, which match with 0.5;
    memories: (key, status, importance, accessed). Hits are a bounded list, so one window orders them.
    """
    named = entities.join(hits, key, "left_anti").select(key, F.lit(0.5).alias("match"))
    found = hits.select(key, F.round("match", 9).alias("match")).unionByName(named).join(memories.filter("status = 'active'"), key)
    scored = found.select(key, "match", decayed(F.col("importance"), F.col("accessed"), now, half_life_days).alias("decay"))
    return scored.withColumn("place", F.row_number().over(Window.orderBy(F.desc("match"), F.desc(F.round("decay", 9)), key)))


def _line_entries(files: DataFrame, path: str, text: str, regex: str, before: int, after: int, numbers: bool) -> DataFrame:
    """(path, matches, entries) of files with a matching line: matching lines and their neighbours as entries, `--` for gaps."""
    body = F.regexp_replace(text, "(\r\n|\n|\r)$", "")
    lines = files.filter(F.length(text) > 0).select(F.col(path).alias("path"), F.explode(F.array(F.split(body, "\r\n|\n|\r"))).alias("lines"))
    hits = lines.select("path", "lines", F.explode(F.array(F.transform("lines", lambda x: F.rlike(x, F.lit(regex))))).alias("hits")).filter(F.array_contains("hits", True))
    low = lambda i: F.greatest(i - after, F.lit(1))
    near = lambda i: F.array_contains(F.slice("hits", low(i), i + before + 1 - low(i)), True)
    kept = hits.select("path", "lines", F.size(F.filter("hits", lambda x: x)).alias("matches"), F.explode(F.array(F.filter(F.sequence(F.lit(1), F.size("lines")), near))).alias("kept"))
    shown = lambda i: F.concat("path", F.concat(F.lit(":"), i.cast("string")) if numbers else F.lit(""), F.lit(":"), F.element_at("lines", i))
    entry = lambda i, n: F.when((n > 0) & (F.get("kept", n - 1) < i - 1), F.array(F.lit("--"), shown(i))).otherwise(F.array(shown(i)))
    return kept.select("path", "matches", F.flatten(F.transform("kept", entry)).alias("entries"))


def _text_entries(files: DataFrame, path: str, text: str, regex: str, numbers: bool) -> DataFrame:
    """(path, matches, entries) of files with matches that may span lines: each match's first line with its line number."""
    named = files.select(F.col(path).alias("path"), F.col(text).alias("text"))
    found = named.select("path", F.explode(F.array(F.regexp_extract_all("text", F.lit(regex), F.lit(0)))).alias("found"), F.split("text", regex, -1).alias("rest")).filter(F.size("found") > 0)
    each = found.select("path", F.size("found").alias("matches"), F.posexplode(F.arrays_zip("found", F.slice("rest", 1, F.size("found")).alias("rest"))).alias("at", "m"))
    breaks = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    before = F.sum(breaks(F.col("m.rest")) + breaks(F.col("m.found"))).over(Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)) - breaks(F.col("m.found"))
    number = F.concat(F.lit(":"), (before + 1).cast("string")) if numbers else F.lit("")
    entry = F.concat("path", number, F.lit(":"), F.substring(F.regexp_extract("m.found", "^[^\r\n]*", 0), 1, 200))
    rows = each.select("path", "matches", "at", entry.alias("entry"))
    return rows.groupBy("path").agg(F.first("matches").alias("matches"), F.transform(F.array_sort(F.collect_list(F.struct("at", "entry"))), lambda x: x["entry"]).alias("entries"))


def search_files(files: DataFrame, path: str, text: str, pattern: str, mode: str = "files", *, name_like: str = "*", ignore_case: bool = False, before: int = 0, after: int = 0, numbers: bool = True, multiline: bool = False, offset: int = 0, head: int | None = 250) -> DataFrame:
    """(path, at, entry): what a regular expression finds in files, by path and place, from `offset` on and at most `head` entries.

    mode: `files` (paths), `count` (path and number of matching lines, or of matches in multiline mode) or `content` (lines, with context and gaps).
    name_like: shell pattern of the file's name. Texts that are null or empty have no lines. Paths are taken as unique, and a multiline pattern
    must not match the empty string. head None: no limit.
    """
    regex = f"(?m{'i' if ignore_case else ''}{'s' if multiline else ''}){pattern}"
    wanted = files.filter(F.rlike(F.substring_index(path, "/", -1), F.lit("^" + fnmatch.translate(name_like))))
    found = _text_entries(wanted, path, text, regex, numbers) if multiline else _line_entries(wanted, path, text, regex, before, after, numbers)
    if mode == "files":
        rows = found.select("path", F.lit(0).alias("at"), F.col("path").alias("entry"))
    elif mode == "count":
        rows = found.select("path", F.lit(0).alias("at"), F.concat("path", F.lit(": "), F.col("matches").cast("string")).alias("entry"))
    elif mode == "content":
        rows = found.select("path", F.posexplode("entries").alias("at", "entry"))
    else:
        raise ValueError(f"no such mode: {mode}")
    ordered = rows.orderBy("path", "at").offset(offset) if offset or head else rows
    return ordered.limit(head) if head else ordered
