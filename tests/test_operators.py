"""Operators on literal cases, empty tables and odd rows."""

from __future__ import annotations

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.functions import verifiers as V
from tessella.operators import attribution, chat, conversion, joins, outcomes, ranking, repetition, retrieval, sampling, sequences
from tessella.plans import registry
from tessella.sources import files
from tessella.streaming import runs


def value(spark, column, text="", label=""):
    return spark.createDataFrame([(text, label)], "text string, label string").select(column.alias("v")).first().v


@pytest.mark.parametrize(
    "column, text, want",
    [
        (lambda: T.paragraphs(F.col("text")), "Para 1.\n\nPara 2.\n\n\nPara 3.", ["Para 1.", "Para 2.", "Para 3."]),
        (lambda: T.sentences(F.col("text")), "Sentence 1. Sentence 2! Sentence 3?", ["Sentence 1", "Sentence 2", "Sentence 3"]),
        (lambda: T.is_math_or_code(F.col("text")), "x = y + 1", True),
        (lambda: T.is_math_or_code(F.col("text")), "This is normal text", False),
        (lambda: T.is_code_fragment(F.col("text")), "import numpy as np", True),
        (lambda: T.is_code_fragment(F.col("text")), "return True", True),
        (lambda: T.is_code_fragment(F.col("text")), "This is not code", False),
        (lambda: T.is_code_fragment(F.col("text")), "an open ( bracket", True),
        (lambda: T.contains_any(F.col("text"), ["not sure"]), "not sure", True),
        (lambda: T.contains_any(F.col("text"), ["no"]), "I know", True),
        (lambda: T.is_structured_list(F.col("text")), "1. a\n2. b", True),
        (lambda: T.is_structured_list(F.col("text")), "1. a\n- b", False),
        (lambda: T.is_think(F.col("text")), "<think>a</think> and more", True),
        (lambda: T.is_think(F.col("text")), "a <think>b</think>", False),
        (lambda: T.is_think_answer(F.col("text")), "<think>a</think><answer>b</answer>", True),
        (lambda: T.is_think_answer(F.col("text")), "<think>a</think> <answer>b</answer>", False),
        (lambda: T.is_think_answer(F.col("text")), "<think>a</think><answer>b</answer>\n", False),
        (lambda: T.add_answer(F.col("text")), "<think>a</think>b", "<think>a</think>\n<answer>\nb\n</answer>"),
        (lambda: T.add_answer(F.col("text")), "<think>a</think>\n<answer>b</answer>", "<think>a</think>\n<answer>b</answer>"),
        (lambda: T.add_answer(F.col("text")), "<answer>b", "<answer>b\n</answer>"),
        (lambda: T.remove_answer(F.col("text")), " <think>a</think><answer>b</answer> ", "<think>a</think>\nb"),
        (lambda: T.is_short_phrase(F.col("text")), "cz < xq", True),
        (lambda: T.is_short_phrase(F.col("text")), "red green blue", False),
        (lambda: T.is_short_phrase(F.col("text")), "I know", True),
        (lambda: T.has_legacy_keyword(F.col("text")), "napalm", True),
        (lambda: T.has_legacy_keyword(F.col("text")), "GPT 2", False),
        (lambda: T.names_provider(F.col("text")), "I am ChatGPT, an AI model.", True),
        (lambda: T.names_provider(F.col("text")), "This model was trained by OpenAI.", True),
        (lambda: T.names_provider(F.col("text")), "A claude is a name", False),
        (lambda: T.has_keyword(F.col("text")), "ask gpt-4 now", True),
        (lambda: T.has_keyword(F.col("text")), "laional", False),
        (lambda: T.last_python_block(F.col("text")), "```python\na\n``` x ```python\nb\n```", "b"),
        (lambda: T.command_shape(F.col("text")), "cat /a/b  | head -n 5", "cat <path> | head -n <n>"),
        (lambda: T.error_class(F.col("text")), "bash: x: command not found, error", "command_not_found"),
        (lambda: T.error_class(F.col("text")), "fine", None),
        (lambda: T.shorten_label(F.col("text")), "build task (hard), more", "build"),
        (lambda: V.token_f1(F.col("text"), F.lit("b c d")), "the a b c", 2 * 2 / 5),
        (lambda: V.token_f1(F.col("text"), F.lit("z")), "", 0.0),
        (lambda: V.number_match(F.col("text"), F.lit("1234.5")), "so 7, then 1,234.5", 1.0),
        (lambda: V.puzzle_match(F.col("text"), F.lit("paris")), "<think>x</think>Paris", 1.0),
        (lambda: V.puzzle_match(F.col("text"), F.lit("answer is 42")), "The answer is 42", 1.0),
        (lambda: V.finish_f1(F.col("text"), F.lit("z")), "<finish>a</finish>", 0.1),
        (lambda: V.is_json(F.col("text")), '{"a": [1]}', True),
        (lambda: V.is_json(F.col("text")), '"k": 1}', False),
        (lambda: V.is_part_of_choice(F.col("text"), ["yes or no"]), "yes", True),
        (lambda: V.sections(F.col("text"), 2, "##"), "## a ## b", True),
        (lambda: V.two_responses(F.col("text")), "a ****** b", True),
        (lambda: V.two_responses(F.col("text")), "a ****** a", False),
        (lambda: V.starred_paragraphs(F.col("text"), 2), "a\n* * *\nb", True),
        (lambda: V.word_count(F.col("text"), 5, "around"), "a b c d", True),
        (lambda: V.paragraph_starts(F.col("text"), 2, "So", 2), "x\n\nSo it is", True),
        (lambda: V.has_postscript(F.col("text"), "P.S."), "a P.S. b", True),
        (lambda: V.has_postscript(F.col("text"), "P.S."), "a P.S.", False),
        (lambda: conversion.tool_arguments(F.col("text")), "ls -l", '{"_raw":"ls -l"}'),
        (lambda: conversion.tool_arguments(F.col("text")), "[1]", '{"value":[1]}'),
        (lambda: conversion.rating(F.col("text")), "N/A", -1),
    ],
)
def test_column(spark, column, text, want):
    got = value(spark, column(), text)
    assert got == (pytest.approx(want) if isinstance(want, float) else want)


@pytest.mark.parametrize("share, dropped", [(4, False), (5, True), (6, True)])
def test_han_ratio_around_its_threshold(spark, share, dropped):
    assert value(spark, T.han_ratio(F.col("text")) >= 0.05, "漢" * share + "x" * (100 - share)) is dropped


@pytest.mark.parametrize("attempts, successes, want", [(1, 0, "sparse"), (3, 0, "unanimous_fail"), (3, 3, "unanimous_pass"), (4, 2, "split")])
def test_bands(spark, attempts, successes, want):
    assert value(spark, outcomes.band(F.lit(attempts), F.lit(successes), 2)) == want


def test_pass_at_k_is_the_closed_form(spark):
    cases = [(n, c) for n in range(1, 9) for c in range(n + 1)]
    df = spark.createDataFrame(cases, "n long, c long")
    for k in (1, 2, 4):
        for r in df.filter(f"n >= {k}").select("n", "c", outcomes.pass_at_k(F.col("n"), F.col("c"), k).alias("p")).collect():
            assert r.p == pytest.approx(1 - math.comb(r.n - r.c, k) / math.comb(r.n, k))


def test_paired_gate(spark):
    one = lambda rows: spark.createDataFrame(rows, "task_id string, score int")
    row = outcomes.paired(one([("a", 1), ("b", 0), ("c", 1)]), one([("a", 1), ("b", 1), ("c", 0)])).first()
    assert (row.wins, row.losses, row.ties) == (1, 1, 1) and row.p == pytest.approx(0.75)


def test_holdout_by_place_is_the_dealt_list(spark):
    for n, held in [(10, 3), (102, 51), (7, 7), (9, 0), (50, 1)]:
        got = [r.v for r in spark.range(n).select(sampling.dealt_to_holdout(F.col("id"), n, held).alias("v")).collect()]
        assert got == sampling.holdout_sides(n, held)


def test_round_robin_is_the_loop(spark):
    r = random.Random(3)
    rows = [(i, r.choice("abc")) for i in range(40)]
    got = [x.id for x in sampling.stratified_fill(spark.createDataFrame(rows, "id long, d string"), "d", "id", 25).collect()]
    assert len(got) == 25
    picked = {d: sum(1 for i in got if dict(rows)[i] == d) for d in "abc"}
    assert max(picked.values()) - min(picked.values()) <= 1 or min(picked, key=picked.get) in [d for d in "abc" if picked[d] == sum(1 for _, x in rows if x == d)]


def test_amounts():
    assert [sampling.parse_amount(a, 10) for a in ("3.0", "1", "0.25", "12")] == [30, 1, 2, 12]


def test_resample_of_nothing(spark):
    empty = spark.createDataFrame([], "id long")
    assert sampling.resample(empty, 5, "id").count() == 0
    assert sampling.split_pairs(empty, "id", 0.1).count() == 0
    assert sampling.stratified_fill(empty.withColumn("d", F.lit("x")), "d", "id", 3).count() == 0


def test_dense_index(spark):
    df = spark.range(1000).repartition(7).withColumn("k", -F.col("id"))
    assert [r.id for r in joins.dense_index(df, ["k"]).orderBy("index").collect()] == list(range(999, -1, -1))
    assert joins.dense_index(df.limit(0), ["k"]).count() == 0


def test_state_diff_knows_nulls(spark):
    one = lambda rows: spark.createDataFrame(rows, "k int, v string")
    got = {(r.k, r.op) for r in joins.state_diff(one([(1, None), (2, None), (3, "a"), (4, "b")]), one([(1, None), (2, "x"), (4, None), (5, None)]), "k", "v").collect()}
    assert got == {(2, "update"), (3, "delete"), (4, "update"), (5, "create")}


def test_overlay_takes_null_repairs(spark):
    one = lambda rows: spark.createDataFrame(rows, "k int, v int")
    assert {tuple(r) for r in joins.overlay(one([(1, 1), (2, 2)]), one([(2, None)]), "k", ["v"]).collect()} == {(1, 1), (2, None)}


@pytest.mark.parametrize(
    "text, thresholds, want",
    [
        (None, repetition.USUAL, ""),
        ("", repetition.USUAL, ""),
        ("Therefore,\n\n" * 50, repetition.USUAL, ""),
        ("import pandas. " * 60, repetition.USUAL, ""),
        ("import numpy as np. " * 60, repetition.USUAL, "line_repeated_60x_consecutive_short_phrase"),  # a phrase is in "numpy"
        ("so it is no. Blue car. " * 45, repetition.USUAL, ""),
        ("red green blue. " * 4, repetition.USUAL, "line_repeated_4x_consecutive"),
        ("red green blue. " * 3, repetition.USUAL, ""),
        ("red green blue. " * 19, repetition.FIRST_LOOK, ""),
        ("red green blue. " * 20, repetition.FIRST_LOOK, "line_repeated_20x_consecutive"),
        ("red green blue. yellow pink. " * 40, repetition.USUAL, "line_repeated_40x"),
        ("red green blue. yellow pink. " * 39, repetition.USUAL, ""),
        ("maybe red. " * 7, repetition.USUAL, ""),
        ("maybe red. " * 8, repetition.USUAL, "line_repeated_8x_consecutive_short_phrase"),
        ("word. " * 50, repetition.USUAL, ""),
        ("red = green blue. " * 7, repetition.USUAL, ""),
        ("large red paragraph of text\n\n" * 10, repetition.USUAL, "paragraph_repeated_10x"),
        ("large red paragraph of text\n\n" * 9, repetition.USUAL, ""),
        ("large red paragraph of text\n\nother blue paragraph of text\n\n" * 20, repetition.USUAL, "paragraph_repeated_20x"),
        ("large red paragraph of text\n\nother blue paragraph of text\n\n" * 19, repetition.USUAL, ""),
        ("large red paragraph\nof text\n\n" * 39, repetition.USUAL, ""),
        ("large red paragraph\nof text\n\n" * 40, repetition.USUAL, "paragraph_repeated_40x"),
        ("1. a\n2. b\n\n" + "large red paragraph of text\n\n" * 29, repetition.USUAL, ""),
        ("1. a\n2. b\n\n" + "large red paragraph of text\n\n" * 30, repetition.USUAL, "paragraph_repeated_30x"),
    ],
)
def test_repetition_verdicts(spark, text, thresholds, want):
    out = repetition.block_verdict(spark.createDataFrame([(1, text)], "doc_id long, text string"), *thresholds).first()
    assert out.repetition_reason == want and out.has_repetition == (want != "") == (len(out.repetition_examples) == 1)


def test_ngrams_of_a_short_text(spark):
    assert repetition.ngram_repetitions(spark.createDataFrame([(1, "a b")], "doc_id long, text string")).count() == 0


def test_masks_and_advantages(spark):
    df = spark.createDataFrame([([1.0, 0.0, 2.0], [0.5, 0.5, 0.5]), ([], [])], "r array<double>, v array<double>")
    got = [r.a for r in df.select(ranking.gae(F.col("r"), F.col("v"), 0.9, 0.8).alias("a")).collect()]
    want, last, after = [], 0.0, 0.0
    for r, v in zip([2.0, 0.0, 1.0], [0.5] * 3, strict=True):
        last = r + 0.9 * after - v + 0.9 * 0.8 * last
        after = v
        want.append(last)
    assert got[0] == pytest.approx(want[::-1]) and got[1] == []


def test_next_fit_and_trim(spark):
    df = spark.createDataFrame([("g", i, n) for i, n in enumerate([5, 4, 3, 9, 1, 20, 2])], "g string, i int, n int")
    assert [r.pack for r in sequences.next_fit(df, "g", ["i"], "n", 10).orderBy("i").collect()] == [0, 0, 1, 2, 2, 3, 4]
    assert [r.i for r in sequences.prefix_within(df, "g", ["i"], "n", 12).orderBy("i").collect()] == [0, 1, 2]


def test_loops_in_a_stream_go_on_between_batches(spark, tmp_path):
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double"
    kinds = ["a", "a", "b", "b", "b", "b", "b", "a"]
    rows = [(i, f"2024-01-01 00:00:{i:02d}", 1, k, 1.0) for i, k in enumerate(kinds)]
    for part in (rows[:4], rows[4:]):
        spark.createDataFrame(part, "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {r.event_id: (r.streak, r.level) for r in runs.run_to_end(runs.detect_loops(stream), "loops_test").collect()}
    want, last = {}, 0
    for i, k in enumerate(kinds):
        last = last + 1 if i and kinds[i - 1] == k else 1
        want[i] = (last, "stop" if last >= 5 else "warn" if last >= 3 else "ok")
    assert got == want


def test_registry(spark, tmp_path):
    turns = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "ho"), (2, 0, "user", " ")], "conv_id long, turn long, role string, text string")
    df = conversion.nested(turns)
    out = registry.run_chain(df, "s", [("no_blank_turns", {}), ("drop_trailing_answer", {}), ("rendered", {})], ["conv_id", "text"])
    assert [tuple(r) for r in out.collect()] == [(1, "user: hi", "s")]
    with pytest.raises(ValueError):
        registry.run_chain(df, "s", [("no_such", {})])
    assert registry.config_key({"a": 1, "b": 2}) == registry.config_key({"b": 2, "a": 1})
    built = []
    build = lambda: built.append(1) or df
    for _ in range(2):
        assert registry.cached(build, spark, str(tmp_path), {"x": 1}).count() == 2
    assert built == [1]


def test_files(spark, tmp_path):
    (tmp_path / "t-r1-traj").mkdir()
    (tmp_path / "t-r1-traj" / "a.jsonl").write_text('{"x": 1}\n{"x": 2}\n')
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "a.jsonl").write_text('{"x": 9}\n')
    assert sorted(tuple(r) for r in files.read_runs(spark, str(tmp_path), "t", "x int").collect()) == [(1, "t-r1"), (2, "t-r1")]
    (tmp_path / "bad.jsonl").write_text('{"x": 1}\n{broken\n')
    rows = files.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "x int").cache()
    assert sorted((r.x or 0, r._bad) for r in rows.collect()) == [(0, "{broken"), (1, None)]
    (tmp_path / "res").mkdir()
    (tmp_path / "res" / "a.json").write_text('{"reward": 1.0}')
    (tmp_path / "res" / "b.json").write_text("{no")
    assert files.read_results(spark, str(tmp_path / "res"), "reward double").count() == 1
    table = spark.createDataFrame([(1, "a")], "x int, y string")
    assert files.markdown_table(table) == "| x | y |\n|---|---|\n| 1 | a |"
    assert files.latex_table(table).splitlines()[1] == r"x & y \\"
    files.write_with_statistics(table, str(tmp_path / "out"), "y")
    assert spark.read.json(str(tmp_path / "out/statistics")).first().n == 1


def test_chat_filters_on_odd_turns(spark):
    turns = spark.createDataFrame([(1, 0, "user", None), (1, 1, "assistant", "I am Qwen here."), (2, 0, "user", "a"), (3, 0, "assistant", "b")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: (r.provider, r.keyword, r.blank) for r in chat.flags(turns).collect()}
    assert got == {1: (True, False, True), 2: (False, False, False), 3: (False, False, False)}
    assert {r.conv_id: r.valid for r in chat.alternates(turns).collect()} == {1: True, 2: True, 3: False}
    kept, gone = chat.keep_reject(turns, F.col("text") == "a")
    assert (kept.count(), gone.count()) == (1, 3)


def test_attribution_ladder(spark):
    schema = "started boolean, grader_error string, n_events long, passed boolean, critical long, steps long, env_error boolean, wrapper_error boolean, observation string, repeated boolean"
    base = [True, None, 5, False, 1, 3, False, False, "a long observation", False]

    def case(**change):
        names = [x.split()[0] for x in schema.split(", ")]
        return [change.get(n, v) for n, v in zip(names, base, strict=True)]

    cases = [
        (case(started=False), "environment_never_started"), (case(grader_error="x"), "grader_error"), (case(n_events=0), None), (case(passed=True), "recovered_success"), (case(passed=True, critical=None), "clean_success"),
        (case(critical=None, steps=98), "step_budget_exhausted_no_errors"), (case(critical=None), "premature_stop_or_wrong_solution"), (case(env_error=True), "missing_dependency_or_broken_env"),
        (case(wrapper_error=True), "tool_wrapper_rejected_or_suppressed"), (case(observation=" err "), "error_not_surfaced_to_model"), (case(repeated=True), "ignored_visible_error_repeated_action"),
        (case(), "visible_error_no_effective_recovery"),
    ]
    out = attribution.attribute(spark.createDataFrame([c for c, _ in cases], schema).coalesce(1), 100)
    assert [r.mode for r in out.collect()] == [m for _, m in cases]
    assert {r.destination for r in attribution.gate(out).collect()} >= {"quarantine", "sft_success"}


def test_similarity(spark):
    docs = spark.createDataFrame([(1, "cats like fish"), (2, "dogs like bones"), (3, None), (4, "")], "id long, text string")
    counts = retrieval.word_counts(docs, "id", "text")
    w = retrieval.weights(counts, retrieval.idf(counts, "id", 4), "id")
    got = {(r.q, r.id): r.sim for r in retrieval.retrieve(w.withColumnRenamed("id", "q"), w, "q", "id", 0.0, 5).collect()}
    assert set(got) == set(itertools.product((1, 2), repeat=2)) and got[(1, 1)] == pytest.approx(1.0) and 0 < got[(1, 2)] < 0.5
