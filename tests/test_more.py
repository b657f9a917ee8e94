"""LaTeX answers, named constraints, keywords, capped selection and message tracks."""

from __future__ import annotations

import random
from collections import Counter
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tessella.functions import constraints, latex
from tessella.functions import verifiers as V
from tessella.operators import attribution, ranking, retrieval
from tessella.plans import tables
from tessella.sources import files
from tessella.streaming import runs


def values(spark, rows, column):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, text string, label string")
    return [r.v for r in df.select("i", column.alias("v")).orderBy("i").collect()]


def test_math_answers(spark):
    rows = [
        (r"so \boxed{\frac{1}{2}}", r"\frac12"), (r"\boxed{1} and \boxed{\sqrt{3}}", r"\sqrt3"), ("Final Answer: The final answer is $12$. I hope it is correct.", "12"), ("first $1$ then $x = 4$", "4"),
        ("1,000", "1000"), ("5 dollars", "5"), (r"\boxed{2}", "3"), ("", "1"), (None, "1"), ("100 meters", "100"),
    ]
    assert values(spark, rows, latex.math_match(F.col("text"), F.col("label"))) == [1, 1, 1, 1, 1, 1, 0, 0, 0, 1]
    assert values(spark, rows, latex.strict_math_match(F.col("text"), F.col("label")))[:3] == [0, 0, 1]


@pytest.mark.parametrize(
    "name, arguments, good, bad",
    [
        ("length_constraints:number_sentences", {"num_sentences": 2, "relation": "at least"}, "One. Two!", "One."),
        ("length_constraints:number_paragraphs", {"num_paragraphs": 2}, "a *** b", "a *** *** b"),
        ("detectable_content:postscript", {"postscript_marker": "P.P.S"}, "x\nP. P.S. more", "P.S. no"),
        ("detectable_format:number_highlighted_sections", {"num_highlights": 2}, "*a* and **b**", "** **"),
        ("detectable_format:multiple_sections", {"section_spliter": "Section", "num_sections": 2}, "Section 1 a Section 2 b", "Section 1"),
        ("length_constraints:nth_paragraph_first_word", {"num_paragraphs": 2, "nth_paragraph": 2, "first_word": "so"}, "a\n\n\"So, it", "so\n\nit"),
        ("detectable_format:json_format", {}, '```json\n{"a": 1}\n```', "```json\nno\n```"),
        ("keywords:key_sentences", {"key_sentences": ["I am.", "No."], "num_sentences": 1}, "I am. Yes.", "Yes."),
        ("detectable_content:rephrase_paragraph", {"original_paragraph": "a b b c", "low": 2, "high": 3}, "b b x a", "x"),
        ("detectable_content:rephrase", {"original_message": "I *like* it"}, "I *love* it", "You *love* it"),
        ("combination:two_responses", {}, "a ****** b", "a ****** ****** b"),
        ("combination:repeat_prompt", {"prompt_to_repeat": "Say this"}, "say this: no", "no"),
        ("copy:copy_span_idx", {"prompt_to_repeat": "abcdef", "n_start": 1, "n_end": 3}, " BC ", "ab"),
        ("copy:copying_multiple", {"prompt_to_repeat": "x y", "N": 2}, "x y ****** X Y", "x y"),
        ("copy:repeat_phrase", {"phrase": "we go home now", "small_n": 2}, "we run home now, we go out now", "we go home now"),
        ("startend:end_checker", {"end_phrase": "The end"}, 'x "the END"', "the end."),
        ("detectable_format:title", {}, "<<a b>>", "<< >>"),
        ("change_case:english_capital", {"detected": F.lit}, "AB C", "ab"),
        ("startend:quotation", {}, ' "a" ', '"'),
        ("detectable_format:sentence_hyphens", {}, "One here.-Two there.", "One here. - Two."),
        ("detectable_format:bigram_wrapping", {}, "<<I am>> <<at home>>", "<<I am at home>>"),
        ("first_word:first_word_sent", {"first_word": "we"}, "We go. we stay.", "We go. They stay."),
        ("last_word:last_word_sent", {"last_word": "now"}, "Go now. Stay NOW!", "Go now. Stay."),
        ("count:counting_composition", {"n_sent": 1, "n_words": 2}, "a b. *** c d. *** e f.", "a b. *** c d."),
        ("keywords:word_count_different_numbers", {"keyword1": "cat", "keyword2": "dog"}, "cat dog Dog", "cat dog"),
        ("keywords:keyword_specific_position", {"keyword": "here", "n": 2, "m": 1}, "No. here it is.", "here it is."),
        ("keywords:start_end", {}, "Go and go", "go and go."),
        ("keywords:no_adjacent_consecutive", {}, "a c b", "a b"),
    ],
)
def test_named_constraint(spark, name, arguments, good, bad):
    arguments = {k: F.lit("en") if v is F.lit else v for k, v in arguments.items()}
    assert values(spark, [(good, ""), (bad, ""), (None, "")], constraints.check(name, F.col("text"), **arguments)) == [True, False, False]


def test_unknown_constraint():
    with pytest.raises(ValueError):
        constraints.check("no:such", None)
    with pytest.raises(ValueError):
        constraints.related(None, "more than", 1)


def test_keywords(spark):
    rows = [("The ＡＢＣ of x and def", ""), ("漢字 名", ""), ("", ""), (None, "")]
    assert values(spark, rows, retrieval.keywords(F.col("text"))) == [["abc", "def"], ["名", "漢字"], [], None]


@pytest.mark.parametrize("seed", [1, 2])
def test_capped_selection_is_the_loop(spark, tmp_path, seed):
    r = random.Random(seed)
    rows = [(t, t, r.random(), r.randrange(6), t * 100 + i) for t in range(8) for i in range(12)]
    need, used, want = {t: r.choice([0, 2, 5]) for t in range(8)}, Counter(), set()
    for t in range(8):
        took = 0
        for _, _, _, env, cand in sorted((x for x in rows if x[0] == t), key=lambda x: (x[2], x[4])):
            if took < need[t] and used[env] < 4:
                used[env] += 1
                took += 1
                want.add(cand)
    n = iter(range(1000))

    def keep(df):
        path = str(tmp_path / str(next(n)))
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    got = retrieval.capped_selection(spark.createDataFrame(rows, "task int, task_order int, rank double, env int, cand int"), spark.createDataFrame(list(need.items()), "task int, need int"), keep, 4)
    assert {x.cand for x in got.collect()} == want


def test_message_tracks(spark):
    rows = [
        ("s", 0, "raw_user", 0, None, "old"), ("s", 1, "context_snapshot", 0, None, None), ("s", 2, "raw_user", 0, None, "hi"), ("s", 3, "raw_assistant", 1, None, "a"), ("s", 4, "assistant", 1, None, "A"),
        ("s", 5, "raw_tool", 1, "c1", "t"), ("s", 6, "raw_tool", 1, "c2", "u"), ("s", 7, "tool", 1, "c2", "U"), ("s", 8, "raw_assistant", 2, None, "late"),
    ]
    df = spark.createDataFrame(rows, "session string, line_no long, type string, step int, tool_call_id string, content string")
    got = [(r.line_no, r.raw, r.effective) for r in files.message_tracks(df, "session", 2).orderBy("line_no").collect()]
    assert got == [(2, "hi", "hi"), (3, "a", "A"), (5, "t", "t"), (6, "u", "U")]


def test_complementary_group():
    from tessella.operators.attribution import complementary_group

    rows = [("a", 3.0, frozenset("xy")), ("b", 2.0, frozenset("x")), ("c", 1.0, frozenset("yz")), ("d", 1.0, frozenset("w"))]
    assert complementary_group(rows, 3) == ["a", "c", "d"] and complementary_group(rows, 1) == ["a"] and complementary_group([], 2) == []


@pytest.mark.parametrize(
    "score, text, label, want",
    [
        (V.number_match, "it is -5", "-5", 1.0),
        (V.number_match, "it is -5", "5", 0.0),
        (V.number_match, "about 1,234.5", "1234.5", 1.0),
        (V.number_match, "none", "NONE", 1.0),
        (V.answer_match, "so The answer is: x", "X", 1.0),
        (V.answer_match, "so The answer is x", "x", 0.0),
        (V.answer_match, "x.", "x", 1.0),
        (V.tagged_match, "paris", "paris", 0.0),
        (V.tagged_match, "<answer>Paris</answer>", "paris", 1.0),
        (V.tagged_match, "<answer>a</answer><answer>Paris", "paris", 1.0),
        (V.tagged_match, "<answer>Paris", "paris", 0.0),
        (V.puzzle_match, "<think>…</think>Paris", "paris", 1.0),
        (V.puzzle_match, "The answer is 42", "answer is 42", 1.0),
    ],
)
def test_answer_scores(spark, score, text, label, want):
    assert spark.createDataFrame([(text, label)], "t string, y string").select(score(F.col("t"), F.col("y")).alias("v")).first().v == want


def test_length_scores(spark):
    rows = spark.createDataFrame([(0,), (100,), (150,), (400,)], "n int")
    got = rows.select(V.max_length(F.col("n"), F.lit(100), 200).alias("m"), V.up_to_max_length(F.col("n"), F.lit(100), 200).alias("u")).collect()
    assert [(r.m, r.u) for r in got] == [(0.5, 1.0), (1.0, 1.0), (0.75, 0.75), (-0.5, -0.5)]


def test_labels_of_a_finish_tag(spark):
    rows = spark.createDataFrame([("<FINISH>Paris</finish>",), ("<finish> </finish>",), ("Paris",)], "t string")
    assert [r.v for r in rows.select(V.any_label_match(F.col("t"), F.array(F.lit("rome"), F.lit("paris"))).alias("v")).collect()] == [1.0, 0.0, 0.0]


def test_gate_skips_accepts_pivots_and_rejects(spark):
    schema = "c int, round int, config string, score double, unique map<int,bigint>"
    rows = [(0, 0, "a", None, None), (0, 1, "a", 0.5, {}), (0, 2, "b", 0.49, {}), (0, 3, "a", 0.3, {1: 0}), (0, 4, "c", 0.3, {1: 2}), (0, 5, "d", 0.41, {1: 0}), (0, 6, "e", 0.2, None)]
    gate = lambda tolerance: [(r.round, r.verdict, r.best_round) for r in ranking.regression_gate(spark.createDataFrame(rows, schema), "c", tolerance).orderBy("round").collect()]
    assert gate(0.02) == [(0, "skip", None), (1, "accept", 1), (2, "accept", 1), (3, "reject", 1), (4, "pivot", 1), (5, "accept", 5), (6, "reject", 5)]
    assert {v for _, v, _ in gate(-1.0)} == {"skip"}


def test_parents(spark):
    solved = spark.createDataFrame([("a", t) for t in range(10)] + [("b", t) for t in range(9)] + [("c", t) for t in (0, 20, 21)], "run string, task int")
    nodes = spark.createDataFrame([("a", 0.5, 2, 0), ("b", 0.5, 1, 1), ("c", 0.2, 1, 2), ("d", 0.1, 1, 2)], "run string, mean double, scores int, round int")
    novelty = {r.run: r.novelty for r in ranking.set_novelty(solved, nodes, "run", "task", 1).collect()}
    assert novelty["d"] == 0.0 and novelty["a"] == 0.0 and novelty["c"] == 0.0
    chosen = lambda **more: [r.run for r in ranking.select_parents(solved, nodes, "run", "task", **more).orderBy("place").collect()]
    assert chosen(turn=3)[0] == "c" and set(chosen(turn=1)) == {"a", "b", "c"} and len(chosen(turn=1, most=2)) == 2
    assert [r.novelty for r in ranking.set_novelty(solved, nodes.limit(1), "run", "task").collect()] == [1.0]


def test_shared_folder_without_the_setting(spark, monkeypatch):
    context = SimpleNamespace(getCheckpointDir=lambda: None, applicationId="app-1", master="local[4]")
    bare = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=context)
    first = tables.shared_base(bare)
    assert first.startswith("file:///") and tables.shared_base(bare) == first
    context.applicationId, context.master = "app-2", "spark://somewhere:7077"
    with pytest.raises(ValueError):
        tables.shared_base(bare)
    context.getCheckpointDir = lambda: "hdfs://x/y/"
    assert tables.shared_base(bare) == "hdfs://x/y"


def test_tables_are_not_cut_off(spark):
    assert files.markdown_table(spark.range(3)).count("\n") == 4
    with pytest.raises(ValueError):
        files.markdown_table(spark.range(3), 2)


def test_usability_and_logs(spark):
    rows = spark.createDataFrame([("d", "f", "From: x\n%post"), (" ", "f", "x"), ("d", None, "x"), ("d", "f", "\n"), ("d", "f", "From: x")], "d string, f string, c string")
    assert [r.u for r in rows.select(attribution.usability(F.col("d"), F.col("f"), F.col("c")).alias("u")).collect()] == [None, "no_description", "no_test_final_state", "no_container_def", "bad_container_def"]
    lines = ['{"type":"raw_assistant","message":{"tool_calls":[{"name":"sh"},{"function":{"name":"py"}},{}]}}', '{"type":"raw_user"}', "no json", '{"type":"raw_assistant","message":{}}']
    got = files.tool_calls(spark.createDataFrame([(1, x) for x in lines], "k int, line string"), "k", "line").collect()
    assert {(r.tool, r.calls) for r in got} == {("sh", 1), ("py", 1), ("unknown", 1)}
    results = [("t__1", '{"verifier_result":{"rewards":{"reward":1}}}'), ("t__2", '{"verifier_result":null}'), ("_x", "{}"), ("u__1", '{"task_name":"v","verifier_result":{"rewards":{"reward":0.5}}}'), ("w__1", "broken")]
    assert {(r.task, r.passed) for r in files.pass_map(spark.createDataFrame(results, "f string, r string"), "f", "r").collect()} == {("t", False), ("v", True)}


def test_stream_tables(spark, tmp_path):
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none")
    assert runs.run_to_end(runs.counters(spark.readStream.schema(schema).parquet(f"{tmp_path}/none")), "none", "complete").count() == 0
