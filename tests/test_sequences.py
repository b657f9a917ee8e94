"""Packs and prefixes over blocks against plain folds; dialogue, window and answer rules against stated results; dispatch of constraints."""

from __future__ import annotations

import inspect
import json
import random

import pytest
from pyspark.sql import functions as F

from tessella.functions import constraints, verifiers
from tessella.operators import conversion, ranking, retrieval, sequences


def plain_packs(sizes, cap):
    out, pack, held, filled = [], 0, 0, False
    for n in sizes:
        if filled and held and held + n > cap:
            pack, held = pack + 1, 0
        held, filled = held + n, True
        out.append(pack)
    return out


@pytest.mark.parametrize("seed,block_rows", [(1, 3), (2, 7), (3, 64)])
def test_next_fit_equals_the_fold(spark, seed, block_rows):
    rng = random.Random(seed)
    groups = {g: [rng.choice([0, 0, rng.randrange(1, 12), rng.randrange(1, 40)]) for _ in range(rng.randrange(1, 300))] for g in ["a", "b", None, "c"]}
    rows = [(g, i, n) for g, sizes in groups.items() for i, n in enumerate(sizes)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, i long, n long")
    got = {(r.g, r.i): r.pack for r in sequences.next_fit(df, "g", ["i"], "n", 20, block_rows=block_rows).collect()}
    assert got == {(g, i): p for g, sizes in groups.items() for i, p in enumerate(plain_packs(sizes, 20))}
    fewer = {(r.g, r.i): r.pack for r in sequences.next_fit(df, "g", ["i"], "n", 20, min_packs=30, block_rows=block_rows).collect()}
    caps = {g: min(sum(s) // 30, 20) if sum(s) else 20 for g, s in groups.items()}
    assert fewer == {(g, i): p for g, sizes in groups.items() for i, p in enumerate(plain_packs(sizes, caps[g]))}
    within = {(r.g, r.i) for r in sequences.prefix_within(df, "g", ["i"], "n", 100, block_rows=block_rows).collect()}
    assert within == {(g, i) for g, sizes in groups.items() for i in range(len(sizes)) if i == 0 or sum(sizes[: i + 1]) <= 100}


def test_one_large_group_spreads_over_tasks(spark):
    df = spark.range(200_000).select(F.lit("one").alias("g"), F.col("id").alias("i"), (F.col("id") % 97 + 1).alias("n"))
    rows = sequences.in_blocks(df, "g", ["i"], 4096)
    used = [r["count"] for r in rows.groupBy("block__").count().collect()]
    assert max(used) <= 4096 and len({r.p for r in rows.select((F.col("pos__") / (1 << 40)).cast("int").alias("p")).distinct().collect()}) > 1
    got = [r.pack for r in sequences.next_fit(df, "g", ["i"], "n", 1000, block_rows=4096).orderBy("i").collect()]
    assert got == plain_packs([i % 97 + 1 for i in range(200_000)], 1000)


def test_no_rows_and_null_sizes(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, 5), ("a", 3, 6)], "g string, i long, n long")
    assert [r.pack for r in sequences.next_fit(df, "g", ["i"], "n", 10).orderBy("i").collect()] == [0, 0, 1]
    assert sequences.next_fit(df.limit(0), "g", ["i"], "n", 10).collect() == []
    assert sequences.prefix_within(df.limit(0), "g", ["i"], "n", 10).collect() == []


@pytest.mark.parametrize(
    "sizes,budget,want",
    [
        ([10, 10, 10, 10, 10], 100, [(0, 0), (1, 0), (2, 0), (3, 0)]),  # an odd last turn goes
        ([10, 10, 30, 30, 5, 5], 90, [(0, 0), (1, 0), (2, 2), (3, 2)]),  # each next pair would pass the budget; what the last one begins is never closed
        ([10, 10, 100, 100, 5, 5], 90, [(0, 0), (1, 0)]),  # a pair that is too long is left out, though its size counts on
        ([10, 10, 10, 10], 64, [(0, 0), (1, 0), (2, 0), (3, 0)]),  # six more for each turn: just within
        ([10, 10, 10, 10], 63, [(0, 0), (1, 0)]),
        ([10], 90, []),
    ],
)
def test_conversations_split_before_the_budget(spark, sizes, budget, want):
    df = spark.createDataFrame([(1, i, n) for i, n in enumerate(sizes)], "conv_id long, turn long, n long")
    assert sorted((r.turn, r.piece) for r in ranking.split_conversations(df, "n", budget).collect()) == want


def test_windows(spark):
    df = spark.createDataFrame([(1, 0, "system"), (1, 1, "user"), (1, 2, "assistant"), (1, 3, "system"), (1, 4, "user"), (2, 0, "user"), (2, 1, "assistant"), (3, 0, "user")], "conv_id long, turn long, role string")
    got = {(r.conv_id, r.turn): r.part for r in ranking.windows_of(df).collect()}
    assert got == {(1, 0): "system", (1, 1): "history", (1, 2): "history", (1, 3): "history", (1, 4): "active", (2, 0): "history", (2, 1): "history", (3, 0): "active"}


@pytest.mark.parametrize(
    "text,label,want",
    [
        ("<finish>a</finish> or <finish>b c</finish>", "b c", 1.0),
        ("<finish></finish>", "b", 0.0),
        ("<finish>x", "b", 0.1),
        ("b</finish> more", "b", 1.0),
        ("b", "b", 0.0),
        ("<finish>paris</finish>", '["rome", "Paris"]', 1.0),
        ("<finish>paris</finish>", " Paris ", 1.0),
    ],
)
def test_finish_part(spark, text, label, want):
    df = spark.createDataFrame([(text, label)], "t string, l string")
    assert df.select(verifiers.finish_f1(F.col("t"), F.col("l"))).first()[0] == pytest.approx(want)


@pytest.mark.parametrize(
    "text,want",
    [
        ("\n\nHuman: hi\n\nAssistant: yo\x1e", [("user", "hi"), ("assistant", "yo\x1e")]),
        ("\n\nHuman: a\n\nHuman: b\n\nAssistant: c", [("user", "a\n\nHuman: b"), ("assistant", "c")]),
        ("\n\nHuman: a\n\nAssistant: b\n\nHuman: c", [("user", "a"), ("assistant", "b\n\nHuman: c")]),
        ("no markers", []),
        ("\n\nHuman: alone", []),
    ],
)
def test_markers_pair_by_number(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(conversion.split_dialogue(F.col("t")).alias("m")).first().m
    assert [(m.role, m.content) for m in got] == want


def test_capabilities_with_packages(spark):
    text = "cd /x && ls | sort\npip install numpy, Pandas==1.0 -U\napt-get install -y gcc make; python3 a.py"
    rows = retrieval.capability_tokens(spark.createDataFrame([(1, text)], "k long, t string"), "k", "t").collect()
    assert {(r.token, r.tf) for r in rows} == {("cmd:sort", 1), ("cmd:pip", 1), ("cmd:apt-get", 1), ("cmd:python3", 1), ("py:numpy", 1), ("py:pandas==1.0", 1), ("apt:gcc", 1), ("apt:make", 1), ("ext:py", 1)}


TEXTS = ["The cat sat. It ran!\n\n* one\n* two\n***\nThe end", "ALL CAPS, <<Title>> [x]", "the the the", "", '"quoted the"', "a *b* c\nthe dog ******\nother"]
ARGUMENTS = {"relation": "at least", "let_relation": "less than", "capital_relation": "at least", "language": "en", "keywords": ["the"], "options": ["cat", "x"], "key_sentences": ["It ran!"], "forbidden_words": ["dog"], "starter": "The", "section_spliter": "SECTION", "postscript_marker": "P.S.", "keyword": "the", "keyword1": "the", "keyword2": "cat", "first_word": "The", "last_word": "end", "end_phrase": "End", "letter": "t", "prompt_to_repeat": "the the the", "phrase": "a b c", "original_paragraph": "The cat ran", "original_message": "a *x* c"}


def test_arguments_from_columns_equal_literals(spark):
    cases = []
    for name, f in constraints.INSTRUCTIONS.items():
        literal = {a: ARGUMENTS.get(a, 1) for a in list(inspect.signature(f).parameters)[1:] if a != "detected"}
        cases.append((name, literal, "detected" in inspect.signature(f).parameters))
    assert len(cases) >= 57
    df = spark.createDataFrame([(i, t, [n for n, _, _ in cases], [json.dumps(a) for _, a, _ in cases]) for i, t in enumerate(TEXTS)], "i long, t string, names array<string>, arguments array<string>")
    got = df.select("i", constraints.followed(F.col("t"), F.col("names"), F.col("arguments"), F.lit("en")).alias("m")).collect()
    direct = df.select("i", F.array(*(constraints.check(n, F.col("t"), **a, **({"detected": F.lit("en")} if d else {})) for n, a, d in cases)).alias("m")).collect()
    plain = {r.i: r.m for r in direct}
    for r in got:
        assert [x.strict for x in r.m] == [bool(TEXTS[r.i].strip()) and x for x in plain[r.i]]
        assert all(x.loose for x in r.m if x.strict)


def test_loose_readings_and_scores(spark):
    rows = [("Sure, here it is\nno dots here\nBye.", ["punctuation:punctuation_dot", "keywords:word_once"], [None, '{"keyword": "dots"}']), (None, ["punctuation:punctuation_dot"], [None]), ("x", [], [])]
    df = spark.createDataFrame(rows, "t string, n array<string>, a array<string>")
    got = [tuple(r) for r in constraints.instruction_scores(df, "t", "n", "a", F.lit("en")).select("score", "score_loose", "all_met", "all_met_loose").collect()]
    assert got == [(0.5, 1.0, False, True), (0.0, 0.0, False, False), (0.0, 0.0, False, False)]
