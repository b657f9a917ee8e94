"""Queries over whole tables against brute force."""

from __future__ import annotations

from collections import Counter, defaultdict

from tessella import queries as Q
from tessella.operators import chat, ranking
from tessella.queries.aggregates import trials

Q.load()


def test_canaries_of_any_length(spark):
    canaries = ["a b c d e f g h", "a b c d e f g x", "c d e f g h i j k", "tail", "b c", "b c", None, "é  f"]
    texts = [(1, "za b c d e f g hz"), (2, "c d e f g h i j kk tail"), (2, "a b"), (2, "a b c"), (2, "a b c"), (3, None), (4, ""), (None, "curtail"), (5, "é  f")]
    got = chat.leaked(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([(c,) for c in canaries], "canary string"))
    want = [(d, n) for d, t in texts if (n := sum(c is not None and c in (t or "") for c in canaries))]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_canary_query_sees_all_items(spark, sf):
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = {(r.doc_id, n) for r in docs if (n := sum(t in r.text for t in items))}
    assert {tuple(r) for r in Q.QUERIES["f36_canary_guard"](spark, sf).collect()} == want


def test_selection_over_the_whole_table(spark, sf):
    tasks = defaultdict(list)
    for r in spark.read.parquet(f"{sf}/lineitem.parquet").collect():
        tasks[r.l_partkey].append((-r.l_quantity, r.l_orderkey * 10 + r.l_linenumber, r.l_suppkey % 12))
    used, want = Counter(), set()
    for task in sorted(tasks):
        took = 0
        for _, cand, env in sorted(tasks[task]):
            if took < 6 and used[env] < 10:
                used[env] += 1
                took += 1
                want.add((task, env, cand))
    assert max(t for t, _, _ in want) >= 1 and {tuple(r) for r in Q.QUERIES["r05_capped_selection"](spark, sf).select("task", "env", "cand").collect()} == want


def test_selection_takes_any_part(spark, tmp_path):
    rows = [(part, part % 3, part, 1, float(part)) for part in (39, 40, 41, 700)]
    spark.createDataFrame(rows, "l_partkey long, l_suppkey long, l_orderkey long, l_linenumber int, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert {r.task for r in Q.QUERIES["r05_capped_selection"](spark, str(tmp_path)).collect()} == {39, 40, 41, 700}


def test_reply_tree_over_the_whole_table(spark, sf):
    children = defaultdict(list)
    for r in spark.read.parquet(f"{sf}/events.parquet").collect():
        children[r.event_id // 3 if r.event_id > 0 else None].append((-r.value, r.event_id))
    want, open_ = set(), [(i, 0, str(i)) for _, i in children[None]]
    while open_:
        i, depth, trail = open_.pop()
        best = sorted(children[i])[:2]
        open_ += [(c, depth + 1, f"{trail}>{c}") for _, c in best]
        if not best:
            want.add((i, depth, trail))
    got = {tuple(r) for r in Q.QUERIES["r17_reply_tree"](spark, sf).select("id", "depth", "trail").collect()}
    assert max(i for i, _, _ in got) >= 600 and got == want


def test_complementary_runs_of_all_tasks(spark, sf):
    solved = defaultdict(set)
    for r in trials(spark, sf).filter("reward > 0").select("run", "task_id").collect():
        solved[r.run].add(r.task_id)
    want = {(x, y) for x, p in solved.items() for y, q in solved.items() if x < y and p - q and q - p}
    assert {tuple(r) for r in Q.QUERIES["w29_complementary"](spark, sf).collect()} == want


def test_complementary_by_items(spark):
    rows = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (2, 3), (2, 3), (3, 2), (4, 9), (5, 1), (5, 2)], "run int, task int")
    assert {tuple(r) for r in ranking.complementary_by_items(rows, "run", "task").collect()} == {(1, 2), (1, 4), (2, 4), (2, 5), (3, 4), (4, 5)}
