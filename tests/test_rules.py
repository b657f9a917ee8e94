"""Trimming, screens, search and reply paths on hand-made rows, against plain loops or stated results."""

from __future__ import annotations

import hashlib
import random

from pyspark.sql import functions as F

from tessella.operators import conversion, outcomes, ranking, retrieval, sampling
from tessella.sources import files


def kept_by_loop(messages, budget):
    """Drops the oldest message but the first, an assistant's results with it, until the rest fits."""
    left = list(messages)
    while len(left) > 1 and sum(m["n"] for m in left) > budget:
        gone = left.pop(1)
        if gone["role"] == "assistant" and gone["calls"]:
            while len(left) > 1 and left[1]["role"] == "tool" and left[1]["call_id"] in gone["calls"]:
                left.pop(1)
    return [m["pos"] for m in left]


def test_trim_with_tools(spark):
    rng = random.Random(3)
    rows, wanted = [], []
    for conv in range(60):
        messages = []
        for pos in range(rng.randrange(1, 14)):
            role = rng.choice(["user", "assistant", "assistant", "tool", "tool", "tool"])
            calls = rng.choice([None, [], ["a"], ["a", "b"]]) if role == "assistant" else None
            messages.append({"conv": conv, "pos": pos, "role": role, "calls": calls, "call_id": rng.choice(["a", "b", "c", None]) if role == "tool" else None, "n": rng.randrange(1, 9)})
        rows += messages
        wanted += [(conv, pos) for pos in kept_by_loop(messages, 20)]
    turns = spark.createDataFrame(rows, "conv long, pos long, role string, calls array<string>, call_id string, n long")
    assert sorted(tuple(r) for r in ranking.trim_with_tools(turns, "conv", ["pos"], "n", 20).select("conv", "pos").collect()) == wanted
    assert sorted(tuple(r) for r in ranking.trim_at_ratio(turns, "conv", ["pos"], "n", 25).select("conv", "pos").collect()) == wanted
    assert ranking.trim_with_tools(turns.limit(0), "conv", ["pos"], "n", 20).count() == 0


def test_mini_eval(spark):
    probes = spark.createDataFrame([("a", True), ("b", True), ("c", False), ("d", False)], "task string, parent boolean")
    solved = {1: "ab", 2: "c", 3: "acd", 4: "bcd", 6: ""}
    results = spark.createDataFrame([(i, t, t in s) for i, s in solved.items() for t in "abcdz"], "idx long, task string, solved boolean")
    out = ranking.mini_eval(spark.range(1, 7).toDF("idx"), results, probes, 1, 3).collect()
    assert {r["idx"]: (r["gained"], r["regressed"], r["score"], r["outcome"]) for r in out} == {
        1: (0, 0, 0.5, "kept"), 2: (1, 2, 0.25, "regressed"), 3: (2, 1, 0.75, "kept"), 4: (2, 1, 0.75, "kept"), 5: (None, None, None, "cut"), 6: (0, 2, 0.0, "regressed")
    }
    lone = ranking.mini_eval(spark.range(5, 6).toDF("idx"), results, probes, 1, 3).collect()
    assert lone[0]["outcome"] == "kept"


def test_structural_screen(spark):
    rows = spark.createDataFrame([(1, "x"), (2, ""), (3, "x"), (4, "bad"), (5, "bad"), (6, None), (7, "y")], "idx long, change string")
    rejected = spark.createDataFrame([("bad",), ("bad",)], "signature string")
    out = ranking.structural_screen(rows, rejected, "idx", F.col("change"), F.col("change") == "").collect()
    assert {r["idx"]: r["outcome"] for r in out} == {1: "kept", 2: "empty", 3: "duplicate", 4: "rejected", 5: "rejected", 6: "empty", 7: "kept"}


def test_relevant_text(spark):
    long = "\n".join(f"l{i}" for i in range(25))
    docs = spark.createDataFrame([(1, "a\nb\nKey x\nc\nd\ne\nf\nkey\n"), (2, long), (3, "a\nb"), (4, ""), (5, None), (6, "key")], "id long, text string")
    out = {r["id"]: r["shown"] for r in retrieval.relevant_text(docs, "id", "text", ["KEY"], 1).collect()}
    assert out == {1: "b\nKey x\nc\n...\nf\nkey\n", 2: "\n".join(f"l{i}" for i in range(20)) + "\n...", 3: "a\nb", 4: "", 5: None, 6: "key"}


def test_search_rank(spark):
    memories = spark.createDataFrame([(1, "active", 4.0, "2024-01-01"), (2, "archived", 9.0, "2024-01-01"), (3, "active", 8.0, None), (4, "active", 1.0, "2023-12-02"), (5, "active", 5.0, "2024-01-01")], "id long, status string, importance double, day string")
    memories = memories.select("id", "status", "importance", F.col("day").cast("timestamp").alias("accessed"))
    hits = spark.createDataFrame([(1, 2.0), (2, 3.0), (3, 2.0)], "id long, match double")
    fields = spark.createDataFrame([(1, "Tom"), (4, "tom, ANN"), (5, "ann"), (6, None)], "id long, words string")
    named = retrieval.entity_hits(fields, "id", "words", retrieval.entity_names("did Tom and Ann or Tom meet Al?"), 3)
    assert sorted(tuple(r) for r in named.collect()) == [(1, 1.0), (4, 2.0), (5, 1.0)]
    out = retrieval.search_rank(hits, named, memories, "id", F.lit("2024-01-01").cast("timestamp"), 30).collect()
    assert [(r["id"], r["match"], round(r["decay"], 6), r["place"]) for r in sorted(out, key=lambda r: r["place"])] == [(3, 2.0, 8.0, 1), (1, 2.0, 4.0, 2), (5, 0.5, 5.0, 3), (4, 0.5, 0.5, 4)]


def test_reply_paths(spark):
    rows = [(1, None, "prompter", None, False), (2, 1, "assistant", 0.5, None), (3, 1, "assistant", 0.9, False), (4, 1, "assistant", 0.7, False), (5, 3, "prompter", 0.1, False), (6, 5, "assistant", 0.1, False),
            (7, 4, "prompter", 0.1, True), (8, 7, "assistant", 0.1, False), (9, None, "prompter", None, True), (10, 9, "assistant", 1.0, False), (11, None, "prompter", None, False)]
    messages = spark.createDataFrame(rows, "id long, parent long, role string, quality double, deleted boolean")
    trails = lambda k: sorted(r["trail"] for r in conversion.reply_paths(messages, "paths_test__", k).collect())
    assert trails(None) == ["1>2", "1>3>5>6"]  # 4 has a reply, though a deleted one
    assert trails(2) == ["1>3>5>6"]


def test_reward_breakdown(spark):
    rows = spark.createDataFrame([(1, "a", 1.0, 2.0), (1, "a", 0.5, 2.0), (1, "b", 1.0, 1.0), (1, "z", None, 1.0), (2, "z", None, 1.0)], "id long, v string, s double, w double")
    out = outcomes.reward_breakdown(rows, "id", "v", F.col("s"), F.col("w"), 10.0).collect()
    assert {r["id"]: (r["reward"], r["parts"]) for r in out} == {1: (40.0, {"a": 30.0, "b": 10.0}), 2: (0.0, {})}


def test_log_panels(spark):
    text = "x: 1\n\x1b[1mMetrics\x1b[0m\n│ training_step: 3 │ a/b: -2.5e-1 │\n│ a/b: 7 │Metrics│ a/b: 1 │Metrics│training_step : 4│"
    logs = spark.createDataFrame([(1, text), (2, "no panel"), (3, None), (4, "")], "id long, text string")
    out = files.log_panels(logs, "id", "text", ["training_step", "a/b"]).collect()
    assert sorted((r["id"], r["panel"], r["metrics"]["training_step"], r["metrics"]["a/b"]) for r in out) == [(1, 0, 3.0, -0.25), (1, 2, 4.0, None)]


def test_search_files(spark):
    texts = {"a/x.md": "one\nTwo foo\nthree\nfour\nfive\nfoo\n", "a/y.md": "none", "b/z.md": "foo\r\nfoo", "b/z.txt": "foo", "c.md": "", "d.md": None}
    docs = spark.createDataFrame(list(texts.items()), "path string, text string")
    found = lambda *a, **k: [r["entry"] for r in retrieval.search_files(docs, "path", "text", *a, **k).orderBy("path", "at").collect()]
    assert found("FOO", ignore_case=True, name_like="*.md") == ["a/x.md", "b/z.md"]
    assert found("foo", "count") == ["a/x.md: 2", "b/z.md: 2", "b/z.txt: 1"]
    assert found("foo", "files", offset=1, head=1) == ["b/z.md"]
    assert found("^foo", "content", before=1, head=None) == ["a/x.md:5:five", "a/x.md:6:foo", "b/z.md:1:foo", "b/z.md:2:foo", "b/z.txt:1:foo"]
    assert found("foo", "content", after=1, name_like="x*") == ["a/x.md:2:Two foo", "a/x.md:3:three", "--", "a/x.md:6:foo"]
    assert found("foo$", "content", numbers=False, name_like="z.*") == ["b/z.md:foo", "b/z.md:foo", "b/z.txt:foo"]
    assert found("o.three|f[a-z]+e\\nf", "content", multiline=True) == ["a/x.md:2:o", "a/x.md:5:five"]
    assert found("foo", "count", multiline=True) == ["a/x.md: 2", "b/z.md: 2", "b/z.txt: 1"]


def pairs_by_loop(messages, critical, most_pairs, most_chars):
    out = []
    for i, m in enumerate(messages):
        if critical is None or i <= critical or m["role"] != "assistant" or len((m["text"] or "").strip()) < 4:
            continue
        for start in (0, max(0, critical - 4)):
            chars = sum(x["n"] for x in messages[start : i + 1])
            if chars <= most_chars:
                out.append((i, start, chars))
                break
        if len(out) == most_pairs:
            break
    return out


def test_recovery_pairs(spark):
    rng = random.Random(5)
    rows, wanted = [], []
    for conv in range(50):
        critical = rng.choice([None, 0, 3, 6])
        messages = [{"conv": conv, "turn": i, "role": rng.choice(["user", "assistant"]), "text": rng.choice(["long enough", " ab ", None]), "n": rng.randrange(1, 20), "critical": critical} for i in range(rng.randrange(1, 14))]
        rows += messages
        wanted += [(conv, *p) for p in pairs_by_loop(messages, critical, 3, 60)]
    turns = spark.createDataFrame(rows, "conv long, turn long, role string, text string, n long, critical long")
    assert sorted(tuple(r) for r in ranking.recovery_pairs(turns, "conv", ["turn"], "n", F.col("text"), "critical", 3, 60).collect()) == wanted
    assert wanted


def test_long_form_messages(spark):
    rows = spark.createDataFrame([(1, [("user", "q"), ("assistant", "a")]), (2, [])], "id long, messages array<struct<role: string, content: string>>")
    out = {r["id"]: (r["ground_truth"], r["no_reasoning_ground_truth"]) for r in conversion.long_form_messages(rows, "id").collect()}
    assert out == {1: ("a", "a"), 2: (None, None)}


def test_loop_levels(spark):
    rng = random.Random(11)
    rows, wanted = [], []
    for run in range(12):
        seen, names, last = [], [], 0
        for step in range(60):
            fp, m = rng.choice(["", None, *["a"] * 12, *["b"] * 3]), rng.choice([10, 10, 10, 10, 10, 10, 10, 5, 0])
            name = None if not fp else "n"
            if last > 0 and last - m >= 5:
                seen, names = [], []
            last = m
            s = t = 0
            if fp:
                while s < len(seen) and seen[-1 - s] == fp:
                    s += 1
                while t < len(names) and names[-1 - t] == name:
                    t += 1
                s, t = s + 1, t + 1
            seen, names = [*seen, fp or ""][-12:], [*names, name or ""][-12:]
            rows.append((run, step, fp, name, m))
            wanted.append((run, step, s, t, "stop" if s >= 5 else "warn" if s >= 3 else "name" if t >= 8 else "ok"))
    calls = spark.createDataFrame(rows, "run long, step long, fp string, name string, m long")
    out = ranking.loop_levels(calls, "run", ["step"], "fp", "name", "m").select("run", "step", "streak", "name_streak", "level")
    assert sorted(tuple(r) for r in out.collect()) == wanted
    assert {w[4] for w in wanted} == {"stop", "warn", "name", "ok"} and max(w[2] for w in wanted) <= 13


def test_safe_turns(spark):
    rng = random.Random(12)
    rows, wanted = [], []
    for run in range(60):
        turns = [(run, i, role := rng.choice(["assistant", "tool", "tool", "user"]), rng.choice([["c"], ["c"], [], None]) if role == "assistant" else None, rng.choice([True, False, False, None]), rng.choice(["abcd", " a "])) for i in range(rng.randrange(1, 16))]
        rows += turns
        found = []
        for i, t in enumerate(turns):
            end = next((j for j in range(i + 1, len(turns)) if turns[j][2] == "assistant"), len(turns))
            results = [x[4] for x in turns[i + 1 : end] if x[2] == "tool"]
            if i < max(1, int(len(turns) * 0.6)) and t[2] == "assistant" and t[3] and results and not any(results) and len(t[5].strip()) >= 4:
                found.append((run, i))
        wanted += found[:2]
    turns = spark.createDataFrame(rows, "run long, i long, role string, calls array<string>, bad boolean, said string")
    assert sorted(tuple(r) for r in ranking.safe_turns(turns, "run", ["i"], F.col("bad"), F.col("said"), 0.6, 2).collect()) == wanted
    assert wanted


def test_probe_tasks(spark):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    parent = {t: t in "acegi" for t in "abcdefghij"}
    stability = {t: (ord(t) % 3) / 2 for t in parent}
    tasks = spark.createDataFrame([(t, p, stability[t]) for t, p in parent.items()], "task string, parent boolean, stability double")
    focus = spark.createDataFrame([("j", 1), ("a", 2), ("b", 3), ("zz", 4)], "task string, place int")
    found = lambda *a, **k: [r["task"] for r in sampling.probe_tasks(*a, **k).orderBy("place").collect()]
    canaries = sorted((t for t in parent if parent[t]), key=lambda t: (-stability[t], sha(t)))[:3]
    extra = sorted((t for t in parent if not parent[t]), key=sha)[:2]
    assert found(tasks, focus.limit(0), 3, 2) == canaries + extra
    assert found(tasks, focus, 3, 2) == list(dict.fromkeys(["j", "b", *extra, *canaries]))
    assert found(tasks, focus, 3, 2, most=3) == list(dict.fromkeys(["j", "b", *extra, *canaries]))[:3]
    assert found(tasks, focus.limit(0), 2, 1, stable=False) == ["a", "c", "b"]
    assert found(tasks.filter("parent"), focus.limit(0), 0, 2) == ["a", "c"]
    assert found(tasks.limit(0), focus, 2, 1) == []
