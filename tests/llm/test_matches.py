"""Operators that hold documents against each other, against brute force."""

from __future__ import annotations

import random
import re
from collections import defaultdict

import numpy as np
import pytest

from tessella.llm import common, decontamination, line_dedup, ngram_join, substring_dedup
from tessella.llm.common import Scratch

SCHEMA = "doc_id long, text string"
WORD = re.compile("[^\x20\x09-\x0d]+")


def corpus(seed: int, n: int = 60) -> list[tuple]:
    """Texts with copies, near copies, shared passages, repeats inside one text, and odd rows."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 6))).title() if r.random() < 0.2 else "".join(r.choice("abcde") for _ in range(r.randint(1, 6)))
    text = lambda k: " ".join(word() for _ in range(k))
    passage, line = text(50), "A line that many documents share."
    rows = []
    for i in range(n):
        t = text(r.choice([0, 1, 3, 5, 30, 80, 150]))
        if r.random() < 0.3:
            t += " " + passage
        if r.random() < 0.4:
            t += f"\n {line.upper() if r.random() < 0.5 else line}\t\n" + text(4)
        if r.random() < 0.1:
            t = f"{t} {t}"
        rows.append((i, t))
    for i in range(n, n + 25):
        words = r.choice(rows)[1].split(" ")
        for _ in range(r.choice([0, 0, 1, 2, 3])):
            words[r.randrange(len(words))] = word()
        rows.append((i, " ".join(words)))
    long = text(3000)
    rows += [(200, None), (201, ""), (202, " \t\n"), (203, long), (204, long + " end"), (205, "five words are in this"), (206, "Five WORDS are in THIS"), (207, "four words are here"), (208, "four words are here")]
    return rows


@pytest.fixture(scope="module", params=[1, 2])
def rows(request):
    return corpus(request.param)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).selectExpr("*", "1 as k", "'x' as n_lines", "2 as blocks", "3 as sid", "4 as n")


def brute_lines(rows, least=20, docs=3):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    where = defaultdict(set)
    for doc, t in rows:
        if doc is not None:
            for x in (t or "").split("\n"):
                if len(key(x)) >= least:
                    where[key(x)].add(doc)
    gone = {k: max(v) for k, v in where.items() if len(v) >= docs}
    out = []
    for doc, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if doc is None or gone.get(key(x), doc) <= doc]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def test_line_dedup(spark, rows):
    rows = [*rows, (3, rows[3][1]), (None, "A line that many documents share."), (None, None)]
    docs = frame(spark, rows)
    out = line_dedup.dedup_lines(docs)
    assert out.columns[: len(docs.columns)] == docs.columns
    got = sorted(((r[0], r[-3], r[-2], r[-1]) for r in out.collect()), key=repr)
    assert got == brute_lines(rows)
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_line_dedup_of_many_repeated_lines_joins(spark, rows, monkeypatch):
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", 0)
    got = line_dedup.dedup_lines(frame(spark, rows))
    assert sorted(((r[0], r[-3], r[-2], r[-1]) for r in got.collect()), key=repr) == brute_lines(rows)


def test_full_filters_only_let_more_through(spark, rows):
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, SCHEMA), filter_bits=2048)
    assert sorted((tuple(r) for r in got.drop("text").collect()), key=repr) == brute_lines(rows)


def brute_substrings(rows, k=35):
    words = [WORD.findall(t or "") for _, t in rows]
    seen = defaultdict(int)
    for w in words:
        for i in range(len(w) - k + 1):
            seen[tuple(w[i : i + k])] += 1
    out = []
    for (doc, _), w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - k + 1):
            if seen[tuple(w[i : i + k])] > 1:
                gone.update(range(i, i + k))
        out.append((doc, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=repr)


def test_substring_dedup(spark, rows):
    rows = [*rows, (203, rows[-6][1]), (None, rows[5][1])]
    docs = frame(spark, rows)
    got = sorted((tuple(r) for r in substring_dedup.dedup_substrings(docs).collect()), key=repr)
    assert got == brute_substrings(rows)
    assert substring_dedup.dedup_substrings(docs.limit(0)).count() == 0


def brute_groups(rows):
    def shingles(t):
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets = [(doc, shingles(t)) for doc, t in rows if doc is not None]
    label = {doc: doc for doc, _ in sets}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[i + 1 :]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = sorted((root(a), root(b)))
                label[q] = p
    return sorted((doc, len(s), root(doc)) for doc, s in sets)


def test_ngram_join(spark, rows):
    rows = [*rows, (3, rows[3][1]), (None, rows[7][1])]
    docs = frame(spark, rows)
    assert sorted(tuple(r) for r in ngram_join.near_groups(docs).collect()) == brute_groups(rows)
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {c for _, _, c in brute_groups(rows)} | {None}
    assert ngram_join.near_groups(docs.limit(0)).count() == 0


def test_families_in_many_chunks(spark, rows, monkeypatch):
    monkeypatch.setattr(ngram_join, "STAR_CHUNK", 300)
    assert sorted(tuple(r) for r in ngram_join.near_groups(frame(spark, rows)).collect()) == brute_groups(rows)


@pytest.mark.parametrize("chunk", [300, 1 << 20])
def test_ids_with_several_texts(spark, rows, monkeypatch, chunk):
    monkeypatch.setattr(ngram_join, "STAR_CHUNK", chunk)
    plain = [f"{a}{i}" for a in "ab" for i in range(30)]
    a, b, c = " ".join(plain[:30]), " ".join(plain[30:]), " ".join(plain[10:50])
    named = [(905, a), (907, a), (905, b), (903, b), (908, c), (908, None), (908, c), (906, ""), (906, None), (909, c + " tail"), (909, a + " tail"), (910, "one"), (910, "two"), (911, "two")]
    named += [(920, t) for t in (a, a, b, None)] + [(doc, rows[0][1]) for doc in (930, 931, 930)]
    again = [*rows, *named, *((doc + 1, text) for doc, text in rows[::3])]
    got = sorted(tuple(r) for r in ngram_join.near_groups(frame(spark, again)).collect())
    assert got == brute_groups([(r[0], r[1]) for r in again])
    small = sorted(tuple(r) for r in ngram_join.near_groups(spark.createDataFrame(named[:4], SCHEMA)).collect())
    assert {(doc, label) for doc, _, label in small} == {(903, 903), (905, 903), (907, 903)}


def test_chains_across_chunks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "STAR_CHUNK", 200)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[i : i + 44])) for i in range(0, 120)] + [(500 + i, " ".join(words[200 + 9 * i : 200 + 9 * i + 44 + 2 * (i % 7)])) for i in range(15)]
    assert sorted(tuple(r) for r in ngram_join.near_groups(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()) == brute_groups(rows)


@pytest.mark.parametrize("seed", range(30))
def test_trie_join_finds_the_components(seed):
    r = np.random.default_rng(seed)
    base = [np.sort(r.choice(60, r.integers(1, 40), replace=False)) for _ in range(4)]
    sets = [np.unique(np.where(r.random(len(b)) < 0.07, r.integers(0, 60, len(b)), b)) for b in (base[r.integers(4)] for _ in range(40))]
    size = np.array([len(x) for x in sets])
    linked = lambda i, j: 180 * len(np.intersect1d(sets[i], sets[j])) >= 80 * (size[i] + size[j])
    want = ngram_join._Forest(np.arange(40))
    for i in range(40):
        for j in range(i):
            if linked(i, j):
                want.join(i, np.array([j]))
    stored, probes = (np.arange(40), np.arange(40)) if seed % 2 else (np.arange(0, 40, 2), np.arange(1, 40, 2))
    got = list(ngram_join.trie_join(stored, probes, sets, size, ngram_join._Forest(np.arange(40))))
    assert all(linked(i, j) for i, j in got)
    if seed % 2:
        assert len(got) == 40 - len(set(want.of))
    else:
        across = {(i, j) for i in stored for j in probes if linked(i, j)}
        joined = ngram_join._Forest(np.arange(40))
        for i, j in got:
            joined.join(i, np.array([j]))
        assert all(joined.of[i] == joined.of[j] for i, j in across)


def test_long_texts_hash_alike_in_pieces(monkeypatch):
    texts = [b"a bc  def\t" * 50, b"", b" x", b"y" * 300, b"one two"]
    whole = common.word_table(texts)
    monkeypatch.setattr(common, "SLICE_BYTES", 16)
    for x, y in zip(whole, common.word_table(texts), strict=True):
        assert x.tolist() == y.tolist()


def test_connected_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(500, 300), (300, 400), (7, 7)], "a long, b long")
    got = {r.v: r.label for r in ngram_join.connected(edges, Scratch(spark, "test"), "c").collect()}
    assert got == {**{i: 0 for i in range(101)}, 300: 300, 400: 300, 500: 300}
    assert ngram_join.connected(edges.limit(0), Scratch(spark, "test"), "c").count() == 0


QUESTION = "A train leaves the small town at 9 and covers 120 km in 3 hours before it meets Ada near the old bridge, so how fast is it?"


def test_reparametrised_questions_are_leaks(spark):
    bench = spark.createDataFrame([(1, QUESTION), (2, None), (3, ""), (4, "too short")], "item_id long, text string").selectExpr("*", "1 as win", "2 as hash")
    other = QUESTION.replace("120", "80").replace("Ada", "Bob").replace("9", "7").replace("3 hours", "2 hours")
    mixed = "Say 5 of 5. " + QUESTION
    rows = [(10, QUESTION), (11, f"Lead in. {other} And on."), (12, "nothing of the kind " * 30), (13, None), (14, ""), (15, "word " * 30_000), (16, QUESTION), (16, QUESTION), (None, "x"), (17, mixed)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as hash", "2 as d_win")
    found = {(r.doc_id, r.item_id) for r in decontamination.find_leaks(docs, bench).collect()}
    assert found == {(10, 1), (11, 1), (16, 1), (17, 1)}
    kept = decontamination.drop_leaks(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {12, 13, 14, 15, None}
    assert decontamination.find_leaks(docs.limit(0), bench).count() == 0
    assert decontamination.find_leaks(docs, bench.limit(0)).count() == 0


def test_slots_that_disagree_are_no_leak(spark):
    item = "one has 5 apples and gives 5 apples to each of 5 friends who wait at home for 5 days now"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    good, bad = item.replace("5", "8"), item.replace("5", "8", 2)
    docs = spark.createDataFrame([(1, good), (2, bad)], SCHEMA)
    assert [r.doc_id for r in decontamination.find_leaks(docs, bench).collect()] == [1]


def test_one_changed_word_does_not_hide_a_short_item(spark):
    item = "which of these fifteen words would you change so that nobody can find them again"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"x y z {item.replace('would', 'might')} x"), (2, "which of these fifteen words are not the same text at all here")], SCHEMA)
    assert [r.doc_id for r in decontamination.find_leaks(docs, bench).collect()] == [1]


GAVE = "She gave 3 red apples to Tom and she gave 5 red apples to Ann before lunch, so how many red apples did she give away?"
SHOP = "A shop sells 12 boxes of pens at 4 dollars each and pays 7 dollars of rent, so how much of it is left for the owner at night?"


def test_each_place_of_a_window_may_align(spark):
    bench = spark.createDataFrame([(1, GAVE), (2, SHOP)], "item_id long, text string")
    before = "Yesterday a shop sells 10 boxes of pens at 3 dollars each. Then: "
    rows = [
        (1, GAVE), (2, GAVE.replace("3", "8").replace("5", "9")), (3, before + SHOP), (4, f"{before}{SHOP} {before}"),
        (5, before + SHOP.replace("pays", "then pays")), (6, before + SHOP.replace("boxes", "crates")), (7, before * 3), (8, "Out. " * 50 + SHOP + before),
    ]
    found = {(r.doc_id, r.item_id) for r in decontamination.find_leaks(spark.createDataFrame(rows, SCHEMA), bench).collect()}
    assert found == {(1, 1), (2, 1), (3, 2), (4, 2), (5, 2), (6, 2), (8, 2)}
