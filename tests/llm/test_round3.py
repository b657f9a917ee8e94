"""Clustering, fingerprints and collocations against plain versions; odd rows; long runs of white space."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from tessella.llm import clustering, collocations, packing, queries, winnowing
from tessella.llm.common import fresh


# sort-means


def plain_means(vectors, k=16, rounds=3, scale=64, seed=1, dims=64):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in vectors if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centroids = [v for _, v in first][:k]
    centroids += sorted(v for i, v in kept if i is None)[: k - len(centroids)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v: min((far(v, c), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[nearest(v)[1]].append(v)
        centroids = [[sum(x) // len(groups[n]) for x in zip(*groups[n], strict=True)] if groups[n] else c for n, c in enumerate(centroids)]
    return sorted((-1 if i is None else i, n, d) for i, v in kept for d, n in [nearest(v)]), centroids


def found_means(vectors, **how):
    got = clustering.sort_means(vectors, **how)
    return sorted((-1 if r.vec_id is None else r.vec_id, r.cluster, r.distance) for r in got.assigned.collect()), got.centroids


@pytest.mark.parametrize("seed,spread", [(1, 3), (2, 40), (3, 1)])
def test_sort_means_equals_plain_means(spark, seed, spread):
    rng = random.Random(seed)
    # few values in few dimensions make many ties and repeated vectors
    vectors = [(i, [rng.randint(-spread, spread) / 8 for _ in range(3)]) for i in range(150)] + [(7, [0.5, 0.5, 0.5]), (None, [0.25, 0.0, -1.0]), (None, None), (900, [1.0]), (901, [1.0, None, 2.0]), (902, [1.0, float("nan"), 2.0]), (903, [1.0, 2.0, float("-inf")]), (904, [])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").selectExpr("*", "0 as cluster", "'x' as vector", "1 as distance").repartition(5)
    assert found_means(df, k=8, rounds=3, scale=8, dims=3) == plain_means(vectors, k=8, scale=8, dims=3)
    assert found_means(df.limit(0), k=8, dims=3) == ([], [])
    few = spark.createDataFrame(vectors[:3], "vec_id long, embedding array<double>")
    assert found_means(few, k=8, scale=8, dims=3) == plain_means(vectors[:3], k=8, scale=8, dims=3)


def test_scans_stop_strictly_beyond_twice_the_distance():
    # centroid 0 lies exactly at twice the vector's distance from its own centroid 1, and ties with it
    points = np.array([[0, 0], [4, 0], [100, 0]])
    best, least = clustering.nearest(np.array([[2, 0]]), np.array([1]), points, *clustering.neighbours(points))
    assert (best.tolist(), least.tolist()) == ([0], [4])


def test_components_beyond_the_bound_are_an_error(spark):
    df = spark.createDataFrame([(1, [1e9, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="reaches"):
        clustering.sort_means(df, dims=2).assigned.collect()


# winnowing


def plain_prints(text, k, window):
    grams = [text[i : i + k] for i in range(max(len(text) - k + 1, min(len(text), 1)))]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() & 0xFFFFFFFF for g in grams]
    chosen = {}
    for s in range(max(len(hashes) - window + 1, min(len(hashes), 1))):
        part = hashes[s : s + window]
        least = min(part)
        at = s + max(i for i, h in enumerate(part) if h == least)
        chosen[at] = least
    return sorted((p, h) for p, h in chosen.items())


def test_fingerprints_choose_the_rightmost_least(spark):
    rng = random.Random(5)
    texts = ["", "a", "abc" * 4, "x" * 400, "".join(rng.choice("ab é漢\U0001f600\n") for _ in range(3000)), "ab" * 4000, "".join(rng.choice("abcdefgh ") for _ in range(9000)), None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'x' as prints")
    for k, window in ((16, 32), (5, 4), (1, 1)):
        got = {r.doc_id: [(p.position, p.hash) for p in r.prints_] for r in winnowing.fingerprints(df, k=k, window=window).collect()}
        assert got == {i: plain_prints(t or "", k, window) for i, t in enumerate(texts)}


def plain_edits(rows, k=winnowing.K, window=winnowing.WINDOW):
    spelt = lambda prints: " ".join(f"{h * 2**31 + 2**31 - 1 - p:X}" for p, h in prints)
    out = []
    for i, (doc, text) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        n = len(text)
        edited = text[: n - n // 3] + following[: n // 3]
        own, theirs, other = (plain_prints(t, k, window) for t in (text, edited, following))
        near = lambda b: (lambda x, y: len(x & y) / len(x | y) if x | y else 1.0)({h for _, h in own}, {h for _, h in b})  # noqa: B023, E731
        out.append((doc, n, hashlib.sha256(edited.encode()).hexdigest(), spelt(own), spelt(theirs), near(theirs), near(other)))
    return sorted(out, key=str)


def test_op12_equals_plain_winnowing(spark, sf, tmp_path):
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows.sort(key=lambda r: -r[0])
    assert sorted([tuple(r) for r in queries.op12_winnowing(spark, sf).collect()], key=str) == plain_edits(rows)


def test_next_document_over_many_stretches(spark):
    rng = random.Random(9)
    rows = [(i, "".join(rng.choice("abcd ") for _ in range(rng.choice([0, 3, 60, 700])))) for i in rng.sample(range(-500, 5000), 400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    order = sorted(rows, key=lambda r: -r[0])
    want = sorted((d, t, order[(i + 1) % len(order)][1]) for i, (d, t) in enumerate(order))
    for each in (1, 4000, 1 << 30):
        got = winnowing.with_next(df, bytes_each=each, least_bytes=each)
        assert sorted((r.doc_id, r.text, r.next_text) for r in got.collect()) == want


def test_odd_documents_for_winnowing(spark):
    odd = [(1, None), (2, ""), (2, "same id"), (2, "same id"), (None, "no id"), (None, "no id either"), (3, "long " * 50_000)]
    df = spark.createDataFrame(odd, "doc_id long, text string").selectExpr("*", "1 as key", "2 as stretch", "'x' as keys")
    rows = winnowing.compare_edits(df).collect()
    assert len(rows) == len(odd) and {r.n_chars for r in rows} == {0, 7, 5, 12, 250_000}
    assert all(r.near_edited == 1 for r in rows if r.n_chars == 0)
    assert winnowing.compare_edits(df.limit(0)).collect() == []
    alone = winnowing.compare_edits(df.filter("doc_id = 3")).first()
    assert alone.near_next == 1.0 and alone.edited_text == ("long " * 50_000)[: 250_000 - 83_333] + ("long " * 50_000)[:83_333]


# collocations


def plain_collocations(rows, top=2000, most=3, least=10, percent=50):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, most + 1):
                f[lang].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, counts in f.items():
        rows = []
        for g, a in counts.items():
            if len(g) == 1 or a < least:
                continue
            cuts = [(math.floor(Fraction(1_000_000 * a * a, counts[g[:k]] * counts[g[k:]])), k) for k in range(1, len(g))]
            inside = [h for h, b in counts.items() if len(h) > len(g) and b >= least and 100 * b >= percent * a and any(h[i : i + len(g)] == g for i in range(len(h)))]
            if not inside:
                score, k = min(cuts)
                rows.append((score, a, " ".join(g), counts[g[:k]], counts[g[k:]]))
        rows.sort(key=lambda r: (-r[0], -r[1], r[2].encode()))
        out += [(lang, i + 1, g, a, le, ri, n[lang], s) for i, (s, a, g, le, ri) in enumerate(rows[:top])]
    return sorted(out)


ROWS = [("The big cat. the BIG cat, a big\tdog!\nbig cat the big cat", "en")] * 6 + [("é ü é ü é; É ü", None), (None, "en"), ("", "fr"), ("?!\v\f\r", "fr"), ("the the the the " * 20, "en"), ("漢 字\x00 x 漢 字\x00 x " * 12, "zh"), ("a b", "")] + [("the big cat sat", "de")] * 11


@pytest.mark.parametrize("top,least", [(2000, 10), (2, 2)])
def test_collocations_equal_plain_counts(spark, top, least):
    df = spark.createDataFrame(ROWS, "text string, lang string").selectExpr("*", "1 as n", "'x' as phrase", "0 as score").repartition(3)
    counts = collocations.count_phrases(df, least=1, shard_words=20, part_bytes=16, most_owners=2)
    assert len({(r.lang, r.phrase) for r in counts.collect()}) == counts.count()
    assert sorted(tuple(r) for r in collocations.collocations(df, top=top, least=least).collect()) == plain_collocations(ROWS, top, least=least)
    assert collocations.collocations(df.limit(0)).collect() == []


def test_longer_phrases(spark):
    df = spark.createDataFrame(ROWS, "text string, lang string")
    assert sorted(tuple(r) for r in collocations.collocations(df, most=5, least=3).collect()) == plain_collocations(ROWS, most=5, least=3)


@pytest.mark.parametrize("seed", range(4))
def test_suffix_array_and_intervals(seed):
    rng = random.Random(seed)
    symbols = np.array([rng.randrange(0, 4) for _ in range(rng.choice([0, 1, 5, 200]))], dtype=np.int64)
    s = symbols.tolist()
    for depth in (1, 3, 5):
        order = collocations.suffix_array(symbols, depth).tolist()
        assert [s[i : i + depth] for i in order] == sorted(s[i : i + depth] for i in range(len(s)))
        for n, at, count in collocations.intervals(symbols, depth):
            want = Counter(tuple(s[i : i + n]) for i in range(len(s) - n + 1) if 0 not in s[i : i + n])
            assert [(tuple(s[a : a + n]), c) for a, c in zip(at.tolist(), count.tolist(), strict=True)] == sorted(want.items())


# packing


@pytest.mark.parametrize("text", ["ab" + " " * 2_000_000 + "x", "ab" + "\n" * 1_000_000, "\t " * 500_000 + "é", "a" * 300_000, "!" * 300_000, ("a" + " " * 2500) * 40, " " * 1999 + "b<|endoftext|>"])
def test_long_runs_have_the_ids_of_the_tokenizers_file(text):
    file = public_tokenizers.path("byte_bpe_50k.json")
    quick = packing.tokenizer(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, tuple(packing.added_tokens(file).items()))
    assert packing.text_ids(text, quick, file).tolist() == Tokenizer.from_file(file).encode(text, add_special_tokens=False).ids


def test_fresh_names():
    assert fresh("Prints", ["prints", "x"]) == "Prints_"
