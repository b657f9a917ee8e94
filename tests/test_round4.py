"""Growth and exactness: what larger tables showed."""

from __future__ import annotations

import math
import time
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella import queries as Q
from tessella.functions import equations
from tessella.operators import outcomes, ranking, retrieval

Q.load()


def test_sign_test_of_many_tasks(spark):
    pairs = [(0, 0), (1, 0), (0, 1), (3, 2), (20, 0), (0, 20), (16, 17), (60, 31), (900, 1000), (5000, 4900)]
    rows = spark.createDataFrame(pairs, "wins long, losses long").repartition(1)
    for r in rows.select("wins", "losses", outcomes.sign_test(F.col("wins"), F.col("losses")).alias("p")).collect():
        n = r.wins + r.losses
        assert r.p == pytest.approx(float(Fraction(sum(math.comb(n, k) for k in range(r.wins, n + 1)), 2**n)), rel=1e-11), r
    begin = time.monotonic()
    half = 300_000
    p = spark.createDataFrame([(half, half)], "wins long, losses long").select(outcomes.sign_test(F.col("wins"), F.col("losses"))).first()[0]
    middle = math.exp(math.lgamma(2 * half + 1) - 2 * math.lgamma(half + 1) - 2 * half * math.log(2))
    assert p == pytest.approx(0.5 + middle / 2, rel=1e-9) and time.monotonic() - begin < 60


def test_equal_spreads_tie_whatever_the_order(spark):
    shapes = [(1, 2, 4), (4, 7, 9, 9, 2), (1, 1, 2, 3, 5, 8, 13)]
    rows = [(q, r, float(x + 3 * r if r % 2 else 60 - x + r)) for q, shape in enumerate(shapes) for r in range(1, 15) for x in (shape if r % 3 else shape[::-1])]
    got = outcomes.prune_by_spread(spark.createDataFrame(rows, "q long, r long, x double"), "q", "r", "x", 3)
    assert {(r.q, r.r) for r in got.collect()} == {(q, r) for q in range(3) for r in (1, 2, 3)}
    parts = [(q, r, x / 10) for q, r, x in rows] + [(9, 1, None), (9, 2, 0.3), (9, 2, 0.3)]
    got = outcomes.prune_by_spread(spark.createDataFrame(parts, "q long, r long, x double"), "q", "r", "x", 3)
    assert {(r.q, r.r) for r in got.collect()} == {(q, r) for q in range(3) for r in (1, 2, 3)} | {(9, 1)}


def test_nearest_by_products_and_by_pairs(spark, monkeypatch):
    rng = np.random.default_rng(5)
    monkeypatch.setattr(ranking, "VECTOR_GROUP", 60)
    monkeypatch.setattr(ranking, "QUERY_GROUP", 30)
    base = rng.normal(size=(30, 8)).astype(np.float32)
    rows = [(i, (base[i % 30] * (1 + i % 3) + (0 if i % 4 else rng.normal(size=8) * 1e-4)).astype(np.float32).tolist()) for i in range(400)]
    rows += [(400, [0.0] * 8), (401, [0.0] * 8), (402, [1e-30] * 8), (403, [1e30] * 8), (7, [1.0] * 8)]
    strange = [(500, [float("nan")] * 8), (501, [float("inf"), *[1.0] * 7])]
    for more in ([], strange):
        df = spark.createDataFrame(rows + more, "id long, v array<float>")
        got = {r.id: r.novelty for r in ranking.knn_novelty(df, "id", "v", df.filter("id % 5 = 0 or id in (7, 401, 403)"), 4).collect()}
        pairs = df.selectExpr("id q", "v u").filter("q % 5 = 0 or q in (7, 401, 403)").join(df.selectExpr("id o", "v"), F.expr("q <> o"))
        near = pairs.select("q", "o", ranking.cosine_distance(F.col("u"), F.col("v")).alias("d"))
        want = {r.q: r.n for r in near.withColumn("r", F.expr("row_number() over (partition by q order by d, o)")).filter("r <= 4").groupBy("q").agg(F.avg("d").alias("n")).collect()}
        assert len(want) > 80 and got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], rel=1e-9, abs=1e-14, nan_ok=True) for i in want)
    one = spark.createDataFrame([(5, [1.0, 2.0]), (None, [1.0, 2.0])], "id long, v array<double>")
    assert [r.novelty for r in ranking.knn_novelty(one, "id", "v", one, 3).collect()] == [1.0, 1.0]


def test_nearest_of_many_queries(spark):
    df = spark.range(0, 40_000, 1, 8).select("id", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: (F.pmod(F.xxhash64("id", i), F.lit(2001)) - 1000).cast("float")).alias("v"))
    begin = time.monotonic()
    assert ranking.knn_novelty(df, "id", "v", df.filter("id % 4 = 0"), 5).filter("novelty > 0.2").count() == 10_000
    assert time.monotonic() - begin < 150


def test_answers_are_compared_once_and_side_by_side(spark, sf, monkeypatch):
    read = []
    start = equations._Reader.__init__
    monkeypatch.setattr(equations._Reader, "__init__", lambda self, signs, point: (read.append(point), start(self, signs, point))[1])
    equations.values.cache_clear()
    assert equations.same(r"\frac{630001}{7}", "90000.142857") is False and read == [0, 0]
    assert equations.same("x+y+123", "y + 123 + x") and len(read) == 2 + 2 * equations.POINTS
    assert Q.QUERIES["v03_v04_math"](spark, sf).rdd.getNumPartitions() == 4  # of one small file
    assert "Aggregate" in Q.QUERIES["v03_v04_equivalence"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()


def test_selection_drops_what_a_full_env_never_takes(spark, tmp_path):
    rows = [(t, t, float(c), c % 3, 100 * t + c) for t in range(40) for c in range(30)] + [(0, 0, 0.5, 1, 0)]  # a candidate of two envs
    used, want, written = Counter(), set(), []
    for t in range(40):
        took = 0
        for _, _, _, env, cand in sorted((r for r in rows if r[0] == t), key=lambda r: (r[2], r[4], r[3])):
            if took < 2 and used[env] < 4:
                used[env] += 1
                took += 1
                want.add((t, env, cand))

    def keep(df):
        path = f"{tmp_path}/{len(written)}"
        df.write.parquet(path)
        written.append(spark.read.parquet(path).count())
        return spark.read.schema(df.schema).parquet(path)

    df = spark.createDataFrame(rows, "task int, task_order int, rank double, env int, cand int")
    got = retrieval.capped_selection(df, df.selectExpr("task", "2 need").distinct(), keep, 4)
    assert {tuple(r) for r in got.select("task", "env", "cand").collect()} == want and sum(written) < 2 * len(rows)


def test_pairs_of_frequent_tokens_are_summed_where_they_arise(spark):
    words = spark.range(0, 60).selectExpr("id", "id % 7 as t", "explode(array('the', 'of', concat('w', id % 7), concat('x', id % 3))) as token").withColumn("tf", F.lit(2))
    w = retrieval.weights(words.select("id", "token", "tf"), retrieval.idf(words, "id", 60), "id")
    left = w.filter("id < 20").withColumnRenamed("id", "q")
    one, other = (retrieval.retrieve(left, w, "q", "id", 0.2, 5, few=few) for few in (True, False))
    assert {(r.q, r.id, round(r.sim, 9)) for r in one.collect()} == {(r.q, r.id, round(r.sim, 9)) for r in other.collect()} and one.count() == 100
