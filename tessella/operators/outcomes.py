"""Aggregates over task outcomes: rows (task_id, run, reward, status, ...)."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def task_outcomes(trials: DataFrame, passed: Column, ok: Column) -> DataFrame:
    """(task_id, attempts, successes, errors, runs, success_rate). Successes count whatever the status, attempts only where it is ok."""
    g = trials.groupBy("task_id").agg(F.count_if(ok).alias("attempts"), F.count_if(passed).alias("successes"), F.count_if(~ok).alias("errors"), F.sort_array(F.collect_set("run")).alias("runs"))
    return g.withColumn("success_rate", F.when(F.col("attempts") > 0, F.col("successes") / F.col("attempts")).otherwise(0.0))


def mastered(outcomes: DataFrame, taught: DataFrame, carried: DataFrame, least: int, rate: float) -> DataFrame:
    """Taught tasks with enough successes and a high enough rate, and those mastered before."""
    new = outcomes.join(taught.select("task_id").distinct(), "task_id", "left_semi").filter((F.col("successes") >= least) & (F.col("success_rate") >= rate)).select("task_id")
    return new.union(carried.select("task_id")).distinct()


def band(attempts: Column, successes: Column, min_runs: int) -> Column:
    return F.when(attempts < min_runs, "sparse").when(successes <= 0, "unanimous_fail").when(successes >= attempts, "unanimous_pass").otherwise("split")


def pass_at_k(n: Column, c: Column, k: int) -> Column:
    """Unbiased 1 - C(n - c, k) / C(n, k) as a product; 1 where fewer than k are wrong."""
    product = F.aggregate(F.sequence(n - c + 1, n), F.lit(1.0), lambda acc, i: acc * (1 - F.lit(k) / i))
    return F.when(n - c < k, 1.0).when(c <= 0, 0.0).otherwise(1 - product)


#: Terms of one array while a tail is summed.
TERMS = 8192
_STIRLING = [0.0] + [math.lgamma(x + 1) - (x + 0.5) * math.log(x) + x - 0.5 * math.log(2 * math.pi) for x in range(1, 16)]


def _stirling_error(x: Column) -> Column:
    """ln(x!) less Stirling's formula for it."""
    y = 1 / (x.cast("double") * x)
    series = (1 / 12 - y * (1 / 360 - y * (1 / 1260 - y / 1680))) / x
    return F.when(x > 15, series).otherwise(F.get(F.array(*map(F.lit, _STIRLING)), F.least(x, F.lit(15)).cast("int")))


def fair_coin_log(n: Column, k: Column) -> Column:
    """ln P(k heads of n tosses), 0 <= k <= n and n > 0, without a loop: Stirling's errors and the distance from n / 2."""
    d = (2 * k - n) / n
    apart = (1 + d) * F.log1p(d) + (1 - d) * F.log1p(-d)
    inner = _stirling_error(n) - _stirling_error(k) - _stirling_error(n - k) - n / 2 * apart + 0.5 * F.log(n / (2 * math.pi * k * (n - k)))
    return F.when((k == 0) | (k == n), -n * math.log(2)).otherwise(inner)


def sign_test(wins: Column, losses: Column) -> Column:
    """One-sided P(at least this many wins of wins + losses) for a fair coin, a term for each further win; 1 without any."""
    n = wins + losses
    add = lambda a, x: a + x
    part = lambda low: F.aggregate(F.sequence(low, F.least(low + (TERMS - 1), n)), F.lit(0.0).cast("double"), lambda a, k: a + F.exp(fair_coin_log(n, k)))
    return F.when(n == 0, 1.0).otherwise(F.aggregate(F.transform(F.sequence(wins, n, F.lit(TERMS).cast("long")), part), F.lit(0.0).cast("double"), add))


def paired(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """One row (wins, losses, ties, p) over the tasks that both have; inputs are (task_id, score)."""
    both = baseline.withColumnRenamed("score", "a").join(candidate.withColumnRenamed("score", "b"), "task_id")
    row = both.agg(F.count_if(F.col("b") > F.col("a")).alias("wins"), F.count_if(F.col("b") < F.col("a")).alias("losses"), F.count_if(F.col("a") == F.col("b")).alias("ties"))
    return row.withColumn("p", sign_test(F.col("wins"), F.col("losses")))


def summary(trials: DataFrame, domain: str, passed: Column) -> DataFrame:
    """Passed and total by domain and, with a null domain, over all."""
    return trials.rollup(domain).agg(F.count_if(passed).alias("passed"), F.count("*").alias("total"), F.avg(passed.cast("int")).alias("pass_rate"))


def duration_skew(trials: DataFrame, passed: Column, elapsed: str, factor: float) -> DataFrame:
    """Failed trials that took more than factor times the longest passing one."""
    longest = trials.filter(passed).agg(F.max(elapsed).alias("longest"))  # one row
    return trials.filter(~passed).join(F.broadcast(longest), F.col(elapsed) > F.col("longest") * factor).drop("longest")


def nearest_rank(values: DataFrame, value: str, fractions: list[float], n: int) -> DataFrame:
    """(fraction, value): the element at min(n - 1, floor(n * f)) of the ascending values, through a dense index."""
    from tessella.operators.joins import dense_index

    spots = [(f, min(n - 1, int(n * f))) for f in fractions] if n else []
    wanted = values.sparkSession.createDataFrame(spots, "fraction double, index long")
    return dense_index(values.select(value), [value]).join(F.broadcast(wanted), "index").select("fraction", value)


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n, mean, std, min, p25, p50, p75, max) with linear percentiles and the sample deviation."""

    def one(c: str) -> DataFrame:
        q = lambda p: F.percentile(c, F.lit(p))
        return df.agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).cast("double").alias("min"), q(0.25).alias("p25"), q(0.5).alias("p50"), q(0.75).alias("p75"), F.max(c).cast("double").alias("max")).select(F.lit(c).alias("column"), "*")

    return reduce(DataFrame.union, map(one, columns))


def mean_and_spread(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean, sample deviation (0 for one row), least and greatest, rounded to four places."""
    r = lambda c, name: F.round(c, 4).alias(name)
    return df.groupBy(*by).agg(r(F.avg(value), "mean"), r(F.coalesce(F.stddev_samp(value), F.lit(0.0)), "stddev"), r(F.min(value), "min"), r(F.max(value), "max"))


#: Whole scores up to this size are summed exactly.
WHOLE = 10_000


def exact_spread(score: str) -> Column:
    """Population deviation as an aggregate that no order of rows changes, so that equal spreads tie: exact of whole scores, else to 40 bits."""
    x = F.col(score).cast("double")
    whole = (F.rint(x) == x) & (F.abs(x) <= WHOLE)
    i, d = F.when(whole, x.cast("long")), lambda c: c.cast("decimal(20,0)")
    n, s, q = d(F.count(x)), d(F.sum(i)), d(F.sum(i * i))
    exact = F.sqrt((n * q - s * s).cast("double") / (n * n).cast("double"))
    std = F.stddev_pop(x)
    unit = F.pow(F.lit(2.0), F.floor(F.log2(std)) - 40)
    return F.when(F.bool_and(whole), exact).when((std > 0) & (std < math.inf), F.rint(std / unit) * unit).otherwise(std)


def prune_by_spread(scores: DataFrame, query: str, rubric: str, score: str, top: int) -> DataFrame:
    """Rubrics with some spread of scores: the `top` of each query by population deviation, ties by rubric; those without any score stay."""
    g = scores.groupBy(query, rubric).agg(F.count(score).alias("n"), exact_spread(score).alias("std"))
    live = g.filter((F.col("n") == 0) | (F.col("std") > 0))
    order = Window.partitionBy(query, (F.col("n") == 0)).orderBy(F.desc("std"), rubric)
    return live.withColumn("rank", F.row_number().over(order)).filter((F.col("n") == 0) | (F.col("rank") <= top)).select(query, rubric, "std")


def binarize(rows: DataFrame, prompt: str, response: str, score: Column, margin: float = 0.0, least: float | None = None) -> DataFrame:
    """(prompt, chosen, rejected, gap): best and worst response of each prompt with two or more; ties and small gaps go."""
    scored = rows.select(prompt, response, score.alias("score__"))
    g = scored.groupBy(prompt).agg(F.count("*").alias("n"), F.max(F.struct("score__", response)).alias("best"), F.min(F.struct("score__", response)).alias("worst"))
    kept = g.filter((F.col("n") >= 2) & (F.col("best.score__") > F.col("worst.score__")) & (F.col("best.score__") - F.col("worst.score__") >= margin))
    if least is not None:
        kept = kept.filter(F.col("best.score__") >= least)
    return kept.select(prompt, F.col(f"best.{response}").alias("chosen"), F.col(f"worst.{response}").alias("rejected"), (F.col("best.score__") - F.col("worst.score__")).alias("gap"))


def best_per_parent(rows: DataFrame, parent: str, order: list) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(parent).orderBy(*order))).filter("rank = 1").drop("rank")


def majority(votes: DataFrame, key: str, choice: str, voter: str) -> DataFrame:
    """The choice with the most votes for each key; ties go to the one that the first voter made."""
    g = votes.groupBy(key, choice).agg(F.count("*").alias("n"), F.min(voter).alias("first"))
    return g.groupBy(key).agg(F.max(F.struct("n", (-F.col("first")).alias("o"), choice)).alias("m")).select(key, F.col(f"m.{choice}").alias(choice), F.col("m.n").alias("votes"))


def task_matrix(rounds: DataFrame, names: list[int]) -> DataFrame:
    """A row for each task: its result in each round, failures and flips between rounds that follow each other."""
    w = Window.partitionBy("task_id").orderBy("round")
    flipped = rounds.withColumn("flip", (F.lag("passed").over(w) != F.col("passed")).cast("int"))
    cells = [F.max(F.when(F.col("round") == r, F.when(F.col("passed"), "T").otherwise("F"))).alias(f"r{r}") for r in names]
    return flipped.groupBy("task_id").agg(*cells, F.count_if(~F.col("passed")).alias("fails"), F.coalesce(F.sum("flip"), F.lit(0)).alias("flips")).orderBy(F.desc("fails"), F.desc("flips"), "task_id")


def selected_tasks(summaries: DataFrame, summary: str) -> DataFrame:
    """(task): the union of `selected_tasks` of JSON summaries; those that can't be read, or have none, add nothing."""
    found = F.from_json(summary, "selected_tasks array<string>")
    return summaries.select(F.explode(found["selected_tasks"]).alias("task")).filter("task is not null").distinct()


def reward_breakdown(rows: DataFrame, key: str, verifier: str, score: Column, weight: Column, multiplier: float = 1.0) -> DataFrame:
    """(key, reward, parts): multiplier * score * weight summed, and a map of the same by verifier. Null scores, of unknown verifiers, are
    skipped; a response with no other has reward 0 and an empty map."""
    each = rows.select(key, F.when(score.isNotNull(), F.col(verifier)).alias("v__"), (score * weight * multiplier).alias("r__"))
    sums = each.groupBy(key, "v__").agg(F.sum("r__").alias("r__"))
    entries = F.array_sort(F.collect_list(F.when(F.col("v__").isNotNull(), F.struct("v__", "r__"))))
    return sums.groupBy(key).agg(F.coalesce(F.sum("r__"), F.lit(0.0)).alias("reward"), F.map_from_entries(entries).alias("parts"))
