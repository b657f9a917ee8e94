"""Deterministic sampling, mixing and splitting. Random order is the order of a seeded hash, so it doesn't hang on partitions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shuffled(key: str, seed: int = 42) -> Column:
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}")))


def ranked(df: DataFrame, by: list, order: list, name: str = "rank") -> DataFrame:
    """A row number within groups; `by` must name some columns, so that no task gets all rows."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def parse_amount(amount: str, n: int) -> int:
    """Rows that a mixer entry asks for: with a point a share of n, else a count."""
    return int(float(amount) * n) if "." in amount else int(amount)


def resample(df: DataFrame, target: int, key: str, seed: int = 42) -> DataFrame:
    """target // n whole copies of the rows and the first target % n of a seeded order. Column `copy` tells them apart."""
    n = df.count()
    if not n or target <= 0:
        return df.limit(0).withColumn("copy", F.lit(0))
    whole, rest = divmod(target, n)
    parts = [df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(whole - 1))))] if whole else []
    if rest:
        parts.append(df.orderBy(shuffled(key, seed), key).limit(rest).withColumn("copy", F.lit(whole)))
    return reduce(DataFrame.unionByName, parts)


def mix(sources: list[tuple[str, DataFrame, str]], key: str, seed: int = 42) -> DataFrame:
    """Sources (name, rows, amount) resampled and put one after another, with dataset_source and its place."""
    parts = [resample(df, parse_amount(amount, df.count()), key, seed).withColumn("dataset_source", F.lit(name)).withColumn("source_order", F.lit(i)) for i, (name, df, amount) in enumerate(sources)]
    return reduce(DataFrame.unionByName, parts)


def split_pairs(df: DataFrame, key: str, ratio: float, seed: int = 42) -> DataFrame:
    """Column `part`: max(1, floor(n * ratio)) rows are `eval`, the first of a seeded order; the others are `train`."""
    n = df.count()
    picked = df.select(key).orderBy(shuffled(key, seed), key).limit(max(1, int(n * ratio)) if n else 0)
    return df.join(picked.withColumn("part", F.lit("eval")), key, "left").withColumn("part", F.coalesce("part", F.lit("train")))


def stratified_fill(df: DataFrame, domain: str, key: str, need: int, seed: int = 42) -> DataFrame:
    """Round-robin over sorted domains: one of each, then the next of each, until `need` rows."""
    order = [F.desc(shuffled(key, seed)), F.col(key)]
    return ranked(df, [domain], order).filter(F.col("rank") <= need).orderBy("rank", domain).limit(max(0, need))


def failed_passed_mix(results: DataFrame, key: str, pool: DataFrame, *, n_failed: int = 10, n_passed: int = 6, n_held: int = 30, errors: tuple[str, ...] = ("error", "agent_error", "timeout"), seed: int = 42) -> DataFrame:
    """(key, part): failing and passing tasks of results (key, passed, status), the first of a seeded order, and a holdout from the pool
    without them. Tasks with a status of `errors` are in neither; a short list gives what it has. Without failing tasks the result has
    none, which the caller has to judge."""
    order = [shuffled(key, seed), F.col(key)]
    sure = results.filter(~F.coalesce(F.col("status"), F.lit("")).isin(*errors)).select(key, F.when(F.col("passed"), "passing").otherwise("failing").alias("part"))
    taken = ranked(sure, ["part"], order).filter(F.col("rank") <= F.when(F.col("part") == "failing", n_failed).otherwise(n_passed)).select(key, "part")
    held = pool.select(key).distinct().join(taken, key, "left_anti").orderBy(*order).limit(n_held)
    return taken.unionByName(held.withColumn("part", F.lit("holdout")))


def rotate(prev: DataFrame, pool: DataFrame, excluded: DataFrame, avoid: DataFrame, domain: str, key: str, size: int, seed: int = 42) -> DataFrame:
    """The next set: what of the previous one is still in the pool and not excluded, then new rows to make up `size`. Column `kept`."""
    kept = pool.join(prev.select(key), key, "left_semi").join(excluded.select(key), key, "left_anti").orderBy(key).limit(size)
    fresh = pool.join(kept.select(key), key, "left_anti").join(excluded.select(key), key, "left_anti").join(avoid.select(key), key, "left_anti")
    new = stratified_fill(fresh, domain, key, size - kept.count(), seed).drop("rank")
    return kept.withColumn("kept", F.lit(True)).unionByName(new.withColumn("kept", F.lit(False)))


def prefer_then_fill(df: DataFrame, preferred: DataFrame, domain: str, key: str, need: int, seed: int = 42) -> DataFrame:
    first = df.join(preferred.select(key), key, "left_semi").orderBy(key).limit(need)
    more = stratified_fill(df.join(preferred.select(key), key, "left_anti"), domain, key, need - first.count(), seed).drop("rank")
    return first.unionByName(more)


def holdout_sides(n: int, held: int) -> list[bool]:
    """Whether each place of a dealt list goes to the holdout: it does while the holdout's share is behind."""
    sides, h, e = [], 0, 0
    for _ in range(n):
        side = h * (n - held) <= e * held and h < held
        h, e = h + side, e + (not side)
        sides.append(side)
    return sides


def dealt_to_holdout(place: Column, n: int, held: int) -> Column:
    """The same rule for one place (from 0) without the list before it: before place p the holdout has min(held, floor((p - 1) * held / n) + 1)."""
    share = lambda p: F.when(p <= 0, 0).otherwise(F.least(F.lit(held), F.floor((p - 1) * F.lit(held) / F.lit(max(n, 1))) + 1))
    return share(place + 1) > share(place)


def cell_round_robin(df: DataFrame, cell: list[str], task: str, order: list, cap: int, n: int) -> DataFrame:
    """At most `cap` rows of each task, then one row of each cell, the next of each, up to n."""
    capped = ranked(df, [*cell, task], order, "in_task").filter(F.col("in_task") <= cap)
    return ranked(capped, cell, order, "in_cell").filter(F.col("in_cell") <= n).orderBy("in_cell", *cell).limit(n)


def rank_quartile(rank: Column, n: int) -> Column:
    """1 to 4 by rank from 0; the last takes the remainder, which ntile spreads."""
    return F.least(F.floor(rank / F.lit(max(1, n // 4))), F.lit(3)) + 1


def top_half_and_sample(df: DataFrame, order: list, key: str, most: int, seed: int = 42) -> DataFrame:
    """The best max(1, most // 2) rows and a seeded sample of the others, `most` together."""
    head = df.orderBy(*order).limit(max(1, most // 2))
    tail = df.join(head.select(key), key, "left_anti").orderBy(shuffled(key, seed), key).limit(max(0, most - max(1, most // 2)))
    return head.unionByName(tail)


def cap_previous(df: DataFrame, preferred: Column, order: list, fraction: float) -> DataFrame:
    """All preferred rows and the best of the others, at most `fraction` of the result; all of them if none is preferred."""
    new = df.filter(preferred)
    n = new.count()
    old = df.filter(~preferred).orderBy(*order)
    return new.unionByName(old.limit(int(fraction / max(1e-9, 1 - fraction) * n)) if n and fraction < 1 else old)


def learnability(rate: Column) -> Column:
    return (1 - rate) * (rate + 0.15)


def quotas(df: DataFrame, weight: Column, budget: int) -> DataFrame:
    """Column `quota`: the budget by weight, rounded half to even."""
    total = df.agg(F.sum(weight).alias("total_weight"))
    return df.crossJoin(F.broadcast(total)).withColumn("quota", F.bround(F.lit(budget) * weight / F.col("total_weight")).cast("long")).drop("total_weight")  # one row


def n_per_key(df: DataFrame, key: str, row: str, n: int, seed: int = 42) -> DataFrame:
    """n seeded rows of each key that has n at least."""
    return ranked(df.withColumn("held", F.count("*").over(Window.partitionBy(key))).filter(F.col("held") >= n), [key], [shuffled(row, seed), F.col(row)]).filter(F.col("rank") <= n).drop("held", "rank")


def portions(df: DataFrame, stratum: str, key: str, shares: dict[str, float], total: int, seed: int = 42) -> DataFrame:
    """floor(share * total) seeded rows of each named stratum, fewer where it has fewer."""
    spark = df.sparkSession
    wanted = spark.createDataFrame([(k, int(v * total)) for k, v in shares.items()], f"{stratum} string, wanted int")
    return ranked(df.join(F.broadcast(wanted), stratum), [stratum], [shuffled(key, seed), F.col(key)]).filter(F.col("rank") <= F.col("wanted")).drop("rank", "wanted")


def frontier_weight(prior_successes: Column, prior_attempts: Column, successes: Column, attempts: Column, exploration: float = 0.1) -> Column:
    """How much a task is worth trying: highest where half of all attempts succeed, never below the exploration share."""
    rate = (prior_successes + successes + 1) / (prior_attempts + attempts + 2)
    return F.greatest(4 * rate * (1 - rate), F.lit(exploration))


def probe_tasks(tasks: DataFrame, focus: DataFrame, n_solved: int, n_unsolved: int, *, stable: bool = True, most: int | None = None) -> DataFrame:
    """(task, place): tasks that a candidate is tried on: some that the parent solved (canaries) and some that it did not.

    tasks: (task, parent, stability), each task once; focus: (task, place), a short list. Focused tasks that the parent did not solve come first, then other
    unsolved ones, then canaries; without such focus canaries come first. Canaries go by stability (null: 1), then by the task's SHA-256, or by
    name alone where `stable` is off; unsolved ones by hash or name. With none of all these the first tasks by name stand in.
    """
    rank = F.sha2("task", 256) if stable else F.col("task")
    solved, unsolved = (tasks.filter(x) for x in (F.coalesce("parent", F.lit(False)), ~F.coalesce("parent", F.lit(False))))
    order = [F.desc(F.coalesce("stability", F.lit(1.0))), rank] if stable else [rank]
    numbered = lambda df, by, group: df.select("task", F.lit(group).alias("group"), F.row_number().over(Window.orderBy(*by)).alias("at"))
    named = focus.join(unsolved, "task", "left_semi").groupBy("task").agg(F.min("place").alias("at")).select("task", F.lit(0).alias("group"), "at")
    extra = numbered(unsolved.orderBy(rank, "task").limit(n_unsolved), [rank, "task"], 1)
    canaries = numbered(solved.orderBy(*order, "task").limit(n_solved), [*order, "task"], 2)
    other = numbered(tasks.orderBy("task").limit(max(1, n_solved + n_unsolved)), ["task"], 3)
    listed = named.unionByName(extra).unionByName(canaries).unionByName(other)  # no more rows than the focus list and the wanted numbers
    whole = listed.select("*", F.bool_or(F.col("group") == 0).over(Window.partitionBy()).alias("focused"), F.bool_or(F.col("group") < 3).over(Window.partitionBy()).alias("any"))
    turn = F.when(~F.col("focused") & (F.col("group") == 2), 0).otherwise(F.col("group"))
    first = whole.filter((F.col("group") < 3) | ~F.col("any")).groupBy("task").agg(F.min(F.struct(turn.alias("turn"), "at")).alias("o"))
    placed = first.withColumn("place", F.row_number().over(Window.orderBy("o", "task")))
    return (placed if most is None else placed.filter(F.col("place") <= most)).select("task", "place")
