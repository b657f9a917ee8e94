"""Error mining and fault attribution over event logs: rows of acts and observations in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.text import command_shape, error_class


def recoveries(events: DataFrame, run: str, order: list[str], obs: Column, text: str, act: Column, command: str, per_class: int = 3) -> DataFrame:
    """(class, run, error, before, after): errors with the commands around them, distinct shapes first-come, some for each class."""
    w = Window.partitionBy(run).orderBy(*order)
    only = F.when(act, F.col(command))
    near = events.withColumn("after", F.first(only, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))).withColumn("before", F.last(only, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    errors = near.withColumn("class", F.when(obs, error_class(F.col(text)))).filter(F.col("class").isNotNull() & F.col("after").isNotNull()).withColumn("shape", command_shape(F.col("after")))
    one = errors.withColumn("k", F.row_number().over(Window.partitionBy("class", "shape").orderBy(run, *order))).filter("k = 1")
    return one.withColumn("r", F.row_number().over(Window.partitionBy("class").orderBy(run, *order))).filter(F.col("r") <= per_class).select("class", run, F.col(text).alias("error"), "before", "after")


def localize(events: DataFrame, run: str, order: list[str], obs: Column, failed: Column) -> DataFrame:
    """(run, critical, downstream): the first error after which no observation is clean, else the first error; later errors count as
    downstream. Runs without an error have nulls."""
    w = Window.partitionBy(run).orderBy(*order)
    placed = events.withColumn("pos", F.row_number().over(w)).withColumn("err", obs & failed).withColumn("clean", obs & ~failed)
    g = placed.withColumn("last_clean", F.max(F.when(F.col("clean"), F.col("pos"))).over(Window.partitionBy(run))).groupBy(run)
    err, open_ = F.when(F.col("err"), F.col("pos")), F.when(F.col("err") & (F.col("pos") > F.coalesce("last_clean", F.lit(0))), F.col("pos"))
    found = g.agg(F.coalesce(F.min(open_), F.min(err)).alias("critical"), F.collect_list(err).alias("errs"))
    return found.select(run, F.col("critical").cast("long").alias("critical"), F.when(F.col("critical").isNotNull(), F.size(F.filter("errs", lambda x: x > F.col("critical")))).cast("long").alias("downstream"))


def attribute(facts: DataFrame, max_steps: int) -> DataFrame:
    """Columns side, mode, confidence, destination by an ordered ladder over started, grader_error, n_events, passed, critical, steps,
    env_error, wrapper_error, observation and repeated."""
    c = F.col
    ladder = [
        (~c("started"), "ENV", "environment_never_started", 0.97, "environment_repair"),
        (c("grader_error").isNotNull(), "GRADER", "grader_error", 0.9, "benchmark_repair"),
        (c("n_events") == 0, None, None, 0.0, "quarantine"),
        (c("passed") & c("critical").isNotNull(), "MODEL", "recovered_success", 0.8, "sft_recovery_slice"),
        (c("passed"), "MODEL", "clean_success", 0.8, "sft_success"),
        (c("critical").isNull() & (c("steps") >= max_steps - 5), "AMBIGUOUS", "step_budget_exhausted_no_errors", 0.45, "quarantine"),
        (c("critical").isNull(), "MODEL", "premature_stop_or_wrong_solution", 0.6, "model_training"),
        (c("env_error"), "ENV", "missing_dependency_or_broken_env", 0.85, "environment_repair"),
        (c("wrapper_error"), "TOOL", "tool_wrapper_rejected_or_suppressed", 0.85, "harness_evolution"),
        (F.length(F.trim("observation")) < 12, "TOOL", "error_not_surfaced_to_model", 0.7, "harness_evolution"),
        (c("repeated"), "MODEL", "ignored_visible_error_repeated_action", 0.8, "model_training"),
    ]

    def pick(i: int, last: object) -> Column:
        out = F.when(ladder[0][0], F.lit(ladder[0][i]))
        for row in ladder[1:]:
            out = out.when(row[0], F.lit(row[i]))
        return out.otherwise(F.lit(last))

    return facts.select("*", pick(1, "MODEL").alias("side"), pick(2, "visible_error_no_effective_recovery").alias("mode"), pick(3, 0.65).alias("confidence"), pick(4, "model_training").alias("destination"))


def gate(attributed: DataFrame, least: float = 0.5) -> DataFrame:
    """(destination, n): routing counts, with whatever is not sure enough in quarantine."""
    routed = F.when(F.col("confidence") < least, "quarantine").otherwise(F.col("destination"))
    return attributed.groupBy(routed.alias("destination")).agg(F.count("*").alias("n"))


def evidence_groups(rows: DataFrame, signature: Column, tier: Column, history: DataFrame, most: int) -> DataFrame:
    """(signature, tier, n, seen): groups by tier and size, with how many rounds before had them."""
    g = rows.groupBy(signature.alias("signature")).agg(F.min(tier).alias("tier"), F.count("*").alias("n"))
    return g.join(history, "signature", "left").select("signature", "tier", "n", F.coalesce("seen", F.lit(0).cast("long")).alias("seen")).orderBy("tier", F.desc("n"), "signature").limit(most)


def run_bucket(name: Column) -> Column:
    return F.when(F.contains(name, F.lit("fulleval")), "fulleval").when(F.contains(name, F.lit("evolve")), "evolve").otherwise("other")


def family(task: Column) -> Column:
    """What stands before the first hyphen."""
    return F.substring_index(task, "-", 1)


def pair_with_exemplars(failures: DataFrame, exemplars: DataFrame, groups: int, per_group: int) -> DataFrame:
    """(class, n, exemplar, place): the largest classes of failures, each with its exemplars of the shortest recovery; classes
    without one have a null exemplar."""
    size = failures.groupBy("class").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "class").limit(groups)
    best = exemplars.withColumn("place", F.row_number().over(Window.partitionBy("class").orderBy("turns", "exemplar"))).filter(F.col("place") <= per_group)
    return size.join(best, "class", "left").select("class", "n", "exemplar", "place")


def complementary_group(candidates: list[tuple[str, float, frozenset]], size: int) -> list[str]:
    """Names of a bounded list's candidates, best score first, each with something that every one picked before lacks and the other way round."""
    picked: list[tuple[str, frozenset]] = []
    for name, _, items in sorted(candidates, key=lambda c: (-c[1], c[0])):
        if len(picked) < size and all(items - other and other - items for _, other in picked):
            picked.append((name, items))
    return [name for name, _ in picked]


def usability(description: Column, final_state: Column, container: Column) -> Column:
    """Why a task can't be evaluated, the first reason in this order; null if it can."""
    blank = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s", " ")) == ""
    broken = (F.instr(container, "From:") == 0) | (F.instr(container, "%post") == 0)
    return F.when(blank(description), "no_description").when(blank(final_state), "no_test_final_state").when(blank(container), "no_container_def").when(broken, "bad_container_def")
