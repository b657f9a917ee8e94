"""Queries of classification and attribution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.text import ERROR_CLASSES, command_shape, error_class, shorten_label
from tessella.operators import attribution as A
from tessella.queries import query, table
from tessella.queries.filters import lit

# Fixed test values: observations by event number.
SEEN = ["bash: foo: command not found", "ModuleNotFoundError: No module named 'x'", "open: No such file or directory", "all good", "Permission denied", "Operation timed out", "make: *** [all] Error 2", "Traceback (most recent call last):", "usage: x [-h]", "it cannot be", "fine"]
OBS_SQL = "CASE event_id % 11 " + " ".join(f"WHEN {i} THEN {lit(s)}" for i, s in enumerate(SEEN)) + " END"
CLASS_SQL = "CASE " + " ".join(f"WHEN regexp_matches(o, {lit('(?i)' + p)}) THEN '{n}'" for n, p in ERROR_CLASSES) + " END"
CMD_SQL = "'cat /tmp/f' || event_id % 5 || ' | head -n ' || event_id % 7"
SHAPE_SQL = r"trim(regexp_replace(regexp_replace(regexp_replace({}, '/\S+', '<path>', 'g'), '\b\d+\b', '<n>', 'g'), '\s+', ' ', 'g'))[:120]"


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = F.element_at(F.array(*map(F.lit, SEEN)), (F.col("event_id") % 11 + 1).cast("int"))
    cmd = F.concat(F.lit("cat /tmp/f"), (F.col("event_id") % 5).cast("string"), F.lit(" | head -n "), (F.col("event_id") % 7).cast("string"))
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", obs.alias("o"), cmd.alias("cmd"), (F.col("event_type") == "view").alias("act"))


@query(f"SELECT event_id, {CLASS_SQL} AS class FROM (SELECT event_id, {OBS_SQL} AS o FROM events)")
def c01_error_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log(spark, sf_dir).select("event_id", error_class(F.col("o")).alias("class"))


@query(f"""WITH e AS (SELECT *, {OBS_SQL} AS o, {CMD_SQL} AS cmd FROM events), n AS (SELECT *, first_value(CASE WHEN event_type = 'view' THEN cmd END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after,
    last_value(CASE WHEN event_type = 'view' THEN cmd END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e),
  c AS (SELECT *, {CLASS_SQL} AS class, {SHAPE_SQL.format('after')} AS shape FROM n WHERE event_type <> 'view' AND after IS NOT NULL),
  k AS (SELECT * FROM c WHERE class IS NOT NULL QUALIFY row_number() OVER (PARTITION BY class, shape ORDER BY user_id, ts, event_id) = 1)
SELECT class, user_id, o AS error, before, after FROM k QUALIFY row_number() OVER (PARTITION BY class ORDER BY user_id, ts, event_id) <= 3""")
def c02_recoveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.recoveries(log(spark, sf_dir), "user_id", ["ts", "event_id"], ~F.col("act"), "o", F.col("act"), "cmd")


LOCAL = """p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, event_type = 'error' AS err, event_type IN ('click', 'purchase') AS clean FROM events),
  l AS (SELECT *, max(CASE WHEN clean THEN pos END) OVER (PARTITION BY user_id) AS last_clean FROM p),
  g AS (SELECT user_id, coalesce(min(CASE WHEN err AND pos > coalesce(last_clean, 0) THEN pos END), min(CASE WHEN err THEN pos END)) AS critical, list(pos) FILTER (err) AS errs FROM l GROUP BY 1),
  f AS (SELECT user_id, critical, len(list_filter(errs, lambda x: x > critical)) AS downstream FROM g)"""


@query(f"WITH {LOCAL} SELECT user_id, critical, CASE WHEN critical IS NOT NULL THEN downstream END AS downstream FROM f")
def c03_localize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return located(spark, sf_dir)


def located(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = F.col("event_type").isin("error", "click", "purchase")
    return A.localize(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], seen, F.col("event_type") == "error")


@query("""WITH e AS (SELECT event_id, user_id, ts, event_type, (event_id % 40)::VARCHAR AS cmd FROM events)
SELECT a.event_id, EXISTS (SELECT 1 FROM e b WHERE b.user_id = a.user_id AND b.cmd = a.cmd AND (b.ts > a.ts OR (b.ts = a.ts AND b.event_id > a.event_id))) AS repeated FROM e a WHERE a.event_type = 'error'""")
def c04_repeated_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").withColumn("cmd", (F.col("event_id") % 40).cast("string"))
    later = F.lead("event_id").over(Window.partitionBy("user_id", "cmd").orderBy("ts", "event_id"))
    return e.withColumn("repeated", later.isNotNull()).filter("event_type = 'error'").select("event_id", "repeated")


FACTS = f"""{LOCAL}, u AS (SELECT f.user_id, critical, user_id % 9 > 0 AS started, CASE WHEN user_id % 11 = 3 THEN 'x' END AS grader_error, n AS n_events, n AS steps, bought AS passed, user_id % 5 = 1 AS env_error, user_id % 7 = 2 AS wrapper_error,
    CASE WHEN user_id % 3 = 0 THEN 'err' ELSE 'a long enough message' END AS observation, user_id % 2 = 0 AS repeated
  FROM f JOIN (SELECT user_id, count(*) AS n, bool_or(event_type = 'purchase') AS bought FROM events GROUP BY 1) USING (user_id)),
  a AS (SELECT user_id, CASE WHEN NOT started THEN 'environment_never_started' WHEN grader_error IS NOT NULL THEN 'grader_error' WHEN passed AND critical IS NOT NULL THEN 'recovered_success' WHEN passed THEN 'clean_success'
    WHEN critical IS NULL AND steps >= 95 THEN 'step_budget_exhausted_no_errors' WHEN critical IS NULL THEN 'premature_stop_or_wrong_solution' WHEN env_error THEN 'missing_dependency_or_broken_env' WHEN wrapper_error THEN 'tool_wrapper_rejected_or_suppressed'
    WHEN length(observation) < 12 THEN 'error_not_surfaced_to_model' WHEN repeated THEN 'ignored_visible_error_repeated_action' ELSE 'visible_error_no_effective_recovery' END AS mode FROM u)"""


def attributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n_events"), F.bool_or(F.col("event_type") == "purchase").alias("passed"))
    u = F.col("user_id")
    facts = located(spark, sf_dir).join(totals, "user_id").select(
        "user_id", "critical", "n_events", F.col("n_events").alias("steps"), "passed", (u % 9 > 0).alias("started"), F.when(u % 11 == 3, "x").alias("grader_error"), (u % 5 == 1).alias("env_error"),
        (u % 7 == 2).alias("wrapper_error"), F.when(u % 3 == 0, "err").otherwise("a long enough message").alias("observation"), (u % 2 == 0).alias("repeated"),
    )
    return A.attribute(facts, 100)


@query(f"WITH {FACTS} SELECT user_id, mode FROM a")
def c05_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attributed(spark, sf_dir).select("user_id", "mode")


@query(f"""WITH {FACTS} SELECT CASE mode WHEN 'environment_never_started' THEN 'environment_repair' WHEN 'missing_dependency_or_broken_env' THEN 'environment_repair' WHEN 'grader_error' THEN 'benchmark_repair' WHEN 'recovered_success' THEN 'sft_recovery_slice'
  WHEN 'clean_success' THEN 'sft_success' WHEN 'step_budget_exhausted_no_errors' THEN 'quarantine' WHEN 'tool_wrapper_rejected_or_suppressed' THEN 'harness_evolution' WHEN 'error_not_surfaced_to_model' THEN 'harness_evolution' ELSE 'model_training' END AS destination, count(*) AS n FROM a GROUP BY 1""")
def c06_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.gate(attributed(spark, sf_dir))


@query(f"""WITH e AS (SELECT user_id, {OBS_SQL} AS o, {CMD_SQL} AS cmd FROM events), s AS (SELECT {SHAPE_SQL.format('cmd')} || '|' || o AS signature, CASE WHEN {CLASS_SQL} IS NULL THEN 2 ELSE 1 END AS tier, user_id FROM e),
  h AS (SELECT signature, count(*) AS seen FROM s WHERE user_id % 10 = 0 GROUP BY 1), g AS (SELECT signature, min(tier) AS tier, count(*) AS n FROM s GROUP BY 1)
SELECT signature, tier, n, coalesce(seen, 0) AS seen FROM g LEFT JOIN h USING (signature) ORDER BY tier, n DESC, signature LIMIT 20""")
def c07_evidence_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = log(spark, sf_dir)
    sig = F.concat(command_shape(F.col("cmd")), F.lit("|"), "o")
    history = e.filter("user_id % 10 = 0").groupBy(sig.alias("signature")).agg(F.count("*").alias("seen"))
    return A.evidence_groups(e, sig, F.when(error_class(F.col("o")).isNull(), 2).otherwise(1), history, 20)


@query("""SELECT p_partkey, CASE WHEN contains(p_name, 'fulleval') THEN 'fulleval' WHEN contains(p_name, 'evolve') THEN 'evolve' ELSE 'other' END AS bucket, split_part(p_type, '-', 1) AS family,
  split_part(split_part(split_part(p_type || ' tasks (all), more', ' task', 1), ' (', 1), ', ', 1) AS label, CASE WHEN p_size % 5 = 0 THEN 'no_description' WHEN p_size % 7 = 0 THEN 'no_test_final_state'
  WHEN p_size % 3 = 0 THEN 'no_container_def' WHEN p_size % 3 = 1 THEN 'bad_container_def' END AS unusable FROM part""")
def c08_c09_c10_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size")
    description, final_state = F.when(n % 5 == 0, " \n").otherwise(F.col("p_name")), F.when(n % 7 != 0, F.col("p_type"))
    container = F.get(F.array(F.lit(" "), F.lit("From: x"), F.lit("From: x\n%post\n echo")), (n % 3).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", A.run_bucket(F.col("p_name")).alias("bucket"), A.family(F.col("p_type")).alias("family"), shorten_label(F.concat("p_type", F.lit(" tasks (all), more"))).alias("label"), A.usability(description, final_state, container).alias("unusable"))


@query(f"""WITH e AS (SELECT event_id, value, {OBS_SQL} AS o FROM events), c AS (SELECT *, {CLASS_SQL} AS class FROM e), g AS (SELECT class, count(*) AS n FROM c WHERE class IS NOT NULL AND value < 50 GROUP BY 1 ORDER BY n DESC, class LIMIT 4),
  x AS (SELECT class, event_id AS exemplar, row_number() OVER (PARTITION BY class ORDER BY value, event_id) AS place FROM c WHERE class IS NOT NULL AND value >= 50)
SELECT g.class, n, exemplar, place FROM g LEFT JOIN x ON x.class = g.class AND place <= 3""")
def j12_exemplars(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = log(spark, sf_dir).join(table(spark, sf_dir, "events").select("event_id", "value"), "event_id").withColumn("class", error_class(F.col("o"))).filter("class is not null")
    exemplars = e.filter("value >= 50").select("class", F.col("event_id").alias("exemplar"), F.col("value").alias("turns"))
    return A.pair_with_exemplars(e.filter("value < 50"), exemplars, 4, 3).withColumn("place", F.col("place").cast("long"))
