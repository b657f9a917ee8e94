"""Queries of the aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import outcomes as O
from tessella.queries import query, table

T = """t AS (SELECT l_partkey AS task_id, (l_suppkey % 8)::INT AS run, l_orderkey * 10 + l_linenumber AS trial, CASE WHEN l_returnflag = 'N' THEN 1.0 ELSE 0.0 END AS reward, l_linestatus = 'F' OR l_linenumber > 1 AS ok,
  l_quantity::INT AS tools, l_tax * 1000 AS elapsed, (l_partkey % 5)::INT AS domain FROM lineitem)"""


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return table(spark, sf_dir, "lineitem").select(
        c("l_partkey").alias("task_id"), (c("l_suppkey") % 8).cast("int").alias("run"), (c("l_orderkey") * 10 + c("l_linenumber")).alias("trial"), F.when(c("l_returnflag") == "N", 1.0).otherwise(0.0).alias("reward"),
        ((c("l_linestatus") == "F") | (c("l_linenumber") > 1)).alias("ok"), c("l_quantity").cast("int").alias("tools"), (c("l_tax") * 1000).alias("elapsed"), (c("l_partkey") % 5).cast("int").alias("domain"),
    )



def passed():
    return F.col("reward") > 0


OUT = f"{T}, o AS (SELECT task_id, count(*) FILTER (ok) AS attempts, count(*) FILTER (reward > 0) AS successes, count(*) FILTER (NOT ok) AS errors, list_sort(list(DISTINCT run)) AS runs FROM t GROUP BY 1), r AS (SELECT *, CASE WHEN attempts > 0 THEN successes / attempts ELSE 0.0 END AS success_rate FROM o)"


@query(f"WITH {OUT} SELECT task_id, attempts, successes, errors, array_to_string(runs, ',') AS runs, success_rate FROM r")
def a01_task_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.task_outcomes(trials(spark, sf_dir), passed(), F.col("ok")).withColumn("runs", F.array_join(F.transform("runs", lambda x: x.cast("string")), ","))


@query(f"WITH {OUT} SELECT task_id FROM r WHERE task_id % 2 = 0 AND successes >= 10 AND success_rate >= 0.5 UNION SELECT p_partkey FROM part WHERE p_size = 7")
def a02_mastered(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = O.task_outcomes(trials(spark, sf_dir), passed(), F.col("ok"))
    before = table(spark, sf_dir, "part").filter("p_size = 7").select(F.col("p_partkey").alias("task_id"))
    return O.mastered(out, out.filter("task_id % 2 = 0"), before, 10, 0.5)


@query(f"WITH {OUT} SELECT CASE WHEN attempts < 20 THEN 'sparse' WHEN successes <= 0 THEN 'unanimous_fail' WHEN successes >= attempts THEN 'unanimous_pass' ELSE 'split' END AS band, count(*) AS n FROM r GROUP BY 1")
def a03_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = O.task_outcomes(trials(spark, sf_dir), passed(), F.col("ok"))
    return out.groupBy(O.band(F.col("attempts"), F.col("successes"), 20).alias("band")).agg(F.count("*").alias("n"))


@query(f"WITH {T} SELECT run, count(*) AS n, count(*) FILTER (reward >= 1.0) AS passed, avg((reward >= 1.0)::INT) AS rate, count(*) FILTER (tools <= 1) AS empty FROM t GROUP BY 1")
def a04_job_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = F.col("reward") >= 1.0
    return trials(spark, sf_dir).groupBy("run").agg(F.count("*").alias("n"), F.count_if(good).alias("passed"), F.avg(good.cast("int")).alias("rate"), F.count_if(F.col("tools") <= 1).alias("empty"))


@query(f"WITH {T} SELECT task_id, bool_or(reward > 0 AND run = 0) AS r0, bool_or(reward > 0 AND run = 1) AS r1, bool_or(reward > 0 AND run = 2) AS r2, bool_or(reward > 0) AS any_pass FROM t WHERE run < 3 GROUP BY 1")
def a05_pass_at_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trials(spark, sf_dir).filter("run < 3")
    return t.groupBy("task_id").agg(*(F.bool_or(passed() & (F.col("run") == i)).alias(f"r{i}") for i in range(3)), F.bool_or(passed()).alias("any_pass"))


def _miss(k: int) -> str:
    return f"CASE WHEN n - c < {k} THEN 1.0 WHEN c <= 0 THEN 0.0 ELSE 1 - list_reduce(list_transform(range(n - c + 1, n + 1), lambda i: 1 - {k} / i), lambda a, b: a * b) END"


@query(f"WITH {T}, g AS (SELECT task_id, count(*) AS n, count(*) FILTER (reward > 0) AS c FROM t GROUP BY 1) SELECT avg(c / n) AS p1, avg((c > 0)::INT) AS pn, avg({_miss(1)}) AS u1, avg({_miss(2)}) AS u2, avg({_miss(4)}) AS u4 FROM g")
def a06_pass_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = trials(spark, sf_dir).groupBy("task_id").agg(F.count("*").alias("n"), F.count_if(passed()).alias("c"))
    n, c = F.col("n"), F.col("c")
    return g.agg(F.avg(c / n).alias("p1"), F.avg((c > 0).cast("int")).alias("pn"), *(F.avg(O.pass_at_k(n, c, k)).alias(f"u{k}") for k in (1, 2, 4)))


@query(f"""WITH {T}, a AS (SELECT task_id, max(reward) AS s FROM t WHERE run = 0 GROUP BY 1), b AS (SELECT task_id, max(reward) AS s FROM t WHERE run = 1 GROUP BY 1),
  w AS (SELECT count(*) FILTER (b.s > a.s) AS wins, count(*) FILTER (b.s < a.s) AS losses, count(*) FILTER (a.s = b.s) AS ties FROM a JOIN b USING (task_id))
SELECT wins, losses, ties, (SELECT sum(exp(lgamma(wins + losses + 1) - lgamma(k + 1) - lgamma(wins + losses - k + 1) - (wins + losses) * ln(2))) FROM range(wins, wins + losses + 1) r(k)) AS p FROM w""")
def a07_sign_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = lambda df: df.groupBy("task_id").agg(F.max("reward").alias("score"))
    t = trials(spark, sf_dir)
    return O.paired(best(t.filter("run = 0")), best(t.filter("run = 1")))


@query(f"WITH {T} SELECT domain, count(*) FILTER (reward > 0) AS passed, count(*) AS total, avg((reward > 0)::INT) AS pass_rate FROM t GROUP BY ROLLUP (domain)")
def a08_a09_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.summary(trials(spark, sf_dir), "domain", passed())


@query(f"WITH {T} SELECT trial FROM t WHERE reward <= 0 AND elapsed > 0.99 * (SELECT max(elapsed) FROM t WHERE reward > 0)")
def a10_duration_skew(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.duration_skew(trials(spark, sf_dir), passed(), "elapsed", 0.99).select("trial")


@query("WITH r AS (SELECT n_chars, row_number() OVER (ORDER BY n_chars) - 1 AS i, count(*) OVER () AS n FROM documents) SELECT f AS fraction, n_chars FROM r, (VALUES (0.5), (0.9), (1.0)) v(f) WHERE i = least(n - 1, floor(n * f))")
def a11_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return O.nearest_rank(d, "n_chars", [0.5, 0.9, 1.0], d.count())


DESCRIBE = "SELECT '{0}' AS column, count({0}) AS n, avg({0}) AS mean, stddev_samp({0}) AS std, min({0})::DOUBLE AS min, quantile_cont({0}, 0.25)::DOUBLE AS p25, quantile_cont({0}, 0.5)::DOUBLE AS p50, quantile_cont({0}, 0.75)::DOUBLE AS p75, max({0})::DOUBLE AS max FROM "


@query(f"WITH c AS (SELECT conv_id, count(*) AS turns, sum(length(text))::BIGINT AS chars, coalesce(sum(length(text)) FILTER (role = 'user'), 0)::BIGINT AS prompt FROM conversations GROUP BY 1) " + " UNION ALL ".join(DESCRIBE.format(c) + "c" for c in ("turns", "chars", "prompt")))
def a12_a13_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text")
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum(n).alias("chars"), F.coalesce(F.sum(F.when(F.col("role") == "user", n)), F.lit(0)).alias("prompt"))
    return O.describe(c, ["turns", "chars", "prompt"])


@query("SELECT source, least(n_chars // 500, 20)::BIGINT AS bin, count(*) AS n FROM documents GROUP BY ALL")
def a14_a15_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source", F.least(F.floor(F.col("n_chars") / 500), F.lit(20)).alias("bin")).agg(F.count("*").alias("n"))


@query("SELECT source, count(*) AS initial, count(*) FILTER (n_chars > 300) AS final, sum(n_chars) FILTER (n_chars > 300)::BIGINT AS chars, sum(n_chars) FILTER (n_chars > 300) / sum(sum(n_chars) FILTER (n_chars > 300)) OVER () AS share FROM documents GROUP BY source")
def a16_a17_source_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = F.when(F.col("n_chars") > 300, F.col("n_chars"))
    g = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("initial"), F.count(kept).alias("final"), F.sum(kept).alias("chars"))
    total = g.agg(F.sum("chars").alias("total"))  # one row
    return g.crossJoin(F.broadcast(total)).select("source", "initial", "final", "chars", (F.col("chars") / F.col("total")).alias("share"))


@query("SELECT p_brand, round(avg(p_retailprice), 4) AS mean, round(coalesce(stddev_samp(p_retailprice), 0), 4) AS stddev, round(min(p_retailprice), 4) AS min, round(max(p_retailprice), 4) AS max FROM part GROUP BY 1")
def a18_mean_and_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.mean_and_spread(table(spark, sf_dir, "part"), ["p_brand"], "p_retailprice")


@query("SELECT l_returnflag AS kind, avg(l_quantity) AS mean, stddev_pop(l_quantity) AS std FROM lineitem GROUP BY 1")
def a19_reward_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("kind")).agg(F.avg("l_quantity").alias("mean"), F.stddev_pop("l_quantity").alias("std"))


@query("""WITH g AS (SELECT l_partkey, l_linenumber, stddev_pop(l_quantity) AS std FROM lineitem GROUP BY ALL HAVING stddev_pop(l_quantity) > 0)
SELECT l_partkey, l_linenumber, std FROM g QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY std DESC, l_linenumber) <= 2""")
def a20_prune_by_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.prune_by_spread(table(spark, sf_dir, "lineitem"), "l_partkey", "l_linenumber", "l_quantity", 2)


@query("SELECT conv_id, count(*) AS n, array_to_string(list(role ORDER BY turn), ',') AS roles FROM conversations GROUP BY 1")
def a21_grouped_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("t"))
    return g.select("conv_id", "n", F.array_join(F.transform("t", lambda x: x["role"]), ",").alias("roles"))


@query("SELECT c_nationkey, coalesce(max(c_name) FILTER (c_mktsegment = 'BUILDING'), '') AS building, coalesce(max(c_name) FILTER (c_mktsegment = 'MACHINERY'), '') AS machinery FROM customer GROUP BY 1")
def a22_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "customer").groupBy("c_nationkey").pivot("c_mktsegment", ["BUILDING", "MACHINERY"]).agg(F.max("c_name"))
    return p.select("c_nationkey", F.coalesce("BUILDING", F.lit("")).alias("building"), F.coalesce("MACHINERY", F.lit("")).alias("machinery"))


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, (l_quantity + l_discount * 100) / 2 AS score FROM lineitem), g AS (SELECT l_orderkey, count(*) AS n, max({'s': score, 'l': l_linenumber}) AS b, min({'s': score, 'l': l_linenumber}) AS w FROM s GROUP BY 1)
SELECT l_orderkey, b.l AS chosen, w.l AS rejected, b.s - w.s AS gap FROM g WHERE n >= 2 AND b.s > w.s AND b.s - w.s >= 5 AND b.s >= 15""")
def a23_a24_binarize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.binarize(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", (F.col("l_quantity") + F.col("l_discount") * 100) / 2, 5, 15)


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber) AS k FROM lineitem)
SELECT a.l_orderkey, a.l_linenumber AS chosen, b.l_linenumber AS rejected FROM r a JOIN r b ON a.l_orderkey = b.l_orderkey AND a.k = 1 AND b.k = 2""")
def a25_a26_rank_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("l_quantity")).alias("q"), "l_linenumber")))
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(ranked.alias("r")).filter(F.size("r") >= 2)  # the few lines of one order
    return g.select("l_orderkey", F.col("r")[0]["l_linenumber"].alias("chosen"), F.col("r")[1]["l_linenumber"].alias("rejected"))


@query("SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) = 1")
def a27_longest_per_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.best_per_parent(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "source", [F.desc("n_chars"), "doc_id"]).drop("n_chars")


@query("""WITH v AS (SELECT l_orderkey AS k, l_returnflag AS c, count(*) AS n, min(l_linenumber) AS f FROM lineitem GROUP BY ALL)
SELECT k, c, n AS votes FROM v QUALIFY row_number() OVER (PARTITION BY k ORDER BY n DESC, f, c DESC) = 1""")
def a28_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_returnflag").alias("c"), "l_linenumber")
    return O.majority(votes, "k", "c", "l_linenumber")


@query("SELECT event_type, avg(json_extract(props, '$.k')::DOUBLE / 100) AS metric FROM events GROUP BY 1")
def a29_metric_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.avg(F.get_json_object("props", "$.k").cast("double") / 100).alias("metric"))


@query(f"""WITH {T}, r AS (SELECT task_id, run AS round, max(reward) > 0 AS passed FROM t GROUP BY ALL), f AS (SELECT *, (lag(passed) OVER (PARTITION BY task_id ORDER BY round) <> passed)::INT AS flip FROM r)
SELECT task_id, max(CASE WHEN round = 0 THEN CASE WHEN passed THEN 'T' ELSE 'F' END END) AS r0, max(CASE WHEN round = 1 THEN CASE WHEN passed THEN 'T' ELSE 'F' END END) AS r1, count(*) FILTER (NOT passed) AS fails, coalesce(sum(flip), 0)::BIGINT AS flips FROM f GROUP BY 1""")
def a30_task_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rounds = trials(spark, sf_dir).groupBy("task_id", F.col("run").alias("round")).agg((F.max("reward") > 0).alias("passed"))
    return O.task_matrix(rounds, [0, 1])


@query(f"""WITH {T} SELECT task_id, avg((reward > 0)::INT) AS pass_rate, floor(median(tools))::BIGINT AS steps, floor(median(elapsed))::BIGINT AS seconds, count(*) FILTER (NOT ok) * 100.0 / count(*) AS error_pct, count(*) FILTER (tools >= 48) AS near_limit FROM t GROUP BY 1""")
def a32_task_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trials(spark, sf_dir).groupBy("task_id").agg(F.avg(passed().cast("int")).alias("pass_rate"), F.floor(F.median("tools")).alias("steps"), F.floor(F.median("elapsed")).alias("seconds"), (F.count_if(~F.col("ok")) * 100.0 / F.count("*")).alias("error_pct"), F.count_if(F.col("tools") >= 48).alias("near_limit"))


@query(f"WITH {T} SELECT CASE WHEN NOT ok THEN 'error' WHEN reward <= 0 THEN 'failed' WHEN tools > 40 THEN 'too_long' ELSE 'kept' END AS reason, count(*) AS n FROM t GROUP BY 1")
def a33_drop_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = F.when(~F.col("ok"), "error").when(~passed(), "failed").when(F.col("tools") > 40, "too_long").otherwise("kept")
    return trials(spark, sf_dir).groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query(f"WITH {T} SELECT run % 2 AS arm, count(DISTINCT task_id) AS tasks, avg(reward) AS rate, max(elapsed) AS slowest, avg(reward) > 0.4 AS learning FROM t GROUP BY 1")
def a34_a35_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trials(spark, sf_dir).groupBy((F.col("run") % 2).alias("arm")).agg(F.countDistinct("task_id").alias("tasks"), F.avg("reward").alias("rate"), F.max("elapsed").alias("slowest"), (F.avg("reward") > 0.4).alias("learning"))


@query("SELECT user_id, count(*) FILTER (event_type = 'click') AS calls, count(*) FILTER (event_type = 'error') AS errors, sum(value) AS cost, arg_max(event_type, (ts, event_id)) AS exit_reason FROM events GROUP BY 1")
def a36_a38_episode_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    is_ = lambda k: F.col("event_type") == k
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(is_("click")).alias("calls"), F.count_if(is_("error")).alias("errors"), F.sum("value").alias("cost"), F.max_by("event_type", F.struct("ts", "event_id")).alias("exit_reason"))


@query("SELECT unnest([10, 25, 50, 75, 90, 95, 99]) AS p, unnest(quantile_cont(n_chars, [0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]))::DOUBLE AS v FROM documents")
def a37_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = [10, 25, 50, 75, 90, 95, 99]
    row = table(spark, sf_dir, "documents").agg(F.percentile("n_chars", F.array(*(F.lit(p / 100) for p in points))).alias("q"))
    return row.select(F.explode(F.arrays_zip(F.array(*map(F.lit, points)).alias("p"), F.col("q").alias("v"))).alias("z")).select("z.p", "z.v")


@query("SELECT count(DISTINCT n) = 1 AS complete, min(n) AS least, max(n) AS most FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)")
def a31_a39_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return n.agg((F.min("n") == F.max("n")).alias("complete"), F.min("n").alias("least"), F.max("n").alias("most"))


@query("""SELECT DISTINCT o_orderstatus || o_orderpriority || o_custkey % 13 AS task FROM orders WHERE o_custkey % 10 <> 0 AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def a31_m19_selected_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    orders = table(spark, sf_dir, "orders").join(taken, "o_orderkey", "left_anti")
    corpora = orders.groupBy("o_custkey").agg(F.to_json(F.struct(F.collect_list(F.concat("o_orderstatus", "o_orderpriority", F.col("o_custkey") % 13)).alias("selected_tasks"))).alias("summary"))
    return O.selected_tasks(corpora.select(F.when(F.col("o_custkey") % 10 == 0, "{broken").otherwise(F.col("summary")).alias("summary")), "summary")
