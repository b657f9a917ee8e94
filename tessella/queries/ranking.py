"""Queries of ranking, deduplication and sequence windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import ranking as R
from tessella.operators.sequences import next_fit, prefix_within
from tessella.queries import query, table
from tessella.queries.aggregates import T, passed, trials


@query(f"""WITH {T}, s AS (SELECT *, md5(run || '-' || tools) AS sig FROM t), a AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY task_id, sig ORDER BY reward DESC, tools, trial, elapsed) = 1)
SELECT task_id, trial FROM a QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY reward DESC, tools, trial, elapsed) <= 2""")
def w01_w02_top_per_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    sig = F.md5(F.concat_ws("-", F.col("run").cast("string"), F.col("tools").cast("string")))
    return R.top_per_task(trials(spark, sf_dir), "task_id", sig, [F.desc("reward"), "tools", "trial", "elapsed"], 2).select("task_id", "trial")


@query("SELECT min(conv_id * 100 + turn) AS id, count(*) AS n FROM conversations GROUP BY role, text[:240]")
def w03_pair_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").withColumn("id", F.col("conv_id") * 100 + F.col("turn"))
    return rows.groupBy("role", F.substring("text", 1, 240)).agg(F.min("id").alias("id"), F.count("*").alias("n")).select("id", "n")


@query("SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY sha256(lang || chr(1) || text) ORDER BY doc_id) = 1")
def w04_exact_pair_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.concat("lang", F.lit("\x01"), "text"), 256).alias("h"))
    return R.first_of(d, ["h"], ["doc_id"]).select("doc_id")


@query(f"""WITH {T}, g AS (SELECT task_id, count(*) AS n, count(*) FILTER (reward > 0) AS c FROM t GROUP BY 1)
SELECT task_id FROM g WHERE c > 0 AND c < n AND task_id % 10 <> 0 ORDER BY CASE WHEN n < 20 THEN 1 ELSE 0 END, abs(c / n - 0.5), n DESC, task_id LIMIT 50""")
def w05_rl_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.operators.outcomes import band

    g = trials(spark, sf_dir).groupBy("task_id").agg(F.count("*").alias("n"), F.count_if(passed()).alias("c"))
    pool = g.filter((F.col("c") > 0) & (F.col("c") < F.col("n")) & (F.col("task_id") % 10 != 0))
    order = F.when(band(F.col("n"), F.col("c"), 20) == "split", 0).otherwise(1)
    return pool.orderBy(order, F.abs(F.col("c") / F.col("n") - 0.5), F.desc("n"), "task_id").limit(50).select("task_id")


@query(f"""WITH {T}, b AS (SELECT *, CASE run % 3 WHEN 0 THEN 'evolve' WHEN 1 THEN 'fulleval' ELSE 'other' END AS bucket, tools % 4 AS recovered FROM t)
SELECT trial, run, tools, elapsed, reward + CASE bucket WHEN 'evolve' THEN 0.35 WHEN 'fulleval' THEN 0.10 ELSE 0.0 END + greatest(0.0, 0.25 - 0.005 * tools) - CASE WHEN tools > 0 THEN 0.15 * recovered / tools ELSE 0.0 END AS quality,
  reward + CASE WHEN tools < 8 THEN -0.20 * (8 - tools) / 8.0 WHEN tools <= 20 THEN 0.10 * (tools - 8) / 12.0 ELSE -0.40 * least(tools - 20, 40) / 40.0 END
  + CASE WHEN elapsed > 0 THEN CASE WHEN elapsed <= 180 THEN 0.10 * (1 - elapsed / 180.0) WHEN elapsed <= 400 THEN -0.05 * (elapsed - 180) / 220.0 ELSE -(0.20 + 0.10 * least(elapsed - 400, 600.0) / 600.0) END ELSE 0.0 END AS compact FROM b""")
def w06_w07_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    bucket = F.when(c("run") % 3 == 0, "evolve").when(c("run") % 3 == 1, "fulleval").otherwise("other")
    return trials(spark, sf_dir).select("trial", "run", "tools", "elapsed", R.quality_score(c("reward"), bucket, c("tools"), c("tools") % 4).alias("quality"), R.compact_score(c("reward"), c("tools"), c("elapsed")).alias("compact"))


@query("""WITH k AS (SELECT *, count(*) FILTER (role = 'assistant' AND length(trim(text)) >= 4) OVER (PARTITION BY conv_id ORDER BY turn) AS k, string_agg(role || ': ' || text, chr(10) || chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prompt FROM conversations)
SELECT conv_id, turn, md5(coalesce(prompt, '')) AS prompt, length(text) AS n FROM k WHERE role = 'assistant' AND length(trim(text)) >= 4 AND k <= 2""")
def w08_turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.turn_pairs(table(spark, sf_dir, "conversations"), 2).select("conv_id", "turn", F.md5("prompt").alias("prompt"), F.length("response").alias("n"))


@query("SELECT doc_id, c AS copy FROM documents, range(1, 5) t(c) WHERE c <= least(greatest(round_even(n_chars / 1000.0, 0), 1), 4)")
def w09_oversample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.oversample(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), F.col("n_chars") / 1000.0).select("doc_id", F.col("copy").cast("long").alias("copy"))


EV = "e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events)"
ORDER = ["ts", "event_id"]


@query(f"WITH {EV}, c AS (SELECT *, min(CASE WHEN event_type = 'error' THEN pos END) OVER (PARTITION BY user_id) AS critical FROM e) SELECT event_id, pos, critical FROM c WHERE pos >= critical - 4")
def w10_recovery_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.recovery_slice(table(spark, sf_dir, "events"), "user_id", ORDER, F.col("event_type") == "error").select("event_id", F.col("pos").cast("long").alias("pos"), F.col("critical").cast("long").alias("critical"))


@query("WITH s AS (SELECT *, count(*) FILTER (event_type = 'click') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS segment FROM events) SELECT user_id, segment, NOT bool_or(event_type = 'error') AS safe FROM s WHERE segment > 0 GROUP BY ALL")
def w11_safe_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.safe_prefix(table(spark, sf_dir, "events"), "user_id", ORDER, F.col("event_type") == "click", F.col("event_type") == "error")


@query("SELECT min(event_id) AS event_id, count(*) AS n FROM events GROUP BY user_id, event_type, props[:200]")
def w12_copy_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type", F.substring("props", 1, 200)).agg(F.min("event_id").alias("event_id"), F.count("*").alias("n")).select("event_id", "n")


LOOP = f"""WITH {EV}, i AS (SELECT *, pos - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS isle FROM e),
  s AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, isle ORDER BY ts, event_id) AS streak FROM i)
SELECT event_id, streak, CASE WHEN streak >= 5 THEN 'stop' WHEN streak >= 3 THEN 'warn' ELSE 'ok' END AS level FROM s"""


@query(LOOP)
def w13_loop_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.repeated_runs(table(spark, sf_dir, "events"), "user_id", ORDER, "event_type").select("event_id", F.col("streak").cast("long").alias("streak"), "level")


@query("WITH n AS (SELECT event_id, (row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1) % 6 + 1 AS count FROM events) SELECT event_id, count, CASE WHEN count = 6 THEN 'hard' WHEN count >= 3 THEN 'soft' END AS hint FROM n")
def w14_edit_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.edit_hints(table(spark, sf_dir, "events"), "user_id", "event_type", ORDER, 3, 6).select("event_id", F.col("count").cast("long").alias("count"), "hint")


@query("WITH s AS (SELECT event_id, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS spent FROM events) SELECT event_id, CASE WHEN spent >= 500 THEN 'stop' WHEN spent >= 400 THEN 'warn' ELSE 'ok' END AS state FROM s")
def w16_budget_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.budget_stop(table(spark, sf_dir, "events"), "user_id", ORDER, "value", 500).select("event_id", "state")


@query("""WITH s AS (SELECT conv_id, turn, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos, first_value(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS f, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS later FROM conversations)
SELECT conv_id, turn FROM s WHERE pos = 1 OR later + f <= 1500""")
def w17_trim_to_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.trim_to_budget(table(spark, sf_dir, "conversations"), F.length("text"), 1500).select("conv_id", "turn")


@query("""SELECT conv_id, turn, CASE WHEN role = 'system' AND turn = min(turn) OVER w THEN 'system' WHEN role = 'user' AND turn = max(turn) OVER w THEN 'active' ELSE 'history' END AS part
FROM conversations WINDOW w AS (PARTITION BY conv_id)""")
def w18_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.windows_of(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "part")


@query("WITH s AS (SELECT doc_id, sum(n_chars) OVER w AS total, row_number() OVER w AS pos FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING)) SELECT doc_id FROM s WHERE total <= 20000 OR pos = 1")
def w19_prefix_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_within(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "source", ["doc_id"], "n_chars", 20000).select("doc_id")


_NEXT_FIT = """WITH RECURSIVE d AS (SELECT source, doc_id, n_chars AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i, {cap} AS cap FROM documents),
  f AS (SELECT source, i, doc_id, n AS held, 0::BIGINT AS pack FROM d WHERE i = 1 UNION ALL
    SELECT d.source, d.i, d.doc_id, CASE WHEN f.held > 0 AND f.held + d.n > d.cap THEN d.n ELSE f.held + d.n END, f.pack + (f.held > 0 AND f.held + d.n > d.cap)::BIGINT FROM f JOIN d ON d.source = f.source AND d.i = f.i + 1)
SELECT doc_id, pack FROM f"""


@query(_NEXT_FIT.format(cap=8000))
def w20_next_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return next_fit(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "source", ["doc_id"], "n_chars", 8000).select("doc_id", "pack")


@query(_NEXT_FIT.format(cap="CASE WHEN sum(n_chars) OVER (PARTITION BY source) > 0 THEN least((sum(n_chars) OVER (PARTITION BY source) // 40)::BIGINT, 16000) ELSE 16000 END"))
def w20_least_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return next_fit(rows, "source", ["doc_id"], "n_chars", 16000, min_packs=40).select("doc_id", "pack")


@query("""WITH RECURSIVE d AS (SELECT conv_id, turn, length(text) + 6 AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) // 2 AS pairs FROM conversations),
  p AS (SELECT conv_id, i // 2 AS p, pairs, sum(n)::BIGINT AS n FROM d WHERE i < 2 * pairs GROUP BY ALL),
  f AS (SELECT conv_id, p, CASE WHEN n > 900 THEN 2 ELSE 0 END::BIGINT AS start, n AS held, CASE WHEN n > 900 OR pairs = 1 THEN 0 END::BIGINT AS a, CASE WHEN n > 900 THEN 0 WHEN pairs = 1 THEN 2 END::BIGINT AS b FROM p WHERE p = 0
    UNION ALL SELECT p.conv_id, p.p, CASE WHEN f.held + p.n > 900 THEN 2 * p.p + CASE WHEN p.n > 900 THEN 2 ELSE 0 END ELSE f.start END, CASE WHEN f.held + p.n > 900 THEN p.n ELSE f.held + p.n END,
      CASE WHEN f.held + p.n > 900 OR p.p = p.pairs - 1 THEN f.start END, CASE WHEN f.held + p.n > 900 THEN 2 * p.p WHEN p.p = p.pairs - 1 THEN 2 * p.p + 2 END FROM f JOIN p ON p.conv_id = f.conv_id AND p.p = f.p + 1)
SELECT d.conv_id, d.turn, f.a AS piece FROM d JOIN f ON f.conv_id = d.conv_id AND d.i >= f.a AND d.i < f.b""")
def w21_split_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("n"))
    return R.split_conversations(rows, "n", 900).select("conv_id", "turn", "piece")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, value AS r, value / 2 AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS i FROM events),
  f AS (SELECT user_id, i, event_id, v, r - v AS a FROM e WHERE i = 1 UNION ALL SELECT e.user_id, e.i, e.event_id, e.v, e.r + 0.99 * f.v - e.v + 0.99 * 0.95 * f.a FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
SELECT event_id, a AS advantage FROM f""")
def w22_gae(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "value"))).alias("e"))  # one episode
    r, v = F.transform("e", lambda x: x["value"]), F.transform("e", lambda x: x["value"] / 2)
    out = g.select("e", r.alias("r"), v.alias("v")).select("e", F.explode(F.array(R.gae(F.col("r"), F.col("v"), 0.99, 0.95))).alias("a"))
    return out.select(F.explode(F.arrays_zip(F.transform("e", lambda x: x["event_id"]).alias("event_id"), F.col("a").alias("advantage"))).alias("z")).select("z.event_id", "z.advantage")


@query("SELECT user_id, coalesce(sum(value * (event_type = 'purchase')::INT) / nullif(count(*) FILTER (event_type = 'purchase'), 0), 0) AS mean FROM events GROUP BY 1")
def w23_masked_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(R.masked_mean(F.col("value"), (F.col("event_type") == "purchase").cast("int")).alias("mean"))


@query("SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT - length(text) AS start, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position FROM conversations")
def w24_position_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.length("text")).alias("start"), (F.row_number().over(w) - 1).cast("long").alias("position"))


def candidates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(run, task_id) solved, and each run's mean, number of scores and round."""
    t = trials(spark, sf_dir)
    return t.filter(passed()).select("run", "task_id").distinct(), t.groupBy("run").agg(F.avg("reward").alias("mean"), F.count("*").alias("scores"), F.first(F.col("run") % 3).alias("round"))


PARENTS = f"""{T}, s AS (SELECT DISTINCT run, task_id FROM t WHERE reward > 0), m AS (SELECT run, avg(reward) AS mean, count(*) AS scores, any_value(run % 3) AS round, count(DISTINCT task_id) FILTER (reward > 0) AS n FROM t GROUP BY 1),
  sh AS (SELECT a.run AS x, b.run AS y, count(*) AS common FROM s a JOIN s b USING (task_id) WHERE a.run <> b.run GROUP BY ALL),
  d AS (SELECT a.run AS x, b.run AS y, CASE WHEN a.n = 0 OR b.n = 0 THEN 0 ELSE 1 - coalesce(common, 0) / sqrt(a.n * b.n) END AS d FROM m a JOIN m b ON a.run <> b.run LEFT JOIN sh ON sh.x = a.run AND sh.y = b.run),
  v AS (SELECT x AS run, avg(d) AS novelty FROM (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY x ORDER BY d, y) <= 3) GROUP BY 1),
  k AS (SELECT *, mean * sqrt(novelty) AS pn, row_number() OVER (ORDER BY mean * sqrt(novelty) DESC, run) AS place FROM m JOIN v USING (run))"""


@query(f"WITH {PARENTS} SELECT run, place, round(novelty, 9) AS novelty FROM k")
def w25_parent_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.parent_ranks(*candidates(spark, sf_dir), "run", "task_id").select("run", "place", F.round("novelty", 9).alias("novelty"))


@query(f"""WITH {PARENTS}, i AS (SELECT run FROM m ORDER BY mean DESC, scores, run LIMIT 1), u AS (SELECT run, count(*) AS gained FROM s WHERE task_id NOT IN (SELECT task_id FROM s WHERE run IN (FROM i)) GROUP BY 1),
  c AS (SELECT run, 0 AS g, 0.0 AS o FROM (SELECT run FROM k ORDER BY novelty DESC, run LIMIT 1) UNION ALL SELECT run, 1, -mean FROM m WHERE mean >= (SELECT max(mean) FROM m) - 0.002
    UNION ALL SELECT run, 2, -gained FROM m JOIN u USING (run) WHERE round = (SELECT max(round) FROM m)),
  f AS (SELECT run, min((g, o)) AS m FROM c GROUP BY 1)
SELECT * FROM (SELECT run, row_number() OVER (ORDER BY m, run) AS place FROM f) WHERE place <= 4""")
def w26_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.select_parents(*candidates(spark, sf_dir), "run", "task_id", turn=3, tie=0.002)


@query(f"""WITH {T}, b AS (SELECT task_id, max(reward) > 0 AS p FROM t WHERE run = 0 GROUP BY 1), c AS (SELECT run, task_id, max(reward) > 0 AS p FROM t WHERE run > 0 GROUP BY ALL)
SELECT run, count(*) FILTER (c.p AND NOT b.p) AS gained, count(*) FILTER (b.p AND NOT c.p) AS regressed, count(*) FILTER (c.p AND NOT b.p) - 2.0 * count(*) FILTER (b.p AND NOT c.p) AS net FROM c JOIN b USING (task_id) GROUP BY run""")
def w27_w28_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trials(spark, sf_dir)
    b = t.filter("run = 0").groupBy("task_id").agg((F.max("reward") > 0).alias("b"))
    c = t.filter("run > 0").groupBy("run", "task_id").agg((F.max("reward") > 0).alias("c"))
    g = c.join(b, "task_id").groupBy("run").agg(F.count_if(F.col("c") & ~F.col("b")).alias("gained"), F.count_if(F.col("b") & ~F.col("c")).alias("regressed"))
    return g.withColumn("net", F.col("gained") - 2.0 * F.col("regressed"))


@query(f"""WITH {T}, s AS (SELECT run, list(DISTINCT task_id) AS d FROM t WHERE reward > 0 GROUP BY 1)
SELECT a.run AS x, b.run AS y FROM s a JOIN s b ON a.run < b.run WHERE NOT list_has_all(b.d, a.d) AND NOT list_has_all(a.d, b.d)""")
def w29_complementary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.complementary_by_items(trials(spark, sf_dir).filter(passed()), "run", "task_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0) QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) = 1")
def w30_structural_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("h")).join(table(spark, sf_dir, "labels").filter("quality = 0"), "doc_id", "left_anti")
    return R.first_of(d, ["h"], ["doc_id"]).select("doc_id")


@query("""WITH s AS (SELECT user_id, event_id // 200 AS step, count(*) FILTER (event_type = 'error') AS n FROM events GROUP BY ALL), p AS (SELECT user_id, step, coalesce(lag(n) OVER (PARTITION BY user_id ORDER BY step), 0) AS pending FROM s)
SELECT user_id, step, pending, pending >= 3 AS warned FROM p""")
def w15_failure_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = table(spark, sf_dir, "events").withColumn("step", F.floor(F.col("event_id") / 200))
    return R.failure_guard(calls, "user_id", "step", F.col("event_type") == "error")


@query("""WITH s AS (SELECT user_id, event_id // 2000 AS step, count(*) FILTER (event_type <> 'error') AS good, count(*) FILTER (event_type = 'error') AS bad FROM events GROUP BY ALL),
  d AS (SELECT user_id, user_id % 3 - 1 AS t, good * 0.05 - bad * 0.1 - CASE WHEN user_id % 4 = 0 AND step = max(step) OVER (PARTITION BY user_id) THEN 0.2 ELSE 0 END AS d FROM s),
  g AS (SELECT user_id, t, t + least(sum(greatest(d, 0)), 0.3) - least(sum(greatest(-d, 0)), 0.5) AS r FROM d GROUP BY user_id, t)
SELECT user_id, round(CASE WHEN t < 0 THEN greatest(-1.1, least(-0.6, r)) ELSE r END, 6)::DOUBLE AS reward FROM g""")
def w31_shaped_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("step", F.floor(F.col("event_id") / 2000))
    steps = e.groupBy("user_id", "step").agg(F.count_if(F.col("event_type") != "error").alias("successes"), F.count_if(F.col("event_type") == "error").alias("failures"))
    steps = steps.withColumns({"looped": F.col("user_id") % 4 == 0, "terminal": (F.col("user_id") % 3 - 1).cast("double")})
    return R.shaped_reward(steps, "user_id", "step", "terminal").withColumn("reward", F.round("reward", 6))


@query(f"""WITH RECURSIVE {T}, s AS (SELECT DISTINCT run, task_id FROM t WHERE reward > 0), g AS (SELECT run AS round, run % 5 AS config, CASE WHEN run <> 3 THEN round(avg(reward), 12) END AS score FROM t GROUP BY run),
  bar AS (SELECT a.config, b.round, avg(a.score) AS bar FROM g a JOIN g b ON a.round < b.round WHERE a.score IS NOT NULL GROUP BY ALL),
  u AS (SELECT a.run AS x, b.run AS y, count(*) FILTER (NOT EXISTS (SELECT 1 FROM s z WHERE z.run = b.run AND z.task_id = a.task_id)) AS gained FROM s a, (SELECT DISTINCT run FROM s) b WHERE a.run <> b.run GROUP BY ALL),
  r(round, verdict, best, config) AS (SELECT round, CASE WHEN score IS NULL THEN 'skip' ELSE 'accept' END, CASE WHEN score IS NOT NULL THEN round END, CASE WHEN score IS NOT NULL THEN config END FROM g WHERE round = 0
    UNION ALL SELECT g.round, CASE WHEN score IS NULL THEN 'skip' WHEN r.best IS NULL OR score >= bar - 0.001 THEN 'accept' WHEN gained > 0 THEN 'pivot' ELSE 'reject' END,
      CASE WHEN score IS NOT NULL AND (r.best IS NULL OR score >= bar) THEN g.round ELSE r.best END, CASE WHEN score IS NOT NULL AND (r.best IS NULL OR score >= bar) THEN g.config ELSE r.config END
    FROM r JOIN g ON g.round = r.round + 1 LEFT JOIN bar ON bar.config = r.config AND bar.round = g.round LEFT JOIN u ON u.x = g.round AND u.y = r.best)
SELECT 0 AS campaign, round, verdict, best AS best_round FROM r""")
def w32_regression_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trials(spark, sf_dir)
    score = F.when(F.col("run") != 3, F.round(F.avg("reward"), 12))
    rounds = t.groupBy("run").agg(score.alias("score")).join(R.unique_counts(t.filter(passed()), "run", "task_id"), "run", "left")
    return R.regression_gate(rounds.select(F.lit(0).alias("campaign"), F.col("run").alias("round"), (F.col("run") % 5).alias("config"), "score", "unique"), "campaign", 0.001)


@query("""WITH d AS (SELECT q.vec_id, o.vec_id AS o, 1 - list_cosine_similarity(q.embedding::DOUBLE[], o.embedding::DOUBLE[]) AS d FROM embeddings q JOIN embeddings o ON q.vec_id <> o.vec_id WHERE q.vec_id % 100 = 0)
SELECT vec_id, avg(d) AS novelty FROM (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, o) <= 5) GROUP BY 1""")
def r06_r07_j11_knn_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return R.knn_novelty(e, "vec_id", "embedding", e.filter("vec_id % 100 = 0"), 5)


@query("""WITH m AS (SELECT event_id, user_id, ts, CASE WHEN event_type = 'click' THEN 'assistant' WHEN event_type = 'purchase' THEN 'user' ELSE 'tool' END AS role, event_type AS id, floor(value)::BIGINT AS n FROM events),
  p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM m),
  h AS (SELECT *, max(CASE WHEN role <> 'tool' THEN pos END) OVER (PARTITION BY user_id ORDER BY pos) AS head FROM p),
  b AS (SELECT h.*, max(CASE WHEN h.role = 'tool' AND h.id NOT IN ('view', 'signup') THEN h.pos END) OVER (PARTITION BY h.user_id ORDER BY h.pos) AS stray, q.role AS head_role FROM h LEFT JOIN p q ON q.user_id = h.user_id AND q.pos = h.head),
  g AS (SELECT *, CASE WHEN role = 'tool' AND head_role = 'assistant' AND head > 1 AND coalesce(stray, 0) < head THEN head ELSE pos END AS grp FROM b),
  s AS (SELECT user_id, grp, sum(n) AS n FROM g GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY grp DESC) AS later, first_value(n) OVER (PARTITION BY user_id ORDER BY grp) AS f FROM s)
SELECT event_id FROM g JOIN t USING (user_id, grp) WHERE pos = 1 OR later + f <= 4000""")
def w16_w17_trim_with_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    role = F.when(kind == "click", "assistant").when(kind == "purchase", "user").otherwise("tool")
    calls = F.when(kind == "click", F.array(F.lit("view"), F.lit("signup")))
    turns = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", role.alias("role"), calls.alias("calls"), kind.alias("call_id"), F.floor("value").alias("n"))
    return R.trim_at_ratio(turns, "user_id", ORDER, "n", 5000).select("event_id")


@query(f"""WITH {T}, b AS (SELECT task_id, max(reward) > 0 AS p FROM t WHERE run = 0 GROUP BY 1), c AS (SELECT run, task_id, max(reward) > 0 AS p FROM t WHERE run > 0 GROUP BY ALL),
  x AS (SELECT idx, b.task_id, b.p AS parent, coalesce(c.p, false) AS own, idx < 8 AS probed FROM range(1, 9) r(idx) CROSS JOIN b LEFT JOIN c ON c.run = idx AND c.task_id = b.task_id),
  s AS (SELECT idx, CASE WHEN bool_and(probed) THEN count(*) FILTER (own AND NOT parent) END AS gained, CASE WHEN bool_and(probed) THEN count(*) FILTER (parent AND NOT own) END AS regressed, CASE WHEN bool_and(probed) THEN count(*) FILTER (own) / count(*) END AS score FROM x GROUP BY 1),
  d AS (SELECT *, coalesce(regressed > 0.93 * (SELECT count(*) FROM b WHERE p), false) AS broke FROM s)
SELECT idx, gained, regressed, score, CASE WHEN broke THEN 'regressed' WHEN row_number() OVER (PARTITION BY broke ORDER BY coalesce(score, -1) DESC, idx) <= 2 THEN 'kept' ELSE 'cut' END AS outcome FROM d""")
def w27_mini_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trials(spark, sf_dir)
    probes = t.filter("run = 0").groupBy(F.col("task_id").alias("task")).agg((F.max("reward") > 0).alias("parent"))
    results = t.filter("run > 0").select(F.col("run").cast("long").alias("idx"), F.col("task_id").alias("task"), (F.col("reward") > 0).alias("solved"))
    most = int(0.93 * probes.filter("parent").count())
    return R.mini_eval(spark.range(1, 9).toDF("idx"), results, probes, most, 2)


@query("""WITH k AS (SELECT DISTINCT md5(text) AS h FROM documents JOIN labels USING (doc_id) WHERE quality = 0), d AS (SELECT doc_id, md5(text) AS h, text IS NULL OR text = '' AS empty FROM documents)
SELECT doc_id, CASE WHEN empty THEN 'empty' WHEN h IN (SELECT h FROM k) THEN 'rejected' WHEN doc_id > (SELECT min(o.doc_id) FROM d o WHERE o.h = d.h AND NOT o.empty) THEN 'duplicate' ELSE 'kept' END AS outcome FROM d""")
def w30_screen_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    known = docs.join(table(spark, sf_dir, "labels").filter("quality = 0").select("doc_id"), "doc_id", "left_semi").select(F.md5("text").alias("signature"))
    return R.structural_screen(docs, known, "doc_id", F.md5("text"), F.col("text").isNull() | (F.col("text") == ""))


@query("""WITH p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, coalesce(length(text), 0) + 10 AS n FROM conversations),
  c AS (SELECT conv_id, coalesce(min(pos) FILTER (role = 'user' AND pos > 1), 1) AS critical FROM p GROUP BY 1),
  b AS (SELECT p.*, critical, coalesce((SELECT sum(n) FROM p o WHERE o.conv_id = p.conv_id AND o.pos < p.pos), 0) AS before, coalesce((SELECT sum(n) FROM p o WHERE o.conv_id = p.conv_id AND o.pos < p.pos AND o.pos >= critical - 4), 0) AS near FROM p JOIN c USING (conv_id)),
  f AS (SELECT conv_id, pos AS turn_index, CASE WHEN before + n <= 2000 THEN 0 ELSE greatest(critical - 4, 0) END AS context_from, CASE WHEN before + n <= 2000 THEN before ELSE near END + n AS chars FROM b WHERE role = 'assistant' AND pos > critical AND length(trim(text)) >= 4 AND least(before, near) + n <= 2000)
SELECT conv_id, turn_index, context_from, chars::BIGINT AS chars FROM f QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn_index) <= 2""")
def w10_recovery_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    turns = table(spark, sf_dir, "conversations").withColumn("n", F.coalesce(F.length("text"), F.lit(0)) + 10)
    pos = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    critical = F.coalesce(F.min(F.when((F.col("role") == "user") & (F.col("pos") > 1), F.col("pos"))).over(Window.partitionBy("conv_id")), F.lit(1))
    pairs = R.recovery_pairs(turns.withColumn("pos", pos).withColumn("critical", critical), "conv_id", ["turn"], "n", F.col("text"), "critical", 2, 2000)
    return pairs.select("conv_id", *(F.col(c).cast("long").alias(c) for c in ("turn_index", "context_from", "chars")))


@query("""WITH c AS (SELECT event_id, user_id, ts, CASE WHEN event_type <> 'error' THEN event_type || floor(value / 400)::BIGINT ELSE '' END AS fp, event_type IN ('click', 'view', 'signup') AS name, length(props) AS m FROM events),
  l AS (SELECT *, lag(fp) OVER w AS lf, lag(name) OVER w AS ln, lag(m) OVER w AS lm, row_number() OVER w AS pos FROM c WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  s AS (SELECT *, fp = '' OR coalesce(lf, '') = '' OR lm - m >= 2 AS broken FROM l),
  i AS (SELECT *, max(CASE WHEN broken OR fp <> lf THEN pos END) OVER w AS a, max(CASE WHEN broken OR name <> ln THEN pos END) OVER w AS b FROM s WINDOW w AS (PARTITION BY user_id ORDER BY pos)),
  r AS (SELECT event_id, CASE WHEN fp = '' THEN 0 ELSE least(pos - a + 1, 13) END AS streak, CASE WHEN fp = '' THEN 0 ELSE least(pos - b + 1, 13) END AS name_streak FROM i)
SELECT *, CASE WHEN streak >= 5 THEN 'stop' WHEN streak >= 3 THEN 'warn' WHEN name_streak >= 8 THEN 'name' ELSE 'ok' END AS level FROM r""")
def w13_loop_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    fp = F.when(kind != "error", F.concat(kind, F.floor(F.col("value") / 400).cast("string"))).otherwise("")
    calls = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", fp.alias("fp"), kind.isin("click", "view", "signup").cast("string").alias("name"), F.length("props").alias("m"))
    found = R.loop_levels(calls, "user_id", ORDER, "fp", "name", "m", drop=2)
    return found.select("event_id", F.col("streak").cast("long").alias("streak"), F.col("name_streak").cast("long").alias("name_streak"), "level")


@query("""WITH p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM events),
  a AS (SELECT user_id, pos, n, coalesce(lead(pos) OVER (PARTITION BY user_id ORDER BY pos), n) AS stop FROM p WHERE event_type = 'click'),
  f AS (SELECT a.user_id, a.pos FROM a JOIN p ON p.user_id = a.user_id AND p.pos > a.pos AND p.pos < a.stop AND p.event_type IN ('view', 'error') WHERE a.pos < greatest(1, floor(a.n * 0.4)) GROUP BY ALL HAVING count(*) FILTER (event_type = 'error') = 0)
SELECT user_id, pos AS turn_index FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY pos) <= 3""")
def w11_safe_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    role = F.when(kind == "click", "assistant").when(kind.isin("view", "error"), "tool").otherwise("user")
    turns = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "props", role.alias("role"), F.when(kind == "click", F.array("props")).alias("calls"))
    return R.safe_turns(turns, "user_id", ORDER, kind == "error", F.col("props"), 0.4, 3).select("user_id", F.col("turn_index").cast("long").alias("turn_index"))
