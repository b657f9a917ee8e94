"""Queries of the sources: written and read again where a format is the point."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.retrieval import relevant_lines
from tessella.sources import files as S
from tessella.plans.tables import shared_folder
from tessella.queries import query, table


@query("SELECT doc_id, lang, n_chars FROM documents")
def src01_snk01_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark)
    S.write_jsonl(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), path)
    return S.read_jsonl(spark, path, "doc_id long, lang string, n_chars long").drop("_bad")


@query("SELECT doc_id AS id, quality FROM labels UNION ALL SELECT item_id, NULL FROM benchmark")
def src02_src04_parquet_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark)
    table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality").write.parquet(f"{path}/a")
    table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id")).write.parquet(f"{path}/b")
    return S.read_many(spark, [f"{path}/a", f"{path}/b"])


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def src08_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark)
    S.write_tsv(table(spark, sf_dir, "nation"), path)
    return S.read_tsv(spark, path, "n_nationkey int, n_name string, n_regionkey int")


@query("SELECT event_id, value AS loss, event_id::DOUBLE AS step FROM events")
def src10_log_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("\x1b[31mMetrics\x1b[0m\nloss: "), F.col("value").cast("string"), F.lit("\nstep = "), F.col("event_id").cast("string"), F.lit("\nloss: 99"))
    m = table(spark, sf_dir, "events").select("event_id", F.explode(F.array(S.log_metrics(text, ["loss", "step"]))).alias("m"))
    return m.select("event_id", F.col("m")["loss"].alias("loss"), F.col("m")["step"].alias("step"))


@query("SELECT user_id, (event_id % 50)::BIGINT AS step, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id % 50 DESC, ts DESC) = 1")
def src11_latest_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("step", F.col("event_id") % 50)
    return S.latest_checkpoint(e, "user_id", "step", ["event_type"])


@query("""WITH h AS (SELECT *, instr(lower(text), 'the') AS hit FROM conversations WHERE role = 'user'), s AS (SELECT *, greatest(hit - 10, 1) AS f FROM h WHERE hit > 0),
  g AS (SELECT conv_id, arg_min(CASE WHEN f > 1 THEN '...' ELSE '' END || substr(text, f, hit + 13 - f) || CASE WHEN hit + 13 <= length(text) THEN '...' ELSE '' END, turn) AS snippet, max(turn) AS updated FROM s GROUP BY 1)
SELECT conv_id, snippet, updated, count(*) OVER () AS total FROM g ORDER BY updated DESC, conv_id LIMIT 10 OFFSET 10""")
def src12_session_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.search_sessions(table(spark, sf_dir, "conversations"), "the", 10, 1, 10)


@query("SELECT event_id FROM events WHERE ts::DATE BETWEEN (SELECT max(ts)::DATE - 3 FROM events) AND (SELECT max(ts)::DATE FROM events)")
def src13_recent_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    today = e.agg(F.max(F.to_date("ts")).alias("d")).first().d
    return S.recent_days(e, F.to_date("ts"), str(today), 3).select("event_id")


@query("""WITH o AS (SELECT doc_id, n_chars, sum(n_chars) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS e FROM documents WHERE n_chars > 0), x AS (SELECT doc_id, e - n_chars AS s, e, unnest(range((e - n_chars) // 100000, (e - 1) // 100000 + 1)) AS chunk FROM o)
SELECT doc_id, chunk, greatest(s - chunk * 100000, 0) AS start, least(e - chunk * 100000, 100000) AS "end" FROM x""")
def snk04_token_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.token_chunks(table(spark, sf_dir, "documents"), "doc_id", F.col("n_chars"), 100_000)


@query("SELECT conv_id, turn AS line_no, CASE role WHEN 'user' THEN 'user' WHEN 'assistant' THEN 'assistant' ELSE 'system' END AS role, md5(text) AS content FROM conversations WHERE role <> 'user' OR (conv_id, turn) IN (SELECT (conv_id, min(turn)) FROM conversations WHERE role = 'user' GROUP BY conv_id)")
def src07_t01_session_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("role") == "user", "raw_user").when(F.col("role") == "assistant", "assistant").otherwise("system")
    line = F.to_json(F.struct(kind.alias("type"), F.col("turn").cast("int").alias("step"), F.struct(F.col("role"), F.col("text").alias("content")).alias("message")))
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("line_no"), line.alias("value"))
    bad = rows.groupBy("conv_id").agg((F.max("line_no") + 1).alias("line_no")).withColumn("value", F.lit("{broken"))
    return S.session_messages(rows.union(bad), "conv_id", "line_no", "value").withColumn("content", F.md5("content"))


@query("""SELECT user_id, CASE event_id % 3 WHEN 0 THEN event_type WHEN 1 THEN 'f-' || event_type ELSE 'unknown' END AS tool, 2 * count(*) AS calls FROM events WHERE event_id % 5 NOT IN (1, 2) GROUP BY ALL""")
def t04_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, kind = F.col("event_id"), F.col("event_type")
    name, inner = F.when(n % 3 == 0, kind), F.struct(F.when(n % 3 == 1, F.concat(F.lit("f-"), kind)).alias("name"))
    call = F.struct(name.alias("name"), inner.alias("function"), F.lit("{}").alias("arguments"))
    event = F.to_json(F.struct(F.when(n % 5 == 1, "raw_user").otherwise("raw_assistant").alias("type"), F.struct(F.array(call, call).alias("tool_calls")).alias("message")))
    return S.tool_calls(table(spark, sf_dir, "events").select("user_id", F.when(n % 5 == 2, "{no json").otherwise(event).alias("line")), "user_id", "line")


@query("""WITH r AS (SELECT CASE WHEN o_orderkey % 13 = 0 THEN '_' ELSE '' END || 'task' || o_custkey || '__' || o_orderkey AS folder, CASE WHEN o_orderkey % 3 = 0 THEN 'task' || o_custkey ELSE 'named' || o_custkey % 7 END AS task,
  CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice - 150000 END AS reward FROM orders)
SELECT task, arg_max(coalesce(reward > 0, false), folder) AS passed FROM r WHERE folder[1] <> '_' GROUP BY task""")
def t05_pass_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, cust = F.col("o_orderkey"), F.col("o_custkey")
    folder = F.concat(F.when(n % 13 == 0, "_").otherwise(""), F.lit("task"), cust, F.lit("__"), n)
    rewards = F.struct(F.struct(F.when(n % 11 != 0, F.col("o_totalprice") - 150000).alias("reward")).alias("rewards"))
    result = F.to_json(F.struct(F.when(n % 3 != 0, F.concat(F.lit("named"), cust % 7)).alias("task_name"), rewards.alias("verifier_result")))
    return S.pass_map(table(spark, sf_dir, "orders").select(folder.alias("folder"), result.alias("result")), "folder", "result")


@query("SELECT event_id, json_extract_string(props, '$.k')[:400] AS command FROM events")
def t07_t08_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    fenced = F.concat(F.lit("```json\n"), "props", F.lit("\n```"))
    inner = F.regexp_extract(fenced, r"(?s)```(?:json)?\n(.*?)\n```", 1)
    named = F.coalesce(*(F.get_json_object(inner, f"$.{k}") for k in ("command", "cmd", "input", "script", "k")))
    return table(spark, sf_dir, "events").select("event_id", F.substring(named, 1, 400).alias("command"))


@query("SELECT conv_id, i - 1 AS line_no, md5(lines[i]) AS line FROM (SELECT conv_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT conv_id * 100 + turn AS conv_id, string_split(text, chr(10)) AS lines FROM conversations)) WHERE regexp_matches(lower(lines[i]), 'the\\w+ing')")
def src09_text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("conv_id"), "text")
    return relevant_lines(rows, "conv_id", "text", r"the\w+ing", 0).select("conv_id", F.col("line_no").cast("long").alias("line_no"), F.md5("line").alias("line"))


@query("""WITH r AS (SELECT user_id, event_id AS line_no, CASE event_type WHEN 'view' THEN 'raw_assistant' WHEN 'click' THEN 'assistant' WHEN 'purchase' THEN 'raw_tool' WHEN 'signup' THEN 'tool' ELSE 'raw_user' END AS type, event_id // 500 AS step, (event_id // 700)::VARCHAR AS call, props AS content FROM events),
  l AS (SELECT *, replace(type, 'raw_', '') AS role, starts_with(type, 'raw_') AS raw, CASE replace(type, 'raw_', '') WHEN 'user' THEN 'u' || line_no WHEN 'tool' THEN 't' || call ELSE 'a' || step END AS key FROM r WHERE step < 18),
  g AS (SELECT user_id, role, key, min(line_no) FILTER (raw) AS line_no, arg_min(content, line_no) FILTER (raw) AS raw, arg_max(content, line_no) FILTER (NOT raw) AS delta FROM l GROUP BY ALL)
SELECT user_id, line_no, role, raw, coalesce(delta, raw) AS effective FROM g WHERE line_no IS NOT NULL""")
def t06_message_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    type_ = F.when(kind == "view", "raw_assistant").when(kind == "click", "assistant").when(kind == "purchase", "raw_tool").when(kind == "signup", "tool").otherwise("raw_user")
    records = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("line_no"), type_.alias("type"), F.floor(F.col("event_id") / 500).alias("step"), F.floor(F.col("event_id") / 700).cast("string").alias("tool_call_id"), F.col("props").alias("content"))
    return S.message_tracks(records, "user_id", 18)


@query("SELECT event_id, 0 AS panel, event_id::DOUBLE AS step, value AS norm, NULL::DOUBLE AS failures FROM events UNION ALL SELECT event_id, 2, event_id + 1.0, NULL, 0.015 FROM events")
def src10_log_panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id").cast("string")
    first = F.concat(F.lit("start: 1\n\x1b[32mMetrics\x1b[0m\n│ training_step: "), n, F.lit(" │ grad_norm: "), F.col("value").cast("string"), F.lit(" │\n│ grad_norm: 99 │ other: 1 ╯\n"))
    rest = F.concat(F.lit("Metrics\n│ grad_norm: 1 │\nMetrics ─\n│ training_step: "), (F.col("event_id") + 1).cast("string"), F.lit(" │ bash/failure_rate: 1.5e-2 │"))
    m = S.log_panels(table(spark, sf_dir, "events").select("event_id", F.concat(first, rest).alias("text")), "event_id", "text", ["training_step", "grad_norm", "bash/failure_rate"])
    return m.select("event_id", "panel", F.col("metrics")["training_step"].alias("step"), F.col("metrics")["grad_norm"].alias("norm"), F.col("metrics")["bash/failure_rate"].alias("failures"))
