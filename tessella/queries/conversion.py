"""Queries of the conversions and of the transform registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.text import last_python_block, replace_all
from tessella.operators import conversion as C
from tessella.plans.registry import run_chain
from tessella.queries import query, table


def nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.nested(table(spark, sf_dir, "conversations"))


NEST = "m AS (SELECT conv_id, list({'role': role, 'content': text} ORDER BY turn) AS m FROM conversations GROUP BY 1)"
JOIN = "array_to_string(list_transform({}, lambda x: x.role || ': ' || x.content), chr(10))"


@query(f"""WITH {NEST}, k AS (SELECT conv_id, CASE WHEN m[-1].role = 'assistant' THEN m[:len(m) - 1] ELSE m END AS m FROM m), s AS (SELECT conv_id, list_concat([{{'role': 'system', 'content': 'Be brief.'}}], list_filter(m, lambda x: x.role <> 'system')) AS m FROM k)
SELECT conv_id, md5({JOIN.format('m')}) AS text, 'chat' AS dataset_source FROM s WHERE len(m) <= 5""")
def p01_p02_p07_p23_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    chain = [("no_blank_turns", {}), ("drop_trailing_answer", {}), ("system_prompt", {"prompt": "Be brief."}), ("max_turns", {"most": 5}), ("rendered", {})]
    return run_chain(nested(spark, sf_dir), "chat", chain, ["conv_id", "text"]).withColumn("text", F.md5("text"))


@query("""WITH d AS (SELECT doc_id, list_transform(range(0, 12), lambda i: i * (doc_id % 7)) AS ids, [0, 6] AS a, [2, 6 + doc_id % 5] AS b FROM documents),
  l AS (SELECT doc_id, ids, list_transform(ids, lambda x, i: CASE WHEN (i - 1 >= a[1] AND i - 1 < b[1]) OR (i - 1 >= a[2] AND i - 1 < b[2]) THEN x ELSE -100 END) AS labels FROM d)
SELECT doc_id, array_to_string(labels, ',') AS labels, len(ids) <= 12 AND len(list_filter(labels, lambda x: x <> -100)) > 0 AS kept FROM l""")
def p03_p04_p05_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id") % 7
    d = table(spark, sf_dir, "documents").select("doc_id", F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: i * n).alias("ids"), F.array(F.lit(0), F.lit(6)).alias("a"), F.array(F.lit(2).cast("long"), 6 + F.col("doc_id") % 5).alias("b"))
    out = d.withColumn("labels", C.mask_labels(F.col("ids"), F.col("a"), F.col("b")))
    return out.select("doc_id", F.array_join(F.transform("labels", lambda x: x.cast("string")), ",").alias("labels"), C.trainable(F.col("ids"), F.col("labels"), 12).alias("kept"))


@query("SELECT c_custkey, length(c_name) + length(c_mktsegment) <= 26 AND c_acctbal > 0 AS kept FROM customer")
def p06_p08_preference_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", ((F.length("c_name") + F.length("c_mktsegment") <= 26) & (F.col("c_acctbal") > 0)).alias("kept"))


@query("SELECT unnest(['tool_x', 'refund']) AS tool, unnest(['unused', 'unused']) AS kind UNION ALL SELECT DISTINCT event_type, 'unknown' FROM events WHERE event_type IN ('error', 'signup')")
def p09_p10_tool_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame([("view",), ("click",), ("purchase",), ("tool_x",), ("refund",)], "tool string")
    used = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("tools"))
    return C.unknown_tools(used, "user_id", "tools", known)


@query(f"""WITH p AS (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_type END AS ctx, CASE WHEN p_size % 2 = 0 THEN p_brand END AS sys, p_name FROM part)
SELECT p_partkey, CASE WHEN coalesce(sys, '') <> '' THEN 'system: ' || sys || chr(10) ELSE '' END || 'user: ' || p_name || CASE WHEN ctx <> '' THEN chr(10) || chr(10) || ctx ELSE '' END || chr(10) || 'assistant: ok' AS text FROM p""")
def p11_p12_p13_instruction_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    system, context = F.when(F.col("p_size") % 2 == 0, F.col("p_brand")), F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_type"))
    messages = C.from_fields(F.col("p_name"), F.lit("ok"), system, context)
    return table(spark, sf_dir, "part").select("p_partkey", C.joined(messages).alias("text"))


@query(r"""WITH d AS (SELECT doc_id, 'a ```python' || chr(10) || 'x = 1' || chr(10) || '``` b ```python' || chr(10) || lang || chr(10) || '```' AS t FROM documents)
SELECT doc_id, lang AS code, 'Hello ' || source || ' in ' || lang AS filled FROM documents""")
def p14_p20_code_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat(F.lit("a ```python\nx = 1\n``` b ```python\n"), "lang", F.lit("\n```"))
    filled = F.replace(F.replace(F.lit("Hello {name} in {lang}"), F.lit("{name}"), F.col("source")), F.lit("{lang}"), F.col("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", last_python_block(t).alias("code"), replace_all(filled, [("{none}", "")]).alias("filled"))


@query("""SELECT item_id, '{"messages":[{"role":"user","content":"Q' || item_id || '"}],"ground_truth":["' || length(text) || '"],"dataset":"string_f1"}' AS row FROM benchmark""")
def p15_p16_qa_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.struct(F.array(C.message("user", F.concat(F.lit("Q"), F.col("item_id").cast("string")))).alias("messages"), F.array(F.length("text").cast("string")).alias("ground_truth"), F.lit("string_f1").alias("dataset"))
    return table(spark, sf_dir, "benchmark").select("item_id", F.to_json(row).alias("row"))


@query("""WITH m AS (SELECT conv_id, turn, role, CASE WHEN role = 'user' THEN chr(10) || chr(10) || 'Human: ' ELSE chr(10) || chr(10) || 'Assistant: ' END || text AS s FROM conversations WHERE role <> 'system'),
  t AS (SELECT conv_id, string_agg(s, '' ORDER BY turn) AS t FROM m GROUP BY conv_id),
  p AS (SELECT conv_id, role, sum(length(s)) OVER (PARTITION BY conv_id ORDER BY turn) - length(s) AS place FROM m),
  n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY place) AS k FROM p),
  c AS (SELECT u.conv_id, u.k, unnest([u.place, a.place]) AS place, unnest([9, 13]) AS mark FROM n u JOIN n a ON a.conv_id = u.conv_id AND a.k = u.k AND u.role = 'user' AND a.role <> 'user'),
  o AS (SELECT c.conv_id, k, mark, substring(t, (place + mark + 1)::BIGINT, greatest(coalesce(lead(place) OVER (PARTITION BY c.conv_id ORDER BY k, mark), length(t)) - place - mark, 0)::BIGINT) AS content FROM c JOIN t USING (conv_id)),
  g AS (SELECT conv_id, count(*) AS turns, bool_and(content <> '') AS complete, md5(string_agg(content, '|' ORDER BY k, mark)) AS said FROM o GROUP BY conv_id)
SELECT conv_id, coalesce(turns, 0) AS turns, coalesce(complete, false) AS complete, coalesce(said, md5('')) AS said FROM t LEFT JOIN g USING (conv_id)""")
def p17_p18_dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.when(F.col("role") == "user", "\n\nHuman: ").otherwise("\n\nAssistant: "), "text")
    g = table(spark, sf_dir, "conversations").filter("role <> 'system'").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", said.alias("s")))).alias("t"))
    text = F.array_join(F.transform("t", lambda x: x["s"]), "")
    m = g.select("conv_id", F.explode(F.array(C.split_dialogue(text))).alias("m"))
    return m.select("conv_id", F.size("m").cast("long").alias("turns"), C.complete_dialogue(F.col("m")).alias("complete"), F.md5(F.array_join(F.transform("m", lambda x: x["content"]), "|")).alias("said"))


_CALL = """'[{"role":"assistant","tool_calls":[{"id":' || event_id || ',"function":{"name":"f","arguments":' || %s || '}}]},{"role":"tool","content":null}]'"""


@query(f"""SELECT event_id, CASE event_id % 4 WHEN 0 THEN {_CALL % """'{"props":"' || replace(props, '"', chr(39)) || '","all":"[1, ' || chr(39) || 'x' || chr(39) || ', None]","yes":"True","s":"as is"}'"""}
  WHEN 1 THEN {_CALL % """'"[' || event_id || ', {' || chr(92) || '"a' || chr(92) || '": null}]"'"""} WHEN 2 THEN {_CALL % "'\"plain\"'"} END AS messages FROM events""")
def p19_tool_calls_as_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id") % 4
    given = F.when(n == 0, F.concat(F.lit('{"props": '), "props", F.lit(', "all": [1, "x", null], "yes": true, "s": "as is"}'))).when(n == 1, F.concat(F.lit("["), F.col("event_id").cast("string"), F.lit(', {"a": null}]'))).when(n == 2, '"plain"').otherwise("broken")
    text = F.concat(F.lit('[{"role": "assistant", "tool_calls": [{"id": '), F.col("event_id").cast("string"), F.lit(', "function": {"name": "f", "arguments": '), given, F.lit('}}]}, {"role": "tool", "content": null}]'))
    return table(spark, sf_dir, "events").select("event_id", C.tool_calls_as_text(text).alias("messages"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN '{}' WHEN 1 THEN props WHEN 2 THEN '{"_raw":"ls -l"}' ELSE '{"value":[1,2]}' END AS args FROM (SELECT event_id, regexp_replace(props, '\\s+', '', 'g') AS props FROM events)""")
def p19_p21_t02_tool_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id") % 4
    text = F.when(n == 0, "").when(n == 1, F.col("props")).when(n == 2, "ls -l").otherwise("[1,2]")
    return table(spark, sf_dir, "events").select("event_id", C.tool_arguments(text).alias("args"))


@query(r"SELECT doc_id, md5(CASE WHEN length(text) > 400 THEN text[:400] || chr(10) || '...[truncated]...' ELSE text END) AS text FROM documents")
def p22_t03_clipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(C.clipped(F.col("text"), 400)).alias("text"))


@query("""WITH h AS (SELECT event_id, event_type, string_agg(event_type || '@' || event_id, chr(10)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS history FROM events)
SELECT event_id, md5(coalesce(history, '')) AS history FROM h WHERE event_type = 'click'""")
def p24_step_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.concat("event_type", F.lit("@"), F.col("event_id").cast("string"))
    return C.step_records(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], shown, F.col("event_type") == "click").select("event_id", F.md5("history").alias("history"))


@query("SELECT p_partkey, 'python:3.' || p_size AS base, '/app' AS workdir, 'git ' || p_brand AS packages FROM part")
def p27_p28_container_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("FROM python:3."), F.col("p_size").cast("string"), F.lit("\nWORKDIR /app\nRUN apt-get install -y git "), "p_brand", F.lit("\n"))
    return table(spark, sf_dir, "part").select("p_partkey", *(c.alias(k) for k, c in C.container_fields(text).items()))


@query("""WITH r AS (SELECT l_orderkey, 0 AS pos, l_quantity AS v FROM lineitem UNION ALL SELECT l_orderkey, 1, coalesce(try_cast(CASE WHEN l_linenumber = 2 THEN 'N/A' ELSE l_linenumber::VARCHAR END AS INT), -1) FROM lineitem WHERE l_linenumber < 4)
SELECT l_orderkey, pos, avg(v) AS mean FROM r GROUP BY ALL""")
def p29_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("l_linenumber") == 2, "N/A").otherwise(F.col("l_linenumber").cast("string"))
    both = F.when(F.col("l_linenumber") < 4, F.array(F.col("l_quantity"), C.rating(text).cast("double"))).otherwise(F.array("l_quantity"))
    return C.mean_ratings(table(spark, sf_dir, "lineitem").select("l_orderkey", both.alias("ratings")), "l_orderkey", "ratings")


@query("""WITH s AS (SELECT user_id, min(ts) FILTER (event_type = 'click') AS a, max(ts) FILTER (event_type = 'click') AS b, min(ts) AS c, max(ts) AS d FROM events GROUP BY 1)
SELECT user_id, coalesce(CASE WHEN b > a THEN (epoch_us(b) - epoch_us(a)) / 1e6 END, CASE WHEN d > c THEN (epoch_us(d) - epoch_us(c)) / 1e6 END) AS seconds FROM s""")
def p30_elapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    click = F.when(F.col("event_type") == "click", F.col("ts"))
    g = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min(click).alias("a"), F.max(click).alias("b"), F.min("ts").alias("c"), F.max("ts").alias("d"))
    return g.select("user_id", C.elapsed_seconds(*map(F.col, "abcd")).alias("seconds"))


@query("SELECT conv_id, turn, 1 AS n, 'bash' AS tool, 'command' AS required FROM conversations")
def p28_tools_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.with_tools(table(spark, sf_dir, "conversations"))
    first = F.col("tools")[0]["function"]
    return rows.select("conv_id", "turn", F.size("tools").alias("n"), first["name"].alias("tool"), F.get_json_object(first["parameters"], "$.required[0]").alias("required"))


@query("""WITH q AS (SELECT item_id, split_part(text, ' ', 1) AS q, split_part(text, ' ', 2) AS a FROM benchmark)
SELECT item_id, 'one' AS layout, 'Ask: ' || q AS asked, a AS truth FROM q UNION ALL SELECT item_id, 'many', 'Ask: ' || q || '?', to_json([a, 'x'])::VARCHAR FROM q UNION ALL SELECT item_id, 'alias', q, to_json([a])::VARCHAR FROM q""")
def p15_qa_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.split("text", " ")
    q = table(spark, sf_dir, "benchmark").select("item_id", words[0].alias("question"), F.coalesce(F.get(words, F.lit(1)), F.lit("")).alias("a"))
    one = C.qa_rows(q.withColumn("answer", F.col("a")), "item_id", "one_answer", "Ask: ")
    many = C.qa_rows(q.withColumn("answer", F.array("a", F.lit("x"))), "item_id", "answers", "Ask: ")
    alias = C.qa_rows(q.withColumn("answer", F.struct(F.array("a").alias("aliases"))), "item_id", "aliases")
    shown = lambda df, name: df.select("item_id", F.lit(name).alias("layout"), F.col("messages")[0]["content"].alias("asked"), F.col("ground_truth").alias("truth"))
    return shown(one, "one").unionByName(shown(many, "many")).unionByName(shown(alias, "alias"))


@query("""SELECT doc_id, 'What?' || chr(10) || 'Think.' AS asked, md5('<think>x</think>' || text) AS truth, md5(string_split(text, '</think>')[-1]) AS plain FROM documents""")
def p16_long_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.lit("What?").alias("prompt"), F.concat(F.lit("<think>x</think>"), "text").alias("response"))
    rows = C.long_form_rows(d, "doc_id", "\nThink.")
    return rows.select("doc_id", F.col("messages")[0]["content"].alias("asked"), F.md5("ground_truth").alias("truth"), F.md5("no_reasoning_ground_truth").alias("plain"))
