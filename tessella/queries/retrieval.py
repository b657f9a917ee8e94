"""Queries of retrieval, search and fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import retrieval as R
from tessella.plans.tables import keep
from tessella.queries import query, table
from tessella.queries.filters import strip_sql

_SHELL = "'import os.path' || chr(10) || 'cat ' || props || ' | grep x && python3 run.py > out' || event_id % 3 || '.json'" + " || chr(10) || 'uv pip install numpy, Pandas==1.0 -U && apt-get install -y gcc make' || chr(10) || 'cd /x; ls'"


@query(rf"""WITH e AS (SELECT event_id, {_SHELL} AS s FROM events),
  k AS (SELECT event_id, unnest(list_concat(list_concat(list_transform(list_filter(regexp_extract_all(lower(s), '(?m)(?:^|\||&&|;|\$\()\s*([a-z][a-z0-9_.+-]{{1,24}})\b', 1), lambda x: x NOT IN ({", ".join(f"'{x}'" for x in R.STOP_TOOLS)})), lambda x: 'cmd:' || x),
    list_concat(list_transform(regexp_extract_all(s, '(?m)^\s*(?:import|from)\s+([a-zA-Z_][\w.]*)', 1), lambda x: 'py:' || lower(split_part(x, '.', 1))),
    list_concat(list_transform(list_filter(flatten(list_transform(regexp_extract_all(lower(s), '{R.PIP}', 1), lambda x: regexp_split_to_array({strip_sql('x')}, '[\s,]+'))), lambda x: x <> '' AND x[1] <> '-'), lambda x: 'py:' || x),
      list_transform(list_filter(flatten(list_transform(regexp_extract_all(lower(s), '{R.APT}', 1), lambda x: regexp_split_to_array({strip_sql('x')}, '\s+'))), lambda x: x <> '' AND x[1] <> '-'), lambda x: 'apt:' || x)))), list_transform(regexp_extract_all(lower(s), '{R.EXTENSION}', 1), lambda x: 'ext:' || x))) AS token FROM e)
SELECT event_id, token, count(*) AS tf FROM k GROUP BY ALL""")
def r01_capability_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.concat(F.lit("import os.path\ncat "), "props", F.lit(" | grep x && python3 run.py > out"), (F.col("event_id") % 3).cast("string"), F.lit(".json\nuv pip install numpy, Pandas==1.0 -U && apt-get install -y gcc make\ncd /x; ls"))
    return R.capability_tokens(table(spark, sf_dir, "events").select("event_id", s.alias("s")), "event_id", "s")


COUNTS = """c AS (SELECT id, token, count(*) AS tf FROM (SELECT doc_id AS id, unnest(list_filter(regexp_extract_all(lower(text), '[a-z0-9_]+'), lambda x: length(x) >= 3)) AS token FROM documents) GROUP BY ALL),
  q AS (SELECT id, token, count(*) AS tf FROM (SELECT item_id AS id, unnest(list_filter(regexp_extract_all(lower(text), '[a-z0-9_]+'), lambda x: length(x) >= 3)) AS token FROM benchmark) GROUP BY ALL),
  i AS (SELECT token, ln(((SELECT count(*) FROM documents) + 1.0) / (count(DISTINCT id) + 1.0)) + 1.0 AS idf FROM c GROUP BY 1),
  cw AS (SELECT id, token, (1 + ln(tf)) * coalesce(idf, 1) / sqrt(sum(((1 + ln(tf)) * coalesce(idf, 1)) ** 2) OVER (PARTITION BY id)) AS w FROM c LEFT JOIN i USING (token)),
  qw AS (SELECT id, token, (1 + ln(tf)) * coalesce(idf, 1) / sqrt(sum(((1 + ln(tf)) * coalesce(idf, 1)) ** 2) OVER (PARTITION BY id)) AS w FROM q LEFT JOIN i USING (token))"""


@query(f"""WITH {COUNTS}, s AS (SELECT q.id AS item_id, c.id AS doc_id, sum(q.w * c.w) AS sim FROM qw q JOIN cw c USING (token) GROUP BY ALL HAVING sum(q.w * c.w) >= 0.2)
SELECT item_id, doc_id, round(sim, 6) AS sim, row_number() OVER (PARTITION BY item_id ORDER BY round(sim, 9) DESC, doc_id) AS rank FROM s QUALIFY rank <= 5""")
def r02_r03_r04_j10_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    spread = docs.select("doc_id", "text").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))  # a file may be one task
    counts = keep(R.word_counts(spread, "doc_id", "text"))
    idfs = keep(R.idf(counts, "doc_id", docs.count()))
    items = keep(R.weights(R.word_counts(table(spark, sf_dir, "benchmark"), "item_id", "text"), idfs, "item_id"))
    found = R.retrieve(items, R.weights(counts, idfs, "doc_id"), "item_id", "doc_id", 0.2, 5, few=items.count() <= 100_000)
    return found.select("item_id", "doc_id", F.round("sim", 6).alias("sim"), F.col("rank").cast("long").alias("rank"))


_K = ["the", "ein", "que"]


@query(f"""WITH h AS (SELECT doc_id, {", ".join(f"len(regexp_extract_all(lower(text), '{k}')) AS k{i}" for i, k in enumerate(_K))} FROM documents WHERE regexp_matches(lower(text), '{"|".join(_K)}')),
  n AS (SELECT count(*) AS n, {", ".join(f"count(*) FILTER (k{i} > 0) AS d{i}" for i in range(len(_K)))} FROM h)
SELECT doc_id, {" + ".join(f"ln(1.0 + k{i}) * ln(1.0 + n / greatest(d{i}, 1))" for i in range(len(_K)))} AS score FROM h, n""")
def r09_r10_keyword_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.keyword_rank(table(spark, sf_dir, "documents"), "doc_id", "text", _K)


@query("""WITH k AS (SELECT item_id, unnest(list_filter(regexp_extract_all(lower(text), '[a-z0-9_-]+'), lambda x: length(x) > 2 AND x NOT IN (STOPS))) AS k FROM benchmark)
SELECT item_id, array_to_string(list_sort(list(DISTINCT k)), ' ') AS keywords FROM k GROUP BY 1""".replace("STOPS", ", ".join(f"'{x}'" for x in R.STOP_WORDS)))
def r08_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(R.keywords(F.col("text")), " ").alias("keywords")).filter("keywords <> ''")


@query()
def r05_capped_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("task"), F.col("l_partkey").alias("task_order"), (-F.col("l_quantity")).alias("rank"), (F.col("l_suppkey") % 12).alias("env"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("cand"))
    quotas = c.select("task").distinct().withColumn("need", F.lit(6))
    best = c.repartition("task").groupBy("task", "task_order", "env", "cand").agg(F.min("rank").alias("rank"))
    return R.capped_selection(best, quotas, keep, 10)


@query("""WITH g(word, pos, syn) AS (VALUES ('error', 1, 'fault'), ('error', 2, 'failure'), ('error', 3, 'bug'), ('error', 4, 'defect'), ('click', 1, 'tap'))
SELECT event_id, coalesce(syn, event_type) AS term FROM events LEFT JOIN g ON word = event_type AND pos <= 3""")
def r11_synonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = spark.createDataFrame([("error", 1, "fault"), ("error", 2, "failure"), ("error", 3, "bug"), ("error", 4, "defect"), ("click", 1, "tap")], "event_type string, pos int, syn string")
    joined = table(spark, sf_dir, "events").select("event_id", "event_type").join(F.broadcast(g.filter("pos <= 3")), "event_type", "left")  # a fixed list
    return joined.select("event_id", F.coalesce("syn", "event_type").alias("term"))


@query("""WITH l AS (SELECT doc_id, i - 1 AS line_no, lines[i] AS line FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))),
  h AS (SELECT *, regexp_matches(lower(line), 'license') AS hit FROM l), n AS (SELECT *, bool_or(hit) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM h)
SELECT doc_id, line_no, md5(line) AS line, hit FROM n WHERE near""")
def r12_src09_relevant_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.relevant_lines(table(spark, sf_dir, "documents"), "doc_id", "text", "license", 1).select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.md5("line").alias("line"), "hit")


@query("""WITH d AS (SELECT event_id, value * exp(-ln(2.0) * greatest((epoch_us(TIMESTAMP '2024-02-10 00:00:00') - epoch_us(ts)) / 86400000000.0, 0) / 30) AS score FROM events)
SELECT event_id, round(score, 6) AS score FROM d WHERE score >= 1 ORDER BY score DESC, event_id LIMIT 200""")
def r13_r14_r15_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit("2024-02-10 00:00:00").cast("timestamp")
    d = table(spark, sf_dir, "events").select("event_id", R.decayed(F.col("value"), F.col("ts"), now, 30).alias("score"))
    return d.filter("score >= 1").orderBy(F.desc("score"), "event_id").limit(200).select("event_id", F.round("score", 6).alias("score"))


@query("""SELECT doc_id, source AS origin, lang AS language FROM documents""")
def r16_front_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("---\norigin: "), "source", F.lit("\nlanguage: "), "lang", F.lit("\norigin: again\n---\n"), "text")
    m = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(R.front_matter(text))).alias("m"))
    return m.select("doc_id", F.col("m")["origin"].alias("origin"), F.col("m")["language"].alias("language"))


@query("""WITH RECURSIVE e AS (SELECT event_id AS id, CASE WHEN event_id > 0 THEN event_id // 3 END AS parent, value AS v FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY v DESC, id) AS k FROM e),
  p(id, depth, trail) AS (SELECT id, 0, id::VARCHAR FROM r WHERE parent IS NULL UNION ALL SELECT r.id, p.depth + 1, p.trail || '>' || r.id FROM r JOIN p ON r.parent = p.id WHERE k <= 2)
SELECT id, depth, trail FROM p WHERE id NOT IN (SELECT parent FROM r WHERE parent IS NOT NULL AND k <= 2)""")
def r17_reply_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reply_paths(spark, table(spark, sf_dir, "events"), "replies__")


def _reply_paths(spark: SparkSession, events: DataFrame, view: str) -> DataFrame:
    from pyspark.sql import Window

    from tessella.operators.joins import lineage

    e = events.select(F.col("event_id").alias("id"), F.when(F.col("event_id") > 0, F.floor(F.col("event_id") / 3)).alias("parent"), "value")
    kept = e.withColumn("k", F.row_number().over(Window.partitionBy("parent").orderBy(F.desc("value"), "id"))).filter("k <= 2 or parent is null")
    kept.createOrReplaceTempView(view)
    paths = lineage(spark.sql, view, "id", "parent", "parent IS NULL").select("id", "depth", "trail")
    return paths.join(kept.filter("parent is not null").select(F.col("parent").alias("id")).distinct(), "id", "left_anti")


@query("""SELECT doc_id, sha256('{"source":"' || source || '","lang":"' || lang || '"}')[:16] AS h FROM documents""")
def r18_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", R.fingerprint(F.col("source"), F.col("lang"), length=16).alias("h"))


@query("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), p AS (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM l),
  h AS (SELECT doc_id, i, l[i] AS line, contains(lower(l[i]), 'license') OR contains(lower(l[i]), 'shan') AS hit FROM p),
  n AS (SELECT * FROM (SELECT *, bool_or(hit) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM h) WHERE near),
  g AS (SELECT doc_id, i, CASE WHEN i > 1 + lag(i) OVER (PARTITION BY doc_id ORDER BY i) THEN '...' || chr(10) ELSE '' END || line AS line FROM n),
  f AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS shown FROM g GROUP BY 1)
SELECT doc_id, md5(coalesce(shown, array_to_string(l[:20], chr(10)) || CASE WHEN len(l) > 20 THEN chr(10) || '...' ELSE '' END)) AS shown FROM l LEFT JOIN f USING (doc_id)""")
def r12_relevant_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.relevant_text(table(spark, sf_dir, "documents"), "doc_id", "text", ["License", "shan"], 1).select("doc_id", F.md5("shown").alias("shown"))


@query(f"""WITH h AS (SELECT doc_id, {", ".join(f"len(regexp_extract_all(lower(text), '{k}')) AS k{i}" for i, k in enumerate(_K))} FROM documents WHERE regexp_matches(lower(text), '{"|".join(_K)}')),
  n AS (SELECT count(*) AS n, {", ".join(f"count(*) FILTER (k{i} > 0) AS d{i}" for i in range(len(_K)))} FROM h),
  g AS (SELECT doc_id, round({" + ".join(f"ln(1.0 + k{i}) * ln(1.0 + n / greatest(d{i}, 1))" for i in range(len(_K)))}, 9) AS match FROM h, n ORDER BY match DESC, doc_id LIMIT 50),
  e AS (SELECT doc_id FROM documents WHERE lang IN ('de', 'es') ORDER BY doc_id LIMIT 20),
  f AS (SELECT * FROM g UNION ALL SELECT doc_id, 0.5 FROM e WHERE doc_id NOT IN (SELECT doc_id FROM g)),
  d AS (SELECT doc_id, match, n_chars / 1000.0 * exp(-ln(2.0) * (n_chars / 24.0) / 30) AS decay FROM f JOIN documents USING (doc_id) WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0))
SELECT doc_id, match, round(decay, 6) AS decay, row_number() OVER (ORDER BY match DESC, round(decay, 9) DESC, doc_id) AS place FROM d""")
def r10_r13_search_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, now = table(spark, sf_dir, "documents"), F.lit("2024-12-31 00:00:00").cast("timestamp")
    poor = table(spark, sf_dir, "labels").filter("quality = 0").select("doc_id", F.lit("archived").alias("poor")).distinct()
    field = F.concat(F.when(F.col("lang") == "de", "german").when(F.col("lang") == "es", "spanish").otherwise(""), F.lit(", prose"))
    accessed = F.timestamp_micros(F.unix_micros(now) - F.col("n_chars") * 3_600_000_000)
    memories = docs.join(poor, "doc_id", "left").select("doc_id", F.coalesce("poor", F.lit("active")).alias("status"), (F.col("n_chars") / 1000.0).alias("importance"), accessed.alias("accessed"))
    hits = R.keyword_rank(docs, "doc_id", "text", _K).select("doc_id", F.round("score", 9).alias("match")).orderBy(F.desc("match"), "doc_id").limit(50)
    entities = R.entity_hits(docs.withColumn("field", field), "doc_id", "field", R.entity_names("What do the German and Spanish notes say of it?"), 20)
    found = R.search_rank(hits, entities, memories, "doc_id", now, 30)
    return found.select("doc_id", "match", F.round("decay", 6).alias("decay"), F.col("place").cast("long").alias("place"))


@query("""WITH RECURSIVE m AS (SELECT event_id AS id, CASE WHEN event_id > 20 THEN event_id // 3 END AS parent, value AS q, event_type = 'error' AS gone, CASE WHEN event_type IN ('view', 'purchase') THEN 'assistant' ELSE 'prompter' END AS role FROM events),
  a AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY q DESC, id) AS k FROM m WHERE NOT gone),
  p(id, depth, trail) AS (SELECT id, 0, id::VARCHAR FROM a WHERE parent IS NULL UNION ALL SELECT a.id, p.depth + 1, p.trail || '>' || a.id FROM a JOIN p ON a.parent = p.id WHERE k <= 2)
SELECT p.id, depth, trail FROM p JOIN m USING (id) WHERE role = 'assistant' AND p.id NOT IN (SELECT parent FROM m WHERE parent IS NOT NULL)""")
def r17_reply_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.operators.conversion import reply_paths

    kind = F.col("event_type")
    m = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_id") > 20, F.floor(F.col("event_id") / 3)).alias("parent"), F.when(kind.isin("view", "purchase"), "assistant").otherwise("prompter").alias("role"), F.col("value").alias("quality"), (kind == "error").alias("deleted"))
    return reply_paths(m, "reply_messages__", top_k=2)


_FOUND = """l AS (SELECT 'd/' || doc_id || '.md' AS path, string_split(CASE WHEN text LIKE '%' || chr(10) THEN text[:-2] ELSE text END, chr(10)) AS l FROM documents WHERE text <> ''), p AS (SELECT path, l, unnest(range(1, len(l) + 1)) AS i FROM l),
  h AS (SELECT path, i, l[i] AS line, regexp_matches(l[i], '(?i)licen[cs]e') AS hit FROM p)"""


@query(f"""WITH {_FOUND}, n AS (SELECT * FROM (SELECT *, bool_or(hit) OVER (PARTITION BY path ORDER BY i ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS near FROM h) WHERE near),
  g AS (SELECT path, i, 1 AS k, path || ':' || i || ':' || line AS entry FROM n UNION ALL SELECT path, i, 0, '--' FROM (SELECT path, i, lag(i) OVER (PARTITION BY path ORDER BY i) AS j FROM n) WHERE j < i - 1)
SELECT path, row_number() OVER (PARTITION BY path ORDER BY i, k) - 1 AS place, md5(entry) AS entry FROM g""")
def src09_search_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.search_files(_files(spark, sf_dir), "path", "text", "licen[cs]e", "content", name_like="*.md", ignore_case=True, before=1, after=2, head=None)
    return found.select("path", F.col("at").cast("long").alias("place"), F.md5("entry").alias("entry"))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("d/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), "text")


@query(f"""WITH {_FOUND}, c AS (SELECT path, path || ': ' || count(*) AS entry FROM h WHERE hit GROUP BY 1), f AS (SELECT DISTINCT path FROM h WHERE hit ORDER BY path LIMIT 40 OFFSET 3)
SELECT 'count' AS mode, entry FROM c UNION ALL SELECT 'files', path FROM f""")
def src09_search_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, pattern = _files(spark, sf_dir), "licen[cs]e"
    counts = R.search_files(files, "path", "text", pattern, "count", ignore_case=True, head=None)
    paths = R.search_files(files, "path", "text", pattern, "files", ignore_case=True, offset=3, head=40)  # a page of the report
    return counts.select(F.lit("count").alias("mode"), "entry").unionByName(paths.select(F.lit("files").alias("mode"), "entry"))
