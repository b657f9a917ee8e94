"""Queries of the sampling operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import sampling as S
from tessella.queries import query, table

H = "md5(doc_id::VARCHAR || '-42')"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")


@query(f"""WITH n AS (SELECT count(*) AS n FROM documents WHERE lang = 'fr'), r AS (SELECT doc_id, row_number() OVER (ORDER BY {H}, doc_id) AS k, n FROM documents, n WHERE lang = 'fr')
SELECT doc_id, c AS copy FROM r, range(3) t(c) WHERE c < 2 OR k <= floor(2.5 * n) - 2 * n""")
def m01_m02_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs(spark, sf_dir).filter("lang = 'fr'").select("doc_id")
    return S.resample(rows, S.parse_amount("2.5", rows.count()), "doc_id").select("doc_id", F.col("copy").cast("long").alias("copy"))


@query(f"""WITH a AS (SELECT doc_id FROM documents WHERE lang = 'es' ORDER BY {H}, doc_id LIMIT 10), b AS (SELECT doc_id FROM documents WHERE lang = 'de')
SELECT row_number() OVER (ORDER BY o, doc_id) - 1 AS index, doc_id, s AS dataset_source FROM (SELECT doc_id, 0 AS o, 'spanish' AS s FROM a UNION ALL SELECT doc_id, 1, 'german' FROM b)""")
def m03_concat_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir).select("doc_id", "lang")
    mixed = S.mix([("spanish", d.filter("lang = 'es'"), "10"), ("german", d.filter("lang = 'de'"), "1.0")], "doc_id")
    return dense_index(mixed).select("index", "doc_id", "dataset_source")


def dense_index(df: DataFrame) -> DataFrame:
    from tessella.operators.joins import dense_index as index

    return index(df, ["source_order", "doc_id"])


@query(f"SELECT doc_id FROM documents ORDER BY {H}, doc_id LIMIT 50")
def m04_m24_shuffle_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id").orderBy(S.shuffled("doc_id"), "doc_id").limit(50)


@query(f"""WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {H}, doc_id) AS k FROM documents)
SELECT doc_id, source FROM r JOIN (VALUES ('src0', 30), ('src1', 12), ('src2', 6)) v(s, n) ON s = source AND k <= n""")
def m05_portions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.portions(docs(spark, sf_dir), "source", "doc_id", {"src0": 0.5, "src1": 0.2, "src2": 0.1}, 60).select("doc_id", "source")


@query(f"SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY {H}, doc_id) <= greatest(1, floor(count(*) OVER () * 0.1)) THEN 'eval' ELSE 'train' END AS part FROM documents")
def m06_split_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.split_pairs(docs(spark, sf_dir), "doc_id", 0.1).select("doc_id", "part")


FILL = f"SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {H} DESC, doc_id) AS k FROM "


@query(f"SELECT doc_id, source FROM ({FILL} documents) ORDER BY k, source LIMIT 77")
def m07_stratified_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.stratified_fill(docs(spark, sf_dir), "source", "doc_id", 77).select("doc_id", "source")


@query(f"""WITH kept AS (SELECT doc_id FROM documents WHERE lang = 'es' AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0) ORDER BY doc_id LIMIT 80),
  f AS (SELECT * FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM kept) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0 OR toxic = 1)),
  r AS (SELECT doc_id FROM ({FILL} f) ORDER BY k, source LIMIT (SELECT 80 - count(*) FROM kept))
SELECT doc_id, true AS kept FROM kept UNION ALL SELECT doc_id, false FROM r""")
def m08_rotating_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir)
    gone = table(spark, sf_dir, "labels").filter("quality = 0").select("doc_id").distinct()
    return S.rotate(d.filter("lang = 'es'"), d, gone, table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id").distinct(), "source", "doc_id", 80).select("doc_id", "kept")


@query(f"""WITH p AS (SELECT doc_id FROM documents WHERE lang = 'es' ORDER BY doc_id LIMIT 20), f AS (SELECT * FROM documents WHERE lang <> 'es'),
  r AS (SELECT doc_id FROM ({FILL} f) ORDER BY k, source LIMIT (SELECT 20 - count(*) FROM p)) SELECT doc_id FROM p UNION ALL SELECT doc_id FROM r""")
def m09_prefer_then_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir)
    return S.prefer_then_fill(d, d.filter("lang = 'es'"), "source", "doc_id", 20).select("doc_id")


@query("""WITH t AS (SELECT p_partkey, split_part(p_type, ' ', 1) AS family, p_size % 2 = 0 AS passed FROM part),
  s AS (SELECT *, count(*) OVER (PARTITION BY passed, family) AS n FROM t),
  o AS (SELECT p_partkey, row_number() OVER (ORDER BY n DESC, passed, family, md5(p_partkey::VARCHAR || '-42'), p_partkey) - 1 AS p, count(*) OVER () AS total FROM s)
SELECT p_partkey, least(50, floor(p * 50 / total) + 1) > CASE WHEN p = 0 THEN 0 ELSE least(50, floor((p - 1) * 50 / total) + 1) END AS holdout FROM o""")
def m10_stratified_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.operators.joins import dense_index as index

    t = table(spark, sf_dir, "part").select("p_partkey", F.split_part("p_type", F.lit(" "), F.lit(1)).alias("family"), (F.col("p_size") % 2 == 0).alias("passed"))
    sizes = t.groupBy("passed", "family").agg(F.count("*").alias("n"))
    placed = index(t.join(sizes, ["passed", "family"]).withColumn("h", S.shuffled("p_partkey")), [F.desc("n"), "passed", "family", "h", "p_partkey"])
    return placed.select("p_partkey", S.dealt_to_holdout(F.col("index"), t.count(), 50).alias("holdout"))


@query(f"""WITH r AS (SELECT doc_id, CASE quality WHEN 1 THEN 'passing' ELSE 'failing' END AS part, row_number() OVER (PARTITION BY quality ORDER BY md5(doc_id::VARCHAR || '-42'), doc_id) AS k FROM labels WHERE toxic = 0),
  e AS (SELECT doc_id, part FROM r WHERE k <= CASE part WHEN 'failing' THEN 10 ELSE 6 END)
SELECT * FROM e UNION ALL SELECT doc_id, 'holdout' FROM (SELECT doc_id FROM documents WHERE lang = 'en' AND doc_id NOT IN (SELECT doc_id FROM e) ORDER BY md5(doc_id::VARCHAR || '-42'), doc_id LIMIT 30)""")
def m11_failed_passed_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("passed"), F.when(F.col("toxic") == 1, "timeout").otherwise("done").alias("status"))
    return S.failed_passed_mix(results, "doc_id", table(spark, sf_dir, "documents").filter("lang = 'en'"))


@query("""WITH a AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag, l_linestatus, l_partkey ORDER BY l_quantity, l_orderkey, l_linenumber) AS t FROM lineitem),
  b AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_quantity, l_orderkey, l_linenumber) AS c FROM a WHERE t <= 2)
SELECT l_orderkey, l_linenumber FROM b ORDER BY c, l_returnflag, l_linestatus LIMIT 99""")
def m12_m17_cell_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_linestatus", "l_quantity")
    return S.cell_round_robin(rows, ["l_returnflag", "l_linestatus"], "l_partkey", ["l_quantity", "l_orderkey", "l_linenumber"], 2, 99).select("l_orderkey", "l_linenumber")


@query("""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS i, count(*) OVER () AS n FROM documents)
SELECT doc_id, (least(i // (n // 4), 3) + 1)::BIGINT AS quartile FROM r""")
def m13_rank_quartile(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.operators.joins import dense_index as index

    d = docs(spark, sf_dir)
    return index(d, ["n_chars", "doc_id"]).select("doc_id", S.rank_quartile(F.col("index"), d.count()).cast("long").alias("quartile"))


@query(f"""WITH h AS (SELECT doc_id FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20), t AS (SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM h) ORDER BY {H}, doc_id LIMIT 20)
SELECT * FROM h UNION ALL SELECT * FROM t""")
def m14_top_half_and_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.top_half_and_sample(docs(spark, sf_dir), [F.desc("n_chars"), "doc_id"], "doc_id", 40).select("doc_id")


@query("""WITH n AS (SELECT doc_id FROM documents WHERE source = 'src3'), o AS (SELECT doc_id FROM documents WHERE source <> 'src3' ORDER BY n_chars DESC, doc_id LIMIT (SELECT (0.25 / 0.75 * count(*))::INT FROM (SELECT 1 FROM n)))
SELECT * FROM n UNION ALL SELECT * FROM (SELECT doc_id FROM documents WHERE source <> 'src3' ORDER BY n_chars DESC, doc_id LIMIT (SELECT floor(0.25 / 0.75 * count(*))::BIGINT FROM n))""")
def m15_cap_previous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.cap_previous(docs(spark, sf_dir), F.col("source") == "src3", [F.desc("n_chars"), "doc_id"], 0.25).select("doc_id")


@query("""WITH p AS (SELECT l_partkey, avg(CASE WHEN l_returnflag = 'N' THEN 1.0 ELSE 0.0 END) AS rate FROM lineitem GROUP BY 1), w AS (SELECT l_partkey, (1 - rate) * (rate + 0.15) AS w FROM p)
SELECT l_partkey, round_even(1000 * w / (SELECT sum(w) FROM w), 0)::BIGINT AS quota FROM w""")
def m16_learnability_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.avg(F.when(F.col("l_returnflag") == "N", 1.0).otherwise(0.0)).alias("rate"))
    return S.quotas(rates, S.learnability(F.col("rate")), 1000).select("l_partkey", "quota")


@query(f"SELECT doc_id FROM ({FILL} (SELECT * FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))) ORDER BY k, source LIMIT 50")
def m18_m19_disjoint_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir).join(table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_anti")
    return S.stratified_fill(d, "source", "doc_id", 50).select("doc_id")


@query("SELECT count(DISTINCT id) AS reuse, greatest(0, 2000 - count(DISTINCT id)) AS new FROM (SELECT doc_id AS id FROM labels UNION ALL SELECT doc_id FROM documents WHERE lang = 'de')")
def m20_top_up_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "labels").select("doc_id").union(docs(spark, sf_dir).filter("lang = 'de'").select("doc_id")).distinct()
    return ids.agg(F.count("*").alias("reuse")).select("reuse", F.greatest(F.lit(0), F.lit(2000) - F.col("reuse")).alias("new"))


@query("""WITH s AS (SELECT l_partkey, avg(CASE WHEN l_returnflag = 'N' THEN 1.0 ELSE 0.0 END) AS stability FROM lineitem GROUP BY 1)
SELECT l_partkey FROM s ORDER BY stability DESC, sha256(l_partkey::VARCHAR), l_partkey LIMIT 25""")
def m21_probe_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.avg(F.when(F.col("l_returnflag") == "N", 1.0).otherwise(0.0)).alias("stability"))
    return rates.orderBy(F.desc("stability"), F.sha2(F.col("l_partkey").cast("string"), 256), "l_partkey").limit(25).select("l_partkey")


@query("""WITH p AS (SELECT l_partkey, count(*) AS n, count(*) FILTER (l_returnflag = 'N') AS k FROM lineitem GROUP BY 1), r AS (SELECT l_partkey, (k + 1) / (n + 2) AS r FROM p)
SELECT l_partkey, greatest(4 * r * (1 - r), 0.1) AS weight FROM r""")
def m22_frontier_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "N").alias("k"))
    return p.select("l_partkey", S.frontier_weight(F.lit(0), F.lit(0), F.col("k"), F.col("n")).alias("weight"))


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_orderkey) AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY md5(l_linenumber::VARCHAR || '-42'), l_linenumber) AS k FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem))
SELECT l_orderkey, l_linenumber FROM r WHERE n >= 4 AND k <= 4""")
def m23_n_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    return S.n_per_key(rows, "l_orderkey", "l_linenumber", 4)


@query("SELECT doc_id FROM documents WHERE regexp_matches(source, '^src1[0-9]$') AND lang IN ('en', 'de') AND contains(source, '5') AND doc_id NOT IN (SELECT doc_id FROM labels)")
def m25_m26_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir).filter(F.col("source").rlike("^src1[0-9]$") & F.col("lang").isin("en", "de") & F.col("source").contains("5"))
    return d.join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id")


@query("""WITH r AS (SELECT l_partkey::VARCHAR AS task, l_suppkey % 8 AS run, bool_or(l_returnflag = 'N') AS ok FROM lineitem GROUP BY ALL),
  t AS (SELECT task, coalesce(bool_or(ok) FILTER (run = 0), false) AS parent, count(*) FILTER (run > 0 AND ok) / 7.0 AS stability FROM r GROUP BY 1),
  c AS (SELECT task, row_number() OVER (ORDER BY stability DESC, sha256(task)) AS pos FROM t WHERE parent), u AS (SELECT task, row_number() OVER (ORDER BY sha256(task)) AS pos FROM t WHERE NOT parent),
  f AS (SELECT s_suppkey::VARCHAR AS task, s_suppkey AS pos FROM supplier WHERE s_acctbal < 0 AND s_suppkey::VARCHAR IN (SELECT task FROM u)),
  l AS (SELECT task, 1 AS turn, pos FROM f UNION ALL SELECT task, 2, pos FROM u WHERE pos <= 8 UNION ALL SELECT task, CASE WHEN EXISTS (SELECT 1 FROM f) THEN 3 ELSE 0 END, pos FROM c WHERE pos <= 12),
  o AS (SELECT task, row_number() OVER (ORDER BY min((turn, pos))) AS place FROM l GROUP BY 1)
SELECT * FROM o WHERE place <= 40""")
def m21_probe_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("task"), (F.col("l_suppkey") % 8).alias("run"), (F.col("l_returnflag") == "N").alias("ok"))
    runs = rows.groupBy("task", "run").agg(F.bool_or("ok").alias("ok"))
    tasks = runs.groupBy("task").agg(F.coalesce(F.bool_or(F.when(F.col("run") == 0, F.col("ok"))), F.lit(False)).alias("parent"), (F.count_if((F.col("run") > 0) & F.col("ok")) / 7.0).alias("stability"))
    focus = table(spark, sf_dir, "supplier").filter("s_acctbal < 0").select(F.col("s_suppkey").cast("string").alias("task"), F.col("s_suppkey").alias("place"))
    return S.probe_tasks(tasks, focus, 12, 8, most=40).select("task", F.col("place").cast("long").alias("place"))
