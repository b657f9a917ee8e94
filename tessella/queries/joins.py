"""Queries of joins and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import joins as J
from tessella.queries import query, table


@query("SELECT p_brand, count(*) AS n, count(*) FILTER (l_returnflag = 'N') AS passed FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def j01_inner_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag").join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return joined.groupBy("p_brand").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "N").alias("passed"))


@query("SELECT a.doc_id AS x, b.doc_id AS y FROM documents a JOIN documents b ON md5(a.text) = md5(b.text) AND a.doc_id < b.doc_id WHERE a.lang = 'es'")
def j02_prompt_hash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").filter("lang = 'es'").select("doc_id", F.md5("text").alias("h"))
    e = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("y"), F.md5("text").alias("h"))
    return d.join(e, "h").filter(F.col("doc_id") < F.col("y")).select(F.col("doc_id").alias("x"), "y")


@query("SELECT doc_id FROM documents WHERE lang = 'en' INTERSECT SELECT doc_id FROM labels INTERSECT SELECT doc_id FROM documents WHERE n_chars > 500")
def j03_j04_common_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return J.common_ids([d.filter("lang = 'en'"), table(spark, sf_dir, "labels"), d.filter("n_chars > 500")], "doc_id")


@query("SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' AND o_custkey IS NOT NULL) GROUP BY 1")
def j05_j06_semi_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    kept = c.join(orders.filter("o_orderstatus = 'F'"), "c_custkey", "left_semi").join(orders.filter("o_orderstatus = 'O'"), "c_custkey", "left_anti")
    return kept.groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query(r"""WITH c AS (SELECT doc_id, lang, lower(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)
SELECT doc_id FROM c WHERE lang = 'fr' AND t NOT IN (SELECT t FROM c WHERE lang IS NULL OR lang <> 'fr')""")
def j07_cleaned_text_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = table(spark, sf_dir, "documents").select("doc_id", "lang", F.xxhash64(F.lower(F.regexp_replace("text", r"\s+", " "))).alias("h"))
    return clean.filter("lang = 'fr'").join(clean.filter("lang is null or lang <> 'fr'").select("h"), "h", "left_anti").select("doc_id")


@query("""WITH a AS (SELECT o_custkey AS k, max(o_orderstatus) AS v FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), b AS (SELECT o_custkey AS k, max(o_orderstatus) AS v FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1)
SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'create' WHEN b.k IS NULL THEN 'delete' ELSE 'update' END AS op, a.v AS before, b.v AS after FROM a FULL JOIN b ON a.k = b.k WHERE a.v IS DISTINCT FROM b.v""")
def j08_state_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey", "o_orderstatus")
    snap = lambda n: o.filter(F.col("o_orderkey") % n == 0).groupBy("k").agg(F.max("o_orderstatus").alias("v"))
    return J.state_diff(snap(2), snap(3), "k", "v")


RATE = "SELECT l_partkey AS k, avg(CASE WHEN l_returnflag = 'N' THEN 1.0 ELSE 0.0 END) > 0.5 AS p FROM lineitem WHERE l_suppkey % 2 = {} GROUP BY 1"


@query(f"""WITH a AS ({RATE.format(0)}), b AS ({RATE.format(1)})
SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.p IS NULL OR b.p IS NULL THEN 'absent' WHEN NOT a.p AND b.p THEN 'flipped' WHEN a.p AND NOT b.p THEN 'regressed' WHEN a.p THEN 'still_T' ELSE 'still_F' END AS flip FROM a FULL JOIN b ON a.k = b.k""")
def j09_flips(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k"), "l_suppkey", "l_returnflag")
    side = lambda n: li.filter(F.col("l_suppkey") % 2 == n).groupBy("k").agg((F.avg(F.when(F.col("l_returnflag") == "N", 1.0).otherwise(0.0)) > 0.5).alias("p"))
    return J.flips(side(0), side(1), "k", "p")


@query("SELECT k, arg_max(v, o) AS v FROM (SELECT n_nationkey AS k, n_name AS v, 0 AS o FROM nation UNION ALL SELECT s_nationkey, max(s_name), 1 FROM supplier GROUP BY 1 UNION ALL SELECT c_nationkey, max(c_name), 2 FROM customer WHERE c_acctbal > 9000 GROUP BY 1) GROUP BY k")
def j13_last_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v"))
    s = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.max("s_name").alias("v"))
    c = table(spark, sf_dir, "customer").filter("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("k")).agg(F.max("c_name").alias("v"))
    return J.last_writer([n, s, c], "k")


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN l.quality ELSE d.n_chars END::BIGINT AS v FROM documents d LEFT JOIN labels l USING (doc_id)")
def j14_j17_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("v"))
    return J.overlay(base, table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("long").alias("v")), "doc_id", ["v"])


@query("""WITH RECURSIVE p AS (SELECT n_nationkey AS id, n_name AS name, CASE WHEN n_nationkey > 0 THEN (n_nationkey - 1) // 2 END AS parent FROM nation),
  t(id, depth, trail) AS (SELECT id, 0, id::VARCHAR FROM p WHERE parent IS NULL UNION ALL SELECT p.id, t.depth + 1, t.trail || '>' || p.id FROM p JOIN t ON p.parent = t.id)
SELECT id, depth, trail FROM t""")
def j15_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.when(F.col("n_nationkey") > 0, F.floor((F.col("n_nationkey") - 1) / 2).cast("int")).alias("parent"))
    tree.createOrReplaceTempView("nation_tree__")
    return J.lineage(spark.sql, "nation_tree__", "id", "parent", "parent IS NULL").select("id", "depth", "trail")


@query("""SELECT event_id, first_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_value,
  last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_value FROM events""")
def j16_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.neighbours(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type", "purchase", "event_id").select("event_id", "next_value", "prev_value")


@query("""SELECT 'union' AS op, count(*) AS n FROM (SELECT doc_id FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id FROM labels)
UNION ALL SELECT 'intersect', count(*) FROM (SELECT doc_id FROM documents WHERE lang = 'en' INTERSECT SELECT doc_id FROM labels)
UNION ALL SELECT 'except', count(*) FROM (SELECT doc_id FROM documents WHERE lang = 'en' EXCEPT SELECT doc_id FROM labels)
UNION ALL SELECT 'distinct', count(*) FROM (SELECT DISTINCT source, lang FROM documents)""")
def set1_set2_set3(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id")
    en = d.filter("lang = 'en'").select("doc_id")
    parts = {"union": en.unionByName(labels), "intersect": en.intersect(labels), "except": en.subtract(labels), "distinct": d.select("source", "lang").dropDuplicates()}
    out = None
    for name, df in parts.items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("op"), "n")
        out = row if out is None else out.union(row)
    return out
