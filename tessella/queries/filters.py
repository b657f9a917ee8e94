"""Queries of the text and chat filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.operators import chat, repetition
from tessella.queries import query, table


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip_sql(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def pieces_sql(x: str, pattern: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array({x}, {lit(pattern)}), lambda x: {strip_sql('x')}), lambda x: x <> '')"


@query(f"SELECT doc_id, len({pieces_sql('text', chr(10) * 2)}) AS n FROM documents")
def f01_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.paragraphs(F.col("text"))).alias("n"))


@query(f"SELECT doc_id, len({pieces_sql('text', '[.!?]+')}) AS n FROM documents")
def f02_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.sentences(F.col("text"))).alias("n"))


MATH_SQL = f"translate(text, {lit(T.MATH_SYMBOLS)}, '') <> text OR regexp_matches(text, {lit(T.one_pattern(T.MATH_PATTERNS))})"
SINGLE_SQL = f"(regexp_matches(text, {lit(T.OPEN_ONLY + '|' + T.CLOSE_ONLY)}) AND NOT regexp_matches(text, {lit(T.MATCHED)})) OR regexp_matches(text, {lit(T.one_pattern(T.CODE_STARTS, '(?i)'))})"
LIST_SQL = " OR ".join(rf"len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches({strip_sql('x')}, {lit(p)}))) >= 2" for p in (r"^\d+\.\s", r"^[\-*•]\s"))


@query(f"SELECT event_id AS id, {MATH_SQL.replace('text', 'props')} AS found FROM events")
def f03_math_or_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), T.is_math_or_code(F.col("props")).alias("found"))


@query(f"SELECT page_id, {SINGLE_SQL.replace('text', 'html')} AS found FROM pages")
def f04_code_fragment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.is_code_fragment(F.col("html")).alias("found"))


PHRASE_SQL = f"(len(list_filter([{', '.join(map(lit, T.SHORT_PHRASES))}], lambda p: contains(lower({strip_sql('text')}), p))) > 0 OR (regexp_matches({strip_sql('text')}, {lit(T.COMPARISON)}) AND NOT regexp_matches(lower(text), {lit('|'.join(T.CODE_WORDS))})))"


@query(f"SELECT conv_id, turn, {PHRASE_SQL} AS found FROM (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'cx < dz' WHEN 1 THEN text[:9] ELSE text END AS text FROM conversations)")
def f05_short_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("turn") % 3 == 0, "cx < dz").when(F.col("turn") % 3 == 1, F.substring("text", 1, 9)).otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.is_short_phrase(text).alias("found"))


@query(f"SELECT page_id, regexp_matches(html, {lit(T.one_pattern(T.COMPLEX_MATH))}) AS found FROM pages")
def f06_complex_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.is_complex_math(F.col("html")).alias("found"))


@query(f"SELECT doc_id, {LIST_SQL} AS listed, contains({strip_sql('text')}, chr(10)) AS multi_line, lower({strip_sql('text')}) IN ({', '.join(map(lit, T.TRANSITIONS))}) AS transition FROM documents")
def f07_f08_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.is_structured_list(t).alias("listed"), T.is_multi_line(t).alias("multi_line"), T.is_transition(t).alias("transition"))


def blocks_sql(pattern: str, least: int) -> str:
    return f"""b AS (SELECT doc_id, i - 1 AS pos, items[i] AS item FROM (SELECT doc_id, items, unnest(range(1, len(items) + 1)) AS i FROM (SELECT doc_id, {pieces_sql('text', pattern)} AS items FROM documents)) WHERE length(items[i]) >= {least}),
  r AS (SELECT doc_id, item, pos, pos - row_number() OVER (PARTITION BY doc_id, item ORDER BY pos) AS run FROM b),
  g AS (SELECT doc_id, item, run, count(*) AS n, min(pos) AS first FROM r GROUP BY ALL)"""


@query(f"WITH {blocks_sql('[.!?]+', 10)} SELECT doc_id, item, first AS start, n FROM g WHERE n > 1")
def f09_consecutive_repetitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.consecutive_repetitions(table(spark, sf_dir, "documents"), "line")


@query(f"WITH {blocks_sql('[.!?]+', 5)} SELECT doc_id, item, sum(n)::BIGINT AS total, max(n) AS consecutive, min(first) AS first_pos FROM g GROUP BY doc_id, item HAVING sum(n) > 1")
def f10_all_repetitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetitions(table(spark, sf_dir, "documents"), "line").drop("listed")


@query(r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w FROM documents),
  g AS (SELECT doc_id, i - 1 AS pos, array_to_string(w[i:i + 2], ' ') AS ngram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w))
SELECT doc_id, ngram, count(*) AS n, min(pos) AS first_pos FROM g GROUP BY ALL HAVING count(*) >= 2""")
def f11_ngram_repetitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.ngram_repetitions(table(spark, sf_dir, "documents"))


def verdict_sql(paragraphs: int, anywhere: int, in_run: int) -> str:
    of = lambda rule: f"({rule.replace('text', 'item')})"
    ignored = f"({of(SINGLE_SQL)} OR regexp_matches(item, {lit(T.one_pattern(T.COMPLEX_MATH))}) OR lower({strip_sql('item')}) IN ({', '.join(map(lit, T.TRANSITIONS))}))"
    listed, math = "(CASE WHEN listed THEN 3 ELSE 1 END)", f"(CASE WHEN {of(MATH_SQL)} THEN 2 ELSE 1 END)"

    def repeated(pattern: str, least: int) -> str:
        return f"SELECT g.doc_id, item, sum(n)::BIGINT AS total, max(n) AS run, min(first) AS first_pos, any_value(listed) AS listed FROM g JOIN ({LISTED}) USING (doc_id) GROUP BY g.doc_id, item HAVING sum(n) > 1"

    return f"""WITH w AS (SELECT * FROM (WITH {blocks_sql(chr(10) * 2, 10)} {repeated(chr(10) * 2, 10)})), l AS (SELECT * FROM (WITH {blocks_sql('[.!?]+', 5)} {repeated('[.!?]+', 5)})),
  wd AS (SELECT *, {paragraphs} * greatest({listed}, CASE WHEN contains({strip_sql('item')}, chr(10)) THEN 4 ELSE 1 END, {math}) AS due FROM w),
  j AS (SELECT doc_id, 0 AS kind, first_pos, item, 'paragraph_repeated_' || total || 'x' AS reason FROM wd WHERE NOT {ignored} AND NOT (run = 1 AND length(item) < 20) AND total >= CASE WHEN run = 1 THEN least(due * 2, 30) ELSE due END
    UNION ALL SELECT doc_id, 1, first_pos, item, CASE WHEN NOT regexp_matches(item, '\\s') THEN NULL WHEN {of(PHRASE_SQL)} THEN CASE WHEN run >= {2 * in_run} THEN 'line_repeated_' || total || 'x_consecutive_short_phrase' END
      WHEN {ignored} THEN NULL WHEN run >= {in_run} * greatest({math}, {listed}) AND length(item) >= 5 THEN 'line_repeated_' || total || 'x_consecutive'
      WHEN total >= {anywhere} * greatest({math}, {listed}) AND length(item) >= 10 THEN 'line_repeated_' || total || 'x' END FROM l),
  m AS (SELECT doc_id, reason, item FROM j WHERE reason IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY kind, first_pos) = 1)
"""


LISTED = f"SELECT doc_id, {LIST_SQL} AS listed FROM documents"
_VERDICT = "SELECT doc_id, reason IS NOT NULL AS has_repetition, coalesce(reason, '') AS repetition_reason, coalesce(item, '') AS example FROM documents LEFT JOIN m USING (doc_id)"


def _verdict(docs: DataFrame, thresholds: tuple[int, int, int]) -> DataFrame:
    return repetition.block_verdict(docs, *thresholds).select("doc_id", "has_repetition", "repetition_reason", F.array_join("repetition_examples", "").alias("example"))


@query(verdict_sql(*repetition.USUAL) + _VERDICT)
def f12_f13_block_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verdict(table(spark, sf_dir, "documents"), repetition.USUAL)


@query(verdict_sql(*repetition.FIRST_LOOK) + _VERDICT)
def f12_f13_block_verdict_first_look(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verdict(table(spark, sf_dir, "documents"), repetition.FIRST_LOOK)


@query(verdict_sql(3, 4, 2) + "SELECT source, regexp_replace(reason, '[0-9]+', 'N') AS reason, count(*) AS n FROM documents JOIN m USING (doc_id) GROUP BY ALL")
def f14_reason_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = repetition.block_verdict(docs, 3, 4, 2).filter("has_repetition")
    reason = F.regexp_replace("repetition_reason", "[0-9]+", "N").alias("reason")
    return docs.select("doc_id", "source").join(found, "doc_id").groupBy("source", reason).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source", "reason")


@query("SELECT conv_id, arg_max(text, turn) AS text FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def f15_last_assistant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.last_assistant(table(spark, sf_dir, "conversations"))


_MIXED = "text || CASE WHEN doc_id % 7 = 0 THEN repeat('漢字', doc_id::INT % 40) ELSE '' END"
_HAN = f"length(regexp_replace({_MIXED}, '[^一-鿿]', '', 'g')) / length({_MIXED})"


@query(f"SELECT doc_id, {_HAN} AS ratio, {_HAN} >= 0.05 AS dropped FROM documents")
def f16_f17_han_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat("text", F.when(F.col("doc_id") % 7 == 0, F.repeat(F.lit("漢字"), (F.col("doc_id") % 40).cast("int"))).otherwise(""))
    ratio = T.han_ratio(text)
    return table(spark, sf_dir, "documents").select("doc_id", ratio.alias("ratio"), (ratio >= 0.05).alias("dropped"))


_THOUGHT = "CASE turn % 3 WHEN 0 THEN '<think>' || text || '</think> rest' WHEN 1 THEN '<think>a</think>' || CASE conv_id % 3 WHEN 0 THEN ' ' WHEN 1 THEN chr(10) ELSE '' END || '<answer>' || text || '</answer>' ELSE ' ' || text || '</think>' END"


def _lined(x: str) -> str:
    return f"CASE WHEN contains({x}, '</think>' || chr(10)) THEN {x} ELSE replace({x}, '</think>', '</think>' || chr(10)) END"


_OPENED = f"(CASE WHEN contains(t, '<answer>') THEN {_lined('t')} ELSE replace({_lined('t')}, '</think>', '</think>' || chr(10) || '<answer>') END)"


@query(f"""WITH t AS (SELECT conv_id, turn, {_THOUGHT} AS t FROM conversations)
SELECT conv_id, turn, regexp_full_match(t, '(?s)<think>.*?</think>.*?') AS think, regexp_full_match(t, '(?s)<think>.*?</think><answer>.*?</answer>') AS both,
  md5(CASE WHEN ends_with({_OPENED}, '</answer>') THEN {_OPENED} ELSE {_OPENED} || chr(10) || '</answer>' END) AS added, md5({_lined(strip_sql("replace(replace(t, '<answer>', ''), '</answer>', '')"))}) AS removed,
  md5(replace(replace(replace(replace(t, '<think>', chr(10)), '</think>', ''), '<answer>', chr(10) || chr(10)), '</answer>', '')) AS bare FROM t""")
def f18_f19_f26_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("<think>"), "text", F.lit("</think> rest"))).when(F.col("turn") % 3 == 1, F.concat(F.lit("<think>a</think>"), F.get(F.array(F.lit(" "), F.lit("\n"), F.lit("")), (F.col("conv_id") % 3).cast("int")), F.lit("<answer>"), "text", F.lit("</answer>"))).otherwise(F.concat(F.lit(" "), "text", F.lit("</think>")))
    t = F.col("t")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", marked.alias("t"))
    return rows.select("conv_id", "turn", T.is_think(t).alias("think"), T.is_think_answer(t).alias("both"), F.md5(T.add_answer(t)).alias("added"), F.md5(T.remove_answer(t)).alias("removed"), F.md5(T.replace_all(t, T.SPECIAL_TOKENS)).alias("bare"))


@query("SELECT doc_id, CASE WHEN n_chars % 2 = 0 AND lang = 'en' THEN 'kept' ELSE 'rejected' END AS part FROM documents")
def f20_keep_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, rejected = chat.keep_reject(table(spark, sf_dir, "documents"), (F.col("n_chars") % 2 == 0) & (F.col("lang") == "en"))
    return kept.select("doc_id", F.lit("kept").alias("part")).union(rejected.select("doc_id", F.lit("rejected").alias("part")))


_SAID = "text || CASE WHEN turn % 4 = 1 THEN ' As of my last update in April 2023 it was so; knowledge cutoff 2021.' ELSE '' END"


@query(f"SELECT conv_id, turn, array_to_string(regexp_extract_all({_SAID}, {lit(T.CUTOFF)}, 0), '|') AS found FROM conversations")
def f21_cutoff_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat("text", F.when(F.col("turn") % 4 == 1, " As of my last update in April 2023 it was so; knowledge cutoff 2021.").otherwise(""))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(F.regexp_extract_all(said, F.lit(T.CUTOFF), F.lit(0)), "|").alias("found"))


@query("SELECT source, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY source")
def f22_id_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return chat.without_ids(docs, labels.filter("toxic = 1"), "doc_id").groupBy("source").agg(F.count("*").alias("n"))


_NAMED = "CASE turn % 5 WHEN 1 THEN text || ' I am ChatGPT, trained by OpenAI.' WHEN 3 THEN text || ' GPT-4 is named here' ELSE text END"


@query(f"""WITH t AS (SELECT conv_id, role, {_NAMED} AS t FROM conversations)
SELECT conv_id, bool_or(coalesce(role = 'assistant' AND regexp_matches(t, {lit(T.one_pattern(T.PROVIDER_PATTERNS, '(?i)'))}), false)) AS provider,
  bool_or(coalesce(role = 'assistant' AND regexp_matches(lower(t), {lit(chr(92) + 'b(' + '|'.join(k.lower() for k in T.KEYWORDS) + ')' + chr(92) + 'b')}), false)) AS keyword, bool_or(trim(coalesce(t, '')) = '') AS blank FROM t GROUP BY conv_id""")
def f23_f24_f25_chat_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.when(F.col("turn") % 5 == 1, F.concat("text", F.lit(" I am ChatGPT, trained by OpenAI."))).when(F.col("turn") % 5 == 3, F.concat("text", F.lit(" GPT-4 is named here"))).otherwise(F.col("text"))
    return chat.flags(table(spark, sf_dir, "conversations").withColumn("text", named))


@query("""WITH t AS (SELECT conv_id, turn, CASE turn % 4 WHEN 1 THEN 'AI' WHEN 2 THEN 'Human' ELSE role END AS role, CASE turn % 3 WHEN 0 THEN ' <think>' || text || '</think> <answer>yes</answer>' ELSE text END AS text FROM conversations)
SELECT conv_id, string_agg(CASE WHEN lower(role) IN ('user', 'human') THEN 'User' WHEN lower(role) IN ('assistant', 'ai') THEN 'Assistant' ELSE upper(role[1]) || lower(role[2:]) END || ': ' ||
  replace(replace(replace(replace(text, '<think>', chr(10)), '</think>', ''), '<answer>', chr(10) || chr(10)), '</answer>', ''), chr(10) || chr(10) ORDER BY turn) AS text FROM t WHERE text <> '' GROUP BY conv_id""")
def f27_rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.when(F.col("turn") % 4 == 1, "AI").when(F.col("turn") % 4 == 2, "Human").otherwise(F.col("role"))
    text = F.when(F.col("turn") % 3 == 0, F.concat(F.lit(" <think>"), "text", F.lit("</think> <answer>yes</answer>"))).otherwise(F.col("text"))
    return chat.render(table(spark, sf_dir, "conversations").withColumns({"role": role, "text": text}))


@query("""WITH d AS (SELECT d.*, coalesce(l.toxic, 0) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT 'toxic' AS step, count(*) AS before, count(*) FILTER (toxic = 0) AS after FROM d UNION ALL SELECT 'language', count(*), count(*) FILTER (lower(lang) = 'en') FROM d WHERE toxic = 0""")
def f28_toxic_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left")
    clean = F.coalesce("toxic", F.lit(0)) == 0
    return chat.removal_counts(docs, [("toxic", clean), ("language", F.lower("lang") == "en")])


@query("SELECT doc_id, lang FROM documents WHERE source NOT IN ('src1', 'src2') UNION ALL SELECT item_id, NULL FROM benchmark")
def f29_update_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"))
    return chat.replace_subsets(table(spark, sf_dir, "documents").drop("text", "n_chars"), more, ["src1", "src2"]).drop("source")


@query(r"SELECT doc_id FROM documents WHERE len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) <= 200")
def f30_length_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter(F.size(F.array_remove(F.split("text", r"\s+"), "")) <= 200).select("doc_id")


@query("""WITH p AS (SELECT l_partkey, avg(CASE WHEN l_returnflag = 'N' THEN 1.0 ELSE 0.0 END) AS rate FROM lineitem GROUP BY 1)
SELECT least(floor(rate * 100), 99)::BIGINT AS bin, count(*) AS n FROM p WHERE rate BETWEEN 0.2 AND 0.8 GROUP BY 1""")
def f31_correctness_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.correctness_band(table(spark, sf_dir, "lineitem"), "l_partkey", F.col("l_returnflag") == "N", 0.2, 0.8)


@query("SELECT conv_id FROM conversations GROUP BY conv_id HAVING NOT list_has_any(list(role), ['system', 'tool'])")
def f32_tag_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_set("role").alias("tags"))
    return rows.filter(~F.arrays_overlap("tags", F.array(F.lit("system"), F.lit("tool")))).select("conv_id")


@query(f"SELECT conv_id, bool_or(len(list_filter([{', '.join(lit(k.lower()) for k in T.LEGACY_KEYWORDS)}], lambda k: contains(lower(t), k))) > 0) AS dropped FROM (SELECT conv_id, CASE WHEN conv_id % 5 = 0 AND turn = 1 THEN text || ' Napalm GPT-3x' ELSE text END AS t FROM conversations) GROUP BY conv_id")
def f33_legacy_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when((F.col("conv_id") % 5 == 0) & (F.col("turn") == 1), F.concat("text", F.lit(" Napalm GPT-3x"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max(T.has_legacy_keyword(text)).alias("dropped"))


@query("SELECT conv_id, bool_and(role = CASE turn % 2 WHEN 0 THEN 'user' ELSE 'assistant' END) AS valid FROM (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn FROM conversations WHERE role <> 'system') GROUP BY conv_id")
def f34_role_alternation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.alternates(table(spark, sf_dir, "conversations").filter("role <> 'system'"))


@query("SELECT event_id, regexp_matches(CASE WHEN event_id % 9 = 0 THEN 'press Ctrl-C' ELSE props END, '(?i)\\x03|ctrl[_-]?c') AS found FROM events")
def f35_ctrl_c(spark: SparkSession, sf_dir: str) -> DataFrame:
    sent = F.when(F.col("event_id") % 9 == 0, "press Ctrl-C").otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", chat.has_ctrl_c(sent).alias("found"))


@query("SELECT d.doc_id, count(*) AS n FROM documents d JOIN benchmark b ON contains(d.text, b.text) GROUP BY d.doc_id")
def f36_canary_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark").select(F.col("text").alias("canary")))
