"""Queries of the verifiers and format constraints."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import verifiers as V
from tessella.functions.constraints import check, instruction_scores
from tessella.functions.latex import math_match, strict_math_match
from tessella.queries import query, table
from tessella.queries.filters import lit, strip_sql

PUNCT = lit(V.PUNCTUATION)


def norm_sql(x: str) -> str:
    return rf"array_to_string(list_filter(regexp_split_to_array(translate(lower({x}), {PUNCT}, ''), '\s+'), lambda x: x NOT IN ('', 'a', 'an', 'the')), ' ')"


def said(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as answers: some think first, some tag their answer, and a label that some of them meet."""
    t, n = F.col("text"), F.col("turn") % 4
    head = F.substring("text", 1, 60)
    text = F.when(n == 0, F.concat(F.lit("<think>x</think> "), head)).when(n == 1, F.concat(F.lit("so <answer>"), head, F.lit("</answer>"))).when(n == 2, F.concat(F.lit("The answer is: "), head)).otherwise(F.concat(head, F.when(F.col("conv_id") % 2 == 0, " 1,234.5").otherwise(" it is -7")))
    label = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("the "), head)).otherwise(F.substring("text", 11, 40))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.alias("text"), F.when(n == 3, F.when(F.col("conv_id") % 2 == 0, "1234.5").otherwise("-7")).otherwise(label).alias("label"), t.alias("full"))


SAID = """s AS (SELECT conv_id, turn, text AS "full", CASE turn % 4 WHEN 0 THEN '<think>x</think> ' || text[:60] WHEN 1 THEN 'so <answer>' || text[:60] || '</answer>' WHEN 2 THEN 'The answer is: ' || text[:60] ELSE text[:60] || CASE WHEN conv_id % 2 = 0 THEN ' 1,234.5' ELSE ' it is -7' END END AS text,
  CASE WHEN turn % 4 = 3 THEN CASE WHEN conv_id % 2 = 0 THEN '1234.5' ELSE '-7' END WHEN conv_id % 2 = 0 THEN 'the ' || text[:60] ELSE text[11:50] END AS label FROM conversations)"""
AFTER = strip_sql("replace(replace(string_split(text, '</think>')[-1], '<answer>', ''), '</answer>', '')")


@query(rf"WITH {SAID} SELECT conv_id, turn, md5({AFTER}) AS after, md5({norm_sql('text')}) AS normal FROM s")
def v01_v05_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return said(spark, sf_dir).select("conv_id", "turn", F.md5(V.without_thinking(t)).alias("after"), F.md5(V.normalized(t)).alias("normal"))


_PLAIN = r"regexp_replace(text, '(\d),(\d)', '\1\2', 'g')"
_NUM = rf"coalesce(regexp_extract_all({_PLAIN}, '[-+]?(?:\d*\.\d+|\d+)')[-1], {_PLAIN})"


@query(f"WITH {SAID} SELECT conv_id, turn, CASE WHEN lower({_NUM}) = lower(label) THEN 1.0 ELSE 0.0 END AS number, CASE WHEN {norm_sql(AFTER)} = {norm_sql('label')} THEN 1.0 ELSE 0.0 END AS puzzle FROM s")
def v02_v10_number_puzzle(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, y = F.col("text"), F.col("label")
    return said(spark, sf_dir).select("conv_id", "turn", V.number_match(t, y).alias("number"), V.puzzle_match(t, y).alias("puzzle"))


def _bag(x: str) -> str:
    return f"list_filter(string_split({norm_sql(x)}, ' '), lambda x: x <> '')"


def _f1(a: str, b: str) -> str:
    common = f"coalesce(list_sum(list_transform(list_distinct({a}), lambda w: least(len(list_filter({a}, lambda x: x = w)), len(list_filter({b}, lambda x: x = w))))), 0)"
    return f"CASE WHEN {common} > 0 THEN 2.0 * {common} / (len({a}) + len({b})) ELSE 0.0 END"


@query(f"""WITH {SAID}, k AS (SELECT conv_id, turn, {_bag('text')} AS a, {_bag('label')} AS b, {_bag(AFTER)} AS aa, {_bag('"full"[5:44]')} AS c FROM s)
SELECT conv_id, turn, {_f1('a', 'b')} AS f1, greatest({_f1('aa', 'b')}, {_f1('aa', 'c')}) AS best FROM k""")
def v06_v09_token_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = F.array("label", F.substring("full", 5, 40))
    return said(spark, sf_dir).select("conv_id", "turn", V.token_f1(F.col("text"), F.col("label")).alias("f1"), V.best_f1(F.col("text"), labels).alias("best"))


_SAYS = f"string_split(text, {lit('The answer is: ')})[-1]"
_TAG = "string_split(string_split(text, '<answer>')[-1], '</answer>')[1]"


@query(f"""WITH {SAID} SELECT conv_id, turn, CASE WHEN {norm_sql(_SAYS)} = {norm_sql('label')} THEN 1.0 ELSE 0.0 END AS answer,
  CASE WHEN contains(text, '<answer>') AND contains(text, '</answer>') AND {norm_sql(_TAG)} = {norm_sql('label')} THEN 1.0 ELSE 0.0 END AS tagged FROM s""")
def v07_v08_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, y = F.col("text"), F.col("label")
    return said(spark, sf_dir).select("conv_id", "turn", V.answer_match(t, y).alias("answer"), V.tagged_match(t, y).alias("tagged"))


_DONE = "string_split(string_split(text, '<finish>')[-1], '</finish>')[1]"


@query(f"""WITH {SAID}, f AS (SELECT conv_id, turn, "full", label, CASE WHEN turn % 4 = 1 THEN replace(replace(text, '<answer>', '<finish>'), '</answer>', '</finish>') WHEN turn % 4 = 2 THEN '<FINISH>' || text || '</Finish>' ELSE text END AS text FROM s),
  k AS (SELECT conv_id, turn, text, label, "full", {_bag(_DONE)} AS a, {_bag('label')} AS b, regexp_extract(text, '(?is)<finish>(.*?)</finish>', 1) AS found FROM f)
SELECT conv_id, turn, CASE WHEN NOT contains(text, '<finish>') AND NOT contains(text, '</finish>') OR {_DONE} = '' THEN 0.0 WHEN {_f1('a', 'b')} > 0 THEN {_f1('a', 'b')} ELSE 0.1 END AS f1,
  CASE WHEN {strip_sql('found')} <> '' AND {norm_sql('found')} IN ({norm_sql('label')}, {norm_sql(lit('The answer is: ') + ' || "full"[:60]')}) THEN 1.0 ELSE 0.0 END AS match FROM k""")
def v11_v12_finish(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, n = F.col("text"), F.col("turn") % 4
    text = F.when(n == 1, F.replace(F.replace(t, F.lit("<answer>"), F.lit("<finish>")), F.lit("</answer>"), F.lit("</finish>"))).when(n == 2, F.concat(F.lit("<FINISH>"), t, F.lit("</Finish>"))).otherwise(t)
    labels = F.array("label", F.concat(F.lit("The answer is: "), F.substring("full", 1, 60)))
    return said(spark, sf_dir).select("conv_id", "turn", V.finish_f1(text, F.col("label")).alias("f1"), V.any_label_match(text, labels).alias("match"))


@query(rf"""SELECT doc_id, 1.0 - abs(n_chars - 2000) / 8192 AS length, CASE WHEN n_chars < 2000 THEN 1.0 ELSE 1.0 - (n_chars - 2000) / 8192 END AS up_to,
  CASE WHEN regexp_matches(text, '(?s)^.*?</think>\s*<answer>.*?</answer>') THEN 1.0 ELSE 0.0 END AS format FROM documents""")
def v13_v18_length_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, wanted = F.col("n_chars"), F.lit(2000)
    return table(spark, sf_dir, "documents").select("doc_id", V.max_length(n, wanted, 8192).alias("length"), V.up_to_max_length(n, wanted, 8192).alias("up_to"), V.soft_format(F.col("text")).alias("format"))


@query(f"""WITH {SAID}, r AS (SELECT conv_id, CASE WHEN turn % 3 = 0 THEN CASE WHEN lower({_NUM}) = lower(label) THEN 1.0 ELSE 0.0 END WHEN turn % 3 = 1 THEN CASE WHEN {norm_sql(AFTER)} = {norm_sql('label')} THEN 1.0 ELSE 0.0 END END AS score, 1 + turn % 2 AS weight FROM s)
SELECT conv_id, coalesce(sum(score * weight), 0) AS reward, count(score) AS scored FROM r GROUP BY 1""")
def v16_v17_v19_weighted_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("turn") % 3 == 0, "number").when(F.col("turn") % 3 == 1, "puzzle").otherwise("unknown")
    row = F.struct(V.registry_score(name, F.col("text"), F.col("label")).alias("score"), (1 + F.col("turn") % 2).cast("double").alias("weight"))
    g = said(spark, sf_dir).groupBy("conv_id").agg(F.collect_list(row).alias("scores"))
    return g.select("conv_id", V.weighted_reward(F.col("scores")).alias("reward"), F.size(F.filter("scores", lambda s: s["score"].isNotNull())).cast("long").alias("scored"))


CONSTRAINTS = {
    "keywords": (lambda t: V.has_keywords(t, ["the", "an"]), "contains(lower(text), 'the') AND contains(lower(text), 'an')"),
    "times": (lambda t: V.keyword_times(t, "the", 1), r"len(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda x: x = 'the')) = 1"),
    "lacks": (lambda t: V.lacks_words(t, ["der", "que"]), "NOT contains(lower(text), 'der') AND NOT contains(lower(text), 'que')"),
    "letters": (lambda t: V.letter_times(t, "T", 2), "length(text) - length(replace(text, 'T', '')) = 2"),
    "stars": (lambda t: V.starred_paragraphs(t, 1), "len(string_split(text, '* * *')) = 1 AND trim(text) <> ''"),
    "words": (lambda t: V.word_count(t, 50, "around"), r"abs(len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) - 50) <= 5"),
    "paragraph": (lambda t: V.paragraph_starts(t, 1, "The", 1), f"len(string_split(text, chr(10) || chr(10))) = 1 AND starts_with({strip_sql('text')}, 'The')"),
    "postscript": (lambda t: V.has_postscript(t, "on "), f"contains(text, 'on ') AND length({strip_sql(chr(116) + 'ext[instr(text, ' + lit('on ') + '):]')}) > 3"),
    "placeholders": (lambda t: V.placeholders(t, 1), r"len(regexp_extract_all(text, '\[(.*?)\]')) >= 1"),
    "bullets": (lambda t: V.bullets(t, 0), rf"len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches({strip_sql('x')}, '^[*\-]'))) = 0"),
    "title": (V.has_title, "regexp_matches(text, '<<(.*?)>>')"),
    "highlights": (lambda t: V.highlights(t, 1), r"len(regexp_extract_all(text, '\*(.*?)\*')) >= 1"),
    "sections": (lambda t: V.sections(t, 2, "and"), "len(string_split(text, 'and')) - CASE WHEN starts_with(text, 'and') THEN 1 ELSE 0 END = 2"),
    "two": (V.two_responses, "len(string_split(text, '******')) = 2"),
    "upper": (V.is_upper, "text = upper(text)"),
    "lower": (V.is_lower, "text = lower(text)"),
    "capitals": (lambda t: V.capital_words(t, 1, "at least"), r"len(list_filter(regexp_extract_all(text, '[\p{L}\p{N}_]+'), lambda x: regexp_matches(x, '^[A-Z]+$'))) >= 1"),
    "ends": (lambda t: V.ends_with(t, "."), "ends_with(text, '.')"),
    "quoted": (V.is_quoted, "starts_with(text, '\"') AND ends_with(text, '\"')"),
    "commas": (V.no_commas, "NOT contains(text, ',')"),
}


@query("SELECT conv_id, turn, " + ", ".join(f"{sql} AS c_{name}" for name, (_, sql) in CONSTRAINTS.items()) + " FROM conversations")
def v20_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", *(f(F.col("text")).alias(f"c_{name}") for name, (f, _) in CONSTRAINTS.items()))


@query("SELECT event_id, json_valid(CASE WHEN event_id % 3 = 0 THEN props[2:] ELSE props END) AS valid FROM events")
def v20_json_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("event_id") % 3 == 0, F.expr("substring(props, 2)")).otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", V.is_json(text).alias("valid"))


@query("SELECT d.doc_id, starts_with(d.text, b.text[:8]) AS repeats FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % 40")
def v20_repeat_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").select("item_id", F.substring("text", 1, 8).alias("prompt"))
    d = table(spark, sf_dir, "documents").select("doc_id", "text", (F.col("doc_id") % 40).alias("item_id"))
    return d.join(b, "item_id").select("doc_id", V.repeats_prompt(F.col("text"), F.col("prompt")).alias("repeats"))


# Constraints of the larger registry with the SQL of their test.
_WORDS = r"regexp_extract_all({}, '[\p{{L}}\p{{N}}_'']+')"
_SPACED = r"list_filter(regexp_split_to_array({}, '\s+'), lambda x: x <> '')"
_W, _S, _L = _WORDS.format("text"), _SPACED.format("text"), _SPACED.format("lower(text)")
V21 = {
    "length_constraints:number_words": ({"num_words": 60, "relation": "at least"}, f"len({_W}) >= 60"),
    "detectable_content:number_placeholders": ({"num_placeholders": 1}, r"len(regexp_extract_all(text, '\[.*?\]')) >= 1"),
    "detectable_format:number_bullet_lists": ({"num_bullets": 0}, r"len(regexp_extract_all(text, '(?m)^\s*\*[^\*].*$')) + len(regexp_extract_all(text, '(?m)^\s*-.*$')) = 0"),
    "detectable_format:constrained_response": ({"options": ["the", "der"]}, "contains(text, 'the') OR contains(text, 'der')"),
    "combination:constrained_start": ({"starter": "The"}, r"regexp_matches(text, '(?m)^\s*The.*$')"),
    "paragraphs:paragraphs2": ({"num_paragraphs": 1}, "len(string_split(text, chr(10) || chr(10))) = 1 AND trim(text) <> ''"),
    "keywords:existence": ({"keywords": ["the", "an"]}, "regexp_matches(text, '(?i)the') AND regexp_matches(text, '(?i)an')"),
    "keywords:frequency": ({"keyword": "the", "frequency": 5, "relation": "less than"}, "len(regexp_extract_all(text, '(?i)the')) < 5"),
    "keywords:word_once": ({"keyword": "que"}, "len(regexp_extract_all(text, '(?i)que')) = 1"),
    "keywords:forbidden_words": ({"forbidden_words": ["der", "the"]}, f"NOT list_has_any(list_transform({_W}, lambda x: lower(x)), ['der', 'the'])"),
    "keywords:exclude_word_harder": ({"keyword": "the"}, "NOT contains(text, ' the ')"),
    "keywords:letter_frequency": ({"letter": "t", "let_frequency": 20, "let_relation": "at least"}, "length(lower(text)) - length(replace(lower(text), 't', '')) >= 20"),
    "letters:letter_counting": ({"N": 200, "relation": "less than"}, "len(regexp_extract_all(text, '[a-zA-Z]')) < 200"),
    "change_case:capital_word_frequency": ({"capital_frequency": 1, "capital_relation": "at least"}, f"len(list_filter({_W}, lambda x: x = upper(x) AND x <> lower(x))) >= 1"),
    "count:lowercase_counting": ({"N": 40}, f"len(list_filter({_W}, lambda x: regexp_matches(x, '^[a-z]+$'))) <= 40"),
    "keywords:no_adjacent_consecutive": ({}, f"len(list_filter(range(1, len({_L})), lambda i: unicode({_L}[i + 1]) - unicode({_L}[i]) = 1)) = 0"),
    "detectable_format:square_brackets": ({}, f"len(list_filter({_S}, lambda x: NOT (starts_with(x, '[') AND ends_with(x, ']')))) = 0"),
    "first_word:first_word_answer": ({"first_word": "the"}, f"coalesce({_L}[1] = 'the', false)"),
    "last_word:last_word_answer": ({"last_word": "the"}, rf"coalesce(regexp_replace({_L}[-1], '[^\p{{L}}\p{{N}}_\s]', '', 'g') = 'the', false)"),
    "count:count_unique": ({}, f"len(list_distinct({_W})) = len({_W})"),
    "new:palindrome": ({}, f"len(list_filter({_S}, lambda x: x = reverse(x))) > 0"),
    "punctuation:punctuation_dot": ({}, "NOT contains(text, '.')"),
    "punctuation:punctuation_exclamation": ({}, "NOT contains(text, '!')"),
    "detectable_format:title": ({}, "regexp_matches(text, '<<[^\\n]*[^<>\\n ]+[^\\n]*>>')"),
    "copy:copy": ({"prompt_to_repeat": "Than in"}, "lower(trim(text)) = 'than in'"),
}


@query("SELECT conv_id, turn, " + ", ".join(f"{sql} AS {name.split(':')[1]}" for name, (_, sql) in V21.items()) + " FROM conversations")
def v21_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", *(check(name, text, **args).alias(name.split(":")[1]) for name, (args, _) in V21.items()))


_MIXED = [(name, json.dumps(args), sql) for name, (args, sql) in V21.items()]
_CUT = {"t": "s", "f": "array_to_string(x[2:], chr(10))", "l": "array_to_string(x[:-2], chr(10))", "b": "array_to_string(x[2:-2], chr(10))"}


@query(f"""WITH r AS (SELECT conv_id, turn, {strip_sql("replace(replace(string_split(text, '</think>')[-1], '<answer>', ''), '</answer>', '')")} AS s FROM conversations),
  v AS (SELECT conv_id, turn, s, string_split(s, chr(10)) AS x FROM r),
  w AS (SELECT conv_id, turn, {strip_sql('s')} <> '' AS filled, unnest([{", ".join(["s"] + [strip_sql(c) for c in list(_CUT.values())[1:]])}]) AS u, unnest([true, false, false, false]) AS strict FROM v),
  o AS (SELECT conv_id, turn, filled, unnest([u, replace(u, '*', '')]) AS text, unnest([strict, false]) AS strict FROM w),
  i AS (SELECT o.*, j, (conv_id * 7 + turn * 3 + j * 5) % {len(_MIXED)} AS k FROM o, range(3) t(j)),
  m AS (SELECT conv_id, turn, j, strict, filled AND {strip_sql('text')} <> '' AND CASE k {" ".join(f"WHEN {n} THEN ({sql})" for n, (_, _, sql) in enumerate(_MIXED))} END AS met FROM i),
  e AS (SELECT conv_id, turn, j, bool_or(coalesce(met, false) AND strict) AS strict, bool_or(coalesce(met, false)) AS loose FROM m GROUP BY ALL)
SELECT conv_id, turn, count(*) FILTER (strict) / 3.0::DOUBLE AS score, count(*) FILTER (loose) / 3.0::DOUBLE AS score_loose, bool_and(strict) AS all_met, bool_and(loose) AS all_met_loose FROM e GROUP BY conv_id, turn""")
def v14_instruction_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*(F.struct(F.lit(name).alias("name"), F.lit(args).alias("arguments")) for name, args, _ in _MIXED))
    chosen = F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda j: F.get(kinds, ((F.col("conv_id") * 7 + F.col("turn") * 3 + j * 5) % len(_MIXED)).cast("int")))
    rows = table(spark, sf_dir, "conversations").withColumn("chosen", chosen).select("conv_id", "turn", "text", F.col("chosen.name").alias("names"), F.col("chosen.arguments").alias("arguments"))
    return instruction_scores(rows, "text", "names", "arguments", F.lit(None).cast("string")).select("conv_id", "turn", "score", "score_loose", "all_met", "all_met_loose")


@query("SELECT p_partkey, CASE WHEN p_size % 3 <> 2 OR p_partkey / 7 = 9 THEN 1.0 ELSE 0.0 END AS math, CASE WHEN p_size % 3 = 1 OR (p_size % 3 = 0 AND p_partkey = 0) OR (p_size % 3 = 2 AND p_partkey / 7 = 8) THEN 1.0 ELSE 0.0 END AS strict FROM part")
def v03_v04_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    # by value 63/7 is the last formula's 9, 56/7 the first's 8, and the letters of `so` times 0/7 are 0
    n = F.col("p_partkey").cast("string")
    said = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit(r"so \boxed{\frac{"), n, F.lit("}{7}}"))).when(F.col("p_size") % 3 == 1, F.concat(F.lit(r"Final Answer: The final answer is $\frac{"), n, F.lit("}{7}$. I hope it is correct."))).otherwise(F.lit("it is $8$, not $9$"))
    label = F.concat(F.lit(r"\frac{"), n, F.lit("}{7}"))
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_size").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))  # a small file of many formulas
    return rows.select("p_partkey", math_match(said, label).alias("math"), strict_math_match(said, label).alias("strict"))


@query(f"""WITH {SAID}, r AS (SELECT conv_id, CASE turn % 3 WHEN 0 THEN 'number' WHEN 1 THEN 'puzzle' END AS v, CASE WHEN turn % 3 = 0 THEN CASE WHEN lower({_NUM}) = lower(label) THEN 1.0 ELSE 0.0 END WHEN turn % 3 = 1 THEN CASE WHEN {norm_sql(AFTER)} = {norm_sql('label')} THEN 1.0 ELSE 0.0 END END AS score, 1 + turn % 2 AS weight FROM s)
SELECT conv_id, coalesce(sum(10 * score * weight), 0) AS reward, sum(10 * score * weight) FILTER (v = 'number') AS number, sum(10 * score * weight) FILTER (v = 'puzzle') AS puzzle FROM r GROUP BY 1""")
def v17_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.operators.outcomes import reward_breakdown

    name = F.when(F.col("turn") % 3 == 0, "number").when(F.col("turn") % 3 == 1, "puzzle").otherwise("unknown")
    rows = said(spark, sf_dir).withColumn("verifier", name)
    g = reward_breakdown(rows, "conv_id", "verifier", V.registry_score(F.col("verifier"), F.col("text"), F.col("label")), (1 + F.col("turn") % 2).cast("double"), 10.0)
    return g.select("conv_id", "reward", F.col("parts")["number"].alias("number"), F.col("parts")["puzzle"].alias("puzzle"))


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey % 3 <> 0 AS good, (l_orderkey + l_linenumber) % 6 AS form FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN good THEN 1.0 ELSE 0.0 END AS math, CASE WHEN good AND form IN (1, 2) THEN 1.0 ELSE 0.0 END AS strict FROM r""")
def v03_v04_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line's quantity as an answer in one spelling and as a label in another; a third of the labels are of another quantity."""
    form = (F.col("l_orderkey") + F.col("l_linenumber")) % 6
    q, k = F.col("l_quantity").cast("long"), F.col("l_linenumber").cast("long")
    of = q + F.when(F.col("l_partkey") % 3 == 0, 1).otherwise(0)
    answer = F.when(form == 0, F.format_string(r"it is \boxed{\frac{%d}{8}}", q)).when(form == 1, F.format_string(r"Final Answer: The final answer is $\sqrt{%d}$. I hope it is correct.", 2 * q * q))
    answer = answer.when(form == 2, F.format_string("it is $(x+%d)^2$", q)).when(form == 3, F.format_string(r"it is \boxed{2^{%d}\cdot %d}", k, q))
    answer = answer.when(form == 4, F.format_string(r"it is \boxed{%d\text{ units}}", q)).otherwise(F.format_string(r"it is \boxed{(%d, %d)}", q, k))
    label = F.when(form == 0, (of / 8).cast("decimal(12,3)").cast("string")).when(form == 1, F.format_string(r"%d\sqrt{2}", of)).when(form == 2, F.format_string("x^2+%dx+%d", 2 * of, of * of))
    label = label.when(form == 3, (of * F.pow(F.lit(2), k)).cast("long").cast("string")).when(form == 4, of.cast("string")).otherwise(F.format_string("(%d,%d)", of, k))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", answer.alias("a"), label.alias("b"))
    pairs = lines.groupBy("a", "b").agg(F.count("*").alias("n")).select(F.col("a").alias("x"), F.col("b").alias("y"), math_match(F.col("a"), F.col("b")).alias("math"), strict_math_match(F.col("a"), F.col("b")).alias("strict"))
    # lines share their spellings, so that each pair is compared once
    return lines.join(pairs, F.col("a").eqNullSafe(F.col("x")) & F.col("b").eqNullSafe(F.col("y"))).select("l_orderkey", "l_linenumber", "math", "strict")
