"""Instruction constraints by name: a registry of boolean column functions of a response and its arguments.

Words are runs of letters, digits, underscores and apostrophes; sentences end at `.`, `!` or `?` with white space after it. Language
constraints take a language column, which the caller gets from a classifier.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import let, strip
from tessella.functions.verifiers import is_json, without_thinking, words_of

Constraint = Callable[..., Column]
INSTRUCTIONS: dict[str, Constraint] = {}
WORD = r"[\p{L}\p{N}_']+"


def instruction(name: str) -> Callable[[Constraint], Constraint]:
    def register(f: Constraint) -> Constraint:
        INSTRUCTIONS[name] = f
        return f

    return register


def given(argument: object) -> Column:
    """An argument as a column: itself, or a literal (lists as arrays of strings)."""
    if isinstance(argument, Column):
        return argument
    return F.array(*map(F.lit, argument)).cast("array<string>") if isinstance(argument, list) else F.lit(argument)


def pattern_of(*parts: str | Column) -> Column:
    return F.concat(*map(given, parts))


def found(text: Column, pattern: str | Column, flags: str = "") -> Column:
    return F.regexp_count(text, pattern_of(flags, pattern))


def related(n: Column, relation: str | Column, wanted: int | Column) -> Column:
    """`less than` or `at least`; another word is a ValueError, in a column null."""
    if isinstance(relation, Column):
        return F.when(relation == "less than", n < wanted).when(relation == "at least", n >= wanted)
    if relation not in ("less than", "at least"):
        raise ValueError(f"no such relation: {relation}")
    return n < wanted if relation == "less than" else n >= wanted


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), strip), lambda x: x != "")


def parts(text: Column, divider: str) -> Column:
    return F.transform(F.split(text, divider), strip)


def n_parts(text: Column, divider: str) -> Column:
    """Parts between dividers, empty ones at the ends not counted; null if one in the middle is empty."""
    p = parts(text, divider)
    inner = F.slice(p, 2, F.greatest(F.size(p) - 2, F.lit(0)))
    ends = F.when(p[0] == "", 1).otherwise(0) + F.when((F.size(p) > 1) & (F.element_at(p, -1) == ""), 1).otherwise(0)
    return F.when(~F.exists(inner, lambda x: x == ""), F.size(p) - ends)


def same(a: Column, b: Column) -> Column:
    return F.lower(strip(a)) == F.lower(strip(b))


@instruction("language:response_language")
def response_language(text: Column, language: str, detected: Column) -> Column:
    return detected == language


@instruction("length_constraints:number_sentences")
def number_sentences(text: Column, num_sentences: int, relation: str) -> Column:
    return related(F.size(sentences(text)), relation, num_sentences)


@instruction("detectable_content:number_placeholders")
def number_placeholders(text: Column, num_placeholders: int) -> Column:
    return found(text, r"\[.*?\]") >= num_placeholders


@instruction("detectable_format:number_bullet_lists")
def number_bullets(text: Column, num_bullets: int) -> Column:
    return found(text, r"^\s*\*[^\*].*$", "(?m)") + found(text, r"^\s*-.*$", "(?m)") == num_bullets


@instruction("detectable_format:constrained_response")
def constrained_response(text: Column, options: list[str]) -> Column:
    return F.exists(given(options), lambda o: F.contains(strip(text), o))


@instruction("combination:constrained_start")
def constrained_start(text: Column, starter: str) -> Column:
    return F.regexp_like(text, pattern_of(r"(?m)^\s*", starter, ".*$"))


@instruction("detectable_format:number_highlighted_sections")
def number_highlights(text: Column, num_highlights: int) -> Column:
    full = lambda pattern: F.size(F.filter(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: F.trim(F.replace(x, F.lit("*"), F.lit(""))) != ""))
    return full(r"\*[^\n\*]*\*") + full(r"\*\*[^\n\*]*\*\*") >= num_highlights


@instruction("detectable_format:multiple_sections")
def multiple_sections(text: Column, section_spliter: str, num_sections: int) -> Column:
    return found(text, pattern_of(r"\s?", section_spliter, r"\s?\d+\s?")) >= num_sections


@instruction("length_constraints:number_paragraphs")
@instruction("paragraphs:paragraphs")
def number_paragraphs(text: Column, num_paragraphs: int = 2) -> Column:
    return F.coalesce(n_parts(text, r"\s?\*\*\*\s?") == num_paragraphs, F.lit(False))


@instruction("paragraphs:paragraphs2")
def blank_line_paragraphs(text: Column, num_paragraphs: int = 2) -> Column:
    return F.coalesce(n_parts(text, "\n\n") == num_paragraphs, F.lit(False))


@instruction("detectable_content:postscript")
def postscript(text: Column, postscript_marker: str) -> Column:
    marker = given(postscript_marker)
    pattern = F.when(marker == "P.P.S", r"\s*p\.\s?p\.\s?s.*$").when(marker == "P.S.", r"\s*p\.\s?s\..*$").otherwise(pattern_of(r"\s*", F.lower(marker), ".*$"))
    return F.regexp_like(F.lower(text), pattern_of("(?m)", pattern))


@instruction("keywords:existence")
def keywords_exist(text: Column, keywords: list[str]) -> Column:
    return F.forall(given(keywords), lambda k: F.regexp_like(text, pattern_of("(?i)", k)))


@instruction("keywords:frequency")
@instruction("keywords:keyword_frequency_different")
def keyword_frequency(text: Column, keyword: str, frequency: int, relation: str) -> Column:
    return related(found(text, keyword, "(?i)"), relation, frequency)


@instruction("keywords:word_once")
def keyword_once(text: Column, keyword: str) -> Column:
    return found(text, keyword, "(?i)") == 1


@instruction("keywords:word_count_different_numbers")
def keyword_counts(text: Column, keyword1: str, keyword2: str) -> Column:
    return (found(text, keyword1, "(?i)") == 1) & (found(text, keyword2, "(?i)") == 2)


@instruction("length_constraints:number_words")
def number_words(text: Column, num_words: int, relation: str) -> Column:
    return related(F.size(words(text)), relation, num_words)


@instruction("detectable_format:json_format")
def json_format(text: Column) -> Column:
    return is_json(strip(F.regexp_replace(F.regexp_replace(strip(text), r"^```(?:json|Json|JSON)?", ""), r"```$", "")))


@instruction("length_constraints:nth_paragraph_first_word")
def nth_paragraph_first_word(text: Column, num_paragraphs: int, nth_paragraph: int, first_word: str) -> Column:
    p = parts(text, "\n\n")
    n = F.size(F.filter(p, lambda x: x != ""))
    first = F.lower(F.regexp_extract(F.get(p, (given(nth_paragraph) - 1).cast("int")), r"^[\"']*([^\s.,?!'\"]*)", 1))
    return (n == num_paragraphs) & (n >= nth_paragraph) & F.coalesce(first == F.lower(given(first_word)), F.lit(False))


@instruction("keywords:key_sentences")
def key_sentences(text: Column, key_sentences: list[str], num_sentences: int) -> Column:
    s = sentences(text)
    return F.size(F.filter(given(key_sentences), lambda k: F.array_contains(s, k))) == num_sentences


@instruction("keywords:forbidden_words")
def forbidden_words(text: Column, forbidden_words: list[str]) -> Column:
    return ~F.arrays_overlap(F.transform(words(text), F.lower), F.transform(given(forbidden_words), F.lower))


@instruction("keywords:exclude_word_harder")
def exclude_word(text: Column, keyword: str) -> Column:
    return ~F.contains(text, pattern_of(" ", keyword, " "))


@instruction("detectable_content:rephrase_paragraph")
def rephrase_paragraph(text: Column, original_paragraph: str, low: int, high: int) -> Column:
    """Words in common, by their counts, between low and high."""
    theirs = words(F.lower(given(original_paragraph)))
    count = lambda ws, w: F.size(F.filter(ws, lambda x: x == w))
    return let(words(F.lower(text)), lambda mine: F.aggregate(F.array_distinct(theirs), F.lit(0), lambda n, w: n + F.least(count(mine, w), count(theirs, w)))).between(low, high)


@instruction("detectable_content:rephrase")
def rephrase(text: Column, original_message: str) -> Column:
    """Only what stands between asterisks differs; without such a part it is false."""
    bare = lambda x: F.regexp_replace(x, r"\*.*\*", "")
    return text.rlike(r"\*.*\*") & (bare(text) == bare(given(original_message)))


@instruction("combination:two_responses")
def two_responses(text: Column) -> Column:
    p = parts(text, r"\*{6}")
    good = F.filter(p, lambda x: x != "")
    inner = F.slice(p, 2, F.greatest(F.size(p) - 2, F.lit(0)))
    return (F.size(good) == 2) & (F.get(good, F.lit(0)) != F.get(good, F.lit(1))) & ~F.exists(inner, lambda x: x == "")


@instruction("combination:repeat_prompt")
def repeat_prompt(text: Column, prompt_to_repeat: str) -> Column:
    return F.startswith(F.lower(strip(text)), F.lower(strip(given(prompt_to_repeat))))


@instruction("copy:copy")
@instruction("copy:copying_simple")
def copy(text: Column, prompt_to_repeat: str) -> Column:
    return same(text, given(prompt_to_repeat))


@instruction("copy:copy_span_idx")
def copy_span(text: Column, prompt_to_repeat: str, n_start: int, n_end: int) -> Column:
    return same(text, F.substring(given(prompt_to_repeat), (given(n_start) + 1).cast("int"), (given(n_end) - given(n_start)).cast("int")))


@instruction("copy:copying_multiple")
def copy_times(text: Column, prompt_to_repeat: str, N: int) -> Column:
    p = F.split(text, r"\*{6}")
    return (F.size(p) == N) & F.forall(p, lambda x: same(x, given(prompt_to_repeat)))


@instruction("copy:repeat_phrase")
def repeat_phrase(text: Column, phrase: str, small_n: int) -> Column:
    """The phrase so often, each time with one word between its ends replaced at most."""
    ref = words_of(given(phrase))
    said = F.regexp_extract_all(text, pattern_of(F.get(ref, F.lit(0)), " .*? ", F.element_at(ref, -1)), F.lit(0))
    changed = lambda p: F.size(F.filter(F.zip_with(words_of(p), ref, lambda a, b: ~a.eqNullSafe(b)), lambda x: x))
    return (F.size(said) == small_n) & F.forall(said, lambda p: (F.size(words_of(p)) == F.size(ref)) & (changed(p) == 1))


@instruction("startend:end_checker")
def ends_with(text: Column, end_phrase: str) -> Column:
    return F.endswith(F.lower(F.regexp_replace(strip(text), '^"+|"+$', "")), F.lower(strip(given(end_phrase))))


@instruction("detectable_format:title")
def title(text: Column) -> Column:
    return F.exists(F.regexp_extract_all(text, F.lit(r"<<[^\n]+>>"), F.lit(0)), lambda x: F.trim(F.regexp_replace(x, r"^<+|>+$", "")) != "")


@instruction("keywords:letter_frequency")
def letter_frequency(text: Column, letter: str, let_frequency: int, let_relation: str) -> Column:
    low = F.lower(text)
    return related(F.length(low) - F.length(F.replace(low, given(letter), F.lit(""))), let_relation, let_frequency)


@instruction("letters:letter_counting")
def letter_counting(text: Column, N: int, relation: str) -> Column:
    return related(found(text, "[a-zA-Z]"), relation, N)


@instruction("change_case:english_capital")
def capitals(text: Column, detected: Column) -> Column:
    return (text == F.upper(text)) & (F.upper(text) != F.lower(text)) & (detected == "en")


@instruction("change_case:english_lowercase")
def lowercase(text: Column, detected: Column) -> Column:
    return (text == F.lower(text)) & (F.upper(text) != F.lower(text)) & (detected == "en")


@instruction("punctuation:no_comma")
def no_comma(text: Column) -> Column:
    return F.instr(text, ",") == 0


@instruction("punctuation:punctuation_dot")
def no_dot(text: Column) -> Column:
    return F.instr(text, ".") == 0


@instruction("punctuation:punctuation_exclamation")
def no_exclamation(text: Column) -> Column:
    return F.instr(text, "!") == 0


@instruction("change_case:capital_word_frequency")
def capital_word_frequency(text: Column, capital_frequency: int, capital_relation: str) -> Column:
    n = F.size(F.filter(words(text), lambda x: (x == F.upper(x)) & (x != F.lower(x))))
    return related(n, capital_relation, capital_frequency)


@instruction("count:lowercase_counting")
def lowercase_counting(text: Column, N: int) -> Column:
    return F.size(F.filter(words(text), lambda x: x.rlike("^[a-z]+$"))) <= N


@instruction("startend:quotation")
def quotation(text: Column) -> Column:
    s = strip(text)
    return (F.length(s) > 1) & F.startswith(s, F.lit('"')) & F.endswith(s, F.lit('"'))


@instruction("detectable_format:sentence_hyphens")
def sentence_hyphens(text: Column) -> Column:
    """Sentences joined by hyphens, with no space around them."""
    return F.forall(F.split(text, "-"), lambda x: x == strip(x)) & F.forall(F.split(text, "-"), lambda x: F.size(sentences(x)) <= 1)


@instruction("keywords:no_adjacent_consecutive")
def no_adjacent_letters(text: Column) -> Column:
    """No word begins with the letter after that of the word before it."""
    first = F.transform(words_of(F.lower(text)), lambda x: F.ascii(x))
    return let(first, lambda a: ~F.exists(F.zip_with(a, F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0))), lambda x, y: F.coalesce(y - x == 1, F.lit(False))), lambda x: x))


@instruction("detectable_format:square_brackets")
def square_brackets(text: Column) -> Column:
    return F.forall(words_of(text), lambda x: F.startswith(x, F.lit("[")) & F.endswith(x, F.lit("]")))


@instruction("detectable_format:bigram_wrapping")
def bigram_wrapping(text: Column) -> Column:
    wrapped = lambda w: F.transform(w, lambda x, i: F.when((i % 2 == 0) & (i + 1 < F.size(w)), F.startswith(x, F.lit("<<"))).when(i % 2 == 1, F.endswith(x, F.lit(">>"))).otherwise(F.lit(True)))
    return F.forall(let(words_of(text), wrapped), lambda x: x)


@instruction("first_word:first_word_sent")
def first_word_of_sentences(text: Column, first_word: str) -> Column:
    return F.forall(sentences(text), lambda s: F.lower(F.get(words_of(s), F.lit(0))) == F.lower(given(first_word)))


@instruction("first_word:first_word_answer")
def first_word_of_answer(text: Column, first_word: str) -> Column:
    return F.coalesce(F.lower(F.get(words_of(text), F.lit(0))) == F.lower(given(first_word)), F.lit(False))


def _last_bare(text: Column) -> Column:
    w = words_of(text)
    return F.when(F.size(w) > 0, F.lower(F.regexp_replace(F.element_at(w, -1), r"[^\p{L}\p{N}_\s]", "")))


@instruction("last_word:last_word_sent")
def last_word_of_sentences(text: Column, last_word: str) -> Column:
    return F.forall(sentences(text), lambda s: F.coalesce(_last_bare(s) == F.lower(given(last_word)), F.lit(False)))


@instruction("last_word:last_word_answer")
def last_word_of_answer(text: Column, last_word: str) -> Column:
    return F.coalesce(_last_bare(text) == F.lower(given(last_word)), F.lit(False))


@instruction("count:counting_composition")
def counting_composition(text: Column, n_sent: int, n_words: int) -> Column:
    """Three paragraphs between `***`, each of n_sent sentences of n_words words."""
    p = F.filter(parts(text, r"\s?\*\*\*\s?"), lambda x: x != "")
    return (F.size(p) == 3) & F.forall(p, lambda x: (F.size(sentences(x)) == n_sent) & F.forall(sentences(x), lambda s: F.size(words(s)) == n_words))


@instruction("count:count_unique")
def unique_words(text: Column) -> Column:
    return let(words(text), lambda w: F.size(F.array_distinct(w)) == F.size(w))


@instruction("new:palindrome")
def palindrome(text: Column) -> Column:
    return F.exists(words_of(text), lambda x: x == F.reverse(x))


@instruction("keywords:keyword_specific_position")
def keyword_position(text: Column, keyword: str, n: int, m: int) -> Column:
    return F.coalesce(F.get(words(F.get(sentences(text), (given(n) - 1).cast("int"))), (given(m) - 1).cast("int")) == keyword, F.lit(False))


@instruction("keywords:start_end")
def start_end(text: Column) -> Column:
    w = words(text)
    return (F.size(w) >= 2) & (F.lower(w[0]) == F.lower(F.element_at(w, -1))) & text.rlike(rf"{WORD}\s*$")


def check(name: str, text: Column, **arguments: object) -> Column:
    """A constraint by name; null responses meet none. ValueError for an unknown name."""
    if name not in INSTRUCTIONS:
        raise ValueError(f"unknown instruction: {name}")
    return F.coalesce(INSTRUCTIONS[name](text, **arguments), F.lit(False))


def argument(arguments: Column, name: str, kind: str) -> Column:
    """A constraint's argument by its annotated type out of a map of JSON values; names differ by case alone, so it isn't a struct."""
    value = F.get(F.map_values(F.map_filter(arguments, lambda k, _: k == name)), F.lit(0))
    return {"int": lambda: value.try_cast("long"), "list[str]": lambda: F.from_json(value, "array<string>")}.get(kind, lambda: value)()


def dispatch(name: Column, text: Column, arguments: Column, detected: Column) -> Column:
    """Whether the text meets the constraint whose name and arguments (a map of JSON values) are columns: one expression for
    all constraints, of which a row computes its own alone. A missing argument meets none, an unknown name is an error."""
    branches = None
    for known, f in INSTRUCTIONS.items():
        values = {}
        for arg, p in list(inspect.signature(f).parameters.items())[1:]:
            value = detected if arg == "detected" else argument(arguments, arg, p.annotation)
            values[arg] = value if p.default is inspect.Parameter.empty else F.coalesce(value, F.lit(p.default))
        met = F.coalesce(f(text, **values), F.lit(False))
        branches = F.when(name == known, met) if branches is None else branches.when(name == known, met)
    return branches.otherwise(F.raise_error(F.concat(F.lit("unknown instruction: "), F.coalesce(name, F.lit("null")))).cast("boolean"))


def loosened(text: Column) -> Column:
    """The text and its looser readings: without its first, last, or both of these lines, each with and without asterisks."""
    lines = F.split(text, "\n")
    n = F.size(lines)
    cut = lambda start, less: strip(F.array_join(F.slice(lines, start, F.greatest(n - less, F.lit(0))), "\n"))
    plain = [text, cut(2, 1), cut(1, 1), cut(2, 2)]
    return F.array(*plain, *(F.replace(x, F.lit("*"), F.lit("")) for x in plain))


def followed(response: Column, names: Column, arguments: Column, detected: Column) -> Column:
    """(strict, loose) for each of a response's instructions. names: array of constraint names; arguments: array of JSON objects beside it,
    null for none. Strict is the response itself, loose any of its looser readings; a blank response meets nothing."""
    parsed = F.transform(arguments, lambda a: F.from_json(F.coalesce(a, F.lit("{}")), "map<string,string>"))
    blank = strip(response) == ""

    def each(both: Column) -> Column:
        met = F.transform(loosened(response), lambda t: ~F.coalesce(blank, F.lit(True)) & (strip(t) != "") & dispatch(both["name"], t, both["arguments"], detected))
        return let(met, lambda m: F.struct(m[0].alias("strict"), F.exists(m, lambda x: x).alias("loose")))

    return F.transform(F.arrays_zip(names.alias("name"), parsed.alias("arguments")), each)


def instruction_scores(rows: DataFrame, response: str, names: str, arguments: str, detected: Column) -> DataFrame:
    """The rows with score (share of the instructions that the response meets), score_loose, all_met and all_met_loose.

    The response counts without its thinking part. No instruction scores 0; a null response meets none."""
    marked = rows.withColumn("met__", followed(without_thinking(F.col(response)), F.col(names), F.col(arguments), detected))
    n = F.size("met__")
    share = lambda kind: F.when(n > 0, F.size(F.filter("met__", lambda x: x[kind])) / n).otherwise(F.lit(0.0))
    return marked.withColumn("score", share("strict")).withColumn("score_loose", share("loose")).withColumn("all_met", F.col("score") == 1).withColumn("all_met_loose", F.col("score_loose") == 1).drop("met__")
