"""Answer verifiers and format constraints as column functions: 1.0 or 0.0, or a boolean for constraints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.text import let, replace_all, strip

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def score(condition: Column) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), 1.0).otherwise(0.0)


def without_thinking(text: Column) -> Column:
    """What follows the last `</think>`, without answer tags and white space around."""
    return strip(replace_all(F.substring_index(text, "</think>", -1), [("<answer>", ""), ("</answer>", "")]))


NUMBER = r"[-+]?(?:\d*\.\d+|\d+)"


def last_number(text: Column) -> Column:
    """The last number of a text with its sign, thousands commas dropped; the whole text without any."""
    plain = F.regexp_replace(text, r"(\d),(\d)", "$1$2")
    found = F.regexp_extract_all(plain, F.lit(NUMBER), F.lit(0))
    return F.when(F.size(found) > 0, F.element_at(found, -1)).otherwise(plain)


def number_match(text: Column, label: Column) -> Column:
    return score(F.lower(last_number(text)) == F.lower(label))


def normalized(text: Column) -> Column:
    """Lower case, without ASCII punctuation and articles, single spaces."""
    words = F.split(F.translate(F.lower(text), PUNCTUATION, ""), r"\s+")
    return F.array_join(F.filter(words, lambda x: ~x.isin("", "a", "an", "the")), " ")


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(normalized(text), " "), "")


def token_f1(text: Column, label: Column) -> Column:
    """F1 of the multisets of normalised words; 0 without any in common."""
    count = lambda words, w: F.size(F.filter(words, lambda x: x == w))

    def score_of(s: Column) -> Column:
        common = F.aggregate(F.array_distinct(s["a"]), F.lit(0), lambda n, w: n + F.least(count(s["a"], w), count(s["b"], w)))
        return F.when(common > 0, 2.0 * common / (F.size(s["a"]) + F.size(s["b"]))).otherwise(0.0)

    return let(F.struct(tokens(text).alias("a"), tokens(label).alias("b")), score_of)


def best_f1(text: Column, labels: Column) -> Column:
    """The highest F1 over an array of labels."""
    return F.coalesce(F.array_max(F.transform(labels, lambda x: token_f1(without_thinking(text), x))), F.lit(0.0))


def answer_match(text: Column, label: Column) -> Column:
    """Normalised equality with what follows the last `The answer is: `, or with the whole text without it."""
    return score(normalized(F.substring_index(text, "The answer is: ", -1)) == normalized(label))


def tagged_match(text: Column, label: Column, tag: str = "answer") -> Column:
    """Normalised equality with what follows the last opening tag, as far as the closing one; 0 unless both tags are there."""
    both = (F.instr(text, f"<{tag}>") > 0) & (F.instr(text, f"</{tag}>") > 0)
    said = F.substring_index(F.substring_index(text, f"<{tag}>", -1), f"</{tag}>", 1)
    return score(both & (normalized(said) == normalized(label)))


def puzzle_match(text: Column, label: Column) -> Column:
    return score(normalized(without_thinking(text)) == normalized(label))


def finish_f1(text: Column, label: Column) -> Column:
    """F1 of what follows the last `<finish>` up to an end tag, the best over the labels of a JSON list; one of the two tags is enough.
    An empty part scores 0, one that shares nothing 0.1."""
    tagged = (F.instr(text, "<finish>") > 0) | (F.instr(text, "</finish>") > 0)
    answer = F.substring_index(F.substring_index(text, "<finish>", -1), "</finish>", 1)
    listed = F.when(F.startswith(strip(label), F.lit("[")), F.from_json(label, "array<string>"))
    f1 = F.coalesce(F.array_max(F.transform(F.coalesce(listed, F.array(strip(label))), lambda x: token_f1(answer, x))), F.lit(0.0))
    return F.when(~tagged | (answer == ""), 0.0).when(f1 > 0, f1).otherwise(0.1)


def any_label_match(text: Column, labels: Column, tag: str = "finish") -> Column:
    """Normalised equality of the first tagged part, unless it is blank, with any of an array of labels; tags in any case."""
    said = F.regexp_extract(text, f"(?is)<{tag}>(.*?)</{tag}>", 1)
    return score((strip(said) != "") & F.exists(labels, lambda x: normalized(x) == normalized(said)))


def max_length(n: Column, wanted: Column, longest: float) -> Column:
    """1 less the distance from the wanted length, as a share of the configured longest; it may get negative."""
    return 1.0 - F.abs(n - wanted) / longest


def up_to_max_length(n: Column, wanted: Column, longest: float) -> Column:
    """1 for fewer than the wanted length, else less what is over, as a share of the configured longest; it may get negative."""
    return F.when(n < wanted, 1.0).otherwise(1.0 - (n - wanted) / longest)


def soft_format(text: Column) -> Column:
    return score(text.rlike(r"(?s)^.*?</think>\s*<answer>.*?</answer>"))


def weighted_reward(scores: Column) -> Column:
    """Sum of score * weight over an array of structs; null scores, of unknown verifiers, are skipped."""
    return F.aggregate(F.filter(scores, lambda s: s["score"].isNotNull()), F.lit(0.0), lambda a, s: a + s["score"] * s["weight"])


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, r"\s+"), "")


def letter_runs(text: Column) -> Column:
    """Runs of letters, digits and underscores of any script."""
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def compared(n: Column, wanted: int, how: str, tolerance: int = 0) -> Column:
    """`at least`, `at most` or `around` a number; false for any other word."""
    return {"at least": n >= wanted, "at most": n <= wanted, "around": F.abs(n - wanted) <= tolerance}.get(how, F.lit(False))


# Format constraints.


def has_keywords(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.instr(F.lower(text), w.lower()) > 0 for w in words], F.lit(True))


def keyword_times(text: Column, word: str, n: int) -> Column:
    return F.size(F.filter(letter_runs(F.lower(text)), lambda x: x == word.lower())) == n


def lacks_words(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.instr(F.lower(text), w.lower()) == 0 for w in words], F.lit(True))


def letter_times(text: Column, letter: str, n: int) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(letter), F.lit(""))) == n


def starred_paragraphs(text: Column, n: int) -> Column:
    """n paragraphs between `* * *` dividers, none of them empty."""
    parts = F.transform(F.split(text, r"\* \* \*"), strip)
    return (F.size(parts) == n) & ~F.exists(parts, lambda x: x == "")


def word_count(text: Column, n: int, how: str) -> Column:
    return compared(F.size(words_of(text)), n, how, max(round(n * 0.1), 1))


def sentence_count(text: Column, n: int, how: str) -> Column:
    return compared(F.size(F.split(text, r"(?<!\w\.\w.)(?<![A-Z][a-z]\.)(?<=\.|\?)\s")), n, how, 1)


def paragraph_starts(text: Column, n: int, first: str, i: int) -> Column:
    parts = F.split(text, "\n\n")
    return (F.size(parts) == n) & F.coalesce(F.startswith(strip(F.get(parts, F.lit(i - 1))), F.lit(first)), F.lit(False))


def has_postscript(text: Column, marker: str) -> Column:
    return (F.instr(text, marker) > 0) & (F.length(strip(F.substr(text, F.greatest(F.instr(text, marker), F.lit(1))))) > len(marker))


def placeholders(text: Column, n: int) -> Column:
    return count_of(text, r"\[(.*?)\]") >= n


def bullets(text: Column, n: int) -> Column:
    return F.size(F.filter(F.split(text, "\n"), lambda x: strip(x).rlike(r"^[*\-]"))) == n


def has_title(text: Column) -> Column:
    return text.rlike(r"<<(.*?)>>")


def is_part_of_choice(text: Column, options: list[str]) -> Column:
    """The text is inside an option, not the other way round."""
    return reduce(lambda a, b: a | b, [F.instr(F.lit(o), text) > 0 for o in options], F.lit(False))


def highlights(text: Column, n: int) -> Column:
    return count_of(text, r"\*(.*?)\*") >= n


def sections(text: Column, n: int, mark: str) -> Column:
    parts = F.split(text, F.lit(f"\\Q{mark}\\E"))
    return F.size(parts) - F.when(parts[0] == "", 1).otherwise(0) == n


def is_json(text: Column) -> Column:
    """One JSON value: the only element when brackets are put around it, so nothing may follow it."""
    inside = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")
    return F.coalesce(F.size(inside) == 1, F.lit(False)) & F.try_parse_json(text).isNotNull()


def repeats_prompt(text: Column, prompt: Column) -> Column:
    return F.startswith(text, prompt)


def two_responses(text: Column) -> Column:
    parts = F.split(text, r"\*{6}")
    return (F.size(parts) == 2) & (strip(parts[0]) != strip(F.get(parts, F.lit(1))))


def is_upper(text: Column) -> Column:
    return text == F.upper(text)


def is_lower(text: Column) -> Column:
    return text == F.lower(text)


def capital_words(text: Column, n: int, how: str) -> Column:
    return compared(F.size(F.filter(letter_runs(text), lambda x: x.rlike("^[A-Z]+$"))), n, how)


def ends_with(text: Column, phrase: str) -> Column:
    return F.endswith(text, F.lit(phrase))


def is_quoted(text: Column) -> Column:
    return F.startswith(text, F.lit('"')) & F.endswith(text, F.lit('"'))


def no_commas(text: Column) -> Column:
    return F.instr(text, ",") == 0


VERIFIERS = {"number": number_match, "puzzle": puzzle_match, "answer": answer_match, "tagged": tagged_match, "f1": token_f1, "finish": finish_f1}


def registry_score(name: Column, text: Column, label: Column) -> Column:
    """The score of the verifier that a column names; null for unknown names."""
    out = F.lit(None).cast("double")
    for key, f in VERIFIERS.items():
        out = F.when(name == key, f(text, label)).otherwise(out)
    return out

