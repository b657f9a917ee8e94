"""Answers in LaTeX: where a text gives its answer, and a normal form to compare answers by. Answers are compared by `equations`."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.equations import any_same

# Replacements and removals of the published answer normalisation, in order.
SUBSTITUTIONS = [("an ", ""), ("a ", ""), (".$", "$"), ("\\$", ""), ("\\ ", ""), (" ", ""), ("mbox", "text"), (",\\text{and}", ","), ("\\text{and}", ","), ("\\text{m}", "\\text{}")]
REMOVED = [
    "square", "ways", "integers", "dollars", "mph", "inches", "ft", "hours", "km", "units", "\\ldots", "sue", "points", "feet", "minutes", "digits", "cents", "degrees", "cm", "gm", "pounds", "meters", "meals", "edges",
    "students", "childrentickets", "multiples", "\\text{s}", "\\text{.}", "\\text{\ns}", "\\text{}^2", "\\text{}^3", "\\text{\n}", "\\text{}", "\\mathrm{th}", "^\\circ", "^{\\circ}", "\\;", ",\\!", "{,}", '"', "\\dots",
]

# The patterns of the same normalisation (Lewkowycz et al., 2022, "Solving quantitative reasoning problems with language
# models", appendix on answer normalisation) and what replaces them, in order.
UNWRAPPED = [
    (r"(?dm)^[^$\n]*+\$([^$\n]*+)\$.*", r"\$$1\$"),  # written so that lines without dollars take linear time
    (r"\\text\{(.*?)\}", r"$1"),
    (r"\\textbf\{(.*?)\}", r"$1"),
    (r"\\overline\{(.*?)\}", r"$1"),
    (r"\\boxed\{(.*)\}", r"$1"),
    (r"frac([^{])(.)", r"frac{$1}{$2}"),
    (r"sqrt([^{])", r"sqrt{$1}"),
]

#: What balanced braces hold, nested nine deep, without backtracking.
_INSIDE = reduce(lambda inside, _: r"[^{}]*+(?:\{" + inside + r"\}[^{}]*+)*+", range(8), r"[^{}]*+")
_BLANK = " \t\n\x0b\x0c\r"


def boxed(text: Column) -> Column:
    """What the last `\\boxed{...}` holds, or what follows the last `\\boxed ` up to a dollar sign; null without either."""
    last = F.regexp_extract_all(F.substring_index(text, "\\boxed", -1), F.lit(r"^\{(" + _INSIDE + r")\}"), F.lit(1))
    braces = F.when(F.contains(text, F.lit("\\boxed")) & (F.size(last) > 0), F.get(last, F.lit(0)))
    loose = F.substring_index(F.substring_index(text, "\\boxed ", -1), "$", 1)
    return F.when(F.contains(text, F.lit("\\boxed ")), loose).otherwise(braces)


def stated(text: Column) -> Column:
    """What `Final Answer: The final answer is ... I hope it is correct.` says; null without it."""
    found = F.regexp_extract_all(F.concat(text, F.lit("I hope it is correct.")), F.lit(r"Final Answer: The final answer is(.*?). I hope it is correct."), F.lit(1))
    return F.btrim(F.get(found, F.lit(0)), F.lit(_BLANK))


def last_formula(text: Column) -> Column:
    """The text between the last two dollar signs; null with fewer."""
    parts = F.split(text, r"\$")
    return F.when(F.size(parts) > 2, F.element_at(parts, -2))


def normal(answer: Column) -> Column:
    """The normal form of an answer."""
    out = F.substring_index(answer, "=", -1)
    for old, new in [*SUBSTITUTIONS, *((x, "") for x in REMOVED)]:
        out = F.replace(out, F.lit(old), F.lit(new))
    for pattern, by in UNWRAPPED:
        out = F.regexp_replace(out, pattern, by)
    out = F.replace(out, F.lit("$"), F.lit(""))
    bare = F.replace(out, F.lit(","), F.lit(""))
    return F.when(bare.rlike(r"^\d+$"), bare).otherwise(out)


def math_match(text: Column, label: Column) -> Column:
    """1.0 if the boxed or the stated answer is the label; without either, the last formula's; without that, the whole text or its normal form.

    Null texts and labels score 0.0.
    """
    box, said, formula = boxed(text), stated(text), last_formula(text)
    direct = box.isNotNull() | said.isNotNull()
    second = normal(F.when(direct, said).otherwise(F.coalesce(formula, text)))  # the normal form of one of them alone
    third = F.when(~direct & formula.isNull(), text)
    return F.when(any_same(F.array(box, second, third), label), 1.0).otherwise(0.0)


def strict_math_match(text: Column, label: Column) -> Column:
    """1.0 if the stated answer, or the whole text without one, is the label, in normal form."""
    return F.when(any_same(F.array(normal(F.coalesce(stated(text), text))), label), 1.0).otherwise(0.0)
