"""Answers in LaTeX: stripped forms, equal values, and what the verifiers take from a text."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessella.functions import equations, latex


def column(spark, rows, make):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, text string, label string")
    return [r.v for r in df.select("i", make(F.col("text"), F.col("label")).alias("v")).orderBy("i").collect()]


def test_stripped():
    rows = [
        (r"\frac{1}{2}", r"\frac{1}{2}"), (r"\frac 1 2", r"\frac{1}{2}"), (r"  \frac{1}{2}  ", r"\frac{1}{2}"), (r"\left(\frac{1}{2}\right)", r"(\frac{1}{2})"), (r"50\%", "50"),
        ("0.5", r"\frac{1}{2}"), (r"\tfrac{3}{4}", r"\frac{3}{4}"), (r"\sqrt2", r"\sqrt{2}"), ("1 + 2", "1+2"), (".5", r"\frac{1}{2}"), ("k = 7", "7"), ("abc=7", "abc=7"), ("3/4", r"\frac{3}{4}"),
        ("03/4", "03/4"), ("x/y", None), (r"\sqrt", None), (r"\frac", None), (r"5\text{ cm}", "5"), (r"5\text{ a}\text{ b}", None), (r"\frac1{72}", r"\frac{1}{72}"), (r"\frac1", r"\frac1"), (r"90^\circ", "90"), ("", ""),
    ]
    assert [equations.stripped(text) for text, _ in rows] == [want for _, want in rows]


EQUAL = [
    (r"\frac{1}{2}", "0.5"), (r"\frac12", ".5"), ("1,000", "1000"), ("2^{10}", "1024"), ("2^10", "1024"), ("(x+1)^2", "x^2+2x+1"), (r"\sqrt{8}", r"2\sqrt{2}"), (r"\frac{\pi}{3}", r"\pi/3"), (r"\sin^2 x+\cos^2 x", "1"),
    (r"\log_2 8", "3"), (r"\binom{5}{2}", "10"), ("5!", "120"), (r"\left(\frac{1}{2}\right)", "0.5"), ("|-3|", "3"), (r"\sqrt[3]{27}", "3"), (r"2\cdot -3", "-6"), ("a_1+a_{2}", "a_2+a_1"),
    (r"\frac{x^2-1}{x-1}", "x+1"), ("2^-1", "0.5"), (r"\sqrt{2}^2-2", "0"), (r"\lfloor 2.5 \rfloor", "2"), ("--3", "3"),
]
UNEQUAL = [
    ("1/3", "0.333"), ("x", "y"), (r"\sqrt{x^2}", "x"), ("1,2", "1"), ("x=5", "5"), ("", ""), ("(", "("), (r"\text{a}", r"\text{a}"), ("|x|", "x"), ("a_1", "a_2"), ("1/0", "1/0"), ("0", "10^{-13}"),
    ("9" * 5000, "9" * 5000), ("(" * 200 + "1" + ")" * 200, "1"), ("9^{9^{9^9}}", "1"), ("400!", "1"), (None, None), (None, "1"),
]


def test_equal_values():
    assert [equations.equivalent(*pair) for pair in [*EQUAL, *UNEQUAL]] == [True] * len(EQUAL) + [False] * len(UNEQUAL)


@pytest.mark.parametrize("a, b", EQUAL)
def test_equality_is_symmetric(a, b):
    assert equations.equivalent(b, a) and equations.equivalent(a, a)


def test_extraction(spark):
    rows = [
        (r"\boxed{\frac{1}{2}}", "0.5", 1.0), (r"\boxed{3} so \boxed{{{{{4}}}}}", "4", 1.0), (r"it is \boxed 7$ then", "7", 1.0), (r"\boxed{8", "9", 0.0), (r"\fbox{8} and $8$", "8", 1.0),
        ("Final Answer: The final answer is $2x$. I hope it is correct.", "x+x", 1.0), ("Final Answer: The final answer is . I hope it is correct. $5$", "5", 0.0), (r"\boxed{(1, 2)}", "(1,2)", 1.0),
        (r"\boxed{\text{north}}", r"\text{north}", 1.0), ("first $1$, then $x=0.75$", r"\frac{3}{4}", 1.0), ("0.75", "3/4", 1.0), ("x" * 100_000, "y", 0.0), (r"\boxed{" + "{" * 50_000, "y", 0.0), (None, "1", 0.0), ("1", None, 0.0), ("", "", 1.0),
    ]
    assert column(spark, [r[:2] for r in rows], latex.math_match) == [r[2] for r in rows]
