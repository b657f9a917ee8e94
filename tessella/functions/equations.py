"""Whether two answers in LaTeX are the same: by a stripped form, or by value. A small parser evaluates as it reads.

Numbers are exact fractions as long as they can be; letters and named constants are free symbols, which take fixed values at each of
a few points. Two formulas are equal when they agree at every point. Roots, powers and functions that have no exact value are complex
numbers and are compared within `TOLERANCE`.
"""

from __future__ import annotations

import cmath
import math
import re
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache
from zlib import crc32

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TOLERANCE = 1e-9
POINTS = 4
#: Longer formulas, deeper nesting and larger exact numbers than these aren't answers.
MOST_CHARACTERS, MOST_DEPTH, MOST_BITS = 4096, 60, 4096

_SIGN = re.compile(r"\s*(?:(\d+(?:,\d{3})*(?:\.\d+)?|\.\d+)|(\\[A-Za-z]+|\\.)|(.))", re.S)
_BLANK = {"\\left", "\\right", "\\,", "\\!", "\\;", "\\:", "\\ ", "\\quad", "\\displaystyle", "\\big", "\\Big"}
_SYMBOLS = set("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi pi rho sigma tau phi chi psi omega Gamma Delta Theta Lambda Xi Pi Sigma Phi Psi Omega".split())
_FUNCTIONS = {
    "sin": cmath.sin, "cos": cmath.cos, "tan": cmath.tan, "arcsin": cmath.asin, "arccos": cmath.acos, "arctan": cmath.atan, "sinh": cmath.sinh, "cosh": cmath.cosh, "tanh": cmath.tanh, "exp": cmath.exp,
    "ln": cmath.log, "log": lambda x: cmath.log(x) / math.log(10), "sec": lambda x: 1 / cmath.cos(x), "csc": lambda x: 1 / cmath.sin(x), "cot": lambda x: 1 / cmath.tan(x),
}
_CLOSING = {"(": ")", "[": "]", "{": "}", "\\{": "\\}", "|": "|", "\\lfloor": "\\rfloor", "\\lceil": "\\rceil"}
_ENDS = {*_CLOSING.values(), "+", "-", ""}


class NotAFormula(ValueError):
    """What the parser doesn't read: relations, lists, words in \\text, unknown commands."""


def _inexact(x: Fraction | complex) -> complex:
    return complex(x)


def _whole(x: Fraction | complex, most: int) -> int:
    if not isinstance(x, Fraction) or x.denominator != 1 or not 0 <= x <= most:
        raise NotAFormula
    return int(x)


def _bounded(x: Fraction | complex) -> Fraction | complex:
    if isinstance(x, Fraction) and max(x.numerator.bit_length(), x.denominator.bit_length()) > MOST_BITS:
        raise NotAFormula
    return x


def _root(x: Fraction | complex, degree: int) -> Fraction | complex:
    """The principal root, exact where numerator and denominator have one."""
    if isinstance(x, Fraction) and (x >= 0):
        parts = [round(v ** (1 / degree)) if v.bit_length() < 1000 else 0 for v in (x.numerator, x.denominator)]
        if degree == 2:
            parts = [math.isqrt(x.numerator), math.isqrt(x.denominator)]
        if parts[0] ** degree == x.numerator and parts[1] ** degree == x.denominator:
            return Fraction(*parts)
    return _inexact(x) ** (1 / degree)


def _power(base: Fraction | complex, to: Fraction | complex) -> Fraction | complex:
    if isinstance(base, Fraction) and isinstance(to, Fraction):
        if to.denominator == 1 and abs(to) * max(base.numerator.bit_length(), base.denominator.bit_length()) <= MOST_BITS:
            return base ** int(to)
        if to.denominator <= 64 and base >= 0 and abs(to.numerator) <= 64:
            return _bounded(_power(_root(base, to.denominator), Fraction(to.numerator)))
    return _inexact(base) ** _inexact(to)


class _Reader:
    """Reads one formula at one point."""

    def __init__(self, signs: tuple[str, ...], point: int):
        self.signs, self.at, self.point, self.depth, self.free = signs, 0, point, 0, False

    def peek(self) -> str:
        return self.signs[self.at] if self.at < len(self.signs) else ""

    def take(self, wanted: str | None = None) -> str:
        sign = self.peek()
        if sign == "" or (wanted is not None and sign != wanted):
            raise NotAFormula
        self.at += 1
        return sign

    def symbol(self, name: str) -> Fraction:
        self.free = True
        if self.peek() == "_":
            self.take()
            begin = self.at
            if self.take() == "{":
                while self.take() != "}":
                    pass
            name += "_" + "".join(s for s in self.signs[begin : self.at] if s not in "{}")
        seed = crc32(f"{self.point}:{name}".encode())
        return Fraction((-1) ** (self.point % 2) * (seed % 499 + 2), 97)

    def total(self) -> Fraction | complex:
        self.depth += 1
        if self.depth > MOST_DEPTH:
            raise NotAFormula
        value = Fraction(0)
        sign = 1
        while self.peek() in ("+", "-"):
            sign = -sign if self.take() == "-" else sign
        value = sign * self.product()
        while self.peek() in ("+", "-"):
            sign = 1
            while self.peek() in ("+", "-"):
                sign = -sign if self.take() == "-" else sign
            value = _bounded(value + sign * self.product())
        self.depth -= 1
        return value

    def product(self) -> Fraction | complex:
        value = self.factor()
        while True:
            sign = self.peek()
            if sign in ("\\cdot", "\\times", "*"):
                self.take()
                value = _bounded(value * self.signed())
            elif sign in ("/", "\\div"):
                self.take()
                value = _bounded(value / self.signed())
            elif sign not in _ENDS:
                value = _bounded(value * self.factor())
            else:
                return value

    def signed(self) -> Fraction | complex:
        if self.peek() == "-":
            self.take()
            return -self.factor()
        return self.factor()

    def factor(self) -> Fraction | complex:
        value = self.atom()
        while self.peek() == "!":
            self.take()
            value = Fraction(math.factorial(_whole(value, 300)))
        if self.peek() == "^":
            self.take()
            value = _power(value, self.exponent())
        return value

    def exponent(self) -> Fraction | complex:
        """A group in braces, or one sign; a number is one sign, as the reading that answers are checked by has it."""
        if self.peek() == "-":
            self.take()
            return -self.exponent()
        return self.group() if self.peek() == "{" else self.atom()

    def argument(self) -> Fraction | complex:
        """A group in braces, or one sign; of a number its first digit alone."""
        if self.peek() == "{":
            return self.group()
        sign = self.peek()
        if re.fullmatch(r"[\d,]{2,}", sign):
            self.signs = (*self.signs[: self.at], sign[0], sign[1:], *self.signs[self.at + 1 :])
        return self.atom()

    def group(self) -> Fraction | complex:
        close = _CLOSING[self.take()]
        value = self.total()
        self.take(close)
        return value

    def atom(self) -> Fraction | complex:
        sign = self.peek()
        if sign in ("\\lfloor", "\\lceil", "|"):
            value = self.group()
            if sign == "|":
                return abs(value)
            if not isinstance(value, Fraction):
                raise NotAFormula
            return Fraction(math.floor(value) if sign == "\\lfloor" else math.ceil(value))
        if sign in _CLOSING:
            return self.group()
        self.take()
        if sign[0].isdigit() or sign[0] == ".":
            return _bounded(Fraction(sign.replace(",", "")))
        if len(sign) == 1 and sign.isalpha() and sign.isascii():
            return self.symbol(sign)
        name = sign[1:] if sign[0] == "\\" else ""
        if name in _SYMBOLS:
            return self.symbol(name)
        if name in ("frac", "dfrac", "tfrac"):
            above = self.argument()
            return _bounded(above / self.argument())
        if name in ("binom", "dbinom", "tbinom"):
            n = _whole(self.argument(), 2000)
            return Fraction(math.comb(n, _whole(self.argument(), 2000)))
        if name == "sqrt":
            degree = _whole(self.group(), 64) if self.peek() == "[" else 2
            return _root(self.argument(), degree)
        if name in _FUNCTIONS:
            return self.function(name)
        raise NotAFormula

    def function(self, name: str) -> complex:
        base = to = None
        while self.peek() in ("_", "^"):
            if self.take() == "_":
                base = self.exponent()
            else:
                to = self.exponent()
        if (base is not None and name != "log") or to == -1:
            raise NotAFormula
        inside = _inexact(self.group() if self.peek() in ("(", "[", "{") else self.factor())
        value = cmath.log(inside) / cmath.log(_inexact(base)) if base is not None else _FUNCTIONS[name](inside)
        return value if to is None else _power(value, to)


@lru_cache(maxsize=4096)
def values(formula: str) -> tuple[Fraction | complex, ...] | None:
    """The formula's value at each point; None for what isn't one."""
    if not formula or len(formula) > MOST_CHARACTERS:
        return None
    signs = tuple(s for m in _SIGN.finditer(formula.strip()) if (s := next(g for g in m.groups() if g is not None)) not in _BLANK and not s.isspace())
    found = []
    try:
        for point in range(POINTS):
            reader = _Reader(signs, point)
            found.append(reader.total())
            if reader.peek():
                return None
            if not reader.free:  # the same at every point
                return tuple(found * POINTS)
    except (NotAFormula, ArithmeticError, ValueError, RecursionError):
        return None
    return tuple(found)


def _close(a: Fraction | complex, b: Fraction | complex) -> bool:
    if isinstance(a, Fraction) and isinstance(b, Fraction):
        return a == b
    try:
        a, b = complex(a), complex(b)
    except OverflowError:
        return False
    return abs(a - b) <= TOLERANCE * max(abs(a), abs(b), 1e-3)


def equivalent(a: str | None, b: str | None) -> bool:
    """Both are formulas and agree at every point."""
    if a is None or b is None:
        return False
    x = values(a)
    y = values(b) if x is not None else None
    return y is not None and all(_close(p, q) for p, q in zip(x, y, strict=True))


# What the stripped form of an answer replaces first, in order.
PLAIN = [("\n", ""), ("\\!", ""), ("\\\\", "\\"), ("tfrac", "frac"), ("dfrac", "frac"), ("\\left", ""), ("\\right", ""), ("^{\\circ}", ""), ("^\\circ", ""), ("\\$", "")]
_INTEGER = r"(?:0|-?[1-9]\d*)"


def stripped(answer: str) -> str | None:
    """An answer without spaces, units, signs of degree, money and percent, its fractions and roots in braces, `0.5` and `a/b` as fractions.

    None where the rule has no result: two units, a fraction or root without anything after it, a slash between other things than integers.
    """
    x = answer
    for old, new in PLAIN:
        x = x.replace(old, new)
    x, *units = x.split("\\text{ ")
    if len(units) > 1:
        return None
    x = re.sub(r"(^|[ {])\.", r"\g<1>0.", x.replace("\\%", ""))
    x = re.sub(r"^[^=]{0,2}=([^=]*)$", r"\1", x)
    if re.search(r"\\sqrt(?=$|\\sqrt)", x):
        return None
    x = re.sub(r"\\sqrt([^{])", r"\\sqrt{\1}", x).replace(" ", "")
    if re.search(r"\\frac(?=$|\\frac)", x):
        return None
    if not re.search(r"\\frac[^{](?=$|\\frac)", x):
        x = re.sub(r"\\frac([^{])(\{|.)", lambda m: rf"\frac{{{m[1]}}}" + (m[2] if m[2] == "{" else f"{{{m[2]}}}"), x)
    if x == "0.5":
        return r"\frac{1}{2}"
    if x.count("/") != 1:
        return x
    if not re.fullmatch(r"[+-]?\d+/[+-]?\d+", x):
        return None
    return re.sub(rf"^({_INTEGER})/({_INTEGER})$", r"\\frac{\1}{\2}", x)


def same(answer: str | None, label: str | None) -> bool:
    """Equal in stripped form, where either has none as they are; or formulas of equal value."""
    if answer is None or label is None:
        return False
    if answer == label:
        return True
    return (_same_short if len(answer) + len(label) <= SHORT else _same)(answer, label)


def _same(answer: str, label: str) -> bool:
    a, b = stripped(answer), stripped(label)
    return (a == b if a is not None and b is not None else False) or equivalent(answer, label)


#: A task remembers its last comparisons of answers and labels that have at most so many characters together.
SHORT = 256
_same_short = lru_cache(maxsize=32_768)(_same)


def any_same(answers: Column, label: Column) -> Column:
    """True where one of the answers is the same as the label; null answers are left out, a null label has none."""

    @F.pandas_udf("boolean")
    def compare(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for rows, labels in batches:
            yield pd.Series([any(same(a, b) for a in found) for found, b in zip(rows, labels, strict=True)], dtype=bool)

    return compare(answers, label)
