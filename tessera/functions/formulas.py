"""Equality of formulae, LaTeX or plain: sums, products, powers, roots and fractions in a rational normal form.

A formula is a quotient of two sums of products. A product maps its bases (variables, prime numbers, -1, and bracketed sums
that can't be multiplied out) to rational exponents; whole powers of numbers go to its coefficient. Two quotients are equal
if cross-multiplying leaves nothing, so `1/sqrt(2)` is `sqrt(2)/2` and `(x+1)^2/(x+1)` is `x+1`; variables under roots count
as positive. Constants are equal within 1e-6.
"""

from __future__ import annotations

import math
import re
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Product = tuple[tuple[str, Fraction], ...]
Sum = dict[Product, Fraction]
Quotient = tuple[Sum, Sum]
ONE: Sum = {(): Fraction(1)}
MOST_POWER = 64
NEAR = 1e-6
#: LaTeX that only shapes what is written, and names of functions.
SHAPE = re.compile(r"\\left|\\right|\\displaystyle|\\[,;:! ]|\$|\\\(|\\\)|~|\s+")
FUNCTIONS = ("sin", "cos", "tan", "log", "ln", "exp")
TOKEN = re.compile(r"\d+\.?\d*|\.\d+|\\[a-z]+|\*\*|[a-z]|[-+*/^(){}\[\]]")


class Unreadable(ValueError):
    """Not a formula of this grammar."""


def add(a: Sum, b: Sum, sign: int = 1) -> Sum:
    out = dict(a)
    for p, c in b.items():
        out[p] = out.get(p, 0) + sign * c
        if not out[p]:
            del out[p]
    return out


_HELD: dict[str, Sum] = {}  # sums that stand under an exponent, by their text


def _product(exponents: dict[str, Fraction], c: Fraction) -> Sum:
    """One product in normal form; whole powers of numbers join the coefficient, whole powers of held sums are multiplied out."""
    rest, sums = {}, []
    for base, e in exponents.items():
        whole = math.floor(e)
        if base == "-1" or base.isdigit():
            c *= Fraction(int(base)) ** whole
            e -= whole
        elif base in _HELD and whole >= 1:
            sums += [_HELD[base]] * whole
            e -= whole
        if e:
            rest[base] = e
    out: Sum = {tuple(sorted(rest.items())): c} if c else {}
    for s in sums:
        out = mul(out, s)
    return out


def mul(a: Sum, b: Sum) -> Sum:
    out: Sum = {}
    for p, c in a.items():
        for q, d in b.items():
            e = dict(p)
            for base, x in q:
                e[base] = e.get(base, Fraction(0)) + x
            out = add(out, _product(e, c * d))
    return out


def _text(s: Sum) -> str:
    return "(" + "+".join(f"{c}*{'*'.join(f'{b}^{e}' for b, e in p)}" for p, c in sorted(s.items())) + ")"


def _primes(n: int) -> dict[str, Fraction]:
    out: dict[str, Fraction] = {}
    p = 2
    while p * p <= n:
        while n % p == 0:
            out[str(p)] = out.get(str(p), Fraction(0)) + 1
            n //= p
        p += 1
        if p > 100_000:
            break
    if n > 1:
        out[str(n)] = out.get(str(n), Fraction(0)) + 1
    return out


def _root(s: Sum, e: Fraction) -> Sum:
    """A sum to a power that isn't whole."""
    if not s:
        return {}
    if len(s) == 1:
        (p, c), = s.items()
        exponents = {b: x * e for b, x in p}
        for n, sign in ((abs(c.numerator), 1), (c.denominator, -1)):
            for base, x in _primes(n).items():
                exponents[base] = exponents.get(base, Fraction(0)) + sign * x * e
        if c < 0:
            exponents["-1"] = exponents.get("-1", Fraction(0)) + e
        return _product(exponents, Fraction(1))
    name = _text(s)
    _HELD[name] = s
    return _product({name: e}, Fraction(1))


def power(a: Quotient, e: Fraction) -> Quotient:
    if e < 0:
        a, e = (a[1], a[0]), -e
        if not a[1]:
            raise Unreadable("division by zero")
    if e.denominator == 1:
        if e > MOST_POWER and (len(a[0]) > 1 or len(a[1]) > 1):
            raise Unreadable("a power too high to multiply out")
        if e > 4096:
            raise Unreadable("a power too high")
        out = (ONE, ONE)
        for _ in range(int(e)):
            out = mul(out[0], a[0]), mul(out[1], a[1])
        return out
    return _root(a[0], e), _root(a[1], e)


def constant(a: Quotient) -> Fraction | None:
    if not a[0]:
        return Fraction(0)
    if set(a[0]) == set(a[1]) == {()}:
        return a[0][()] / a[1][()]
    return None


class _Reader:
    """Recursive descent: a sum of products of signed powers; factors may stand side by side."""

    def __init__(self, text: str):
        flat = SHAPE.sub(" ", text).replace("\\{", "(").replace("\\}", ")")
        self.tokens = TOKEN.findall(flat)
        if "".join(self.tokens) != flat.replace(" ", "") or not self.tokens:
            raise Unreadable(text)
        self.at = 0

    def next(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self, wanted: str | None = None) -> str:
        t = self.next()
        if not t or wanted and t != wanted:
            raise Unreadable(f"{t} for {wanted}")
        self.at += 1
        return t

    def whole(self) -> Quotient:
        out = self.sum()
        if self.next():
            raise Unreadable(self.next())
        return out

    def sum(self) -> Quotient:
        out = self.product()
        while self.next() in ("+", "-"):
            sign = 1 if self.take() == "+" else -1
            b = self.product()
            out = add(mul(out[0], b[1]), mul(b[0], out[1]), sign), mul(out[1], b[1])
        return out

    def product(self) -> Quotient:
        out = self.signed()
        while (t := self.next()) and t not in ("+", "-", ")", "}", "]"):
            over = t in ("/", "\\div")
            if over or t in ("*", "\\cdot", "\\times"):
                self.take()
            b = self.signed() if over or t in ("*", "\\cdot", "\\times") else self.raised()
            if over:
                b = power(b, Fraction(-1))
            out = mul(out[0], b[0]), mul(out[1], b[1])
        return out

    def signed(self) -> Quotient:
        sign = 1
        while self.next() in ("+", "-"):
            sign *= 1 if self.take() == "+" else -1
        a = self.raised()
        return (a[0] if sign > 0 else mul(a[0], {(): Fraction(-1)})), a[1]

    def raised(self) -> Quotient:
        base = self.atom()
        if self.next() in ("^", "**"):
            self.take()
            e = self.signed() if self.next() != "{" else self.group("{", "}")
            c = constant(e)
            if c is None:
                return {((f"{_text(base[0])}/{_text(base[1])}^{_text(e[0])}/{_text(e[1])}", Fraction(1)),): Fraction(1)}, ONE
            return power(base, c)
        return base

    def group(self, a: str, b: str) -> Quotient:
        self.take(a)
        out = self.sum()
        self.take(b)
        return out

    def argument(self) -> Quotient:
        """A group in braces, or the next digit or letter alone."""
        if self.next() == "{":
            return self.group("{", "}")
        t = self.next()
        if re.fullmatch(r"\d{2,}", t):
            self.tokens[self.at : self.at + 1] = list(t)
        return self.atom()

    def atom(self) -> Quotient:
        t = self.next()
        if t in ("(", "{", "["):
            return self.group(t, {"(": ")", "{": "}", "[": "]"}[t])
        self.take()
        if t[0].isdigit() or t[0] == ".":
            c = Fraction(t.rstrip(".") if t != "." else "0")
            return ({(): c} if c else {}), ONE
        if t in ("\\frac", "\\dfrac", "\\tfrac"):
            a, b = self.argument(), power(self.argument(), Fraction(-1))
            return mul(a[0], b[0]), mul(a[1], b[1])
        if t == "\\sqrt":
            n = constant(self.group("[", "]")) if self.next() == "[" else Fraction(2)
            if not n:
                raise Unreadable("a root without a number")
            return power(self.argument(), 1 / n)
        if t[1:] in FUNCTIONS:
            a = self.raised()
            return {((f"{t}{_text(a[0])}/{_text(a[1])}", Fraction(1)),): Fraction(1)}, ONE
        if t.isalpha() or t.startswith("\\"):
            return {((t, Fraction(1)),): Fraction(1)}, ONE
        raise Unreadable(t)


def read(text: str) -> Quotient:
    out = _Reader(text).whole()
    if not out[1]:
        raise Unreadable("division by zero")
    return out


def value(a: Quotient) -> float | None:
    """The number a formula without variables stands for; None with variables or beyond real numbers."""

    def of(s: Sum) -> float:
        total = 0.0
        for p, c in s.items():
            x = float(c)
            for base, e in p:
                b = math.pi if base == "\\pi" else float(base) if base == "-1" or base.isdigit() else of(_HELD[base]) if base in _HELD else math.nan
                y = b ** float(e) if b or e > 0 else math.nan
                x *= y if not isinstance(y, complex) else math.nan
            total += x
        return total

    try:
        n, d = of(a[0]), of(a[1])
        out = n / d
    except (OverflowError, ZeroDivisionError):
        return None
    return out if math.isfinite(out) else None


def same(a: str, b: str) -> bool:
    """Whether two texts are equal, or formulae that are; what isn't a formula is equal to its like alone."""
    a, b = a.strip().lower(), b.strip().lower()
    if a == b:
        return True
    _HELD.clear()
    try:
        x, y = read(a), read(b)
        if not add(mul(x[0], y[1]), mul(y[0], x[1]), -1):
            return True
    except (Unreadable, RecursionError):
        return False
    u, v = value(x), value(y)
    return u is not None and v is not None and abs(u - v) < NEAR


def equal(a: Column, b: Column) -> Column:
    """same(), row by row, with each pair of texts worked out once per batch; null if either is null."""

    @F.pandas_udf("boolean")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        known: dict[tuple, bool | None] = {}
        out = []
        for pair in zip(x, y, strict=True):
            if pair not in known:
                known[pair] = None if pair[0] is None or pair[1] is None else same(*pair)
            out.append(known[pair])
        return pd.Series(out, dtype=object)

    return run(a, b)
