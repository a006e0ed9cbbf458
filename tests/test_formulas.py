"""Equality of formulae: known pairs, and random ones against their values at random points."""

import math
import random

import pytest

from tessera.functions import formulas

EQUAL = [
    ("\\frac{1}{2}", "0.5"), ("1/\\sqrt{2}", "\\frac{\\sqrt2}{2}"), ("\\sqrt{8}", "2\\sqrt{2}"), ("\\sqrt{2}\\cdot\\sqrt{3}", "\\sqrt{6}"), ("2^{10}", "1024"), ("x+x", "2x"), ("(x+1)^2", "x^2+2x+1"),
    ("\\frac{x^2-1}{x-1}", "x+1"), ("\\sqrt[3]{54}", "3\\sqrt[3]{2}"), ("\\sqrt{x^2+2x+1}^2", "(1+x)^2"), ("-3/2", "-\\dfrac32"), ("3.14159265", "\\pi"), ("2(3+4)", "14"), ("4^{1/2}", "2"), ("x^{-1}", "1/x"), ("a b", "b*a"),
    ("$\\left(\\frac{3}{4}\\right)$", "0.75"), ("2**3", "8"), ("\\frac12 x", "x/2"), ("\\sqrt{12}+\\sqrt{27}", "5\\sqrt{3}"), ("0", "x-x"), ("hello world!", "Hello World! "), ("\\sin(x+x)", "\\sin(2x)"), ("2^x", "2^{x}"), ("(1+\\sqrt5)(1-\\sqrt5)", "-4"),
]
APART = [("1/2", "0.4999"), ("x", "y"), ("x^2", "2x"), ("\\sqrt{2}", "1.41"), ("1/0", "2/0"), ("abc?", "abc!"), ("", "0"), ("(1", "1"), ("\\sqrt{-1}", "1"), ("2^x", "x^2"), ("1,5", "1.5"), ("\\frac{1}", "1")]


@pytest.mark.parametrize("a,b", EQUAL)
def test_equal(a, b):
    assert formulas.same(a, b) and formulas.same(b, a)


@pytest.mark.parametrize("a,b", APART)
def test_apart(a, b):
    assert not formulas.same(a, b) and not formulas.same(b, a)


def some(r, depth):
    """(LaTeX, the same for Python)."""
    if not depth or r.random() < 0.2:
        t = r.choice(["x", "y", str(r.randint(1, 9)), f"{r.randint(1, 9)}.5"])
        return t, t
    (a, p), (b, q) = some(r, depth - 1), some(r, depth - 1)
    k = r.randint(0, 5)
    return [(f"({a}+{b})", f"({p}+{q})"), (f"({a}-{b})", f"({p}-{q})"), (f"{{{a}}}\\cdot{{{b}}}", f"({p})*({q})"), (f"\\frac{{{a}}}{{{b}+20}}", f"({p})/({q}+20)"), (f"({a})^{{2}}", f"({p})**2"), (f"\\sqrt{{({a})^2+1}}", f"(({p})**2+1)**0.5")][k]


@pytest.mark.parametrize("seed", range(60))
def test_against_values_at_random_points(seed):
    r = random.Random(seed)
    (a, p), (b, q) = some(r, 3), some(r, 3)
    points = [{"x": r.uniform(1, 2), "y": r.uniform(1, 2)} for _ in range(5)]
    at = lambda f, v: eval(f, {}, v)  # noqa: E731, S307
    for one, two, f, g in ((a, b, p, q), (f"({a})-({b})+({b})", a, f"({p})-({q})+({q})", p), (f"({a})*({b})", f"{b}({a})", f"({p})*({q})", f"({q})*({p})"), (f"\\frac{{{a}}}{{7}}\\cdot7", a, p, p)):
        close = all(math.isclose(at(f, v), at(g, v), rel_tol=1e-9, abs_tol=1e-9) for v in points)
        assert formulas.same(one, two) == close, (one, two)


def test_columns(spark):
    from pyspark.sql import functions as F

    d = spark.createDataFrame([("1/2", "0.5"), (None, "1"), ("x", "y")], "a string, b string")
    assert [r.s for r in d.select(formulas.equal(F.col("a"), F.col("b")).alias("s")).collect()] == [True, None, False]
