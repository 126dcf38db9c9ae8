"""Cases of the grader, and its normal form against values at random points."""

import random
from fractions import Fraction

import pytest

from hyperweave.functions import mathematics as M

SAME = [
    ("1/2", "0.5"), ("\\frac{1}{2}", "0.5"), ("\\frac12", ".5"), ("50%", "0.5"), ("50", "0.5"), ("1,234", "1234"), ("0.33333", "1/3"), ("2\\pi", "6.28318"),
    ("x^2-1", "(x-1)(x+1)"), ("\\frac{x^2-1}{x-1}", "x+1"), ("a b + c", "c+b*a"), ("(x+y)^3", "x^3+3x^2y+3xy^2+y^3"), ("\\sqrt{8}", "2\\sqrt{2}"), ("\\sqrt2 \\cdot \\sqrt6", "2\\sqrt{3}"), ("x\\sqrt{12}", "2x\\sqrt3"),
    ("\\frac{1}{x}+\\frac1y", "\\frac{x+y}{xy}"), ("x^{-1}", "1/x"), ("\\sin x \\cdot 2", "2\\sin(x)"), ("|x|", "\\sqrt{x^2}"), ("2\\sqrt{x}", "\\sqrt{4x}"),
    ("(1, 2)", "(1.0,4/2)"), ("[1,2)", "[1, 2)"), ("1,2", "(1,2)"), ("{1,2}", "{2,1}"), ("\\{3, 1, 2\\}", "1,2,3"), ("\\left(1,\\frac{1}{2}\\right]", "(1,0.5]"), ("(1,2)\\cup(3,4)", "(3,4) \\cup (1,2)"),
    ("\\begin{pmatrix}1 & x\\\\ 2 & 3\\end{pmatrix}", "[[1, x], [2, 3]]"), ("Matrix([[1],[2]])", "\\begin{pmatrix} 1 \\\\ 2 \\end{pmatrix}"), ("[1,2]", "\\begin{bmatrix}1\\\\2\\end{bmatrix}"), ("\\begin{pmatrix}1&2\\end{pmatrix}", "\\begin{bmatrix}1&\\frac42\\end{bmatrix}"),
    ("x=5", "5"), ("y = 2x+1", "2y=4x+2"), ("x+y=3", "3-x-y=0"), ("2x+3y-6=0", "y=2-\\frac{2x}{3}"), ("Yes", "yes"), ("90^\\circ", "90"), ("5\\text{ cm}", "5"), ("$x+1$", "1+x"), ("", ""), ("\\alpha+1", "1+\\alpha"),
]
OTHER = [
    ("(1,2]", "[1,2)"), ("(1,2)", "[1,2]"), ("[1,2]", "[2,1]"), ("{1,2}", "{1,3}"), ("{1,1,2}", "{1,2,2}"), ("A", "a"), ("x", "y"), ("x^2", "x^3"), ("1/3", "0.33"), ("x+1", "x+1.00001"), ("(1,2,3)", "(1,2)"),
    ("\\begin{pmatrix}1&2\\\\3&4\\end{pmatrix}", "[[1,2],[4,3]]"), ("\\begin{pmatrix}1&2\\end{pmatrix}", "\\begin{pmatrix}1\\\\2\\end{pmatrix}"), ("y=2x", "x=2y"), ("x+y=3", "x+y=4"), ("x=5", "6"), ("1", ""), ("", "1"), ("\\sqrt{2}", "\\sqrt{3}"), ("1/0", "1"), ("x/0", "x/0+1"),
    ("((((", "))))"), ("x+", "x"), ("(1,2)\\cup(3,4)", "(1,2)"), ("2+3=5", "5"), ("a=b=c", "c"), ("(x+y)^{60}", "(x+y)^{59}"), ("xy", "x+y"),
]


@pytest.mark.parametrize("a,b", SAME)
def test_same(a, b):
    assert M.equal(a, b) and M.equal(b, a) and M.equal(a, a)


@pytest.mark.parametrize("a,b", OTHER)
def test_other(a, b):
    assert not M.equal(a, b) and not M.equal(b, a)


def expression(rng, depth):
    if not depth or rng.random() < 0.2:
        return rng.choice(["x", "y", "z", str(rng.randint(1, 9)), "1.5", f"\\sqrt{{{rng.choice([2, 3, 8, 12])}}}"])
    a, b = expression(rng, depth - 1), expression(rng, depth - 1)
    return rng.choice([f"({a}+{b})", f"({a}-{b})", f"({a})({b})", f"\\frac{{{a}}}{{{b}}}", f"({a})^{rng.randint(0, 3)}"])


def test_normal_form_against_values():
    rng = random.Random(0)
    seen = 0
    for _ in range(300):
        a, b = expression(rng, 3), expression(rng, 2)
        try:
            tree, other = M._tree(a), M._tree(b)
            p, q = M._quotient(tree)
            values = [M._value(tree, k) for k in range(3)]
            M._value(other, 0)
        except (ZeroDivisionError, ValueError, OverflowError):
            continue
        seen += 1

        def at(poly, k):
            total = 0.0
            for term, x in poly.items():
                v = float(x)
                for name, n in term:
                    v *= (int(name[2:]) ** 0.5 if name[:2] == "r " else M._value(("v", name), k)) ** n
                total += v
            return total

        for k, v in enumerate(values):
            assert at(p, k) == pytest.approx(v * at(q, k), rel=1e-6, abs=1e-6), a
        assert M.equal(f"({a})+({b})", f"({b})+({a})")
        if M._unknowns(tree):  # else by value, within a share of it
            assert not M.equal(f"({a})+1", a)
        assert M._same(("*", tree, other), ("*", other, tree), 1e-9)
    assert seen > 200


def test_roots():
    for n in range(1, 400):
        a, b = M._root(n)
        assert a * a * b == n and all(b % (k * k) for k in range(2, 20))
    assert M._tree("1.5")[1] == Fraction(3, 2)


def test_limits():
    assert not M.equal("(" * 60 + "x" + ")" * 60, "x") and M.equal("x" * 2000, "x" * 2000) and not M.equal("1+" * 900 + "1", "901")
    assert M.equal("(a+b+c+d+e+f+g)^{12}", "(g+f+e+d+c+b+a)^{12}")  # by values
