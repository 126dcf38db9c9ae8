"""Equality of mathematical answers: by text, by value, part by part, as matrices and equations, and in a normal form.

Expressions in plain or LaTeX form are read into a tree. Those of +, -, *, /, whole powers and roots of numbers have an
exact normal form: quotients of polynomials in any number of unknowns over the rationals, with square roots of whole
numbers reduced to square-free ones. Two of them are equal if and only if their cross products are. Other expressions
(functions of unknowns, fractional powers) are compared at POINTS values of their unknowns; expressions without unknowns
by value, within the tolerance.
"""

from __future__ import annotations

import math
import re
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

from .text import c

#: Longest expression that is read, and the deepest nesting; longer or deeper ones are compared as text alone. Largest
#: whole power, and most terms of a polynomial, that are multiplied out; beyond them values decide.
LONGEST, DEEPEST, POWER, TERMS = 1000, 50, 64, 2000
#: Values of a variable at which two expressions without a normal form are compared, spread by its name.
POINTS = 4

_TOKEN = re.compile(r"\s*(\d+(?:\.\d*)?|\.\d+|\\[a-zA-Z]+|[a-zA-Z]|[-+*/^(){}!|])")
_FUNCTIONS = {"sqrt": math.sqrt, "sin": math.sin, "cos": math.cos, "tan": math.tan, "ln": math.log, "log": math.log10, "exp": math.exp, "abs": abs}
_NAMES = {"pi": math.pi, "e": math.e}


class _Unread(ValueError):
    """An expression outside the grammar, or outside the normal form."""


def _tree(text: str) -> tuple:
    """The tree of an expression: ("n", Fraction), ("v", name), ("f", function, x), (operator, x, y), ("-", x)."""
    tokens, at = [], 0
    text = text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise _Unread(text)
        tokens.append(m[1])
        at = m.end()
    tokens.append("")
    place, depth = 0, 0

    def take(*wanted: str) -> str | None:
        nonlocal place
        if tokens[place] in wanted:
            place += 1
            return tokens[place - 1]
        return None

    def group() -> tuple:
        nonlocal depth
        opened = take("(", "{")
        depth += 1
        if opened is None or depth > DEEPEST:
            raise _Unread(text)
        x = total()
        if take(")" if opened == "(" else "}") is None:
            raise _Unread(text)
        depth -= 1
        return x

    def argument() -> tuple:
        """What \\frac and \\sqrt take: a group, or one digit or letter."""
        nonlocal place
        if tokens[place] in ("(", "{"):
            return group()
        t = tokens[place]
        if t.isdigit() and len(t) > 1:  # the first digit alone
            tokens[place] = t[1:]
            return "n", Fraction(t[0])
        return atom()

    def atom() -> tuple:
        nonlocal place, depth
        t = tokens[place]
        if t in ("(", "{"):
            return group()
        place += 1
        if t[:1].isdigit() or t[:1] == ".":
            return "n", Fraction(t if t[-1] != "." else t[:-1])
        if t == "|":
            depth += 1
            if depth > DEEPEST:
                raise _Unread(text)
            x = total()
            depth -= 1
            if take("|") is None:
                raise _Unread(text)
            return "f", "abs", x
        name = t[1:] if t[:1] == "\\" else ""
        if name == "frac":
            a = argument()
            return "/", a, argument()
        if name == "sqrt":
            return "f", name, argument()
        if name in _FUNCTIONS:
            return "f", name, group() if tokens[place] in ("(", "{") else power()
        if name in _NAMES:
            return "v", name
        if name or (len(t) == 1 and t.isalpha()):
            return "v", t
        raise _Unread(text)

    def power() -> tuple:
        x = atom()
        if take("^"):
            sign = take("-")
            y = argument() if tokens[place] == "{" else power()
            return "^", x, ("-", y) if sign else y
        return x

    def product() -> tuple:
        x = signed()
        while True:
            if take("*", "\\cdot", "\\times"):
                x = "*", x, signed()
            elif take("/", "\\div"):
                x = "/", x, signed()
            elif tokens[place] and tokens[place] not in "+-)}|!":
                x = "*", x, power()
            else:
                return x

    def signed() -> tuple:
        sign = False
        while t := take("+", "-"):
            sign ^= t == "-"
        return ("-", power()) if sign else power()

    def total() -> tuple:
        x = product()
        while t := take("+", "-"):
            x = ("+", x, product()) if t == "+" else ("+", x, ("-", product()))
        return x

    x = total()
    if tokens[place] != "":
        raise _Unread(text)
    return x


def _unknowns(tree: tuple) -> set[str]:
    if tree[0] == "v":
        return set() if tree[1] in _NAMES else {tree[1]}
    return set().union(*(_unknowns(x) for x in tree[1:] if isinstance(x, tuple)))


def _value(tree: tuple, point: int) -> float:
    kind = tree[0]
    if kind == "n":
        return float(tree[1])
    if kind == "v":
        # irrational values, so that different expressions do not meet by chance
        return _NAMES.get(tree[1]) or math.sqrt(sum(map(ord, tree[1])) * 7 + 13 * point + 2) / 3
    if kind == "f":
        return _FUNCTIONS[tree[1]](_value(tree[2], point))
    x = _value(tree[1], point)
    if kind == "-":
        return -x
    y = _value(tree[2], point)
    out = x + y if kind == "+" else x * y if kind == "*" else x / y if kind == "/" else x**y
    if isinstance(out, complex) or not math.isfinite(out):
        raise _Unread("no real value")
    return out


# The normal form: polynomials are {monomial: Fraction}, a monomial the sorted pairs (unknown, power). A root of the whole
# number n is the unknown "r n", whose square is n.

_ONE = {(): Fraction(1)}


def _root(n: int) -> tuple[int, int]:
    """(a, b) with n = a * a * b, b without square factors."""
    a, k = 1, 2
    while k * k <= n and k < 10_000:
        while n % (k * k) == 0:
            n, a = n // (k * k), a * k
        k += 1
    whole = math.isqrt(n)
    return (a * whole, 1) if whole * whole == n else (a, n)


def _term(a: tuple, b: tuple) -> tuple[tuple, Fraction]:
    """The product of two monomials, and the rational that their roots give."""
    powers: dict[str, int] = {}
    inside = 1
    for name, n in (*a, *b):
        if name[:2] == "r ":
            inside *= int(name[2:]) ** n
        else:
            powers[name] = powers.get(name, 0) + n
    out, rest = _root(inside) if inside > 1 else (1, 1)
    if rest > 1:
        powers[f"r {rest}"] = 1
    return tuple(sorted(powers.items())), Fraction(out)


def _times(p: dict, q: dict) -> dict:
    out: dict = {}
    for a, x in p.items():
        for b, y in q.items():
            term, more = _term(a, b)
            out[term] = out.get(term, 0) + x * y * more
            if len(out) > TERMS:
                raise _Unread("too many terms")
    return {k: v for k, v in out.items() if v}


def _plus(p: dict, q: dict) -> dict:
    out = dict(p)
    for k, v in q.items():
        out[k] = out.get(k, 0) + v
    return {k: v for k, v in out.items() if v}


def _quotient(tree: tuple) -> tuple[dict, dict]:
    """Numerator and denominator."""
    kind = tree[0]
    if kind == "n":
        return ({(): tree[1]} if tree[1] else {}), _ONE
    if kind == "v":
        return {((tree[1], 1),): Fraction(1)}, _ONE
    if kind == "f":
        p, q = _quotient(tree[2])
        if tree[1] != "sqrt" or p.keys() - {()} or q.keys() != {()}:
            raise _Unread("no normal form")
        x = p.get((), Fraction(0)) / q[()]
        if x < 0:
            raise _Unread("no real value")
        a, b = _root(x.numerator * x.denominator) if x else (0, 1)
        return ({((f"r {b}", 1),) if b > 1 else (): Fraction(a, x.denominator)} if a else {}), _ONE
    p, q = _quotient(tree[1])
    if kind == "-":
        return {k: -v for k, v in p.items()}, q
    if kind == "^":
        r, s = _quotient(tree[2])
        if r.keys() - {()} or s.keys() != {()}:
            raise _Unread("no normal form")
        n = r.get((), Fraction(0)) / s[()]
        if n.denominator != 1 or abs(n) > POWER:
            raise _Unread("no normal form")
        if n < 0:
            p, q, n = q, p, -n
        if not q:
            raise ZeroDivisionError
        up, down = _ONE, _ONE
        for _ in range(int(n)):
            up, down = _times(up, p), _times(down, q)
        return up, down
    r, s = _quotient(tree[2])
    if kind == "+":
        return _plus(_times(p, s), _times(r, q)), _times(q, s)
    if kind == "*":
        return _times(p, r), _times(q, s)
    if not r:
        raise ZeroDivisionError
    return _times(p, s), _times(q, r)


def _same(a: tuple, b: tuple, tolerance: float) -> bool:
    """Whether two trees are equal."""
    names = _unknowns(a) | _unknowns(b)
    if not names:
        return math.isclose(_value(a, 0), _value(b, 0), rel_tol=tolerance, abs_tol=1e-9)
    try:
        (p, q), (r, s) = _quotient(a), _quotient(b)
        return _times(p, s) == _times(r, q)
    except _Unread:
        return all(math.isclose(_value(a, k), _value(b, k), rel_tol=tolerance, abs_tol=1e-9) for k in range(POINTS))


def _same_equation(a: tuple, b: tuple) -> bool:
    """Whether two equations, given as left less right, differ by a constant factor that is not zero."""
    (p, _), (r, _) = _quotient(a), _quotient(b)
    if p.keys() != r.keys() or not p:
        return not p and not r
    first = min(p)
    return all(v * r[first] == r[k] * p[first] for k, v in p.items())


def _number(x: str) -> float | None:
    """A plain number, with commas between thousands or a percent sign."""
    s = x.strip().rstrip("%").rstrip("\\").replace(",", "") if re.fullmatch(r"\s*[-+]?(\d{1,3}(,\d{3})+|\d+)?(\.\d*)?([eE][-+]?\d+)?\s*(\\?%)?\s*", x) else ""
    try:
        v = float(s)
    except ValueError:
        return None
    return v / 100 if x.strip().endswith("%") else v


_OPEN, _CLOSE = "([{", ")]}"


def _split(x: str, at: str = ",") -> list[str]:
    """The parts of a text between signs outside all brackets."""
    parts, depth, start = [], 0, 0
    for k, ch in enumerate(x):
        depth += (ch in _OPEN) - (ch in _CLOSE)
        if ch == at and depth <= 0:
            parts.append(x[start:k])
            start = k + 1
    return [*parts, x[start:]]


def _bracketed(x: str) -> tuple[str, list[str]] | None:
    """(kind, parts) of a tuple, an interval, a set or a list; kind: its brackets, "" without any. None if it has one part
    and no square or curly brackets of its own."""
    x, kind = x.strip(), ""
    if len(x) > 1 and x[0] in _OPEN and x[-1] in _CLOSE:
        depth = 0
        for k, ch in enumerate(x):
            depth += (ch in _OPEN) - (ch in _CLOSE)
            if depth == 0:
                break
        if k == len(x) - 1:
            kind, x = x[0] + x[-1], x[1:-1]
    parts = _split(x)
    return (kind, parts) if len(parts) > 1 or kind == "{}" or kind == "[]" else None


def _matrix(x: str) -> list[list[str]] | None:
    """Rows of a LaTeX matrix, of Matrix([[...]]) or of a list of lists."""
    if m := re.fullmatch(r"\\begin\{([pbvV]?matrix|array)\}(?:\{[lcr|]*\})?(.*)\\end\{\1\}", x.strip(), re.DOTALL):
        rows = [r for r in re.split(r"\\\\", m[2]) if r.strip()]
        return [[e.strip() for e in r.split("&")] for r in rows]
    x = x.strip()
    if m := re.fullmatch(r"Matrix\((.*)\)", x, re.DOTALL):
        x = m[1].strip()
    outer = _bracketed(x)
    if not outer or outer[0] != "[]":
        return None
    rows = [_bracketed(p) for p in outer[1]]
    if all(r and r[0] == "[]" for r in rows):
        return [[e.strip() for e in r[1]] for r in rows]
    return None


def _plain(x: str) -> str:
    x = re.sub(r"\\left|\\right|(?<!\\)\\[!,;: ]|\^\{?\\circ\}?", "", x).replace("\\dfrac", "\\frac").replace("\\tfrac", "\\frac").replace("**", "^")
    x = x.replace("\\{", "{").replace("\\}", "}").replace("\\$", "").replace("\\lvert", "|").replace("\\rvert", "|")
    unit = re.sub(r"\\(?:text|mbox|mathrm)\{[^{}]*\}", "", x)
    return (unit if unit.strip() else x).strip()


def _all_equal(a: list[str], b: list[str], **how) -> bool:
    return len(a) == len(b) and all(equal(x, y, **how) for x, y in zip(a, b))


def _any_order(a: list[str], b: list[str], **how) -> bool:
    """Whether the parts agree one to one, in some order."""
    rest = list(b)
    for x in a:
        found = next((k for k, y in enumerate(rest) if equal(x, y, **how)), None)
        if found is None:
            return False
        del rest[found]
    return not rest


def equal(given: str, truth: str, percent: bool = True, tolerance: float = 1e-4) -> bool:
    """Whether two answers say the same.

    Numbers agree within the tolerance, with `percent` also a hundredfold. Tuples and intervals agree part by part, in
    order, and only with brackets of the same kinds, unless one side has none; sets in any order; unions of intervals in
    any order; matrices entry by entry, one of a single row or column also with a list. An equation agrees with one that differs by
    a factor, "x = 5" also with 5. Words agree in any case, single letters do not."""
    how = {"percent": percent, "tolerance": tolerance}
    a, b = given.strip().strip("$").strip(), truth.strip().strip("$").strip()
    if a.replace(" ", "") == b.replace(" ", ""):
        return bool(a) or not b
    if a.lower() == b.lower() and re.search(r"(?<!\\)\b[a-zA-Z]{2,}", a):
        return True
    x, y = _number(a), _number(b)
    if x is not None and y is not None:
        return any(math.isclose(x, z, rel_tol=tolerance) for z in ((y / 100, y, y * 100) if percent else (y,)))
    if not a or not b or max(len(a), len(b)) > LONGEST:
        return False
    a, b = _plain(a), _plain(b)
    p, q = _matrix(a), _matrix(b)
    if p or q:
        flat = lambda m: [r[0] for r in m] if all(len(r) == 1 for r in m) else m[0] if len(m) == 1 else None
        if p and q:
            return len(p) == len(q) and all(_all_equal(r, s, **how) for r, s in zip(p, q))
        parts, held = flat(p or q), _bracketed(b if p else a)
        return bool(parts and held and held[0] in ("", "()", "[]")) and _all_equal(*((parts, held[1]) if p else (held[1], parts)), **how)
    unions = [re.split(r"\\cup|\u222a", s) for s in (a, b)]
    if max(map(len, unions)) > 1:
        return _any_order(*unions, **how)
    p, q = _bracketed(a), _bracketed(b)
    if p or q:
        if not (p and q) or (p[0] and q[0] and p[0] != q[0]):
            return False
        return (_any_order if "{}" in (p[0], q[0]) else _all_equal)(p[1], q[1], **how)
    try:
        sides = [[_tree(side) for side in s.split("=")] for s in (a, b)]
        if max(map(len, sides)) > 2:
            return False
        if len(sides[0]) == len(sides[1]) == 2:
            less = [("+", left, ("-", right)) for left, right in sides]
            return _same_equation(*less)
        named = [s for s in sides if len(s) == 2]
        if named and named[0][0][0] != "v":
            return False
        return _same(sides[0][-1], sides[1][-1], tolerance)
    except (ValueError, OverflowError, ZeroDivisionError, TypeError, RecursionError):
        return False


def math_equal(given: Column | str, truth: Column | str, percent: bool = True, tolerance: float = 1e-4) -> Column:
    """1 where the answer equals the truth as `equal` has it, else 0; 0 where either is null."""

    @pandas_udf("double")
    def graded(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([float(x is not None and y is not None and equal(x, y, percent, tolerance)) for x, y in zip(a, b)], dtype="float64")

    return graded(c(given), c(truth))
