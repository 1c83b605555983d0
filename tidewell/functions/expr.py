"""A small expression language over metric names, compiled to columns.

Numbers, variables, + - * / ^, comparisons (1 or 0), && || and ?:, functions and the constants _pi and _e.
Arithmetic is that of doubles: x / 0 is infinite, 0 / 0 is NaN. Variable names may hold dots, colons and
dashes where they match a known name as a whole; the longest known name wins.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.errors import QueryError

_NUMBER = re.compile(r"(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?")
_NAME = re.compile(r"[A-Za-z_]\w*")
_OPERATORS = ("&&", "||", "<=", ">=", "==", "!=", "<", ">", "+", "-", "*", "/", "^", "?", ":", "(", ")", ",")
#: Levels of binary operators from loosest to tightest; all are left-associative but ^.
_LEVELS = (("||",), ("&&",), ("==", "!=", "<", ">", "<=", ">="), ("+", "-"), ("*", "/"))


def divided(a: Column, b: Column) -> Column:
    """Division of doubles without errors: infinite or NaN for a zero divisor."""
    zero = F.when(a > 0, F.lit(math.inf)).when(a < 0, F.lit(-math.inf)).otherwise(F.lit(math.nan))
    return F.when(b != 0, a / F.when(b != 0, b)).when(b.isNotNull(), zero)


def _flag(c: Column) -> Column:
    return F.when(c, F.lit(1.0)).otherwise(F.lit(0.0))


def _log(f):
    """A logarithm that gives NaN below 0 and minus infinity at 0, as doubles do."""
    return lambda x: F.when(x > 0, f(x)).when(x == 0, F.lit(-math.inf)).otherwise(F.lit(math.nan))


_UNARY = {
    "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan, "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh,
    "asinh": F.asinh, "acosh": F.acosh, "atanh": F.atanh, "log2": _log(F.log2), "log10": _log(F.log10), "log": _log(F.log), "ln": _log(F.log),
    "exp": F.exp, "sqrt": F.sqrt, "sign": F.signum, "rint": F.rint, "abs": F.abs,
}
_VARIADIC = {
    "min": lambda *a: F.least(*a) if len(a) > 1 else a[0],
    "max": lambda *a: F.greatest(*a) if len(a) > 1 else a[0],
    "sum": lambda *a: reduce(lambda x, y: x + y, a),
    "avg": lambda *a: reduce(lambda x, y: x + y, a) / F.lit(float(len(a))),
}


def _binary(op: str, a: Column, b: Column) -> Column:
    return {
        "||": lambda: _flag((a != 0) | (b != 0)),
        "&&": lambda: _flag((a != 0) & (b != 0)),
        "==": lambda: _flag(a == b),
        "!=": lambda: _flag(a != b),
        "<": lambda: _flag(a < b),
        ">": lambda: _flag(a > b),
        "<=": lambda: _flag(a <= b),
        ">=": lambda: _flag(a >= b),
        "+": lambda: a + b,
        "-": lambda: a - b,
        "*": lambda: a * b,
        "/": lambda: divided(a, b),
    }[op]()


class _Parser:
    def __init__(self, text: str, variables: Mapping[str, Column]) -> None:
        self.variables, self.text = variables, text
        self.tokens = [*self._tokens(text), ("end", "")]
        self.at = 0

    def _tokens(self, s: str):
        known, i = sorted(self.variables, key=len, reverse=True), 0
        while i < len(s):
            if s[i].isspace():
                i += 1
                continue
            name = next((k for k in known if s.startswith(k, i) and not re.match(r"\w", s[i + len(k) : i + len(k) + 1])), None)
            if name:
                yield "variable", name
                i += len(name)
            elif m := _NUMBER.match(s, i):
                yield "number", m[0]
                i = m.end()
            elif m := _NAME.match(s, i):
                yield "name", m[0]
                i = m.end()
            elif op := next((o for o in _OPERATORS if s.startswith(o, i)), None):
                yield "op", op
                i += len(op)
            else:
                raise QueryError(f"unexpected {s[i]!r} in expression {s!r}")

    def fail(self) -> QueryError:
        return QueryError(f"bad expression {self.text!r} near {self.tokens[self.at][1] or 'its end'!r}")

    def take(self, *ops: str) -> str | None:
        kind, text = self.tokens[self.at]
        if kind == "op" and text in ops:
            self.at += 1
            return text
        return None

    def need(self, op: str) -> None:
        if not self.take(op):
            raise self.fail()

    def whole(self) -> Column:
        out = self.ternary()
        if self.tokens[self.at][0] != "end":
            raise self.fail()
        return out

    def ternary(self) -> Column:
        test = self.level(0)
        if not self.take("?"):
            return test
        yes = self.ternary()
        self.need(":")
        return F.when(test != 0, yes).otherwise(self.ternary())

    def level(self, k: int) -> Column:
        if k == len(_LEVELS):
            return self.signed()
        left = self.level(k + 1)
        while op := self.take(*_LEVELS[k]):
            left = _binary(op, left, self.level(k + 1))
        return left

    def signed(self) -> Column:
        if self.take("-"):
            return -self.signed()
        if self.take("+"):
            return self.signed()
        base = self.atom()
        return F.pow(base, self.signed()) if self.take("^") else base

    def atom(self) -> Column:
        kind, text = self.tokens[self.at]
        if self.take("("):
            out = self.ternary()
            self.need(")")
            return out
        self.at += 1
        if kind == "number":
            return F.lit(float(text))
        if kind == "variable":
            return self.variables[text]
        if kind == "name" and text in ("_pi", "_e"):
            return F.lit(math.pi if text == "_pi" else math.e)
        if kind == "name" and (text in _UNARY or text in _VARIADIC):
            self.need("(")
            args = [self.ternary()]
            while self.take(","):
                args.append(self.ternary())
            self.need(")")
            if text in _UNARY and len(args) > 1:
                raise QueryError(f"{text} takes one argument")
            return _UNARY[text](args[0]) if text in _UNARY else _VARIADIC[text](*args)
        self.at -= 1
        raise QueryError(f"unknown name {text!r} in expression {self.text!r}") if kind == "name" else self.fail()


def compile_expression(text: str, variables: Mapping[str, Column]) -> Column:
    """A column of an expression; variables must be columns of doubles without nulls."""
    return _Parser(text, variables).whole()
