"""Derived columns: arithmetic text compiled to Spark column expressions.

The text is parsed by Python's own ``ast`` module and every node becomes a Catalyst
expression, so a derived column runs inside whole-stage codegen. Nothing is evaluated per
row in Python.
"""

from __future__ import annotations

import ast
import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planeweave.functions.numeric import finite, half_up, nan

CONSTANTS = {"pi": math.pi, "e": math.e}
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*")
_NUMBER = re.compile(r"(?:\d[\d.]*|\.\d[\d.]*)(?:[eE][+-]?\d+)?")
_SAFE = re.compile(r"[\s+\-*/%^(),]")


class ExpressionError(ValueError):
    """Malformed expression; ``position`` is the offset of the fault in the text."""

    def __init__(self, message: str, position: int):
        super().__init__(message)
        self.position = position


def _whole(fn):
    return lambda v: F.when(finite(v), fn(v).cast("double")).otherwise(v)


def _extreme(pick):
    def build(*args: Column) -> Column:
        bad = F.lit(False)
        for a in args:
            bad = bad | F.isnan(a)
        best = args[0] if len(args) == 1 else pick(*args)
        return F.when(bad, nan()).otherwise(best)
    return build


def _log(fn):
    return lambda v: F.when(v == 0, F.lit(-math.inf)).otherwise(F.coalesce(fn(v), nan()))


FUNCTIONS = {
    "abs": F.abs, "sqrt": F.sqrt, "exp": F.exp, "sin": F.sin, "cos": F.cos, "tan": F.tan,
    "log": _log(F.ln), "log10": _log(F.log10), "log2": _log(F.log2),
    "min": _extreme(F.least), "max": _extreme(F.greatest), "pow": F.pow, "atan2": F.atan2,
    "round": _whole(half_up), "floor": _whole(F.floor), "ceil": _whole(F.ceil),
    "sign": lambda v: F.signum(v),
}


def _divide(a: Column, b: Column) -> Column:
    """IEEE division: x/0 is a signed infinity and 0/0 is NaN instead of an error."""
    by_zero = F.when((a == 0) | F.isnan(a), nan()).when(a > 0, F.lit(math.inf)).otherwise(F.lit(-math.inf))
    return F.when(b == 0, by_zero).otherwise(F.try_divide(a, b))


def _remainder(a: Column, b: Column) -> Column:
    return F.when(b == 0, nan()).otherwise(a % F.when(b != 0, b))


def _prepare(text: str):
    """Check the alphabet, put each name under a placeholder, and turn ``^`` into ``**``."""
    out, names, origin, i = [], {}, [], 0
    while i < len(text):
        m = _NUMBER.match(text, i) or _NAME.match(text, i)
        if m and (text[i].isdigit() or text[i] == "."):
            try:
                piece = repr(float(m.group()))
            except ValueError:
                raise ExpressionError(f'Invalid number "{m.group()}"', i) from None
        elif m:
            piece = f"n{len(names)}"
            names[piece] = m.group()
        elif _SAFE.match(text[i]):
            piece = {"^": "**"}.get(text[i], " " if text[i].isspace() else text[i])
            # '//' and '**' typed by the user are not operators here.
            if i and text[i] in "*/" and text[i - 1] == text[i]:
                raise ExpressionError(f'Unexpected token "{text[i]}"', i)
        else:
            raise ExpressionError(f'Unexpected character "{text[i]}"', i)
        out.append(piece)
        origin += [i] * len(piece)
        i = m.end() if m else i + 1
    return "".join(out), names, origin + [len(text)]


def _parse(text: str):
    source, names, origin = _prepare(text)
    lead = len(source) - len(source.lstrip())
    try:
        tree = ast.parse(source.strip(), mode="eval").body
    except SyntaxError as exc:
        unfinished = source.rstrip()[-1:] in ("", *"+-*/%(,")
        at = len(origin) - 1 if unfinished else min(lead + (exc.offset or 1) - 1, len(origin) - 1)
        raise ExpressionError("Unexpected token or end of expression", origin[at]) from None
    return tree, names, source.strip(), lambda node: origin[lead + node.col_offset]


def compile_expression(text: str, numeric_columns: set[str]) -> Column:
    """Column for the text; an unknown name is NaN, an unknown function an error."""
    tree, names, source, place = _parse(text)

    def name_of(node):
        return names.get(node.id, node.id)

    def build(node) -> Column:
        if isinstance(node, ast.Constant) and isinstance(node.value, float):
            return F.lit(node.value)
        if isinstance(node, ast.Name):
            name = name_of(node)
            if name.lower() in CONSTANTS:
                return F.lit(CONSTANTS[name.lower()])
            if name in numeric_columns:
                return F.coalesce(F.col(f"`{name}`").cast("double"), nan())
            return nan()
        if isinstance(node, ast.UnaryOp):
            inner = node.operand
            # The sign binds tighter than the power here: -2^2 is (-2)^2.
            bare = "(" not in source[node.col_offset + 1:inner.col_offset]
            if isinstance(inner, ast.BinOp) and isinstance(inner.op, ast.Pow) and bare:
                signed = ast.copy_location(ast.UnaryOp(node.op, inner.left), node)
                return F.pow(build(signed), build(inner.right))
            return -build(inner) if isinstance(node.op, ast.USub) else build(inner)
        if isinstance(node, ast.BinOp):
            a, b = build(node.left), build(node.right)
            for op, made in ((ast.Add, lambda: a + b), (ast.Sub, lambda: a - b), (ast.Mult, lambda: a * b),
                             (ast.Div, lambda: _divide(a, b)), (ast.Mod, lambda: _remainder(a, b)),
                             (ast.Pow, lambda: F.pow(a, b))):
                if isinstance(node.op, op):
                    return made()
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name):
            fn = FUNCTIONS.get(name_of(node.func).lower())
            if fn is None:
                raise ExpressionError(f'Unknown function "{name_of(node.func)}"', place(node))
            try:
                return fn(*[build(a) for a in node.args])
            except TypeError:
                raise ExpressionError("Wrong number of arguments", place(node)) from None
        raise ExpressionError("Unexpected token", place(node))

    return build(tree)


def with_derived(rows: DataFrame, name: str, text: str) -> DataFrame:
    numeric = {n for n, t in rows.dtypes if t in ("double", "float", "int", "bigint", "smallint", "tinyint")}
    return rows.withColumn(name, compile_expression(text, numeric))


def dependencies(text: str) -> list[str]:
    """Column names an expression refers to, in order of first use; [] if unreadable."""
    try:
        tree, names, _, _ = _parse(text)
    except ExpressionError:
        return []
    called = {id(n.func) for n in ast.walk(tree) if isinstance(n, ast.Call)}
    used = [n for n in ast.walk(tree) if isinstance(n, ast.Name) and id(n) not in called]
    ordered = [names.get(n.id, n.id) for n in sorted(used, key=lambda n: n.col_offset)]
    return list(dict.fromkeys(n for n in ordered if n.lower() not in CONSTANTS))
