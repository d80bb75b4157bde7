"""Expression text to Column: a whitelist of arithmetic, comparison and logic, never ``eval``.

Everything is computed in doubles. An unknown name is 0; whatever can't be computed (division by
zero, a null operand, text) makes the whole expression 0.0.
"""

from __future__ import annotations

import ast
import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Unsupported(ValueError):
    pass


def _truth(c: Column) -> Column:
    return F.coalesce(c != 0, F.lit(False))


def _compile(node: ast.AST, schema: T.StructType) -> Column:
    go = lambda n: _compile(n, schema)
    if isinstance(node, ast.Expression):
        return go(node.body)
    if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)):
        return F.lit(float(node.value))
    if isinstance(node, ast.Name):
        if node.id in ("True", "False"):
            return F.lit(float(node.id == "True"))
        if node.id not in schema.fieldNames():
            return F.lit(0.0)
        kind = schema[node.id].dataType
        if isinstance(kind, T.BooleanType):
            return F.col(node.id).cast("int").cast("double")
        return F.col(node.id).cast("double") if isinstance(kind, T.NumericType) else F.lit(None).cast("double")
    if isinstance(node, ast.UnaryOp):
        v = go(node.operand)
        if isinstance(node.op, ast.USub):
            return -v
        if isinstance(node.op, ast.UAdd):
            return v
        if isinstance(node.op, ast.Not):
            return F.when(v.isNotNull(), (v == 0).cast("double"))
    if isinstance(node, ast.BinOp):
        a, b = go(node.left), go(node.right)
        if isinstance(node.op, ast.Add):
            return a + b
        if isinstance(node.op, ast.Sub):
            return a - b
        if isinstance(node.op, ast.Mult):
            return a * b
        if isinstance(node.op, ast.Div):
            return F.try_divide(a, b)
        if isinstance(node.op, ast.FloorDiv):
            return F.floor(F.try_divide(a, b)).cast("double")
        if isinstance(node.op, ast.Mod):  # the sign of the divisor
            return a - b * F.floor(F.try_divide(a, b))
        if isinstance(node.op, ast.Pow):
            return F.pow(a, b)
    if isinstance(node, ast.BoolOp):
        out = go(node.values[-1])
        for v in reversed(node.values[:-1]):
            v = go(v)
            keep = _truth(v) if isinstance(node.op, ast.Or) else ~_truth(v) & v.isNotNull()
            out = F.when(v.isNull(), F.lit(None).cast("double")).when(keep, v).otherwise(out)
        return out
    if isinstance(node, ast.Compare):
        ops = {ast.Lt: "__lt__", ast.LtE: "__le__", ast.Gt: "__gt__", ast.GtE: "__ge__", ast.Eq: "__eq__", ast.NotEq: "__ne__"}
        left, out = go(node.left), None
        for op, right in zip(node.ops, node.comparators, strict=True):
            if type(op) not in ops:
                break
            right = go(right)
            test = getattr(left, ops[type(op)])(right)
            out, left = test if out is None else out & test, right
        else:
            return out.cast("double")
    if isinstance(node, ast.IfExp):
        test = go(node.test)
        return F.when(test.isNull(), F.lit(None).cast("double")).when(_truth(test), go(node.body)).otherwise(go(node.orelse))
    raise Unsupported(ast.dump(node)[:80])


def arithmetic(text: str, schema: T.StructType) -> Column:
    try:
        c = _compile(ast.parse(text.strip(), mode="eval"), schema)
    except (SyntaxError, Unsupported):
        return F.lit(0.0)
    return F.coalesce(F.when(~F.isnan(c), c), F.lit(0.0))


#: Parts of a conditional: quoted text, words, signs; whatever lies between them is kept.
TOKEN = re.compile(r"'[^']*'|\"[^\"]*\"|[A-Za-z_][A-Za-z_0-9.]*|.", re.S)


def _outer(text: str) -> list[re.Match]:
    """The tokens outside of all brackets."""
    depth, out = 0, []
    for t in TOKEN.finditer(text):
        depth -= t.group() in ")]"
        if not depth:
            out.append(t)
        depth += t.group() in "(["
    return out


def _parts(text: str) -> tuple[str, str, str] | None:
    """Test and branches of the outermost conditional; its branches may hold conditionals themselves."""
    tokens = _outer(text)
    words = [t.group().lower() for t in tokens]
    spoken = next((w for w in words if w.strip()), "") == "if"
    opens, middle, closes = ("if", "then", "else") if spoken else ("?", "?", ":")
    first, inner = None, 0
    for t, w in zip(tokens, words, strict=True):
        if first is None:
            first = t if w == middle else None
        elif w == opens:
            inner += 1
        elif w == closes and inner:
            inner -= 1
        elif w == closes:
            start = next(t.end() for t, w in zip(tokens, words, strict=True) if w == "if") if spoken else 0
            return text[start : first.start()], text[first.end() : t.start()], text[t.end() :]
    return None


def conditional(text: str, schema: T.StructType) -> Column:
    """``c ? a : b`` or ``if c then a else b``, nested too; anything else is 0.0."""
    parts = _parts(text)
    if not parts:
        return F.lit(0.0)
    test, *branches = parts

    def branch(part: str) -> Column:
        part = part.strip()
        bare = part[1:-1] if len(_outer(part)) == 2 and part[:1] == "(" else part  # brackets around all of it
        return conditional(bare, schema) if _parts(bare) else arithmetic(bare, schema)

    a, b = map(branch, branches)
    return F.when(arithmetic(test, schema) != 0, a).otherwise(b)
