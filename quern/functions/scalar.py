"""Scalar expressions: a small typed language that is compiled to Spark columns while the plan is built.

Types are int (signed), uint, bool, string, char, null and other (passed through: doubles, timestamps). Operators take
operands of one type; null equals null and has no order; `and`, `or` and `not` take truth from any value, where only
null and false are false. Functions are closures; a call replaces the parameters by the arguments, so nothing is left
to call at run time.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ExpressionError(TypeError):
    """An expression whose operands don't fit together."""


@dataclass(frozen=True)
class Const:
    value: object
    type: str | None = None


@dataclass(frozen=True)
class Ref:
    name: str


@dataclass(frozen=True)
class Unary:
    op: str
    operand: object


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Fn:
    params: tuple[str, ...]
    body: object


@dataclass(frozen=True)
class Call:
    function: object
    arguments: tuple


@dataclass(frozen=True)
class Tup:
    items: tuple


@dataclass(frozen=True)
class At:
    target: object
    index: object


@dataclass(frozen=True)
class Let:
    """Bind a name in a block's scope."""

    name: str
    value: object


@dataclass(frozen=True)
class Assign:
    """Change the innermost binding of a name."""

    name: str
    value: object


@dataclass(frozen=True)
class Block:
    """Statements in a scope of their own; the last one's value counts, null for none."""

    statements: tuple


@dataclass(frozen=True)
class Typed:
    column: Column
    type: str
    constant: object = None


@dataclass
class Closure:
    params: tuple[str, ...]
    body: object
    scope: Scope


@dataclass
class Scope:
    names: dict = field(default_factory=dict)
    outer: Scope | None = None

    def find(self, name: str) -> Scope | None:
        at: Scope | None = self
        while at is not None and name not in at.names:
            at = at.outer
        return at


def spark_type(kind: T.DataType) -> str:
    if isinstance(kind, T.LongType | T.IntegerType | T.ShortType | T.ByteType):
        return "int"
    return {T.StringType: "string", T.BooleanType: "bool", T.NullType: "null"}.get(type(kind), "other")


def columns_of(schema: T.StructType, unsigned: frozenset[str] = frozenset()) -> dict[str, Typed]:
    """A schema's columns as names of an expression; those in `unsigned` hold unsigned numbers."""
    return {f.name: Typed(F.col(f"`{f.name}`"), "uint" if f.name in unsigned else spark_type(f.dataType)) for f in schema.fields}


def constant(value: object, kind: str | None = None) -> Typed:
    kind = kind or {bool: "bool", int: "int", str: "string", type(None): "null"}.get(type(value), "other")
    if kind == "uint" and (not isinstance(value, int) or value < 0):
        raise ExpressionError(f"{value!r} is no unsigned number")
    return Typed(F.lit(value).cast("long") if kind in ("int", "uint") else F.lit(value), kind, value)


def truthy(x: Typed) -> Column:
    if x.type == "null":
        return F.lit(False)
    return F.coalesce(x.column, F.lit(False)) if x.type == "bool" else x.column.isNotNull()


def _same(op: str, a: Typed, b: Typed) -> None:
    if a.type != b.type:
        raise ExpressionError(f"{op} takes operands of one type, not {a.type} and {b.type}")


def binary(op: str, a: Typed, b: Typed) -> Typed:
    if op in ("==", "!="):
        _same(op, a, b)
        if a.type == "char":
            raise ExpressionError(f"{op} doesn't take char")
        equal = a.column.eqNullSafe(b.column)
        return Typed(equal if op == "==" else ~equal, "bool")
    if op in ("<", "<=", ">", ">="):
        _same(op, a, b)
        if a.type in ("null", "char"):
            raise ExpressionError(f"{a.type} has no order")
        return Typed({"<": a.column < b.column, "<=": a.column <= b.column, ">": a.column > b.column, ">=": a.column >= b.column}[op], "bool")
    if op in ("and", "or"):
        return Typed(truthy(a) & truthy(b) if op == "and" else truthy(a) | truthy(b), "bool")
    _same(op, a, b)
    if op == "+" and a.type == "string":
        return Typed(F.concat(a.column, b.column), "string")
    if a.type not in ("int", "uint", "other"):
        raise ExpressionError(f"{op} doesn't take {a.type}")
    if op == "-" and a.type == "uint":
        known = _constant(op, a, b)
        return Typed(F.when(a.column >= b.column, a.column - b.column).otherwise(F.raise_error(F.lit("unsigned subtraction below zero")).cast("long")), "uint", known)
    known = _constant(op, a, b)
    if op == "/":
        return Typed(a.column / b.column if a.type == "other" else _div(a.column, b.column), a.type, known)
    return Typed({"+": a.column + b.column, "-": a.column - b.column, "*": a.column * b.column}[op], a.type, known)


#: The range of each whole-number type.
RANGES = {"int": (-(1 << 63), (1 << 63) - 1), "uint": (0, (1 << 64) - 1)}


def _constant(op: str, a: Typed, b: Typed) -> int | None:
    """The value of whole-number arithmetic on constants, worked out while planning; outside the type's range, and
    divided by zero, it is an error at once."""
    x, y = a.constant, b.constant
    if a.type not in RANGES or not isinstance(x, int) or not isinstance(y, int):
        return None
    if op == "/" and not y:
        raise ExpressionError("division by zero")
    value = {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: abs(x) // abs(y) * (1 if (x < 0) == (y < 0) else -1)}[op]()
    low, high = RANGES[a.type]
    if not low <= value <= high:
        raise ExpressionError(f"{x} {op} {y} is no {a.type}")
    return value


def _div(a: Column, b: Column) -> Column:
    """Integer division toward zero, exact for all longs; an error by zero."""
    by = F.when(b == 0, F.raise_error(F.lit("DIVIDE_BY_ZERO")).cast("long")).otherwise(b)
    return F.call_function("div", a, by)


def unary(op: str, x: Typed) -> Typed:
    if op == "not":
        return Typed(~truthy(x), "bool")
    if op == "-" and x.type in ("int", "other"):
        return Typed(-x.column, x.type)
    raise ExpressionError(f"{op} doesn't take {x.type}")


def compile_expression(e: object, columns: Mapping[str, Typed], scope: Scope | None = None):
    """The value of an expression: a Typed column, a tuple of values, or a Closure. Columns shadow the scope's names."""
    scope = scope or Scope()
    go = lambda x, s=scope: compile_expression(x, columns, s)
    match e:
        case Typed() | Closure():
            return e
        case tuple():
            return tuple(map(go, e))
        case Const(value, kind):
            return constant(value, kind)
        case Ref(name):
            if name in columns:
                return columns[name]
            at = scope.find(name)
            if at is None:
                raise ExpressionError(f"unknown name {name}")
            return at.names[name]
        case Unary(op, operand):
            return unary(op, go(operand))
        case Binary(op, left, right):
            a, b = go(left), go(right)
            if isinstance(a, tuple) and isinstance(b, tuple) and op in ("==", "!="):
                if len(a) != len(b):
                    raise ExpressionError("tuples of different lengths")
                equal = F.lit(True)
                for x, y in zip(a, b, strict=True):
                    equal = equal & binary("==", x, y).column
                return Typed(equal if op == "==" else ~equal, "bool")
            if not isinstance(a, Typed) or not isinstance(b, Typed):
                raise ExpressionError(f"{op} doesn't take tuples or functions")
            return binary(op, a, b)
        case Tup(items):
            return tuple(map(go, items))
        case At(target, index):
            items, k = go(target), go(index)
            if not isinstance(items, tuple) or not isinstance(k, Typed) or not isinstance(k.constant, int):
                raise ExpressionError("an index needs a tuple and a constant")
            if not 0 <= k.constant < len(items):
                raise ExpressionError(f"index {k.constant} of {len(items)} items")
            return items[k.constant]
        case Fn(params, body):
            return Closure(params, body, scope)
        case Call(function, arguments):
            f = go(function)
            if not isinstance(f, Closure):
                raise ExpressionError("only functions can be called")
            if len(f.params) != len(arguments):
                raise ExpressionError(f"{len(f.params)} arguments expected, {len(arguments)} given")
            inner = Scope(dict(zip(f.params, map(go, arguments), strict=True)), f.scope)
            return compile_expression(f.body, {k: v for k, v in columns.items() if k not in f.params}, inner)
        case Let(name, value):
            scope.names[name] = go(value)
            return scope.names[name]
        case Assign(name, value):
            at = scope.find(name)
            if at is None:
                raise ExpressionError(f"unknown name {name}")
            at.names[name] = go(value)
            return at.names[name]
        case Block(statements):
            inner, last = Scope({}, scope), constant(None)
            for s in statements:
                last = go(s, inner)
            return last
    return constant(e)
