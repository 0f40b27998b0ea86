"""Filters to two-valued Columns.

A filter is true or false for every row, never NULL: each test is wrapped before it can be negated. A positive test
that stands on its own at the top is emitted bare, so that it reaches the Parquet scan. Paths fan out over arrays
(a digit segment is an index); a test on an array holds if any element passes it.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.errors import BadValue, Unsupported
from docspark.functions.expressions import literal
from docspark.functions.scope import Scope, split_path, type_name, type_rank

Test = Callable[[Column, T.DataType], Column]
_TYPES = {"double": 1, "string": 2, "object": 3, "array": 4, "bool": 8, "boolean": 8, "date": 9, "null": 10, "regex": 11, "int": 16, "long": 18, "decimal": 19, "number": 0, "objectid": 7}


def matches(filter_: dict, scope: Scope) -> Column:
    """The Column of a filter."""
    if not isinstance(filter_, dict):
        raise BadValue("a filter is a document")
    return reduce(lambda a, b: a & b, [_entry(k, v, scope) for k, v in filter_.items()], F.lit(True))


def _sure(column: Column) -> Column:
    return F.coalesce(column, F.lit(False))


def _entry(key: str, value: Any, scope: Scope) -> Column:
    if key in ("$and", "$or", "$nor"):
        if not isinstance(value, list):
            raise BadValue(f"{key} takes a list")
        parts = [matches(f, scope) for f in value]
        if key == "$and":
            return reduce(lambda a, b: a & b, parts, F.lit(True))
        some = reduce(lambda a, b: a | b, parts, F.lit(False))
        return some if key == "$or" else ~_sure(some)
    if key == "$not":
        return ~_sure(matches(value, scope))
    if key == "$expr":
        column = _expr(value, scope)
        return _sure(_expr_truth(column, scope.dtype(column)))
    if key.startswith("$"):
        raise Unsupported(f"unsupported top-level operator {key}")
    first, *rest = split_path(key)
    root = (scope.column(first), scope.df.schema[first].dataType) if first in scope.df.columns else None
    return field_test(root, rest, value)


def is_operators(value: Any) -> bool:
    return isinstance(value, dict) and bool(value) and all(k.startswith("$") for k in value)


def field_test(root: tuple[Column, T.DataType] | None, rest: list[str], value: Any) -> Column:
    """What a field's entry in a filter asks of the path `rest` below a column."""
    if not is_operators(value):
        return _apply(root, rest, "$eq", value, {})
    if "$options" in value and "$regex" not in value:
        raise BadValue("$options needs $regex")
    return reduce(lambda a, b: a & b, [_apply(root, rest, k, v, value) for k, v in value.items() if k != "$options"])


def _apply(root, rest: list[str], name: str, operand: Any, whole: dict) -> Column:
    if name == "$ne":
        return ~_sure(_apply(root, rest, "$eq", operand, whole))
    if name == "$nin":
        if not isinstance(operand, list):
            raise BadValue("$nin takes a list")
        # a missing field passes even if the list has null
        present = _walk(root, rest, lambda c, t: c.isNotNull())
        return ~_sure(_apply(root, rest, "$in", operand, whole)) | ~_sure(present)
    if name == "$not":
        if isinstance(operand, (re.Pattern, str)):
            operand = {"$regex": operand}
        if not is_operators(operand):
            raise BadValue("$not takes operators or a pattern")
        return ~_sure(field_test(root, rest, operand))
    if name == "$in":
        if not isinstance(operand, list):
            raise BadValue("$in takes a list")
        return reduce(lambda a, b: a | b, [_apply(root, rest, "$eq", v, whole) for v in operand], F.lit(False))
    if name not in _TESTS:
        raise Unsupported(f"unsupported operator {name}")
    return _walk(root, rest, _TESTS[name](operand, whole), null_matches=name == "$eq" and operand is None or name == "$exists" and operand is False)


def _walk(root, rest: list[str], test: Test, null_matches: bool = False) -> Column:
    """A test at the end of a path; any element of an array on the way may pass it."""
    if root is None:
        return F.lit(null_matches)
    column, kind = root
    if not rest:
        return test(column, kind)
    name, *more = rest
    if isinstance(kind, T.StructType):
        return _walk((column.getField(name), kind[name].dataType) if name in kind.names else None, more, test, null_matches)
    if isinstance(kind, T.ArrayType):
        if name.isdigit():
            return _walk((F.get(column, int(name)), kind.elementType), more, test, null_matches)
        some = F.exists(column, lambda x: _sure(_walk((x, kind.elementType), rest, test, null_matches)))
        return F.coalesce(some, F.lit(True)) if null_matches else some
    return F.lit(null_matches)


def _any(test: Test) -> Test:
    """The test on a value, or on any element of an array."""

    def build(column: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.ArrayType):
            return F.exists(column, lambda x: _sure(test(x, kind.elementType)))
        return test(column, kind)

    return build


def _value_rank(value: Any) -> int:
    if value is None:
        return 1
    if isinstance(value, bool):
        return 8
    return 2 if isinstance(value, (int, float)) else 3 if isinstance(value, str) else 4 if isinstance(value, dict) else 5 if isinstance(value, list) else 6 if isinstance(value, bytes) else 9


def _equal(value: Any, _: dict) -> Test:
    if isinstance(value, re.Pattern):
        return _regex(value, {})
    if value is None:
        return lambda c, t: F.exists(c, lambda x: x.isNull()) | c.isNull() if isinstance(t, T.ArrayType) else c.isNull()

    def build(column: Column, kind: T.DataType) -> Column:
        if isinstance(value, list):
            whole = column == literal(value) if isinstance(kind, T.ArrayType) else F.lit(False)
            nested = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.ArrayType)
            return whole | F.exists(column, lambda x: _sure(x == literal(value))) if nested else whole
        if isinstance(value, dict):
            return _any(lambda c, t: _document(c, t, value))(column, kind)
        return _any(lambda c, t: c == F.lit(value) if type_rank(t) == _value_rank(value) else F.lit(False))(column, kind)

    return build


def _document(column: Column, kind: T.DataType, value: dict) -> Column:
    """A document equals another if it has the same fields, in any order; a missing field is NULL."""
    if not isinstance(kind, T.StructType) or not set(value) <= set(kind.names):
        return F.lit(False)
    return reduce(lambda a, b: a & b, [(_document(column.getField(f), kind[f].dataType, value[f]) if isinstance(value.get(f), dict) else column.getField(f).eqNullSafe(literal(value.get(f)))) for f in kind.names], column.isNotNull())


def _compare(name: str) -> Callable[[Any, dict], Test]:
    step = {"$gt": lambda a, b: a > b, "$gte": lambda a, b: a >= b, "$lt": lambda a, b: a < b, "$lte": lambda a, b: a <= b}[name]
    return lambda value, _: _any(lambda c, t: step(c, F.lit(value)) if value is not None and type_rank(t) == _value_rank(value) else F.lit(False))


def _regex(pattern: Any, whole: dict) -> Test:
    if isinstance(pattern, re.Pattern):
        flags = "".join(f for f, bit in (("i", re.I), ("m", re.M), ("s", re.S), ("x", re.X)) if pattern.flags & bit)
        pattern = pattern.pattern
    else:
        flags = whole.get("$options", "")
    if not isinstance(pattern, str) or set(flags) - set("imsxu"):
        raise BadValue("bad $regex or $options")
    text = f"(?{flags}){pattern}" if flags else pattern
    return _any(lambda c, t: c.rlike(text) if isinstance(t, T.StringType) else F.lit(False))


def _type_test(operand: Any, _: dict) -> Test:
    code = _TYPES.get(operand.lower()) if isinstance(operand, str) else operand if operand in _TYPES.values() else None
    if code is None:
        raise BadValue(f"unknown type {operand!r}")

    def own(kind: T.DataType) -> bool:
        return type_rank(kind) == 2 if code == 0 else _TYPES.get(type_name(kind)) == code

    def build(column: Column, kind: T.DataType) -> Column:
        if code == 10:
            return column.isNull()
        if isinstance(kind, T.ArrayType) and code != 4:
            return F.exists(column, lambda x: x.isNotNull()) if own(kind.elementType) else F.lit(False)
        return column.isNotNull() if own(kind) else F.lit(False)

    return build


def _size(operand: Any, _: dict) -> Test:
    if not isinstance(operand, int) or isinstance(operand, bool) or operand < 0:
        raise BadValue("$size takes a whole number of 0 or more")
    return lambda c, t: F.size(c) == operand if isinstance(t, T.ArrayType) else F.lit(False)


def _element(operand: Any, _: dict) -> Test:
    if not isinstance(operand, dict) or not operand:
        raise BadValue("$elemMatch takes a document")

    def one(column: Column, kind: T.DataType) -> Column:
        if is_operators(operand) and not set(operand) & {"$and", "$or", "$nor", "$expr"}:
            return field_test((column, kind), [], operand)
        if not isinstance(kind, T.StructType):
            return F.lit(False)
        return reduce(lambda a, b: a & b, [_sub_entry(k, v, column, kind) for k, v in operand.items()])

    return lambda c, t: F.exists(c, lambda x: _sure(one(x, t.elementType))) if isinstance(t, T.ArrayType) else F.lit(False)


def _sub_entry(key: str, value: Any, column: Column, kind: T.StructType) -> Column:
    if key in ("$and", "$or", "$nor"):
        parts = [reduce(lambda a, b: a & b, [_sub_entry(k, v, column, kind) for k, v in f.items()], F.lit(True)) for f in value]
        if key == "$and":
            return reduce(lambda a, b: a & b, parts, F.lit(True))
        some = reduce(lambda a, b: a | b, parts, F.lit(False))
        return some if key == "$or" else ~_sure(some)
    if key.startswith("$"):
        raise Unsupported(f"unsupported operator {key} for elements")
    first, *rest = split_path(key)
    return field_test((column.getField(first), kind[first].dataType) if first in kind.names else None, rest, value)


def _all(operand: Any, _: dict) -> Test:
    if not isinstance(operand, list):
        raise BadValue("$all takes a list")

    def build(column: Column, kind: T.DataType) -> Column:
        if not isinstance(kind, T.ArrayType):
            return F.lit(False)
        parts = [_sure((_element(v["$elemMatch"], {}) if isinstance(v, dict) and set(v) == {"$elemMatch"} else _equal(v, {}))(column, kind)) for v in operand]
        return reduce(lambda a, b: a & b, parts, column.isNotNull())

    return build


def _mod(operand: Any, _: dict) -> Test:
    if not isinstance(operand, list) or len(operand) != 2 or not operand[0]:
        raise BadValue("$mod takes a divisor other than 0 and a remainder")
    return _any(lambda c, t: c % F.lit(operand[0]) == operand[1] if type_rank(t) == 2 else F.lit(False))


def _bits(operand: Any, _: dict) -> Test:
    if isinstance(operand, list):
        operand = sum(1 << b for b in set(operand))
    if not isinstance(operand, int) or operand < 0:
        raise BadValue("$bitsAllSet takes a mask or a list of bits")
    return _any(lambda c, t: c.cast("long").bitwiseAND(F.lit(operand).cast("long")) == operand if type_rank(t) == 2 else F.lit(False))


def _exists(operand: Any, _: dict) -> Test:
    if not isinstance(operand, bool):
        raise BadValue("$exists takes true or false")
    return lambda c, t: c.isNotNull() if operand else c.isNull()


_TESTS: dict[str, Callable[[Any, dict], Test]] = {
    "$eq": _equal,
    **{n: _compare(n) for n in ("$gt", "$gte", "$lt", "$lte")},
    "$exists": _exists,
    "$type": _type_test,
    "$size": _size,
    "$elemMatch": _element,
    "$all": _all,
    "$regex": _regex,
    "$mod": _mod,
    "$bitsAllSet": _bits,
}


# $expr has its own comparisons: values of different types, and NULLs in an order comparison, don't compare.


def _expr_truth(column: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.BooleanType):
        return column
    if isinstance(kind, T.StringType):
        return column != ""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return (column != 0) & ~F.isnan(column) & (F.abs(column) != float("inf"))
    return column != 0 if isinstance(kind, T.NumericType) else column.isNotNull()


def _expr(value: Any, scope: Scope) -> Column:
    from docspark.functions.expressions import expression

    if not (isinstance(value, dict) and len(value) == 1 and next(iter(value)).startswith("$")):
        if isinstance(value, list):
            return F.array(*[_expr(v, scope) for v in value])
        return expression(value, scope) if not isinstance(value, dict) else F.struct(*[_expr(v, scope).alias(k) for k, v in value.items()])
    name, operand = next(iter(value.items()))
    if name == "$literal":
        return literal(operand)
    if name not in ("$eq", "$ne", "$gt", "$gte", "$lt", "$lte", "$add", "$and", "$or", "$not"):
        raise Unsupported(f"unsupported in $expr: {name}")
    if not isinstance(operand, list) or not operand:
        raise BadValue(f"{name} takes a list of arguments")
    parts = [_expr(v, scope) for v in operand]
    if name in ("$and", "$or", "$not"):
        truths = [_sure(_expr_truth(p, scope.dtype(p))) for p in parts]
        if name == "$not":
            if len(parts) != 1:
                raise BadValue("$not takes one argument")
            return ~truths[0]
        return reduce((lambda a, b: a & b) if name == "$and" else (lambda a, b: a | b), truths)
    if name == "$add":
        return reduce(lambda a, b: a + b, parts)
    if len(parts) != 2:
        raise BadValue(f"{name} takes two arguments")
    a, b = parts
    ranks = type_rank(scope.dtype(a)), type_rank(scope.dtype(b))
    alike = ranks[0] == ranks[1]
    if name in ("$eq", "$ne"):
        same = a.eqNullSafe(b) if alike or 1 in ranks else F.lit(False)
        return same if name == "$eq" else ~same
    step = {"$gt": lambda: a > b, "$gte": lambda: a >= b, "$lt": lambda: a < b, "$lte": lambda: a <= b}[name]
    return _sure(step()) if alike else F.lit(False)
