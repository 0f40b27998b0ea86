"""Expressions to Columns.

A missing field is NULL. Comparisons are total: NULL comes before all, and values of different types compare by the
order of their types. The truth of a value: NULL, false, 0 and NaN are false, everything else is true.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.errors import BadValue, Unsupported
from docspark.functions.scope import Scope, type_name, type_rank

_UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 7 * 86400}
_MONTHS = {"month": 1, "quarter": 3, "year": 12}
_WEEKDAYS = ["sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday"]


def literal(value: Any) -> Column:
    if isinstance(value, dict):
        return F.struct(*[literal(v).alias(k) for k, v in value.items()])
    if isinstance(value, list):
        return F.array(*[literal(v) for v in value])
    return F.lit(value)


def expression(value: Any, scope: Scope) -> Column:
    """The Column of an expression."""
    if isinstance(value, str) and value.startswith("$$"):
        name, _, rest = value[2:].partition(".")
        if name in ("ROOT", "CURRENT"):
            return expression("$" + rest, scope) if rest else scope.root()
        if name not in scope.variables:
            raise Unsupported(f"unknown variable {value}")
        return scope.variables[name].getField(rest) if rest else scope.variables[name]
    if isinstance(value, str) and value.startswith("$"):
        found = scope.at(value[1:])
        return F.lit(None) if found is None else found[0]
    if isinstance(value, dict):
        if len(value) == 1 and next(iter(value)).startswith("$"):
            name, operand = next(iter(value.items()))
            if name not in _OPERATORS:
                raise Unsupported(f"unsupported expression {name}")
            return _OPERATORS[name](operand, scope)
        if any(k.startswith("$") for k in value):
            raise BadValue("an operator stands alone in its document")
        return F.struct(*[expression(v, scope).alias(k) for k, v in value.items()])
    if isinstance(value, list):
        return F.array(*[expression(v, scope) for v in value])
    return F.lit(value)


def truth(column: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.BooleanType):
        return F.coalesce(column, F.lit(False))
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.coalesce((column != 0) & ~F.isnan(column), F.lit(False))
    if isinstance(kind, T.NumericType):
        return F.coalesce(column != 0, F.lit(False))
    return column.isNotNull()


def _true(value: Any, scope: Scope) -> Column:
    column = expression(value, scope)
    return truth(column, scope.dtype(column))


def _list(operand: Any, name: str, least: int, most: int | None = None) -> list:
    if not isinstance(operand, list) or len(operand) < least or most is not None and len(operand) > most:
        raise BadValue(f"{name} takes a list of {least}{'' if most == least else ' or more'} arguments")
    return operand


def order_of(a: Column, b: Column, scope: Scope) -> Column:
    """-1, 0 or 1 in the order of all values."""
    ranks = type_rank(scope.dtype(a)), type_rank(scope.dtype(b))
    if 1 not in ranks and ranks[0] != ranks[1]:
        step = F.lit(-1 if ranks[0] < ranks[1] else 1)
    else:
        step = F.when(a < b, -1).when(a > b, 1).otherwise(0)
    return F.when(a.isNull() & b.isNull(), 0).when(a.isNull(), -1).when(b.isNull(), 1).otherwise(step)


def _comparison(name: str) -> Callable[[Any, Scope], Column]:
    def build(operand: Any, scope: Scope) -> Column:
        a, b = (expression(x, scope) for x in _list(operand, name, 2, 2))
        ranks = type_rank(scope.dtype(a)), type_rank(scope.dtype(b))
        same = 1 in ranks or ranks[0] == ranks[1]
        if name in ("$eq", "$ne") and same:
            return a.eqNullSafe(b) if name == "$eq" else ~a.eqNullSafe(b)
        step = order_of(a, b, scope)
        return {"$eq": step == 0, "$ne": step != 0, "$gt": step > 0, "$gte": step >= 0, "$lt": step < 0, "$lte": step <= 0, "$cmp": step}[name]

    return build


def _cond(operand: Any, scope: Scope) -> Column:
    if isinstance(operand, dict):
        if set(operand) != {"if", "then", "else"}:
            raise BadValue("$cond takes if, then and else")
        operand = [operand["if"], operand["then"], operand["else"]]
    test, then, other = _list(operand, "$cond", 3, 3)
    return F.when(_true(test, scope), expression(then, scope)).otherwise(expression(other, scope))


def _arithmetic(name: str, least: int, most: int | None, step: Callable[[Column, Column], Column]) -> Callable[[Any, Scope], Column]:
    def build(operand: Any, scope: Scope) -> Column:
        parts = [expression(x, scope) for x in _list(operand, name, least, most)]
        for part in parts:
            if type_rank(scope.dtype(part)) not in (1, 2):
                raise BadValue(f"{name} takes numbers")
        return reduce(step, parts)

    return build


def _extreme(name: str) -> Callable[[Any, Scope], Column]:
    over_args, over_array = (F.least, F.array_min) if name == "$min" else (F.greatest, F.array_max)

    def build(operand: Any, scope: Scope) -> Column:
        if isinstance(operand, list):
            parts = [expression(x, scope) for x in operand]
            return over_args(*parts) if len(parts) > 1 else parts[0] if parts else F.lit(None)
        column = expression(operand, scope)
        return over_array(column) if isinstance(scope.dtype(column), T.ArrayType) else column

    return build


def _merge(operand: Any, scope: Scope) -> Column:
    parts = [expression(x, scope) for x in (operand if isinstance(operand, list) else [operand])]
    kinds = [scope.dtype(p) for p in parts]
    return merged([(p, k) for p, k in zip(parts, kinds, strict=True) if not isinstance(k, T.NullType)])


def merged(parts: list[tuple[Column, T.DataType]]) -> Column:
    """Documents laid over each other: of each field the last one that is there."""
    fields: dict[str, list[Column]] = {}
    for column, kind in parts:
        if not isinstance(kind, T.StructType):
            raise BadValue("$mergeObjects takes documents")
        for f in kind.names:
            fields.setdefault(f, []).insert(0, column.getField(f))
    return F.struct(*[F.coalesce(*c).alias(f) for f, c in fields.items()])


def _type(operand: Any, scope: Scope) -> Column:
    if isinstance(operand, str) and operand.startswith("$") and not operand.startswith("$$") and scope.at(operand[1:]) is None:
        return F.lit("missing")
    column = expression(operand, scope)
    return F.when(column.isNull(), F.lit("null")).otherwise(F.lit(type_name(scope.dtype(column))))


def _date_trunc(operand: Any, scope: Scope) -> Column:
    if not isinstance(operand, dict) or not {"date", "unit"} <= set(operand) <= {"date", "unit", "binSize", "timezone", "startOfWeek"}:
        raise BadValue("$dateTrunc takes date, unit, binSize, timezone, startOfWeek")
    unit, size = operand["unit"], operand.get("binSize", 1)
    if not isinstance(size, int) or size < 1:
        raise BadValue("binSize is a whole number of 1 or more")
    if operand.get("timezone", "UTC") not in ("UTC", "Z", "GMT", "Etc/UTC", "+00:00"):
        raise Unsupported("only UTC")
    date = expression(operand["date"], scope)
    if scope.dtype(date).typeName() not in ("timestamp_ntz", "timestamp", "date", "void"):
        raise BadValue("$dateTrunc takes a date")
    return date_bins(date, unit, size, operand.get("startOfWeek", "sunday")).cast(scope.dtype(date) if scope.dtype(date).typeName() == "timestamp_ntz" else "timestamp")


def date_bins(date: Column, unit: str, size: int = 1, start_of_week: str = "sunday") -> Column:
    """The start of the bin of so many units that the date is in; bins are counted from 2000-01-01."""
    stamp = date.cast("timestamp")
    if unit in _MONTHS:
        width = size * _MONTHS[unit]
        months = (F.year(stamp) - 2000) * 12 + F.month(stamp) - 1
        return F.add_months(F.lit(datetime.date(2000, 1, 1)), (F.floor(months / width) * width).cast("int")).cast("timestamp")
    if unit not in _UNITS:
        raise BadValue(f"unknown unit {unit!r}")
    base = 946684800  # 2000-01-01, a Saturday
    if unit == "week":
        day = next((k for k, n in enumerate(_WEEKDAYS) if n.startswith(start_of_week.lower()[:3])), None)
        if day is None:
            raise BadValue(f"unknown day {start_of_week!r}")
        base += ((day - 6) % 7) * 86400
    width = _UNITS[unit] * size * 1_000_000
    return F.timestamp_micros((F.floor((F.unix_micros(stamp) - base * 1_000_000) / F.lit(width).cast("decimal(20,0)")) * width + base * 1_000_000).cast("long"))


_OPERATORS: dict[str, Callable[[Any, Scope], Column]] = {
    "$literal": lambda x, s: literal(x),
    "$cond": _cond,
    "$ifNull": lambda x, s: F.coalesce(*[expression(e, s) for e in _list(x, "$ifNull", 2)]),
    "$type": _type,
    **{n: _comparison(n) for n in ("$eq", "$ne", "$gt", "$gte", "$lt", "$lte", "$cmp")},
    "$and": lambda x, s: reduce(lambda a, b: a & b, [_true(e, s) for e in _list(x, "$and", 0)], F.lit(True)),
    "$or": lambda x, s: reduce(lambda a, b: a | b, [_true(e, s) for e in _list(x, "$or", 0)], F.lit(False)),
    "$not": lambda x, s: ~_true(_list(x, "$not", 1, 1)[0], s),
    "$min": _extreme("$min"),
    "$max": _extreme("$max"),
    "$add": _arithmetic("$add", 1, None, lambda a, b: a + b),
    "$subtract": _arithmetic("$subtract", 2, 2, lambda a, b: a - b),
    "$multiply": _arithmetic("$multiply", 1, None, lambda a, b: a * b),
    "$divide": _arithmetic("$divide", 2, 2, lambda a, b: a.cast("double") / b.cast("double")),
    "$mergeObjects": _merge,
    "$dateTrunc": _date_trunc,
}
