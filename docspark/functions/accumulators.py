"""Group accumulators to aggregate Columns.

Those that depend on arrival order work on the order keys of the pipeline (see plans.pipeline.Order): $first and $last
are a min_by and max_by, lists are sorted after they are collected, so a shuffle can't change a result.

Those that keep n values of a group ($firstN, $lastN, $minN, $maxN, $topN, $bottomN) are Bounded: the rows of a group are
ranked and cut to n before they are collected (Spark cuts each partition's groups ahead of the shuffle), and
$addToSet is reduced to a group's distinct values first.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.errors import BadValue, Unsupported
from docspark.functions.expressions import expression, merged
from docspark.functions.scope import Scope, type_rank


@dataclass
class Bounded:
    """Of a group's rows, at most n in the order of `key` (None: distinct values, each by its first arrival) give `value`."""

    value: Column
    key: Column | None
    n: int
    from_top: bool = True
    turned: bool = False
    nulls: bool = True


def bounded(spec: Any, scope: Scope, order: Column | None) -> Bounded | None:
    """What a bounded accumulator keeps; None for the others."""
    if not isinstance(spec, dict) or len(spec) != 1:
        return None
    name, operand = next(iter(spec.items()))
    if name in ("$minN", "$maxN"):
        n, value = _n(operand, {"input", "n"}), expression(operand["input"], scope)
        return Bounded(value, value, n, name == "$minN", nulls=False)
    if name not in ("$firstN", "$lastN", "$topN", "$bottomN", "$addToSet"):
        return None
    if order is None:
        raise BadValue(f"{name} depends on arrival order: name it with order_by, or sort first")
    if name == "$addToSet":
        return Bounded(expression(operand, scope), None, 0)
    if name in ("$firstN", "$lastN"):
        return Bounded(expression(operand["input"], scope), order, _n(operand, {"input", "n"}), name == "$firstN", name == "$lastN")
    n = _n(operand, {"output", "sortBy", "n"})
    return Bounded(expression(operand["output"], scope), sort_key(operand["sortBy"], scope, order), n, name == "$topN", name == "$bottomN")


def accumulator(spec: Any, scope: Scope, order: Column | None) -> Column:
    """The aggregate of {$name: operand}; order is the arrival key of a row."""
    if not isinstance(spec, dict) or len(spec) != 1:
        raise BadValue("an accumulator is a document of one operator")
    name, operand = next(iter(spec.items()))
    if name in _ORDERED:
        if order is None:
            raise BadValue(f"{name} depends on arrival order: name it with order_by, or sort first")
        return _ORDERED[name](operand, scope, order)
    if name not in _PLAIN:
        raise Unsupported(f"unsupported accumulator {name}")
    return _PLAIN[name](operand, scope)


def _numbers(operand: Any, scope: Scope) -> Column:
    column = expression(operand, scope)
    return column if type_rank(scope.dtype(column)) == 2 else F.lit(None).cast("double")


def _sum(operand: Any, scope: Scope) -> Column:
    if operand == 1 and not isinstance(operand, bool):
        return F.count(F.lit(1))
    column = _numbers(operand, scope)
    return F.coalesce(F.sum(column), F.lit(0))


def _percentile(operand: Any, scope: Scope) -> Column:
    if not isinstance(operand, dict) or set(operand) != {"input", "p", "method"}:
        raise BadValue("$percentile takes input, p and method")
    column = _finite(operand["input"], scope)
    return F.percentile(column, F.array(*[F.lit(float(p)) for p in operand["p"]]))


def _median(operand: Any, scope: Scope) -> Column:
    if not isinstance(operand, dict) or set(operand) != {"input", "method"}:
        raise BadValue("$median takes input and method")
    return F.median(_finite(operand["input"], scope))


def _finite(operand: Any, scope: Scope) -> Column:
    column = _numbers(operand, scope).cast("double")
    return F.when(~F.isnan(column) & (F.abs(column) != float("inf")), column)


def _n(operand: Any, fields: set[str]) -> int:
    if not isinstance(operand, dict) or set(operand) != fields:
        raise BadValue(f"takes {', '.join(sorted(fields))}")
    n = operand["n"]
    if not isinstance(n, int) or isinstance(n, bool) or n < 1:
        raise BadValue("n is a whole number of 1 or more")
    return n


def _extremes(ascending: bool) -> Callable[[Any, Scope], Column]:
    def build(operand: Any, scope: Scope) -> Column:
        n = _n(operand, {"input", "n"})
        return F.slice(F.sort_array(F.collect_list(expression(operand["input"], scope)), ascending), 1, n)

    return build


def _listed(value: Column, order: Column) -> Column:
    """All values in arrival order, NULLs among them."""
    return F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda x: x["v"])


def _first(operand: Any, scope: Scope, order: Column) -> Column:
    # the value in a struct, since min_by passes over no NULL that way
    return F.min_by(F.struct(expression(operand, scope).alias("v")), order)["v"]


def _last(operand: Any, scope: Scope, order: Column) -> Column:
    return F.max_by(F.struct(expression(operand, scope).alias("v")), order)["v"]


def _first_n(operand: Any, scope: Scope, order: Column) -> Column:
    n = _n(operand, {"input", "n"})
    return F.slice(_listed(expression(operand["input"], scope), order), 1, n)


def _last_n(operand: Any, scope: Scope, order: Column) -> Column:
    n = _n(operand, {"input", "n"})
    return F.reverse(F.slice(F.reverse(_listed(expression(operand["input"], scope), order)), 1, n))


def _merge_objects(operand: Any, scope: Scope, order: Column) -> Column:
    column = expression(operand, scope)
    kind = scope.dtype(column)
    if not isinstance(kind, T.StructType):
        raise BadValue("$mergeObjects takes documents")
    last = [(f, F.max_by(column.getField(f), F.when(column.getField(f).isNotNull(), order))) for f in kind.names]
    return F.struct(*[c.alias(f) for f, c in last])


def _top(bottom: bool) -> Callable[[Any, Scope, Column], Column]:
    def build(operand: Any, scope: Scope, order: Column) -> Column:
        n = _n(operand, {"output", "sortBy", "n"})
        key = sort_key(operand["sortBy"], scope, order)
        listed = _listed(expression(operand["output"], scope), key)
        return F.reverse(F.slice(F.reverse(listed), 1, n)) if bottom else F.slice(listed, 1, n)

    return build


def sort_key(spec: dict, scope: Scope, order: Column | None) -> Column:
    """A struct whose natural order is that of a sort document, ties by arrival."""
    if not isinstance(spec, dict) or not spec or any(d not in (1, -1) for d in spec.values()):
        raise BadValue("a sort document has 1 or -1 for each path")
    parts = []
    for k, (path, way) in enumerate(spec.items()):
        column = expression("$" + path, scope)
        if way == 1:
            parts.append(column.alias(f"k{k}"))
            continue
        kind = scope.dtype(column)
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            column = F.unix_micros(column.cast("timestamp"))
        elif isinstance(kind, T.BooleanType):
            column = column.cast("int")
        elif isinstance(kind, T.StringType):
            # each code point from the top down; a longer string comes before its own beginning
            column = F.transform(F.split(column, ""), lambda c: -F.when(c == "", 0).otherwise(F.ascii(c)))
            parts += [F.coalesce(F.isnull(column), F.lit(True)).alias(f"n{k}"), F.concat(column, F.array(F.lit(1))).alias(f"k{k}")]
            continue
        elif type_rank(kind) not in (1, 2):
            raise Unsupported(f"descending by {path}")
        parts += [F.isnull(column).alias(f"n{k}"), (-column).alias(f"k{k}")]
    return F.struct(*parts, *([order.alias("o")] if order is not None else []))


_PLAIN: dict[str, Callable[[Any, Scope], Column]] = {
    "$sum": _sum,
    "$avg": lambda x, s: F.avg(_numbers(x, s)),
    "$min": lambda x, s: F.min(expression(x, s)),
    "$max": lambda x, s: F.max(expression(x, s)),
    "$percentile": _percentile,
    "$median": _median,
    "$minN": _extremes(True),
    "$maxN": _extremes(False),
}
_ORDERED: dict[str, Callable[[Any, Scope, Column], Column]] = {
    "$first": _first,
    "$last": _last,
    "$push": lambda x, s, o: _listed(expression(x, s), o),
    "$addToSet": lambda x, s, o: F.array_distinct(_listed(expression(x, s), o)),
    "$firstN": _first_n,
    "$lastN": _last_n,
    "$mergeObjects": _merge_objects,
    "$topN": _top(False),
    "$bottomN": _top(True),
}
