"""Aggregation pipelines to one lazy DataFrame.

Every stage maps a Flow (a DataFrame and the arrival order of its rows) to the next one; Catalyst sees the whole plan.
Arrival order matters to $first, $push, ties and the like. It is a hidden column: order_by names the columns it comes
from, and $sort replaces it. Rows without it have no order, and what depends on one is refused.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from docspark.errors import BadValue, Unsupported
from docspark.functions.accumulators import Bounded, accumulator, bounded, sort_key
from docspark.functions.expressions import expression
from docspark.functions.filters import matches
from docspark.functions.scope import HIDDEN, Scope, quoted, split_path, with_path, without_path

ORDER, GROUP = HIDDEN + "order", HIDDEN + "group"
Collections = Mapping[str, DataFrame]


@dataclass
class Flow:
    df: DataFrame
    collections: Collections
    variables: dict[str, Column]

    @property
    def scope(self) -> Scope:
        return Scope(self.df, self.variables)

    @property
    def order(self) -> Column | None:
        return F.col(ORDER) if ORDER in self.df.columns else None

    def hidden(self) -> list[Column]:
        return [F.col(quoted(c)) for c in self.df.columns if c.startswith(HIDDEN)]

    def shown(self) -> list[str]:
        return [c for c in self.df.columns if not c.startswith(HIDDEN)]

    def to(self, df: DataFrame) -> Flow:
        return Flow(df, self.collections, self.variables)


def aggregate(df: DataFrame, pipeline: list[dict], collections: Collections | None = None, order_by: list[str] | None = None, variables: dict[str, Column] | None = None) -> DataFrame:
    """The result of a pipeline; collections are the other DataFrames that its stages may name, variables what $$name is."""
    if order_by:
        df = df.withColumn(ORDER, F.struct(*[F.col(c) for c in order_by]))
    return shown(run(Flow(df, {} if collections is None else collections, variables or {}), pipeline).df)


def shown(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(HIDDEN)])


def run(flow: Flow, pipeline: list[dict]) -> Flow:
    if not isinstance(pipeline, list):
        raise BadValue("a pipeline is a list")
    k = 0
    while k < len(pipeline):
        stage = pipeline[k]
        if not isinstance(stage, dict) or len(stage) != 1:
            raise BadValue("a stage is a document of one operator")
        name, spec = next(iter(stage.items()))
        if name not in STAGES:
            raise Unsupported(f"unsupported stage {name}")
        if name == "$lookup":
            from docspark.operators.lookup import lookup_then

            flow, used = lookup_then(flow, spec, pipeline[k + 1 : k + 3])
            k += 1 + used
            continue
        flow = STAGES[name](flow, spec)
        k += 1
    return flow


def _document(spec: Any, name: str) -> dict:
    if not isinstance(spec, dict):
        raise BadValue(f"{name} takes a document")
    return spec


def match(flow: Flow, spec: Any) -> Flow:
    return flow.to(flow.df.filter(matches(_document(spec, "$match"), flow.scope)))


def set_paths(flow: Flow, values: dict[str, Column]) -> Flow:
    """Columns with values set at paths; all values were made of the columns as they are."""
    roots: dict[str, list[tuple[list[str], Column]]] = {}
    for path, value in values.items():
        first, *rest = split_path(path)
        roots.setdefault(first, []).append((rest, value))
    new = {}
    for name, parts in roots.items():
        column = F.col(quoted(name)) if name in flow.df.columns else None
        kind = flow.df.schema[name].dataType if name in flow.df.columns else None
        for rest, value in parts:
            column = with_path(column, kind, rest, value)
            kind = flow.scope.dtype(column)
        new[name] = column
    return flow.to(flow.df.withColumns(new))


def add_fields(flow: Flow, spec: Any) -> Flow:
    scope = flow.scope
    return set_paths(flow, {p: expression(v, scope) for p, v in _document(spec, "$addFields").items()})


def unset(flow: Flow, spec: Any) -> Flow:
    paths = [spec] if isinstance(spec, str) else list(spec)
    df = flow.df
    for path in paths:
        first, *rest = split_path(path)
        if first not in df.columns:
            continue
        kept = without_path(F.col(quoted(first)), df.schema[first].dataType, rest) if rest else None
        df = df.drop(first) if kept is None else df.withColumn(first, kept)
    return flow.to(df)


def project(flow: Flow, spec: Any) -> Flow:
    """Fields to keep or to leave out, and computed ones; dotted paths give nested documents; _id stays unless it is 0."""
    spec = _document(spec, "$project")
    if not spec:
        raise BadValue("$project is not empty")
    flags = {p: bool(v) for p, v in spec.items() if isinstance(v, (bool, int, float)) and v in (0, 1)}
    computed = {p: v for p, v in spec.items() if p not in flags}
    if "_id" in computed:
        raise BadValue("_id can't be computed")
    if any(isinstance(v, (int, float)) for v in computed.values()):
        raise BadValue("a flag is 0 or 1")
    own = {p: f for p, f in flags.items() if p != "_id"}
    if own and not all(own.values()) and (any(own.values()) or computed):
        raise BadValue("$project keeps or leaves out")
    if not computed and not any(own.values()) and (own or not flags["_id"]):
        return unset(flow, [p for p, f in flags.items() if not f])
    scope, tree = flow.scope, {}
    wanted = ["_id"] if flags.get("_id", True) and "_id" in flow.df.columns else []
    for path in [*wanted, *[p for p in spec if p != "_id"]]:
        at = tree
        *parents, last = split_path(path)
        for part in parents:
            at = at.setdefault(part, {})
        if path in computed:
            at[last] = expression(computed[path], scope)
        elif (found := scope.at(path)) is not None:
            at[last] = found[0]
    build = lambda node: F.struct(*[(build(v) if isinstance(v, dict) else v).alias(k) for k, v in node.items()])
    columns = [(build(v) if isinstance(v, dict) else v).alias(k) for k, v in tree.items() if not (isinstance(v, dict) and not v)]
    return flow.to(flow.df.select(*columns, *flow.hidden()))


def replace_root(flow: Flow, spec: Any) -> Flow:
    value = spec["newRoot"] if isinstance(spec, dict) and set(spec) == {"newRoot"} else spec
    return replace_with(flow, value)


def replace_with(flow: Flow, value: Any) -> Flow:
    column = expression(value, flow.scope)
    kind = flow.scope.dtype(column)
    if not isinstance(kind, T.StructType):
        raise BadValue("the new root is a document")
    root = F.when(column.isNull(), F.raise_error(F.lit("the new root is a document"))).otherwise(column)
    return flow.to(flow.df.select(*[root.getField(f).alias(f) for f in kind.names], *flow.hidden()))


def group(flow: Flow, spec: Any) -> Flow:
    spec = _document(spec, "$group")
    if "_id" not in spec:
        raise BadValue("$group takes _id")
    scope, order = flow.scope, flow.order
    key = expression(spec["_id"], scope)
    kept = {k: b for k, v in spec.items() if k != "_id" and (b := bounded(v, scope, order)) is not None}
    made = [accumulator(v, scope, order).alias(k) for k, v in spec.items() if k != "_id" and k not in kept]
    if order is not None:
        made.append(F.min(order).alias(ORDER))
    if made:
        out = flow.df.groupBy(key.alias("_id")).agg(*made)
    else:
        out = flow.df.select(key.alias("_id")).distinct()
    for name, what in kept.items():
        lists = _kept(flow.df.select(key.alias(GROUP), what.value.alias("v"), (what.key if what.key is not None else order).alias("o")), what).withColumnRenamed("v", name)
        out = out.join(lists, out["_id"].eqNullSafe(lists[GROUP]), "left").drop(GROUP)
        out = out.withColumn(name, F.coalesce(quoted(name), F.array().cast(lists.schema[name].dataType)))
    return flow.to(out.select("_id", *[F.col(quoted(k)) for k in spec if k != "_id"], *([ORDER] if order is not None else [])))


def _kept(rows: DataFrame, what: Bounded) -> DataFrame:
    """GROUP and v: the list that a bounded accumulator gives, from rows of GROUP, v (value) and o (key)."""
    if what.key is None:
        rows = rows.groupBy(GROUP, "v").agg(F.min("o").alias("o"))
    else:
        rows = rows if what.nulls else rows.filter(F.col("v").isNotNull())
        within = Window.partitionBy(GROUP).orderBy(F.col("o").asc() if what.from_top else F.col("o").desc())
        rows = rows.withColumn(GROUP + "n", F.row_number().over(within)).filter(F.col(GROUP + "n") <= what.n)
    listed = F.sort_array(F.collect_list(F.struct("o", "v")), asc=what.from_top or what.turned)
    return rows.groupBy(GROUP).agg(F.transform(listed, lambda x: x["v"]).alias("v"))


def sort_by_count(flow: Flow, spec: Any) -> Flow:
    counted = flow.df.groupBy(expression(spec, flow.scope).alias("_id")).agg(F.count(F.lit(1)).alias("count"))
    return sort(flow.to(counted), {"count": -1, "_id": 1})


def count(flow: Flow, spec: Any) -> Flow:
    if not isinstance(spec, str) or not spec or spec.startswith("$") or "." in spec:
        raise BadValue("$count takes a field name")
    return flow.to(flow.df.agg(F.count(F.lit(1)).alias(spec)).filter(F.col(quoted(spec)) > 0))


def sort_columns(flow: Flow, spec: dict) -> list[Column]:
    scope = flow.scope
    columns = []
    for path, way in _document(spec, "$sort").items():
        if way not in (1, -1):
            raise BadValue("a sort has 1 or -1 for each path")
        column = expression("$" + path, scope)
        columns.append(column.asc_nulls_first() if way == 1 else column.desc_nulls_last())
    return [*columns, *([flow.order.asc()] if flow.order is not None else [])]


def sort(flow: Flow, spec: Any) -> Flow:
    columns = sort_columns(flow, spec)
    key = sort_key(spec, flow.scope, flow.order)
    return flow.to(flow.df.orderBy(*columns).withColumn(ORDER, key))


def _whole(spec: Any, name: str) -> int:
    if not isinstance(spec, int) or isinstance(spec, bool) or spec < 0:
        raise BadValue(f"{name} takes a whole number of 0 or more")
    return spec


def unwind(flow: Flow, spec: Any) -> Flow:
    """One row for each element; what is no array passes through, with a null index."""
    if isinstance(spec, str):
        spec = {"path": spec}
    path, keep, index = spec["path"], spec.get("preserveNullAndEmptyArrays", False), spec.get("includeArrayIndex")
    if not path.startswith("$"):
        raise BadValue("$unwind takes a path")
    parts = split_path(path[1:])
    found = flow.scope.at(path[1:])
    null = F.lit(None).cast("long")
    if found is None:
        out = flow.df if keep else flow.df.filter(F.lit(False))
        return flow.to(out.withColumn(index, null) if index else out)
    column, kind = found
    if not isinstance(kind, T.ArrayType):
        out = flow.df if keep else flow.df.filter(column.isNotNull())
        return flow.to(out.withColumn(index, null) if index else out)
    pos, item = HIDDEN + "pos", HIDDEN + "item"
    out = flow.to(flow.df.select("*", (F.posexplode_outer if keep else F.posexplode)(column).alias(pos, item)))
    out = set_paths(out, {".".join(parts): F.col(item)})
    df = out.df
    if ORDER in df.columns:
        df = df.withColumn(ORDER, F.struct(F.col(ORDER).alias("o"), F.col(pos).alias("p")))
    if index:
        df = df.withColumn(index, F.col(pos).cast("long"))
    return flow.to(df.drop(pos, item))


def union_with(flow: Flow, spec: Any) -> Flow:
    if isinstance(spec, str):
        spec = {"coll": spec}
    if set(spec) - {"coll", "pipeline"}:
        raise BadValue("$unionWith takes coll and pipeline")
    other = run(Flow(flow.collections[spec["coll"]], flow.collections, {}), spec.get("pipeline", []))
    return flow.to(shown(flow.df).unionByName(shown(other.df), allowMissingColumns=True))


def facet(flow: Flow, spec: Any) -> Flow:
    """One document with the result of each pipeline as an array, in arrival order where there is one."""
    rows = []
    for name, pipeline in _document(spec, "$facet").items():
        out = run(flow, pipeline)
        row = F.struct(*[F.col(quoted(c)) for c in out.shown()])
        listed = F.transform(F.sort_array(F.collect_list(F.struct(out.order.alias("o"), row.alias("v")))), lambda x: x["v"]) if out.order is not None else F.collect_list(row)
        rows.append(out.df.agg(listed.alias(name)))
    # each has one row
    return flow.to(reduce(lambda a, b: a.crossJoin(b), rows))


def set_window_fields(flow: Flow, spec: Any) -> Flow:
    spec = _document(spec, "$setWindowFields")
    if set(spec) - {"partitionBy", "sortBy", "output"} or "output" not in spec:
        raise BadValue("$setWindowFields takes partitionBy, sortBy and output")
    scope = flow.scope
    window = Window.partitionBy(expression(spec.get("partitionBy"), scope))
    sorting = spec.get("sortBy")
    rows = window.orderBy(*(sort_columns(flow, sorting) if sorting else [flow.order] if flow.order is not None else [F.lit(1)]))
    peers = window.orderBy(*sort_columns(Flow(shown(flow.df), {}, flow.variables), sorting)) if sorting else None
    made: dict[str, Column] = {}
    for path, definition in spec["output"].items():
        if not isinstance(definition, dict) or len(definition) != 1:
            raise BadValue("an output is a document of one operator")
        name, operand = next(iter(definition.items()))
        if name in ("$documentNumber", "$rank", "$denseRank"):
            if operand != {} or not sorting:
                raise BadValue(f"{name} takes {{}} and needs sortBy")
            made[path] = {"$documentNumber": lambda: F.row_number().over(rows), "$rank": lambda: F.rank().over(peers), "$denseRank": lambda: F.dense_rank().over(peers)}[name]().cast("long")
        elif name == "$shift":
            if not isinstance(operand, dict) or not {"output", "by"} <= set(operand) <= {"output", "by", "default"} or not sorting:
                raise BadValue("$shift takes output, by and default, and needs sortBy")
            made[path] = F.lead(expression(operand["output"], scope), operand["by"], operand.get("default")).over(rows)
        else:
            raise Unsupported(f"unsupported window operator {name}")
    return set_paths(flow, made)


def _join(name: str):
    def stage(flow: Flow, spec: Any) -> Flow:
        from docspark.operators import lookup

        return getattr(lookup, name)(flow, spec)

    return stage


STAGES = {
    "$match": match,
    "$project": project,
    "$addFields": add_fields,
    "$set": add_fields,
    "$unset": unset,
    "$replaceRoot": replace_root,
    "$replaceWith": replace_with,
    "$group": group,
    "$sortByCount": sort_by_count,
    "$count": count,
    "$sort": sort,
    "$limit": lambda flow, n: flow.to(flow.df.limit(_whole(n, "$limit"))),
    "$skip": lambda flow, n: flow.to(flow.df.offset(_whole(n, "$skip"))),
    "$unwind": unwind,
    "$lookup": _join("lookup"),
    "$graphLookup": _join("graph_lookup"),
    "$unionWith": union_with,
    "$facet": facet,
    "$setWindowFields": set_window_fields,
}

