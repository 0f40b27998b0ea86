"""Joins of documents.

$lookup is a left join to an array. Where the next stage only unwinds the array, or asks that it be empty, the
compiler emits the flat, anti or semi join that this amounts to, and no array is collected. A sub-pipeline with
variables is decorrelated: its leading $match stages become the join condition, sorts and limits become windows per
outer row.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from docspark.errors import BadValue, Unsupported
from docspark.functions.accumulators import accumulator
from docspark.functions.expressions import expression
from docspark.functions.filters import matches
from docspark.functions.scope import HIDDEN, Scope, quoted
from docspark.plans.pipeline import ORDER, Flow, run, sort
from docspark.sources.tables import written

ROW, KEY = HIDDEN + "row", HIDDEN + "key"


def _spec(spec: Any) -> dict:
    if not isinstance(spec, dict) or not {"from", "as"} <= set(spec) or set(spec) - {"from", "as", "localField", "foreignField", "let", "pipeline"}:
        raise BadValue("$lookup takes from, localField, foreignField, let, pipeline and as")
    if "pipeline" not in spec and not {"localField", "foreignField"} <= set(spec):
        raise BadValue("$lookup needs localField and foreignField, or a pipeline")
    return spec


def lookup_then(flow: Flow, spec: Any, following: list[dict]) -> tuple[Flow, int]:
    """The flow after $lookup and as many of the following stages as it could take in, and their number."""
    spec = _spec(spec)
    name, simple = spec["as"], "pipeline" not in spec and not _has_array(flow, spec)
    nxt = following[0] if following else {}
    if simple and "$unwind" in nxt:
        how = {"path": nxt["$unwind"]} if isinstance(nxt["$unwind"], str) else nxt["$unwind"]
        if how["path"] == "$" + name and not how.get("includeArrayIndex"):
            return _flat(flow, spec, "left" if how.get("preserveNullAndEmptyArrays") else "inner"), 1
    if simple and isinstance(nxt.get("$match"), dict) and set(nxt["$match"]) == {name}:
        asked = nxt["$match"][name]
        if asked in ([], {"$size": 0}, {"$eq": []}):
            kept = _filtered(flow, spec, "left_anti")
            empty = F.array().cast(T.ArrayType(_row_type(flow.collections[spec["from"]])))
            return kept.to(kept.df.withColumn(name, empty)), 1
        if asked == {"$ne": []} and len(following) > 1 and following[1] == {"$unset": name}:
            return _filtered(flow, spec, "left_semi"), 2
    return lookup(flow, spec), 0


def _row_type(df: DataFrame) -> T.StructType:
    return T.StructType([f for f in df.schema.fields if not f.name.startswith(HIDDEN)])


def _has_array(flow: Flow, spec: dict) -> bool:
    sides = (flow.scope.at(spec["localField"]), Scope(flow.collections[spec["from"]]).at(spec["foreignField"]))
    return any(s is None or isinstance(s[1], T.ArrayType) for s in sides)


def _foreign(flow: Flow, spec: dict) -> DataFrame:
    """Rows of the other collection as one document column, with their key and arrival order."""
    df = flow.collections[spec["from"]]
    found = Scope(df).at(spec["foreignField"])
    key = found[0] if found else F.lit(None)
    if found and isinstance(found[1], T.ArrayType):
        key = F.explode(F.array_distinct(F.when(F.size(key) > 0, key).otherwise(F.array(F.lit(None).cast(found[1].elementType)))))
    order = F.col(ORDER) if ORDER in df.columns else F.lit(0)
    return df.select(key.alias(KEY), F.struct(*[F.col(quoted(c)) for c in _row_type(df).names]).alias(spec["as"]), order.alias(HIDDEN + "o"))


def _local(flow: Flow, spec: dict) -> Column:
    found = flow.scope.at(spec["localField"])
    return found[0] if found else F.lit(None)


def _flat(flow: Flow, spec: dict, how: str) -> Flow:
    other = _foreign(flow, spec)
    df = flow.df.drop(spec["as"]).join(other, _local(flow, spec).eqNullSafe(other[KEY]), how)
    if ORDER in df.columns:
        df = df.withColumn(ORDER, F.struct(F.col(ORDER).alias("o"), F.col(HIDDEN + "o").alias("p")))
    return flow.to(df.drop(KEY, HIDDEN + "o"))


def _filtered(flow: Flow, spec: dict, how: str) -> Flow:
    other = _foreign(flow, spec).select(KEY)
    return flow.to(flow.df.join(other, _local(flow, spec).eqNullSafe(other[KEY]), how))


def _listed(value: str, order: str) -> Column:
    return F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(quoted(value)).alias("v")))), lambda x: x["v"])


def lookup(flow: Flow, spec: Any) -> Flow:
    spec = _spec(spec)
    if "pipeline" in spec:
        return _correlated(flow, spec)
    name, other = spec["as"], _foreign(flow, spec)
    empty = F.array().cast(T.ArrayType(other.schema[name].dataType))
    found = flow.scope.at(spec["localField"])
    if not (found and isinstance(found[1], T.ArrayType)):
        lists = other.groupBy(KEY).agg(_listed(name, HIDDEN + "o").alias(name))
        df = flow.df.drop(name).join(lists, _local(flow, spec).eqNullSafe(lists[KEY]), "left").drop(KEY)
        return flow.to(df.withColumn(name, F.coalesce(quoted(name), empty)))
    # rows with the same array share a list, so the array itself is the key: a retried task can't number rows anew
    left = flow.df.drop(name).withColumn(ROW, found[0])
    keys = left.select(ROW).distinct().select(ROW, F.explode(F.array_distinct(ROW)).alias(KEY + "l"))
    hits = keys.join(other, F.col(KEY + "l").eqNullSafe(F.col(KEY))).dropDuplicates([ROW, name])
    lists = hits.groupBy(ROW).agg(_listed(name, HIDDEN + "o").alias(name)).withColumnRenamed(ROW, ROW + "l")
    df = left.join(lists, F.col(ROW).eqNullSafe(F.col(ROW + "l")), "left").drop(ROW, ROW + "l")
    return flow.to(df.withColumn(name, F.coalesce(quoted(name), empty)))


def _correlated(flow: Flow, spec: dict) -> Flow:
    name, pipeline = spec["as"], list(spec["pipeline"])
    scope = Scope(flow.df.drop(name), flow.variables)
    bound = {HIDDEN + "v_" + v: expression(e, scope) for v, e in spec.get("let", {}).items()}
    if "localField" in spec:
        bound[KEY + "l"] = expression("$" + spec["localField"], scope)
    # rows with the same bound values share a list, so these are the key: a retried task can't number rows anew
    row = F.struct(*[c.alias(v) for v, c in bound.items()]) if bound else F.struct(F.lit(0).alias("none"))
    left = flow.df.drop(name).withColumn(ROW, row)
    outer = left.select(ROW).distinct().select(ROW, *[F.col(ROW).getField(v).alias(v) for v in bound])
    other = flow.collections[spec["from"]]
    variables = {v: F.col(HIDDEN + "v_" + v) for v in spec.get("let", {})}
    both = Scope(outer.crossJoin(other), variables)  # for the types of the condition alone; it is never run
    condition = F.lit(True)
    if "localField" in spec:
        condition = F.col(KEY + "l").eqNullSafe(expression("$" + spec["foreignField"], Scope(other)))
    while pipeline and set(pipeline[0]) == {"$match"}:
        condition = condition & _condition(pipeline.pop(0)["$match"], both)
    inner = Flow(outer.join(other, condition), flow.collections, variables)
    for stage in pipeline:
        inner = _per_row(inner, stage)
    rows = inner.df.select(ROW, F.struct(*[F.col(quoted(c)) for c in inner.shown()]).alias(name), (inner.order if inner.order is not None else F.lit(0)).alias(HIDDEN + "o"))
    lists = rows.groupBy(ROW).agg(_listed(name, HIDDEN + "o").alias(name))
    empty = F.array().cast(lists.schema[name].dataType)
    lists = lists.withColumnRenamed(ROW, ROW + "l")
    df = left.join(lists, F.col(ROW).eqNullSafe(F.col(ROW + "l")), "left").drop(ROW, ROW + "l")
    return flow.to(df.withColumn(name, F.coalesce(quoted(name), empty)))


def _condition(filter_: dict, scope: Scope) -> Column:
    """A filter as a join condition: equalities of $expr are emitted bare, so that they become join keys."""
    whole = None
    for key, value in filter_.items():
        parts = [matches({key: value}, scope)]
        if key == "$expr" and isinstance(value, dict) and set(value) == {"$and"}:
            parts = [_condition({"$expr": v}, scope) for v in value["$and"]]
        elif key == "$and":
            parts = [_condition(v, scope) for v in value]
        elif key == "$expr" and isinstance(value, dict) and set(value) == {"$eq"}:
            a, b = (expression(x, scope) for x in value["$eq"])
            parts = [a.eqNullSafe(b)]
        for part in parts:
            whole = part if whole is None else whole & part
    return F.lit(True) if whole is None else whole


def _per_row(inner: Flow, stage: dict) -> Flow:
    name, spec = next(iter(stage.items()))
    if name in ("$match", "$project", "$addFields", "$set", "$unset", "$unwind", "$replaceRoot", "$replaceWith"):
        return run(inner, [stage])
    if name == "$sort":
        return inner.to(sort(inner, spec).df)
    if name in ("$limit", "$skip"):
        place = F.row_number().over(Window.partitionBy(ROW).orderBy(inner.order if inner.order is not None else F.lit(1)))
        df = inner.df.withColumn(HIDDEN + "n", place)
        return inner.to(df.filter(F.col(HIDDEN + "n") <= spec if name == "$limit" else F.col(HIDDEN + "n") > spec).drop(HIDDEN + "n"))
    if name == "$group":
        made = [accumulator(v, inner.scope, inner.order).alias(k) for k, v in spec.items() if k != "_id"]
        return inner.to(inner.df.groupBy(ROW, expression(spec["_id"], inner.scope).alias("_id")).agg(*made or [F.count("*").alias(HIDDEN + "n")]))
    if name == "$count":
        return inner.to(inner.df.groupBy(ROW).agg(F.count("*").alias(spec)))
    if name == "$sortByCount":
        counted = inner.df.groupBy(ROW, expression(spec, inner.scope).alias("_id")).agg(F.count("*").alias("count"))
        return inner.to(sort(inner.to(counted), {"count": -1, "_id": 1}).df)
    if name == "$lookup":
        # ROW is a hidden column of the rows, so an inner lookup keeps it; its own key takes another place
        own = inner.df.withColumnRenamed(ROW, ROW + "outer")
        done = lookup(inner.to(own), spec)
        return done.to(done.df.withColumnRenamed(ROW + "outer", ROW))
    raise Unsupported(f"{name} in a $lookup pipeline")


def graph_lookup(flow: Flow, spec: Any) -> Flow:
    """Breadth first from startWith: each round joins the frontier with the collection and drops what was met before.

    The rounds are joins over all outer rows at once. Every round's rows are a written table, so the plan doesn't grow.
    """
    needed, known = {"from", "startWith", "connectFromField", "connectToField", "as"}, {"maxDepth"}
    if not isinstance(spec, dict) or not needed <= set(spec) or set(spec) - needed - known:
        raise BadValue("$graphLookup takes from, startWith, connectFromField, connectToField, as and maxDepth")
    most, name = spec.get("maxDepth"), spec["as"]
    if most is not None and (not isinstance(most, int) or most < 0):
        raise BadValue("maxDepth is a whole number of 0 or more")
    other = flow.collections[spec["from"]]
    names = _row_type(other).names
    to, come = Scope(other).at(spec["connectToField"]), Scope(other).at(spec["connectFromField"])
    if to is None:
        raise BadValue("connectToField isn't there")
    fan = lambda column, kind: F.explode(column) if isinstance(kind, T.ArrayType) else column
    nodes = other.select(fan(*to).alias("to"), (come[0] if come else F.lit(None)).alias("come"), F.struct(*[F.col(quoted(c)) for c in names]).alias("node"))
    nodes = nodes.withColumn("id", F.xxhash64("node"))
    left = flow.df.drop(name).withColumn(ROW, F.monotonically_increasing_id())
    left = written(left, "graphleft")
    start = expression(spec["startWith"], Scope(left, flow.variables))
    frontier = left.select(ROW, fan(start, Scope(left).dtype(start)).alias("value")).where("value IS NOT NULL")
    met, depth = None, 0
    while most is None or depth <= most:
        hits = frontier.join(nodes, F.col("value") == F.col("to")).select(ROW, "id", "come", "node").dropDuplicates([ROW, "id"])
        if met is not None:
            hits = hits.join(met.select(ROW, "id"), [ROW, "id"], "left_anti")
        hits = written(hits.withColumn("depth", F.lit(depth)), "graphround")
        if not hits.take(1):
            break
        met = hits if met is None else met.union(hits)
        frontier = hits.select(ROW, fan(F.col("come"), hits.schema["come"].dataType).alias("value")).where("value IS NOT NULL").distinct()
        depth += 1
    empty = F.array().cast(T.ArrayType(_row_type(other)))
    if met is None:
        return flow.to(left.drop(ROW).withColumn(name, empty))
    lists = met.groupBy(ROW).agg(F.transform(F.sort_array(F.collect_list(F.struct("depth", "id", "node"))), lambda x: x["node"]).alias(name))
    return flow.to(left.join(lists, ROW, "left").drop(ROW).withColumn(name, F.coalesce(quoted(name), empty)))


