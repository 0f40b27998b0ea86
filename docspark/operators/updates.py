"""Updates, deletes, upserts and write stages: a new version of a collection from the old one.

Nothing is changed in place: each function returns the DataFrame of the next version. The operators of one update
apply in a fixed order: $set, $setOnInsert, $inc, $min and $max, $unset, $addToSet.
"""

from __future__ import annotations

import re
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from docspark.errors import BadValue, DuplicateKey, ImmutableField, Unsupported
from docspark.functions.expressions import literal
from docspark.functions.filters import field_test, is_operators, matches
from docspark.functions.scope import HIDDEN, Scope, descend, quoted, split_path, with_path, without_path
from docspark.plans.pipeline import Flow, run, set_paths
from docspark.sources.tables import written

_ORDER = ["$set", "$setOnInsert", "$inc", "$min", "$max", "$unset", "$addToSet"]
_STAGES = {"$addFields", "$set", "$project", "$unset", "$replaceRoot", "$replaceWith"}
HIT = HIDDEN + "hit"


def check_update(update: Any) -> None:
    """Raises for operators, paths and combinations that no update may have."""
    if isinstance(update, list):
        if not update or any(set(s) - _STAGES or len(s) != 1 for s in update):
            raise Unsupported("a pipeline update takes $addFields, $set, $project, $unset, $replaceRoot and $replaceWith")
        return
    if not is_operators(update):
        if any(k.startswith("$") for k in update):
            raise BadValue("a replacement has no operators")
        return
    if unknown := set(update) - set(_ORDER):
        raise Unsupported(f"unsupported update operators {sorted(unknown)}")
    paths = [p for op in update.values() for p in op]
    for k, a in enumerate(paths):
        if a == "_id" or a.startswith("_id."):
            raise ImmutableField("_id can't change")
        if "$" in re.sub(r"\$\[\w+\]", "", a):
            raise Unsupported(f"positional path {a}")
        if any(a == b or a.startswith(b + ".") or b.startswith(a + ".") for b in paths[k + 1 :]):
            raise BadValue(f"paths meet at {a}")


def update(df: DataFrame, filter_: dict, change: Any, array_filters: list[dict] | None = None, one_by: list[str] | None = None) -> DataFrame:
    """The rows of df, those that match changed; with one_by, only the first match in the order of these columns."""
    check_update(change)
    hit = _first_hit(df, filter_, one_by) if one_by else df.withColumn(HIT, matches(filter_, Scope(df)))
    changed = _changed(hit, change, array_filters or [])
    kept = [c for c in df.columns if not c.startswith(HIDDEN)]
    columns = []
    for name in [*kept, *[c for c in changed.columns if c not in df.columns and not c.startswith(HIDDEN)]]:
        columns.append(F.col(quoted(name)) if name in changed.columns else F.lit(None).cast(df.schema[name].dataType).alias(name))
    return changed.select(*columns)


def _first_hit(df: DataFrame, filter_: dict, one_by: list[str]) -> DataFrame:
    """HIT marks the first match in the order of these columns; of matches that are equal in them, one."""
    key = F.struct(*[F.col(quoted(c)) for c in one_by])
    matching = matches(filter_, Scope(df))
    first = df.filter(matching).agg(F.min(key).alias(HIDDEN + "first"))
    # one row, so the join is a broadcast of a bound size
    marked = df.withColumn(HIT, matching).join(F.broadcast(first), F.lit(True), "left").withColumn(HIT, F.coalesce(F.col(HIT) & (key == F.col(HIDDEN + "first")), F.lit(False))).drop(HIDDEN + "first")
    if one_by == ["_id"]:
        return marked  # _id is unique
    # among equals, the one whose whole row is least; only equals are ranked
    names = [c for c in df.columns if not c.startswith(HIDDEN)]
    among = Window.partitionBy(HIT).orderBy(F.xxhash64(*[F.to_json(F.struct(F.col(quoted(c)))) for c in names]))
    tied = marked.filter(F.col(HIT)).withColumn(HIDDEN + "n", F.row_number().over(among)).withColumn(HIT, F.col(HIDDEN + "n") == 1).drop(HIDDEN + "n")
    return marked.filter(~F.col(HIT)).unionByName(tied)


def _changed(df: DataFrame, change: Any, array_filters: list[dict]) -> DataFrame:
    if isinstance(change, list) or not is_operators(change):
        return _rewritten(df, change)
    values: dict[str, Column] = {}
    scope, hit = Scope(df), F.col(HIT)
    for name in (n for n in _ORDER if n in change and n != "$setOnInsert"):
        for path, operand in change[name].items():
            if "$[" in path:
                first, column = _array_change(df, name, path, operand, array_filters, values)
                values[first] = column
                continue
            if name == "$unset":
                first, *rest = split_path(path)
                if first in df.columns:
                    kind = df.schema[first].dataType
                    gone = without_path(F.col(quoted(first)), kind, rest) if rest else None
                    nulls = F.lit(None).cast(kind) if gone is None else _as(gone, scope.dtype(gone), kind)
                    values[first] = F.when(hit, nulls).otherwise(F.col(quoted(first)))
                continue
            found = scope.at(path)
            old = found[0] if found else F.lit(None)
            new = _value(name, old, found[1] if found else T.NullType(), operand)
            values[path] = F.when(hit, new).otherwise(old)
    return set_paths(Flow(df, {}, {}), values).df


def _as(column: Column, have: T.DataType, want: T.DataType) -> Column:
    """A document in the shape of a wider one: fields that it lacks are NULL."""
    if not isinstance(want, T.StructType) or not isinstance(have, T.StructType):
        return column
    return F.when(column.isNotNull(), F.struct(*[(_as(column.getField(f.name), have[f.name].dataType, f.dataType) if f.name in have.names else F.lit(None).cast(f.dataType)).alias(f.name) for f in want.fields]))


def _value(name: str, old: Column, kind: T.DataType, operand: Any) -> Column:
    if name == "$set":
        return literal(operand)
    if name == "$inc":
        if isinstance(operand, bool) or not isinstance(operand, (int, float)) or not isinstance(kind, (T.NumericType, T.NullType)):
            raise BadValue("$inc takes numbers")
        return F.coalesce(old, F.lit(0)) + F.lit(operand)
    if name in ("$min", "$max"):
        # NULL is less than all: $min keeps it where the field is there, which a typed column can't tell, so it is set
        return F.coalesce((F.least if name == "$min" else F.greatest)(old, literal(operand)), literal(operand))
    if name == "$addToSet":
        more = operand["$each"] if isinstance(operand, dict) and set(operand) == {"$each"} else [operand]
        if not isinstance(kind, (T.ArrayType, T.NullType)):
            raise BadValue("$addToSet takes an array")
        added = F.array(*[literal(v) for v in more])
        own = F.coalesce(old, F.slice(added, 1, 0))
        return F.concat(own, F.array_distinct(F.array_except(added, own)))
    raise Unsupported(name)


def _array_change(df: DataFrame, name: str, path: str, operand: Any, array_filters: list[dict], values: dict[str, Column]) -> tuple[str, Column]:
    """$set or $unset at a path with $[id] steps (items.$[e].sub.q, items.$[e].parts.$[f].n): the elements that pass the
    filter of the id in the rows that are HIT, whatever the depth."""
    if name not in ("$set", "$unset"):
        raise Unsupported("array filters go with $set and $unset")
    head, *steps = path.split(".")
    if head not in df.columns or not head or not all(steps):
        raise Unsupported(f"array path {path}")
    value = literal(operand) if name == "$set" else F.lit(None)
    column = values.get(head, F.col(quoted(head)))
    return head, _changed_at(column, Scope(df).dtype(column), steps, value, name == "$set", array_filters, path)


def _changed_at(column: Column, kind: T.DataType, steps: list[str], value: Column, make: bool, array_filters: list[dict], path: str) -> Column:
    if not steps:
        return value
    step, *rest = steps
    if (tag := re.fullmatch(r"\$\[(\w+)\]", step)) is not None:
        if not isinstance(kind, T.ArrayType):
            raise Unsupported(f"array path {path}")
        wanted = {k.partition(".")[2]: v for f in array_filters for k, v in f.items() if k.partition(".")[0] == tag[1]}
        if not wanted:
            raise BadValue(f"no array filter for {tag[1]}")
        each = kind.elementType

        def change(x: Column) -> Column:
            tests = [F.coalesce(field_test(descend(x, each, p.split(".")) if p else (x, each), [], v), F.lit(False)) for p, v in wanted.items()]
            return F.when(reduce(lambda a, b: a & b, tests, F.col(HIT)), _changed_at(x, each, rest, value, make, array_filters, path)).otherwise(_widened(x, each, rest, value, make))

        return F.transform(column, change)
    if not isinstance(kind, T.StructType):
        raise Unsupported(f"array path {path}")
    fields = [(_changed_at(column.getField(f.name), f.dataType, rest, value, make, array_filters, path) if f.name == step else column.getField(f.name)).alias(f.name) for f in kind.fields]
    if step not in kind.names and make:
        if any("$" in r for r in rest):
            raise Unsupported(f"array path {path}")
        fields.append(with_path(None, None, rest, value).alias(step))
    return F.when(column.isNotNull(), F.struct(*fields))


def _widened(x: Column, kind: T.DataType, steps: list[str], value: Column, make: bool) -> Column:
    """An element that isn't changed, in the shape of those that are: a field that is new to them is NULL."""
    if not steps or not make or not isinstance(kind, T.StructType) or "$" in steps[0]:
        return x
    step, *rest = steps
    if step in kind.names:
        fields = [(_widened(x.getField(f.name), f.dataType, rest, value, make) if f.name == step else x.getField(f.name)).alias(f.name) for f in kind.fields]
        return F.when(x.isNotNull(), F.struct(*fields))
    gone = F.when(F.lit(False), with_path(None, None, rest, value))
    return F.when(x.isNotNull(), F.struct(*[x.getField(f).alias(f) for f in kind.names], gone.alias(step)))


def _rewritten(df: DataFrame, change: Any) -> DataFrame:
    """Rows that a pipeline or a replacement makes of those that match; _id stays."""
    hit, rest = df.filter(F.col(HIT)), df.filter(~F.col(HIT))
    if isinstance(change, list):
        made = run(Flow(hit, {}, {}), change).df
    else:
        if "_id" in change:
            raise ImmutableField("_id can't change")
        made = hit.select(*[F.col("_id")] * ("_id" in df.columns), *[literal(v).alias(k) for k, v in change.items()], HIT)
    return rest.unionByName(made, allowMissingColumns=True)


def seed(filter_: dict) -> dict:
    """What an upsert's document takes from the filter: its equalities, also those inside $and."""
    out: dict = {}
    for key, value in filter_.items():
        if key == "$and":
            for part in value:
                out |= seed(part)
        elif not key.startswith("$"):
            if is_operators(value):
                if "$eq" in value:
                    out[key] = value["$eq"]
            else:
                out[key] = value
    return out


def upsert(df: DataFrame, filter_: dict, change: dict, one_by: list[str] | None = None) -> DataFrame:
    """As update; if no row matches, one more row: the filter's equalities with the change applied."""
    if df.filter(matches(filter_, Scope(df))).take(1):
        return update(df, filter_, change, one_by=one_by)
    document = seed(filter_)
    if is_operators(change):
        for name in _ORDER:
            for path, operand in change.get(name, {}).items():
                if name == "$addToSet":
                    document[path] = operand["$each"] if isinstance(operand, dict) and set(operand) == {"$each"} else [operand]
                elif name != "$unset":
                    document[path] = operand
    else:
        document |= change
    flat = {k: v for k, v in document.items() if "." not in k}
    row = df.sparkSession.range(1).select(*[literal(v).alias(k) for k, v in flat.items()])
    row = set_paths(Flow(row, {}, {}), {k: literal(v) for k, v in document.items() if "." in k}).df
    return df.unionByName(row, allowMissingColumns=True)


def delete(df: DataFrame, filter_: dict, one_by: list[str] | None = None) -> DataFrame:
    """The rows that don't match; with one_by, all but the first match."""
    hit = _first_hit(df, filter_, one_by) if one_by else df.withColumn(HIT, matches(filter_, Scope(df)))
    return hit.filter(~F.coalesce(F.col(HIT), F.lit(False))).drop(HIT)


def with_ids(rows: DataFrame, like: DataFrame) -> DataFrame:
    """rows with an _id in each: 24 hexadecimal digits where it is missing, fixed by writing them."""
    if "_id" in rows.columns and not rows.filter("_id IS NULL").take(1):
        return rows
    kind = like.schema["_id"].dataType if "_id" in like.columns else rows.schema["_id"].dataType if "_id" in rows.columns else T.StringType()
    if not isinstance(kind, (T.StringType, T.NullType)):
        raise BadValue(f"rows without _id go with text ids, not {kind.simpleString()}")
    made = F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 24)
    own = F.coalesce(F.col("_id").cast("string"), made) if "_id" in rows.columns else made
    return written(rows.select(own.alias("_id"), *[F.col(quoted(c)) for c in rows.columns if c != "_id"]), "inserted")


def insert(df: DataFrame, rows: DataFrame, unique: list[list[str]] | None = None) -> DataFrame:
    """df and rows, if the unique keys (at least _id) allow it; rows without an _id get one."""
    both = df.unionByName(with_ids(rows, df), allowMissingColumns=True)
    for key in [["_id"], *(unique or [])]:
        check_unique(both, key)
    return both


def check_unique(df: DataFrame, key: list[str], partial: dict | None = None, sparse: bool = False) -> None:
    """Raises DuplicateKey if two rows share the key; NULLs are equal. partial: only rows that match count; sparse: only
    rows with some part of the key do."""
    rows = df.filter(matches(partial, Scope(df))) if partial else df
    if sparse:
        rows = rows.filter(reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in key]))
    if rows.groupBy(*key).count().filter("count > 1").take(1):
        raise DuplicateKey(f"duplicate key in {key}")


def expire(df: DataFrame, field: str, seconds: int, now: Column) -> DataFrame:
    """Without the rows whose date plus so many seconds is now or before."""
    date = F.col(field).cast("timestamp")
    return df.filter(F.coalesce(date + F.make_dt_interval(secs=F.lit(seconds)) > now, F.lit(True)))


def merge(target: DataFrame, rows: DataFrame) -> DataFrame:
    """$merge by _id: a matching row takes the fields that the new one has, others are added; a NULL _id always is."""
    keyed, loose = rows.filter("_id IS NOT NULL"), rows.filter("_id IS NULL")
    names = [*target.columns, *[c for c in rows.columns if c not in target.columns]]
    a, b = target.alias("a"), keyed.withColumn(HIT, F.lit(True)).alias("b")
    joined = a.join(b, F.col("a._id") == F.col("b._id"), "full")

    def pick(name: str) -> Column:
        sides = [F.col(f"{s}.{quoted(name)}") for s, d in (("b", rows), ("a", target)) if name in d.columns]
        return F.coalesce(*sides).alias(name)

    return joined.select(*[pick(n) for n in names]).unionByName(loose, allowMissingColumns=True)
