"""A collection: an immutable DataFrame version with document-style reads and writes.

Writes return the next version; the old one stays as it is, so a snapshot is just a reference. Rows have an arrival
order by the columns of order_by (default: _id), which decides what "the first match" is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.errors import BadValue, QueryError, Unsupported
from docspark.functions.canonical import sorted_keys
from docspark.functions.expressions import literal
from docspark.functions.filters import matches
from docspark.functions.scope import Scope, quoted
from docspark.operators import updates
from docspark.plans.pipeline import Flow, aggregate, project, shown, sort_columns
from docspark.sources.tables import written

#: Collations by locale and strength: accents and case, case, or nothing is passed over.
_COLLATIONS = {1: "_CI_AI", 2: "_CI", 3: "", 4: ""}

#: Writes of a bulk after which the version is written, so that the plan doesn't grow with their number.
PLAN_WRITES = 8


@dataclass(frozen=True)
class Index:
    key: list[str]
    unique: bool = False
    sparse: bool = False
    partial: dict | None = None
    expire_after: int | None = None


@dataclass(frozen=True)
class Collection:
    df: DataFrame
    order_by: list[str] = field(default_factory=lambda: ["_id"])
    indexes: tuple[Index, ...] = ()
    collections: dict[str, DataFrame] = field(default_factory=dict)
    now: Column | None = None

    def live(self) -> DataFrame:
        """The rows that no expiring index has run out for."""
        df = self.df
        for index in self.indexes:
            if index.expire_after is not None and len(index.key) == 1 and not index.partial:
                df = updates.expire(df, index.key[0], index.expire_after, self.now if self.now is not None else F.current_timestamp())
        return df

    def find(self, filter_: dict | None = None, projection: dict | None = None, sort: dict | None = None, skip: int = 0, limit: int = 0, collation: dict | None = None, let: dict | None = None) -> DataFrame:
        """let: variables of the command, which $expr may name."""
        df = collated(self.live(), collation)
        df = df.filter(matches(filter_ or {}, Scope(df, _bound(let))))
        if sort:
            df = df.orderBy(*sort_columns(Flow(df, {}, {}), sort), *[F.col(quoted(c)) for c in self.order_by])
        if skip > 0:
            df = df.offset(skip)
        if limit:
            df = df.limit(abs(limit))
        return shown(project(Flow(df, {}, {}), projection).df) if projection else df

    def find_one(self, filter_: dict | None = None, **more: Any) -> Row | None:
        return next(iter(self.find(filter_, limit=1, **more).collect()), None)

    def batches(self, size: int = 101, **query: Any) -> Iterator[list[Row]]:
        """The result of find, so many rows at a time."""
        batch: list[Row] = []
        for row in self.find(**query).toLocalIterator():
            batch.append(row)
            if len(batch) == size:
                yield batch
                batch = []
        if batch:
            yield batch

    def count(self, filter_: dict | None = None, skip: int = 0, limit: int = 0) -> DataFrame:
        return self.find(filter_, skip=skip, limit=limit).agg(F.count(F.lit(1)).alias("n"))

    def estimated_count(self) -> DataFrame:
        """The number of rows, without a filter: Parquet files tell it in their footers."""
        return self.live().agg(F.count(F.lit(1)).alias("n"))

    def distinct(self, key: str, filter_: dict | None = None, collation: dict | None = None) -> DataFrame:
        """One column `value`: the distinct values at a path; arrays give their elements."""
        df = self.find(filter_, collation=collation)
        found = Scope(df).at(key)
        if found is None:
            fanned = _fanned(df, key)
            return fanned.distinct()
        column, kind = found
        while isinstance(kind, T.ArrayType):
            df = df.select(F.explode(column).alias("value"))
            column, kind = F.col("value"), kind.elementType
        return df.select(column.alias("value")).distinct()

    def aggregate(self, pipeline: list[dict], collation: dict | None = None, let: dict | None = None) -> DataFrame:
        """The pipeline's rows. If its last stage is $out or $merge, these are written, and the rows of the collection that
        it names are returned, as they are then."""
        last = pipeline[-1] if pipeline else {}
        if "$out" in last:
            return written(self.aggregate(pipeline[:-1], collation, let), "out")
        if "$merge" in last:
            spec = {"into": last["$merge"]} if isinstance(last["$merge"], str) else last["$merge"]
            if set(spec) - {"into", "on", "whenMatched", "whenNotMatched"} or spec.get("on", "_id") != "_id" or spec.get("whenMatched", "merge") != "merge" or spec.get("whenNotMatched", "insert") != "insert":
                raise Unsupported("$merge merges by _id and inserts the rest")
            rows, target = self.aggregate(pipeline[:-1], collation, let), self.collections.get(spec["into"])
            return written(rows if target is None else updates.merge(target, rows), "merge")
        others = {n: collated(d, collation) for n, d in self.collections.items()} if collation else self.collections
        return aggregate(collated(self.live(), collation), pipeline, others, self.order_by, _bound(let))

    def out(self, pipeline: list[dict]) -> DataFrame:
        """The pipeline's rows as a new table: what $out puts in the place of a collection."""
        return written(self.aggregate(pipeline), "out")

    def merge_into(self, target: DataFrame, pipeline: list[dict]) -> DataFrame:
        return written(updates.merge(target, self.aggregate(pipeline)), "merge")

    def _next(self, df: DataFrame) -> Collection:
        for index in self.indexes:
            if index.unique:
                updates.check_unique(df, index.key, index.partial, index.sparse)
        return replace(self, df=df)

    def insert(self, rows: DataFrame) -> Collection:
        return self._next(updates.insert(self.live(), rows))

    def update_one(self, filter_: dict, change: Any, upsert: bool = False, array_filters: list[dict] | None = None) -> Collection:
        if upsert:
            return self._next(updates.upsert(self.live(), filter_, change, self.order_by))
        return self._next(updates.update(self.live(), filter_, change, array_filters, self.order_by))

    def update_many(self, filter_: dict, change: Any, array_filters: list[dict] | None = None) -> Collection:
        if isinstance(change, dict) and not all(k.startswith("$") for k in change):
            raise BadValue("a replacement is for one row")
        return self._next(updates.update(self.live(), filter_, change, array_filters))

    def replace_one(self, filter_: dict, document: dict, upsert: bool = False) -> Collection:
        return self.update_one(filter_, document, upsert)

    def delete_one(self, filter_: dict) -> Collection:
        return self._next(updates.delete(self.live(), filter_, self.order_by))

    def delete_many(self, filter_: dict) -> Collection:
        return self._next(updates.delete(self.live(), filter_))

    def find_and_modify(self, filter_: dict, change: Any = None, sort: dict | None = None, new: bool = False, upsert: bool = False, remove: bool = False, fields: dict | None = None, array_filters: list[dict] | None = None) -> tuple[Row | None, Collection]:
        """The first match (by sort, then order_by) is changed, replaced or removed; the row as it was, or is (new), cut to
        fields, and the next version. With upsert, a row is added where there is no match."""
        if remove == (change is not None) or remove and (new or upsert):
            raise BadValue("either remove, or a change with new and upsert")
        row = self.find_one(filter_, sort=sort)
        if row is None:
            if not upsert:
                return None, self
            then = self.update_one(filter_, change, upsert=True)
            return (then.find_one(updates.seed(filter_), projection=fields) if new else None), then
        key = {c: row[c] for c in self.order_by}
        then = self.delete_one(key) if remove else self.update_one(key, change, array_filters=array_filters)
        return (then if new else self).find_one(key, projection=fields), then

    def find_one_and_update(self, filter_: dict, change: Any, sort: dict | None = None, new: bool = False, upsert: bool = False, fields: dict | None = None) -> tuple[Row | None, Collection]:
        return self.find_and_modify(filter_, change, sort, new, upsert, fields=fields)

    def find_one_and_replace(self, filter_: dict, document: dict, sort: dict | None = None, new: bool = False, upsert: bool = False, fields: dict | None = None) -> tuple[Row | None, Collection]:
        if any(k.startswith("$") for k in document):
            raise BadValue("a replacement has no operators")
        return self.find_and_modify(filter_, document, sort, new, upsert, fields=fields)

    def find_one_and_delete(self, filter_: dict, sort: dict | None = None, fields: dict | None = None) -> tuple[Row | None, Collection]:
        return self.find_and_modify(filter_, sort=sort, remove=True, fields=fields)

    def bulk_write(self, operations: list[dict]) -> Collection:
        """Operations in order: insertOne, updateOne, updateMany, deleteOne, deleteMany, replaceOne."""
        out = self
        for k, operation in enumerate(operations):
            out = out._applied(operation)
            if k % PLAN_WRITES == PLAN_WRITES - 1:
                out = out.persisted()
        return out

    def bulk_result(self, operations: list[dict], ordered: bool = True) -> tuple[Collection, dict[str, Any]]:
        """bulk_write with its counts: inserted, matched, modified, deleted, upserted, and errors (index and message) of the
        operations that failed; ordered stops at the first. Each operation's version is written, so counts are of rows
        that stay as they are."""
        out, counts = self, {"inserted": 0, "matched": 0, "modified": 0, "deleted": 0, "upserted": 0, "errors": []}
        for k, operation in enumerate(operations):
            try:
                then = out._applied(operation).persisted()
            except QueryError as e:
                counts["errors"].append({"index": k, "message": str(e)})
                if ordered:
                    break
                continue
            name, spec = next(iter(operation.items()))
            before, after = out.df.count(), then.df.count()
            if name == "insertOne":
                counts["inserted"] += after - before
            elif name.startswith("delete"):
                counts["deleted"] += before - after
            else:
                met = out.find(spec["filter"], limit=0 if name == "updateMany" else 1).count()
                counts["matched"] += met
                counts["upserted"] += after - before
                if met:
                    counts["modified"] += _as_text(then.df).exceptAll(_as_text(out.df)).count()
            out = then
        return out, counts

    def _applied(self, operation: dict) -> Collection:
        name, spec = next(iter(operation.items()))
        if name == "insertOne":
            return self.insert(self.df.sparkSession.range(1).select(*[literal(v).alias(k) for k, v in spec["document"].items()]))
        if name == "updateOne":
            return self.update_one(spec["filter"], spec["update"], spec.get("upsert", False), spec.get("arrayFilters"))
        if name == "updateMany":
            return self.update_many(spec["filter"], spec["update"], spec.get("arrayFilters"))
        if name == "deleteOne":
            return self.delete_one(spec["filter"])
        if name == "deleteMany":
            return self.delete_many(spec["filter"])
        if name == "replaceOne":
            return self.replace_one(spec["filter"], spec["replacement"], spec.get("upsert", False))
        raise Unsupported(f"unsupported operation {name}")

    def create_index(self, index: Index) -> Collection:
        """The collection with one more constraint; the rows that are there must meet it."""
        if index.unique:
            updates.check_unique(self.df, index.key, index.partial, index.sparse)
        return replace(self, indexes=(*self.indexes, index))

    def persisted(self) -> Collection:
        """The same rows as a written table: cuts the plan after many writes."""
        return replace(self, df=written(self.df, "version"))


def _bound(let: dict | None) -> dict[str, Column]:
    return {name: literal(value) for name, value in (let or {}).items()}


def _as_text(df: DataFrame) -> DataFrame:
    """One column: each row as JSON with its keys in order and without NULLs, so that rows of wider versions compare."""
    parts = [sorted_keys(F.col(quoted(c)), df.schema[c].dataType).alias(c) for c in sorted(df.columns)]
    return df.select(F.to_json(F.struct(*parts)).alias("value"))


def _fanned(df: DataFrame, key: str) -> DataFrame:
    """value: what a path that crosses arrays leads to."""
    first, *rest = key.split(".")
    if first not in df.columns:
        return df.limit(0).select(F.lit(None).cast("string").alias("value"))
    out, kind = df.select(F.col(quoted(first)).alias("value")), df.schema[first].dataType
    for part in [*rest, None]:
        while isinstance(kind, T.ArrayType):
            out, kind = out.select(F.explode("value").alias("value")), kind.elementType
        if part is not None:
            if not isinstance(kind, T.StructType) or part not in kind.names:
                return df.limit(0).select(F.lit(None).cast("string").alias("value"))
            out, kind = out.select(F.col("value").getField(part).alias("value")), kind[part].dataType
    return out


def collated(df: DataFrame, collation: dict | None) -> DataFrame:
    """df with its string columns compared by locale and strength."""
    if not collation or collation.get("locale") == "simple":
        return df
    if set(collation) - {"locale", "strength"}:
        raise Unsupported("a collation has locale and strength")
    name = collation["locale"].replace("-", "_") + _COLLATIONS[collation.get("strength", 3)]
    return df.withColumns({f.name: F.collate(F.col(quoted(f.name)), name) for f in df.schema.fields if isinstance(f.dataType, T.StringType)})


