"""Data-quality jobs: sanitizing, PII lint, keyed diff, drift score, extraction."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from docspark.errors import BadValue
from docspark.functions.canonical import canonical, sorted_keys
from docspark.functions.filters import matches
from docspark.functions.scope import HIDDEN, Scope, quoted
from docspark.plans.pipeline import Flow, project, set_paths, shown, sort_columns, unset
from docspark.sources.tables import written

# The patterns of personal data, and the names that stand in for real ones.
EMAIL = r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}"
PHONE = r"\+?\d[\d\-\s]{7,}\d"
SSN = r"\b\d{3}-\d{2}-\d{4}\b"
FIRST_NAMES = ["Alex", "Casey", "Jordan", "Taylor", "Morgan", "Riley", "Avery", "Parker"]
LAST_NAMES = ["Kim", "Lee", "Park", "Choi", "Jung", "Han", "Seo", "Kang"]


def _digest(value: Column, seed: str, use: str = "") -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}::{use}"), value.cast("string")), 256)


def _string_hash(text: Column) -> Column:
    """The 31-polynomial hash of a string's ASCII characters, wrapped to 32 bits, without its sign."""
    wrapped = F.aggregate(F.split(text, ""), F.lit(0).cast("long"), lambda h, c: F.when(c == "", h).otherwise((h * 31 + F.ascii(c)) % (1 << 32)))
    return F.abs(F.when(wrapped >= 1 << 31, wrapped - (1 << 32)).otherwise(wrapped))


def _fake(value: Column, seed: str, kind: str | None) -> Column:
    hexed = _digest(value, seed, "fake::")
    if kind == "email":
        return F.concat(F.lit("email-fake-"), F.substring(hexed, 1, 12))
    if kind == "phone":
        # a digest may have few digits: it is read again from the start
        digits = F.substring(F.repeat(F.regexp_replace(hexed, "[a-f]", ""), 10), 1, 10)
        return F.concat(F.lit("+1-555-"), F.substring(digits, 1, 3), F.lit("-"), F.substring(digits, 4, 7))
    if kind == "name":
        first = F.element_at(F.lit(FIRST_NAMES), (_string_hash(hexed) % 8 + 1).cast("int"))
        last = F.element_at(F.lit(LAST_NAMES), (_string_hash(F.concat(hexed, F.lit("x"))) % 8 + 1).cast("int"))
        return F.concat_ws(" ", first, last)
    return F.concat(F.lit("fake-"), F.substring(hexed, 1, 12))


def sanitize(df: DataFrame, rules: list[dict], seed: str, volatile: list[str] | None = None) -> DataFrame:
    """df with each rule {path, action, fakeType?} applied, and the volatile paths dropped.

    Actions: drop, nullify, hash, tokenize, fake. A NULL stays NULL. All are functions of the value and the seed, so
    equal values stay equal across tables.
    """
    flow = Flow(df, {}, {})
    for rule in rules:
        path, action = rule["path"], rule["action"].lower()
        found = flow.scope.at(path)
        if found is None:
            continue
        value = found[0]
        if action == "drop":
            flow = unset(flow, path)
            continue
        makers = {
            "nullify": lambda v: F.lit(None).cast(found[1]),
            "hash": lambda v: F.concat(F.lit("sha256:"), _digest(v, seed)),
            "tokenize": lambda v: F.concat(F.lit("tok_"), F.substring(_digest(v, seed, "token::"), 1, 16)),
            "fake": lambda v: _fake(v, seed, (rule.get("fakeType") or "").lower()),
        }
        if action not in makers:
            raise BadValue(f"unknown action {action!r}")
        flow = set_paths(flow, {path: makers[action](value) if action == "nullify" else F.when(value.isNotNull(), makers[action](value))})
    for path in volatile or []:
        flow = unset(flow, path)
    return shown(flow.df)


def pii_lint(df: DataFrame, text: str | None = None) -> DataFrame:
    """df's columns and type, sample: the first finding of each type (email, phone, ssn) in each row's canonical JSON,
    or in one text column."""
    subject = F.col(quoted(text)) if text else canonical(df)
    # most texts have no @, and need no search for an address
    sample = {"email": F.when(F.contains(subject, F.lit("@")), F.regexp_extract(subject, EMAIL, 0)), "phone": F.regexp_extract(subject, PHONE, 0), "ssn": F.regexp_extract(subject, SSN, 0)}
    found = F.array(*[F.struct(F.lit(n).alias("type"), F.coalesce(s, F.lit("")).alias("sample")) for n, s in sample.items()])
    return df.select("*", F.inline(F.filter(found, lambda x: x["sample"] != "")))


def extract(df: DataFrame, plan: dict[str, Any]) -> DataFrame:
    """The rows of an extraction plan: filter, projection, sort, limit."""
    flow = Flow(df, {}, {})
    if plan.get("filter"):
        flow = flow.to(flow.df.filter(matches(plan["filter"], Scope(flow.df))))
    if plan.get("sort"):
        flow = flow.to(flow.df.orderBy(*sort_columns(flow, plan["sort"])))
    if plan.get("limit"):
        flow = flow.to(flow.df.limit(plan["limit"]))
    if plan.get("projection"):
        flow = project(flow, plan["projection"])
    return shown(flow.df)


def keyed_diff(before: DataFrame, after: DataFrame, key: str = "_id") -> DataFrame:
    """key, status (added, removed, changed, unchanged) and field_drop (a field that had a value is NULL or gone)."""
    fields = sorted({*before.columns, *after.columns} - {key})

    def side(df: DataFrame, name: str) -> DataFrame:
        whole = F.xxhash64(*[F.to_json(F.struct(sorted_keys(F.col(quoted(c)), df.schema[c].dataType).alias(c))) if c in df.columns else F.lit("{}") for c in fields])
        there = F.array(*[F.col(quoted(c)).isNotNull() if c in df.columns else F.lit(False) for c in fields])
        return df.select(F.col(quoted(key)).alias(key), F.struct(whole.alias("hash"), there.alias("there")).alias(name))

    both = side(before, "b").join(side(after, "a"), key, "full")
    status = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(F.col("b.hash") == F.col("a.hash"), "unchanged").otherwise("changed")
    dropped = F.exists(F.arrays_zip(F.col("b.there").alias("x"), F.col("a.there").alias("y")), lambda z: z["x"] & ~z["y"])
    return both.select(key, status.alias("status"), F.coalesce((status == "changed") & dropped, F.lit(False)).alias("field_drop"))


def diff_summary(before: DataFrame, after: DataFrame, key: str = "_id") -> DataFrame:
    """One row: added, removed, changed, unchanged, requires_approval."""
    diff = keyed_diff(before, after, key)
    counts = [F.count(F.when(F.col("status") == s, 1)).alias(s) for s in ("added", "removed", "changed", "unchanged")]
    return diff.agg(*counts, F.coalesce(F.bool_or((F.col("status") == "removed") | F.col("field_drop")), F.lit(False)).alias("requires_approval"))


def incremental(before: DataFrame, after: DataFrame, key: str = "_id") -> DataFrame:
    """The rows of after that are new or changed."""
    fresh = keyed_diff(before, after, key).filter(F.col("status").isin("added", "changed")).select(key)
    return after.join(fresh, key, "left_semi")


def _cells(df: DataFrame, fields: list[str], side: str) -> DataFrame:
    """field, value (64 bits of it, or NULL), x and y (1 on the side that the row is of)."""
    values = [(f, _scalar(df, f)) for f in fields]
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.when(v.isNotNull(), F.xxhash64(v)).alias("value")) for f, v in values])
    return df.select(F.inline(cells)).select("field", "value", *[F.lit(int(side == c)).alias(c) for c in "xy"])


def _scalar(df: DataFrame, field: str) -> Column:
    if field not in df.columns:
        return F.lit(None).cast("string")
    kind, column = df.schema[field].dataType, F.col(quoted(field))
    if isinstance(kind, (T.StructType, T.ArrayType)):
        return F.to_json(sorted_keys(column, kind))
    return column.cast("string")


def drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """field, null_delta, cardinality_delta, distribution_delta: how far each field's values moved. Values are told apart by
    64 bits, and counted on both sides in one pass."""
    fields = sorted({*before.columns, *after.columns})
    both = _cells(before, fields, "x").union(_cells(after, fields, "y")).groupBy("field", "value").agg(*[F.sum(c).alias(c) for c in "xy"])
    some = F.col("value").isNotNull()
    sums = both.groupBy("field").agg(*[F.coalesce(F.sum(F.when(some, F.col(c))), F.lit(0)).alias(f"{c}t") for c in "xy"], *[F.coalesce(F.sum(F.when(~some, F.col(c))), F.lit(0)).alias(f"{c}n") for c in "xy"], *[F.count(F.when(some & (F.col(c) > 0), 1)).alias(f"{c}c") for c in "xy"])
    share = lambda c: F.when(F.col(f"{c}t") > 0, F.col(c) / F.col(f"{c}t")).otherwise(0.0)
    # a field has few totals; its values are many, so the totals go to the values
    moved = both.filter(some).join(F.broadcast(sums), "field").groupBy("field").agg((F.sum(F.abs(share("x") - share("y"))) / 2).alias("moved"))
    ratio = lambda c: F.round(F.when(F.col(f"{c}n") + F.col(f"{c}t") > 0, F.col(f"{c}n") / (F.col(f"{c}n") + F.col(f"{c}t"))).otherwise(0.0), 4)
    return sums.join(moved, "field", "left").select(
        "field",
        F.round(F.abs(ratio("y") - ratio("x")), 4).alias("null_delta"),
        F.round(F.abs(F.col("yc") - F.col("xc")) / F.greatest(F.lit(1), F.col("xc")), 4).alias("cardinality_delta"),
        F.round(F.coalesce("moved", F.lit(0.0)), 4).alias("distribution_delta"),
    )


def drift_score(before: DataFrame, after: DataFrame, warn: float = 0.15, fail: float = 0.30) -> DataFrame:
    """One row: row_delta, avg_null, avg_cardinality, max_distribution, score, status."""
    rows = before.agg(F.count("*").alias("b")).crossJoin(after.agg(F.count("*").alias("a")))
    row_delta = F.round(F.abs(F.col("a") - F.col("b")) / F.greatest(F.lit(1), F.col("b")), 4)
    fields = drift(before, after).agg(*[F.round(F.coalesce(f(c), F.lit(0.0)), 4).alias(n) for f, c, n in ((F.avg, "null_delta", "avg_null"), (F.avg, "cardinality_delta", "avg_cardinality"), (F.max, "distribution_delta", "max_distribution"))])
    score = F.round(F.col("row_delta") * 0.4 + F.col("avg_null") * 0.2 + F.col("avg_cardinality") * 0.2 + F.col("max_distribution") * 0.2, 4)
    # one row each
    both = rows.select(row_delta.alias("row_delta")).crossJoin(fields).withColumn("score", score)
    return both.withColumn("status", F.when(F.col("score") >= fail, "FAIL").when(F.col("score") >= warn, "WARN").otherwise("OK"))


def restore(target: DataFrame, rows: DataFrame, mode: str = "REPLACE", key: str = "_id") -> DataFrame:
    """REPLACE: rows alone; MERGE: the target with rows put in the place of those with their key."""
    if mode == "REPLACE":
        return rows
    if mode != "MERGE":
        raise BadValue(f"unknown mode {mode!r}")
    return target.join(rows.select(key), key, "left_anti").unionByName(rows, allowMissingColumns=True)


def schema_signatures(df: DataFrame) -> DataFrame:
    """keys, n: each set of top-level fields that rows have a value in, as sorted names joined by commas. More than one
    means documents of mixed shape."""
    names = sorted(df.columns)
    present = F.array(*[F.when(F.col(quoted(c)).isNotNull(), F.lit(c)) for c in names])
    return df.groupBy(F.array_join(F.array_compact(present), ",").alias("keys")).agg(F.count(F.lit(1)).alias("n"))


def schema_hash(collections: dict[str, DataFrame]) -> DataFrame:
    """One row, hash: sha256 of each collection's name, fields that any row has a value in, and number of rows, a line
    each, collections and fields in the order of their names."""
    parts = None
    for place, name in enumerate(sorted(collections)):
        df = collections[name]
        fields = [F.when(F.count(F.col(quoted(c))) > 0, F.lit(c + "\n")) for c in sorted(df.columns)]
        part = df.agg(F.concat(F.lit(name + "\n"), F.array_join(F.array_compact(F.array(*fields)), "") if fields else F.lit(""), F.lit("docs="), F.count(F.lit(1)).cast("string"), F.lit("\n")).alias("text")).withColumn("place", F.lit(place))
        parts = part if parts is None else parts.union(part)
    # one row for each collection
    listed = F.transform(F.sort_array(F.collect_list(F.struct("place", "text"))), lambda x: x["text"])
    return parts.agg(F.sha2(F.array_join(listed, ""), 256).alias("hash"))


def nearest_rank(df: DataFrame, column: str, shares: list[float], by: list[str] | None = None) -> DataFrame:
    """by, p, value: for each share p the value of rank ceil(n * p), at least 1, among the n that aren't NULL.

    Equal values are counted before they are ranked. The running counts go over ranges of values (by a range shuffle), so
    no group has to be in one task.
    """
    keys = by or []
    counted = df.filter(F.col(quoted(column)).isNotNull()).groupBy(*keys, F.col(quoted(column)).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    part, below = HIDDEN + "part", HIDDEN + "below"
    ranged = written(counted.repartitionByRange(*[F.col(k) for k in keys], F.col("value")).withColumn(part, F.spark_partition_id()), "ranged")
    # a row for each group in each range
    totals = ranged.groupBy(*keys, part).agg(F.sum("n").alias("t"))
    all_ = ranged.groupBy(*keys).agg(F.sum("n").alias("all"))
    before = totals.withColumn(below, F.sum("t").over(Window.partitionBy(*keys).orderBy(part)) - F.col("t")).drop("t")
    run = F.sum("n").over(Window.partitionBy(*keys, part).orderBy("value"))
    rows = ranged.withColumn("to", run)
    renamed = lambda d: d.withColumnsRenamed({k: HIDDEN + k for k in keys})
    b, a = renamed(before).withColumnRenamed(part, part + "b"), renamed(all_)
    on = lambda d: [F.col(quoted(k)).eqNullSafe(F.col(quoted(HIDDEN + k))) for k in keys]
    rows = rows.join(b, [*on(b), F.col(part) == F.col(part + "b")]).drop(*[HIDDEN + k for k in keys])
    rows = rows.join(a, on(a) or F.lit(True)).drop(*[HIDDEN + k for k in keys])
    to = F.col("to") + F.col(below)
    ranks = F.explode(F.array(*[F.struct(F.lit(float(p)).alias("p"), F.greatest(F.lit(1), F.ceil(F.col("all") * F.lit(float(p)))).alias("rank")) for p in shares]))
    hit = rows.select(*keys, "value", to.alias("to"), (to - F.col("n")).alias("from"), ranks.alias("x"))
    return hit.filter((F.col("x.rank") > F.col("from")) & (F.col("x.rank") <= F.col("to"))).select(*keys, F.col("x.p").alias("p"), "value")
