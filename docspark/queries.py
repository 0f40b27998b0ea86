"""Registered queries over the given tables, one or more for each operator, with the DuckDB SQL of the same result."""

from __future__ import annotations

import datetime
import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.operators import fixtures, updates
from docspark.plans.collection import Collection, Index
from docspark.plans.pipeline import aggregate
from docspark.sources import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
_KEYS = {"orders": ["o_orderkey"], "events": ["event_id"], "customer": ["c_custkey"], "part": ["p_partkey"], "supplier": ["s_suppkey"], "documents": ["doc_id"], "embeddings": ["vec_id"]}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class _Tables(dict):
    """The other collections of a pipeline, read when a stage names them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self.spark, self.sf_dir = spark, sf_dir

    def __missing__(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)


def _pipeline(name: str, source: str, pipeline: list[dict], sql: str, rounded: dict[str, int] | None = None, ordered: bool = False) -> None:
    """Registers a pipeline over a table; `rounded` columns are sums of doubles, whose last digits depend on order."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = aggregate(table(spark, sf_dir, source), pipeline, _Tables(spark, sf_dir), _KEYS[source] if ordered else None)
        return out.withColumns({c: F.round(c, n) for c, n in (rounded or {}).items()})

    QUERIES[name] = run
    ORACLE_SQL[name] = sql


def _query(name: str, sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name], ORACLE_SQL[name] = f, sql
        return f

    return add


def _find(name: str, source: str, filter_: dict, where: str, key: str) -> None:
    _pipeline(name, source, [{"$match": filter_}, {"$project": {"_id": 0, key: 1}}], f"SELECT {key} FROM {source} WHERE {where}")


# ---- filters ----

_day = datetime.datetime
_find("match_eq", "orders", {"o_orderstatus": "F"}, "o_orderstatus = 'F'", "o_orderkey")
_find("match_ne", "orders", {"o_orderstatus": {"$ne": "F"}}, "o_orderstatus IS DISTINCT FROM 'F'", "o_orderkey")
_find("match_range", "orders", {"o_orderdate": {"$gte": _day(1997, 1, 1), "$lt": _day(1998, 1, 1)}, "o_totalprice": {"$gt": 100000}}, "o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01' AND o_totalprice > 100000", "o_orderkey")
_find("match_in", "orders", {"o_orderpriority": {"$in": ["1-URGENT", "5-LOW"]}}, "o_orderpriority IN ('1-URGENT', '5-LOW')", "o_orderkey")
_find("match_nin", "orders", {"o_orderpriority": {"$nin": ["1-URGENT", "5-LOW"]}}, "o_orderpriority NOT IN ('1-URGENT', '5-LOW')", "o_orderkey")
_find("match_exists", "events", {"props": {"$exists": True}, "nothing": {"$exists": False}}, "props IS NOT NULL", "event_id")
_find("match_type", "part", {"p_size": {"$type": "int"}, "p_name": {"$type": 2}}, "p_size IS NOT NULL AND p_name IS NOT NULL", "p_partkey")
_find("match_regex", "part", {"p_name": {"$regex": "^RED|ring$", "$options": "i"}}, "regexp_matches(p_name, '(?i)^RED|ring$')", "p_partkey")
_find("match_regex_literal", "part", {"p_brand": re.compile("brand#1", re.I)}, "regexp_matches(p_brand, '(?i)brand#1')", "p_partkey")
_find("match_mod", "part", {"p_size": {"$mod": [7, 3]}}, "p_size % 7 = 3", "p_partkey")
_find("match_bits_all_set", "part", {"p_size": {"$bitsAllSet": [0, 3]}}, "p_size & 9 = 9", "p_partkey")
_find("match_and_or", "orders", {"$and": [{"o_orderstatus": "O"}, {"$or": [{"o_totalprice": {"$lt": 50000}}, {"o_orderpriority": "2-HIGH"}]}]}, "o_orderstatus = 'O' AND (o_totalprice < 50000 OR o_orderpriority = '2-HIGH')", "o_orderkey")
_find("match_nor", "orders", {"$nor": [{"o_orderstatus": "O"}, {"o_totalprice": {"$lt": 200000}}]}, "NOT (o_orderstatus = 'O' OR o_totalprice < 200000)", "o_orderkey")
_find("match_not", "orders", {"o_totalprice": {"$not": {"$gte": 150000}}, "$not": {"o_orderstatus": "P"}}, "NOT o_totalprice >= 150000 AND o_orderstatus <> 'P'", "o_orderkey")
_pipeline("match_expr_cmp", "lineitem", [{"$match": {"$expr": {"$gt": ["$l_discount", "$l_tax"]}}}, {"$group": {"_id": "$l_returnflag", "n": {"$sum": 1}}}, {"$project": {"_id": 0, "flag": "$_id", "n": 1}}], "SELECT l_returnflag AS flag, count(*) AS n FROM lineitem WHERE l_discount > l_tax GROUP BY 1")
_pipeline("match_expr_add", "lineitem", [{"$match": {"$expr": {"$or": [{"$eq": [{"$add": ["$l_linenumber", 1]}, 3]}, {"$gte": ["$l_quantity", 45]}]}}}, {"$count": "n"}], "SELECT count(*) AS n FROM lineitem WHERE l_linenumber + 1 = 3 OR l_quantity >= 45 HAVING count(*) > 0")


def _arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with the statuses and the price and status of their orders, as arrays in the order of the key."""
    pushed = [{"$group": {"_id": "$o_custkey", "tags": {"$push": "$o_orderstatus"}, "items": {"$push": {"price": "$o_totalprice", "status": "$o_orderstatus"}}}}]
    return aggregate(table(spark, sf_dir, "orders"), pushed, order_by=["o_orderkey"])


_ARRAYS = "WITH a AS (SELECT o_custkey AS _id, list(o_orderstatus ORDER BY o_orderkey) AS tags, list({'price': o_totalprice, 'status': o_orderstatus} ORDER BY o_orderkey) AS items FROM orders GROUP BY 1) "


def _find_array(name: str, filter_: dict, where: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: aggregate(_arrays(spark, sf_dir), [{"$match": filter_}, {"$project": {"_id": 1}}])
    ORACLE_SQL[name] = f"{_ARRAYS} SELECT _id FROM a WHERE {where}"


_find_array("match_size", {"tags": {"$size": 9}}, "len(tags) = 9")
_find_array("match_elem_match", {"items": {"$elemMatch": {"status": "P", "price": {"$gt": 300000}}}}, "len(list_filter(items, lambda x: x.status = 'P' AND x.price > 300000)) > 0")
_find_array("match_all", {"tags": {"$all": ["P", "F", "O"]}}, "list_has_all(tags, ['P', 'F', 'O'])")
_find_array("match_array_scalar", {"tags": "P", "items.price": {"$lt": 20000}}, "list_contains(tags, 'P') AND len(list_filter(items, lambda x: x.price < 20000)) > 0")
_find_array("match_array_index", {"tags.0": "F", "items.1.price": {"$gte": 100000}}, "tags[1] = 'F' AND items[2].price >= 100000")
_find_array("match_array_ne", {"tags": {"$ne": "P"}}, "NOT list_contains(tags, 'P')")

# ---- shapes ----

_pipeline("project_include", "customer", [{"$project": {"c_name": 1, "c_mktsegment": 1}}], "SELECT c_name, c_mktsegment FROM customer")
_pipeline("project_exclude", "customer", [{"$project": {"c_name": 0, "c_acctbal": 0}}], "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer")
_pipeline("project_computed", "part", [{"$project": {"p_partkey": 1, "label": "$p_brand", "double_size": {"$multiply": ["$p_size", 2]}}}], "SELECT p_partkey, p_brand AS label, p_size * 2 AS double_size FROM part")
_pipeline("add_fields", "part", [{"$addFields": {"p_size": {"$add": ["$p_size", 1]}, "old": "$p_size"}}, {"$project": {"p_partkey": 1, "p_size": 1, "old": 1}}], "SELECT p_partkey, p_size + 1 AS p_size, p_size AS old FROM part")
_pipeline("set_nested", "part", [{"$set": {"dim.size": "$p_size", "dim.brand": "$p_brand"}}, {"$project": {"p_partkey": 1, "size": "$dim.size", "brand": "$dim.brand"}}], "SELECT p_partkey, p_size AS size, p_brand AS brand FROM part")
_pipeline("unset", "supplier", [{"$unset": ["s_name", "s_acctbal"]}], "SELECT s_suppkey, s_nationkey FROM supplier")
_pipeline("replace_root", "part", [{"$replaceRoot": {"newRoot": {"k": "$p_partkey", "b": "$p_brand"}}}], "SELECT p_partkey AS k, p_brand AS b FROM part")
_pipeline("replace_with", "part", [{"$addFields": {"doc": {"$mergeObjects": [{"k": "$p_partkey", "v": "$p_size"}, {"v": 1}]}}}, {"$replaceWith": "$doc"}], "SELECT p_partkey AS k, 1 AS v FROM part")

# ---- expressions ----

_pipeline("expr_cond", "part", [{"$project": {"p_partkey": 1, "c": {"$cond": [{"$gte": ["$p_size", 25]}, "big", "small"]}}}], "SELECT p_partkey, CASE WHEN p_size >= 25 THEN 'big' ELSE 'small' END AS c FROM part")
_pipeline("expr_if_null", "part", [{"$project": {"p_partkey": 1, "v": {"$ifNull": ["$missing", "$p_type"]}}}], "SELECT p_partkey, p_type AS v FROM part")
_pipeline("expr_cmp", "lineitem", [{"$group": {"_id": {"$cmp": ["$l_discount", "$l_tax"]}, "n": {"$sum": 1}}}, {"$project": {"_id": 0, "c": "$_id", "n": 1}}], "SELECT CASE WHEN l_discount < l_tax THEN -1 WHEN l_discount > l_tax THEN 1 ELSE 0 END AS c, count(*) AS n FROM lineitem GROUP BY 1")
_pipeline("expr_type", "part", [{"$project": {"p_partkey": 1, "a": {"$type": "$p_size"}, "b": {"$type": "$p_name"}, "c": {"$type": "$none"}}}], "SELECT p_partkey, 'int' AS a, 'string' AS b, 'missing' AS c FROM part")
_pipeline("expr_min_max", "lineitem", [{"$project": {"_id": 0, "l_orderkey": 1, "l_linenumber": 1, "lo": {"$min": ["$l_discount", "$l_tax"]}, "hi": {"$max": ["$l_discount", "$l_tax"]}}}], "SELECT l_orderkey, l_linenumber, least(l_discount, l_tax) AS lo, greatest(l_discount, l_tax) AS hi FROM lineitem")
_pipeline("expr_arith", "part", [{"$project": {"p_partkey": 1, "a": {"$add": ["$p_size", "$p_partkey", 3]}, "s": {"$subtract": ["$p_size", 10]}, "m": {"$multiply": ["$p_size", "$p_size"]}, "d": {"$divide": ["$p_size", 4]}}}], "SELECT p_partkey, p_size + p_partkey + 3 AS a, p_size - 10 AS s, p_size * p_size AS m, p_size / 4 AS d FROM part")
_pipeline("expr_merge_objects", "part", [{"$project": {"p_partkey": 1, "m": {"$mergeObjects": [{"x": "$p_size", "y": "$p_brand"}, {"x": 7}]}}}, {"$project": {"p_partkey": 1, "x": "$m.x", "y": "$m.y"}}], "SELECT p_partkey, 7 AS x, p_brand AS y FROM part")
_pipeline("expr_literal", "part", [{"$project": {"p_partkey": 1, "v": {"$literal": "$p_size"}}}], "SELECT p_partkey, '$p_size' AS v FROM part")
_pipeline("expr_and_or_not", "part", [{"$project": {"p_partkey": 1, "v": {"$and": [{"$not": [{"$eq": ["$p_size", 1]}]}, {"$or": [{"$lt": ["$p_size", 10]}, {"$gt": ["$p_size", 40]}]}]}}}], "SELECT p_partkey, p_size <> 1 AND (p_size < 10 OR p_size > 40) AS v FROM part")

_BINS = {
    "second": ({"unit": "second", "binSize": 30}, "time_bucket(INTERVAL 30 SECOND, ts, TIMESTAMP '2000-01-01')"),
    "minute": ({"unit": "minute", "binSize": 5}, "time_bucket(INTERVAL 5 MINUTE, ts, TIMESTAMP '2000-01-01')"),
    "hour": ({"unit": "hour"}, "date_trunc('hour', ts)"),
    "day": ({"unit": "day"}, "date_trunc('day', ts)"),
    "week_sun": ({"unit": "week"}, "date_trunc('week', ts + INTERVAL 1 DAY) - INTERVAL 1 DAY"),
    "week_mon": ({"unit": "week", "startOfWeek": "monday"}, "date_trunc('week', ts)"),
    "day_bin": ({"unit": "day", "binSize": 10}, "time_bucket(INTERVAL 10 DAY, ts, TIMESTAMP '2000-01-01')"),
}
for _name, (_spec, _sql) in _BINS.items():
    _pipeline(f"date_trunc_{_name}", "events", [{"$group": {"_id": {"$dateTrunc": {"date": "$ts", **_spec}}, "n": {"$sum": 1}}}, {"$project": {"_id": 0, "bin": "$_id", "n": 1}}], f"SELECT CAST({_sql} AS TIMESTAMP) AS bin, count(*) AS n FROM events GROUP BY 1")
for _unit in ("month", "quarter", "year"):
    _pipeline(f"date_trunc_{_unit}", "orders", [{"$group": {"_id": {"$dateTrunc": {"date": "$o_orderdate", "unit": _unit}}, "n": {"$sum": 1}}}, {"$project": {"_id": 0, "bin": "$_id", "n": 1}}], f"SELECT CAST(date_trunc('{_unit}', o_orderdate) AS TIMESTAMP) AS bin, count(*) AS n FROM orders GROUP BY 1")

# ---- groups ----

FLAGSHIP = [
    {"$match": {"l_shipdate": {"$lte": _day(2001, 6, 30)}}},
    {"$group": {"_id": {"f": "$l_returnflag", "s": "$l_linestatus"}, "qty": {"$sum": "$l_quantity"}, "price": {"$sum": "$l_extendedprice"}, "avg_discount": {"$avg": "$l_discount"}, "n": {"$sum": 1}}},
    {"$sort": {"_id": 1}},
    {"$project": {"_id": 0, "flag": "$_id.f", "status": "$_id.s", "qty": 1, "price": 1, "avg_discount": 1, "n": 1}},
]
_pipeline("group_compound", "lineitem", FLAGSHIP, "SELECT l_returnflag AS flag, l_linestatus AS status, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice), 1) AS price, round(avg(l_discount), 6) AS avg_discount, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-06-30' GROUP BY 1, 2", {"qty": 2, "price": 1, "avg_discount": 6})
_pipeline("group_sum_avg_min_max", "lineitem", [{"$group": {"_id": "$l_suppkey", "total": {"$sum": "$l_quantity"}, "mean": {"$avg": "$l_quantity"}, "lo": {"$min": "$l_quantity"}, "hi": {"$max": "$l_quantity"}}}, {"$project": {"_id": 0, "supp": "$_id", "total": 1, "mean": 1, "lo": 1, "hi": 1}}], "SELECT l_suppkey AS supp, sum(l_quantity) AS total, round(avg(l_quantity), 6) AS mean, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY 1", {"mean": 6})


def _grouped(name: str, spec: Any, sql: str) -> None:
    """One order-dependent accumulator over a customer's orders; arrays are shown as JSON-like text."""
    many = not name.endswith(("first", "last"))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = aggregate(table(spark, sf_dir, "orders"), [{"$group": {"_id": "$o_custkey", "v": spec}}], order_by=["o_orderkey"])
        return out.withColumn("v", F.array_join("v", ",")) if many else out

    QUERIES[name] = run
    shown = f"array_to_string({sql}, ',')" if many else sql
    ORACLE_SQL[name] = f"SELECT o_custkey AS _id, {shown} AS v FROM orders GROUP BY 1"


_grouped("group_first", {"$first": "$o_orderstatus"}, "first(o_orderstatus ORDER BY o_orderkey)")
_grouped("group_last", {"$last": "$o_orderstatus"}, "last(o_orderstatus ORDER BY o_orderkey)")
_grouped("group_push", {"$push": "$o_orderstatus"}, "list(o_orderstatus ORDER BY o_orderkey)")
_grouped("group_first_n", {"$firstN": {"input": "$o_orderkey", "n": 3}}, "list(o_orderkey ORDER BY o_orderkey)[:3]")
_grouped("group_last_n", {"$lastN": {"input": "$o_orderkey", "n": 3}}, "list(o_orderkey ORDER BY o_orderkey)[-3:]")
_grouped("group_min_n", {"$minN": {"input": "$o_orderkey", "n": 2}}, "list(o_orderkey ORDER BY o_orderkey)[:2]")
_grouped("group_max_n", {"$maxN": {"input": "$o_orderkey", "n": 2}}, "list(o_orderkey ORDER BY o_orderkey DESC)[:2]")
_grouped("group_top_n", {"$topN": {"output": "$o_orderkey", "sortBy": {"o_totalprice": -1}, "n": 2}}, "list(o_orderkey ORDER BY o_totalprice DESC, o_orderkey)[:2]")
_grouped("group_bottom_n", {"$bottomN": {"output": "$o_orderkey", "sortBy": {"o_orderpriority": -1, "o_totalprice": 1}, "n": 2}}, "list(o_orderkey ORDER BY o_orderpriority DESC, o_totalprice, o_orderkey)[-2:]")
_pipeline("group_add_to_set", "orders", [{"$group": {"_id": "$o_custkey", "s": {"$addToSet": "$o_orderstatus"}}}, {"$unwind": "$s"}], "SELECT DISTINCT o_custkey AS _id, o_orderstatus AS s FROM orders", ordered=True)
_pipeline("group_merge_objects", "orders", [{"$group": {"_id": "$o_custkey", "m": {"$mergeObjects": {"k": "$o_orderkey", "s": "$o_orderstatus"}}}}, {"$project": {"_id": 1, "k": "$m.k", "s": "$m.s"}}], "SELECT o_custkey AS _id, max(o_orderkey) AS k, arg_max(o_orderstatus, o_orderkey) AS s FROM orders GROUP BY 1", ordered=True)
_pipeline("group_percentile", "lineitem", [{"$group": {"_id": "$l_returnflag", "p": {"$percentile": {"input": "$l_quantity", "p": [0.5, 0.95], "method": "approximate"}}}}, {"$unwind": {"path": "$p", "includeArrayIndex": "i"}}], "SELECT _id, p, i FROM (SELECT l_returnflag AS _id, unnest(quantile_cont(l_quantity, [0.5, 0.95])) AS p, unnest([CAST(0 AS BIGINT), 1]) AS i FROM lineitem GROUP BY 1)")
_pipeline("group_median", "orders", [{"$group": {"_id": "$o_orderpriority", "m": {"$median": {"input": "$o_totalprice", "method": "approximate"}}}}], "SELECT o_orderpriority AS _id, round(median(o_totalprice), 4) AS m FROM orders GROUP BY 1", {"m": 4})
_pipeline("sort_by_count", "part", [{"$sortByCount": "$p_brand"}], "SELECT p_brand AS _id, count(*) AS count FROM part GROUP BY 1")
_pipeline("count_stage", "orders", [{"$match": {"o_orderstatus": "P"}}, {"$count": "n"}], "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'P' HAVING count(*) > 0")


@_query("distinct_values", "SELECT DISTINCT o_orderpriority AS value FROM orders WHERE o_totalprice > 100000")
def distinct_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Collection(table(spark, sf_dir, "orders"), ["o_orderkey"]).distinct("o_orderpriority", {"o_totalprice": {"$gt": 100000}})


@_query("distinct_array", f"{_ARRAYS} SELECT DISTINCT unnest(tags) AS value FROM a")
def distinct_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Collection(_arrays(spark, sf_dir)).distinct("items.status")


@_query("count_documents", "SELECT count(*) AS n FROM orders WHERE o_orderstatus <> 'F'")
def count_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Collection(table(spark, sf_dir, "orders"), ["o_orderkey"]).count({"o_orderstatus": {"$ne": "F"}})


@_query("find_sorted", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5")
def find_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = Collection(table(spark, sf_dir, "orders"), ["o_orderkey"])
    return orders.find({"o_orderstatus": "O"}, {"o_orderkey": 1, "o_totalprice": 1}, {"o_totalprice": -1}, skip=5, limit=20)


@_query("find_collation", "SELECT p_partkey FROM part WHERE lower(p_type) = 'economy' AND lower(p_name) >= 'red'")
def find_collation(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = Collection(table(spark, sf_dir, "part"), ["p_partkey"])
    return part.find({"p_type": "Economy", "p_name": {"$gte": "RED"}}, {"p_partkey": 1}, collation={"locale": "en", "strength": 2})


# ---- order, arrays ----

_pipeline("sort_multi", "orders", [{"$sort": {"o_orderpriority": 1, "o_totalprice": -1}}, {"$limit": 50}, {"$project": {"o_orderkey": 1}}], "SELECT o_orderkey FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 50", ordered=True)
_pipeline("sort_limit", "lineitem", [{"$sort": {"l_extendedprice": -1, "l_orderkey": 1, "l_linenumber": 1, "l_partkey": 1}}, {"$limit": 25}, {"$project": {"l_orderkey": 1, "l_linenumber": 1, "l_extendedprice": 1}}], "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 25")
_pipeline("skip_limit", "customer", [{"$sort": {"c_acctbal": 1}}, {"$skip": 10}, {"$limit": 15}, {"$project": {"c_custkey": 1}}], "SELECT c_custkey FROM customer ORDER BY c_acctbal, c_custkey LIMIT 15 OFFSET 10", ordered=True)
_pipeline("unwind", "embeddings", [{"$unwind": "$embedding"}, {"$group": {"_id": "$label", "n": {"$sum": 1}, "hi": {"$max": "$embedding"}}}], "SELECT label AS _id, count(*) AS n, max(e) AS hi FROM (SELECT label, unnest(embedding) AS e FROM embeddings) GROUP BY 1")
_pipeline("unwind_index", "embeddings", [{"$unwind": {"path": "$embedding", "includeArrayIndex": "i"}}, {"$match": {"i": {"$lt": 3}}}, {"$project": {"vec_id": 1, "i": 1, "embedding": 1}}], "SELECT vec_id, i, embedding[i + 1] AS embedding FROM embeddings, (SELECT unnest([CAST(0 AS BIGINT), 1, 2]) AS i)")


@_query("unwind_preserve", "SELECT c_custkey, o_orderstatus AS tag FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 300000")
def unwind_preserve(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = [{"$match": {"o_totalprice": {"$gt": 300000}}}, {"$group": {"_id": "$o_custkey", "tags": {"$push": "$o_orderstatus"}}}]
    tags = aggregate(table(spark, sf_dir, "orders"), big, order_by=["o_orderkey"])
    rows = table(spark, sf_dir, "customer").join(tags, F.col("c_custkey") == F.col("_id"), "left").select("c_custkey", F.col("tags").alias("tag"))
    return aggregate(rows, [{"$unwind": {"path": "$tag", "preserveNullAndEmptyArrays": True}}])


# ---- joins, sets ----

_ORDERS = {"from": "orders", "localField": "c_custkey", "foreignField": "o_custkey", "as": "o"}
_NATION = {"from": "nation", "localField": "c_nationkey", "foreignField": "n_nationkey", "as": "n"}


@_query("lookup_equality", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def lookup_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = aggregate(table(spark, sf_dir, "customer"), [{"$lookup": _ORDERS}], _Tables(spark, sf_dir))
    return out.select("c_custkey", F.size("o").cast("long").alias("n"))


_pipeline("lookup_unwind_inner", "customer", [{"$lookup": _NATION}, {"$unwind": "$n"}, {"$project": {"_id": 0, "c_custkey": 1, "nation": "$n.n_name"}}], "SELECT c_custkey, n_name AS nation FROM customer JOIN nation ON n_nationkey = c_nationkey")
_pipeline("lookup_left", "customer", [{"$lookup": _ORDERS}, {"$unwind": {"path": "$o", "preserveNullAndEmptyArrays": True}}, {"$project": {"c_custkey": 1, "k": "$o.o_orderkey"}}], "SELECT c_custkey, o_orderkey AS k FROM customer LEFT JOIN orders ON o_custkey = c_custkey")
_pipeline("lookup_semi", "customer", [{"$lookup": _ORDERS}, {"$match": {"o": {"$ne": []}}}, {"$unset": "o"}, {"$project": {"c_custkey": 1}}], "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
_pipeline("lookup_anti", "customer", [{"$lookup": _ORDERS}, {"$match": {"o": {"$size": 0}}}, {"$project": {"c_custkey": 1}}], "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
_pipeline(
    "lookup_let_pipeline",
    "customer",
    [
        {"$lookup": {"from": "orders", "let": {"k": "$c_custkey"}, "pipeline": [{"$match": {"$expr": {"$eq": ["$o_custkey", "$$k"]}, "o_orderstatus": "F"}}, {"$sort": {"o_totalprice": -1, "o_orderkey": 1}}, {"$limit": 2}, {"$project": {"o_orderkey": 1}}], "as": "best"}},
        {"$unwind": "$best"},
        {"$project": {"c_custkey": 1, "k": "$best.o_orderkey"}},
    ],
    "SELECT o_custkey AS c_custkey, o_orderkey AS k FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2",
)
_pipeline(
    "lookup_theta",
    "nation",
    [{"$lookup": {"from": "region", "let": {"r": "$n_regionkey"}, "pipeline": [{"$match": {"$expr": {"$lt": ["$r_regionkey", "$$r"]}}}], "as": "r"}}, {"$unwind": "$r"}, {"$project": {"n_nationkey": 1, "r": "$r.r_regionkey"}}],
    "SELECT n_nationkey, r_regionkey AS r FROM nation JOIN region ON r_regionkey < n_regionkey",
)


@_query(
    "graph_lookup",
    """WITH RECURSIVE t AS (SELECT p_partkey AS id, p_partkey // 2 AS parent FROM part WHERE p_partkey > 0), w AS (
        SELECT id, parent AS a, 1 AS d FROM t UNION ALL SELECT w.id, t.parent, d + 1 FROM w JOIN t ON t.id = w.a WHERE d < 4)
    SELECT w.id, t.id AS ancestor FROM w JOIN t ON t.id = w.a""",
)
def graph_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to four ancestors of each part in the tree where a part's parent has half its number."""
    tree = table(spark, sf_dir, "part").where("p_partkey > 0").selectExpr("p_partkey AS id", "p_partkey div 2 AS parent")
    stage = {"$graphLookup": {"from": "tree", "startWith": "$parent", "connectFromField": "parent", "connectToField": "id", "as": "up", "maxDepth": 3}}
    return aggregate(tree, [stage, {"$unwind": "$up"}, {"$project": {"id": 1, "ancestor": "$up.id"}}], {"tree": tree})


_pipeline("union_with", "customer", [{"$project": {"name": "$c_name"}}, {"$unionWith": {"coll": "supplier", "pipeline": [{"$project": {"name": "$s_name"}}]}}], "SELECT c_name AS name FROM customer UNION ALL SELECT s_name FROM supplier")
_pipeline("union_with_plain", "region", [{"$unionWith": "nation"}], "SELECT r_regionkey, r_name, NULL::INTEGER AS n_nationkey, NULL::VARCHAR AS n_name, NULL::INTEGER AS n_regionkey FROM region UNION ALL SELECT NULL, NULL, n_nationkey, n_name, n_regionkey FROM nation")


@_query("facet", "SELECT 'status' AS facet, o_orderstatus AS key, count(*) AS n FROM orders GROUP BY ALL UNION ALL SELECT 'priority', o_orderpriority, count(*) FROM orders WHERE o_totalprice > 250000 GROUP BY ALL")
def facet(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = lambda f: {"$group": {"_id": f, "n": {"$sum": 1}}}
    out = aggregate(table(spark, sf_dir, "orders"), [{"$facet": {"status": [counted("$o_orderstatus")], "priority": [{"$match": {"o_totalprice": {"$gt": 250000}}}, counted("$o_orderpriority")]}}])
    parts = [out.select(F.lit(n).alias("facet"), F.inline(n)).withColumnRenamed("_id", "key") for n in ("status", "priority")]
    return parts[0].union(parts[1])


# ---- windows ----


def _window(name: str, definition: dict, sql: str, sort: dict | None = None) -> None:
    _pipeline(
        name,
        "orders",
        [{"$setWindowFields": {"partitionBy": "$o_custkey", "sortBy": sort or {"o_orderdate": 1, "o_orderkey": 1}, "output": {"w": definition}}}, {"$project": {"o_orderkey": 1, "w": 1}}],
        f"SELECT o_orderkey, {sql} AS w FROM orders",
    )


_OVER = "OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"
_window("window_shift_lag", {"$shift": {"output": "$o_totalprice", "by": -1, "default": 0.0}}, f"lag(o_totalprice, 1, 0.0) {_OVER}")
_window("window_shift_lead", {"$shift": {"output": "$o_orderstatus", "by": 2}}, f"lead(o_orderstatus, 2) {_OVER}")
_window("window_document_number", {"$documentNumber": {}}, f"row_number() {_OVER}")
_window("window_rank", {"$rank": {}}, "rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority)", {"o_orderpriority": 1})
_window("window_dense_rank", {"$denseRank": {}}, "dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority DESC)", {"o_orderpriority": -1})

# ---- writes ----


def _written(name: str, source: str, columns: list[str], change: Callable[[Collection], Collection], sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, source).select(*columns)
        return change(Collection(rows, _KEYS[source])).df

    QUERIES[name], ORACLE_SQL[name] = run, sql


_PART, _P = ["p_partkey", "p_brand", "p_size"], "p_partkey, p_brand, "
_written("update_set", "part", _PART, lambda c: c.update_many({"p_size": {"$lt": 10}}, {"$set": {"p_brand": "tiny"}}), "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'tiny' ELSE p_brand END AS p_brand, p_size FROM part")
_written("update_inc", "part", _PART, lambda c: c.update_many({"p_brand": "Brand#1"}, {"$inc": {"p_size": 5}}), f"SELECT {_P} p_size + CASE WHEN p_brand = 'Brand#1' THEN 5 ELSE 0 END AS p_size FROM part")
_written("update_min_max", "part", _PART, lambda c: c.update_many({}, {"$min": {"p_size": 30}}).update_many({}, {"$max": {"p_size": 5}}), f"SELECT {_P} greatest(least(p_size, 30), 5) AS p_size FROM part")
_written("update_unset", "part", _PART, lambda c: c.update_many({"p_size": {"$gt": 40}}, {"$unset": {"p_brand": ""}}), "SELECT p_partkey, CASE WHEN p_size > 40 THEN NULL ELSE p_brand END AS p_brand, p_size FROM part")
_written("update_one", "part", _PART, lambda c: c.update_one({"p_size": 7}, {"$set": {"p_brand": "first"}}), "SELECT p_partkey, CASE WHEN p_partkey = (SELECT min(p_partkey) FROM part WHERE p_size = 7) THEN 'first' ELSE p_brand END AS p_brand, p_size FROM part")
_written("update_pipeline", "part", _PART, lambda c: c.update_many({"p_size": {"$gte": 45}}, [{"$set": {"p_size": {"$subtract": ["$p_size", 45]}}}]), f"SELECT {_P} CASE WHEN p_size >= 45 THEN p_size - 45 ELSE p_size END AS p_size FROM part")
_written("upsert", "part", _PART, lambda c: c.update_one({"p_partkey": -1}, {"$set": {"p_size": 3}, "$setOnInsert": {"p_brand": "new"}}, upsert=True), f"SELECT {_P} p_size FROM part UNION ALL SELECT -1, 'new', 3")
_written("delete_many", "part", _PART, lambda c: c.delete_many({"p_size": {"$gte": 10}}), f"SELECT {_P} p_size FROM part WHERE p_size < 10")
_written("delete_one", "part", _PART, lambda c: c.delete_one({"p_brand": "Brand#3"}), f"SELECT {_P} p_size FROM part WHERE p_partkey IS DISTINCT FROM (SELECT min(p_partkey) FROM part WHERE p_brand = 'Brand#3')")
_written("bulk_write", "part", _PART, lambda c: c.bulk_write([{"updateMany": {"filter": {"p_size": 1}, "update": {"$set": {"p_size": 100}}}}, {"deleteMany": {"filter": {"p_size": {"$lt": 5}}}}]), f"SELECT {_P} CASE WHEN p_size = 1 THEN 100 ELSE p_size END AS p_size FROM part WHERE p_size = 1 OR p_size >= 5")
_written("ttl_prune", "events", ["event_id", "ts"], lambda c: Collection(Collection(c.df, c.order_by, now=F.lit("2024-01-20 00:00:00").cast("timestamp")).create_index(Index(["ts"], expire_after=432000)).live()), "SELECT event_id, ts FROM events WHERE ts + INTERVAL 432000 SECOND > TIMESTAMP '2024-01-20'")


@_query("update_add_to_set", f"{_ARRAYS} SELECT _id, unnest(CASE WHEN list_contains(tags, 'X') THEN tags ELSE list_append(tags, 'X') END) AS tag FROM a")
def update_add_to_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = Collection(_arrays(spark, sf_dir)).update_many({}, {"$addToSet": {"tags": "X"}})
    return out.df.select("_id", F.explode("tags").alias("tag"))


@_query("update_array_filters", f"{_ARRAYS} SELECT _id, i.price AS price, CASE WHEN i.price >= 400000 THEN 'X' ELSE i.status END AS status FROM (SELECT _id, unnest(items) AS i FROM a)")
def update_array_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = Collection(_arrays(spark, sf_dir)).update_many({}, {"$set": {"items.$[e].status": "X"}}, [{"e.price": {"$gte": 400000}}])
    return out.df.select("_id", F.inline("items"))


@_query("out_stage", "SELECT o_custkey AS _id, count(*) AS n FROM orders GROUP BY 1")
def out_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Collection(table(spark, sf_dir, "orders"), ["o_orderkey"]).out([{"$group": {"_id": "$o_custkey", "n": {"$sum": 1}}}])


@_query("merge_stage", "SELECT coalesce(c_custkey, o_custkey) AS _id, c_name AS name, n FROM customer FULL JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def merge_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("_id"), F.col("c_name").alias("name"))
    return Collection(table(spark, sf_dir, "orders"), ["o_orderkey"]).merge_into(target, [{"$group": {"_id": "$o_custkey", "n": {"$sum": 1}}}])


@_query("insert_union", "SELECT s_suppkey AS _id, s_name AS name FROM supplier UNION ALL SELECT -1 - s_suppkey, 'copy' FROM supplier")
def insert_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("_id"), F.col("s_name").alias("name"))
    return updates.insert(rows, rows.select((-1 - F.col("_id")).alias("_id"), F.lit("copy").alias("name")))


# ---- data quality ----


@_query("sanitize_hash", "SELECT c_custkey, 'sha256:' || sha256('seed::' || c_name) AS c_name, c_mktsegment FROM customer")
def sanitize_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    return fixtures.sanitize(rows, [{"path": "c_name", "action": "hash"}, {"path": "c_acctbal", "action": "drop"}], "seed")


@_query("sanitize_token", "SELECT c_custkey, 'tok_' || left(sha256('seed::token::' || c_name), 16) AS c_name, NULL::VARCHAR AS c_mktsegment FROM customer")
def sanitize_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    return fixtures.sanitize(rows, [{"path": "c_name", "action": "tokenize"}, {"path": "c_mktsegment", "action": "nullify"}], "seed", volatile=["c_acctbal"])


@_query("sanitize_fake", "SELECT c_custkey, 'email-fake-' || left(sha256('seed::fake::' || c_name), 12) AS c_name FROM customer")
def sanitize_fake(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return fixtures.sanitize(rows, [{"path": "c_name", "action": "fake", "fakeType": "EMAIL"}], "seed")


@_query(
    "pii_lint",
    r"""SELECT doc_id, type, sample FROM (
        SELECT doc_id, 'email' AS type, regexp_extract(text, '(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}', 0) AS sample FROM documents
        UNION ALL SELECT doc_id, 'phone', regexp_extract(text, '\+?\d[\d\-\s]{7,}\d', 0) FROM documents
        UNION ALL SELECT doc_id, 'ssn', regexp_extract(text, '\b\d{3}-\d{2}-\d{4}\b', 0) FROM documents) WHERE sample <> ''""",
)
def pii_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.pii_lint(table(spark, sf_dir, "documents").select("doc_id", "text"), "text").drop("text")


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The parts, and a later version of them: some are gone, some are new, some changed."""
    before = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("_id"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"))
    kept = before.where("_id % 10 <> 0").withColumn("size", F.expr("CASE WHEN _id % 7 = 0 THEN size + 1 ELSE size END")).withColumn("brand", F.expr("CASE WHEN _id % 91 <> 0 THEN brand END"))
    return before, kept.unionByName(before.where("_id % 20 = 5").select((-F.col("_id")).alias("_id"), "brand", "size"))


_VERSIONS = """WITH x AS (SELECT p_partkey AS _id, p_brand AS brand, p_size AS size FROM part), y AS (
    SELECT _id, CASE WHEN _id % 91 <> 0 THEN brand END AS brand, CASE WHEN _id % 7 = 0 THEN size + 1 ELSE size END AS size FROM x WHERE _id % 10 <> 0
    UNION ALL SELECT -_id, brand, size FROM x WHERE _id % 20 = 5) """


@_query("keyed_diff", _VERSIONS + "SELECT coalesce(x._id, y._id) AS _id, CASE WHEN x._id IS NULL THEN 'added' WHEN y._id IS NULL THEN 'removed' WHEN x.brand IS NOT DISTINCT FROM y.brand AND x.size = y.size THEN 'unchanged' ELSE 'changed' END AS status, x._id IS NOT NULL AND y._id IS NOT NULL AND x.brand IS NOT NULL AND y.brand IS NULL AS field_drop FROM x FULL JOIN y ON x._id = y._id")
def keyed_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.keyed_diff(*_versions(spark, sf_dir))


@_query("diff_incremental", _VERSIONS + "SELECT y.* FROM y LEFT JOIN x ON x._id = y._id WHERE x._id IS NULL OR x.brand IS DISTINCT FROM y.brand OR x.size <> y.size")
def diff_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.incremental(*_versions(spark, sf_dir))


@_query(
    "drift_fields",
    _VERSIONS
    + """, v AS (SELECT 'x' AS t, unnest(['_id', 'brand', 'size']) AS field, unnest([_id::VARCHAR, brand, size::VARCHAR]) AS value FROM x
        UNION ALL SELECT 'y', unnest(['_id', 'brand', 'size']), unnest([_id::VARCHAR, brand, size::VARCHAR]) FROM y),
    c AS (SELECT field, value, count(*) FILTER (t = 'x') AS a, count(*) FILTER (t = 'y') AS b FROM v GROUP BY ALL),
    s AS (SELECT field, sum(a) FILTER (value IS NOT NULL) AS xt, sum(b) FILTER (value IS NOT NULL) AS yt, coalesce(sum(a) FILTER (value IS NULL), 0) AS xn, coalesce(sum(b) FILTER (value IS NULL), 0) AS yn,
        count(*) FILTER (value IS NOT NULL AND a > 0) AS xc, count(*) FILTER (value IS NOT NULL AND b > 0) AS yc FROM c GROUP BY 1)
    SELECT s.field, round(abs(round(yn / (yn + yt), 4) - round(xn / (xn + xt), 4)), 4) AS null_delta, round(abs(yc - xc) / greatest(1, xc), 4) AS cardinality_delta,
        round((SELECT sum(abs(a / xt - b / yt)) / 2 FROM c WHERE c.field = s.field AND value IS NOT NULL), 4) AS distribution_delta FROM s""",
)
def drift_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.drift(*_versions(spark, sf_dir))


@_query("extract_plan", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def extract_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.extract(table(spark, sf_dir, "orders"), {"filter": {"o_orderstatus": "F"}, "projection": {"o_orderkey": 1, "o_totalprice": 1}, "sort": {"o_totalprice": -1, "o_orderkey": 1}, "limit": 100})


@_query("restore_merge", "SELECT s_suppkey AS _id, CASE WHEN s_suppkey % 2 = 0 THEN 'restored' ELSE s_name END AS name FROM supplier")
def restore_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("_id"), F.col("s_name").alias("name"))
    return fixtures.restore(rows, rows.where("_id % 2 = 0").withColumn("name", F.lit("restored")), "MERGE")


@_query("match_variant", "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS INTEGER) >= 50")
def match_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter on a field of mixed-shape documents, by way of VARIANT."""
    doc = F.parse_json("props")
    typed = table(spark, sf_dir, "events").select("event_id", F.try_variant_get(doc, "$.k", "int").alias("k"))
    return aggregate(typed, [{"$match": {"k": {"$gte": 50}}}])


# ---- more reads ----

_pipeline("expr_root", "customer", [{"$project": {"c_custkey": 1, "doc": "$$ROOT", "same": "$$CURRENT.c_name"}}, {"$project": {"c_custkey": 1, "same": 1, "name": "$doc.c_name", "nation": "$doc.c_nationkey"}}], "SELECT c_custkey, c_name AS same, c_name AS name, c_nationkey AS nation FROM customer")
_pipeline("expr_array", "part", [{"$project": {"p_partkey": 1, "a": ["$p_size", {"$add": ["$p_size", 1]}, 7]}}, {"$unwind": {"path": "$a", "includeArrayIndex": "i"}}], "SELECT p_partkey, unnest([p_size, p_size + 1, 7]) AS a, unnest([0, 1, 2]) AS i FROM part")
_find("match_expr_not", "part", {"$expr": {"$not": [{"$or": [{"$eq": ["$p_brand", {"$literal": "Brand#11"}]}, {"$gt": ["$p_size", 20]}]}]}}, "NOT (p_brand = 'Brand#11' OR p_size > 20)", "p_partkey")
_pipeline("lookup_nested", "customer", [{"$match": {"c_custkey": {"$lte": 100}}}, {"$lookup": {"from": "nation", "let": {"n": "$c_nationkey"}, "pipeline": [{"$match": {"$expr": {"$eq": ["$n_nationkey", "$$n"]}}}, {"$lookup": {"from": "region", "localField": "n_regionkey", "foreignField": "r_regionkey", "as": "r"}}, {"$unwind": "$r"}, {"$project": {"n_name": 1, "region": "$r.r_name"}}], "as": "n"}}, {"$unwind": "$n"}, {"$project": {"c_custkey": 1, "nation": "$n.n_name", "region": "$n.region"}}], "SELECT c_custkey, n_name AS nation, r_name AS region FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE c_custkey <= 100")
_pipeline("lookup_sort_by_count", "nation", [{"$lookup": {"from": "customer", "let": {"n": "$n_nationkey"}, "pipeline": [{"$match": {"$expr": {"$eq": ["$c_nationkey", "$$n"]}}}, {"$sortByCount": "$c_mktsegment"}, {"$limit": 1}], "as": "top"}}, {"$unwind": "$top"}, {"$project": {"n_nationkey": 1, "segment": "$top._id", "n": "$top.count"}}], "SELECT n_nationkey, segment, n FROM (SELECT n_nationkey, c_mktsegment AS segment, count(*) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY n_nationkey ORDER BY n DESC, segment) = 1")


def _orders(spark: SparkSession, sf_dir: str) -> Collection:
    return Collection(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), ["o_orderkey"])


_DEAREST = "(SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 1)"


@_query("find_one", f"SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey = {_DEAREST}")
def find_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _orders(spark, sf_dir)
    return spark.createDataFrame([orders.find_one({"o_orderstatus": "F"}, sort={"o_totalprice": -1})], orders.df.schema)


@_query("find_one_and_delete", f"SELECT o_orderkey FROM orders WHERE o_orderkey <> {_DEAREST}")
def find_one_and_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).find_one_and_delete({"o_orderstatus": "F"}, sort={"o_totalprice": -1})[1].df.select("o_orderkey")


@_query("find_one_and_update", f"SELECT o_orderkey, CASE WHEN o_orderkey = {_DEAREST} THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def find_one_and_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    row, then = _orders(spark, sf_dir).find_one_and_update({"o_orderstatus": "F"}, {"$set": {"o_orderstatus": "X"}}, sort={"o_totalprice": -1}, new=True, fields={"o_orderstatus": 1})
    if row is None or row.asDict() != {"o_orderstatus": "X"}:
        raise ValueError(f"the row is {row}")
    return then.df.select("o_orderkey", "o_orderstatus")


@_query("find_one_and_replace", "SELECT s_suppkey, CASE WHEN s_suppkey = 3 THEN 'new' ELSE s_name END AS s_name, CASE WHEN s_suppkey <> 3 THEN s_acctbal END AS s_acctbal FROM supplier UNION ALL SELECT -1, 'added', NULL")
def find_one_and_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    _, then = Collection(rows, ["s_suppkey"]).find_one_and_replace({"s_suppkey": 3}, {"s_suppkey": 3, "s_name": "new"})
    return then.find_one_and_replace({"s_suppkey": -1}, {"s_suppkey": -1, "s_name": "added"}, upsert=True)[1].df


@_query("estimated_count", "SELECT count(*) AS n FROM lineitem")
def estimated_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Collection(table(spark, sf_dir, "lineitem"), ["l_orderkey"]).estimated_count()


@_query("find_let", "SELECT o_orderkey FROM orders WHERE o_totalprice > 250000")
def find_let(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).find({"$expr": {"$gt": ["$o_totalprice", "$$least"]}}, {"_id": 0, "o_orderkey": 1}, let={"least": 250000})


@_query("aggregate_collation", "SELECT lower(p_brand) AS brand, count(*) AS n FROM part WHERE lower(p_brand) >= 'brand#3' GROUP BY 1")
def aggregate_collation(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = Collection(table(spark, sf_dir, "part"), ["p_partkey"])
    out = part.aggregate([{"$match": {"p_brand": {"$gte": "BRAND#3"}}}, {"$group": {"_id": "$p_brand", "n": {"$sum": 1}}}], collation={"locale": "en", "strength": 2})
    return out.select(F.lower(F.collate("_id", "UTF8_BINARY")).alias("brand"), "n")


@_query("pipeline_out", "SELECT c_nationkey AS _id, count(*) AS n FROM customer GROUP BY 1")
def pipeline_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Collection(table(spark, sf_dir, "customer"), ["c_custkey"]).aggregate([{"$group": {"_id": "$c_nationkey", "n": {"$sum": 1}}}, {"$out": "counts"}])


@_query("pipeline_merge", "SELECT n_nationkey AS _id, n_name AS name, n FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) ON c_nationkey = n_nationkey")
def pipeline_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("_id"), F.col("n_name").alias("name"))
    customers = Collection(table(spark, sf_dir, "customer").withColumn("c_nationkey", F.col("c_nationkey").cast("long")), ["c_custkey"], collections={"nations": nations})
    return customers.aggregate([{"$group": {"_id": "$c_nationkey", "n": {"$sum": 1}}}, {"$merge": {"into": "nations", "on": "_id"}}])


# ---- more writes ----


@_query("replace_one", "SELECT s_suppkey, CASE WHEN s_suppkey = 2 THEN 'replaced' ELSE s_name END AS s_name, CASE WHEN s_suppkey <> 2 THEN s_acctbal END AS s_acctbal FROM supplier")
def replace_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    return Collection(rows, ["s_suppkey"]).replace_one({"s_suppkey": 2}, {"s_suppkey": 2, "s_name": "replaced"}).df


@_query("update_order", "SELECT p_partkey, p_size + 1 AS p_size, least(p_retailprice, 1000.0) AS p_retailprice, 'set' AS p_brand, NULL::VARCHAR AS p_name FROM part")
def update_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several operators in one update, named in another order than they apply in."""
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice", "p_brand", "p_name")
    return Collection(rows, ["p_partkey"]).update_many({}, {"$unset": {"p_name": 1}, "$min": {"p_retailprice": 1000.0}, "$inc": {"p_size": 1}, "$set": {"p_brand": "set"}}).df


@_query("update_one_tie", "SELECT o_orderstatus, count(*) - CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS n FROM orders GROUP BY 1 UNION ALL SELECT 'X', 1")
def update_one_tie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row changes, though many are equal in the arrival order."""
    orders = Collection(_orders(spark, sf_dir).df, ["o_orderstatus"]).update_one({"o_orderstatus": "F"}, {"$set": {"o_orderstatus": "X"}})
    return orders.df.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@_query("update_array_filters_deep", f"{_ARRAYS} SELECT _id, i.price AS price, CASE WHEN i.price >= 400000 THEN 'X' ELSE i.status END AS code, CASE WHEN i.price >= 400000 THEN 1 END AS seen FROM (SELECT _id, unnest(items) AS i FROM a)")
def update_array_filters_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = aggregate(_arrays(spark, sf_dir), [{"$unset": "tags"}]).withColumn("items", F.transform("items", lambda x: F.struct(x["price"].alias("price"), F.struct(x["status"].alias("code")).alias("sub"))))
    out = Collection(nested).update_many({}, {"$set": {"items.$[e].sub.code": "X", "items.$[e].sub.seen": 1}}, [{"e.price": {"$gte": 400000}}])
    return out.df.select("_id", F.inline("items")).select("_id", "price", "sub.code", "sub.seen")


@_query(
    "bulk_result",
    "SELECT 1 AS inserted, (SELECT count(*) FROM supplier WHERE s_suppkey > 5) + 2 AS matched, (SELECT count(*) FROM supplier WHERE s_suppkey > 5) + 1 AS modified, (SELECT count(*) FROM supplier WHERE s_suppkey = 4) AS deleted, 1 AS upserted, 1 AS errors, (SELECT count(*) FROM supplier) + 1 AS n",
)
def bulk_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("_id"), F.col("s_name").alias("name"), F.lit(0).alias("seen"))
    then, counts = Collection(rows).bulk_result(
        [
            {"insertOne": {"document": {"_id": -1, "name": "new"}}},
            {"updateMany": {"filter": {"_id": {"$gt": 5}}, "update": {"$inc": {"seen": 1}}}},
            {"updateOne": {"filter": {"_id": 1}, "update": {"$set": {"seen": 0}}}},
            {"replaceOne": {"filter": {"_id": 2}, "replacement": {"name": "other"}}},
            {"deleteOne": {"filter": {"_id": 4}}},
            {"updateOne": {"filter": {"_id": -7}, "update": {"$set": {"name": "upserted"}}, "upsert": True}},
            {"insertOne": {"document": {"_id": 1, "name": "again"}}},
            {"deleteMany": {"filter": {}}},
        ]
    )
    return spark.range(1).select(*[F.lit(v if k != "errors" else len(v)).cast("long").alias(k) for k, v in counts.items()], F.lit(then.df.count()).alias("n"))


@_query("insert_ids", "SELECT count(*) * 2 AS n, count(*) * 2 AS ids, 24 AS digits FROM supplier")
def insert_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without _id get one each."""
    rows = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"))
    both = Collection(updates.with_ids(rows, rows)).insert(rows).df
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("_id").alias("ids"), F.max(F.length("_id")).alias("digits"))


@_query("create_index", "SELECT s_suppkey AS _id, s_name AS name FROM supplier UNION ALL SELECT -1 - s_suppkey, NULL FROM supplier")
def create_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A unique sparse index on name, which rows without a name pass, and a partial one."""
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("_id"), F.col("s_name").alias("name"))
    held = Collection(rows).create_index(Index(["name"], unique=True, sparse=True)).create_index(Index(["name"], unique=True, partial={"_id": {"$gt": 0}}))
    return held.insert(rows.select((-1 - F.col("_id")).alias("_id"), F.lit(None).cast("string").alias("name"))).df


# ---- more data quality, files ----


@_query(
    "sanitize_fake_more",
    """WITH h AS (SELECT c_custkey, sha256('seed::fake::' || c_name) AS a, sha256('seed::fake::' || c_mktsegment) AS b FROM customer),
    g AS (SELECT *, substr(repeat(regexp_replace(a, '[a-f]', '', 'g'), 10), 1, 10) AS d,
        [CAST(list_reduce(list_prepend(0::BIGINT, list_transform(string_split(t, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (h * 31 + c) % 4294967296) AS BIGINT) for t in [b, b || 'x']] AS k FROM h),
    n AS (SELECT *, list_transform(k, lambda x: abs(CASE WHEN x >= 2147483648 THEN x - 4294967296 ELSE x END) % 8 + 1) AS j FROM g)
    SELECT c_custkey, '+1-555-' || substr(d, 1, 3) || '-' || substr(d, 4, 7) AS c_name, ['Alex', 'Casey', 'Jordan', 'Taylor', 'Morgan', 'Riley', 'Avery', 'Parker'][j[1]] || ' ' || ['Kim', 'Lee', 'Park', 'Choi', 'Jung', 'Han', 'Seo', 'Kang'][j[2]] AS c_mktsegment FROM n""",
)
def sanitize_fake_more(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal", "c_nationkey")
    return fixtures.sanitize(rows, [{"path": "c_name", "action": "fake", "fakeType": "phone"}, {"path": "c_mktsegment", "action": "fake", "fakeType": "name"}, {"path": "c_acctbal", "action": "drop"}], "seed", volatile=["c_nationkey"])


@_query("canonical_json", """SELECT '{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || ',"nothing":null}' AS value FROM nation""")
def canonical_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.canonical_json(table(spark, sf_dir, "nation").select(F.lit(None).cast("string").alias("nothing"), "n_regionkey", "n_nationkey", "n_name"))


@_query("ndjson_round_trip", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def ndjson_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    path = tables.new_path(spark, "ndjson")
    tables.write_ndjson(rows, path)
    return tables.read_ndjson(spark, path, rows.schema)


@_query("bundle_round_trip", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def bundle_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bundle whose fast copy is spoiled: the portable one is read."""
    path = tables.new_path(spark, "bundle")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    tables.write_bundle({"app.supplier": rows}, path, "1")
    rows.limit(1).write.mode("overwrite").parquet(f"{path}/fast/app.supplier")
    return tables.read_bundle(spark, path, "1")["app.supplier"]


_DIFF = "d AS (SELECT CASE WHEN x._id IS NULL THEN 'added' WHEN y._id IS NULL THEN 'removed' WHEN x.brand IS NOT DISTINCT FROM y.brand AND x.size = y.size THEN 'unchanged' ELSE 'changed' END AS status, x._id IS NOT NULL AND y._id IS NOT NULL AND x.brand IS NOT NULL AND y.brand IS NULL AS dropped FROM x FULL JOIN y ON x._id = y._id) "


@_query("diff_summary", f"{_VERSIONS}, {_DIFF} SELECT count(*) FILTER (status = 'added') AS added, count(*) FILTER (status = 'removed') AS removed, count(*) FILTER (status = 'changed') AS changed, count(*) FILTER (status = 'unchanged') AS unchanged, bool_or(status = 'removed' OR dropped) AS requires_approval FROM d")
def diff_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.diff_summary(*_versions(spark, sf_dir))


@_query(
    "drift_score",
    f"""WITH f AS ({ORACLE_SQL["drift_fields"]}), r AS ({_VERSIONS} SELECT round(abs((SELECT count(*) FROM y) - count(*)) / greatest(1, count(*)), 4) AS row_delta FROM x),
    m AS (SELECT row_delta, round(avg(null_delta), 4) AS avg_null, round(avg(cardinality_delta), 4) AS avg_cardinality, round(max(distribution_delta), 4) AS max_distribution FROM f, r GROUP BY row_delta),
    s AS (SELECT *, round(row_delta * 0.4 + avg_null * 0.2 + avg_cardinality * 0.2 + max_distribution * 0.2, 4) AS score FROM m)
    SELECT *, CASE WHEN score >= 0.3 THEN 'FAIL' WHEN score >= 0.15 THEN 'WARN' ELSE 'OK' END AS status FROM s""",
)
def drift_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.drift_score(*_versions(spark, sf_dir))


@_query("schema_hash", "SELECT sha256('app.part\nbrand\nid\ndocs=' || (SELECT count(*) FROM part) || '\napp.supplier\ns_name\ns_suppkey\ndocs=' || (SELECT count(*) FROM supplier) || '\n') AS hash".replace("\n", "' || chr(10) || '"))
def schema_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"), F.lit(None).cast("int").alias("none"))
    return fixtures.schema_hash({"app.supplier": table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), "app.part": part})


@_query("schema_signatures", "SELECT CASE WHEN p_size > 25 THEN 'p_brand,p_partkey' ELSE 'p_partkey' END AS keys, count(*) AS n FROM part GROUP BY 1")
def schema_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.schema_signatures(table(spark, sf_dir, "part").select("p_partkey", F.expr("CASE WHEN p_size > 25 THEN p_brand END AS p_brand")))


@_query("nearest_rank", "SELECT l_returnflag, p, v[greatest(1, CAST(ceil(len(v) * p) AS BIGINT))] AS value FROM (SELECT l_returnflag, list_sort(list(l_extendedprice)) AS v FROM lineitem GROUP BY 1), (SELECT unnest([0.0::DOUBLE, 0.5, 0.95, 1.0]) AS p)")
def nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.nearest_rank(table(spark, sf_dir, "lineitem"), "l_extendedprice", [0.0, 0.5, 0.95, 1.0], by=["l_returnflag"])
