"""Filters: corners of the semantics, and typical query patterns over small documents."""

from __future__ import annotations

import re

import pytest

from docspark.errors import BadValue, Unsupported
from docspark.plans.pipeline import aggregate

ITEMS = "array<struct<sku:string,qty:int>>"
CASES = [
    ("_id int, profile struct<city:string,tier:string>, active boolean, tags array<string>", [(1, ("Seoul", "g"), True, ["x"]), (2, ("Busan", "g"), True, ["ops"]), (3, ("Seoul", "s"), False, ["ops"]), (4, ("Seoul", "s"), False, [])], {"$and": [{"profile.city": "Seoul"}, {"$or": [{"active": True}, {"tags": "ops"}]}]}, [1, 3]),
    ("_id int, status string, score int, segment string", [(1, "on", 60, "a"), (2, "disabled", 90, "a"), (3, "on", 10, "a"), (4, "on", 70, "internal")], {"$and": [{"$nor": [{"status": "disabled"}, {"score": {"$lt": 50}}]}, {"segment": {"$not": {"$eq": "internal"}}}]}, [1]),
    ("_id int, scores array<int>", [(1, [4, 20]), (2, [8]), (3, [1, 9])], {"scores": {"$elemMatch": {"$gte": 4, "$lt": 9}}}, [1, 2]),
    (f"_id int, items {ITEMS}", [(1, [("A", 2), ("B", 1)]), (2, [("A", 1)]), (3, None)], {"items": {"$all": [{"$elemMatch": {"sku": "A", "qty": {"$gte": 2}}}]}}, [1]),
    (f"_id int, orders array<struct<id:int,lines:{ITEMS}>>", [(1, [(1, [("C", 1)]), (2, [("D", 7)])]), (2, [(3, [("C", 2)])])], {"orders.lines.sku": "C", "orders.lines.qty": {"$gte": 5}}, [1]),
    ("_id int, routes array<struct<region:string,weight:int>>", [(1, [("apac", 1), ("emea", 2)]), (2, [("emea", 1), ("apac", 2)])], {"routes.0.region": "apac"}, [1]),
    ("_id int, samples array<int>", [(1, [1, 9]), (2, [9, 1]), (3, [9])], {"samples.1": {"$gt": 7}}, [1]),
    ("_id int, price int, cost int", [(1, 5, 3), (2, 3, 5), (3, None, 5)], {"$expr": {"$gt": ["$price", "$cost"]}}, [1]),
    ("_id int, active boolean, qty int, tier string", [(1, True, 3, "s"), (2, True, 1, "gold"), (3, False, 9, "gold"), (4, True, 1, "s")], {"$expr": {"$and": ["$active", {"$or": [{"$gt": ["$qty", 2]}, {"$eq": ["$tier", "gold"]}]}]}}, [1, 2]),
    ("_id int, metrics array<int>", [(1, [5, 2]), (2, [1])], {"$expr": {"$eq": ["$metrics.0", 5]}}, []),
    ("_id int, name string, status string", [(1, "Alice", "on"), (2, "ALIna", "inactive"), (3, "Bob", "on")], {"name": re.compile("^ali", re.I), "status": {"$ne": "inactive"}}, [1]),
    ("_id int, region string, profile struct<nickname:string>", [(1, "apac", ("x",)), (2, "emea", (None,)), (3, "us", (None,))], {"profile.nickname": {"$exists": False}, "region": {"$in": ["apac", "emea"]}}, [2]),
    ("_id int, tags array<string>, n int", [(1, ["a", "b"], 1), (2, ["a"], 1)], {"tags": {"$size": 2}, "n": {"$type": "int"}}, [1]),
    (f"_id int, items {ITEMS}", [(1, [("X", 6)]), (2, [("X", 1), ("Y", 9)])], {"items.qty": {"$gte": 5}, "items": {"$elemMatch": {"sku": "X", "qty": {"$gte": 5}}}}, [1]),
    ("_id int, qty int", [(1, 4), (2, 5), (3, None)], {"qty": {"$mod": [2, 0]}}, [1]),
    ("_id int, price int, tax int", [(1, 100, 20), (2, 100, 21)], {"$expr": {"$eq": [{"$add": ["$price", "$tax"]}, 120]}}, [1]),
    ("_id int, flags int", [(1, 3), (2, 2)], {"flags": {"$bitsAllSet": 1}}, [1]),
    # null and missing
    ("_id int, v int", [(1, 1), (2, None)], {"v": {"$ne": 1}}, [2]),
    ("_id int, v int", [(1, 1), (2, None)], {"v": None}, [2]),
    ("_id int, v int", [(1, 1), (2, None)], {"v": {"$nin": [1, None]}}, [2]),
    ("_id int, v int", [(1, 1), (2, None)], {"v": {"$in": [None]}}, [2]),
    ("_id int, v int", [(1, 1), (2, None)], {"v": {"$not": {"$gt": 5}}}, [1, 2]),
    ("_id int, v int", [(1, 1), (2, None)], {"w": None}, [1, 2]),
    ("_id int, v int", [(1, 1), (2, 2)], {"$or": []}, []),
    ("_id int, v int", [(1, 1), (2, 2)], {"$and": []}, [1, 2]),
    ("_id int, v int", [(1, 1), (2, 2)], {"v": {"$gt": "a"}}, []),
    ("_id int, v array<int>", [(1, [1]), (2, []), (3, None)], {"v": {"$all": []}}, [1, 2]),
    ("_id int, v array<int>", [(1, [1, 2]), (2, [2, 1])], {"v": [1, 2]}, [1]),
    ("_id int, v array<int>", [(1, [1, None]), (2, [2])], {"v": None}, [1]),
    ("_id int, d struct<a:int,b:int>", [(1, (1, 2)), (2, (1, None))], {"d": {"b": 2, "a": 1}}, [1]),
    ("_id int, d struct<a:int,b:int>", [(1, (1, 2)), (2, (1, None))], {"d": {"a": 1}}, [2]),
]


@pytest.mark.parametrize("schema,rows,filter_,wanted", CASES)
def test_filter(spark, schema, rows, filter_, wanted):
    df = spark.createDataFrame(rows, schema)
    assert sorted(r._id for r in aggregate(df, [{"$match": filter_}]).collect()) == wanted


@pytest.mark.parametrize("filter_,error", [({"v": {"$near": 1}}, Unsupported), ({"$where": "x"}, Unsupported), ({"v": {"$size": -1}}, BadValue), ({"v": {"$mod": [0, 1]}}, BadValue), ({"v": {"$options": "i"}}, BadValue), ({"v": {"$exists": 1}}, BadValue), ({"$expr": {"$cond": [1, 2, 3]}}, Unsupported)])
def test_refused(spark, filter_, error):
    with pytest.raises(error):
        aggregate(spark.createDataFrame([(1,)], "v int"), [{"$match": filter_}])


def test_pushdown(spark, sf):
    df = spark.read.parquet(f"{sf}/lineitem.parquet")
    out = aggregate(df, [{"$match": {"l_quantity": {"$gt": 10}}}, {"$project": {"l_orderkey": 1}}])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,10" in plan and "l_comment" not in plan and "l_tax" not in plan
