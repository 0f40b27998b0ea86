"""Stages, accumulators, windows, joins, writes and data-quality jobs on small documents."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from docspark.errors import BadValue, DuplicateKey, ImmutableField, Unsupported
from docspark.functions.canonical import canonical
from docspark.operators import fixtures
from docspark.operators.updates import merge
from docspark.plans.collection import Collection, Index
from docspark.plans.pipeline import aggregate
from docspark.sources.tables import read_ndjson, read_variant, write_ndjson


def out(df):
    return [r.asDict(True) for r in df.collect()]


@pytest.fixture
def people(spark):
    return spark.createDataFrame([(1, "A", 10), (2, "B", 30), (3, "C", 20), (4, "D", 40)], "_id int, name string, score int")


def test_accumulators(people):
    got = out(aggregate(people, [{"$group": {"_id": None, "p": {"$percentile": {"input": "$score", "p": [0.5, 0.95], "method": "approximate"}}, "m": {"$median": {"input": "$score", "method": "approximate"}}, "f": {"$firstN": {"input": "$name", "n": 2}}, "l": {"$lastN": {"input": "$name", "n": 2}}, "lo": {"$minN": {"input": "$score", "n": 2}}, "hi": {"$maxN": {"input": "$score", "n": 2}}, "t": {"$topN": {"output": "$name", "sortBy": {"score": -1}, "n": 2}}, "b": {"$bottomN": {"output": "$name", "sortBy": {"score": -1}, "n": 2}}}}], order_by=["_id"]))
    assert got == [{"_id": None, "p": [25.0, 38.5], "m": 25.0, "f": ["A", "B"], "l": ["C", "D"], "lo": [10, 20], "hi": [40, 30], "t": ["D", "B"], "b": ["C", "A"]}]


def test_group_over_missing_values(spark):
    df = spark.createDataFrame([(1, "e", 10.0, (1, None)), (2, "e", 30.0, (3, 2)), (3, "e", None, None)], "n int, event string, d double, labels struct<a:int,b:int>")
    got = out(aggregate(df, [{"$group": {"_id": {"e": "$event"}, "n": {"$sum": 1}, "s": {"$sum": "$d"}, "a": {"$avg": "$d"}, "f": {"$first": "$d"}, "l": {"$last": "$d"}, "p": {"$push": "$d"}, "m": {"$mergeObjects": "$labels"}, "z": {"$addToSet": "$d"}}}], order_by=["n"]))
    assert got == [{"_id": {"e": "e"}, "n": 3, "s": 40.0, "a": 20.0, "f": 10.0, "l": None, "p": [10.0, 30.0, None], "m": {"a": 3, "b": 2}, "z": [10.0, 30.0, None]}]


def test_unwind(spark):
    df = spark.createDataFrame([(1, [7, 8]), (2, []), (3, None)], "_id int, tags array<int>")
    kept = out(aggregate(df, [{"$unwind": {"path": "$tags", "preserveNullAndEmptyArrays": True, "includeArrayIndex": "i"}}]))
    assert [(r["_id"], r["tags"], r["i"]) for r in kept] == [(1, 7, 0), (1, 8, 1), (2, None, None), (3, None, None)]
    assert [r["tags"] for r in out(aggregate(df, [{"$unwind": "$tags"}]))] == [7, 8]
    assert len(out(aggregate(df, [{"$unwind": "$_id"}]))) == 3


def test_project_and_count(people):
    assert aggregate(people, [{"$project": {"_id": 0, "x.y": "$name"}}]).first().asDict(True) == {"x": {"y": "A"}}
    assert aggregate(people, [{"$project": {"_id": 0}}]).columns == ["name", "score"]
    assert out(aggregate(people, [{"$match": {"name": "Z"}}, {"$count": "n"}])) == []
    with pytest.raises(BadValue):
        aggregate(people, [{"$project": {"name": 1, "score": 0}}])
    with pytest.raises(Unsupported):
        aggregate(people, [{"$bucket": {}}])


def test_sort_feeds_order(people):
    got = aggregate(people, [{"$sort": {"score": -1}}, {"$group": {"_id": None, "f": {"$first": "$name"}, "p": {"$push": "$name"}}}]).first()
    assert (got.f, got.p) == ("D", ["D", "B", "C", "A"])
    by_name = aggregate(people, [{"$sort": {"name": -1}}, {"$group": {"_id": None, "p": {"$push": "$name"}}}]).first()
    assert by_name.p == ["D", "C", "B", "A"]
    with pytest.raises(BadValue):
        aggregate(people, [{"$group": {"_id": None, "f": {"$first": "$name"}}}])


def test_date_bins(spark):
    df = spark.createDataFrame([(datetime.datetime(2026, 7, 21, 9, 37, 42, 987000),)], "ts timestamp")
    got = aggregate(df, [{"$project": {"h": {"$dateTrunc": {"date": "$ts", "unit": "hour"}}, "w": {"$dateTrunc": {"date": "$ts", "unit": "week", "startOfWeek": "mon"}}, "m": {"$dateTrunc": {"date": "$ts", "unit": "month"}}}}]).first()
    assert (got.h, got.w, got.m) == (datetime.datetime(2026, 7, 21, 9), datetime.datetime(2026, 7, 20), datetime.datetime(2026, 7, 1))


def test_lookups(spark):
    users = spark.createDataFrame([(1, "x"), (2, "y")], "_id int, name string")
    orders = spark.createDataFrame([(1, 1), (2, 1), (3, 9)], "_id int, userId int")
    stage = {"$lookup": {"from": "o", "localField": "_id", "foreignField": "userId", "as": "os"}}
    got = out(aggregate(users, [stage, {"$sort": {"_id": 1}}], {"o": orders}))
    assert [[o["_id"] for o in r["os"]] for r in got] == [[1, 2], []]
    assert out(aggregate(users, [stage, {"$match": {"os": []}}], {"o": orders})) == [{"_id": 2, "name": "y", "os": []}]
    flat = aggregate(users, [stage, {"$unwind": "$os"}], {"o": orders})
    assert "collect_list" not in flat._jdf.queryExecution().executedPlan().toString() and flat.count() == 2
    arrays = spark.createDataFrame([(1, [1, 9]), (2, [])], "_id int, ids array<int>")
    got = out(aggregate(arrays, [{"$lookup": {"from": "o", "localField": "ids", "foreignField": "userId", "as": "os"}}, {"$sort": {"_id": 1}}], {"o": orders}))
    assert [len(r["os"]) for r in got] == [3, 0]
    let = {"$lookup": {"from": "o", "let": {"u": "$_id"}, "pipeline": [{"$match": {"$expr": {"$eq": ["$userId", "$$u"]}}}, {"$sort": {"_id": -1}}, {"$limit": 1}], "as": "os"}}
    assert [[o["_id"] for o in r["os"]] for r in out(aggregate(users, [let, {"$sort": {"_id": 1}}], {"o": orders}))] == [[2], []]


def test_graph(spark):
    nodes = spark.createDataFrame([("A", None), ("B", "A"), ("C", "B"), ("D", "E"), ("E", "D")], "_id string, parent string")
    stage = {"from": "n", "startWith": "$parent", "connectFromField": "parent", "connectToField": "_id", "as": "g"}
    got = {r["_id"]: sorted(x["_id"] for x in r["g"]) for r in out(aggregate(nodes, [{"$graphLookup": stage}], {"n": nodes}))}
    assert got == {"A": [], "B": ["A"], "C": ["A", "B"], "D": ["D", "E"], "E": ["D", "E"]}
    got = {r["_id"]: len(r["g"]) for r in out(aggregate(nodes, [{"$graphLookup": stage | {"maxDepth": 0}}], {"n": nodes}))}
    assert got == {"A": 0, "B": 1, "C": 1, "D": 1, "E": 1}


def test_windows(people):
    got = out(aggregate(people, [{"$setWindowFields": {"sortBy": {"score": 1}, "output": {"r": {"$rank": {}}, "n": {"$documentNumber": {}}, "p": {"$shift": {"output": "$name", "by": -1, "default": "none"}}}}}]))
    assert [(r["name"], r["r"], r["n"], r["p"]) for r in got] == [("A", 1, 1, "none"), ("C", 2, 2, "A"), ("B", 3, 3, "C"), ("D", 4, 4, "B")]


def test_updates(spark, people):
    c = Collection(people)
    assert [r["score"] for r in out(c.update_one({"score": {"$gte": 10}}, {"$inc": {"score": 5}}).find(sort={"_id": 1}))] == [15, 30, 20, 40]
    assert c.replace_one({"_id": 2}, {"name": "Z"}).find_one({"_id": 2}).asDict() == {"_id": 2, "name": "Z", "score": None}
    assert c.update_one({"_id": 9, "name": "N"}, {"$set": {"score": 1}}, upsert=True).find_one({"_id": 9}).name == "N"
    row, after = c.find_one_and_update({}, {"$set": {"name": "top"}}, sort={"score": -1}, new=True)
    assert (row._id, row.name, after.count().first().n) == (4, "top", 4)
    for bad, error in (({"$set": {"_id": 1}}, ImmutableField), ({"$push": {"a": 1}}, Unsupported), ({"$set": {"a.b": 1}, "$inc": {"a": 1}}, BadValue)):
        with pytest.raises(error):
            c.update_many({}, bad)
    with pytest.raises(DuplicateKey):
        c.insert(spark.createDataFrame([(1, "x", 1)], people.schema))
    with pytest.raises(DuplicateKey):
        c.insert(spark.createDataFrame([(9, "A", 1)], people.schema)).create_index(Index(["name"], unique=True))
    items = spark.createDataFrame([(1, [("A", 1), ("B", 5)])], "_id int, items array<struct<sku:string,qty:int>>")
    got = Collection(items).update_many({}, {"$set": {"items.$[e].qty": 9}}, [{"e.qty": {"$gte": 3}}]).find_one()
    assert [i.qty for i in got["items"]] == [1, 9]


def test_merge_and_ttl(spark, people):
    got = {r["_id"]: r for r in out(merge(people, spark.createDataFrame([(1, "N"), (7, "M")], "_id int, name string")))}
    assert got[1] == {"_id": 1, "name": "N", "score": 10} and got[7]["score"] is None and len(got) == 5
    df = spark.createDataFrame([(1, datetime.datetime(2024, 1, 1)), (2, datetime.datetime(2024, 1, 1, 0, 0, 1)), (3, None)], "_id int, at timestamp")
    c = Collection(df, now=F.lit("2024-01-01 00:00:10").cast("timestamp")).create_index(Index(["at"], expire_after=10))
    assert [r["_id"] for r in out(c.find(sort={"_id": 1}))] == [2, 3]


def test_collation(spark):
    df = spark.createDataFrame([(1, "z"), (2, "ä"), (3, "ALPHA")], "_id int, name string")
    got = Collection(df).find({"name": {"$gte": "a"}}, sort={"name": 1}, collation={"locale": "en", "strength": 1})
    assert [r.name for r in got.collect()] == ["ä", "ALPHA", "z"]


def test_quality_jobs(spark, people):
    before = spark.createDataFrame([(1, "a", "t1"), (2, "b", "t1"), (3, "c", "t1")], "_id int, name string, at string")
    after = spark.createDataFrame([(1, "a", "t2"), (2, "b", "t2"), (3, "d", None), (4, "e", "t2")], "_id int, name string, at string")
    assert fixtures.diff_summary(before, after).first().asDict() == {"added": 1, "removed": 0, "changed": 3, "unchanged": 0, "requires_approval": True}
    assert fixtures.drift_score(before, before).first().status == "OK"
    got = fixtures.sanitize(people, [{"path": "name", "action": "fake", "fakeType": "PHONE"}, {"path": "score", "action": "nullify"}], "s").first()
    assert got.name.startswith("+1-555-") and len(got.name) == 18 and got.score is None
    text = spark.createDataFrame([(1, "write to a.b@example.org or +1 555 123 4567"), (2, "none")], "_id int, t string")
    assert {r.type for r in fixtures.pii_lint(text).collect()} == {"email", "phone"}


def test_ndjson(spark, people, tmp_path):
    write_ndjson(people, f"file://{tmp_path}/x.ndjson")
    back = read_ndjson(spark, f"file://{tmp_path}/x.ndjson", people.schema)
    assert sorted(out(back), key=lambda r: r["_id"]) == out(people)
    assert read_variant(spark, f"file://{tmp_path}/x.ndjson").select(F.try_variant_get("doc", "$.score", "int").alias("s")).agg(F.sum("s")).first()[0] == 100
    nested = people.select(F.struct(F.col("score").alias("b"), F.col("name").alias("a")).alias("z"), "_id")
    assert nested.select(canonical(nested).alias("j")).first().j == '{"_id":1,"z":{"a":"A","b":10}}'


def test_stream(spark, tmp_path):
    from docspark.streaming.events import matching, tumbling

    rows = spark.createDataFrame([(datetime.datetime(2024, 1, 1, 0, m), "a" if m % 2 else "b", m) for m in range(10)], "ts timestamp, k string, v int")
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    agg = tumbling(matching(stream, {"v": {"$gte": 2}}), "ts", "5 minutes", ["k"], [F.count("*").alias("n")], "1 minute")
    query = agg.writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.table("windows").agg(F.sum("n")).first()[0] == 8
