"""Bounded accumulators, stable lookups, writes with options and counts, bundles."""

from __future__ import annotations

import pytest

from docspark.errors import BadValue, DuplicateKey, Unsupported
from docspark.operators import fixtures, updates
from docspark.plans.collection import Collection, Index
from docspark.plans.pipeline import aggregate
from docspark.sources import tables


@pytest.fixture
def people(spark):
    rows = [(1, "A", 10, ["x"]), (2, "B", 30, ["x", "y"]), (3, "C", 20, None), (4, "D", 40, ["z"])]
    return spark.createDataFrame(rows, "_id long, name string, score int, tags array<string>")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("spec", [{"$topN": {"output": "$name", "sortBy": {"score": -1}, "n": 2}}, {"$minN": {"input": "$score", "n": 2}}, {"$lastN": {"input": "$name", "n": 2}}])
def test_groups_are_cut_before_they_are_collected(people, spec):
    out = aggregate(people, [{"$group": {"_id": "$name", "v": spec}}], order_by=["_id"])
    assert "WindowGroupLimit" in plan(out)


def test_bounded_values(spark):
    rows = [(k, k % 2, None if k % 5 == 0 else k % 7) for k in range(40)]
    df = spark.createDataFrame(rows, "_id long, g long, v long").repartition(5)
    spec = {"f": {"$firstN": {"input": "$v", "n": 3}}, "l": {"$lastN": {"input": "$v", "n": 3}}, "lo": {"$minN": {"input": "$v", "n": 4}}, "hi": {"$maxN": {"input": "$v", "n": 4}}, "s": {"$addToSet": "$v"}, "n": {"$sum": 1}, "b": {"$bottomN": {"output": "$_id", "sortBy": {"v": 1}, "n": 2}}}
    got = {r["_id"]: r for r in aggregate(df, [{"$group": {"_id": "$g", **spec}}], order_by=["_id"]).collect()}
    for g in (0, 1):
        own = [(k, v) for k, x, v in rows if x == g]
        values = [v for _, v in own]
        some = sorted(v for v in values if v is not None)
        assert (got[g].f, got[g].l, got[g].lo, got[g].hi, got[g].n) == (values[:3], values[-3:], some[:4], some[::-1][:4], 20)
        assert got[g].s == list(dict.fromkeys(values))
        assert got[g].b == [k for k, v in sorted(own, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))][-2:]
    # a group without values has an empty list
    none = aggregate(spark.createDataFrame([(1, None)], "_id long, v long"), [{"$group": {"_id": None, "lo": {"$minN": {"input": "$v", "n": 2}}}}]).collect()
    assert [list(r.lo) for r in none] == [[]]


def test_lookup_keys_are_values(spark, people):
    other = spark.createDataFrame([(1, "x", 5), (2, "y", 6), (3, "x", 7)], "_id long, tag string, w long")
    by_array = aggregate(people, [{"$lookup": {"from": "o", "localField": "tags", "foreignField": "tag", "as": "hits"}}], {"o": other}, ["_id"])
    assert {r["_id"]: sorted(h.w for h in r.hits) for r in by_array.collect()} == {1: [5, 7], 2: [5, 6, 7], 3: [], 4: []}
    let = aggregate(people.union(people), [{"$lookup": {"from": "o", "let": {"s": "$score"}, "pipeline": [{"$match": {"$expr": {"$lt": ["$w", "$$s"]}}}, {"$sort": {"w": -1}}, {"$limit": 2}], "as": "hits"}}], {"o": other})
    assert sorted((r["_id"], [h.w for h in r.hits]) for r in let.collect()) == sorted([(k, [7, 6]) for k in (1, 2, 3, 4)] * 2)
    plain = aggregate(people, [{"$lookup": {"from": "o", "pipeline": [{"$count": "n"}], "as": "c"}}], {"o": other})
    assert {r.c[0].n for r in plain.collect()} == {3} and "monotonically" not in plan(by_array) + plan(let)


def test_ids_are_made(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "name string")
    both = Collection(updates.with_ids(rows, rows)).insert(rows).df
    ids = [r["_id"] for r in both.collect()]
    assert len(set(ids)) == 4 and all(len(i) == 24 for i in ids)
    with pytest.raises(BadValue):
        updates.insert(spark.createDataFrame([(1, "a")], "_id long, name string"), rows)
    with pytest.raises(DuplicateKey):
        updates.insert(both, both.limit(1))


def test_update_one_changes_one(spark):
    rows = spark.createDataFrame([("t", 0), ("t", 0), ("u", 0), ("t", 0)], "s string, n long")
    out = Collection(rows, ["s"]).update_one({"s": "t"}, {"$set": {"n": 9}}).df
    assert out.where("n = 9").count() == 1 and out.count() == 4


def test_find_and_modify(people):
    c = Collection(people)
    row, then = c.find_and_modify({"score": {"$gte": 20}}, {"$inc": {"score": 1}}, sort={"score": -1}, new=True, fields={"score": 1})
    assert row.asDict() == {"_id": 4, "score": 41} and then.find_one({"_id": 4}).score == 41
    row, then = c.find_and_modify({"score": 10}, remove=True)
    assert row.name == "A" and then.df.count() == 3
    assert c.find_and_modify({"_id": 9}, {"$set": {"name": "Z"}}) == (None, c)
    row, then = c.find_and_modify({"_id": 9}, {"$set": {"name": "Z"}}, upsert=True, new=True)
    assert (row["_id"], row.name) == (9, "Z") and then.df.count() == 5
    row, then = c.find_one_and_replace({"name": "B"}, {"name": "BB"}, new=True)
    assert row.asDict() == {"_id": 2, "name": "BB", "score": None, "tags": None}
    with pytest.raises(BadValue):
        c.find_and_modify({}, {"$set": {"name": "Z"}}, remove=True)
    with pytest.raises(BadValue):
        c.find_one_and_replace({}, {"$set": {"name": "Z"}})


def test_bulk_stops_at_the_first_error(people):
    again = {"insertOne": {"document": {"_id": 1, "name": "again"}}}
    remove = {"deleteOne": {"filter": {"_id": 2}}}
    then, counts = Collection(people).bulk_result([again, remove])
    assert counts["deleted"] == 0 and [e["index"] for e in counts["errors"]] == [0] and then.df.count() == 4
    then, counts = Collection(people).bulk_result([again, remove], ordered=False)
    assert counts["deleted"] == 1 and len(counts["errors"]) == 1 and then.df.count() == 3
    many = [{"updateOne": {"filter": {"_id": 1}, "update": {"$inc": {"score": 1}}}}] * 20
    assert Collection(people).bulk_write(many).find_one({"_id": 1}).score == 30


def test_deep_array_filters(spark):
    rows = spark.createDataFrame([(1, [(1, [(5, "a"), (6, "b")]), (2, [(7, "c")])]), (2, None)], "_id long, items array<struct<q:int,parts:array<struct<n:int,s:string>>>>")
    out = Collection(rows).update_many({}, {"$set": {"items.$[e].parts.$[f].s": "X"}}, [{"e.q": 1}, {"f.n": {"$gte": 6}}]).df
    assert [[p.s for p in i.parts] for i in out.where("_id = 1").first()["items"]] == [["a", "X"], ["c"]] and out.where("_id = 2").first()["items"] is None
    gone = Collection(rows).update_many({"_id": 1}, {"$unset": {"items.$[e].parts.$[f].s": 1}}, [{"e.q": 1}, {"f.n": 5}]).df
    assert [[p.s for p in i.parts] for i in gone.where("_id = 1").first()["items"]] == [[None, "b"], ["c"]]
    with pytest.raises(BadValue):
        Collection(rows).update_many({}, {"$set": {"items.$[e].q": 1}}, [])
    with pytest.raises(Unsupported):
        Collection(rows).update_many({}, {"$set": {"items.q.$[e]": 1}}, [{"e": 1}])


def test_last_stages(people):
    c = Collection(people, collections={"old": people.where("_id < 3")})
    assert c.aggregate([{"$match": {"_id": {"$gt": 2}}}, {"$out": "new"}]).count() == 2
    assert c.aggregate([{"$match": {"_id": 4}}, {"$merge": {"into": "old"}}]).count() == 3
    with pytest.raises(Unsupported):
        c.aggregate([{"$merge": {"into": "old", "whenMatched": "fail"}}])


def test_bundle(spark, people, tmp_path):
    path = f"file://{tmp_path}/b"
    tables.write_bundle({"app.people": people, "app.none": people.limit(0)}, path, "7")
    got = tables.read_bundle(spark, path, "7")
    assert sorted(map(str, got["app.people"].collect())) == sorted(map(str, people.collect())) and got["app.none"].count() == 0
    with pytest.raises(ValueError):
        tables.read_bundle(spark, path, "8")
    for copy in ("fast", "portable"):
        people.limit(2).write.mode("overwrite").parquet(f"{path}/{copy}/app.people")
    with pytest.raises(ValueError):
        tables.read_bundle(spark, path, "7")


def test_nearest_rank(spark):
    import math

    values = [k * k % 37 for k in range(101)] + [None] * 5
    df = spark.createDataFrame([(v,) for v in values], "v int").repartition(3)
    some = sorted(v for v in values if v is not None)
    for r in fixtures.nearest_rank(df, "v", [0.0, 0.01, 0.5, 0.951, 1.0]).collect():
        assert r.value == some[max(1, math.ceil(len(some) * r.p)) - 1]
    assert fixtures.nearest_rank(df.limit(0), "v", [0.5]).count() == 0


def test_shared_folder_on_clusters(spark):
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext, conf = Context(), type("C", (), {"get": staticmethod(lambda k, d: d)})()

    with pytest.raises(ValueError):
        tables.shared_dir(Session())


def test_index_on_bulk(people):
    with pytest.raises(DuplicateKey):
        Collection(people).create_index(Index(["name"], unique=True)).update_many({}, {"$set": {"name": "same"}})
