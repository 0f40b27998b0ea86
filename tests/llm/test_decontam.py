from __future__ import annotations

import random

from brute import contaminated, near_items

from docspark.llm import common
from docspark.llm.decontam import contamination


def result(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in df.collect()), key=lambda r: (r[0] is None, r))


def test_against_all_places(spark):
    rng = random.Random(5)
    words = ["the", "of", "É", "漢字", "a1", "b", "c", "d", "e", "f"]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([1, 4, 10, 11, 25])))) for k in range(12)] + [(50, None), (51, "..!"), (3, "the of")]
    docs = []
    for k in range(60):
        parts = [rng.choice(words).upper() for _ in range(rng.randrange(40))]
        if k % 3 == 0:
            parts += (rng.choice(items)[1] or "").split()
        docs.append((k, rng.choice([" ", "-", ", "]).join(parts)))
    docs += [(100, None), (101, ""), (102, "?!")]
    got = contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert result(got) == sorted(contaminated(docs, items))
    assert {c for c, _ in got.dtypes} == {"doc_id", "n_words", "n_hit", "n_items", "items", "contaminated", "n_near"}


def test_table(spark, sf):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    pairs = lambda df, i: [(r[i], r.text) for r in df.collect()]
    assert result(contamination(docs, items)) == sorted(contaminated(pairs(docs, "doc_id"), pairs(items, "item_id")))


def test_odd_rows(spark):
    docs = [(None, "x one two y", 0), (1, "one two", 1), (1, "one two", 1), (1, "two", 2)]
    items = [(None, "one two"), (9, "two"), (9, "two")]
    got = contamination(spark.createDataFrame(docs, "doc_id long, text string, n_hit int"), spark.createDataFrame(items, "item_id long, text string"))
    assert result(got) == [(1, 1, 1, ["9"]), (1, 2, 2, ["9"]), (1, 2, 2, ["9"]), (None, 4, 2, ["9"])]
    empty = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert contamination(empty, bench).count() == 0
    none = contamination(spark.createDataFrame(docs, "doc_id long, text string, n_hit int"), spark.createDataFrame([], "item_id long, text string"))
    assert none.where("contaminated OR n_hit > 0").count() == 0 and none.count() == 4


def test_proximity(spark):
    rng = random.Random(9)
    passage = [f"w{k}" for k in range(14)]
    items = [(1, " ".join(passage)), (2, "alpha beta gamma"), (3, "x x y x"), (None, "beta alpha")]
    docs = [(1, "alpha x beta gamma"), (2, "alpha beta gamma"), (3, "alpha " + "x " * 9 + "beta gamma"), (4, "beta alpha gamma"), (5, "x x y x y"), (6, "alpha gamma beta x"), (7, None), (8, "gamma alpha beta")]
    for k in range(20, 50):
        w = list(passage)
        for _ in range(k % 7):
            a = rng.randrange(len(w) - 1)
            if rng.random() < 0.5:
                w[a], w[a + 1] = w[a + 1], w[a]
            else:
                w.insert(a, "z")
        docs.append((k, " ".join(["start", *w, "end"])))
    for slop in (1, 2):
        got = contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), slop=slop)
        wanted = near_items(docs, items, slop)
        assert {r.doc_id: r.n_near for r in got.collect()} == wanted
        assert {0, 1} <= set(wanted.values())


def test_same_without_broadcasts(spark, sf, monkeypatch):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    whole = sorted(map(str, contamination(docs, items).collect()))
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    assert sorted(map(str, contamination(docs, items).collect())) == whole
