from __future__ import annotations

import random

import pytest
from brute import linked, near_groups, shingle_sets
from pyspark.sql import functions as F

from docspark.llm import common
from docspark.llm import near_dup
from docspark.llm.near_dup import components, near_duplicates


def result(df):
    return {r.doc_id: (r.component_id, r.kept, r.n_shingles) for r in df.collect()}


@pytest.mark.parametrize("size", [2, 5])
def test_against_all_pairs(spark, size):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    bases = [[rng.choice(words) for _ in range(rng.choice([1, 3, 12, 60, 150]))] for _ in range(12)]
    rows = []
    for k in range(150):
        text = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2, 8])):
            text[rng.randrange(len(text))] = rng.choice(words)
        rows.append((k, " ".join(text).title() if k % 3 else " \t ".join(text)))
    rows += [(900, None), (901, ""), (902, " \n "), (903, "one"), (904, "ONE"), (905, "É e"), (906, "é e")]
    rng.shuffle(rows)
    got = result(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size))
    assert {i: c for i, (c, _, _) in got.items()} == near_groups(sorted(rows), size, 80)
    assert all(kept == (i == c) for i, (c, kept, _) in got.items())
    assert got[900][2] == got[902][2] == 0 and got[903][0] == got[904][0] == 903


def test_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    assert {i: c for i, (c, _, _) in result(near_duplicates(docs, 2)).items()} == near_groups(rows, 2, 80)


def test_recall_of_links(spark):
    """Of all pairs at 0.8 or more on sf0.01, the share that the 16-of-32 filter keeps together; none but linked ones are."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    got = {i: c for i, (c, _, _) in result(near_duplicates(docs, 2)).items()}
    pairs = list(linked(shingle_sets(rows, 2), 80))
    assert len(pairs) > 50 and sum(got[i] == got[j] for i, j in pairs) / len(pairs) >= 0.9
    groups = near_groups(rows, 2, 80)
    assert all(groups[i] == groups[c] for i, c in got.items())


def test_same_without_broadcasts_and_in_small_blocks(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    whole = result(near_duplicates(docs, 2))
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(near_dup, "BLOCK", 3)
    assert result(near_duplicates(docs, 2)) == whole


def test_odd_rows(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string"), 2).collect() == []
    rows = [(None, "a b c d", 1), (2, "a b c d", 2), (2, "x y z", 3), (7, "x y z", 4), (7, "x y z", 4)]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, component_id long"), 2).collect())
    assert got == [(False, 2, 2), (False, 2, 2), (False, 7, 2), (False, 7, 2), (True, 0, 2)]


def test_components(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_hot_group(spark):
    base = [f"b{k}" for k in range(100)]
    rows = spark.range(600).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit(" ".join(base)), F.concat(F.lit("u"), F.col("id"))).alias("text"))
    got = near_duplicates(rows, 2)
    assert got.select("component_id").distinct().collect()[0][0] == 0 and got.where("kept").count() == 1
