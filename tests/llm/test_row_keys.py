"""Pipeline stages over rows with null and repeated ids."""

from __future__ import annotations

import corpus_pipeline

from docspark.llm.near_dup import near_duplicates

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def texts(stage, spark, sf, rows):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    return sorted((r.doc_id if r.doc_id is not None else -1, r.text) for r in stage(spark, docs, sf).collect())


def words(name, n=60):
    return [f"{name}{k}" for k in range(n)]


def test_decontaminate_by_row(spark, sf):
    bad = spark.read.parquet(f"{sf}/benchmark.parquet").where("length(text) > 80").first().text
    rows = [(None, bad), (None, "a clean text"), (5, bad), (5, "another clean text")]
    assert texts(corpus_pipeline.decontaminate, spark, sf, rows) == [(-1, "a clean text"), (5, "another clean text")]


def test_near_dedup_by_row(spark, sf):
    a, b, c = (" ".join(words(n)) for n in "abc")
    rows = [(1, a), (None, a), (None, a + " end"), (None, b), (None, b + " end"), (None, "a clean text of seven words here"), (7, c), (7, c + " end")]
    got = texts(corpus_pipeline.near_dedup, spark, sf, rows)
    assert [i for i, _ in got] == [-1, -1, 1, 7] and (1, a) in got and (-1, "a clean text of seven words here") in got


def test_links_of_rows_without_id(spark):
    a = " ".join(words("a", 100))
    rows = [(None, a + " x"), (3, a + " y"), (None, a + " z")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    assert {r.component_id for r in got} == {3}
