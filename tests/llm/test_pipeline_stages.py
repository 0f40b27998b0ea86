from __future__ import annotations

import corpus_pipeline
import pytest
from brute import contaminated, kept_lines, near_groups

from docspark.llm import common
from docspark.llm.line_dedup import MIN_WORDS, NEAR_WORDS


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = lambda df: sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())
    good = corpus_pipeline.quality(spark, docs, sf)
    lines = corpus_pipeline.line_dedup(spark, good, sf)
    wanted = kept_lines(texts(good), MIN_WORDS, NEAR_WORDS)
    before = dict(texts(good))
    assert texts(lines) == sorted((i, t) for i, t in wanted.items() if t == before[i] or t.strip())
    alone = corpus_pipeline.near_dedup(spark, lines, sf)
    groups = near_groups(texts(lines), 2, 80)
    assert [i for i, _ in texts(alone)] == sorted(i for i, c in groups.items() if i == c)
    clean = corpus_pipeline.decontaminate(spark, alone, sf)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert [i for i, _ in texts(clean)] == [d for d, _, hit, _ in sorted(contaminated(texts(alone), items)) if not hit]
    assert all(df.columns == docs.columns for df in (good, lines, alone, clean))
    assert corpus_pipeline.encode(spark, clean, sf).count() == clean.count()


def test_odd_rows(spark, sf):
    rows = [(1, None, None, None, None), (1, None, None, None, None), (2, "", "en", "s", 0), (None, "one two three four five six", "en", "s", 27), (None, "one two three four five six", "en", "s", 27)]
    for docs in (spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, sf).count() <= docs.count()


def test_long_texts_and_no_broadcasts(spark, sf, monkeypatch):
    long = "\n".join(" ".join(f"w{k * j % 9973}" for j in range(40)) for k in range(2000))
    rows = [(1, long, "en", "s", len(long)), (2, long + "\nthe end", "en", "s", len(long) + 8), (3, "x" * 400_000, "en", "s", 400_000)]
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 30").unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("doc_id + 10000 AS doc_id", "text", "lang", "source", "n_chars"))

    def results():
        out, now = [], docs
        for _, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, sf)
            out.append(sorted(map(str, now.collect())))
        return out

    whole = results()
    assert all(whole)
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    assert results() == whole


@pytest.mark.parametrize("name", ["quality classifier", "line dedup", "minhash near-dedup", "benchmark decontamination", "byte-level bpe"])
def test_names(name):
    assert name in dict(corpus_pipeline.STAGES)


@pytest.mark.parametrize("at", [0, 2, 4])
def test_small_batches(spark, sf, monkeypatch, at):
    """Each stage that runs Python takes texts in batches of BATCH_BYTES and a text at most, and leaves the session as it was."""
    docs = spark.range(0, 3000, 1, 1).selectExpr("id AS doc_id", "repeat(concat('w', id, ' and more '), 800) AS text", "'en' AS lang", "'s' AS source", "10000L AS n_chars")
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, taken = spark.conf.get(key), []

    def sizes(batches):
        for batch in batches:
            yield batch[["text"]].head(1).assign(text=int(batch["text"].str.len().sum())).rename(columns={"text": "n"})

    def spied(df, function, schema, *rest, plain=type(docs).mapInPandas):
        if "text" in df.columns:
            taken.append(max((r.n for r in plain(df, sizes, "n long").collect()), default=0))
        return plain(df, function, schema, *rest)

    monkeypatch.setattr(type(docs), "mapInPandas", spied)
    out = corpus_pipeline.STAGES[at][1](spark, docs, sf)
    assert taken and max(taken) <= common.BATCH_BYTES + 20_000
    # nothing is left to run in Python after the stage, without the limit
    assert "MapInPandas" not in out._jdf.queryExecution().executedPlan().toString()
    assert spark.conf.get(key) == before
