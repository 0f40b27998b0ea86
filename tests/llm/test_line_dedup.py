from __future__ import annotations

import random

import pytest
from brute import kept_lines, within_one

from docspark.llm import common
from docspark.llm.line_dedup import MIN_WORDS, NEAR_WORDS, dedup_lines, within_one_edit


@pytest.mark.parametrize("least,near", [(MIN_WORDS, NEAR_WORDS), (1, 1), (2, 3), (4, 10)])
def test_against_all_pairs(spark, least, near):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(60)]
    lines = [[rng.choice(words) for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 9, 10, 11, 14]))] for _ in range(40)]
    rows = []
    for k in range(60):
        text = []
        for _ in range(rng.randrange(5)):
            line = list(rng.choice(lines))
            if line and rng.random() < 0.5:
                at = rng.randrange(len(line))
                line[at : at + rng.choice([0, 1])] = rng.choice([[], ["new"], [rng.choice(words)]])
            text.append(rng.choice([" ", "  ", "\t", " \v"]).join(line) + rng.choice(["", "\r"]))
        rows.append((k, "\n".join(text)))
    rows += [(200, None), (201, ""), (202, "\n\n")]
    got = {r.doc_id: r for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), least, near).collect()}
    wanted = kept_lines(rows, least, near)
    assert {i: r.text for i, r in got.items()} == wanted
    assert sum(r.n_near for r in got.values()) > 0 and got[200].n_lines == 0


def test_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    got = dedup_lines(docs)
    assert {r.doc_id: r.text for r in got.collect()} == kept_lines(rows, MIN_WORDS, NEAR_WORDS)
    assert got.columns == [*docs.columns, "n_lines", "n_dropped", "n_near"]


def test_same_without_broadcasts(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    whole = {r.doc_id: (r.text, r.n_near) for r in dedup_lines(docs).collect()}
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    assert {r.doc_id: (r.text, r.n_near) for r in dedup_lines(docs).collect()} == whole


def test_odd_rows(spark):
    line = "a b c d e"
    rows = [(None, line, 1), (1, line, 2), (1, line, 2), (2, f"{line}\n{line}", 3)]
    got = sorted((r.doc_id or 0, r.text, r.n_dropped) for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, n_dropped int")).collect())
    assert got == [(0, line, 0), (1, "", 1), (1, "", 1), (2, "", 2)]
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_edit_test(spark):
    rng = random.Random(2)
    pairs = [([rng.choice("ab") for _ in range(rng.randrange(6))], [rng.choice("ab") for _ in range(rng.randrange(6))]) for _ in range(400)]
    df = spark.createDataFrame(pairs, "x array<string>, y array<string>").selectExpr("x", "y", f"{within_one_edit('x', 'y')} AS near")
    assert all(r.near == within_one(r.x, r.y) for r in df.collect())
