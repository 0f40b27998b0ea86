"""Keys of a line's neighbourhood: equal exactly where the words are, and cheap for very long lines."""

from __future__ import annotations

import random
import time

from pyspark.sql import functions as F

from docspark.llm.line_dedup import STRETCH, dedup_lines, neighbourhood


def test_keys_are_those_of_the_words(spark):
    rng = random.Random(4)
    lines = [[rng.choice("abc") for _ in range(n)] for n in [*range(1, 9), STRETCH - 2, STRETCH - 1, STRETCH, STRETCH + 1, 2 * STRETCH, 3 * STRETCH + 5] for _ in range(4)]
    rows = [(k, w) for k, w in enumerate(lines)]
    rows += [(k, w[:i] + w[i + 1 :]) for k, w in rows for i in range(len(w)) if len(w) > 1]
    keys: dict[int, tuple] = {}
    for w, near in spark.createDataFrame(rows, "k long, w array<string>").select("w", F.expr(neighbourhood("w"))).collect():
        wanted = [tuple(w), *(tuple(w[:i] + w[i + 1 :]) for i in range(len(w)))]
        assert len(near) == len(wanted)
        for key, words in zip(near, wanted, strict=True):
            assert keys.setdefault(key, words) == words
    assert len(set(keys.values())) == len(keys)


def test_very_long_lines(spark):
    words = [f"w{k}" for k in range(60_000)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:-9], "new", *words[-8:]])), (3, " ".join(words[1:])), (4, " ".join([*words[:-9], "new", "more", *words[-7:]]))]
    start = time.monotonic()
    got = {r.doc_id: (r.n_dropped, r.n_near) for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (0, 0), 2: (1, 1), 3: (1, 1), 4: (1, 1)}
    assert time.monotonic() - start < 90  # a copy of the line for each of its words takes minutes
