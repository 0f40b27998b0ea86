"""Syncmer fingerprints: against a plain reading of the definition."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from docspark.llm import syncmers
from docspark.llm.syncmers import K, S, SKETCH, anchors, compared, distinct, edited_likeness, estimate, fingerprints, shown

ODD = [None, "", " ", "a" * 300, "naïve 漢字 é x", "ecidonolgdoalman", "ihd aaaalgmaphno", "😀" * 17, "word " * 2000, "short", "short"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    return list(enumerate(ODD + ["".join(rng.choice("aab  tsé漢1!n") for _ in range(rng.randrange(90))) for _ in range(120)]))


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en") for i, t in texts], "doc_id long, text string, fingerprint string").repartition(3)


def _rank(smer: str) -> int:
    """An S-mer's rank, by the operator's own hash of it alone."""
    return int(syncmers._mix(syncmers._poly(np.frombuffer(smer.encode("utf-32-le"), "<u4").astype(np.uint64), S))[0])


def plain(text: str) -> set[str]:
    """The text's closed syncmers as strings, by the definition; the text itself if it has none."""
    out = set()
    for i in range(len(text) - K + 1):
        ranks = [_rank(text[i + j : i + j + S]) for j in range(K - S + 1)]
        if min(ranks) in (ranks[0], ranks[-1]):
            out.add(text[i : i + K])
    return out or ({text} if text else set())


def jaccard(a: str, b: str) -> float:
    x, y = plain(a), plain(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def test_against_definition(docs, texts):
    got = {r.doc_id: r for r in edited_likeness(docs).collect()}
    short = {r.doc_id: r.fingerprint for r in fingerprints(docs).collect()}
    for k, (i, t) in enumerate(texts):
        text, after = t or "", texts[(k + 1) % len(texts)][1] or ""
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        r = got[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint) == (len(text), hashlib.sha256(edited.encode()).hexdigest(), short[i])
        if len(text) < 1000:
            assert r.near_edited == pytest.approx(jaccard(text, edited)) and r.near_next == pytest.approx(jaccard(text, after))
            # texts of few anchors are told from the fingerprints exactly
            assert estimate(r.fingerprint, r.edited_fingerprint) == pytest.approx(r.near_edited)


def test_short_texts_differ():
    a, b = distinct("ecidonolgdoalman"), distinct("ihd aaaalgmaphno")
    assert len(a[0]) == len(b[0]) == 1 and compared(a, b)[0] == 0 and compared(a, distinct(""))[0] == 0 and compared(distinct(""), distinct(""))[0] == 1
    assert shown(a) != shown(b) and shown(distinct("")) == "0:"


def test_sketch_error():
    rng = random.Random(6)
    errors = []
    for _ in range(40):
        text = "".join(rng.choice("abcdefghij ") for _ in range(6000))
        other = text[: rng.randrange(6000)] + "".join(rng.choice("abcdefghij ") for _ in range(3000))
        a, b = distinct(text), distinct(other)
        errors.append(estimate(shown(a), shown(b)) - compared(a, b)[0])
    assert max(map(abs, errors)) < 4 * 0.5 / SKETCH**0.5 and (sum(e * e for e in errors) / 40) ** 0.5 < 1.2 * 0.5 / SKETCH**0.5


def test_places():
    rng = random.Random(7)
    text = "".join(rng.choice("abcdefghij ") for _ in range(2000))
    h, at = anchors(text)
    assert 0.15 < len(at) / len(text) < 0.35
    moved, there = anchors("xyz" + text)
    assert set(zip(h.tolist(), (at + 3).tolist(), strict=True)) <= set(zip(moved.tolist(), there.tolist(), strict=True))
    near, aligned = compared(distinct(text), distinct("xyz" + text))
    assert near > 0.95 and aligned == len(distinct(text)[0])
    assert compared(distinct(text), distinct(text[::-1]))[0] < 0.05


def test_odd_rows(spark):
    assert edited_likeness(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = edited_likeness(spark.createDataFrame([(3, "abcdefgh")], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.near_next) for r in one] == [(3, 1.0)]
    rows = [(None, "first"), (1, "same text here"), (1, "same text here"), (2, None)]
    got = edited_likeness(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.n_chars for r in got) == [0, 5, 14, 14] and max(r.near_next for r in got if r.doc_id == 1) == 1.0


def test_many_parts(docs, monkeypatch):
    key = lambda df: sorted(map(tuple, df.collect()))
    whole = key(edited_likeness(docs))
    monkeypatch.setattr(syncmers, "PART_BYTES", 700)
    assert key(edited_likeness(docs)) == whole
