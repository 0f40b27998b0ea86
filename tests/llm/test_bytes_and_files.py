"""Byte-level BPE, token files, fingerprints: against the public libraries and exact round trips."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from docspark.llm import byte_bpe, token_files
from docspark.llm.byte_bpe import decoded, encoded, load_ranks
from docspark.llm.token_files import PerfectHash, Shard, id_digests, read_ids, write_ids

ODD = [None, "", " ", "a" * 3000, "=-" * 500, "naïve 漢字́ é x\x1c\x85", "<|endoftext|> it's WE'LL", "a <|startoftext|>b<|endoftext|>.  c <|endoftex", "Word, word. ÉTÉ!! été?' (x), Ab-c's;",  "\n\n  x \n", "ΣΑΣ İK ſ", "1234567 ½", "word " * 2000, "😀".encode("utf-16", "surrogatepass").decode("utf-16")]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    made = ["".join(rng.choice("aab  \t'st́é漢1２!<|\n") for _ in range(rng.randrange(80))) for _ in range(150)]
    return list(enumerate(ODD + made))


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en") for i, t in texts], "doc_id long, text string, n_tokens string").repartition(3)


def test_byte_bpe(docs, texts):
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=load_ranks(path), special_tokens={})
    ids = encoded(docs.select("doc_id", "text"), path, P.PATTERN)
    assert {r.doc_id: list(r.ids) for r in ids.collect()} == {i: library.encode_ordinary(t or "") for i, t in texts}
    assert {r.doc_id: r.text for r in decoded(ids, path).collect()} == {i: t or "" for i, t in texts}
    for r in encoded(docs, path, P.PATTERN, digests=True).collect():
        text = texts[r.doc_id][1] or ""
        own = library.encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(own), hashlib.sha256(" ".join(map(str, own)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_token_files(docs, texts):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    wanted = {i: [*library.encode(t or "", add_special_tokens=False).ids, 1] for i, t in texts}
    keys = write_ids(docs, path)
    assert {r.doc_id: list(r.ids) for r in read_ids(keys).collect()} == wanted
    start = 0
    for r in sorted(id_digests(keys).collect()):
        ids = wanted[r.doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_token_files_odd_rows(spark):
    rows = [(5, "b"), (None, "a"), (5, "b"), (5, "c"), (2, None)]
    keys = write_ids(spark.createDataFrame(rows, "doc_id long, text string"), P.path("word_bpe_49k.json"))
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in id_digests(keys).collect())
    assert [d for _, d, _ in got] == [None, 2, 5, 5, 5] and got[2][0] == 3
    assert id_digests(write_ids(spark.createDataFrame([], "doc_id long, text string"), P.path("word_bpe_49k.json"))).count() == 0
    shard = Shard(keys.first().path)
    with pytest.raises(KeyError):
        shard.find(np.array([[1, 2, 3]], np.uint64))


def test_perfect_hash():
    keys = np.random.default_rng(1).integers(0, 2**63, (20_000, 3)).astype(np.uint64)
    assert sorted(PerfectHash.build(keys).slots(keys)) == list(range(20_000))


def test_many_shards(docs, texts, monkeypatch):
    path = P.path("word_bpe_49k.json")
    one = sorted(map(tuple, id_digests(write_ids(docs, path)).collect()))
    monkeypatch.setattr(token_files, "SHARD_BYTES", 600)
    monkeypatch.setattr(token_files, "SHARDS_AT_ONCE", 3)
    keys = write_ids(docs, path)
    assert keys.select("shard").distinct().count() > 10
    assert sorted(map(tuple, id_digests(keys).collect())) == one


def test_tables_that_forget(texts, monkeypatch):
    """The tables of pieces drop their older half; ids stay right."""
    import tiktoken
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_files, "KEPT_PIECES", 50)
    ranks = load_ranks(P.path("byte_bpe_50k.tiktoken"))
    codec, library = byte_bpe.Codec(ranks, P.PATTERN, 50), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    other = byte_bpe.Codec(ranks, r"\p{L}+|\P{L}+", 50)
    pieces, whole = token_files.PieceTokenizer(P.path("word_bpe_49k.json")), Tokenizer.from_file(P.path("word_bpe_49k.json"))
    by_letters = tiktoken.Encoding("letters", pat_str=r"\p{L}+|\P{L}+", mergeable_ranks=ranks, special_tokens={})
    for at in range(0, len(texts), 9):
        part = [t or "" for _, t in texts[at : at + 9]]
        assert list(codec(part)) == [library.encode_ordinary(t) for t in part]
        assert list(other(part)) == [by_letters.encode_ordinary(t) for t in part]
        assert [np.frombuffer(b, "<u2").tolist() for b in pieces(part)] == [[*whole.encode(t, add_special_tokens=False).ids, 1] for t in part]
