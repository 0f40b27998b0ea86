"""Byte-level BPE by corpus-level merge replay.

The words (matches of the tokenizer's pattern) that a task meets for the first time stand in one array of tokens. An
inverted index maps the token that a pair makes to all places of such pairs in all words; the merges are applied in
rank order, each to all its places, and a merge updates only the entries of the two neighbours that it touches. Since
a word's merges depend on that word alone, each distinct word is replayed once by a worker, and the ids are those of
one replay over the corpus; no text or word is shuffled. A worker keeps what it has met (`kept` pieces and words,
and those of a chunk of CHARS_PER_KEPT times as many characters; then the older half goes), so that the cost of a gigabyte falls as it goes on.

The ranks and the pattern are parameters. A null text counts as empty: no ids. Texts of any length are whole.
Rows are independent, so ties, repeated rows and repeated ids change nothing.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import uncollected

#: Pieces and words that a worker keeps, about 230 bytes each, and characters of text for each of them that are encoded at once.
KEPT = 700_000
CHARS_PER_KEPT = 16
#: The pattern under which blanks bound pieces (fixed value: the split of the byte-level vocabularies).
BLANK_BOUND = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def load_ranks(path: str) -> dict[bytes, int]:
    """Bytes to rank, from lines of base64 and decimal rank."""
    import base64

    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class MergeReplay:
    #: ranks whose positions are looked up at once
    BAND = 1024

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: b for b, i in ranks.items()}
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.top = max(ranks.values()) + 1
        # each way to make a token of two: (left id, right id) as one number, in order, and the token
        made = {}
        for word, i in ranks.items():
            for cut in range(1, len(word)):
                a, b = ranks.get(word[:cut]), ranks.get(word[cut:])
                if a is not None and b is not None:
                    made[a * self.top + b] = i
        self.pairs = np.array(sorted(made), np.int64)
        self.made = np.array([made[p] for p in sorted(made)], np.int64)

    def _token(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The token that each pair makes, -1 where none or where an id is -1."""
        pair = left * self.top + right
        at = np.searchsorted(self.pairs, pair)
        at[at == len(self.pairs)] = 0
        return np.where((self.pairs[at] == pair) & (left >= 0) & (right >= 0), self.made[at], -1)

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word."""
        whole = [self.ranks.get(w) for w in words]
        ids = [[i] for i in whole]
        open_ = [k for k, i in enumerate(whole) if i is None and words[k]]
        for k in (k for k, w in enumerate(words) if not w):
            ids[k] = []
        if open_:
            for k, found in zip(open_, self._replay([words[k] for k in open_]), strict=True):
                ids[k] = found
        return ids

    def _replay(self, words: list[bytes]) -> list[list[int]]:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1)
        n = int(ends[-1]) + 1
        tok = np.full(n, -1, np.int64)  # -1 stands between words and at bytes that a token to the left has taken
        own = np.ones(n, bool)
        own[0] = own[ends] = False
        tok[own] = self.bytes[np.frombuffer(b"".join(words), np.uint8)]
        word_at = np.repeat(np.arange(len(words) + 1, dtype=np.int32), np.append(sizes + 1, 1))  # of a position less 1
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        # the inverted index: at[i] is the token that the pair beginning at i makes; a band of ranks is sorted out at a time
        at = np.append(self._token(tok[:-1], tok[1:]), -1).astype(np.int32)
        for low in range(0, self.top, self.BAND):
            high = low + self.BAND
            places = np.flatnonzero((at >= low) & (at < high))
            if not len(places):
                continue
            places = places[np.argsort(at[places], kind="stable")]
            ranks, starts = np.unique(at[places], return_index=True)
            index = dict(zip(ranks.tolist(), ([x] for x in np.split(places, starts[1:])), strict=True))
            waiting = list(index)
            heapify(waiting)
            while waiting:
                rank = heappop(waiting)
                i = index.pop(rank, None)
                if i is None:
                    continue
                i = np.concatenate(i) if len(i) > 1 else i[0]
                i = i[at[i] == rank]
                if len(i) > 1:
                    # a word's merges go from left to right, and what a merge makes may go before its next one
                    i = np.unique(i)
                    w = word_at[i - 1]
                    first = np.append(True, w[1:] != w[:-1])
                    if not first.all():
                        index[rank] = [i[~first]]
                        heappush(waiting, rank)
                        i = i[first]
                if not len(i):
                    continue
                j = after[i]
                k, h = after[j], before[i]
                tok[i], tok[j], at[j] = rank, -1, -1
                after[i], before[k] = k, i
                touched = np.concatenate((h, i))
                new = self._token(tok[touched], np.concatenate((tok[i], tok[k])))
                at[touched] = new
                soon = (new >= 0) & (new < high)
                if soon.any():
                    places, made = touched[soon], new[soon]
                    order = np.argsort(made, kind="stable")
                    places, made = places[order], made[order]
                    cuts = np.flatnonzero(made[1:] != made[:-1]) + 1
                    for m, group in zip(made[np.append(0, cuts)].tolist(), np.split(places, cuts), strict=True):
                        if m not in index:
                            index[m] = []
                            heappush(waiting, m)
                        index[m].append(group)
        left = tok >= 0
        counts = np.add.reduceat(left, np.append(1, ends[:-1] + 1)[: len(words)]) if len(words) else []
        flat, out, begin = tok[left].tolist(), [], 0
        for c in counts.tolist():
            out.append(flat[begin : begin + c])
            begin += c
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class Codec:
    """Texts to ids and back, over a table of what was met so far.

    A piece is a run without blanks, with the one blank before it if there is one: the tokenizer's pattern never
    matches across such a bound, unless white space stands on both sides of a blank (or a text ends with a blank
    after white space); such texts are matched whole. The table holds the ids of pieces and of the words in them.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, kept: int = KEPT):
        import regex

        self.kept = kept
        self.replay, self.find = MergeReplay(ranks), regex.compile(pattern).findall
        self.by_blanks, self.unbound = pattern == BLANK_BOUND, re.compile(r"\s \s|\s \Z").search
        self.kind = np.dtype("<u2" if self.replay.top <= 2**16 else "<u4")
        self.known: dict[str, bytes] = {}
        self.digits = {i: b"%d" % i for i in self.replay.tokens}

    def pieces(self, text: str) -> list[str]:
        if not text:
            return []
        if not self.by_blanks or self.unbound(text):
            return self.find(text)
        first, *rest = text.split(" ")
        return [first, *map(" ".__add__, rest)] if first else list(map(" ".__add__, rest))

    def _learn(self, pieces: list[str]) -> None:
        """Replays the merges over the words of new pieces, all at once."""
        words, known = [self.find(p) for p in pieces], self.known
        new = list({w for own in words for w in own if w not in known})
        for w, ids in zip(new, self.replay.encode([w.encode("utf-8", "surrogatepass") for w in new]), strict=True):
            known[w] = np.array(ids, self.kind).tobytes()
        for p, own in zip(pieces, words, strict=True):
            if len(own) > 1:
                known[p] = b"".join([known[w] for w in own])

    def __call__(self, texts: list[str]) -> Iterator[list[int]]:
        """The ids of each text."""
        if len(self.known) > self.kept:
            # the older half goes
            for p in list(islice(self.known, len(self.known) // 2)):
                del self.known[p]
        found, new = [], set()
        with uncollected():
            for t in texts:
                pieces = self.pieces(t)
                ids = list(map(self.known.get, pieces))
                if None in ids:
                    new.update(p for p, i in zip(pieces, ids, strict=True) if i is None)
                found.append(ids)
            self._learn(list(new))
        for t, ids in zip(texts, found, strict=True):
            if None in ids:
                ids = [self.known[p] if i is None else i for p, i in zip(self.pieces(t), ids, strict=True)]
            yield np.frombuffer(b"".join(ids), self.kind).tolist()

    def decimal(self, ids: list[int]) -> bytes:
        return b" ".join(map(self.digits.__getitem__, ids))


@lru_cache(maxsize=1)
def _codec(ranks_path: str, pattern: str, kept: int) -> Codec:
    """One for all tasks of a worker, so that what it has met serves the next task, too."""
    return Codec(load_ranks(ranks_path), pattern, kept)


def encoded(docs: DataFrame, ranks_path: str, pattern: str, digests: bool = False, kept: int = KEPT) -> DataFrame:
    """docs' columns but text, with ids array<int>; or with digests of them (n_tokens, ids_sha256, decoded_sha256).

    decoded_sha256 is of the bytes that the ids decode to. kept bounds what a worker remembers, not the result.
    """
    own = [f for f in docs.schema.fields if f.name not in ("text", "ids", "n_tokens", "ids_sha256", "decoded_sha256")]
    head = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in own)
    docs = docs.select(*[F.col(f"`{f.name}`") for f in own], F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = _codec(ranks_path, pattern, kept)
        for batch in batches:
            texts, rows, at = batch["text"].tolist(), [], 0
            while at < len(texts):
                end, chars = at, 0
                while end < len(texts) and chars < CHARS_PER_KEPT * kept:
                    chars += len(texts[end])
                    end += 1
                for ids in codec(texts[at:end]):
                    rows.append((len(ids), hashlib.sha256(codec.decimal(ids)).hexdigest(), hashlib.sha256(codec.replay.decode(ids)).hexdigest()) if digests else ids)
                at = end
            out = batch.drop(columns="text")
            if digests:
                out["n_tokens"], out["ids_sha256"], out["decoded_sha256"] = [[r[i] for r in rows] for i in range(3)]
            else:
                out["ids"] = rows
            yield out

    return docs.mapInPandas(run, head + ("n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>"))


def decoded(encoded_docs: DataFrame, ranks_path: str) -> DataFrame:
    """The other columns, and text: what ids decode to (bytes that aren't UTF-8 become U+FFFD; null ids an empty text)."""
    own = [f for f in encoded_docs.schema.fields if f.name not in ("ids", "text")]
    head = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in own)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = {i: b for b, i in load_ranks(ranks_path).items()}
        for batch in batches:
            out = batch.drop(columns="ids")
            out["text"] = [b"".join(map(tokens.__getitem__, () if ids is None else ids)).decode("utf-8", "replace") for ids in batch["ids"]]
            yield out

    return encoded_docs.select(*[f"`{f.name}`" for f in own], "ids").mapInPandas(run, head + "text string")
