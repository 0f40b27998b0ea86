"""Token-id files with a minimal perfect hash index.

A shard is two files in the shared folder:
  <shard>.ids   the raw ids of its documents one after another, little-endian unsigned, ID_BYTES each
  <shard>.idx   the index: a minimal perfect hash from document key to slot, and for each slot the key's
                fingerprint, the document's first id and its number of ids
A lookup hashes the key through the levels' bit arrays to its slot, compares the fingerprint and reads that range:
constant time whatever the shard's size.

Documents are dealt to shards by ranges of doc_id and sorted in them, so the shards in order hold all ids in
ascending doc_id order. Every attempt of a task writes files of its own name; the key table, committed by Spark,
names those that count. Null ids come first; a null text has only the end id. Rows of one doc_id are in order of
their text's hash; rows equal in both are told apart by a running number. Other columns are ignored.
"""

from __future__ import annotations

import io
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docspark.llm.common import new_folder, small, uncollected, with_row_key, written

ID_BYTES = 2
END_ID = 1
#: Bytes of text that go to a shard, and shards whose starts are summed up together.
SHARD_BYTES = 32 * 2**20
SHARDS_AT_ONCE = 1000
KEPT_PIECES = 900_000
_MAGIC = b"DSIDX001"


def _hashes(keys: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hashes of key rows (uint64 columns)."""
    with np.errstate(over="ignore"):
        h = np.full(len(keys), np.uint64((seed * 0x9E3779B97F4A7C15 + 0x243F6A8885A308D3) % 2**64))
        for c in range(keys.shape[1]):
            h = (h ^ keys[:, c]) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(29)
            h = h * np.uint64(0x94D049BB133111EB)
            h ^= h >> np.uint64(32)
    return h


class PerfectHash:
    """Levels of bit arrays: a key's slot is the rank of the first level's bit that it alone had set."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.before = np.cumsum([0, *(int(x.sum()) for x in levels)])
        self.ranks = [np.cumsum(x, dtype=np.int64) - 1 for x in levels]

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], np.arange(len(keys))
        while len(left):
            if len(levels) > 200:
                raise ValueError("keys are not distinct")
            size = max(8, int(len(left) * 1.6))
            at = (_hashes(keys[left], len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            left = left[~alone[at]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slots of the keys, -1 for those that no level has."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for k, level in enumerate(self.levels):
            at = (_hashes(keys[left], k) % np.uint64(len(level))).astype(np.int64)
            hit = level[at]
            out[left[hit]] = self.before[k] + self.ranks[k][at[hit]]
            left = left[~hit]
        return out


def index_bytes(keys: np.ndarray, lengths: np.ndarray) -> bytes:
    """The .idx file for documents with these keys and numbers of ids, in the order of the .ids file."""
    mph, n = PerfectHash.build(keys), len(keys)
    slot = mph.slots(keys)
    prints, starts, sizes = np.empty(n, "<u4"), np.empty(n, "<u8"), np.empty(n, "<u8")
    prints[slot] = _hashes(keys, 1_000_003).astype(np.uint32)
    starts[slot] = np.cumsum(lengths) - lengths
    sizes[slot] = lengths
    out = io.BytesIO()
    out.write(_MAGIC + struct.pack("<QQII", n, int(lengths.sum()), ID_BYTES, len(mph.levels)))
    for level in mph.levels:
        out.write(struct.pack("<Q", len(level)) + np.packbits(level).tobytes())
    for column in (prints, starts, sizes):
        out.write(column.tobytes())
    return out.getvalue()


class Shard:
    """A shard's files, open for keyed reading."""

    def __init__(self, path: str):
        self.fs, at = _filesystem(path)
        with self.fs.open_input_stream(at + ".idx") as f:
            data = f.read()
        n, self.n_ids, self.width, levels = struct.unpack_from("<QQII", data, 8)
        if data[:8] != _MAGIC:
            raise ValueError(f"{path}: not an index")
        pos, bits = 32, []
        for _ in range(levels):
            (size,) = struct.unpack_from("<Q", data, pos)
            held = (size + 7) // 8
            bits.append(np.unpackbits(np.frombuffer(data, np.uint8, held, pos + 8), count=size).astype(bool))
            pos += 8 + held
        self.mph, self.columns = PerfectHash(bits), []
        for kind in ("<u4", "<u8", "<u8"):
            self.columns.append(np.frombuffer(data, kind, n, pos))
            pos += self.columns[-1].nbytes
        self.file = self.fs.open_input_file(at + ".ids")

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First id and number of ids of each key; raises if a key isn't there."""
        slot = self.mph.slots(keys)
        prints, starts, sizes = self.columns
        if (slot < 0).any() or (prints[slot] != _hashes(keys, 1_000_003).astype(np.uint32)).any():
            raise KeyError("a key is not in the shard")
        return starts[slot].astype(np.int64), sizes[slot].astype(np.int64)

    def ids(self, start: int, size: int) -> np.ndarray:
        return np.frombuffer(self.file.read_at(size * self.width, start * self.width), f"<u{self.width}")


def _filesystem(path: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path)


def _keys(ids: pd.Series, hashes: pd.Series, copies: pd.Series) -> np.ndarray:
    return np.column_stack([c.to_numpy(np.int64).view(np.uint64) for c in (ids, hashes, copies)])


#: A piece that ends with ASCII punctuation after a Latin letter (whose lower case is one letter, too); the tokenizer always splits there.
_TAILED = re.compile(r"(.*[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0131-\u024F])([!-&(-;=-@\[-`{-~]+)", re.S)


class PieceTokenizer:
    """Texts to the raw bytes of their ids. The tokenizer drops white space and treats what stands between blanks
    separately, so each distinct piece between blanks is encoded once and its ids are kept; so is what a piece is
    without the punctuation at its end, in lower case if it is ASCII (the tokenizer lower-cases). New pieces are encoded
    many at a time, with a mark of one id between them. Texts with a special token of the file are encoded whole."""

    AT_ONCE = 100

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {}
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.mark, self.mark_id = next((c, i[0]) for c in "\u00a7\u00b6\u00a4~^" if len(i := self._encode([c])[0]) == 1)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: set[str]) -> None:
        known, parts = self.known, {}
        for p in pieces:
            m = _TAILED.fullmatch(p)
            core = m[1] if m else p
            parts[p] = [core.lower() if core.isascii() else core, m[2]] if m else [core.lower() if core.isascii() else core]
        new = list({x for own in parts.values() for x in own if x not in known})
        odd = [p for p in new if self.mark in p]
        plain = [p for p in new if self.mark not in p]
        groups = [plain[at : at + self.AT_ONCE] for at in range(0, len(plain), self.AT_ONCE)]
        for part, found in zip(groups, self._encode([f" {self.mark} ".join(g) for g in groups]), strict=True):
            ids = np.array(found, f"<u{ID_BYTES}")
            cuts = np.flatnonzero(ids == self.mark_id)
            if len(cuts) != len(part) - 1:
                odd += part
                continue
            data = ids.tobytes()
            bounds = (np.concatenate(([0], cuts + 1)) * ID_BYTES).tolist(), (np.append(cuts, len(ids)) * ID_BYTES).tolist()
            known.update((p, data[i:j]) for p, i, j in zip(part, *bounds, strict=True))
        for p, ids in zip(odd, self._encode(odd), strict=True):
            known[p] = np.array(ids, f"<u{ID_BYTES}").tobytes()
        known.update((p, b"".join([known[x] for x in own])) for p, own in parts.items())

    def _whole(self, text: str) -> bytes:
        return np.array(self._encode([text])[0], f"<u{ID_BYTES}").tobytes()

    def __call__(self, texts: list[str]) -> Iterator[bytes]:
        if len(self.known) > KEPT_PIECES:
            # the older half goes
            for p in list(islice(self.known, len(self.known) // 2)):
                del self.known[p]
        end = END_ID.to_bytes(ID_BYTES, "little")
        found, new = [], set()
        with uncollected():
            for t in texts:
                if any(s in t for s in self.special):
                    found.append([self._whole(t)])
                    continue
                pieces = t.replace("\n", " ").split(" ")
                ids = list(map(self.known.get, pieces))
                if None in ids:
                    new.update(p for p, i in zip(pieces, ids, strict=True) if i is None)
                found.append(ids)
            self._learn(new)
        for t, ids in zip(texts, found, strict=True):
            if None in ids:
                ids = [self.known[p] if i is None else i for p, i in zip(t.replace("\n", " ").split(" "), ids, strict=True)]
            yield b"".join(ids) + end


@lru_cache(maxsize=1)
def _tokenizer(path: str) -> PieceTokenizer:
    """One for all tasks of a worker, so that what it has learned serves the next shard, too."""
    return PieceTokenizer(path)


def write_ids(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Writes the files. The key table: shard, path, doc_id, _id, _h, copy."""
    folder = new_folder(docs.sparkSession, "ids")
    rows, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    n = max(1, min(rows, size // SHARD_BYTES))
    docs = with_row_key(docs.select(F.col("doc_id").cast("long"), "text")).withColumn("text", F.coalesce("text", F.lit("")))
    # both columns have the order of doc_id, so the shards have it too
    dealt = docs.repartitionByRange(n, "_id", "_h").sortWithinPartitions("_id", "_h")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        encode, shard = _tokenizer(tokenizer_path), TaskContext.get().partitionId()
        path = f"{folder}/{shard:06d}-{uuid.uuid4().hex[:8]}"
        fs, at = _filesystem(path)
        fs.create_dir(at.rpartition("/")[0], recursive=True)
        kept, lengths, last, copy = [], [], None, 0
        with fs.open_output_stream(at + ".ids") as out:
            for batch in batches:
                for start in range(0, len(batch), 1000):
                    part = batch.iloc[start : start + 1000]
                    for data in encode(part["text"].tolist()):
                        out.write(data)
                        lengths.append(len(data) // ID_BYTES)
                copies = []
                for key in zip(batch["_id"], batch["_h"], strict=True):
                    copy = copy + 1 if key == last else 0
                    last = key
                    copies.append(copy)
                head = pd.DataFrame({"shard": shard, "path": path, "doc_id": batch["doc_id"].astype("Int64"), "_id": batch["_id"], "_h": batch["_h"], "copy": copies})
                kept.append(_keys(head["_id"], head["_h"], head["copy"]))
                yield head
        if lengths:
            with fs.open_output_stream(at + ".idx") as out:
                out.write(index_bytes(np.concatenate(kept), np.array(lengths, np.int64)))

    return written(dealt.mapInPandas(run, "shard int, path string, doc_id long, _id long, _h long, copy long"), "keys")


def read_ids(keys: DataFrame) -> DataFrame:
    """For each row of the key table, from the files: its shard, first id in it, n_tokens, ids array<int>."""
    return keys.repartition("shard").sortWithinPartitions("shard", "_id", "_h", "copy").mapInPandas(
        _reader(lambda ids: {"ids": [x.astype(np.int32) for x in ids]}), "shard int, doc_id long, local long, n_tokens long, shard_ids long, ids array<int>"
    )


def _reader(show):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard = None
        for batch in batches:
            for path, part in batch.groupby("path", sort=False):
                if shard is None or shard[0] != path:
                    shard = path, Shard(path)
                start, size = shard[1].find(_keys(part["_id"], part["_h"], part["copy"]))
                out = pd.DataFrame({"shard": part["shard"].to_numpy(), "doc_id": part["doc_id"].astype("Int64").array, "local": start, "n_tokens": size, "shard_ids": shard[1].n_ids})
                yield out.assign(**show(shard[1].ids(s, n) for s, n in zip(start, size, strict=True)))

    return run


def id_digests(keys: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, read back from the files."""
    crc = _reader(lambda ids: {"ids_crc32": [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]})
    read = written(keys.repartition("shard").mapInPandas(crc, "shard int, doc_id long, local long, n_tokens long, shard_ids long, ids_crc32 long"), "read")
    # one row a shard: running sums within blocks of shards, and over the blocks
    sizes = written(read.groupBy("shard").agg(F.first("shard_ids").alias("n")).withColumn("block", F.floor(F.col("shard") / SHARDS_AT_ONCE)), "sizes")
    blocks = sizes.groupBy("block").agg(F.sum("n").alias("all"))
    blocks = blocks.select("block", (F.sum("all").over(Window.orderBy("block")) - F.col("all")).alias("before"))
    within = F.sum("n").over(Window.partitionBy("block").orderBy("shard")) - F.col("n")
    base = written(sizes.withColumn("within", within).join(blocks, "block").select("shard", (F.col("before") + F.col("within")).alias("base")), "bases")
    return read.join(small(base), "shard").select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")
