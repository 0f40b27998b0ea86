"""Document fingerprints from closed syncmers.

A k-mer of K code points is a closed syncmer if the smallest (by hash) of its S-mers stands at its start or its
end. That depends on the k-mer alone, so an edit elsewhere neither adds nor removes an anchor. A document's anchors are
its syncmers' hashes with their places; a text without syncmers (all of under K code points, some of up to 21) has one
anchor, all of it, and an empty text has none. So equal texts have equal anchors, and only an empty text has none.

Likeness is the Jaccard similarity of two sets of anchors, all of them (two empty ones: 1). Places serve positional
matching: of the anchors that two texts share, the aligned ones are those that moved by the commonest distance.
A fingerprint, as written, is the number of distinct anchors and the SKETCH smallest hashes, so its size is bounded;
estimate() tells the likeness from two of them with a standard error of at most 0.5 / sqrt(SKETCH), exactly if both
texts have at most SKETCH anchors.

A null text counts as empty. Order is by doc_id (null first), then text hash; repeated rows follow one another.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import with_row_key, written

K = 16
S = 9
SKETCH = 128
#: Bytes of text in a part of edited_likeness, and how many parts (bounds on the driver) there are at most.
PART_BYTES = 32 * 2**20
MOST_PARTS = 100_000
_P = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    return (x ^ (x >> np.uint64(27))) * _M2


def anchors(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the text's closed syncmers."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    at = np.empty(0, np.int64)
    if len(codes) >= K:
        small = _mix(_poly(codes, S))
        w = K - S + 1  # 8 inner substrings
        low, span = small, 1
        while span < w:
            step = min(span, w - span)
            low = np.minimum(low[:-step], low[step:])
            span += step
        at = np.flatnonzero((low == small[: len(low)]) | (low == small[w - 1 :]))
    if len(at):
        return _mix(_poly(codes, K)[at]), at
    whole = np.array([int.from_bytes(hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()[:8], "little")], np.uint64)
    return (whole, np.zeros(1, np.int64)) if len(codes) else (codes, at)


def _poly(codes: np.ndarray, width: int) -> np.ndarray:
    """A polynomial hash of each run of `width` code points."""
    if width == 1:
        return codes + np.uint64(1)
    half = width // 2
    short = _poly(codes, half)
    power = np.uint64(pow(int(_P), half, 2**64))
    both = short[: len(short) - half] * power + short[half:]
    return both if width % 2 == 0 else both[: len(codes) - width + 1] * _P + codes[width - 1 :]


def distinct(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The text's anchors, each at its first place, in order of their hashes."""
    h, at = anchors(text)
    h, first = np.unique(h, return_index=True)
    return h, at[first]


def compared(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[float, int]:
    """Likeness and aligned anchors of two texts, from their distinct anchors."""
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0])), 0
    common, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    moved = np.unique(a[1][i] - b[1][j], return_counts=True)[1]
    return len(common) / (len(a[0]) + len(b[0]) - len(common)), int(moved.max()) if len(moved) else 0


def shown(a: tuple[np.ndarray, np.ndarray]) -> str:
    """The fingerprint: the number of anchors and the smallest hashes, in hexadecimal digits."""
    return f"{len(a[0]):x}:" + a[0][:SKETCH].astype(">u8").tobytes().hex()


def estimate(a: str, b: str) -> float:
    """Likeness from two fingerprints."""
    x, y = ({f[k : k + 16] for k in range(0, len(f), 16)} for f in (a.partition(":")[2], b.partition(":")[2]))
    if not x or not y:
        return float(len(x) == len(y))
    full = all(int(f.partition(":")[0], 16) <= SKETCH for f in (a, b))
    merged = x | y if full else set(sorted(x | y)[:SKETCH])
    return len(x & y & merged) / len(merged)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of each row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "fingerprint": [shown(distinct(t or "")) for t in batch["text"]]})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, fingerprint string")


def edited_likeness(docs: DataFrame) -> DataFrame:
    """Each text against itself with its last quarter replaced by the next document's beginning, and against the next.

    Rows are dealt by ranges of doc_id whose bounds are quantiles, to parts of about PART_BYTES of text (more if that
    would be over MOST_PARTS parts; a part is streamed, so its size isn't a matter of memory). Each part gets the first
    row of the next part as well, so one shuffle brings every document together with its successor.
    """
    docs = with_row_key(docs.select(F.col("doc_id").cast("long"), "text")).withColumn("text", F.coalesce("text", F.lit("")))
    keys = written(docs.select("_id", "_h", F.octet_length("text").alias("n")), "keys")
    rows, size = keys.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    n = max(1, min(MOST_PARTS, size // PART_BYTES, rows))
    bounds = np.unique(keys.approxQuantile("_id", [i / n for i in range(1, n)], 0.2 / n)).astype(np.int64) if n > 1 else np.empty(0, np.int64)

    @F.pandas_udf("int")
    def part_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, ids.to_numpy(np.int64), side="right").astype(np.int32))

    # at most a row for each of the parts
    firsts = sorted((r.part, r.first._id, r.first._h) for r in keys.select("_id", "_h", part_of("_id").alias("part")).groupBy("part").agg(F.min(F.struct("_id", "_h")).alias("first")).collect())
    # the first row of each part goes to the part before it, too; that of the first part to the last
    heads = [(firsts[k - 1][0], i, h) for k, (_, i, h) in enumerate(firsts)]
    heads = docs.sparkSession.createDataFrame(heads, "part int, _id long, _h long")
    columns = ["part", "_id", "_h", "doc_id", "text"]
    ahead = docs.join(F.broadcast(heads), ["_id", "_h"]).select(columns).dropDuplicates(["part"]).withColumn("ahead", F.lit(True))
    dealt = docs.withColumn("part", part_of("_id")).select(columns).withColumn("ahead", F.lit(False)).union(ahead)
    dealt = dealt.repartition(n, "part").sortWithinPartitions("part", "ahead", "_id", "_h").select("part", "ahead", "doc_id", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None
        for batch in batches:
            rows = []
            for part, ahead, i, text in batch.itertuples(index=False):
                own = distinct(text)
                if last is not None and last[0] == part:
                    rows.append(_row(*last[1:], text, own))
                last = None if ahead else (part, i, text, own)
            out = pd.DataFrame(rows, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "aligned_edited", "aligned_next"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return dealt.mapInPandas(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, aligned_edited long, aligned_next long")


def _row(i, text: str, own: tuple, after: str, theirs: tuple) -> tuple:
    cut = len(text) // 4
    edited = text[: len(text) - cut] + after[:cut]
    changed = own if edited == text else distinct(edited)
    (near, aligned), (near_next, aligned_next) = compared(own, changed), compared(own, theirs)
    return i, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), shown(own), shown(changed), near, near_next, aligned, aligned_next
