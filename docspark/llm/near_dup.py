"""MinHash near-duplicate groups by a signature-coordinate inverted join.

1. Each document becomes a set of word shingles (64-bit hashes) and a signature of COORDINATES minima.
   Documents with equal sets form one class; only the class's smallest doc_id goes on.
2. Every coordinate-value pair is a posting term. Terms that one document alone has can't collide and are
   skipped. Two documents with MATCHES equal coordinates must share a term among the rarest s - MATCHES + 1
   of either's s remaining terms (prefix filter), so only those are posted.
3. Postings of a term are first linked to its centre, the document whose terms are commonest (a star, not all
   pairs). A document's home is the centre of greatest weight that it resembles. Documents of one home in different
   components are compared in blocks by how their sets differ from the home's, and only links are emitted. Postings
   of one term with different homes and components are joined.
4. Pairs whose signatures agree in MATCHES coordinates are confirmed on their full sets, by the exact test
   100 * |A and B| >= percent * |A or B|. Confirmed links give components by alternating large and small stars.

A pair at similarity 0.8 agrees in 25.6 of 32 coordinates on average; it has fewer than 16 with probability 1e-4.

Null and empty texts have an empty set and link with nothing. Rows of one doc_id with different texts are
separate nodes; a row with a null doc_id gets the smallest id of its group, or null. Repeated rows fall in one class.
Other columns are ignored. The key of a set has 64 bits: two of n different sets share one with probability n^2 / 2^65.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import small, with_row_key, written

COORDINATES = 32
MATCHES = 16
_SEEDS = np.random.default_rng(20240607).integers(1, 2**63, (2, COORDINATES), dtype=np.uint64) | np.uint64(1)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Texts to sorted distinct 64-bit shingle hashes; keeps the hashes of words it has met, up to a bound."""

    KEPT_WORDS = 400_000

    def __init__(self, size: int):
        import xxhash

        self.size, self.words, self.hash = size, {}, xxhash.xxh3_64_intdigest

    def __call__(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.uint64)
        # bytes.lower() changes A-Z alone, and bytes.split() splits at space, tab, \n, \v, \f and \r alone
        words = text.encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.empty(0, np.uint64)
        known = self.words
        if len(known) > self.KEPT_WORDS:
            known.clear()
        try:
            ids = [known[w] for w in words]
        except KeyError:
            for w in words:
                if w not in known:
                    known[w] = self.hash(w)
            ids = [known[w] for w in words]
        h = np.array(ids, np.uint64)
        k = min(self.size, len(h))
        out = np.full(len(h) - k + 1, np.uint64(k))
        for i in range(k):
            out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i])
        return np.unique(out)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minima of COORDINATES hash functions, 32 bits each."""
    out = np.full(COORDINATES, np.uint64(2**64 - 1))
    a, b = _SEEDS
    for at in range(0, len(shingles), 4096):
        x = shingles[at : at + 4096, None] * a + b
        out = np.minimum(out, _mix(x).min(axis=0))
    return (out >> np.uint64(33)).astype(np.int32)


def _key(shingles: np.ndarray) -> int:
    """64 bits that stand for the set."""
    import xxhash

    k = xxhash.xxh3_64_intdigest(shingles.tobytes())
    return k - 2**64 if k >= 2**63 else k


def shingle_sets(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, _h (the text's hash), n_shingles, node (the key of the set) and sig (null for an empty set)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = Shingler(size)
        for batch in batches:
            sets = [of(t) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "_h": batch["_h"], "n_shingles": [len(s) for s in sets], "node": [_key(s) for s in sets], "sig": [signature(s) if len(s) else None for s in sets]})

    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("_h")).mapInPandas(run, "doc_id long, _h long, n_shingles long, node long, sig array<int>")


def _full_sets(docs: DataFrame, size: int) -> DataFrame:
    """The node and the whole shingle set of each row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = Shingler(size)
        for batch in batches:
            sets = [of(t) for t in batch["text"]]
            yield pd.DataFrame({"node": [_key(s) for s in sets], "shingles": [s.view(np.int64) for s in sets]})

    return docs.select("text").mapInPandas(run, "node long, shingles array<long>")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of edges (a, b): component is the smallest node reachable.

    Large star, then small star, until the edges are stars around their smallest nodes; a step is a grouped minimum
    and a join, so a node with a great many edges is pre-aggregated and its rows are split by skew joins. Each round
    is a written table.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = written(both.join(low, "a").where("b > a AND b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")), "large")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        links = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low)
        edges = written(links.distinct(), "small")
        # stars around their smallest nodes: no centre hangs on another, and a node has one centre
        if not edges.join(edges.select(F.col("a").alias("b")), "b", "left_semi").take(1) and not edges.groupBy("a").count().where("count > 1").take(1):
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())


def _agree(a: str, b: str) -> str:
    """SQL for the number of coordinates in which two signatures agree."""
    return " + ".join(f"int({a}[{i}] = {b}[{i}])" for i in range(COORDINATES))


def _alike(pairs: DataFrame, sigs: DataFrame, percent: int) -> DataFrame:
    """a, b, na, nb of the distinct pairs (a, b) whose sizes and signatures allow the threshold."""
    a, b = (sigs.select(F.col("node").alias(x), F.col("sig").alias(f"s{x}"), F.col("n_shingles").alias(f"n{x}")) for x in "ab")
    near = pairs.join(a, "a").join(b, "b").where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    return written(near.where(f"{_agree('sa', 'sb')} >= {MATCHES}").select("a", "b", "na", "nb"), "matched")


def _sets_of(near: DataFrame, sigs: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """node, shingles: the full sets of the nodes in pairs."""
    wanted = near.select("a").union(near.select("b")).withColumnRenamed("a", "node").distinct()
    wanted = written(wanted.join(sigs, "node").select("node", F.coalesce("head.doc_id", F.lit(-(2**63))).alias("_id"), "head._h"), "wanted")
    # a node's text is found by its first row: texts of null-id rows, too
    sets = _full_sets(with_row_key(docs).join(small(wanted), ["_id", "_h"], "left_semi"), size)
    return written(sets.join(small(wanted), "node", "left_semi").dropDuplicates(["node"]), "sets")


def _measured(near: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs with common, the exact size of their sets' intersection."""
    x, y = (sets.select(F.col("node").alias(k), F.col("shingles").alias(f"s{k}")) for k in "ab")
    both = near.join(x, "a").join(y, "b").withColumn("common", F.size(F.array_intersect("sa", "sb")).cast("long"))
    return written(both.drop("sa", "sb"), "measured")


def _links(measured: DataFrame, percent: int) -> DataFrame:
    return measured.where(f"100 * common >= {percent} * (na + nb - common)").select("a", "b")


#: Documents in each side of a block.
BLOCK = 512


def _within_homes(homes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between documents of one home that are in different components. homes: node, home, part, base (the
    home's component).

    |x and y| = |h| - |h\\x or h\\y| + |x\\h and y\\h|, so a pair is measured by what its sets differ in from the home's.
    """
    apart = F.col("part") != F.col("base")
    slot = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    sizes = homes.groupBy("home").agg(F.count(F.when(apart, 1)).alias("x"), F.count("*").alias("y")).where("x > 0")
    sizes = written(sizes.select("home", F.ceil(F.col("x") / BLOCK).alias("xs"), F.ceil(F.col("y") / BLOCK).alias("ys")), "homesizes")
    own = sets.select("node", F.col("shingles").alias("s"))
    # a large home is dealt out before it meets its centre's set, which goes to each of the slots
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("ys") - 1)).alias("slot")
    centre = sizes.select("home", each).join(sets.select(F.col("node").alias("home"), F.col("shingles").alias("h")), "home")
    rows = homes.join(small(sizes), "home").join(own, "node").withColumn("slot", slot("ys")).join(centre, ["home", "slot"])
    rows = rows.select("home", "node", "part", apart.alias("apart"), "xs", "ys", F.size("s").alias("n"), F.size("h").alias("nh"), F.array_except("h", "s").alias("minus"), F.array_except("s", "h").alias("plus"))
    left = rows.where("apart").select("*", slot("xs").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("ys") - 1)).alias("j"), F.lit(True).alias("left"))
    right = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("xs") - 1)).alias("i"), slot("ys").alias("j"), F.lit(False).alias("left"))
    columns = ["home", "i", "j", "left", "node", "part", "n", "nh", "minus", "plus"]

    def compare(block: pd.DataFrame) -> pd.DataFrame:
        x, y = block[block["left"]], block[~block["left"]]
        if not len(x) or not len(y):
            return pd.DataFrame({"a": [], "b": []}).astype("int64")
        less, more = (_overlaps(x[c], y[c]) for c in ("minus", "plus"))
        sizes_x, sizes_y = (np.array([len(m) for m in side["minus"]]) for side in (x, y))
        common = int(block["nh"].iloc[0]) - (sizes_x[:, None] + sizes_y[None, :] - less) + more
        total = x["n"].to_numpy()[:, None] + y["n"].to_numpy()[None, :]
        linked = (100 * common >= percent * (total - common)) & (x["part"].to_numpy()[:, None] != y["part"].to_numpy()[None, :])
        i, j = np.nonzero(linked)
        out = pd.DataFrame({"a": x["node"].to_numpy()[i], "b": y["node"].to_numpy()[j], "part": y["part"].to_numpy()[j]})
        # one link to each component is enough
        return out.drop_duplicates(["a", "part"])[["a", "b"]]

    return left.select(columns).union(right.select(columns)).groupBy("home", "i", "j").applyInPandas(compare, "a long, b long")


def _overlaps(x: pd.Series, y: pd.Series) -> np.ndarray:
    """Sizes of the intersections of each of x with each of y."""
    out = np.zeros((len(x), len(y)), np.int64)
    sides = []
    for side in (x, y):
        sizes = [len(e) for e in side]
        values = np.concatenate([np.asarray(e, np.int64) for e in side]) if sum(sizes) else np.empty(0, np.int64)
        order = np.argsort(values, kind="stable")
        sides.append((values[order], np.repeat(np.arange(len(sizes)), sizes)[order]))
    (vx, rx), (vy, ry) = sides
    shared = np.intersect1d(vx, vy)
    bounds = [np.searchsorted(v, shared, side) for v in (vx, vy) for side in ("left", "right")]
    for a, b, c, d in zip(*(b.tolist() for b in bounds), strict=True):
        out[rx[a:b, None], ry[None, c:d]] += 1
    return out


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, _h (the text's hash), n_shingles, component_id and kept for each row."""
    return _judged(docs, size, percent).drop("first_id", "first_h")


def near_copies(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """_id and _h (the keys of with_row_key) of all rows but the first of each group: the one with the smallest doc_id
    (null ids after all others), then hash. Rows without words are in no group."""
    judged = _judged(docs, size, percent).where("n_shingles > 0 AND NOT (doc_id <=> first_id AND _h = first_h)")
    return judged.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("_id"), "_h").distinct()


def _judged(docs: DataFrame, size: int, percent: int) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    rows = written(shingle_sets(docs, size), "signatures")
    sigs = written(rows.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("low"), F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "_h")).alias("head"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n_shingles")), "classes")
    # a term holds the coordinate in its upper and the value in its lower 32 bits
    terms = sigs.select("node", F.posexplode("sig").alias("i", "v")).select("node", F.expr("shiftleft(bigint(i), 32) | bigint(v) AS term"))
    counts = written(terms.groupBy("term").agg(F.count("*").alias("n")).where("n > 1"), "terms")
    rarest = terms.join(counts, "term").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "term"))).alias("t")).where(f"size(t) >= {MATCHES}")
    # a document that many others come from has the commonest terms: it is the best centre of a star
    postings = rarest.select("node", F.expr("aggregate(t, 0L, (s, x) -> s + x.n) AS weight"), F.explode(F.expr(f"slice(t, 1, size(t) - {MATCHES} + 1).term")).alias("term"))
    postings = written(postings, "postings")

    centre = postings.groupBy("term").agg(F.max(F.struct("weight", "node")).alias("c")).select("term", F.col("c.node").alias("b"), F.col("c.weight").alias("weight"))
    star = postings.drop("weight").join(centre, "term").where("node <> b").groupBy(F.col("node").alias("a"), "b").agg(F.max("weight").alias("weight"))
    star = written(star, "star")
    near = _alike(star.select("a", "b"), sigs, percent)
    sets = _sets_of(near, sigs, docs, size)
    links = _links(_measured(near, sets), percent)
    parts = written(components(links), "parts")

    part = F.coalesce("component", "node").alias("part")
    home = star.join(near.select("a", "b"), ["a", "b"], "left_semi").groupBy(F.col("a").alias("node")).agg(F.max(F.struct("weight", "b")).alias("m")).select("node", F.col("m.b").alias("home"))
    bases = parts.withColumnsRenamed({"node": "home", "component": "base"})
    homes = written(home.join(parts, "node", "left").select("node", "home", part).join(bases, "home", "left").select("node", "home", "part", F.coalesce("base", "home").alias("base")), "homes")
    links = written(links.union(_within_homes(homes, sets, percent)), "links")
    parts = written(components(links), "parts")

    placed = postings.join(parts, "node", "left").select("term", "node", part).join(homes.select("node", "home"), "node", "left")
    placed = written(placed.select("term", "node", "part", F.coalesce("home", "node").alias("home")), "placed")
    spread = placed.groupBy("term").agg(F.ceil(F.count("*") / BLOCK).alias("cells"), *[f(c).alias(f"{n}{c}") for c in ("part", "home") for f, n in ((F.min, "lo"), (F.max, "hi"))]).where("lopart <> hipart AND lohome <> hihome").select("term", "cells")
    open_ = written(placed.join(spread, "term").join(sigs.select("node", "sig", "n_shingles"), "node"), "open")
    # a common term's postings are compared in cells of BLOCK by BLOCK
    slot, all_ = F.pmod(F.xxhash64("node"), F.col("cells")), F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1))
    side = lambda k: [F.col(c).alias(f"{k}{c}") for c in ("node", "part", "home", "sig", "n_shingles")]
    x, y = open_.select("term", slot.alias("i"), all_.alias("j"), *side("a")), open_.select("term", all_.alias("i"), slot.alias("j"), *side("b"))
    alike = F.expr(f"apart <> bpart AND ahome <> bhome AND anode > bnode AND 100 * least(an_shingles, bn_shingles) >= {percent} * greatest(an_shingles, bn_shingles) AND {_agree('asig', 'bsig')} >= {MATCHES}")
    across = x.join(y, (x.term == y.term) & (x.i == y.i) & (x.j == y.j) & alike).select(F.col("anode").alias("a"), F.col("bnode").alias("b")).distinct()
    tried = near.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    more = _alike(written(across.join(tried, ["a", "b"], "left_anti"), "across"), sigs, percent)
    if more.take(1):
        links = links.union(_links(_measured(more, _sets_of(more, sigs, docs, size)), percent))
        parts = written(components(links), "parts")

    lows = written(sigs.select("node", "low", "head").join(parts, "node", "left").select("node", "low", "head", F.coalesce("component", "node").alias("component")), "lows")
    roots = lows.groupBy("component").agg(F.min("low").alias("component_id"), F.min("head").alias("head"))
    named = written(lows.drop("head").join(roots, "component").select("node", "component_id", F.col("head.doc_id").alias("first_id"), F.col("head._h").alias("first_h")), "named")
    own = F.coalesce("component_id", "doc_id")
    return rows.join(named, "node", "left").select("doc_id", "_h", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(False)).alias("kept"), "first_id", "first_h")
