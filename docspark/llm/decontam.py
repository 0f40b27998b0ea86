"""Benchmark decontamination by a distributed positional inverted index (DataFrame operations only).

1. Benchmark items become windows of WINDOW consecutive words (a shorter item is one window).
2. One pass over the documents counts how often each benchmark word occurs in them. A window with a word that
   occurs nowhere can't occur and is dropped; of each other window the ANCHORS rarest words are its anchors.
3. The index holds the postings (word, document, position) of the ANCHORS rarest words of the windows. Lists are
   intersected from the rarest word on: a posting of it minus its offset is a place where the window may begin, and
   stays a candidate if the next word has a posting at its own offset from there, to within 2 * SLOP places.
4. For the documents that still have a candidate, the index is widened to the postings of all words of the windows, and
   the lists of all of a candidate's words are intersected: a phrase has each word of the window at its offset, a near
   match has each word within SLOP places of its offset (so two words may be swapped, or one put in between).

Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z in lower case. A null text has no words; an item
without words has no window; items with one id and equal windows count once; an item with a null id marks words
as hit but isn't counted or listed. Rows equal in doc_id and text share their results. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docspark.llm.common import small, with_row_key, written

WINDOW = 10
ANCHORS = 2
SLOP = 1
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The text's words in order."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _BETWEEN), "")


def windows(benchmark: DataFrame, length: int = WINDOW) -> DataFrame:
    """item_id, win (its words): each distinct window of each item."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("w")).where("size(w) > 0")
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - length, F.lit(0)))
    return items.select("item_id", "w", F.explode(starts).alias("i")).select("item_id", F.slice("w", F.col("i") + 1, F.lit(length)).alias("win")).distinct()


def _tokens(docs: DataFrame) -> DataFrame:
    return docs.select("_id", "_h", F.posexplode(words_of(F.col("text"))).alias("pos", "word"))


def anchors(docs: DataFrame, wins: DataFrame, count: int = ANCHORS) -> DataFrame:
    """win_id, word, off, r, k: the k <= count rarest words of each window that may occur, the r-th, each at its first offset."""
    words = small(written(wins.select(F.explode("win").alias("word")).distinct(), "benchwords"))
    df = written(docs.select(F.explode(words_of(F.col("text"))).alias("word")).join(words, "word").groupBy("word").agg(F.count("*").alias("df")), "frequency")
    placed = wins.select("win_id", F.posexplode("win").alias("off", "word")).groupBy("win_id", "word").agg(F.min("off").alias("off"))
    placed = placed.join(df, "word", "left")
    each = Window.partitionBy("win_id")
    ranked = placed.withColumns({"least": F.min(F.coalesce("df", F.lit(0))).over(each), "r": F.row_number().over(each.orderBy("df", "word"))})
    return ranked.where(f"least > 0 AND r <= {count}").select("win_id", "word", "off", "r", F.count("*").over(each).alias("k"))


def postings(docs: DataFrame, words: DataFrame, name: str = "postings") -> DataFrame:
    """word, _id, _h, pos: the positional index of these words, as a written table."""
    wanted = small(written(words.select("word").distinct(), "indexedwords"))
    return written(_tokens(docs).join(wanted, "word", "left_semi").distinct(), name)


def candidates(index: DataFrame, anchor: DataFrame, slop: int) -> DataFrame:
    """_id, _h, win_id, start: places by the rarest word of the window at which its other anchors stand to within 2 * slop."""
    asked = ["_id", "_h", "win_id", "start", "k"]
    found = index.join(small(anchor.where("r = 1")), "word").select("_id", "_h", "win_id", (F.col("pos") - F.col("off")).alias("start"), "k")
    for r in range(2, ANCHORS + 1):
        spots = F.explode(F.sequence(F.col("start") + F.col("off") - 2 * slop, F.col("start") + F.col("off") + 2 * slop)).alias("pos")
        probes = found.where(f"k >= {r}").join(small(anchor.where(f"r = {r}").drop("k", "r")), "win_id").select(*asked, "word", spots)
        met = probes.join(index, ["_id", "_h", "word", "pos"], "left_semi").select(asked)
        found = met.distinct().union(found.where(f"k < {r}"))
    return found.drop("k")


def _confirmed(found: DataFrame, words: DataFrame, index: DataFrame, slop: int) -> DataFrame:
    """Those candidates (with the window's len) of which each word stands within slop of its place."""
    asked = found.join(small(words), "win_id").select("_id", "_h", "win_id", "start", "len", "off", "word", (F.col("start") + F.col("off")).alias("pos"))
    if slop:
        asked = asked.withColumn("pos", F.explode(F.sequence(F.col("pos") - slop, F.col("pos") + slop)))
    there = asked.join(index, ["_id", "_h", "pos", "word"], "left_semi")
    there = there.select("_id", "_h", "win_id", "start", "len", "off").distinct() if slop else there
    return there.groupBy("_id", "_h", "win_id", "start").agg(F.count("*").alias("n"), F.first("len").alias("len")).where("n = len").drop("n")


def matches(docs: DataFrame, wins: DataFrame, slop: int = SLOP) -> tuple[DataFrame, DataFrame]:
    """Phrases: _id, _h, win_id, start, len of every occurrence of a window in a document (docs has _id and _h).
    Near matches: _id, _h, win_id of the windows that occur in no such way but within slop."""
    anchor = written(anchors(docs, wins), "anchors")
    words = wins.select("win_id", F.size("win").alias("len"), F.posexplode("win").alias("off", "word"))
    words = written(words.join(anchor.select("win_id").distinct(), "win_id", "left_semi"), "windowwords")
    found = written(candidates(postings(docs, anchor), anchor, slop), "candidates")
    keys = small(written(found.select("_id", "_h").distinct(), "candidatekeys"))
    wide = postings(docs.join(keys, ["_id", "_h"], "left_semi"), words, "widepostings")
    phrases = written(_confirmed(found.where("start >= 0"), words, wide, 0), "phrases")
    open_ = found.join(phrases.select("_id", "_h", "win_id").distinct(), ["_id", "_h", "win_id"], "left_anti")
    # the rarest word may stand beside its place, too
    open_ = open_.select("_id", "_h", "win_id", F.explode(F.sequence(F.col("start") - slop, F.col("start") + slop)).alias("start")).distinct()
    return phrases, written(_confirmed(open_, words, wide, slop).select("_id", "_h", "win_id").distinct(), "near")


def contamination(docs: DataFrame, benchmark: DataFrame, length: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (sorted ids), contaminated, n_near (items with a window that occurs or
    is near) for each row of docs."""
    return keyed_contamination(docs, benchmark, length, slop).drop("_id", "_h")


def keyed_contamination(docs: DataFrame, benchmark: DataFrame, length: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """As contamination, with _id and _h, the keys of with_row_key."""
    docs = with_row_key(docs.select("doc_id", "text"))
    items = written(windows(benchmark, length).withColumn("win_id", F.xxhash64("win")), "windows")
    wins = written(items.select("win_id", "win").distinct(), "distinctwindows")
    hits, near = matches(docs, wins, slop)
    spots = hits.select("_id", "_h", F.explode(F.expr("sequence(start, start + len - 1)")).alias("pos")).distinct()
    covered = spots.groupBy("_id", "_h").agg(F.count("*").alias("n_hit"))
    ids = small(written(items.where("item_id IS NOT NULL").select("win_id", F.col("item_id").cast("string").alias("item")).distinct(), "windowitems"))
    listed = hits.select("_id", "_h", "win_id").distinct().join(ids, "win_id").groupBy("_id", "_h").agg(F.sort_array(F.collect_set("item")).alias("items"))
    close = hits.select("_id", "_h", "win_id").union(near).distinct().join(ids, "win_id").select("_id", "_h", "item").distinct().groupBy("_id", "_h").agg(F.count("*").alias("n_near"))
    marks = written(covered.join(listed, ["_id", "_h"], "left").join(close, ["_id", "_h"], "full"), "marks")
    counted = docs.select("doc_id", "_id", "_h", F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    none = F.lit(0).cast("long")
    hit, found = F.coalesce("n_hit", none), F.coalesce("items", F.array().cast("array<string>"))
    return counted.join(small(marks), ["_id", "_h"], "left").select(
        "doc_id", "_id", "_h", "n_words", hit.alias("n_hit"), F.size(found).cast("long").alias("n_items"), found.alias("items"), (hit > 0).alias("contaminated"), F.coalesce("n_near", none).alias("n_near")
    )
