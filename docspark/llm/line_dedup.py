"""Line dedup by a deletion-neighbourhood join (DataFrame operations only).

A line is the sequence of its words, split at white space. Edits are counted in words: a line's neighbourhood is
itself and the line without any one of its words, as hashed keys. A key is the xor of one hash for each word and its
place, so that the keys of a line follow from one another. Two lines within one edit share a key:
  - a word replaced: both without the word at that place, so the key holds the place too;
  - a word inserted: the shorter line is the longer one without that word.

1. Lines of min_words words or more get a 128-bit key; equal lines form a class with its earliest place
   (doc_id, text hash, line number).
2. Two classes of near_words words or more within one edit agree in the first or the last half of the shorter
   one. Classes that share no half with another class have no partner, and emit nothing.
3. The others emit their neighbourhoods. Keys of one class alone go; of the rest, grouped minima give each class the
   earliest class under each equal key (never all pairs under a key); the pairs are verified word by word.
4. A line is dropped if an equal line stands earlier, or a line within one edit does, dropped or not.

Lines without words are never dropped, and those of under near_words words only if equal. Its default is 5: one edit in
fewer words is a similarity below 0.8, and with 1, all lines of one word would be one another's near copies. A null
text stays null and has no lines. Rows equal in doc_id and text count as one document and keep the same lines. Other columns
pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import small, with_row_key, written

MIN_WORDS = 1
NEAR_WORDS = 5
#: Keys of a neighbourhood that are summed in one array.
STRETCH = 32


def _lines(docs: DataFrame) -> DataFrame:
    """_id, _h, line (its number), t (its text, with spaces for other white space)."""
    # one pass over a document, then splits at one character: cheaper than a split at \s+, and translate looks up each character
    spaced = F.regexp_replace("text", r"[\t\x0B\f\r]", " ")
    return docs.select("_id", "_h", F.posexplode(F.split(spaced, "\n", -1)).alias("line", "t"))


def _words() -> Column:
    return F.array_remove(F.split("t", " "), "")


def _halves(near_words: int) -> Column:
    """Keys of the halves that a partner as long as the line or longer, and one that is a word shorter, shares with it.
    A key holds the number of words of the shorter line, so that short lines meet only lines of nearly their length."""
    own, shorter = (f"xxhash64(0, {m}, slice(w, 1, int(({m}) / 2))), xxhash64(1, {m}, slice(w, -(({m}) - int(({m}) / 2)), {m}))" for m in ("size(w)", "size(w) - 1"))
    return F.expr(f"array_distinct(if(size(w) > {near_words}, array({own}, {shorter}), array({own})))")


def neighbourhood(w: str) -> str:
    """SQL for an array of keys: that of the words in w, then that of w without its word at each place."""
    own, moved = (f"transform({words}, (x, i) -> xxhash64(x, i))" for words in (w, f"slice({w}, 2, size({w}))"))
    whole, later = (f"aggregate({keys}, 0L, (a, x) -> a ^ x)" for keys in (own, moved))
    # from one place to the next, a word comes back at its own place, and the next one goes, which was a place earlier
    steps = f"concat(array({whole}, {whole} ^ {later}), zip_with(slice({own}, 1, size({w}) - 1), {moved}, (x, y) -> x ^ y))"
    # keys are running sums of steps: by stretches, since an array is copied for each value appended to it
    parts = f"transform(array({steps}), d -> transform(sequence(0, int((size(d) - 1) / {STRETCH})), k -> slice(d, {STRETCH} * k + 1, {STRETCH})))[0]"
    sums = f"aggregate(slice(c, 2, {STRETCH}), array(element_at(element_at(r, -1), -1) ^ c[0]), (s, x) -> concat(s, array(element_at(s, -1) ^ x)))"
    return f"slice(flatten(aggregate({parts}, array(array(0L)), (r, c) -> concat(r, array({sums})))), 2, size({w}) + 1)"


def line_keys(docs: DataFrame, min_words: int = MIN_WORDS, near_words: int = NEAR_WORDS) -> DataFrame:
    """_id, _h, line, k1, k2, halves (null for lines too short to have a partner) of the lines of min_words or more
    words, as a written table."""
    # a filter splits each line once more: not for lines of one word or more
    least = "trim(t) <> ''" if min_words == 1 else F.size(_words()) >= min_words
    lines = _lines(docs).where(least).select("_id", "_h", "line", _words().alias("w"))
    keys = lines.select("_id", "_h", "line", F.xxhash64("w").alias("k1"), F.xxhash64(F.lit(1), F.col("w")).alias("k2"), F.when(F.size("w") >= near_words, _halves(near_words)).alias("halves"))
    return written(keys, "linekeys")


def line_classes(docs: DataFrame, keys: DataFrame, near_words: int = NEAR_WORDS) -> DataFrame:
    """k1, k2, first (the earliest place of the class), partner (the earliest place of a class within one edit that
    stands earlier, or null) of the classes from which lines go: those of several lines, and those with a partner."""
    halves = keys.where("halves IS NOT NULL").select("k1", F.explode("halves").alias("half"))
    shared = halves.groupBy("half").agg(F.min("k1").alias("lo"), F.max("k1").alias("hi")).where("lo < hi").select("half")
    open_ = small(written(halves.join(small(written(shared, "halves")), "half", "left_semi").select("k1").distinct(), "openkeys"))
    classes = keys.groupBy("k1", "k2").agg(F.min(F.struct("_id", "_h", "line")).alias("first"), F.count("*").alias("n"))
    classes = classes.join(open_.withColumn("open", F.lit(True)), "k1", "left").where("n > 1 OR open")
    classes = written(classes, "classes")

    # the words of an open class, from the line that is its first
    firsts = small(written(classes.where("open").select("first._id", "first._h", "first.line"), "firsts"))
    texts = _lines(docs).join(firsts, ["_id", "_h", "line"], "left_semi").dropDuplicates(["_id", "_h", "line"])
    texts = texts.select(F.struct("_id", "_h", "line").alias("first"), F.xxhash64(_words()).alias("k1"), _words().alias("w")).where(f"size(w) >= {near_words}")
    texts = written(texts.withColumn("near", F.expr(neighbourhood("w"))), "openlines")

    # the neighbourhoods: only keys and numbers are shuffled; place 0 is the whole line, place p the line without word p
    shared = texts.select("k1", F.explode("near").alias("v")).groupBy("v").agg(F.min("k1").alias("lo"), F.max("k1").alias("hi")).where("lo < hi").select("v")
    shared = small(written(shared, "variants"))
    met = written(texts.select("first", F.posexplode("near").alias("place", "v")).join(shared, "v", "left_semi").select("first", "place", "v"), "met")
    cut, whole = met.where("place > 0"), met.where("place = 0").select("first", "v")
    lowest = F.min("first").alias("other")
    replaced = cut.join(small(written(cut.groupBy("v", "place").agg(lowest), "lowest")), ["v", "place"]).select("first", "other")
    inserted = cut.join(small(whole.withColumnRenamed("first", "other")), "v").select("first", "other")
    longer = small(whole).join(cut.groupBy("v").agg(lowest), "v").select("first", "other")
    pairs = small(written(replaced.union(inserted).union(longer).where("other < first").distinct(), "nearpairs"))
    theirs = texts.select(F.col("first").alias("other"), F.col("w").alias("w2"))
    true = texts.select("first", "w").join(pairs, "first").join(theirs, "other").where(within_one_edit("w", "w2"))
    partners = written(true.groupBy("first").agg(F.min("other").alias("partner")), "partners")
    return classes.join(partners, "first", "left").where("n > 1 OR partner IS NOT NULL").select("k1", "k2", "first", "partner")


def within_one_edit(a: str, b: str) -> str:
    """SQL for: the word arrays are equal but for one word replaced, inserted or deleted."""
    # the number of equal words from the front, then from the back
    front = f"coalesce(nullif(array_position(zip_with(slice({a}, 1, least(size({a}), size({b}))), slice({b}, 1, least(size({a}), size({b}))), (x, y) -> x = y), false), 0) - 1, least(size({a}), size({b})))"
    return f"""abs(size({a}) - size({b})) <= 1 AND CASE
        WHEN size({a}) = size({b}) THEN {front} = size({a}) OR slice({a}, int({front}) + 2, size({a})) = slice({b}, int({front}) + 2, size({b}))
        WHEN size({a}) > size({b}) THEN slice({a}, int({front}) + 2, size({a})) = slice({b}, int({front}) + 1, size({b}))
        ELSE slice({a}, int({front}) + 1, size({a})) = slice({b}, int({front}) + 2, size({b})) END"""


def dropped_lines(docs: DataFrame, min_words: int = MIN_WORDS, near_words: int = NEAR_WORDS) -> DataFrame:
    """_id, _h, dropped (sorted numbers of the lines to drop), n_near (how many of them have no equal line earlier)."""
    keys = line_keys(docs, min_words, near_words)
    classes = written(line_classes(docs, keys, near_words), "decisions")
    judged = keys.select("_id", "_h", "line", "k1", "k2").join(small(classes), ["k1", "k2"]).withColumn("again", F.expr("struct(_id, _h, line) > first"))
    out = judged.where("again OR partner IS NOT NULL")
    return out.groupBy("_id", "_h").agg(F.sort_array(F.collect_set("line")).alias("dropped"), F.size(F.collect_set(F.expr("CASE WHEN NOT again THEN line END"))).cast("long").alias("n_near"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, near_words: int = NEAR_WORDS) -> DataFrame:
    """docs with their kept lines as text, and n_lines, n_dropped, n_near (each long)."""
    keyed = with_row_key(docs)
    drops = written(dropped_lines(keyed.select("_id", "_h", "text"), min_words, near_words), "droppedlines")
    joined = keyed.join(drops, ["_id", "_h"], "left")
    kept = F.expr("CASE WHEN dropped IS NULL THEN text ELSE array_join(filter(split(text, '\n', -1), (t, i) -> NOT array_contains(dropped, i)), '\n') END")
    n_lines = F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).cast("long")
    counts = {"n_lines": F.when(F.col("text").isNull(), F.lit(0).cast("long")).otherwise(n_lines), "n_dropped": F.coalesce(F.size("dropped"), F.lit(0)).cast("long"), "n_near": F.coalesce("n_near", F.lit(0).cast("long"))}
    columns = [kept.alias("text") if c == "text" else F.col(c) for c in docs.columns if c not in counts]
    return joined.select(*columns, *[c.alias(n) for n, c in counts.items()])
