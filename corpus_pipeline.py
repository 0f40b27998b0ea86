"""The corpus pipeline: quality classifier, line dedup, MinHash near-dedup, benchmark decontamination, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last return the
columns of documents, with n_chars as the length of the text that is left. Rows are judged by (doc_id, text), so
rows with a null or repeated doc_id are judged by their texts. Texts go to Python in small batches (all stages share the
executors, and each batch's buffers come on top of their heaps).
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm.byte_bpe import encoded
from docspark.llm.common import new_folder, small, small_batches, with_row_key, written
from docspark.llm.decontam import keyed_contamination
from docspark.llm.line_dedup import dedup_lines
from docspark.llm.near_dup import near_copies
from docspark.llm.quality import keep_good

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: What a worker remembers of the words that it has encoded: less than op2's, since the other stages' memory stays with the executors.
BPE_KEPT = 60_000
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    with small_batches(spark):
        return keep_good(docs.select(COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, and documents of which nothing is left."""
    out = dedup_lines(docs.select(COLUMNS))
    kept = out.where("n_dropped = 0 OR trim(BOTH FROM replace(text, '\n', ' ')) <> ''")
    return kept.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.lit(0).cast("long"))).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest doc_id (null ids last), then hash; two-word shingles and similarity 0.8, as op10."""
    keyed = with_row_key(docs.select(COLUMNS))
    with small_batches(spark):
        gone = written(near_copies(docs, size=2, percent=80), "gone")
    keyed = keyed.join(small(gone), ["_id", "_h"], "left_anti")
    # rows equal in id and text are one group, too
    repeated = written(keyed.groupBy("_id", "_h").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "repeated")
    if repeated.take(1):
        once = keyed.join(small(repeated), ["_id", "_h"], "left_semi").dropDuplicates(["_id", "_h"])
        keyed = keyed.join(small(repeated), ["_id", "_h"], "left_anti").unionByName(once)
    return keyed.select(COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go."""
    keyed = with_row_key(docs.select(COLUMNS))
    marks = keyed_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = small(written(marks.where("contaminated").select("_id", "_h").distinct(), "contaminated"))
    return keyed.join(hit, ["_id", "_h"], "left_anti").select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_chars, n_tokens, ids_sha256, decoded_sha256 of each document."""
    with small_batches(spark):
        return written(encoded(docs.select(COLUMNS), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, digests=True, kept=BPE_KEPT), "encoded")


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("minhash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("byte-level bpe", encode),
]

#: SQL can't express the classifier, the signatures and the merges: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = new_folder(spark, f"stage{k}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
