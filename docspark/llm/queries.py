"""The queries opN_<name>: each operator applied with production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm.byte_bpe import encoded
from docspark.llm.decontam import contamination
from docspark.llm.html_text import extract_text
from docspark.llm.line_dedup import dedup_lines
from docspark.llm.near_dup import near_duplicates
from docspark.llm.quality import classify
from docspark.llm.secret_scan import scan
from docspark.llm.syncmers import edited_likeness
from docspark.llm.token_files import id_digests, write_ids
from docspark.llm.url_filter import ALL_EVENTS_SQL
from docspark.llm.url_filter import ORACLE_SQL as URL_SQL
from docspark.llm.url_filter import decide, listed_by_all_events, listed_by_events

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(_table(spark, sf_dir, "pages"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return encoded(docs, _tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, digests=True)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated", "n_near")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(_table(spark, sf_dir, "documents"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return id_digests(write_ids(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json")))


def op6_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_likeness(_table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide(*listed_by_events(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "events")))


def op7_url_filter_all_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide(*listed_by_all_events(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "events")))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", "n_near", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).drop("_k")


def op10_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), size=2, percent=80).drop("_h")


QUERIES: dict[str, Query] = {
    "op1_html_text": op1_html_text,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_decontamination": op3_decontamination,
    "op4_secret_scan": op4_secret_scan,
    "op5_token_files": op5_token_files,
    "op6_syncmers": op6_syncmers,
    "op7_url_filter": op7_url_filter,
    "op7_url_filter_all_events": op7_url_filter_all_events,
    "op8_line_dedup": op8_line_dedup,
    "op9_quality": op9_quality,
    "op10_minhash_near_dup": op10_minhash_near_dup,
}

ORACLE_SQL: dict[str, str] = {"op7_url_filter": URL_SQL, "op7_url_filter_all_events": ALL_EVENTS_SQL}
