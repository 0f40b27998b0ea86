"""What the corpus operators share: the shared folder, written tables, size-checked broadcasts, row keys."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.sources.tables import shared_dir, written

__all__ = ["new_folder", "shared_dir", "small", "small_batches", "uncollected", "with_row_key", "written"]
#: Size on disk up to which a written table is broadcast (a few times that in memory); beyond it, joins shuffle.
BROADCAST_BYTES = 12 * 2**20
#: Of an Arrow batch within small_batches.
BATCH_BYTES = 4 * 2**20


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/docspark-{name}-{uuid.uuid4().hex[:12]}"


def small(df: DataFrame) -> DataFrame:
    """A written table (or columns of one), marked for broadcast only if its files are small by the plan's statistics,
    which know them without a job; else Spark picks a shuffle join."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= BROADCAST_BYTES else df.hint("shuffle_merge")


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Rows go to Python in batches of BATCH_BYTES while it lasts (Spark: 64 MB). An executor's buffers for them lie outside
    its heap and stay with it, and so does what its workers took for them. The limit counts when a plan runs, so tables
    are to be written within."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.set(key, was)


@contextmanager
def uncollected() -> Iterator[None]:
    """Pauses the cycle collector while a great many plain lists and strings are made, which it would walk again and again."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def with_row_key(df: DataFrame) -> DataFrame:
    """Adds _id and _h, a null-free key of (doc_id, text); rows equal in both share it and all their results."""
    return df.withColumns({"_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), "_h": F.xxhash64("text")})
