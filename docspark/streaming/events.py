"""Structured Streaming forms of the time-based operators: expiry and tumbling groups over a stream of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.errors import BadValue
from docspark.functions.filters import matches
from docspark.functions.scope import Scope


def matching(stream: DataFrame, filter_: dict) -> DataFrame:
    """The documents of a stream that match a filter."""
    return stream.filter(matches(filter_, Scope(stream)))


def tumbling(stream: DataFrame, time: str, width: str, keys: list[str], aggregates: list[Column], lateness: str) -> DataFrame:
    """Groups by key and window of event time; state older than the lateness is dropped, so it stays bounded."""
    if not aggregates:
        raise BadValue("no aggregates")
    grouped = stream.withWatermark(time, lateness).groupBy(F.window(time, width).alias("window"), *keys)
    return grouped.agg(*aggregates).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, *[F.col(c) for c in _names(stream, aggregates)])


def _names(stream: DataFrame, aggregates: list[Column]) -> list[str]:
    return stream.sparkSession.createDataFrame([], stream.schema).agg(*aggregates).columns
