"""Canonical JSON of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.functions.scope import quoted


def sorted_keys(column: Column, kind: T.DataType) -> Column:
    """The value with the fields of its documents in the order of their names."""
    if isinstance(kind, T.StructType):
        fields = [sorted_keys(column.getField(f), kind[f].dataType).alias(f) for f in sorted(kind.names)]
        return F.when(column.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: sorted_keys(x, kind.elementType))
    return column


def canonical(df: DataFrame, columns: list[str] | None = None) -> Column:
    names = sorted(columns or df.columns)
    parts = [sorted_keys(F.col(quoted(c)), df.schema[c].dataType).alias(c) for c in names]
    return F.to_json(F.struct(*parts), {"ignoreNullFields": "false"})
