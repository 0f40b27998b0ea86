"""What a compiled expression can see: the columns of a DataFrame, their types, and variables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.errors import BadValue

#: Names that begin so are the compiler's own: never shown, never part of $$ROOT.
HIDDEN = "__"


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


@dataclass
class Scope:
    df: DataFrame
    variables: dict[str, Column] = field(default_factory=dict)
    #: prefix of column references, where two sides of a join share names
    alias: str = ""

    def column(self, name: str) -> Column:
        return F.col(f"{self.alias}.{quoted(name)}" if self.alias else quoted(name))

    def names(self) -> list[str]:
        return [c for c in self.df.columns if not c.startswith(HIDDEN)]

    def root(self) -> Column:
        return F.struct(*[self.column(c).alias(c) for c in self.names()])

    def dtype(self, column: Column) -> T.DataType:
        frame = self.df.alias(self.alias) if self.alias else self.df
        return frame.select(column.alias("x")).schema["x"].dataType

    def at(self, path: str) -> tuple[Column, T.DataType] | None:
        """A path through documents; None where the schema has no such field (an array on the way has none)."""
        first, *rest = split_path(path)
        if first not in self.df.columns:
            return None
        return descend(self.column(first), self.df.schema[first].dataType, rest)


def split_path(path: str) -> list[str]:
    parts = path.split(".")
    if not path or not all(parts):
        raise BadValue(f"bad path: {path!r}")
    return parts


def descend(column: Column, kind: T.DataType, parts: list[str]) -> tuple[Column, T.DataType] | None:
    for part in parts:
        if not isinstance(kind, T.StructType) or part not in kind.names:
            return None
        column, kind = column.getField(part), kind[part].dataType
    return column, kind


def with_path(column: Column | None, kind: T.DataType | None, parts: list[str], value: Column) -> Column:
    """The struct with a value set at a path; documents on the way are made, and replace what is no document."""
    if not parts:
        return value
    name, *rest = parts
    if not isinstance(kind, T.StructType):
        return F.struct(with_path(None, None, rest, value).alias(name))
    inner = with_path(column.getField(name), kind[name].dataType, rest, value) if name in kind.names else with_path(None, None, rest, value)
    fields = [column.getField(f).alias(f) for f in kind.names if f != name]
    at = kind.names.index(name) if name in kind.names else len(fields)
    fields.insert(at, inner.alias(name))
    return F.struct(*fields)


def without_path(column: Column, kind: T.DataType, parts: list[str]) -> Column | None:
    """The struct without a path; None if nothing is left; the column itself if the path isn't there."""
    name, *rest = parts
    if not isinstance(kind, T.StructType) or name not in kind.names:
        return column
    fields = []
    for f in kind.names:
        kept = column.getField(f) if f != name else (without_path(column.getField(f), kind[f].dataType, rest) if rest else None)
        if kept is not None:
            fields.append(kept.alias(f))
    return F.when(column.isNotNull(), F.struct(*fields)) if fields else None


_RANKS = [((T.NumericType,), 2), ((T.StringType,), 3), ((T.StructType,), 4), ((T.ArrayType,), 5), ((T.BinaryType,), 6), ((T.BooleanType,), 8), ((T.TimestampType, T.TimestampNTZType, T.DateType), 9)]


def type_rank(kind: T.DataType) -> int:
    """Place of a type in the order of all values; null is 1."""
    return next((r for kinds, r in _RANKS if isinstance(kind, kinds)), 1)


def type_name(kind: T.DataType) -> str:
    names = [((T.ByteType, T.ShortType, T.IntegerType), "int"), ((T.LongType,), "long"), ((T.FloatType, T.DoubleType), "double"), ((T.DecimalType,), "decimal"), ((T.StringType,), "string"), ((T.StructType,), "object"), ((T.ArrayType,), "array"), ((T.BooleanType,), "bool"), ((T.TimestampType, T.TimestampNTZType, T.DateType), "date"), ((T.BinaryType,), "binData")]
    return next((n for kinds, n in names if isinstance(kind, kinds)), "null")
