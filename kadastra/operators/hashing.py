"""Hashes of whole rows, whatever their columns hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _maps(kind: T.DataType) -> bool:
    """Whether a type has a map or a variant in it: Spark hashes neither."""
    if isinstance(kind, T.StructType):
        return any(_maps(f.dataType) for f in kind.fields)
    return _maps(kind.elementType) if isinstance(kind, T.ArrayType) else isinstance(kind, (T.MapType, T.VariantType))


def hashable(df: DataFrame, name: str) -> Column:
    """A column as a value that can be hashed: a map as its entries by key, so that their order does not count; what holds maps
    or variants deeper down as JSON."""
    column, kind = F.col(f"`{name}`"), df.schema[name].dataType
    if isinstance(kind, T.MapType) and not _maps(kind.keyType) and not _maps(kind.valueType):
        return F.array_sort(F.map_entries(column))
    return F.to_json(column) if _maps(kind) else column


def row_hash(df: DataFrame, salt: str = "") -> Column:
    """64 bits of all columns of a row, nulls told from empty values."""
    parts = [x for c in df.columns for x in (hashable(df, c), F.col(f"`{c}`").isNull())]
    return F.xxhash64(F.lit(salt), *parts)
