"""Keeping, leaving out and emptying fields of nested records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def keep_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The top-level fields named, in the record's order; unknown names are none."""
    return df.select(*(c for c in df.columns if c in set(keys)))


def skip_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All top-level fields but those named."""
    return df.select(*(c for c in df.columns if c not in set(keys)))


def _inner(value: Column, kind: T.DataType) -> Column:
    """A value with the empty fields of all that it holds made null; itself perhaps empty. A list keeps its length."""
    if isinstance(kind, T.StructType):
        fields = [without_empty(value[f.name], f.dataType).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*fields)) if fields else value
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StructType, T.ArrayType, T.MapType)):
        return F.transform(value, lambda x: _inner(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.map_filter(F.transform_values(value, lambda _, v: without_empty(v, kind.valueType)), lambda _, v: v.isNotNull())
    return value


def _is_empty(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType):
        out = F.lit(True)
        for f in kind.fields:
            out = out & value[f.name].isNull()
        return out
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return F.size(value) == 0
    if isinstance(kind, T.StringType):
        return value == ""
    return F.lit(False)


def without_empty(value: Column, kind: T.DataType) -> Column:
    """A value whose empty parts are null, at all depths: blank strings, lists and maps without element, records without any field left.

    Numbers and flags stay, 0 and false too. Elements of a list stay even when nothing
    is left of them, so that positions (of a birth in the list of events) keep their meaning.
    The expression is made by recursion over the schema and needs no data.
    """
    inner = _inner(value, kind)
    return F.when(~F.coalesce(_is_empty(inner, kind), F.lit(True)), inner)


def strip_empty(df: DataFrame) -> DataFrame:
    """Every field of every record by :func:`without_empty`; written as JSON, the null fields are not there at all."""
    return df.select(*(without_empty(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields))


def as_json(df: DataFrame, handle: str = "handle") -> DataFrame:
    """(handle, json): each record as one JSON object without its empty fields."""
    return strip_empty(df).select(F.col(handle).alias("handle"), F.to_json(F.struct(*(F.col(c) for c in df.columns))).alias("json"))
