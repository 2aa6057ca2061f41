"""Removal and replacement on nested columns, as expressions made from their types.

What the operators of JSON text do to documents, these do to structs, arrays and maps:
a function of the type gives one Spark expression, so nothing is parsed and no Python
runs. In a typed row a member that isn't there is a null, so a removed member becomes
one; items of arrays and entries of maps are really removed. A container that becomes
empty stays. Names are replaced once, in the schema.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import regex

Change = Callable[[Column], Column]


def _rebuilt(col: Column, kind: T.DataType, keep: Callable[[T.DataType], Change | None], text: Change | None, name: Callable[[str], str]) -> Column:
    """``col`` with ``text`` applied to members that are strings, and without the items
    and entries for which ``keep`` of their type is false."""

    def inside(values, over: Callable[[Column, Change], Column], of: T.DataType) -> Column:
        wanted = keep(of)
        held = values(wanted) if wanted else col
        # What ``keep`` has settled needs no change of its own.
        return over(held, lambda x: _rebuilt(x, of, keep, None if wanted and isinstance(of, T.StringType) else text, name))

    if isinstance(kind, T.StructType):
        return F.when(col.isNotNull(), F.struct(*[_rebuilt(col.getField(f.name), f.dataType, keep, text, name).alias(name(f.name)) for f in kind]))
    if isinstance(kind, T.ArrayType):
        return inside(lambda wanted: F.filter(col, wanted), F.transform, kind.elementType)
    if isinstance(kind, T.MapType):
        return inside(lambda wanted: F.map_filter(col, lambda _, v: wanted(v)), lambda held, f: F.transform_values(held, lambda _, v: f(v)), kind.valueType)
    return text(col) if text and isinstance(kind, T.StringType) else col


def _on(df: DataFrame, columns: list[str] | None, keep=lambda kind: None, text: Change | None = None, name: Callable[[str], str] = lambda n: n) -> DataFrame:
    chosen = df.columns if columns is None else columns
    return df.select(*[_rebuilt(df[f"`{f.name}`"], f.dataType, keep, text, name).alias(name(f.name)) if f.name in chosen else df[f"`{f.name}`"] for f in df.schema])


def remove_nulls(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Without null items of arrays and null entries of maps, at any depth, in
    ``columns`` or in all. Null members of structs are absent members already."""
    return _on(df, columns, lambda kind: lambda x: x.isNotNull())


def remove_empty_strings(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Empty strings become absent members; as items and entries they are removed.
    Nulls stay."""
    full = lambda x: x.isNull() | (x != "")
    return _on(df, columns, lambda kind: full if isinstance(kind, T.StringType) else None, lambda x: F.nullif(x, F.lit("")))


def replace_values(df: DataFrame, pattern: str, replacement: str, columns: list[str] | None = None) -> DataFrame:
    """Strings in which the POSIX pattern is found become ``replacement``."""
    found = regex.java(pattern)
    return _on(df, columns, text=lambda x: F.when(x.rlike(found), replacement).otherwise(x))


def replace_keys(df: DataFrame, pattern: str, replacement: str, columns: list[str] | None = None) -> DataFrame:
    """Names of columns and members in which the POSIX pattern is found become
    ``replacement``; keys of maps are data and stay."""
    found = regex.compiled(pattern)
    return _on(df, columns, name=lambda n: replacement if found.search(n) else n)
