"""Readers of documents through VARIANT, without Python.

A text becomes a VARIANT once, and readers are expressions over it. VARIANT has one
member of a name, in no order, so a document of which that can't be said, because it
repeats a name or a name's case differs, is told apart: the readers give null for it,
and ``unsure`` is true. ``columns.extract`` reads such documents.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _fold(name: Column) -> Column:
    return F.translate(name, _UPPER, _LOWER)


def _named(key: str, case_sensitive: bool):
    if case_sensitive:
        return lambda e: e["key"] == key
    return lambda e: _fold(e["key"]) == key.translate(str.maketrans(_UPPER, _LOWER))


def at(doc: Column, keys: tuple, case_sensitive: bool = False) -> tuple[Column, Column]:
    """The value at ``keys``, and whether its names stand for one member each."""
    sure = F.lit(True)
    for key in keys:
        if isinstance(key, int):
            doc = F.get(F.try_variant_get(doc, "$", "array<variant>"), F.lit(key))
            continue
        entries = F.map_entries(F.try_variant_get(doc, "$", "map<string,variant>"))
        found = F.filter(entries, _named(key, case_sensitive))
        doc, sure = F.get(found, F.lit(0))["value"], sure & (F.coalesce(F.size(found), F.lit(0)) <= 1)
    return doc, sure


def kind(doc: Column) -> Column:
    """null, boolean, integer, number, string, array or object; null where nothing is."""
    name = F.regexp_extract(F.schema_of_variant(doc), "^[A-Z]+", 0)
    number = F.try_variant_get(doc, "$", "double")
    whole = number.between(-2147483648, 2147483647) & (number == F.floor(number))
    return (
        F.when(name == "OBJECT", "object").when(name == "ARRAY", "array").when(name == "STRING", "string").when(name == "BOOLEAN", "boolean").when(name == "VOID", "null")
        .when(doc.isNotNull(), F.when(whole, "integer").otherwise("number"))
    )


def _is(doc: Column, *names: str) -> Column:
    return F.regexp_extract(F.schema_of_variant(doc), "^[A-Z]+", 0).isin(*names)


def has_at(*keys, case_sensitive: bool = False):
    return lambda doc: (lambda v, sure: (v.isNotNull(), sure))(*at(doc, keys, case_sensitive))


def size_at(*keys, case_sensitive: bool = False):
    """Items or members of a container; 0 for a scalar."""

    def read(doc: Column):
        v, sure = at(doc, keys, case_sensitive)
        n = F.coalesce(F.size(F.try_variant_get(v, "$", "array<variant>")), F.size(F.try_variant_get(v, "$", "map<string,variant>")), F.lit(0))
        return F.when(v.isNotNull(), n.cast("long")), sure

    return read


def kind_at(*keys, case_sensitive: bool = False):
    return lambda doc: (lambda v, sure: (kind(v), sure))(*at(doc, keys, case_sensitive))


def string_at(*keys, case_sensitive: bool = False):
    return lambda doc: (lambda v, sure: (F.when(_is(v, "STRING"), F.try_variant_get(v, "$", "string")), sure))(*at(doc, keys, case_sensitive))


def number_at(*keys, case_sensitive: bool = False):
    """A number; NaN for another value, null where there is none."""

    def read(doc: Column):
        v, sure = at(doc, keys, case_sensitive)
        number = F.when(_is(v, "BIGINT", "DECIMAL", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT"), F.try_variant_get(v, "$", "double"))
        return F.when(v.isNotNull(), F.coalesce(number, F.lit(float("nan")))), sure

    return read


def extract(json: Column, **readers) -> Column:
    """A struct of what ``readers`` find, and ``unsure``: true for a text that isn't
    a document VARIANT can hold, or whose names are ambiguous."""
    doc = F.try_parse_json(json)
    found = {name: read(doc) for name, read in readers.items()}
    sure = doc.isNotNull()
    for _, one in found.values():
        sure = sure & one
    unsure = F.when(json.isNotNull(), ~sure)
    return F.struct(*[F.when(sure, value).alias(name) for name, (value, _) in found.items()], unsure.alias("unsure"))
