"""Documents that are equal, as a join.

Deep equality takes members in any order, repeated names by their first, and numbers
that are a machine epsilon apart for equal, so it isn't an equality of texts that Spark
could join by. Most documents are plain: no name twice, no escapes, no number of over
twelve digits. Printed with names in order, two of them are equal just if these texts
are, and a text's hash is a document's key. Any other document is made a plain one for
its key, by the first member of each name and the first twelve digits of numbers. A
number that an epsilon may carry over to other digits counts in two ways, and its
document has a key for each. So equal documents share a key, and what shares one is
compared in full, unless both are plain.
"""

from __future__ import annotations

import itertools
import json
import math
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns, jsontext, values

#: Numbers of a document that may count in two ways.
MOST_DOUBTFUL = 12

KEYED = "struct<plain:boolean,texts:array<string>>"

#: What may be a number of over twelve digits or with an exponent, a zero that is printed in another way, and a name with capitals.
_long = re.compile(r"[0-9.](?:[0-9.]{12}|[eE][+-]?[0-9])")
_minus_zero = re.compile(r"-0\.0(?![0-9])")
_capitals = re.compile(r'[A-Z][^"A-Z]*"[\x00-\x20]*:')
_decoder = json.JSONDecoder(parse_int=float, parse_constant=jsontext._no_constant, strict=False)
_printed = json.JSONEncoder(ensure_ascii=False, check_circular=False, sort_keys=True, separators=(",", ":")).encode


def _plain(text: str, case_sensitive: bool) -> str | None:
    """A plain document as it is printed; None for any other text."""
    if "\\" in text or "\0" in text or _long.search(text) or (not case_sensitive and _capitals.search(text)):
        return None
    at = jsontext._space.match(text).end()
    if text[at : at + 1] not in ("{", "["):
        return None
    if text.count("[") + text.count("{") > jsontext.NESTING_LIMIT and jsontext._too_deep(text, at):
        return None
    try:
        value, end = _decoder.raw_decode(text, at)
    except ValueError:
        return None
    out = _printed(value)
    # A name that came again would have been dropped with its quotes.
    return out if out.count('"') == text.count('"', at, end) and not ("-0.0" in out and _minus_zero.search(out)) else None


def _ways(number: float) -> list[float]:
    """A number by its first twelve digits, in the two ways in which it may count."""
    near = 2.0**-50  # beyond what comparing may differ by
    return sorted({float(f"{number * (1 + s):.11e}") + 0.0 for s in (-near, near)})


def _beyond(value) -> bool:
    """Whether there is a number beyond the range of doubles."""
    if isinstance(value, jsontext.Members):
        return any(_beyond(x) for _, x in value)
    return any(map(_beyond, value)) if isinstance(value, list) else isinstance(value, float) and math.isinf(value)


def _as_plain(value, case_sensitive: bool) -> list[str]:
    """The plain documents that stand for ``value`` in keys, as they are printed; none
    if it has a number beyond the range of doubles."""
    fold = (lambda k: k) if case_sensitive else values._ascii_fold
    doubtful: list[list[float]] = []

    def first(v):
        if isinstance(v, jsontext.Members):
            return {k: first(x) for k, x in {fold(k): x for k, x in reversed(v)}.items()}
        if isinstance(v, list):
            return [first(x) for x in v]
        if isinstance(v, float):
            if len(ways := _ways(v)) > 1:
                doubtful.append(ways)
                return ways
            return ways[0]
        return v

    def chosen(v):
        if isinstance(v, dict):
            return {k: chosen(x) for k, x in v.items()}
        if isinstance(v, list):
            return choice[id(v)] if id(v) in choice else [chosen(x) for x in v]
        return v

    if _beyond(value):
        return []
    value = first(value)
    if not doubtful:
        return [_printed(value)]
    if len(doubtful) > MOST_DOUBTFUL:
        raise ValueError(f"a document has over {MOST_DOUBTFUL} numbers that may count in two ways")
    texts = []
    for picked in itertools.product(*doubtful):
        choice = {id(ways): x for ways, x in zip(doubtful, picked, strict=True)}
        texts.append(_printed(chosen(value)))
    return texts


def _keyed(col: Column, case_sensitive: bool) -> Column:
    """Whether a document is plain, and the texts that are hashed for its keys."""

    def others(text: str) -> list[str]:
        try:
            return _as_plain(jsontext.parse(text, placed=False), case_sensitive)
        except jsontext.Invalid:
            return []

    def run(texts: pa.Array) -> pa.Array:
        texts = texts.to_pylist()
        plain = [None if t is None else _plain(t, case_sensitive) for t in texts]
        keyed = [[p] if p is not None else [] if t is None else others(t) for t, p in zip(texts, plain, strict=True)]
        return pa.StructArray.from_arrays([pa.array([p is not None for p in plain], pa.bool_()), pa.array(keyed, pa.list_(pa.string()))], ["plain", "texts"])

    return F.arrow_udf(run, KEYED)(col)


def keys(df: DataFrame, json_col: str, ids: list[str], case_sensitive: bool = True) -> DataFrame:
    """``(ids..., key, plain, json)``: the keys of each document, by far most have one;
    a plain one is printed with its names in order. A text that isn't JSON, and a null,
    have none; nor has a document with a number beyond the range of doubles, which
    would be an epsilon apart from every number."""
    rows = df.select(*[df[c] for c in ids], df[json_col].alias("json")).withColumn("_keyed", _keyed(F.col("json"), case_sensitive))
    # The outer form: the plain one would work the texts out again for a filter of its own.
    rows = rows.select(*ids, F.col("_keyed.plain").alias("plain"), "json", F.explode_outer("_keyed.texts").alias("_text")).where("_text is not null")
    return rows.select(*ids, F.xxhash64("_text").alias("key"), "plain", F.when(F.col("plain"), F.col("_text")).otherwise(F.col("json")).alias("json"))


def equal_documents(a: DataFrame, b: DataFrame, json_col: str, a_id: str, b_id: str, case_sensitive: bool = True) -> DataFrame:
    """``(a, b)``: the ids of documents of ``a`` and of ``b`` that are equal."""
    left = keys(a, json_col, [a_id], case_sensitive).select(F.col(a_id).alias("a"), "key", F.col("plain").alias("plain_x"), F.col("json").alias("x"))
    right = keys(b, json_col, [b_id], case_sensitive).select(F.col(b_id).alias("b"), "key", F.col("plain").alias("plain_y"), F.col("json").alias("y"))
    plain = F.col("plain_x") & F.col("plain_y")
    in_full = columns.compare(F.when(~plain, F.col("x")), F.when(~plain, F.col("y")), case_sensitive)
    pairs = left.join(right, "key").where(~plain | (F.col("x") == F.col("y")))
    return pairs.where(plain | in_full).select("a", "b").distinct()
