"""Rows of leaves from JSON text without Python, level by level.

Strings and numbers of a text are marked first, all in one pass: both become strings,
a string between two marks, a number after them, so its digits stay as they are written
and no string looks like a number or a container. Spark's parser then reads one level at a time, objects as maps and
arrays as lists of texts; each row that holds a container becomes a row for each of
its members. ``place``, the positions on the way to a leaf, keeps document order, so
nothing is numbered and nothing is shuffled.

This holds for plain documents: objects and arrays of up to ``depth`` levels, numbers
of up to 15 digits without exponents, no ``\\u`` escapes and no control characters.
``is_plain`` tells them apart. Others go through the exact functions, or are an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns
from ..functions.values import PATH_BYTES

#: Private characters that mark the start and the end of a string; a number has both before it.
START, END = "\ue000", "\ue001"
DEPTH = 6
_TOKEN = r'"((?:[^"\\]++|\\.)*+)"|(-?[0-9][0-9.eE+\-]*+)'
#: A number whose digits print as they stand, but for noughts at its end.
_NUMBER = r'-?+(?=[0-9.]{1,16}")(?:0|[1-9][0-9]{0,14})(?:\.(?!0{4})[0-9]{1,14})?+'
_ODD_NUMBER = f'{START}{END}(?!"|{_NUMBER}")'
_NUMBER_AS_NAME = f'{START}{END}[^"]++"[ \\t\\r\\n]*+:'
_ODD = rf"[\x00-\x08\x0B\x0C\x0E-\x1F{START}{END}\ufeff]|\\u"
_OPTIONS = {"allowSingleQuotes": "false"}


def marked(json: Column) -> Column:
    """The text with a string as ``"S...E"`` and a number as ``"SE..."``, S and E being the marks."""
    return F.regexp_replace(json, _TOKEN, f'"{START}$1{END}$2"')


def _skeleton(text: Column, depth: int) -> Column:
    """What is left of a marked text's brackets after pairs are removed ``depth`` times."""
    out = F.regexp_replace(text, r'"(?:[^"\\]++|\\.)*+"|[^\[\]{}"]++', "")
    for _ in range(depth):
        out = F.regexp_replace(out, r"\[\]|\{\}", "")
    return out


def _plain(json: Column, text: Column) -> Column:
    """Whether a text, but for its depth, is a plain document, ``text`` being the marked one."""
    return json.rlike(r"^[ \t\r\n]*+[\[{]") & ~json.rlike(_ODD) & ~text.rlike(f"{_ODD_NUMBER}|{_NUMBER_AS_NAME}")


def is_plain(json: Column, depth: int = DEPTH) -> Column:
    """Whether a text is a plain document, as far as can be told without parsing."""
    return F.coalesce(_plain(json, marked(json)) & (_skeleton(marked(json), depth) == ""), F.lit(False))


def _cut(path: Column, most: int | None) -> Column:
    if most is None:
        return path
    whole = F.substring(path.cast("binary"), 1, most).cast("string")
    return F.when(F.octet_length(path) <= most, path).otherwise(F.regexp_replace(F.make_valid_utf8(whole), "\ufffd+$", ""))


def _opened(rows: DataFrame, others: list[str], level: int, keep_empty: bool, most: int | None) -> DataFrame:
    """Rows of containers as rows of their members; other rows as they are."""
    first = F.substring("_raw", 1, 1)
    is_object = (first == "{") & (F.col("_raw") != "{}") if keep_empty else first == "{"
    nothing = F.lit(None).cast("string")
    members = (
        F.when(is_object, F.map_entries(F.from_json("_raw", "map<string,string>", _OPTIONS)))
        .when(first == "[", F.transform(F.from_json("_raw", "array<string>", _OPTIONS), lambda v: F.struct(nothing.alias("key"), v.alias("value"))))
        .otherwise(F.array(F.struct(nothing.alias("key"), F.col("_raw").alias("value"))))
    )
    rows = rows.select(*others, "_path", (first == "[").alias("_list"), F.posexplode_outer(members).alias(f"_{level}", "_m")).where(F.col(f"_{level}").isNotNull())  # the plain generator would parse again for a filter of its own
    name = F.substring("_m.key", F.lit(2), F.length("_m.key") - 2)
    path = F.when(F.col("_list"), F.concat("_path", F.lit("["), F.col(f"_{level}").cast("string"), F.lit("]"))).when(F.col("_m.key").isNull(), F.col("_path"))
    path = path.otherwise(F.when(F.col("_path") == "", name).otherwise(F.concat("_path", F.lit("."), name)))
    rows = rows.select(*others, f"_{level}", path.alias("_long"), F.col("_m.value").alias("_raw"))
    return rows.select(*others, f"_{level}", _cut(F.col("_long"), most).alias("_path"), "_raw")


def _number(raw: Column) -> Column:
    """A number as it prints; null for other leaves."""
    digits = F.substring(raw, 3, 40)
    short = F.when(digits.contains("."), F.regexp_replace(digits, r"\.?0+$", "")).otherwise(digits)
    return F.when(raw.startswith(START + END) & (raw != START + END), F.when(short == "-0", "0").otherwise(short))


def _typed(raw: Column, number: Column) -> list[Column]:
    """``type`` and ``value`` of a leaf."""
    text = raw.endswith(END)
    whole = F.when(~number.contains("."), number.try_cast("bigint")).between(-(1 << 31), (1 << 31) - 1)
    kind = F.when(raw.isNull(), "null").when(number.isNotNull(), F.when(whole, "integer").otherwise("number")).when(text, "string").when(raw == "{}", "object").otherwise("boolean")
    value = F.when(number.isNotNull(), number).when(text, F.substring(raw, F.lit(2), F.length(raw) - 2)).when(raw != "{}", raw)
    return [kind.alias("type"), value.alias("value")]


def leaf_rows(df: DataFrame, json_col: str, ids: list[str], others: str = "exact", depth: int = DEPTH, empty_objects: bool = False, on_error: str = "fail", max_path_bytes: int | None = PATH_BYTES) -> DataFrame:
    """``(ids..., place, path, type, value)``: the rows of ``rows.flatten_rows``, with
    ``place`` to order a document's by.

    Documents that aren't plain go through the exact function in the same pass, and
    have one number as their place; with ``others="fail"`` they are an error, and the
    plan has no Python at all."""
    if others not in ("exact", "fail"):
        raise ValueError("others is 'exact' or 'fail'")
    keys = [f"_id{i}" for i in range(len(ids))]
    rows = df.where(df[json_col].isNotNull()).select(*[df[c].alias(k) for c, k in zip(ids, keys, strict=True)], df[json_col].alias("_json"), marked(df[json_col]).alias("_raw"))
    start = [F.lit("").alias("_path"), F.regexp_replace("_raw", r"^[ \t\r\n]++", "").alias("_raw")]
    error = F.raise_error(F.concat(F.lit("not a plain document: "), F.substring("_json", 1, 100)))
    plain = _plain(F.col("_json"), F.col("_raw"))
    named = [F.col(k).alias(c) for c, k in zip(ids, keys, strict=True)]
    if others == "fail":
        # The root is opened here too, for a text that the parser refuses.
        whole = F.from_json("_raw", "map<string,string>", _OPTIONS).isNotNull() | F.from_json("_raw", "array<string>", _OPTIONS).isNotNull()
        rows = rows.withColumn("_raw", F.when(plain & whole, F.col("_raw")).otherwise(error)).select(*keys, *start)
        carried = []
    else:
        parses = F.when(F.trim("_raw").startswith("["), F.from_json("_raw", "array<string>", _OPTIONS).isNotNull()).otherwise(F.from_json("_raw", "map<string,string>", _OPTIONS).isNotNull())
        plain = F.coalesce(plain & (_skeleton(F.col("_raw"), depth) == "") & parses, F.lit(False))
        rows = rows.withColumn("_plain", plain)
        exact = columns.leaf_rows(F.when(~F.col("_plain"), F.col("_json")), empty_objects, on_error, max_path_bytes)
        # What the exact function finds waits in a row of its own kind, to be given out at the end.
        rows = rows.select(*keys, F.when(F.col("_plain"), F.lit(None)).otherwise(exact).alias("_exact"), start[0], F.when(F.col("_plain"), start[1]).alias("_raw"), "_plain")
        carried = ["_exact", "_plain"]
    for level in range(depth):
        rows = _opened(rows, [*keys, *carried, *[f"_{i}" for i in range(level)]], level, empty_objects and level > 0, max_path_bytes)
    place = F.array(*[f"_{i}" for i in range(depth)])
    if others == "fail":
        deep = F.raise_error(F.concat(F.lit("more than the levels asked for at "), F.col("_path")))
        raw = F.when(F.substring("_raw", 1, 1).isin("[", "{") & (F.col("_raw") != "{}" if empty_objects else F.lit(True)), deep).otherwise(F.col("_raw"))
        rows = rows.select(*keys, place.alias("place"), F.col("_path").alias("path"), raw.alias("_raw")).withColumn("_number", _number(F.col("_raw")))
        return rows.select(*named, "place", "path", *_typed(F.col("_raw"), F.col("_number")))
    rows = rows.withColumn("_number", _number(F.col("_raw")))
    own = F.array(F.struct(place.alias("place"), F.col("_path").alias("path"), *_typed(F.col("_raw"), F.col("_number"))))
    exact = F.transform("_exact", lambda x: F.struct(F.array(x["ord"]).alias("place"), x["path"].alias("path"), x["type"].alias("type"), x["value"].alias("value")))
    return rows.select(*named, F.inline(F.when(F.col("_plain"), own).otherwise(exact)))
