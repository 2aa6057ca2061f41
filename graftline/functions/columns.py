"""Column functions over JSON text. Each is one Arrow function of a batch.

``on_error`` is ``"fail"`` or ``"null"``; a null text gives null. ``pipeline``
fuses several document operators: a text is parsed and printed once.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import jsontext, regex, values

LEAVES = "array<struct<ord:int,path:string,type:string,value:string>>"


def _mapped(run: Callable, kind: str, on_error: str, message: str = "Invalid JSON input", strict: bool = False):
    """An Arrow function that applies ``run`` to the parsed texts of a batch, and to
    the values beside them in further columns. A second column named ``index`` is
    for the error's message only."""
    if on_error not in ("fail", "null"):
        raise ValueError("on_error is 'fail' or 'null'")

    def one(text: str | None, *others):
        if text is None:
            return None
        try:
            return run(jsontext.parse(text, strict, placed=on_error == "fail"), *others)
        except jsontext.Invalid as e:
            if on_error == "fail":
                raise ValueError(f"{message}: {e}") from None
            return None

    def indexed(text: str | None, index):
        try:
            return one(text)
        except ValueError as e:
            raise ValueError(f"Invalid JSON at index {index}: {e}") from None

    def of(*cols, index=None) -> Column:
        if index is not None:
            each = F.arrow_udf(lambda texts, at: pa.array([indexed(*x) for x in zip(texts.to_pylist(), at.to_pylist(), strict=True)], _arrow(kind)), kind)
            return each(*cols, index)
        if len(cols) == 2:
            return F.arrow_udf(lambda texts, others: pa.array([one(*x) for x in zip(texts.to_pylist(), others.to_pylist(), strict=True)], _arrow(kind)), kind)(*cols)
        return F.arrow_udf(lambda texts: pa.array([one(t) for t in texts.to_pylist()], _arrow(kind)), kind)(*cols)

    return of


def _arrow(kind: str) -> pa.DataType:
    if kind == LEAVES:
        return pa.list_(pa.struct([("ord", pa.int32()), ("path", pa.string()), ("type", pa.string()), ("value", pa.string())]))
    if kind.startswith("struct<"):
        return pa.struct([(n, _arrow(k)) for n, k in (f.split(":", 1) for f in kind[7:-1].split(","))])
    return {"long": pa.int64(), "array<string>": pa.list_(pa.string()), "string": pa.string(), "boolean": pa.bool_(), "int": pa.int32(), "double": pa.float64()}[kind]


def _pattern(pattern: str, strict: bool):
    """The compiled pattern, or None for a bad one, which changes nothing."""
    try:
        return regex.compiled(pattern)
    except regex.BadPattern:
        if strict:
            raise
        return None


# Steps of a pipeline: functions of a parsed document.
def flatten_step(root_array: str = "batch", max_path_bytes: int | None = values.PATH_BYTES):
    """``root_array="index"`` gives a root array one flat document with paths ``[i]``."""
    return lambda v: (values.flatten if root_array == "batch" else values.flat)(v, max_path_bytes)


def paths_step(max_path_bytes: int | None = values.PATH_BYTES):
    return lambda v: values.paths(v, max_path_bytes)


def remove_empty_strings_step():
    return lambda v: values.without(v, lambda x: x == "" and isinstance(x, str))


def remove_nulls_step():
    return lambda v: values.without(v, lambda x: x is None)


def replace_keys_step(pattern: str, replacement: str, strict_regex: bool = False):
    found = _pattern(pattern, strict_regex)
    return lambda v: values.renamed(v, found, replacement) if found else v


def replace_values_step(pattern: str, replacement: str, strict_regex: bool = False):
    found = _pattern(pattern, strict_regex)
    return lambda v: values.revalued(v, found, replacement) if found else v


def pipeline(col, steps: list, pretty: bool = False, on_error: str = "fail", strict: bool = False, index=None) -> Column:
    """The steps, one after the other, on each document. ``strict``: nothing may
    follow the document; ``index``: a column that an error's message names."""

    def run(value):
        for step in steps:
            value = step(value)
        return jsontext.dump(value, pretty)

    return _mapped(run, "string", on_error, strict=strict)(col, index=index)


# Readers of a parsed document, for ``extract``: a kind and a function.
def _below(keys: tuple, case_sensitive: bool = False):
    def find(value):
        for key in keys:
            at = _member(value, key, case_sensitive)
            if at is None:
                raise LookupError
            value = value[at][1] if isinstance(value, jsontext.Members) else value[at]
        return value

    return find


def _read(kind: str, keys: tuple, case_sensitive: bool, run: Callable, otherwise=None):
    find = _below(keys, case_sensitive)

    def reader(value):
        try:
            return run(find(value))
        except LookupError:
            return otherwise

    return kind, reader


def has_at(*keys, case_sensitive: bool = False):
    return _read("boolean", keys, case_sensitive, lambda v: True, False)


def size_at(*keys, case_sensitive: bool = False):
    return _read("long", keys, case_sensitive, lambda v: len(v) if isinstance(v, list) else 0)


def kind_at(*keys, case_sensitive: bool = False):
    return _read("string", keys, case_sensitive, values.kind)


def string_at(*keys, case_sensitive: bool = False):
    return _read("string", keys, case_sensitive, lambda v: v if isinstance(v, str) else None)


def number_at(*keys, case_sensitive: bool = False):
    return _read("double", keys, case_sensitive, lambda v: v if isinstance(v, float) else float("nan"))


def text_at(*keys, case_sensitive: bool = False):
    return _read("string", keys, case_sensitive, jsontext.dump)


def extract(col, steps: list | None = None, on_error: str = "fail", **readers) -> Column:
    """A struct of what ``readers`` find in each document after ``steps``, from one
    parse in one function: ``extract("json", n=size_at("lines"), s=string_at("status"))``.
    With ``on_error="null"`` a text that isn't JSON gives a null struct."""
    kind = "struct<" + ",".join(f"{name}:{k}" for name, (k, _) in readers.items()) + ">"

    def run(value):
        for step in steps or ():
            value = step(value)
        return {name: reader(value) for name, (_, reader) in readers.items()}

    return _mapped(run, kind, on_error)(col)


def flatten(col, pretty: bool = False, on_error: str = "fail", index=None, **options) -> Column:
    """Nested members as one level, named by path: ``a.b``, ``a[0]``."""
    return pipeline(col, [flatten_step(**options)], pretty, on_error, index=index)


def paths_with_types(col, pretty: bool = False, on_error: str = "fail", **options) -> Column:
    """An object of paths and their types."""
    return pipeline(col, [paths_step(**options)], pretty, on_error)


def remove_empty_strings(col, pretty: bool = False, on_error: str = "fail") -> Column:
    return pipeline(col, [remove_empty_strings_step()], pretty, on_error)


def remove_nulls(col, pretty: bool = False, on_error: str = "fail") -> Column:
    return pipeline(col, [remove_nulls_step()], pretty, on_error)


def replace_keys(col, pattern: str, replacement: str, pretty: bool = False, on_error: str = "fail", strict_regex: bool = False) -> Column:
    return pipeline(col, [replace_keys_step(pattern, replacement, strict_regex)], pretty, on_error)


def replace_values(col, pattern: str, replacement: str, pretty: bool = False, on_error: str = "fail", strict_regex: bool = False) -> Column:
    return pipeline(col, [replace_values_step(pattern, replacement, strict_regex)], pretty, on_error)


def schema_of(col, pretty: bool = True, on_error: str = "fail", root_array: str = "batch") -> Column:
    """The Draft-07 schema of each document. A root array is a batch whose items'
    schemas are merged, or with ``root_array="array"`` an array."""
    if root_array not in ("batch", "array"):
        raise ValueError("root_array is 'batch' or 'array'")
    return _mapped(lambda v: jsontext.dump(values.schema_of(v, root_array), pretty), "string", on_error, "Failed to generate schema")(col)


def leaf_rows(col, empty_objects: bool = False, on_error: str = "fail", max_path_bytes: int | None = values.PATH_BYTES) -> Column:
    """An array of ``(ord, path, type, value)``; ``value`` is a scalar's text without quotes."""

    return _mapped(lambda v: leaf_list(v, empty_objects, max_path_bytes), LEAVES, on_error)(col)


def leaf_list(value, empty_objects: bool = False, max_path_bytes: int | None = values.PATH_BYTES) -> list[dict]:
    rows = values.leaves(value, empty_objects, max_path_bytes)
    text = lambda v: None if v is None or isinstance(v, list) else v if isinstance(v, str) else jsontext.scalar_text(v)
    return [{"ord": i, "path": p, "type": values.kind(v), "value": text(v)} for i, (p, v) in enumerate(rows)]


def items(col, on_error: str = "fail") -> Column:
    """A root array's items, each as text; another document is its only item."""

    def run(value):
        array = isinstance(value, list) and not isinstance(value, jsontext.Members)
        return [jsontext.dump(v) for v in (value if array else [value])]

    return _mapped(run, "array<string>", on_error)(col)


def printed(col, pretty: bool = False, on_error: str = "fail") -> Column:
    return pipeline(col, [], pretty, on_error)


def is_valid(col, strict: bool = False) -> Column:
    """Whether a text parses, with ``strict`` to its end; null for null."""
    col = F.col(col) if isinstance(col, str) else col
    return F.when(col.isNotNull(), _mapped(lambda v: True, "boolean", "null", strict=strict)(col).isNotNull())


def error_place(col, strict: bool = False) -> Column:
    """The byte of a text's UTF-8 where it stops being JSON, from 0 on; null for a
    text that parses and for null."""

    def place(text: str | None) -> int | None:
        try:
            if text is not None:
                jsontext.parse(text, strict)
        except jsontext.Invalid as e:
            mark = "\ufeff" if not strict and text.startswith("\ufeff") and len(text) > 1 else ""
            return len((mark + text[len(mark) :][: e.at]).encode())
        return None

    return F.arrow_udf(lambda texts: pa.array([place(t) for t in texts.to_pylist()], pa.int64()), "long")(col)


def kind(col, on_error: str = "fail") -> Column:
    """The type of the document: null, boolean, integer, number, string, array or object."""
    return _mapped(values.kind, "string", on_error)(col)


def size(col, on_error: str = "fail") -> Column:
    """Items or members of a container; 0 for a scalar."""
    return _mapped(lambda v: len(v) if isinstance(v, list) else 0, "int", on_error)(col)


def compare(a, b, case_sensitive: bool = True) -> Column:
    """Deep equality of two documents; one that isn't JSON equals nothing."""

    def same(x: str | None, y: str | None) -> bool | None:
        if x is None or y is None:
            return None
        try:
            return values.compare(jsontext.parse(x), jsontext.parse(y), case_sensitive)
        except jsontext.Invalid:
            return False

    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        if len(x) in (x.null_count, y.null_count):
            return pa.nulls(len(x), pa.bool_())
        return pa.array([same(p, q) for p, q in zip(x.to_pylist(), y.to_pylist(), strict=True)], pa.bool_())

    return F.arrow_udf(run, "boolean")(a, b)


def minify(col) -> Column:
    """White space and comments outside strings removed, nothing checked.

    A column expression: strings are kept by being matched first.
    """
    string = r'("(?:[^"\\]++|\\"?+)*+(?:"|\z))'  # possessive: a text of any length takes no stack
    return F.regexp_replace(col, string + r"|//[^\n]*(?:\n|\z)|/\*(?s:.*?)(?:\*/|\z)|[ \t\r\n/]", "$1")


def _member(value, key, case_sensitive: bool):
    """The place of an item by number, or of the first member by name."""
    if isinstance(key, int):
        return key if isinstance(value, list) and 0 <= key < len(value) else None
    fold = (lambda k: k) if case_sensitive else values._ascii_fold
    return next((i for i, (k, _) in enumerate(value) if fold(k) == fold(key)), None) if isinstance(value, jsontext.Members) else None


def get(col, key: str | int, case_sensitive: bool = False, on_error: str = "fail") -> Column:
    """The text of a member or item, or null."""

    def run(value):
        at = _member(value, key, case_sensitive)
        if at is None:
            return None
        return jsontext.dump(value[at][1] if isinstance(value, jsontext.Members) else value[at])

    return _mapped(run, "string", on_error)(col)


def has(col, key: str, case_sensitive: bool = False, on_error: str = "fail") -> Column:
    return get(col, key, case_sensitive, on_error).isNotNull()


def string_value(col, on_error: str = "fail") -> Column:
    """The string that the document is, or null."""
    return _mapped(lambda v: v if isinstance(v, str) else None, "string", on_error)(col)


def number_value(col, on_error: str = "fail") -> Column:
    """The number that the document is, or NaN."""
    return _mapped(lambda v: v if isinstance(v, float) else float("nan"), "double", on_error)(col)


def delete(col, key: str | int, case_sensitive: bool = False, on_error: str = "fail") -> Column:
    """The document without a member (the first of its name) or item."""

    def step(value):
        at = _member(value, key, case_sensitive)
        return value if at is None else type(value)(value[:at] + value[at + 1 :])

    return pipeline(col, [step], on_error=on_error)


def put(col, key: str | int, json: str | Column, how: str = "add", case_sensitive: bool = False, on_error: str = "fail") -> Column:
    """``add`` appends, without a look for the name; ``replace`` replaces the first
    member of the name or the item, if there is one; ``insert`` puts an item before
    another, at the end if there is none. ``json`` is the new value's text, or a
    column of such texts; where that is null nothing changes."""
    if how not in ("add", "replace", "insert"):
        raise ValueError("how is 'add', 'replace' or 'insert'")

    def changed(value, new):
        members = isinstance(value, jsontext.Members)
        if not isinstance(value, list) or members != isinstance(key, str):
            return value
        at = _member(value, key, case_sensitive)
        if how == "replace":
            if at is None:
                return value
            return type(value)([*value[:at], (value[at][0], new) if members else new, *value[at + 1 :]])
        at = len(value) if how == "add" or at is None else at
        return type(value)([*value[:at], (key, new) if members else new, *value[at:]])

    if isinstance(json, Column):
        return _mapped(lambda value, text: jsontext.dump(value if text is None else changed(value, jsontext.parse(text))), "string", on_error)(col, json)
    constant = jsontext.parse(json)
    return pipeline(col, [lambda value: changed(value, constant)], on_error=on_error)


def map_values(col, keys: tuple, change: Callable[[Column], Column], on_error: str = "fail") -> Column:
    """The document with ``change`` applied to every value at ``keys``, in which
    ``"*"`` stands for all members or items: ``map_values("json", ("lines", "*", "qty"),
    lambda text: ...)``. ``change`` is a Spark expression from a value's text to another
    text, null for the value as it was. The document is parsed once."""

    def run(value):
        around, found = values.cut_at(value, tuple(keys), jsontext.dump)
        return {"around": around, "values": found}

    parts = _mapped(run, "struct<around:array<string>,values:array<string>>", on_error)(col)
    changed = F.transform(parts["values"], lambda x: F.coalesce(change(x), x))
    texts = F.transform(F.arrays_zip(parts["around"].alias("a"), changed.alias("v")), lambda x: F.concat(x["a"], F.coalesce(x["v"], F.lit(""))))
    return F.array_join(texts, "")
