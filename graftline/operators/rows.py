"""Documents as rows: a row for each leaf. Spark joins, groups and filters these."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns, regex


def flatten_rows(df: DataFrame, json_col: str, ids: list[str], on_error: str = "fail", empty_objects: bool = False) -> DataFrame:
    """``(ids..., ord, path, type, value)`` for each leaf of each document."""
    found = columns.leaf_rows(df[json_col], empty_objects, on_error)
    return df.select(*[df[c] for c in ids], F.inline(found))


def path_rows(df: DataFrame, json_col: str, ids: list[str], on_error: str = "fail") -> DataFrame:
    """``(ids..., ord, path, type)``, empty objects included."""
    return flatten_rows(df, json_col, ids, on_error, empty_objects=True).drop("value")


#: A member of a plain object: no escapes, numbers that print as they stand.
_NAME = r'"([^"\\\x00-\x1F]*+)"'
_SCALAR = r'("[^"\\\x00-\x1F]*+"|true|false|null|0(?![0-9.eE+-])|-?[1-9][0-9]{0,8}+(?![0-9.eE+-])|-?(?:0|[1-9][0-9]{0,8}+)\.[0-9]{0,3}[1-9](?![0-9.eE+-]))'
_MEMBER = _NAME + r"[ \t\r\n]*+:[ \t\r\n]*+" + _SCALAR
_PLAIN = r"^[ \t\r\n]*+\{[ \t\r\n]*+(?:" + _MEMBER + r"[ \t\r\n]*+(?:,[ \t\r\n]*+(?=\")|(?=\})))*+\}[ \t\r\n]*+\z"


def flat_object_rows(df: DataFrame, json_col: str, ids: list[str], on_error: str = "fail") -> DataFrame:
    """``flatten_rows``, without Python for plain documents: objects of scalars with
    no escapes in strings and numbers of up to nine digits and four decimals. Other
    documents go through ``flatten_rows``, so both give the same rows."""
    text = df[json_col]
    plain = F.coalesce(text.rlike(_PLAIN), F.lit(False))
    found = df.where(plain).select(*[df[c] for c in ids], F.posexplode(F.regexp_extract_all(text, F.lit(f"({_MEMBER})"), F.lit(1))).alias("ord", "_member"))
    found = found.select(*ids, "ord", F.regexp_extract("_member", _MEMBER, 1).alias("path"), F.regexp_extract("_member", _MEMBER, 2).alias("_raw"))
    first = F.substring("_raw", 1, 1)
    kind = F.when(first == '"', "string").when(first.isin("t", "f"), "boolean").when(first == "n", "null").when(F.col("_raw").contains("."), "number").otherwise("integer")
    value = F.when(first == '"', F.expr("substring(_raw, 2, length(_raw) - 2)")).when(first != "n", F.col("_raw"))
    native = found.select(*ids, "ord", "path", kind.alias("type"), value.alias("value"))
    return native.unionByName(flatten_rows(df.where(~plain), json_col, ids, on_error))


def bad_documents(df: DataFrame, json_col: str, ids: list[str], strict: bool = False) -> DataFrame:
    """``(ids..., place)`` of the texts that aren't JSON, ``place`` being the byte
    where they stop being so."""
    return df.select(*[df[c] for c in ids], columns.error_place(df[json_col], strict).alias("place")).where("place is not null")


def replace_paths(rows: DataFrame, pattern: str, replacement: str) -> DataFrame:
    """Rows whose path holds the pattern get another path."""
    return rows.withColumn("path", F.when(F.col("path").rlike(regex.java(pattern)), replacement).otherwise(F.col("path")))


def replace_strings(rows: DataFrame, pattern: str, replacement: str) -> DataFrame:
    """String values that hold the pattern are replaced."""
    found = (F.col("type") == "string") & F.col("value").rlike(regex.java(pattern))
    return rows.withColumn("value", F.when(found, replacement).otherwise(F.col("value")))


def _without(rows: DataFrame, ids: list[str], gone: Column, levels: int | None) -> DataFrame:
    step = r"\[(\d+)\]"
    index = F.regexp_extract_all("path", F.lit(step), F.lit(1))
    if levels is None:
        levels = rows.agg(F.max(F.size(index))).first()[0] or 0
    # Dealt out by document once; the windows below need no shuffle of their own.
    found = rows.repartition(*ids).withColumn("_gone", F.coalesce(gone, F.lit(False))).withColumn("_at", index)
    shifts = []
    for k in range(levels):
        # The array that the k-th index is of, and whether the row is an item of it that goes.
        above = F.regexp_extract("path", rf"^((?:.*?\[\d+\]){{{k}}}.*?)\[\d+\]", 1)
        here = F.size("_at") > k
        direct = F.col("_gone") & (F.size("_at") == k + 1) & F.col("path").rlike(r"\[\d+\]$")
        found = found.withColumn("_above", F.when(here, above)).withColumn("_i", F.when(here, F.get("_at", F.lit(k)).cast("long")))
        lower = Window.partitionBy(*ids, "_above").orderBy("_i").rangeBetween(Window.unboundedPreceding, -1)
        found = found.withColumn(f"_s{k}", F.coalesce(F.sum(F.when(direct, 1).otherwise(0)).over(lower), F.lit(0)))
        shifts.append(F.col(f"_s{k}"))
    pieces = F.split("path", step, -1)
    shift = F.array(*shifts) if shifts else F.array(F.lit(0))
    moved = F.transform(pieces, lambda p, i: F.when(i < F.size("_at"), F.concat(p, F.lit("["), (F.get("_at", i).cast("long") - F.get(shift, i)).cast("string"), F.lit("]"))).otherwise(p))
    found = found.withColumn("path", F.array_join(moved, "")).where("not _gone")
    if "ord" in rows.columns:
        found = found.withColumn("ord", F.row_number().over(Window.partitionBy(*ids).orderBy("ord")) - 1)
    return found.select(*rows.columns)


def remove_null_rows(rows: DataFrame, ids: list[str], levels: int | None = None) -> DataFrame:
    """Leaf rows without nulls, as the documents without nulls would have them: where
    an item goes, those after it in its array move up, level by level, by windows over
    the array's rows. A window holds rows of one document. ``levels`` are the indices
    to a path at most, found by an aggregate if not given. Names that hold an index in
    brackets can't be told from items."""
    return _without(rows, ids, F.col("type") == "null", levels)


def remove_empty_rows(rows: DataFrame, ids: list[str], levels: int | None = None) -> DataFrame:
    """``remove_null_rows`` for empty strings."""
    return _without(rows, ids, (F.col("type") == "string") & (F.col("value") == ""), levels)


def documents(rows: DataFrame, ids: list[str], name: str = "json") -> DataFrame:
    """Flat documents again from rows of leaves."""
    quoted = lambda c: F.regexp_replace(F.to_json(F.struct(c.alias("x"))), r'(?s)^\{"x":(.*)\}$', "$1")
    value = F.when(F.col("type") == "string", quoted(F.col("value"))).otherwise(F.coalesce("value", F.lit("null")))
    member = F.struct("ord", F.concat(quoted(F.col("path")), F.lit(":"), value).alias("text"))
    texts = F.transform(F.array_sort(F.collect_list(member)), lambda m: m["text"])
    return rows.groupBy(*ids).agg(F.concat(F.lit("{"), F.array_join(texts, ","), F.lit("}")).alias(name))


def path_statistics(rows: DataFrame) -> DataFrame:
    """For each path and type: rows, and different values about."""
    return rows.groupBy("path", "type").agg(F.count("*").alias("n"), F.approx_count_distinct("value").alias("values"))


def typed(df: DataFrame, arrays: str = "keep", separator: str = ".") -> DataFrame:
    """Struct columns as flat ones, from the schema alone: Catalyst prunes what
    isn't used. ``arrays="explode"`` gives rows for the items of array columns."""

    def of(kind: T.DataType, col: Column, name: str):
        if isinstance(kind, T.StructType):
            for f in kind:
                yield from of(f.dataType, col.getField(f.name), f"{name}{separator}{f.name}")
        else:
            yield col.alias(name)

    while True:
        df = df.select(*[c for f in df.schema for c in of(f.dataType, df[f"`{f.name}`"], f.name)])
        lists = [f.name for f in df.schema if isinstance(f.dataType, T.ArrayType)]
        if arrays == "keep" or not lists:
            return df
        df = df.select(*[F.explode_outer(f"`{lists[0]}`").alias(lists[0]) if c == lists[0] else df[f"`{c}`"] for c in df.columns])


def value_at(json: Column, path: str) -> Column:
    """One leaf's value by its path, without parsing into rows."""
    return F.get_json_object(json, "$." + path)
