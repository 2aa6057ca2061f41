"""Nested columns, removal on leaf rows, changed values and VARIANT readers."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from graftline.functions import columns, variants
from graftline.operators import nested, rows


def made(draw, depth):
    kind = draw.choice("oaas") if depth else "s"
    if kind == "o":
        return {k: made(draw, depth - 1) for k in "abc" if draw.random() < 0.6}
    if kind == "a":
        return [made(draw, depth - 1) for _ in range(draw.randrange(5))]
    return draw.choice([None, "", "x", 1, True, None, ""])


@pytest.mark.parametrize(("on_rows", "on_text"), [(rows.remove_null_rows, columns.remove_nulls), (rows.remove_empty_rows, columns.remove_empty_strings)])
def test_removal_on_rows_is_removal_on_text(spark, on_rows, on_text):
    draw = random.Random(8)
    docs = [json.dumps({"r": made(draw, 4), "s": made(draw, 2)}) for _ in range(200)] + ["[null,[null,1,null,2],null,[[null],[1,null,3]]]", '["",["",1]]']
    df = spark.createDataFrame(list(enumerate(docs)), "id long, json string").repartition(3)
    found = on_rows(rows.flatten_rows(df, "json", ["id"]), ["id"])
    want = rows.flatten_rows(df.select("id", on_text("json").alias("json")), "json", ["id"])
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert on_rows(rows.flatten_rows(df.limit(0), "json", ["id"]), ["id"]).collect() == []


NESTED = "id int, s struct<a:string,n:struct<a:string,k:int>>, l array<string>, ll array<array<string>>, ls array<struct<a:string>>, m map<string,string>"


def test_nested_columns(spark):
    full = (1, ("old_1", ("", 5)), ["", None, "old_x", "y"], [["", "b"], None, []], [("",), None, ("c",)], {"a": "", "b": None, "c": "old"})
    df = spark.createDataFrame([full, (2, None, None, None, None, None)], NESTED)
    out = lambda d: [r.asDict(True) for r in d.orderBy("id").collect()]
    nulls = out(nested.remove_nulls(df))
    assert nulls[0] == {"id": 1, "s": {"a": "old_1", "n": {"a": "", "k": 5}}, "l": ["", "old_x", "y"], "ll": [["", "b"], []], "ls": [{"a": ""}, {"a": "c"}], "m": {"a": "", "c": "old"}}
    assert nulls[1] == {"id": 2, "s": None, "l": None, "ll": None, "ls": None, "m": None}
    empty = out(nested.remove_empty_strings(df))[0]
    assert empty == {"id": 1, "s": {"a": "old_1", "n": {"a": None, "k": 5}}, "l": [None, "old_x", "y"], "ll": [["b"], None, []], "ls": [{"a": None}, None, {"a": "c"}], "m": {"b": None, "c": "old"}}
    values = out(nested.replace_values(df, "^old", "Z"))[0]
    assert values["s"]["a"] == "Z" and values["l"] == ["", None, "Z", "y"] and values["m"]["c"] == "Z"
    assert nested.replace_keys(df, "^(a|l)$", "r").schema.simpleString() == "struct<id:int,s:struct<r:string,n:struct<r:string,k:int>>,r:array<string>,ll:array<array<string>>,ls:array<struct<r:string>>,m:map<string,string>>"
    assert "Python" not in nested.remove_nulls(df)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    ("doc", "keys", "want"),
    [
        ('{"a":[1,2,{"a":3}]}', ("a", "*"), '{"a":[<1>,<2>,<{"a":3}>]}'),
        ('{"l":[{"q":1,"r":0},{"r":1},{"q":2.50,"q":9},5],"q":7}', ("l", "*", "q"), '{"l":[{"q":<1>,"r":0},{"r":1},{"q":<2.5>,"q":9},5],"q":7}'),
        ("[1,[2,3]]", (1, 0), "[1,[<2>,3]]"),
        ("5", (), "<5>"),
        ('{"a":{}}', ("b", "*"), '{"a":{}}'),
        ('{"a":1,"b":"x"}', ("*",), '{"a":<1>,"b":<"x">}'),
        ("[]", (0,), "[]"),
    ],
)
def test_changed_values(spark, doc, keys, want):
    df = spark.createDataFrame([(doc,), (None,)], "json string")
    found = [r[0] for r in df.select(columns.map_values("json", keys, lambda t: F.concat(F.lit("<"), t, F.lit(">")))).collect()]
    assert found == [want, None]
    assert [r[0] for r in df.select(columns.map_values("json", keys, lambda t: F.lit(None).cast("string"))).collect()] == [want.replace("<", "").replace(">", ""), None]


def test_variant_readers_agree_with_the_exact_ones(spark):
    docs = ['{"A":[1,{"b":"x"}],"n":92.0,"z":null,"t":true,"s":"q","o":{"k":1}}', '{"a":1,"A":2}', '{"a":1,"a":2}', "[]", "5", "{bad", None, '{"n":3000000000}', '{"n":1e2}', '{"n":"x"}', '{"a":{"b":1,"c":2}}']
    df = spark.createDataFrame(list(enumerate(docs)), "id long, json string")
    names = {"size_a": ("size", ("a",)), "kind_n": ("kind", ("n",)), "kind_z": ("kind", ("z",)), "kind_t": ("kind", ("T",)), "text": ("string", ("a", 1, "b")), "number": ("number", ("n",)), "has_z": ("has", ("z",)), "kind_o": ("kind", ("o",))}
    exact = df.select("id", columns.extract("json", on_error="null", **{n: getattr(columns, f"{f}_at")(*k) for n, (f, k) in names.items()}).alias("x")).collect()
    found = df.select("id", variants.extract(F.col("json"), **{n: getattr(variants, f"{f}_at")(*k) for n, (f, k) in names.items()}).alias("x"))
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
    unsure = []
    for e, f in zip(sorted(exact), sorted(found.collect()), strict=True):
        if f.x.unsure is not False:
            unsure.append(f.id)
            continue
        for n in names:
            a, b = e.x[n], f.x[n]
            assert a == b or (isinstance(a, float) and math.isnan(a) and math.isnan(b)), (docs[f.id], n)
    assert unsure == [1, 2, 5, 6]
