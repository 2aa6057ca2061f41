"""Native leaf rows against the exact ones."""

import itertools
import json
import random

import pytest
from pyspark.errors import PySparkException

from graftline.operators import native, rows


def value(draw, depth):
    kind = draw.choice("oaoasnbzi") if depth else draw.choice("snbzi")
    if kind == "o":
        return {draw.choice(["a", "b", "a.b", "", "é", "x y", 'n"q', "[0]", "snow"]) + str(draw.randrange(3)): value(draw, depth - 1) for _ in range(draw.randrange(4))}
    if kind == "a":
        return [value(draw, depth - 1) for _ in range(draw.randrange(4))]
    texts, numbers = ["", "x", "null", "1", "{}", "[1]", 'a"b', "t\\n", "é😀", "n5", " sp "], [1.5, 92.0, 0.0001, 123456.789, -0.0, 2147483648, -3.25, 99999999999.5]
    return {"s": draw.choice(texts), "n": draw.choice(numbers), "b": True, "z": None, "i": draw.randrange(-5, 3000000000)}[kind]


ODD = ['{"a":1}x', '{"a":01}', '{"a":1e2}', '[1,{"a":2}]', '{"a":"\t"}', "{}", "[]", '{"a":{}}', '{"a":"x"}', '{"a":-0}', '{"a":-0.0,"b":1.50,"c":100,"d":0.10}', '{"a":[[[[[[[1]]]]]]]}', ' \n{"a":1}']
ODD += ['{"a":0.00001}', '{"a":1234567890123456}', '{"a":123456789012345}', '{"d":1,"d":2}', '{"' + "k" * 3000 + '":{"é":1}}', '{"' + "é" * 1100 + '":1}', '{"a" : [ ] , "b" : [ { } ] }', '{"a":"\\ud83d\\ude00"}', "5", '"x"']
BAD = ["{1:2}", '{"a":nul}', '{"a":1', "[1,]", '{"a":.5}', "{'a':1}", "", "nul", '{"a":1 2}', '{"a":[1}']


@pytest.mark.parametrize("empty", [False, True])
def test_same_rows_as_the_exact_functions(spark, empty):
    draw = random.Random(3)
    docs = [json.dumps(value(draw, 4), ensure_ascii=draw.random() < 0.1, indent=draw.choice([None, 1])) for _ in range(250)] + ODD + BAD
    df = spark.createDataFrame([*enumerate(docs), (9999, None)], "id long, json string").repartition(3)
    exact = sorted((r.id, r.ord, r.path, r.type, r.value) for r in rows.flatten_rows(df, "json", ["id"], "null", empty).collect())
    found = sorted(native.leaf_rows(df, "json", ["id"], empty_objects=empty, on_error="null").collect(), key=lambda r: (r.id, r.place))
    assert exact == [(i, k, r.path, r.type, r.value) for i, g in itertools.groupby(found, key=lambda r: r.id) for k, r in enumerate(g)]


def test_plain_documents_alone_have_no_python(spark):
    df = spark.createDataFrame([(1, '{"a":[{"b":1}]}')], "id long, json string")
    found = native.leaf_rows(df, "json", ["id"], others="fail")
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
    assert [(r.path, r.type, r.value) for r in found.collect()] == [("a[0].b", "integer", "1")]
    for text in ('{"a":1e5}', '{"a":', "[[[1]]]"):
        bad = spark.createDataFrame([(1, text)], "id long, json string")
        with pytest.raises(PySparkException):
            native.leaf_rows(bad, "json", ["id"], others="fail", depth=2).collect()
