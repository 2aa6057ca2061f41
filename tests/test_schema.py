"""The merged schema against a sequential fold."""

import json
import random

import pytest

from graftline.functions import jsontext, values
from graftline.operators import schema


def fold(docs):
    state = None
    for d in docs:
        node = values.analyse(jsontext.parse(d))
        state = node if state is None else schema.merged(state, node)
    return state


def canonical(node):
    """Without the order of members."""
    if node is None:
        return None
    members = tuple(sorted((n, m, canonical(s)) for n, m, s in node.members or ())) if node.kind == "object" else ()
    return node.kind, node.nullable, canonical(node.items) if node.kind == "array" else None, members


def made(draw, depth):
    kind = draw.choice(["object"] * 3 + ["array", "integer", "number", "string", "null"])
    if depth and kind == "object":
        return {k: made(draw, depth - 1) for k in "abc/*" if draw.random() < 0.8}
    if depth and kind == "array":
        return [made(draw, depth - 1) for _ in range(draw.randrange(3))]
    return {"integer": 1, "number": 1.5, "string": "x"}.get(kind)


def uniform(draw, depth):
    """Documents that mostly agree, so that inner structure lasts."""
    return {k: (uniform(draw, depth - 1) if depth and k in "pq" else [uniform(draw, 0)] if k == "r" else draw.choice([1, 1, 1, 2.5, None])) for k in "pqrs" if draw.random() < 0.93}


@pytest.mark.parametrize("seed", range(4))
def test_equals_the_fold(spark, seed):
    draw = random.Random(seed)
    docs = [json.dumps(uniform(draw, 2) if seed % 3 else made(draw, 3)) for _ in range(draw.choice([1, 2, 5, 30]))]
    df = spark.createDataFrame(list(enumerate(docs)), "ord long, json string").repartition(draw.choice([1, 2, 7]))
    assert canonical(schema.merge(df, "json", "ord")) == canonical(fold(docs))


@pytest.mark.parametrize(
    ("docs", "want"),
    [
        (['{}', '{"p":{"q":1}}', '{"p":{"q":2}}'], '{"type":"object","properties":{"p":{"type":["object","null"],"properties":{"q":{"type":["integer","null"]}}}}}'),
        (['{"p":{"q":1}}', '{"p":{"q":2}}', '{}'], '{"type":"object","properties":{"p":{"type":["object","null"]}}}'),
        (['{"a":[]}', '{"a":[1]}'], '{"type":"object","properties":{"a":{"type":"array","items":{"type":["string","number","integer","boolean","object","array","null"]}}},"required":["a"]}'),
    ],
)
def test_gaps(spark, docs, want):
    df = spark.createDataFrame(list(enumerate(docs)), "ord long, json string")
    got = jsontext.parse(schema.batch_schema(df, "json", "ord"))
    assert jsontext.dump(jsontext.Members(got[1:])) == want


@pytest.mark.parametrize("seed", [0, 1])
def test_groups_equal_their_folds(spark, seed):
    """One group has half of all documents; chunks of three documents follow each other."""
    draw = random.Random(seed)
    rows = [(draw.choice(["hot", "a", None]), i, json.dumps(uniform(draw, 2))) for i in range(60)]
    df = spark.createDataFrame(rows, "g string, ord long, json string").repartition(5)
    nodes = schema.merged_nodes(df, "json", "ord", ["g"], size=3).collect()
    for g in ("hot", "a", None):
        got = values.assembled([r.asDict() for r in nodes if r.g.k0 == g])
        assert canonical(got) == canonical(fold([d for h, _, d in rows if h == g]))
    texts = {r.g: r.schema for r in schema.grouped_schemas(df, ["g"], "json", "ord").collect()}
    assert texts.keys() == {"hot", "a", None} and all(canonical(values.assembled([r.asDict() for r in nodes if r.g.k0 == g])) for g in texts)


def test_many_names(spark):
    """A name for each document; nothing is made of the names that a document lacks."""
    docs = [f'{{"n{i}":{{"x":1}},"all":{{"y":{i}}}}}' for i in range(3000)]
    df = spark.createDataFrame(list(enumerate(docs)), "ord long, json string")
    got = schema.merge(df, "json", "ord")
    assert len(got.members) == 3001 and canonical(got) == canonical(fold(docs))


def test_empty_and_groups(spark):
    empty = spark.createDataFrame([], "ord long, json string")
    assert schema.batch_schema(empty, "json", "ord") == "{}"
    df = spark.createDataFrame([("x", 1, '{"a":1}'), ("x", 2, '{"a":2.5}'), ("y", 1, None)], "g string, ord long, json string")
    got = {r.g: r.schema for r in schema.grouped_schemas(df, ["g"], "json", "ord").collect()}
    assert '"number"' in got["x"] and got["y"] == "{}"
    assert schema.spark_type(schema.merge(df.where("g = 'x'"), "json", "ord")).simpleString() == "struct<a:double>"
