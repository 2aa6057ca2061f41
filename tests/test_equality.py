"""Equality of documents as a join, and table functions."""

import json
import math
import random

import pytest

from graftline.functions import jsontext, tables, values
from graftline.operators import equality
from graftline.plans import queries


def made(draw, depth):
    kind = draw.choice("oaosn") if depth else draw.choice("sn")
    if kind == "o":
        items = [(k, made(draw, depth - 1)) for k in "abA" if draw.random() < 0.6]
        draw.shuffle(items)
        return dict(items)
    if kind == "a":
        return [made(draw, depth - 1) for _ in range(draw.randrange(3))]
    return draw.choice(["x", "", None, True]) if kind == "s" else draw.choice([0.0, 1.0, 1.0000000000000002, 0.1 + 0.2, 0.3, 1e300, 123456789012.5, 123456789012.50002, -5])


@pytest.mark.parametrize("case_sensitive", [True, False])
def test_pairs_are_those_that_compare_finds(spark, case_sensitive):
    draw = random.Random(2)
    texts = [json.dumps(made(draw, 2)) for _ in range(90)] + ['{"a":1,"a":1}', '{"a":1}', '{"a":1,"a":2}', '{"A":1}', "{}", "[]", '{"a":[]}', '{"a":{}}', "5", "5.0", "1e400", "null", "{bad", '{"a":1} x']
    # Numbers beside the edge of two runs of twelve digits.
    edge = 1.234567890125
    texts += [json.dumps({"e": x}) for x in (edge, math.nextafter(edge, 2), math.nextafter(edge, 0), 1.23456789012, -edge)]
    df = spark.createDataFrame([*enumerate(texts), (999, None)], "id long, json string").repartition(3)
    parsed = {}
    for i, t in enumerate(texts):
        try:
            if "e400" not in t:  # a number beyond the range has no key
                parsed[i] = jsontext.parse(t)
        except jsontext.Invalid:
            continue
    want = {(i, j) for i in parsed for j in parsed if values.compare(parsed[i], parsed[j], case_sensitive)}
    rows = equality.equal_documents(df, df, "json", "id", "id", case_sensitive).collect()
    assert {(r.a, r.b) for r in rows} == want and len(rows) == len(want)


def test_plain_documents_are_equal_just_if_their_texts_are(spark):
    numbers = ["0", "-0", "0.0", "1", "1.00", "1e0", "01", "0.3", "0.30000000000000004", "123456789012.0", "1234567890125", "1234567890124.9999", "-0.05", "0.00000000001", "1e-11", "1.7976931348623157e308"]
    texts = ['"a"', '"A"', '"-0.0"', '"x\\n"', '"x\n"', '"\\u0061"', '"1234567890.1234"', '"[{"', '""']
    names = ['"a"', '"A"', '"b"', '"\\u0061"', '""', '"{"']

    def value(depth):
        kind = draw.choice("nnsoa" if depth else "ns")
        if kind == "a":
            return "[" + ",".join(value(depth - 1) for _ in range(draw.randrange(3))) + "]"
        if kind == "o":
            return "{" + ",".join(f"{draw.choice(names)}: {value(depth - 1)}" for _ in range(draw.randrange(3))) + "}"
        return draw.choice(numbers if kind == "n" else texts)

    draw = random.Random(4)
    parsed = [(t, jsontext.parse(t)) for t in ["{" + f'"a":{value(1)},"b":{value(1)}' + "}" for _ in range(350)] + ["[" * 1000 + "]" * 1000, " [" + "{}," * 1100 + "1]", '{"a":1,"a":1.0}', '{"a":1}']]
    for case_sensitive in (True, False):
        plain = [equality._plain(t, case_sensitive) for t, _ in parsed]
        keys = [[p] if p is not None else equality._as_plain(v, case_sensitive) for p, (_, v) in zip(plain, parsed, strict=True)]
        assert sum(p is not None for p in plain) > 60 and sum(p is None for p in plain) > 60
        assert all(equality._as_plain(v, case_sensitive) == [p] for p, (_, v) in zip(plain, parsed, strict=True) if p is not None)
        for i, (_, x) in enumerate(parsed):
            for j, (_, y) in enumerate(parsed):
                same = values.compare(x, y, case_sensitive)
                if plain[i] is not None and plain[j] is not None:
                    assert same == (plain[i] == plain[j])
                elif same:
                    assert set(keys[i]) & set(keys[j])
    assert [equality._as_plain(jsontext.parse(t), True) for t in ("[1e400]", '{"a":1,"a":-1e400}')] == [[], []]
    docs = queries.order_docs(spark, "/root/testdata/sf0.001")
    assert equality.keys(docs, "json", ["okey"]).where("not plain").count() == 0


def test_comparison_looks_at_each_level_once(monkeypatch):
    compare, calls = values.compare, []

    def counted(*args):
        calls.append(1)
        assert len(calls) < 200
        return compare(*args)

    monkeypatch.setattr(values, "compare", counted)
    nested = jsontext.parse('{"a":' * 60 + "1" + "}" * 60)
    assert values.compare(nested, jsontext.parse('{"a":' * 60 + "1.0" + "}" * 60))
    for a, b, same in (('{"a":1,"a":1}', '{"a":1}', True), ('{"a":1,"a":2}', '{"a":1}', False), ('{"a":1}', '{"a":1,"a":2}', False), ('{"a":1,"a":2}', '{"a":1,"a":2}', False), ('{"a":1,"b":1}', '{"a":1}', False), ('{"a":null,"a":null}', '{"a":null}', True)):
        calls.clear()
        assert values.compare(jsontext.parse(a), jsontext.parse(b)) == same


def test_table_functions(spark):
    tables.register(spark)
    docs = [(1, '{"a":{"b":1},"e":{},"l":[1,"x"]}'), (2, "[5]"), (3, "{bad"), (4, None), (5, "7")]
    spark.createDataFrame(docs, "id long, doc string").createOrReplaceTempView("docs_of_test")
    rows = lambda q: sorted(map(tuple, spark.sql(q).collect()), key=repr)
    assert rows("select id, t.* from docs_of_test, lateral json_each(doc) t") == [(1, 0, "a.b", "integer", "1"), (1, 1, "l[0]", "integer", "1"), (1, 2, "l[1]", "string", "x"), (2, 0, "[0]", "integer", "5"), (5, 0, "", "integer", "7")]
    assert rows("select id, path from docs_of_test, lateral json_each(doc, 'paths') t where type = 'object'") == [(1, "e")]
    assert rows("select id, name, json from docs_of_test, lateral json_each(doc, 'members') t where id < 3") == [(1, "a", '{"b":1}'), (1, "e", "{}"), (1, "l", '[1,"x"]'), (2, None, "5")]
    with pytest.raises(Exception, match="second argument"):
        spark.sql("select * from json_each('{}', 'other')").collect()
    groups = [("x", 2, '{"p":{"q":1}}'), ("x", 1, "{}"), ("x", 3, '{"p":{"q":2}}'), ("y", 1, '{"p":{"q":1}}'), ("y", 2, "{}"), (None, 1, None)]
    spark.createDataFrame(groups, "g string, n int, doc string").createOrReplaceTempView("groups_of_test")
    found = {r.key: (r.docs, r.schema) for r in spark.sql("select * from json_schemas(table(select g, n, doc from groups_of_test) partition by g order by n)").collect()}
    assert found["x"][0] == 3 and '"q"' in found["x"][1] and found["y"][0] == 2 and '"q"' not in found["y"][1] and found[None] == (0, "{}")
