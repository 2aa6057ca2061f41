"""Single documents: the contract's goldens, without Spark."""

import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graftline.functions import jsontext, regex, values
from graftline.functions.jsontext import Invalid, dump, number_text, parse


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('{"name":"J","c":{"lat":40.7128,"lng":-74.0060},"t":["a","b"],"m":null}', '{"name":"J","c.lat":40.7128,"c.lng":-74.006,"t[0]":"a","t[1]":"b","m":null}'),
        ('{"a":{},"b":[],"c":1}', '{"c":1}'),
        ("5", '{"":5}'),
        ('[1,"x"]', '[1,"x"]'),
        ("[]", "[]"),
        ('[1,{"a":2}]', '[{"":1},{"a":2}]'),
        ('[[1,2],{"a":[3]}]', '[{"[0]":1,"[1]":2},{"a[0]":3}]'),
        ('{"a.b":1,"a":{"b":2}}', '{"a.b":1,"a.b":2}'),
        ('{"a":{"":1},"":{"b":2}}', '{"a.":1,"b":2}'),
        ("[" + "0," * 50 + '{"a":1}]', "[" + "0," * 50 + '{"a":1}]'),
        ("[" + "0," * 49 + '{"a":1}]', "[" + '{"":0},' * 49 + '{"a":1}]'),
    ],
)
def test_flatten(text, want):
    assert dump(values.flatten(parse(text))) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('{"a":{},"b":[],"c":1}', '{"a":"object","c":"integer"}'),
        ("5", '{"root":"integer"}'),
        ("{}", "{}"),
        ('[1,{"a":2}]', '{"[0]":"integer","[1].a":"integer"}'),
        ('{"a":92.0,"b":3000000000,"c":2147483647,"d":1e2,"e":null,"f":true}', '{"a":"integer","b":"number","c":"integer","d":"integer","e":"null","f":"boolean"}'),
    ],
)
def test_paths(text, want):
    assert dump(values.paths(parse(text))) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [("92.0", "92"), ("-0.0", "0"), ("1e2", "100"), ("2147483648", "2147483648"), ("0.30000000000000004", "0.3"), ("1e400", "null"), ("1000000000000000", "1e+15"), ("1000000000000001", "1000000000000001"), ("9007199254740993", "9.00719925474099e+15"), ("1234567890123456789", "1.2345678901234568e+18"), ("1e20", "1e+20"), ("1e-7", "1e-07"), ("5e-324", "4.94065645841247e-324"), ("01", "1"), ("1.", "1"), ("-.5", "-0.5"), ("1E+2", "100"), ("0x10", "0"), ("nullx", "null")],
)
def test_numbers(text, want):
    assert dump(parse(text)) == want


@pytest.mark.parametrize("text", ["", "  ", "[1,]", "{'a':1}", "{a:1}", "+1", ".5", "-", "NaN", "Infinity", "-Infinity", "[NaN]", '"\\ud800"', '"\\udc00"', '"\\x"', '"a', "[1", '{"a" 1}', "{invalid json}", "[" * 1001 + "]" * 1001])
def test_invalid(text):
    with pytest.raises(Invalid):
        parse(text)


def test_strings_and_limits():
    assert dump(parse('["\\ud83d\\ude00","a\\u0000b","\\u000b\\/é"]')) == '["😀","a","\\u000b/é"]'
    assert dump(parse("﻿ \x01{\"a\":1} xyz")) == '{"a":1}'
    assert dump(parse("[" * 1000 + "]" * 1000)) == "[" * 1000 + "]" * 1000
    assert [len(k.encode()) for k, _ in values.flat(parse('{"' + "é" * 1500 + '":{"b":1}}'))] == [2047]  # a cut character, and the point
    assert dump(parse('{"a":{},"b":[{"c":1},2]}'), True) == '{\n\t"a":\t{\n\t},\n\t"b":\t[{\n\t\t\t"c":\t1\n\t\t}, 2]\n}'


def test_filters():
    empty, null = (lambda v: values.without(v, lambda x: x == "" and isinstance(x, str))), (lambda v: values.without(v, lambda x: x is None))
    doc = parse('{"name":"John","empty":"","null_field":null,"age":30,"x":["",{"a":""}," ",null]}')
    assert dump(empty(doc)) == '{"name":"John","null_field":null,"age":30,"x":[{}," ",null]}'
    assert dump(null(doc)) == '{"name":"John","empty":"","age":30,"x":["",{"a":""}," "]}'
    assert dump(empty("")) == '""' and dump(null(None)) == "null"


def test_replacement():
    old = regex.compiled("^old_.*")
    doc = parse('{"old_name":"value1","new_name":"value2","old_value":"old_data","n":[{"old_x":["old_a",1]}]}')
    assert dump(values.renamed(doc, old, "replaced")) == '{"replaced":"value1","new_name":"value2","replaced":"old_data","n":[{"replaced":["old_a",1]}]}'
    assert dump(values.revalued(doc, old, "\\1$1&")) == '{"old_name":"value1","new_name":"value2","old_value":"\\\\1$1&","n":[{"old_x":["\\\\1$1&",1]}]}'


@pytest.mark.parametrize(("pattern", "text", "found"), [("^old_.*", "old_x", True), ("[[:alpha:]]+$", "123", False), ("a{2}", "baab", True), ("(a|b)*?c", "xc", True), ("[]a]", "]", True), ("a$", "a\n", False), (".", "\n", True), ("\\d", "d", True), ("[\\d]", "\\", True), (")", ")", True), ("a|^b", "xb", False), ("[^[:digit:]-]", "5-", False)])
def test_regex(pattern, text, found):
    assert bool(regex.compiled(pattern).search(text)) is found


@pytest.mark.parametrize("pattern", ["(", "[", "*a", "a{", "[b-a]", "a{2,1}", "(?:a)", "\\"])
def test_bad_regex(pattern):
    with pytest.raises(regex.BadPattern):
        regex.translate(pattern)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('{"a":[null,1]}', '{"type":"array","items":{"type":"integer"}}'),
        ('{"a":[1,null]}', '{"type":"array","items":{"type":["string","number","integer","boolean","object","array","null"]}}'),
        ('{"a":[]}', '{"type":"array","items":{"type":"null"}}'),
        ('{"a":[null,null]}', '{"type":"array","items":{"type":["null","null"]}}'),
        ('{"a":[1,2.5]}', '{"type":"array","items":{"type":"number"}}'),
        ('{"a":[{"a":1},{"b":2}]}', '{"type":"array","items":{"type":"object","properties":{"a":{"type":"integer"}},"required":["a"]}}'),
        ('{"a":null}', '{"type":["null","null"]}'),
        ('{"a":[' + ",".join(["1", '"x"'] * 74 + ["1"]) + "]}", '{"type":"array","items":{"type":"integer"}}'),
    ],
)
def test_schema(text, want):
    node = dict(values.draft(values.analyse(parse(text))))["properties"]
    assert dump(dict(node)["a"]) == want


def test_compare():
    assert values.compare(parse('{"a":1,"b":[0.1]}'), parse('{"b":[0.10000000000000001],"a":1.0}'))
    assert not values.compare(parse("[1,2]"), parse("[1]")) and not values.compare(parse('{"a":1}'), parse('{"A":1}'))
    assert values.compare(parse('{"a":1}'), parse('{"A":1}'), case_sensitive=False)
    assert not values.compare(parse("1"), parse("true"))


plain = st.recursive(st.none() | st.booleans() | st.floats(allow_nan=False, allow_infinity=False) | st.text(st.characters(codec="utf-8", exclude_characters="\0")), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(st.characters(codec="utf-8", exclude_characters="\0"), max_size=4), x, max_size=4), max_leaves=20)


@settings(max_examples=150, deadline=None)
@given(plain)
def test_properties(value):
    doc = parse(json.dumps(value, ensure_ascii=False))
    assert values.compare(parse(dump(doc)), doc) and values.compare(parse(dump(doc, True)), doc)
    empty, null = (lambda v: values.without(v, lambda x: x == "" and isinstance(x, str))), (lambda v: values.without(v, lambda x: x is None))
    assert dump(empty(empty(doc))) == dump(empty(doc)) and dump(null(empty(doc))) == dump(empty(null(doc)))
    if isinstance(doc, list):
        flat, paths = [k for k, _ in values.flat(doc)], [k for k, _ in values.paths(doc)]
        assert set(flat) <= set(paths)


@given(st.floats(allow_nan=False, allow_infinity=False))
def test_number_text(x):
    y = float(number_text(x))
    assert abs(x - y) <= max(abs(x), abs(y)) * 2.3e-16


def test_texts_of_many_containers_go_to_the_standard_decoder(monkeypatch):
    def no(*_):
        raise AssertionError("the slow parser")

    def error(text, **how):
        with pytest.raises(Invalid) as e:
            parse(text, **how)
        return e.value.at

    deep, wrong = ["[1," * 1500, '{"a":[' * 501 + "1", ' [{"a]":' + "[" * 999, "[" * 10**6], ["[" * 900 + "x" + "[" * 200, '["' + "[" * 1100, "[1}" + "[" * 1100, "[}" * 600, '{"a"' * 1100]
    want = {}
    for text in deep + wrong:
        with pytest.raises(Invalid) as e:
            jsontext._value(text, len(text) - len(text.lstrip()), 0)
        want[text] = e.value.at
    assert {t: error(t) for t in deep + wrong} == want and all(error(t, placed=False) >= 0 for t in deep + wrong)
    assert parse('"a"' + "[" * 1100) == "a" and parse("[]" + "[" * 1100) == []
    monkeypatch.setattr(jsontext, "_value", no)
    assert {t: error(t) for t in deep} == {t: want[t] for t in deep}
    many = '[{"a":["]["]},"\\"["]'
    assert len(parse("[" + ",".join([many] * 2000) + "]")) == 2000 and parse("[" * 1000 + "]" * 1000)


@pytest.mark.parametrize("most", [None, 3, 5, 8, 13, 2047])
def test_paths_of_chains_are_made_step_by_step(most):
    def below(value, path):
        if not isinstance(value, list) or (not value and isinstance(value, jsontext.Members)):
            yield path, value
        else:
            for p, v in values.children(value, path, most):
                yield from below(v, p)

    def made(depth):
        if not depth:
            return draw.choice(["1", "{}", "[]", '"x"'])
        names = draw.choices(["a", "", "é", "日本", "b.c"], k=draw.choice([1, 1, 1, 2]))
        return "[" + ",".join(made(depth - 1) for _ in names) + "]" if draw.random() < 0.5 else "{" + ",".join(f'"{n}":{made(depth - 1)}' for n in names) + "}"

    draw = random.Random(3)
    for _ in range(300):
        doc = parse(made(draw.randrange(1, 9)))
        assert list(values.leaves(doc, True, most)) == list(below(doc, ""))
    chain = parse('{"a":' + "[" * 990 + '{"é":1}' + "]" * 990 + "}")
    assert list(values.leaves(chain, True, most)) == list(below(chain, ""))
