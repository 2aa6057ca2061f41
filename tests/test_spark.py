"""Columns, rows, sources, streams, SQL functions and the command line on Spark."""

import io
import json
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from graftline import cli
from graftline.functions import columns, sql
from graftline.operators import rows
from graftline.plans import queries
from graftline.sources import files
from graftline.streaming import streams


@pytest.fixture(scope="module")
def docs(spark):
    made = ['{"a":{"b":1,"c":"x"},"t":["u",null,""],"n":null}', "5", None, "[1,[2]]", '{"k":"old_v"}']
    return spark.createDataFrame(list(enumerate(made)), "id long, json string").repartition(3)


def values_of(df, col):
    return [r.x for r in df.orderBy("id").select("id", col.alias("x")).collect()]


def test_columns(docs):
    assert values_of(docs, columns.flatten("json")) == ['{"a.b":1,"a.c":"x","t[0]":"u","t[1]":null,"t[2]":"","n":null}', '{"":5}', None, '[{"":1},{"[0]":2}]', '{"k":"old_v"}']
    assert values_of(docs, columns.flatten("json", root_array="index"))[3] == '{"[0]":1,"[1][0]":2}'
    assert values_of(docs, columns.remove_nulls("json"))[0] == '{"a":{"b":1,"c":"x"},"t":["u",""]}'
    assert values_of(docs, columns.remove_empty_strings("json"))[0] == '{"a":{"b":1,"c":"x"},"t":["u",null],"n":null}'
    assert values_of(docs, columns.replace_values("json", "^old_", "new"))[4] == '{"k":"new"}'
    assert values_of(docs, columns.replace_keys("json", "(", "new"))[4] == '{"k":"old_v"}'
    assert values_of(docs, columns.kind("json")) == ["object", "integer", None, "array", "object"]
    assert values_of(docs, columns.size("json")) == [3, 0, None, 2, 1]
    assert values_of(docs, columns.get(columns.get("json", "T"), 0))[0] == '"u"'
    assert values_of(docs, columns.number_value("json"))[1] == 5
    assert values_of(docs, columns.put("json", "k", "[]"))[4] == '{"k":"old_v","k":[]}'
    assert values_of(docs, columns.put("json", 1, "7", "insert"))[3] == "[1,7,[2]]"
    assert values_of(docs, columns.put("json", 9, "7", "insert"))[3] == "[1,[2],7]"
    assert values_of(docs, columns.delete("json", 0))[3] == "[[2]]"
    steps = [columns.remove_nulls_step(), columns.flatten_step()]
    assert values_of(docs, columns.pipeline("json", steps))[0] == '{"a.b":1,"a.c":"x","t[0]":"u","t[1]":""}'


def test_errors(spark):
    bad = spark.createDataFrame([(1, "{invalid json}")], "id long, json string")
    assert values_of(bad, columns.flatten("json", on_error="null")) == [None] and values_of(bad, columns.is_valid("json")) == [False]
    with pytest.raises(Exception, match="Invalid JSON input"):
        values_of(bad, columns.flatten("json"))
    with pytest.raises(ValueError, match="on_error"):
        columns.flatten("json", on_error="x")


def test_minify(spark):
    text = '{ "a b" : 1, // c\n "x\\"/*": /* d\n */ [1 ,\t2] / }'
    df = spark.createDataFrame([(1, text)], "id long, json string")
    assert values_of(df, columns.minify(F.col("json"))) == ['{"a b":1,"x\\"/*":[1,2]}']


def test_long_strings_are_minified(spark):
    inside = 'a\\"b // c /* d' * 80_000
    df = spark.createDataFrame([(1, '{ "k" : "' + inside + '" }'), (2, '"' + "x" * 1_000_000), (3, "/*" + "y" * 1_000_000 + "*/ 1 // " + "z" * 100_000)], "id long, json string")
    assert values_of(df, columns.minify(F.col("json"))) == ['{"k":"' + inside + '"}', '"' + "x" * 1_000_000, "1"]


def test_places_and_strict(spark):
    made = {"{invalid json}": (2, 2), '{"a":1} x': (None, 8), "{}": (None, None), "": (0, 0), "[1,]": (3, 3), '{"a" 1}': (5, 5), '"é': (1, 1), '["é\\q"]': (4, 4), "[1 2]": (3, 3), "nullx": (None, 4), '"\\ud800"': (1, 1), "[" * 1001: (1000, 1000), "[-]": (1, 1)}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(made)], "id long, json string")
    assert list(zip(values_of(df, columns.error_place("json")), values_of(df, columns.error_place("json", strict=True)), strict=True)) == list(made.values())
    assert values_of(df, columns.is_valid("json", strict=True)) == [b is None for _, b in made.values()]
    assert [r.id for r in rows.bad_documents(df, "json", ["id"]).collect()] == [i for i, (a, _) in enumerate(made.values()) if a is not None]
    with pytest.raises(Exception, match="Invalid JSON at index 7"):
        spark.createDataFrame([(7, "[")], "id long, json string").select(columns.flatten("json", index=F.col("id"))).collect()


def test_extract_put_and_arrays(docs, spark):
    got = docs.orderBy("id").select("id", columns.extract("json", n=columns.size_at(), b=columns.number_at("a", "B"), k=columns.kind_at("t", 1), s=columns.text_at("a"), h=columns.has_at("A", case_sensitive=True)).alias("x")).collect()
    assert [r.x and tuple(r.x) for r in got][:3] == [(3, 1.0, "null", '{"b":1,"c":"x"}', False), (0, None, None, None, False), None]
    assert values_of(docs, columns.put("json", "k", F.when(F.col("id") == 4, "[1]")))[4] == '{"k":"old_v","k":[1]}'
    assert values_of(docs, columns.put("json", "k", F.lit(None).cast("string")))[0] == values_of(docs, columns.printed("json"))[0]
    assert '"array"' in values_of(docs, columns.schema_of("json", root_array="array"))[3] and '"items"' not in values_of(docs, columns.schema_of("json"))[3]


def test_native_rows_are_the_exact_ones(spark):
    texts = ["1e20", "1e400", "-0", "0", "-0.5", "0.0001", "0.00001", "1.50", "01", "1.", "123456789", "1234567890", "3000000000", "0.30000000000000004", '"a\\n"', '"é \u2028"', "[1]", "{}", "true", "null", "-1", '""', '"1e5"']
    made = [f'{{"k": {t} ,"k":{t}}}' for t in texts] + ["{}", " { } x", '{"a":1}x', '{"a":1 ,"b":-22.25 }', '\ufeff{"a":1}', "5", None, '{"a,\\"b":1}', '{"a":"}","b":"{,:"}']
    flat = spark.createDataFrame(list(enumerate(made)), "id long, json string")
    exact, native = (sorted(map(str, f(flat, "json", ["id"]).collect())) for f in (rows.flatten_rows, rows.flat_object_rows))
    assert exact == native and len(exact) > 40


def test_rows(docs, spark):
    got = rows.flatten_rows(docs, "json", ["id"]).orderBy("id", "ord").collect()
    assert [tuple(r) for r in got][:3] == [(0, 0, "a.b", "integer", "1"), (0, 1, "a.c", "string", "x"), (0, 2, "t[0]", "string", "u")]
    assert {(r.id, r.path) for r in rows.path_rows(spark.createDataFrame([(1, '{"a":{},"b":[]}')], "id long, json string"), "json", ["id"]).collect()} == {(1, "a")}
    flat = spark.createDataFrame([(1, '{"s":"1","n":1.5,"i":92.0,"b":true,"z":null,"s":"2"}')], "id long, json string")
    exact, native = (sorted(tuple(r) for r in f(flat, "json", ["id"]).collect()) for f in (rows.flatten_rows, rows.flat_object_rows))
    assert exact == native
    back = rows.documents(rows.flatten_rows(flat, "json", ["id"]), ["id"]).first().json
    assert back == '{"s":"1","n":1.5,"i":92,"b":true,"z":null,"s":"2"}'
    nested = spark.sql("select named_struct('a', 1, 'b', named_struct('c', array(1, 2), 'd', 'x')) as r")
    assert rows.typed(nested).columns == ["r.a", "r.b.c", "r.b.d"]
    assert rows.typed(nested, arrays="explode", separator="_").count() == 2


def test_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"a":1},{"a":2}] trailing')
    (tmp_path / "b.jsonl").write_text('{"a":1}\n\n{"a":3}\n')
    assert [r.json for r in files.array_files(spark, str(tmp_path / "a.json")).orderBy("position").collect()] == ['{"a":1}', '{"a":2}']
    lines = files.line_files(spark, str(tmp_path / "b.jsonl"))
    files.write_lines(lines.select(columns.flatten("json").alias("json")), str(tmp_path / "out"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ['{"a":1}', '{"a":3}']
    assert [r.json for r in files.from_list(spark, [5, "x", None]).collect()] == ["5", "x", "None"]
    for k in range(40):
        (tmp_path / "many").mkdir(exist_ok=True)
        (tmp_path / "many" / f"{k:02}.txt").write_text("".join(f'{{"n":{k * 100 + j}}}\n' for j in range(k % 7)))
    numbered = files.numbered_lines(spark, str(tmp_path / "many")).orderBy("position").collect()
    assert [r.json for r in numbered] == [f'{{"n":{k * 100 + j}}}' for k in range(40) for j in range(k % 7)] and [r.position for r in numbered] == list(range(len(numbered)))
    assert files.whole_files(spark, str(tmp_path / "a.json")).count() == 1


def test_streams(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "1.json").write_text('{"id":1,"a":{"b":1}}\n{"id":2,"a":{"b":null}}\n')
    stream = streams.json_lines(spark, str(folder)).withColumn("id", F.get_json_object("json", "$.id").cast("long"))
    flat = stream.select(columns.flatten("json").alias("flat"))
    q = flat.writeStream.format("memory").queryName("flat_docs").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    assert {r.flat for r in spark.table("flat_docs").collect()} == {'{"id":1,"a.b":1}', '{"id":2,"a.b":null}'}
    running = streams.RunningSchema("json", "id")
    q = running.start(stream, str(tmp_path / "c2"))
    q.processAllAvailable()
    q.stop()
    assert dict((n, s.kind) for n, _, s in running.node(spark).members) == {"a": "object", "id": "integer"}
    # Another process goes on from what is stored.
    (folder / "2.json").write_text('{"id":3}\n')
    again = streams.RunningSchema("json", "id")
    q = again.start(stream, str(tmp_path / "c2"))
    q.processAllAvailable()
    q.stop()
    assert {n: (s.kind, s.nullable, must) for n, must, s in again.node(spark).members} == {"a": ("object", True, False), "id": ("integer", False, True)}


def test_a_stopped_stream_has_the_schema_of_one_batch(spark, tmp_path):
    """Inner structure that a gap in another batch forgets, and one that lasts over batches."""
    from graftline.operators import schema

    lines = ['{"p":{"q":1},"s":{"t":1}}', '{"s":{"t":2.5}}', '{"p":{"q":2,"r":null},"s":{"t":1}}', '{"p":{"q":"x"},"s":{"t":1},"n":[{"a":1}]}', '{"p":{"q":1},"s":{"t":1},"n":[{"b":1}]}']
    folder, seen = tmp_path / "in", []
    folder.mkdir()
    for i, line in enumerate(lines):
        (folder / f"{i}.json").write_text(line + "\n")
        stream = streams.json_lines(spark, f"file://{folder}").withColumn("id", F.lit(0))
        query = streams.RunningSchema("json", "id", seen=lambda n, node: seen.append(n)).start(stream, str(tmp_path / "c"))
        query.processAllAvailable()
        query.stop()
    assert seen == list(range(5))
    last = streams.RunningSchema("json", "id", folder=str(tmp_path / "c" / "schema"))
    want = schema.merge(spark.createDataFrame(list(enumerate(lines)), "id long, json string"), "json", "id")
    assert last.node(spark) == want
    last.update(spark.createDataFrame([(0, lines[4])], "id long, json string"), 4)  # the last batch again
    assert last.node(spark) == want
    assert streams.RunningSchema("json", "id", folder=str(tmp_path / "none")).node(spark) is None


def test_sql(spark, docs):
    names = sql.register(spark)
    docs.createOrReplaceTempView("some_docs")
    assert "json_flatten" in names
    assert spark.sql("select json_replace_values(json, '^old', 'x') v from some_docs where id = 4").first().v == '{"k":"x"}'
    assert spark.sql("select json_flatten('{') v").first().v is None
    assert spark.sql("select count(*) n from some_docs lateral view inline(json_leaves(json)) l").first().n == 6 + 1 + 2 + 1
    assert spark.sql("select json_leaves('{') is null and json_leaves(null) is null and not json_valid('{') v").first().v


def test_cli(tmp_path, capsys, monkeypatch):
    path = tmp_path / "d.json"
    path.write_text('{"a":{"old_b":"old_x"},"n":null}')
    assert cli.main([str(path)]) == 0
    assert json.loads(capsys.readouterr().out) == {"a.old_b": "old_x", "n": None}
    assert cli.main(["-r", "^old_", "k", "-v", "^old_", "w", str(path)]) == 0
    assert capsys.readouterr().out == '{"a":{"old_b":"w"},"n":null}\n'
    assert cli.main(["-n", "-p", "-o", str(tmp_path / "out"), str(path)]) == 0
    assert (tmp_path / "out").read_text() == '{\n\t"a":\t{\n\t\t"old_b":\t"old_x"\n\t}\n}\n'
    assert cli.main(["-s", str(path)]) == 0 and '"$schema"' in capsys.readouterr().out
    assert cli.main(["--paths", str(path)]) == 0 and '"n":\t"null"' in capsys.readouterr().out
    assert cli.main([str(tmp_path / "none")]) == 1
    path.write_text("{invalid json}")
    assert cli.main([str(path)]) == 1
    for args in (["-x"], ["-r", "a"], ["a", "b"]):
        with pytest.raises(SystemExit) as e:
            cli.main(args)
        assert e.value.code == 1
    monkeypatch.setattr(sys, "stdin", io.StringIO("[]"))
    assert cli.main(["-s", "-"]) == 0 and capsys.readouterr().out == "{\n}\n"


def test_module():
    done = subprocess.run([sys.executable, "-m", "graftline", "-e"], input='["",1]', capture_output=True, text=True)
    assert done.returncode == 0 and done.stdout == "[1]\n"


def test_deep_documents_of_one_file_are_dealt_to_many_tasks(spark):
    assert spark.read.parquet("/root/testdata/sf0.001/customer.parquet").rdd.getNumPartitions() == 1
    assert queries.nesting_limit(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 4
