"""Root arrays read in blocks."""

import json
import random

import pytest

from graftline.functions import jsontext
from graftline.sources import files


@pytest.fixture
def small_blocks(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def items(spark, path):
    return [r.json for r in sorted(files.array_files(spark, f"file://{path}").collect(), key=lambda r: (r.file, r.position))]


def test_arrays_in_blocks_of_64_bytes(spark, tmp_path, small_blocks):
    draw = random.Random(1)
    texts = ["a,b", 'say "x, y" \\', "[1,2]", "{", "]", "é,ü", "\\\\", ",", "long, " * 40]
    made = lambda d: {draw.choice("abc"): made(d - 1), "t": draw.choice(texts)} if d and draw.random() < 0.5 else [made(d - 1), draw.choice(texts)] if d and draw.random() < 0.5 else draw.choice([1, None, True, draw.choice(texts)])
    docs = [made(3) for _ in range(150)]
    (tmp_path / "a.json").write_text(json.dumps(docs, ensure_ascii=False), encoding="utf-8")
    found = files.array_files(spark, f"file://{tmp_path}/a.json")
    assert found.select("position").distinct().count() == 150
    assert [json.loads(x) for x in items(spark, f"{tmp_path}/a.json")] == docs
    (tmp_path / "b.json").write_text(json.dumps(docs, ensure_ascii=False, indent=1) + '\n, [5, 6] ] "', encoding="utf-8")
    assert [json.loads(x) for x in items(spark, f"{tmp_path}/b.json")] == docs


@pytest.mark.parametrize(
    ("text", "want"),
    [("[]", []), (" [ ] x", []), ("[1]", ["1"]), ("﻿[1, [2,3] ,{}]", ["1", "[2,3]", "{}"]), ('{"a":[1,2],"b":"' + "x, " * 60 + '"}', None), ("5", ["5"]), ('"a,b"', ['"a,b"']), ("", []), ("[1,]", ["1", ""]), ('[{"a":"' + "," * 300 + '"},2]', None)],
)
def test_odd_files(spark, tmp_path, small_blocks, text, want):
    (tmp_path / "x.json").write_text(text, encoding="utf-8")
    value = jsontext.parse(text) if want is None else None
    if want is None:
        want = [jsontext.dump(v) for v in value] if not isinstance(value, jsontext.Members) else [text]
    assert items(spark, f"{tmp_path}/x.json") == want


def test_an_array_without_end(spark, tmp_path, small_blocks):
    (tmp_path / "x.json").write_text("[" + "1, " * 100)
    with pytest.raises(ValueError, match="without an end"):
        files.array_files(spark, f"file://{tmp_path}/x.json")


def test_many_tasks_read_one_file(spark, tmp_path, small_blocks):
    (tmp_path / "x.json").write_text(json.dumps(list(range(1000))))
    assert spark.read.text(f"file://{tmp_path}/x.json", lineSep=",").rdd.getNumPartitions() > 10
    assert items(spark, f"{tmp_path}/x.json") == [str(i) for i in range(1000)]
