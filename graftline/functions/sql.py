"""The operators as SQL functions."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import columns, jsontext, regex, values


def register(spark: SparkSession, prefix: str = "json_") -> list[str]:
    """Register ``json_flatten(text)`` and the others; a text that isn't JSON gives null.

    ``json_leaves`` gives an array of structs, for ``inline``:
    ``select id, inline(json_leaves(doc)) from docs``."""
    import pyarrow as pa

    def of(step):
        def one(*args):
            if any(a is None for a in args):
                return None
            try:
                return jsontext.dump(step(jsontext.parse(args[0]), *args[1:]))
            except jsontext.Invalid:
                return None

        return one

    def with_pattern(change):
        def step(value, pattern, new):
            try:
                return change(value, regex.compiled(pattern), new)
            except regex.BadPattern:
                return value

        return step

    one_text = {
        "flatten": values.flatten,
        "paths": values.paths,
        "schema": values.schema_of,
        "remove_empty_strings": columns.remove_empty_strings_step(),
        "remove_nulls": columns.remove_nulls_step(),
        "compact": lambda v: v,
    }
    with_two = {"replace_keys": with_pattern(values.renamed), "replace_values": with_pattern(values.revalued)}

    def arrow(run, n):
        if n == 1:
            return F.arrow_udf(lambda a: pa.array([run(x) for x in a.to_pylist()], pa.string()), "string")
        return F.arrow_udf(lambda a, b, c: pa.array([run(*x) for x in zip(a.to_pylist(), b.to_pylist(), c.to_pylist(), strict=True)], pa.string()), "string")

    for name, step in one_text.items():
        spark.udf.register(prefix + name, arrow(of(step), 1))
    for name, step in with_two.items():
        spark.udf.register(prefix + name, arrow(of(step), 3))

    def leaves(text):
        try:
            return None if text is None else columns.leaf_list(jsontext.parse(text))
        except jsontext.Invalid:
            return None

    kind = columns._arrow(columns.LEAVES)
    spark.udf.register(prefix + "leaves", F.arrow_udf(lambda a: pa.array([leaves(x) for x in a.to_pylist()], kind), columns.LEAVES))
    spark.udf.register(prefix + "valid", F.arrow_udf(lambda a: pa.array([None if x is None else leaves(x) is not None for x in a.to_pylist()], pa.bool_()), "boolean"))
    return [prefix + n for n in (*one_text, *with_two, "leaves", "valid")]
