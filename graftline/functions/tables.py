"""Table functions: ``select d.id, t.* from docs d, lateral json_each(d.doc) t``."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from . import columns, jsontext, values


def _fields(**kinds: type[T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind()) for name, kind in kinds.items()])


_FIELDS = {
    "leaves": _fields(ord=T.IntegerType, path=T.StringType, type=T.StringType, value=T.StringType),
    "paths": _fields(ord=T.IntegerType, path=T.StringType, type=T.StringType),
    "members": _fields(ord=T.IntegerType, name=T.StringType, type=T.StringType, json=T.StringType),
}


class JsonEach:
    """The rows of one document. The second argument says which, and so which columns:
    ``'leaves'``, ``'paths'`` (empty objects included) or ``'members'`` of the root.
    A text that isn't JSON, and a null, give none."""

    @staticmethod
    def analyze(doc: AnalyzeArgument, what: AnalyzeArgument | None = None) -> AnalyzeResult:
        chosen = "leaves" if what is None else what.value
        if chosen not in _FIELDS:
            raise ValueError("the second argument is 'leaves', 'paths' or 'members', as a constant")
        if doc.dataType != T.StringType():
            raise ValueError("the first argument is a text")
        return AnalyzeResult(schema=_FIELDS[chosen])

    def eval(self, doc: str, what: str = "leaves") -> Iterator[tuple]:
        try:
            value = None if doc is None else jsontext.parse(doc)
        except jsontext.Invalid:
            return
        if doc is None:
            return
        if what == "members":
            if isinstance(value, list):
                named = value if isinstance(value, jsontext.Members) else [(None, v) for v in value]
                for i, (name, v) in enumerate(named):
                    yield i, name, values.kind(v), jsontext.dump(v)
            return
        for leaf in columns.leaf_list(value, empty_objects=what == "paths"):
            yield (leaf["ord"], leaf["path"], leaf["type"], leaf["value"])[: 4 if what == "leaves" else 3]


class JsonSchemas:
    """The merged schema of each partition of a table, in its order:
    ``select * from json_schemas(table(select g, doc from t) partition by g order by n)``.
    The column ``doc`` is the document; the first column, by which it is partitioned, is
    given as text, ``key``. A partition is folded by one task, a document at a time;
    ``operators.schema.grouped_schemas`` spreads large groups."""

    @staticmethod
    def analyze(table: AnalyzeArgument) -> AnalyzeResult:
        if not table.isTable:
            raise ValueError("the argument is a table")
        return AnalyzeResult(schema=_fields(key=T.StringType, docs=T.LongType, schema=T.StringType))

    def __init__(self):
        self.key, self.docs, self.state = None, 0, None

    def eval(self, row: Row) -> None:
        self.key, text = (None if row[0] is None else str(row[0])), row["doc"]
        if text is not None:
            node = values.analyse(jsontext.parse(text))
            self.docs, self.state = self.docs + 1, node if self.state is None else values.merged(self.state, node)

    def terminate(self) -> Iterator[tuple]:
        yield self.key, self.docs, "{}" if self.state is None else jsontext.dump(values.draft(self.state))


def register(spark: SparkSession, prefix: str = "json_") -> list[str]:
    """Register ``json_each`` and ``json_schemas``."""
    spark.udtf.register(f"{prefix}each", F.udtf(JsonEach))
    spark.udtf.register(f"{prefix}schemas", F.udtf(JsonSchemas))
    return [f"{prefix}each", f"{prefix}schemas"]
