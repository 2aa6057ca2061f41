"""The schemas of batches of documents, merged in their order.

Merging keeps what it knows of a property only as long as every document has it:
where a document lacks it, or it turns up first in a later document, its inner
structure is forgotten and gathered anew from the documents after that *gap*. So the
merged schema follows from where each property's last unbroken stretch starts.

Documents are dealt out in ranges of their order (and group), and a task reads its
range in order. It numbers the places of every path, and gives a row for each stretch
of documents in which a path has one type: what it is, and which of its parent's places
it stands at. Nothing is given for what a document lacks. Numbers of ranges are added
up, so a stretch knows its places among all documents.

Stretches are then put together level by level, from the root down. Of a property, the
stretches of a range make a summary (first place, start of the unbroken tail, last
place), summaries follow each other as stretches do, and so on to the whole: each list
is of bounded length, and a group that has most of the documents is no task of its own.
Where the tail starts is where the level below starts to count.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import jsontext, values

# Fixed values
KINDS = ["null", "boolean", "integer", "number", "string", "array", "object", "mixed"]

#: Documents to a chunk of a range; scopes that are sent to all tasks at most.
CHUNK, FEW = 100_000, 50_000
_STRETCH = [("chunk", pa.int64()), ("above", pa.string()), ("path", pa.string()), ("kind", pa.int64()), ("nullable", pa.bool_()), ("required", pa.bool_()), ("lo", pa.int64()), ("n", pa.int64()), ("own", pa.int64())]
STRETCHES = "chunk bigint, above string, path string, kind bigint, nullable boolean, required boolean, lo bigint, n bigint, own bigint"


def _kept(df: DataFrame) -> DataFrame:
    """Checkpointed where a folder is set, else cached: levels read it again."""
    if df.sparkSession.sparkContext.getCheckpointDir() or df.sparkSession.conf.get("spark.checkpoint.dir", None):
        return df.checkpoint()
    return df.persist()


class _Chunk:
    """The stretches of consecutive documents."""

    def __init__(self):
        self.docs = 0
        self.open: dict[str, list] = {}  # path: kind, nullable, required, first place of the parent, places, first own place, parent
        self.count: dict[str, int] = {}
        self.done: list[tuple] = []

    def add(self, node: values.Node) -> None:
        self.docs += 1
        self._add(node, "", "", True, self.docs)

    def _add(self, node: values.Node, above: str, path: str, required: bool, place: int) -> None:
        last = self.open.get(path)
        if last and last[3] + last[4] - 1 == place:
            return  # a name that its object repeats
        own = self.count[path] = self.count.get(path, 0) + 1
        kind = 1 << KINDS.index(node.kind)
        if last and last[3] + last[4] == place and last[:3] == [kind, node.nullable, required]:
            last[4] += 1
        else:
            if last:
                self._close(path, last)
            self.open[path] = [kind, node.nullable, required, place, 1, own, above]
        for name, must, below in node.members or ():
            self._add(below, path, path + values.path_step(name), must, own)
        if node.items:
            self._add(node.items, path, path + "*", True, own)

    def _close(self, path: str, s: list) -> None:
        self.done.append((s[6], path, s[0], s[1], s[2], s[3], s[4], s[5]))

    def rows(self) -> list[tuple]:
        for path, s in self.open.items():
            self._close(path, s)
        return self.done


def stretches(df: DataFrame, json_col: str, order_by: str, by: list[str] | None = None, on_error: str = "fail", size: int = CHUNK) -> DataFrame:
    """``(g, chunk, above, path, kind, nullable, required, lo, n, own)``: ``n`` places
    of a path from its ``own``-th on, at its parent's places from ``lo`` on, counted
    within a chunk of up to ``size`` documents. ``g`` holds the columns of ``by``;
    ``kind`` is a bit of a set."""
    group = F.struct(*[df[c].alias(f"k{i}") for i, c in enumerate(by or ())]) if by else F.lit(0)
    rows = df.where(df[json_col].isNotNull()).select(group.alias("g"), df[order_by].cast("long").alias("ord"), df[json_col].alias("json"))
    keys = ["g", "ord"] if by else ["ord"]
    kind = rows.schema["g"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, group, chunk = TaskContext.get().partitionId() << 32, None, None

        def out(batch_group: pa.Array) -> pa.RecordBatch:
            found = chunk.rows()
            columns = [pa.array([number] * len(found), pa.int64()), *[pa.array(c, t) for c, (_, t) in zip(zip(*found, strict=True), _STRETCH[1:], strict=True)]]
            return pa.RecordBatch.from_arrays([batch_group.take(pa.array([0] * len(found))), *columns], names=["g", *[n for n, _ in _STRETCH]])

        held = None
        for batch in batches:
            groups = batch.column(0)
            for i, (g, text) in enumerate(zip(groups.to_pylist(), batch.column(2).to_pylist(), strict=True)):
                if chunk is not None and (g != group or chunk.docs >= size):
                    yield out(held)
                    chunk, number = None, number + 1
                if chunk is None:
                    chunk, group, held = _Chunk(), g, pa.array([g], groups.type)
                try:
                    chunk.add(values.analyse(jsontext.parse(text)))
                except jsontext.Invalid as e:
                    if on_error == "fail":
                        raise ValueError(f"Invalid JSON input: {e}") from None
        if chunk is not None and chunk.docs:
            yield out(held)

    return rows.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(run, f"g {kind}, {STRETCHES}")


def _numbered(rows: DataFrame) -> DataFrame:
    """Places counted over all documents, and with each row how many its parent has."""
    counts = rows.groupBy("g", "path", "chunk").agg(F.sum("n").alias("n"))
    of_path = Window.partitionBy("g", "path")  # a row for each chunk
    before = counts.select("g", "path", "chunk", (F.sum("n").over(of_path.orderBy("chunk")) - F.col("n")).alias("before"), F.sum("n").over(of_path).alias("places"))
    parent = before.select("g", F.col("path").alias("above"), "chunk", F.col("before").alias("lo_before"), "places")
    placed = rows.join(before.drop("places"), ["g", "path", "chunk"]).join(parent, ["g", "above", "chunk"])
    return placed.select("g", "chunk", "above", "path", "kind", "nullable", "required", (F.col("lo") + F.col("lo_before")).alias("lo"), "n", (F.col("own") + F.col("before")).alias("own"), "places")


_SUMMARY = ["first", "first_own", "tail", "tail_own", "last"]


def _in_order(rows: DataFrame, keys: list[str], sums: list[Column]) -> DataFrame:
    """Summaries that follow each other as one: the first place, where the unbroken
    tail starts, and the last place."""
    listed = F.sort_array(F.collect_list(F.struct(*_SUMMARY)))
    found = rows.groupBy(*keys).agg(listed.alias("s"), *sums)

    def step(acc, x):
        joined = x["first"] <= acc["last"] + 1
        broken = x["tail"] > x["first"]
        tail = lambda name: F.when(joined & ~broken, acc[name]).otherwise(x[name]).alias(name)
        return F.struct(acc["first"].alias("first"), acc["first_own"].alias("first_own"), tail("tail"), tail("tail_own"), x["last"].alias("last"))

    one = F.aggregate(F.slice("s", 2, F.greatest(F.size("s"), F.lit(1))), F.col("s")[0], step)
    return found.withColumn("s", one).select(*[c for c in found.columns if c != "s"], *[F.col("s")[c].alias(c) for c in _SUMMARY])


def _joined(mask: Column) -> Column:
    """The joined type of a set of types."""
    bit = {k: 1 << i for i, k in enumerate(KINDS)}
    out = F.when(mask == bit["integer"] + bit["number"], "number")
    for k, b in bit.items():
        out = out.when(mask == b, k)
    return out.otherwise("mixed")


def merged_nodes(df: DataFrame, json_col: str, order_by: str, by: list[str] | None = None, on_error: str = "fail", size: int = CHUNK) -> DataFrame:
    """``(g, path, kind, nullable, required)``: the nodes of the merged schema of each
    group, ``g`` being a struct of the columns of ``by``, or 0 for all documents."""
    return merged_stretches(_kept(stretches(df, json_col, order_by, by, on_error, size)))


def merged_stretches(found: DataFrame) -> DataFrame:
    """``merged_nodes`` from the rows of ``stretches``. ``chunk`` may be of any type
    that has an order: stretches of several batches follow each other in it."""
    rows = _kept(_numbered(found))
    null = 1 << KINDS.index("null")
    sums = [F.bit_or("kind").alias("kinds"), F.bool_or("nullable").alias("nullable"), F.bool_and("required").alias("required"), F.sum("n").alias("n")]
    again = [F.bit_or("kinds").alias("kinds"), F.bool_or("nullable").alias("nullable"), F.bool_and("required").alias("required"), F.sum("n").alias("n")]
    nullable = F.col("nullable") | ((F.col("n") > 1) & (F.col("kinds").bitwiseAND(null) != 0))
    root = rows.where("path = ''").groupBy("g").agg(*sums)
    level = _kept(root.select("g", F.lit("").alias("path"), _joined(F.col("kinds")).alias("kind"), nullable.alias("nullable"), F.lit(True).alias("required"), F.lit(0).cast("long").alias("after"), F.lit(True).alias("whole")))
    found = [level]
    while True:
        # What is below counts from the parent's place after ``after`` on.
        scopes = level.where(F.col("kind").isin("object", "array") & F.col("after").isNotNull()).select("g", F.col("path").alias("above"), "after", "whole")
        few = scopes.limit(FEW + 1).count()
        if not few:
            break
        below = rows.where("path <> ''").join(F.broadcast(scopes) if few <= FEW else scopes, ["g", "above"])
        skip = F.greatest(F.col("after") + 1 - F.col("lo"), F.lit(0))
        below = below.withColumn("skip", skip).where("skip < n").select("*", (F.col("lo") + F.col("skip")).alias("first"), (F.col("own") + F.col("skip")).alias("first_own"))
        below = below.withColumn("last", F.col("lo") + F.col("n") - 1).withColumn("n", F.col("n") - F.col("skip")).withColumn("tail", F.col("first")).withColumn("tail_own", F.col("first_own"))
        keys = ["g", "above", "path", "after", "whole", "places"]
        whole = _in_order(_in_order(below, [*keys, "chunk"], sums), keys, again)
        items = F.col("path").endswith("*")
        ends, broken = F.col("last") < F.col("places"), F.col("tail") > F.col("first")
        starts = F.col("whole") & (F.col("first") == F.col("after") + 1)
        gap = ~items & (ends | broken | ~starts)
        # The place after which the next level counts; none if the property is lacking at the end.
        zero = F.lit(0).cast("long")
        after = (
            F.when(items, F.when(F.col("whole"), zero).otherwise(F.col("first_own")))
            .when(ends, None)
            .when(broken, F.col("tail_own") - 1)
            .when(~starts, F.col("first_own"))
            .otherwise(zero)
        )
        level = _kept(
            whole.select(
                "g", "path", _joined(F.col("kinds")).alias("kind"), (nullable | gap).alias("nullable"), (F.col("required") & ~gap).alias("required"), after.alias("after"),
                F.when(items, F.col("whole")).otherwise(~gap).alias("whole"),
            )
        )
        found.append(level)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.select("g", "path", "kind", "nullable", "required")


def merge(df: DataFrame, json_col: str, order_by: str, on_error: str = "fail", max_paths: int = 1_000_000) -> values.Node | None:
    """The merged schema of ``df`` in the order of ``order_by``, whole numbers
    that are unique; None for no documents. Rows whose text is null are left out.

    A schema has a node for each path, and so has the driver's memory: one of over
    ``max_paths`` is an error. ``merged_nodes`` gives nodes as rows, however many."""
    return gathered(merged_nodes(df, json_col, order_by, on_error=on_error), max_paths)


def gathered(nodes: DataFrame, max_paths: int = 1_000_000) -> values.Node | None:
    """One schema from its nodes; None for no nodes."""
    found = nodes.drop("g").limit(max_paths + 1).toArrow()
    if len(found) > max_paths:
        raise ValueError(f"the schema has over {max_paths} paths; replace keys that hold data first, or raise max_paths")
    return values.assembled(found.to_pylist())


def batch_schema(df: DataFrame, json_col: str, order_by: str, pretty: bool = False, on_error: str = "fail") -> str:
    """The merged Draft-07 schema as text; ``{}`` for no documents. Properties are
    in order of their names."""
    node = merge(df, json_col, order_by, on_error)
    return "{}" if node is None else jsontext.dump(values.draft(node), pretty)


def listed(node: values.Node | None) -> list[tuple[str, str, bool, bool]]:
    """``(path, type, nullable, required)`` of a merged schema; paths as in flattening, ``[]`` for items."""
    out: list[tuple[str, str, bool, bool]] = []

    def walk(n: values.Node, path: str, required: bool) -> None:
        out.append((path, n.kind, n.nullable, required))
        if n.kind == "object":
            for name, must, below in n.members or ():
                walk(below, f"{path}.{name}" if path else name, must)
        if n.kind == "array" and n.items:
            walk(n.items, path + "[]", True)

    if node:
        walk(node, "", True)
    return out


def spark_type(node: values.Node):
    """The Spark type to read documents of a schema with."""
    from pyspark.sql import types as T

    if node.kind == "object":
        return T.StructType([T.StructField(n, spark_type(s), not must) for n, must, s in node.members or ()])
    if node.kind == "array":
        return T.ArrayType(spark_type(node.items) if node.items else T.StringType())
    return {"boolean": T.BooleanType(), "integer": T.IntegerType(), "number": T.DoubleType(), "mixed": T.VariantType()}.get(node.kind, T.StringType())


def grouped_schemas(df: DataFrame, by: list[str], json_col: str, order_by: str) -> DataFrame:
    """The merged schema of each group: ``(by..., schema)``. A group's documents are
    spread over tasks as all documents are; a task holds a schema at a time."""
    nodes = merged_nodes(df, json_col, order_by, by)
    listed = nodes.groupBy("g").agg(F.collect_list(F.struct("path", "kind", "nullable", "required")).alias("nodes"))
    text = F.arrow_udf(lambda lists: pa.array([jsontext.dump(values.draft(values.assembled(x))) for x in lists.to_pylist()], pa.string()), "string")
    groups = df.select(F.struct(*[df[c].alias(f"k{i}") for i, c in enumerate(by)]).alias("g")).distinct()
    found = groups.join(listed.select("g", text("nodes").alias("schema")), "g", "left")
    return found.select(*[F.col(f"g.k{i}").alias(c) for i, c in enumerate(by)], F.coalesce("schema", F.lit("{}")).alias("schema"))


merged = values.merged
