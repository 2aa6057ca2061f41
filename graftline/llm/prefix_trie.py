"""The trie of conversations' prefixes, found from its deepest nodes up.

A node is a sequence of turns that some conversation starts with. Nodes of a depth are
known once those below are: the conversations that end at the depth join the nodes that
survive from the depth below, each stripped of its last turn, and all are grouped anew
by what is left. The grouping sums up members, children, leaves and tokens while it
finds the nodes, so each node is made once and nothing is looked up downwards. Equal
conversations become one row before anything else; sums and minima are aggregated
before every shuffle, so a first turn that a third of all conversations share is a
partial sum in each task.

Down to ``depth`` turns each level is a Spark grouping, stored before the next one.
What lies deeper hangs below a node of that depth, and is peeled the same way for each
such node in a task of its own, if no node has more than ``most`` turns below it;
otherwise ``depth`` is doubled first. So long conversations cost no job a turn, and no
task holds more than ``most`` turns.

A turn is known by a 128-bit digest of role and text, and a node by a 128-bit digest
of its parent's and its last turn's.

Defined results: turns are in order of their number, null first, and those of one number
in order of their digests; a null role or text is empty, and so no different from an
empty one; turns without a conversation's id belong to none and are left out; other
columns are left alone, whatever their names; an empty table has no conversations and
gives no node. A conversation's digests, 16 bytes a turn, are held by one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, words

#: Levels that are grouped by Spark at least, and turns that one task peels at most.
DEPTH, MOST = 8, 500_000
#: Conversations' ids to a piece of a node's list.
PIECE = 65_536
PATH = "array<struct<key:string,words:bigint>>"
_PATH = pa.list_(pa.struct([("key", pa.string()), ("words", pa.int64())]))
#: What is known of a node: its members' smallest id and number, children, leaves below, tokens saved below.
KNOWN = ["conv", "n_convs", "n_children", "n_leaves", "saved"]


def conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv, turns)``: each conversation's turns in order, as digests and words."""
    role, text = (F.coalesce(turns[c], F.lit("")) for c in (role_col, text_col))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    rows = turns.where(turns[conv_col].isNotNull()).select(turns[conv_col].alias("conv"), F.struct(turns[turn_col].alias("turn"), digest.alias("digest"), F.size(words(text)).cast("long").alias("words")).alias("t"))
    ordered = F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words")))
    return rows.groupBy("conv").agg(ordered.alias("turns"))


def with_shared_starts(convs: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """Conversation c starts with the first h turns of conversation c - c mod ``every``,
    h being the CRC-32 of c modulo ``most``; its own turns follow after its first h."""
    h = (F.crc32(F.col("conv").cast("string")) % most).cast("int")
    starts = convs.where(F.col("conv") % every == 0).select(F.col("conv").alias("base"), F.slice("turns", 1, most - 1).alias("start"))
    rows = convs.select("conv", "turns", h.alias("h"), (F.col("conv") - F.col("conv") % every).alias("base")).join(starts, "base", "left")
    start = F.slice(F.coalesce("start", F.slice("turns", 1, 0)), F.lit(1), F.col("h"))
    own = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return rows.select("conv", F.concat(start, own).alias("turns"))


def _paths(turns: Column) -> Column:
    """The nodes on the way to a conversation's end, the root first: for each its key
    and its last turn's words."""

    def chained(lists: pa.Array) -> pa.Array:
        out = []
        for turns in lists.to_pylist():
            key = ""
            path = [{"key": key, "words": 0}]
            for t in turns:
                key = hashlib.md5((key + t["digest"]).encode()).hexdigest()
                path.append({"key": key, "words": t["words"]})
            out.append(path)
        return pa.array(out, _PATH)

    return F.arrow_udf(chained, PATH)(turns)


def _peeled(depth: int, paths: list[list[dict]], convs: list[int], counts: list[int]) -> tuple[list[tuple], dict]:
    """The nodes below a node of ``depth`` turns, deepest first, and what those right
    below it sum up to."""
    ending: dict[int, list[int]] = {}
    for i, path in enumerate(paths):
        ending.setdefault(len(path) - 1, []).append(i)
    level: dict[str, list] = {}  # key: a path through the node, and what is known
    out = []
    for d in range(max(ending), depth - 1, -1):
        above: dict[str, list] = {}
        for path, known in level.values():
            conv, n, children, leaves, saved = known
            out.append((path[d + 1]["key"], path[d]["key"], d + 1, *known))
            node = above.setdefault(path[d]["key"], [path, [conv, 0, 0, 0, 0]])
            node[1] = [min(node[1][0], conv), node[1][1] + n, node[1][2] + 1, node[1][3] + leaves, node[1][4] + saved]
        if d == depth:
            ((_, known),) = above.values()
            return out, dict(zip(KNOWN, known, strict=True))
        for i in ending.get(d, ()):
            node = above.setdefault(paths[i][d]["key"], [paths[i], [convs[i], 0, 0, 0, 0]])
            node[1][0], node[1][1] = min(node[1][0], convs[i]), node[1][1] + counts[i]
        for path, known in above.values():
            known[3] = known[3] or 1
            known[4] += (known[1] - 1) * path[d]["words"]
        level = above
    raise AssertionError("no level is left")


def _below(deep: DataFrame, depth: int) -> DataFrame:
    """The nodes below ``depth``, and the rows (``depth`` -1) that their tops add up to."""
    kind = deep.schema["conv"].dataType.simpleString()
    fields = f"key string, parent string, depth int, conv {kind}, n_convs bigint, n_children bigint, n_leaves bigint, saved bigint, path {PATH}"

    def run(group: pa.Table) -> pa.Table:
        paths = group.column("path").to_pylist()
        nodes, top = _peeled(depth, paths, group.column("conv").to_pylist(), group.column("n_convs").to_pylist())
        head = paths[0][: depth + 1]
        rows = [(*n, None) for n in nodes] + [(head[-1]["key"], None, -1, *top.values(), head)]
        types = [pa.string(), pa.string(), pa.int32(), group.schema.field("conv").type, *[pa.int64()] * 4, _PATH]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["key", "parent", "depth", *KNOWN, "path"])

    return deep.withColumn("top", F.col("path")[depth]["key"]).groupBy("top").applyInArrow(run, fields)


def nodes(convs: DataFrame, depth: int = DEPTH, most: int = MOST) -> DataFrame:
    """``(key, parent, depth, conv, n_convs, n_children, n_leaves, saved)`` of every
    node of the trie of ``convs``, ``(conv, turns)``. Nodes' names are their keys."""
    paths = convs.select("conv", _paths(F.col("turns")).alias("path"))
    ends = paths.groupBy(F.element_at("path", -1)["key"].alias("key")).agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs"), F.first("path").alias("path"))
    ends = stored(ends.select("conv", "n_convs", "path", (F.size("path") - 1).alias("depth")), "ends")
    deepest = ends.agg(F.max("depth")).first()[0]
    if deepest is None:
        deepest = -1
    while depth < deepest:
        below = ends.where(F.col("depth") > depth).groupBy(F.col("path")[depth]["key"]).agg(F.sum(F.col("depth") - depth).alias("n"))
        if below.agg(F.max("n")).first()[0] <= most:
            break
        depth *= 2
    found, level = [], None
    none = F.lit(0).cast("long")
    if depth < deepest:
        deep = stored(_below(ends.where(F.col("depth") > depth), depth), "deep")
        found.append(deep.where("depth >= 0").drop("path"))
        level = deep.where("depth < 0").drop("depth")
    for d in range(min(depth, deepest), -1, -1):
        rows = ends.where(F.col("depth") == d).select("conv", "n_convs", none.alias("n_children"), none.alias("n_leaves"), none.alias("saved"), "path")
        if level is not None:
            rows = rows.unionByName(level.select(*KNOWN, "path"))
        sums = [F.min("conv").alias("conv"), *[F.sum(c).alias(c) for c in KNOWN[1:]], F.first("path").alias("path")]
        grouped = rows.withColumn("key", F.col("path")[d]["key"]).groupBy("key").agg(*sums)
        last = F.col("path")[d]["words"] if d else none
        parent = F.col("path")[d - 1]["key"] if d else F.lit(None).cast("string")
        made = grouped.select("key", parent.alias("parent"), F.lit(d).alias("depth"), "conv", "n_convs", "n_children", F.greatest("n_leaves", F.lit(1)).alias("n_leaves"), (F.col("saved") + (F.col("n_convs") - 1) * last).alias("saved"), F.slice("path", 1, max(d, 1)).alias("path"))
        made = stored(made, f"level-{d}")
        found.append(made.drop("path"))
        # Stripped of the last turn; each row is a child of what it will be grouped to.
        level = made.withColumn("n_children", F.lit(1).cast("long"))
    if not found:
        kind = convs.schema["conv"].dataType.simpleString()
        return convs.sparkSession.createDataFrame([], f"key string, parent string, depth int, conv {kind}, n_convs bigint, n_children bigint, n_leaves bigint, saved bigint")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def ends(convs: DataFrame) -> DataFrame:
    """``(key, ends_sha256)``: of each node at which conversations end, the digest of
    their ids, ascending, with commas between them.

    Ids are sorted and joined in pieces of a range of ``PIECE`` ids. A digest has to be
    taken in order, so a node's pieces reach one task, sorted, and are read one by one."""
    keyed = convs.select("conv", F.element_at(_paths(F.col("turns")), -1)["key"].alias("key"))
    pieces = keyed.groupBy("key", F.floor(F.col("conv") / PIECE).alias("piece")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, digest = None, None
        for batch in batches:
            done = []
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if key == last:
                    digest.update(b",")
                else:
                    if last is not None:
                        done.append((last, digest.hexdigest()))
                    last, digest = key, hashlib.sha256()
                digest.update(ids.encode())
            yield _named(done)
        yield _named([(last, digest.hexdigest())] if last is not None else [])

    return pieces.repartition("key").sortWithinPartitions("key", "piece").select("key", "ids").mapInArrow(digested, "key string, ends_sha256 string")


def _named(rows: list[tuple[str, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], names=["key", "ends_sha256"])


def trie(convs: DataFrame, depth: int = DEPTH, most: int = MOST) -> DataFrame:
    """Every node by its smallest member and depth: ``(conv, depth, parent, n_convs,
    n_children, n_leaves, saved, ends_sha256)``, ``parent`` being the parent's ``conv``."""
    convs = stored(convs, "conversations")
    found = nodes(convs, depth, most)
    parents = found.where("n_children > 0").select(F.col("key").alias("parent"), F.col("conv").alias("parent_conv"))
    out = found.join(parents, ["parent"], "left").join(ends(convs), "key", "left")
    return out.select("conv", "depth", F.col("parent_conv").alias("parent"), "n_convs", "n_children", "n_leaves", "saved", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
