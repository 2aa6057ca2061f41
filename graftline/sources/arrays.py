"""Files that are one large JSON array, read by many tasks.

Spark's text reader cuts a file into blocks and each block at its commas, so no task
reads a file whole. What a piece of text means depends on what stands before it: whether
a string is open there, and how deep it lies. A first pass gives, for each block, its
quotes, how its brackets move the depth, and its commas by depth, for both cases of a
string that is or isn't open where it starts. Sums over the blocks before give every
block its start and the position of its first item. A second pass then gives out the
items that lie in a block, and a third one the pieces of items that reach over a block's
edge; only these are grouped.

A file that isn't an array is its own only item; an array without an end is an error.
What follows the array is ignored, as it is after any document. Items are the text as
it stands, without blanks around it; that an item is JSON is for whoever parses it to
find out. An empty file, and an empty array, have no item.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_BLOCKS = "file string, block bigint, quotes bigint, first string, closes boolean, moves array<bigint>, least array<bigint>, commas array<array<bigint>>"
_ITEMS = "file string, position bigint, block bigint, last boolean, json string"


def _marks(text: bytes, in_string: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """The places of brackets and commas outside strings, what each does to the depth,
    and whether a string is open at the end. A piece starts after a comma, so it never
    starts within an escape."""
    data = np.frombuffer(text, dtype=np.uint8)
    quote = np.flatnonzero(data == 0x22)
    if len(quote) and 0x5C in text:
        # A quote is a string's own if an odd number of backslashes is before it.
        plain = np.flatnonzero(data != 0x5C)
        before = np.searchsorted(plain, quote)
        last = np.where(before > 0, plain[np.maximum(before - 1, 0)], -1)
        quote = quote[(quote - last) % 2 == 1]
    mark = np.flatnonzero((data == 0x5B) | (data == 0x7B) | (data == 0x5D) | (data == 0x7D) | (data == 0x2C))
    outside = (np.searchsorted(quote, mark) + in_string) % 2 == 0
    mark = mark[outside]
    kind = data[mark]
    return mark, np.where(kind == 0x2C, 0, np.where((kind == 0x5B) | (kind == 0x7B), 1, -1)), bool((len(quote) + in_string) % 2)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, list, bytes]]:
    """Runs of rows of one block: file, block, further columns of the first row, and the text."""
    for batch in batches:
        files, blocks = batch.column(0), batch.column(1)
        at = blocks.to_numpy(zero_copy_only=False)
        coded = files.dictionary_encode().indices.to_numpy()
        edges = [0, *(np.flatnonzero((np.diff(at) != 0) | (np.diff(coded) != 0)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(edges, edges[1:], strict=False):
            if hi > lo:
                pieces = batch.column(2).slice(lo, hi - lo).to_pylist()
                rest = [batch.column(c)[lo].as_py() for c in range(3, batch.num_columns)]
                yield files[lo].as_py(), int(at[lo]), rest, (",".join(pieces) + ",").encode()


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each block's text does, outside and inside a string at its start."""
    state: dict[tuple[str, int], dict] = {}
    for file, block, _, text in _batches(batches):
        known = state.setdefault((file, block), {"open": [False, True], "moves": [0, 0], "least": [0, 0], "commas": [{}, {}], "first": "", "closes": False})
        for start in (0, 1):
            _, moves, known["open"][start] = _marks(text, known["open"][start])
            if len(moves):
                depth = known["moves"][start] + np.cumsum(moves)
                for d, n in zip(*(x.tolist() for x in np.unique(depth[(moves == 0) & (depth <= 1)], return_counts=True)), strict=True):
                    known["commas"][start][1 - d] = known["commas"][start].get(1 - d, 0) + n
                known["closes"] |= start == 0 and bool(((moves == -1) & (depth == 0)).any())
                known["least"][start], known["moves"][start] = min(known["least"][start], int(depth.min())), int(depth[-1])
        known["first"] = known["first"] or text.decode(errors="replace").lstrip("\ufeff \t\r\n")[:1]
    rows = [(f, b, int(k["open"][0]), k["first"], k["closes"], k["moves"], k["least"], [[c.get(i, 0) for i in range(2 - min(0, least))] for c, least in zip(k["commas"], k["least"], strict=True)]) for (f, b), k in state.items()]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), *[pa.list_(pa.int64())] * 2, pa.list_(pa.list_(pa.int64()))]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["file", "block", "quotes", "first", "closes", "moves", "least", "commas"])


class _Block:
    """Items of a block whose start is known."""

    def __init__(self, file: str, block: int, array: bool, in_string: bool, depth: int, position: int):
        self.file, self.block, self.array, self.in_string, self.depth, self.position = file, block, array, in_string, depth, position
        self.held, self.edge, self.closed = [], depth > 0 or not array, False

    def _row(self, last: bool) -> tuple:
        text = b"".join(self.held).decode(errors="replace")
        self.held = []
        return self.file, self.position, self.block, last, text

    def add(self, text: bytes) -> Iterator[tuple[bool, tuple]]:
        """Items that end in the text, and whether they started before the block."""
        if not self.array:
            self.held.append(text)
        if self.closed or not self.array:
            return
        mark, moves, self.in_string = _marks(text, self.in_string)
        depth = self.depth + np.cumsum(moves)
        begin = 0
        if self.depth == 0:
            opens = np.flatnonzero((moves == 1) & (depth == 1))
            if not len(opens):
                return
            begin = int(mark[opens[0]]) + 1
        for c in np.flatnonzero(((moves == 0) & (depth == 1)) | ((moves == -1) & (depth == 0))).tolist():
            end = int(mark[c])
            if end < begin:
                continue
            self.held.append(text[begin:end])
            self.closed = bool(depth[c] == 0)
            yield self.edge, self._row(self.closed)
            begin, self.position, self.edge = end + 1, self.position + 1, False
            if self.closed:
                return
        self.held.append(text[begin:])
        self.depth = int(depth[-1]) if len(depth) else self.depth

    def rest(self) -> Iterator[tuple[bool, tuple]]:
        """What goes on in the next block."""
        if not self.closed and (self.depth > 0 or not self.array):
            yield True, self._row(False)


def _items(edges: bool):
    """Items that lie in a block, or the pieces at its edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: _Block | None = None
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]

        def out(found) -> pa.RecordBatch:
            rows = [row for edge, row in found if edge == edges]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["file", "position", "block", "last", "json"])

        for file, number, start, text in _batches(batches):
            if block is None or (block.file, block.block) != (file, number):
                if block:
                    yield out(block.rest())
                block = _Block(file, number, *start)
            yield out(block.add(text))
        if block:
            yield out(block.rest())

    return run


def array_items(spark: SparkSession, path: str) -> DataFrame:
    """``(file, position, json)``: the items of files that are JSON arrays."""
    pieces = spark.read.text(path, lineSep=",").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("text"))
    blocks = pieces.mapInArrow(_summaries, _BLOCKS).persist()  # a row for each block
    file = Window.partitionBy("file").orderBy("block")
    before = file.rowsBetween(Window.unboundedPreceding, -1)
    sum_before = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    starts = blocks.withColumn("array", F.first("first").over(file) == "[").withColumn("in_string", sum_before("quotes") % 2 == 1)
    case = F.col("in_string").cast("int")
    starts = starts.withColumn("depth", sum_before(F.get("moves", case)))
    starts = starts.withColumn("closes", F.when(F.col("block") == 0, F.col("closes")).otherwise(F.col("depth") + F.get("least", case) <= 0))
    starts = starts.withColumn("position", sum_before(F.coalesce(F.get(F.get("commas", case), F.col("depth").cast("int")), F.lit(0))))
    starts = starts.withColumn("over", sum_before(F.col("closes").cast("int")) > 0)
    endless = starts.where("array").groupBy("file").agg(F.bool_or("closes").alias("closes")).where("not closes").first()
    if endless:
        raise ValueError(f"{endless['file']}: array without an end")
    known = starts.where("not array or not over").select("file", "block", "array", "in_string", "depth", F.when(F.col("array"), F.col("position")).otherwise(0).alias("position"))
    # 100 TB are under a million blocks of 128 MB, some 100 bytes each.
    rows = pieces.join(F.broadcast(known), ["file", "block"]).select("file", "block", "text", "array", "in_string", "depth", "position")
    whole = rows.mapInArrow(_items(False), _ITEMS)
    edges = rows.mapInArrow(_items(True), _ITEMS).groupBy("file", "position")
    joined = edges.agg(F.max("block").alias("block"), F.bool_or("last").alias("last"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "json"))), lambda x: x["json"]), "").alias("json"))
    # A file that isn't an array has a comma too many, from its last piece.
    joined = joined.join(F.broadcast(known.where("not array").select("file", F.lit(True).alias("single")).distinct()), "file", "left")
    joined = joined.withColumn("json", F.when(F.col("single"), F.regexp_replace("json", ",\\z", "")).otherwise(F.col("json"))).drop("single")
    blank = F.regexp_replace("json", r"^[\x00-\x20]+|[\x00-\x20]+\z", "")
    items = whole.unionByName(joined.select(*whole.columns)).select("file", "position", "last", blank.alias("json"))
    return items.where(~((F.col("json") == "") & F.col("last") & (F.col("position") == 0))).select("file", "position", "json")
