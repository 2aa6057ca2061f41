"""Token ids as files: canonical length-limited Huffman codes.

Documents are encoded and dealt out by ranges of their ids, each range to a file.
Ids are counted over all files; the counts give one code for all of them, no code
longer than ``max_bits``. The bits of a file are cut into blocks of ``BLOCK`` ids
that start at recorded bit offsets, so blocks are decoded apart from each other:
a table of 2^max_bits entries gives the id and length of the code at any place,
and numpy walks through all blocks of a slice in step.

File format (little-endian): the magic and seven 64-bit numbers (code bits,
symbols, block, documents, ids, payload bytes, bytes of the code lengths); the
code lengths, one byte each, deflated; the payload; for each block its bit offset
in the payload; for each document its id, whether the id is null, and its count
of ids.

Defined results: a null text is an empty one and has the end id alone; documents
come in ascending order of id, null first, and those of one id in order of text;
an empty table gives no file; other columns are left alone, whatever their names.
Ids are those of the tokenizer's own call, so text that spells one of its added
tokens gets that token's id. Files hold about ``FILE_IDS`` ids, or one longer
document. A task that runs again writes the same file under the same name.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import file_system, slices, stored
from .units import UnitCoder, concat, cut, odd, offsets_of

MAGIC, HEADER = b"GLHUF001", "<8s7Q"
BLOCK, SLICE = 1024, 1024 * 1024
#: Units that a worker remembers; ids to a file; bytes of text to a slice.
UNITS, FILE_IDS, SLICE_BYTES = 800_000, 32 << 20, 8_000_000


class Encoder:
    """A tokenizer, and the ids of the units met so far.

    Texts with odd white space, or with the content of a token that the tokenizer
    has added to its vocabulary, are encoded whole.
    """

    made: dict[str, Encoder] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = "|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values())
        (self.newline,) = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.units = UnitCoder(self._lines, np.array([self.newline], dtype="<u4").tobytes(), UNITS)

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls.made:
            cls.made[path] = cls(path)
        return cls.made[path]

    def _lines(self, units: pa.Array) -> pa.Array:
        """Ids of units, from texts of a unit a line."""
        out = [pa.array([], pa.large_binary())]
        for k in range(0, len(units), 2000):
            (found,) = self.tokenizer.encode_batch_fast(["\n".join(units.slice(k, 2000).to_pylist())], add_special_tokens=False)
            ids = np.array([*found.ids, self.newline], dtype="<u4")
            ends = np.flatnonzero(ids == self.newline)
            out.append(cut(ids[ids != self.newline], 4 * (ends - np.arange(len(ends)))))
        return concat(*out)

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, the end id after each, and how many each has."""
        texts = pc.fill_null(texts, "")
        whole = odd(texts, self.added)
        ids, first = self.units.encode(texts.filter(pa.array(~whole)))
        # Each text's newline gives its place to the end of the text before.
        ids = ids.copy()
        ids[first] = end_id
        ids, sizes = np.append(ids[1:], np.uint32(end_id)).astype("<u4") if len(first) else ids, np.diff(np.append(first, len(ids)))
        if whole.any():
            others = [np.array([*x.ids, end_id], dtype="<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts.filter(pa.array(whole)).to_pylist(), add_special_tokens=False)]
            place = np.where(whole, len(sizes) + np.cumsum(whole) - 1, np.cumsum(~whole) - 1)
            both = concat(cut(ids, 4 * np.cumsum(sizes)), pa.array(others, pa.large_binary())).take(pa.array(place))
            offsets = offsets_of(both)
            ids, sizes = np.frombuffer(both.buffers()[2], dtype="<u4", count=int(offsets[-1]) // 4), np.diff(offsets) // 4
        return ids, sizes


def code_lengths(counts: np.ndarray, max_bits: int) -> np.ndarray:
    """Code lengths of least total for ``counts``, none over ``max_bits``; 0 for
    symbols that don't occur. By the package-merge method. Raises ValueError if
    ``max_bits`` is too small for so many symbols."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), dtype=np.uint8)
    if len(used) < 2:
        out[used] = 1
        return out
    if len(used) > 1 << max_bits:
        raise ValueError(f"{len(used)} symbols need codes of more than {max_bits} bits")
    order = used[np.lexsort((used, counts[used]))]
    leaves = counts[order].astype(np.int64)
    levels, packages = [], np.empty(0, dtype=np.int64)
    for _ in range(max_bits):
        weights = np.concatenate([leaves, packages])
        rank = np.argsort(weights, kind="stable")
        levels.append(rank < len(leaves))
        merged = weights[rank]
        packages = merged[0 : len(merged) // 2 * 2 : 2] + merged[1::2][: len(merged) // 2]
    take = 2 * (len(used) - 1)
    for is_leaf in reversed(levels):
        n = int(is_leaf[:take].sum())
        out[order[:n]] += 1
        take = 2 * (take - n)
    return out


class Code:
    """A canonical code: codes of a length follow each other in order of symbols."""

    def __init__(self, lengths: np.ndarray):
        self.lengths, self.bits = lengths, int(max(lengths.max(initial=1), 1))
        symbols = np.flatnonzero(lengths)
        symbols = symbols[np.lexsort((symbols, lengths[symbols]))]
        shares = 1 << (self.bits - lengths[symbols].astype(np.int64))
        starts = np.cumsum(shares) - shares
        self.codes = np.zeros(len(lengths), dtype=np.uint64)
        self.codes[symbols] = (starts >> (self.bits - lengths[symbols].astype(np.int64))).astype(np.uint64)
        self.symbol = np.zeros(1 << self.bits, dtype=np.uint32)
        self.symbol[: int(shares.sum())] = np.repeat(symbols, shares).astype(np.uint32)
        self.length = np.ones(1 << self.bits, dtype=np.int64)
        self.length[: int(shares.sum())] = np.repeat(lengths[symbols].astype(np.int64), shares)

    def pack(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bits of some ids, from a byte on, and the bit offsets of their blocks."""
        size = self.lengths[ids].astype(np.int64)
        at = np.cumsum(size) - size
        total = int(at[-1] + size[-1]) if len(ids) else 0
        if not total:
            return b"", np.empty(0, dtype=np.uint64)
        word = at >> 5
        wide = self.codes[ids] << (64 - (at & 31) - size).astype(np.uint64)
        words = np.zeros((total + 31) // 32 + 1, dtype=np.uint64)
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        words[word[first]] += np.add.reduceat(wide >> np.uint64(32), first)
        words[word[first] + 1] += np.add.reduceat(wide & np.uint64(0xFFFFFFFF), first)
        return words.astype(">u4").tobytes()[: (total + 7) // 8], at[::BLOCK].astype(np.uint64)

    def unpack(self, payload: np.ndarray, at: np.ndarray, count: int) -> np.ndarray:
        """The ids of blocks that start at the bits ``at`` of ``payload``; ``count`` in all."""
        b = np.concatenate([payload, np.zeros(8 + BLOCK * self.bits // 8, dtype=np.uint8)]).astype(np.uint32)
        windows = (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]
        pos, out = at.astype(np.int64), np.empty((BLOCK, len(at)), dtype=np.uint32)
        last = len(windows) - 1
        shift = np.uint32(32 - self.bits)
        for k in range(min(BLOCK, count)):
            key = (windows[np.minimum(pos >> 3, last)] << (pos & 7).astype(np.uint32)) >> shift
            out[k] = self.symbol[key]
            pos = pos + self.length[key]
        return out.T.reshape(-1)[:count]


def _write_raw(folder: str, tokenizer_path: str, end_id: int):
    """Encodes rows ``(doc, text)`` in order, into files of about ``FILE_IDS`` raw
    ids; a file ends with a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = Encoder.of(tokenizer_path)
        task, attempt, number = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId(), 0
        system, inner = file_system(folder)
        system.create_dir(inner, recursive=True)
        out, counts, docs, sizes, size = None, np.zeros(end_id + 1, dtype=np.int64), [], [], 0

        def close() -> pa.RecordBatch:
            """A file gets its name when it is whole."""
            nonlocal out, counts, docs, sizes, size, number
            out.close()
            sink.close()
            part = task << 32 | number
            system.move(f"{inner}/_raw-{task:05d}-{attempt}", f"{inner}/raw-{task:05d}-{number:05d}")
            used = np.flatnonzero(counts)
            columns = [pa.array([part]), pa.array([f"{folder}/raw-{task:05d}-{number:05d}"]), pa.array([docs], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([used], pa.list_(pa.int64())), pa.array([counts[used]], pa.list_(pa.int64()))]
            out, counts, docs, sizes, size, number = None, np.zeros(end_id + 1, dtype=np.int64), [], [], 0, number + 1
            return pa.RecordBatch.from_arrays(columns, names=["part", "path", "docs", "sizes", "symbols", "counts"])

        for batch in batches:
            for lo, hi in slices(batch.column(1), SLICE_BYTES):
                if out is None:
                    sink = system.open_output_stream(f"{inner}/_raw-{task:05d}-{attempt}", compression=None)
                    out = pa.CompressedOutputStream(sink, "zstd")
                ids, n = encoder.encode(batch.column(1).slice(lo, hi - lo), end_id)
                out.write(np.ascontiguousarray(ids))
                some = np.bincount(ids)
                if len(some) > len(counts):
                    counts = np.concatenate([counts, np.zeros(len(some) - len(counts), dtype=np.int64)])
                counts[: len(some)] += some
                docs += batch.column(0).slice(lo, hi - lo).to_pylist()
                sizes += n.tolist()
                size += len(ids)
                if size >= FILE_IDS:
                    yield close()
        if out is not None:
            yield close()

    return run


def _exactly(stream, size: int) -> bytes:
    """``size`` bytes, fewer only at the stream's end."""
    got = []
    while size and (piece := stream.read(size)):
        got.append(piece)
        size -= len(piece)
    return b"".join(got)


def _write_coded(folder: str, lengths: np.ndarray):
    """Turns a file of raw ids into a file of coded ones."""
    book = zlib.compress(lengths.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        code = Code(lengths)
        attempt = TaskContext.get().taskAttemptId()
        system, inner = file_system(folder)
        for batch in batches:
            for part, path, docs, sizes in zip(*[batch.column(c).to_pylist() for c in ("part", "path", "docs", "sizes")], strict=True):
                name, final = f"{inner}/_ids-{part:013x}-{attempt}", f"ids-{part:013x}.huf"
                packed, at, payload = [], [], 0
                with system.open_input_stream(file_system(path)[1], compression=None) as raw:
                    ids = pa.CompressedInputStream(raw, "zstd")
                    while data := _exactly(ids, 4 * SLICE):  # whole slices but for the last, so blocks never straddle them
                        bits, offsets = code.pack(np.frombuffer(data, dtype="<u4"))
                        packed.append(bits)
                        at.append(offsets + np.uint64(8 * payload))
                        payload += len(bits)
                header = struct.pack(HEADER, MAGIC, code.bits, len(lengths), BLOCK, len(docs), sum(sizes), payload, len(book))
                tail = np.concatenate(at).astype("<u8").tobytes() + np.array([d or 0 for d in docs], dtype="<i8").tobytes() + np.array([d is None for d in docs], dtype=np.uint8).tobytes() + np.array(sizes, dtype="<u8").tobytes()
                with system.open_output_stream(name, compression=None) as out:
                    out.write(header + book)
                    for bits in packed:
                        out.write(bits)
                    out.write(tail)
                system.move(name, f"{inner}/{final}")
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (part, f"{folder}/{final}", len(docs), sum(sizes), len(header + book) + payload + len(tail))], names=["part", "path", "n_docs", "n_ids", "bytes"])

    return run


def _summed(raw: DataFrame, end_id: int) -> np.ndarray:
    """How often each id occurs in all raw files. Tasks add up what their rows
    hold, in spans of ids; the driver gets one number for each id of the vocabulary."""
    span = 4096

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            symbols, counts = (c.flatten().to_numpy() for c in batch.columns)
            some = np.bincount(symbols, minlength=len(total)).astype(np.int64) * 0
            np.add.at(some, symbols, counts)
            some[: len(total)] += total
            total = some
        for k in range(0, len(total), span):
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([total[k : k + span]], pa.list_(pa.int64()))], names=["first", "counts"])

    def merge(table: pa.Table) -> pa.Table:
        rows = [r.values.to_numpy() for r in table.column("counts")]
        total = np.zeros(max(map(len, rows)), dtype=np.int64)
        for r in rows:
            total[: len(r)] += r
        return pa.table({"first": [table.column("first")[0].as_py()], "counts": pa.array([total], pa.list_(pa.int64()))})

    kind = "first long, counts array<long>"
    rows = raw.select("symbols", "counts").mapInArrow(add, kind).groupBy("first").applyInArrow(merge, kind).collect()
    out = np.zeros(max([end_id + 1, *[r[0] + len(r[1]) for r in rows]]), dtype=np.int64)
    for first, counts in rows:
        out[first : first + len(counts)] += np.array(counts)
    return out


def write(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, max_bits: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode ``docs`` and write their ids below ``folder``; returns the files:
    ``(part, path, n_docs, n_ids, bytes, first_id)``, ``first_id`` being the
    number of ids in the files before. ``max_bits`` has to hold the different ids,
    else a ValueError tells so."""
    rows = docs.select(docs[id_col].cast("long").alias("doc"), docs[text_col].alias("text")).repartitionByRange("doc").sortWithinPartitions("doc", "text")
    raw = stored(rows.mapInArrow(_write_raw(folder, tokenizer_path, end_id), "part long, path string, docs array<long>, sizes array<long>, symbols array<long>, counts array<long>"), "raw-files")
    counts = _summed(raw, end_id)
    lengths = code_lengths(counts, max_bits)
    parts = raw.select("part", "path", "docs", "sizes")
    files = parts.repartition(max(1, parts.count())).mapInArrow(_write_coded(folder, lengths), "part long, path string, n_docs long, n_ids long, bytes long")
    files = stored(files, "id-files")
    for r in raw.select("path").toLocalIterator():  # the raw files have done their work
        system, inner = file_system(r[0])
        system.delete_file(inner)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("first_id", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def open_file(stream) -> tuple[Code, dict]:
    """The code and the tables of a file, which is read whole."""
    data = stream.read()
    magic, bits, symbols, block, docs, ids, payload, book = struct.unpack_from(HEADER, data)
    if magic != MAGIC or block != BLOCK:
        raise ValueError("not a file of coded ids")
    at = struct.calcsize(HEADER)
    code = Code(np.frombuffer(zlib.decompress(data[at : at + book]), dtype=np.uint8))
    at += book
    blocks = -(-ids // BLOCK)
    fields = {"ids": ids, "payload": np.frombuffer(data, np.uint8, payload, at)}
    at += payload
    for name, kind, n in (("offsets", "<u8", blocks), ("docs", "<i8", docs), ("null", "u1", docs), ("sizes", "<u8", docs)):
        fields[name] = np.frombuffer(data, kind, n, at)
        at += fields[name].nbytes
    return code, fields


def ids_from(code: Code, fields: dict, first_block: int, blocks: int) -> np.ndarray:
    """The ids of some blocks of an opened file."""
    at = fields["offsets"][first_block : first_block + blocks].astype(np.int64)
    end = fields["offsets"][first_block + blocks] if first_block + blocks < len(fields["offsets"]) else 8 * len(fields["payload"])
    base = int(at[0]) >> 3
    count = min(blocks * BLOCK, fields["ids"] - first_block * BLOCK)
    return code.unpack(fields["payload"][base : (int(end) + 7) >> 3], at - 8 * base, count)


def read(files: DataFrame) -> DataFrame:
    """``(doc, start, n_tokens, ids)`` of every document of ``files``: ``start``
    counts the ids of all documents before it, ``ids`` are little-endian unsigned
    32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, start in (x for b in batches for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
            system, inner = file_system(path)
            with system.open_input_stream(inner, compression=None) as stream:
                code, fields = open_file(stream)
            sizes, left, doc = fields["sizes"].astype(np.int64), b"", 0
            for k in range(0, len(fields["offsets"]), SLICE // BLOCK):
                left += ids_from(code, fields, k, SLICE // BLOCK).astype("<u4").tobytes()
                ends = np.cumsum(sizes[doc:]) * 4
                n = int(np.searchsorted(ends, len(left), "right"))
                if not n:
                    continue
                cuts = np.concatenate([[0], ends[:n]])
                ids = [left[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                docs = pa.array(fields["docs"][doc : doc + n], mask=fields["null"][doc : doc + n].astype(bool))
                yield pa.RecordBatch.from_arrays([docs, pa.array(start + cuts[:-1] // 4), pa.array(sizes[doc : doc + n]), pa.array(ids, pa.binary())], names=["doc", "start", "n_tokens", "ids"])
                left, doc, start = left[int(cuts[-1]) :], doc + n, start + int(cuts[-1]) // 4

    paths = files.select("path", "first_id")
    return paths.repartition(max(1, paths.count())).mapInArrow(run, "doc long, start long, n_tokens long, ids binary")
