"""Byte-level BPE in DuckDB, one embedded database per Python worker.

Spark deals out the documents; in each task the pattern splits texts into words,
and words that the worker hasn't met go through a recursive query. Its rows are a
token, its place in the word, and the token and place that follow. Each turn joins
them with the merge table and contracts the leftmost pair of least rank in every
word; words of which no pair is in the table are put out and leave the recursion.
Decoding joins ids with the vocabulary and aggregates the bytes in order, those
of each different run of ids in a slice once.

A rank file has a line for each token: its bytes in base64, and its id, which is
its rank as well. A pair may merge if its joined bytes are a token. A word that
is a token is that token.

A word of over ``WINDOW`` bytes is cut into overlapping windows. Where the tokens
of two windows have a boundary and the token after it in common, one may be
followed by the other: a sequence of tokens is the word's encoding if every two
neighbours are the encoding of their joined bytes, and each of these pairs stands
in the encoding of a window. Windows that don't meet so are taken again from a
boundary of the last one, and made longer if need be, so the ids are exact.

Defined results: a null text is an empty one and has no ids; null ids, and ids
that aren't in the vocabulary, decode to no bytes; other columns are left alone,
whatever their names; repeated rows are encoded each; an empty table gives an
empty result. Texts and ids are worked on in slices of bounded size, and the
memory of met units is bounded by ``UNITS``.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, slices
from .units import UnitCoder, concat, cut, odd, offsets_of

#: Units that a worker remembers; words to a query; bytes of text and ids to a slice;
#: ids to a row of the decoding query.
UNITS, QUERY_WORDS, SLICE_BYTES, SLICE_IDS, BLOCK = 600_000, 50_000, 8_000_000, 2_000_000, 2048
#: Bytes of the words that are encoded at once, and of those that go to a query of
#: their own for its many turns; windows start every ``STEP`` bytes.
WINDOW, SHORT, STEP = 128, 40, 64
#: Ids to a run at most.
RUN = 64

ENCODE = """
with recursive step(word, pos, token, next, next_pos, done) as (
    select word, pos, token, next, next_pos, false from start
    union all
    (with least as (
        select s.word, min((m.merged::bigint << 46) | (s.pos::bigint << 23) | s.next_pos) as pair
        from step s join merges m on m.l = s.token and m.r = s.next where not s.done group by s.word
    ), best as (
        select word, (pair >> 46)::int as merged, ((pair >> 23) & 8388607)::int as l, (pair & 8388607)::int as r from least
    )
    select s.word, s.pos, case when s.pos = b.r then b.merged else s.token end,
           case when s.next_pos = b.l then b.merged else s.next end,
           case when s.next_pos = b.l then b.r else s.next_pos end, b.word is null
    from step s left join best b on s.word = b.word
    where not s.done and (b.word is null or s.pos <> b.l))
)
select word, token from step where done order by word, pos
"""

DECODE = """
select pos // {block} as block, list(v.bytes order by pos) as bytes
from incoming join vocabulary v using (id) group by block order by block
"""


def _points(text: str) -> np.ndarray:
    return np.unique(np.frombuffer(text.encode("utf-32-le"), dtype="<u4"))


def _ranges(points: np.ndarray) -> str:
    """Code points, ascending, as the ranges of a character class."""
    edges = np.flatnonzero(np.diff(points) > 1)
    first, last = points[np.concatenate([[0], edges + 1])], points[np.append(edges, len(points) - 1)]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(first.tolist(), last.tolist(), strict=True))


def as_the_library(pattern: str) -> tuple[str, np.ndarray]:
    """The pattern with classes of characters as the library has them, and its letters.

    The two expression engines know different versions of Unicode. What belongs to a
    class is read off the library: with the class as its pattern, and bytes as its
    tokens, it gives the bytes of just these characters."""
    import regex
    import tiktoken

    text = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    letters = None
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        library = tiktoken.Encoding("characters", pat_str=name, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        true = _points(bytes(library.encode_ordinary(text)).decode())
        own = _points("".join(regex.findall(f"{name}+", text)))
        letters = true if letters is None else letters
        more, less = np.setdiff1d(true, own), np.setdiff1d(own, true)
        inner = name + (f"||[{_ranges(more)}]" if len(more) else "")
        inner = f"[{inner}]--[{_ranges(less)}]" if len(less) else inner
        pattern = pattern.replace(name, f"[{inner}]")
        if name == r"\s":
            pattern = pattern.replace(r"\S", f"[^{inner}]")
    return f"(?V1){pattern}", letters


class Coder:
    """The tables of one rank file, and the units met so far."""

    made: dict[str, Coder] = {}

    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "250MB", "temp_directory": ""})
        self._table("vocabulary", pa.table({"id": pa.array(ranks.values(), pa.int32()), "bytes": pa.array(ranks, pa.binary())}))
        pattern, letters = as_the_library(pattern)
        self.pattern, self.tokens, self.ranks = regex.compile(pattern), pa.array(ranks, pa.binary()), np.array(list(ranks.values()))
        # Arrow's letters tell single words apart, if the library takes all of them for letters.
        every = pa.array(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        known = np.isin(_points("".join(every.filter(pc.match_substring_regex(every, r"\pL")).to_pylist())), letters).all()
        self.single_word = r"^ ?\pL+$" if known else "^ ?[A-Za-z]+$"
        self.single = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        splits = np.fromiter((x for t, rank in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks for x in (ranks[t[:k]], ranks[t[k:]], rank)), dtype=np.int32).reshape(-1, 3)
        self._table("merges", pa.table({"l": splits[:, 0].copy(), "r": splits[:, 1].copy(), "merged": splits[:, 2].copy()}))
        top = max(ranks.values()) + 1
        self.size, self.opens = np.zeros(top + 1, dtype=np.int64), np.zeros(top + 1, dtype=bool)  # the last for ids that aren't in the table
        for token, rank in ranks.items():
            self.size[rank], self.opens[rank] = len(token), token[:1] in (b" ", b"\n")
        self.units = UnitCoder(self.code, self.single[10:11].astype("<u4").tobytes(), UNITS)

    @classmethod
    def of(cls, path: str, pattern: str) -> Coder:
        if path not in cls.made:
            cls.made[path] = cls(path, pattern)
            give_back()
        return cls.made[path]

    def _table(self, name: str, rows: pa.Table) -> None:
        self.db.register("incoming", rows)
        self.db.execute(f"create or replace table {name} as select * from incoming")
        self.db.unregister("incoming")

    def code(self, texts: pa.Array) -> pa.Array:
        """The ids of texts, which the pattern splits into words."""
        single = pc.match_substring_regex(texts, self.single_word)
        alone = texts.filter(single).dictionary_encode()
        split = [self.pattern.findall(t) for t in texts.filter(pc.invert(single)).to_pylist()]
        words = list({w for ws in split for w in ws})
        found = self.learn(concat(alone.dictionary, pa.array(words, pa.string())))
        known = dict(zip(words, found.slice(len(alone.dictionary)).to_pylist(), strict=True))
        joined = pa.array([b"".join(map(known.__getitem__, ws)) for ws in split], pa.large_binary())
        first = single.to_numpy(zero_copy_only=False)
        place = np.where(first, np.cumsum(first) - 1, len(alone) + np.cumsum(~first) - 1)
        return concat(found.take(alone.indices), joined).take(pa.array(place))

    def learn(self, words: pa.Array) -> pa.Array:
        """The ids of words, 4 little-endian bytes each."""
        words = words.cast(pa.binary())
        at = pc.index_in(words, value_set=self.tokens)
        size = pc.binary_length(words).to_numpy()
        token = at.is_valid().to_numpy(zero_copy_only=False)
        groups = [np.flatnonzero(x) for x in (token, ~token & (size <= SHORT), ~token & (size > SHORT) & (size <= WINDOW), ~token & (size > WINDOW))]
        ids = self.ranks[at.drop_null().to_numpy()].astype("<u4")
        parts = [cut(ids, 4 * np.arange(1, len(ids) + 1)), *[self._merged(words.take(pa.array(g))) for g in groups[1:3]], pa.array([self._long(w) for w in words.take(pa.array(groups[3])).to_pylist()], pa.large_binary())]
        place = np.empty(len(words), dtype=np.int64)
        place[np.concatenate(groups)] = np.arange(len(words))
        return concat(*parts).take(pa.array(place))

    def _merged(self, words: pa.Array) -> pa.Array:
        """The ids that the recursive query gives for words of less than 8 million bytes."""
        out = [pa.array([], pa.large_binary())]
        for k in range(0, len(words), QUERY_WORDS):
            part = words.slice(k, QUERY_WORDS)
            offsets = offsets_of(part)
            sizes, ends = np.diff(offsets), offsets[1:] - offsets[0]
            token = self.single[np.frombuffer(part.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]]
            pos = np.arange(len(token), dtype=np.int32) - np.repeat(ends - sizes, sizes).astype(np.int32)
            after = np.append(token[1:], np.int32(-1))
            after[ends - 1] = -1
            rows = pa.table({"word": np.repeat(np.arange(len(part), dtype=np.int32), sizes), "pos": pos, "token": token, "next": after, "next_pos": pos + np.int32(1)})
            self.db.register("start", rows)
            found = self.db.sql(ENCODE).to_arrow_table()
            self.db.unregister("start")
            out.append(cut(found.column("token").to_numpy().astype("<u4"), 4 * np.cumsum(np.bincount(found.column("word").to_numpy(), minlength=len(part)))))
        return concat(*out)

    def _long(self, word: bytes) -> bytes:
        """The ids of a word of any length, from windows of it."""
        known: dict[bytes, np.ndarray] = {}
        places = range(0, len(word) - STEP, STEP)
        pieces = list({word[k : k + WINDOW] for k in places})
        for lo in range(0, len(pieces), 4000):
            some = pieces[lo : lo + 4000]
            known |= {w: np.frombuffer(x, dtype="<u4") for w, x in zip(some, self._merged(pa.array(some, pa.binary())).to_pylist(), strict=True)}

        def window(at: int, size: int) -> tuple[np.ndarray, np.ndarray]:
            """The tokens of a window, and where they start in the word."""
            piece = word[at : at + size]
            if piece not in known:
                known[piece] = np.frombuffer(self._merged(pa.array([piece], pa.binary()))[0].as_py(), dtype="<u4")
            ids = known[piece]
            return ids, at + np.cumsum(self.size[ids]) - self.size[ids]

        out, at, size = [], 0, WINDOW  # tokens that are settled; place and length of the window
        ids, starts = window(at, size)
        while at + size < len(word):
            grid = (at // STEP + 1) * STEP
            for start in (grid, *starts[starts > at][::-1].tolist()):
                more, begin = window(start, WINDOW)
                _, here, there = np.intersect1d(starts, begin, assume_unique=True, return_indices=True)
                fits = np.flatnonzero(ids[here] == more[there])
                if len(fits):
                    out.append(ids[: here[fits[0]]])
                    ids, starts, at, size = more[there[fits[0]] :], begin[there[fits[0]] :], start, WINDOW
                    break
            else:
                size *= 2
                ids, starts = window(int(starts[0]), at + size - int(starts[0]))
        return np.concatenate([*out, ids]).astype("<u4").tobytes()

    def encode(self, texts: pa.Array) -> pa.ListArray:
        """A list of ids for each text."""
        texts = pc.fill_null(texts, "")
        whole = odd(texts)
        ids, first = self.units.encode(texts.filter(pa.array(~whole)))
        sizes = np.diff(np.append(first, len(ids))) - 1
        keep = np.ones(len(ids), dtype=bool)
        keep[first] = False  # the newlines before the texts
        ids = ids[keep].astype(np.int32)
        if whole.any():
            # Both kinds of texts, and then all in their order.
            others = self.code(texts.filter(pa.array(whole)))
            place = np.where(whole, len(sizes) + np.cumsum(whole) - 1, np.cumsum(~whole) - 1)
            both = concat(cut(ids, 4 * np.cumsum(sizes)), others).take(pa.array(place))
            offsets = offsets_of(both)
            ids = np.frombuffer(both.buffers()[2] or b"", dtype="<i4", count=int(offsets[-1]) // 4)
            sizes = np.diff(offsets) // 4
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(ids))

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """The bytes of each list of ids."""
        flat = pc.fill_null(ids.flatten(), -1).to_numpy(zero_copy_only=False).astype("<u4")
        ends = ids.offsets.to_numpy() - ids.offsets[0].as_py()
        parts, lo = [], 0
        while lo < len(ids):
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + SLICE_IDS, "right")) - 1)
            parts.append(self._bytes(flat[ends[lo] : ends[hi]], ends[lo : hi + 1] - ends[lo]))
            lo = hi
        return pa.chunked_array(parts, pa.large_binary()).combine_chunks() if parts else pa.array([], pa.large_binary())

    def _bytes(self, flat: np.ndarray, ends: np.ndarray) -> pa.Array:
        if not len(flat):
            return pa.array([b""] * (len(ends) - 1), pa.large_binary())
        flat = np.minimum(flat, np.uint32(len(self.size) - 1))
        # A run starts with a text, with a token that opens a word, and after RUN ids.
        starts = self.opens[flat]
        starts[ends[:-1][ends[:-1] < len(flat)]] = True
        cuts = np.append(np.flatnonzero(starts), len(flat))
        for i in np.flatnonzero(np.diff(cuts) > RUN).tolist():
            starts[cuts[i] : cuts[i + 1] : RUN] = True
        cuts = np.append(np.flatnonzero(starts), len(flat))
        runs = cut(np.ascontiguousarray(flat), 4 * cuts[1:]).dictionary_encode()
        offsets = offsets_of(runs.dictionary)
        ids = np.frombuffer(runs.dictionary.buffers()[2], dtype="<u4", count=int(offsets[-1] - offsets[0]) // 4, offset=int(offsets[0])).astype(np.int32)
        upto = np.concatenate([[0], np.cumsum(self.size[ids])])
        known = cut(self._in_order(ids), upto[(offsets[1:] - offsets[0]) // 4])
        found = known.take(runs.indices)
        return cut(found.buffers()[2] or b"", offsets_of(found)[np.searchsorted(cuts, ends[1:])])

    def _in_order(self, ids: np.ndarray) -> pa.Buffer:
        """The bytes of ids, one after the other."""
        self.db.register("incoming", pa.table({"id": ids, "pos": np.arange(len(ids), dtype=np.int32)}))
        found = self.db.sql(DECODE.format(block=BLOCK)).to_arrow_table().combine_chunks()
        self.db.unregister("incoming")
        if not len(found):
            return b""
        tokens = found.column("bytes").combine_chunks().flatten()
        offsets = offsets_of(tokens)
        return tokens.buffers()[2].slice(int(offsets[0]), int(offsets[-1] - offsets[0]))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    rows = docs.select(docs[id_col].alias("doc"), docs[text_col].alias("text"))
    return rows, rows.schema["doc"].dataType.simpleString()


def _encoded(coder: Coder, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.ListArray]]:
    """Ids of the texts, a slice at a time."""
    for batch in batches:
        for lo, hi in slices(batch.column(1), SLICE_BYTES):
            yield batch.column(0).slice(lo, hi - lo), coder.encode(batch.column(1).slice(lo, hi - lo))


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc, ids)``: the ids of each text, an array of integers."""
    rows, kind = _keyed(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, ids in _encoded(Coder.of(ranks_path, pattern), batches):
            yield pa.RecordBatch.from_arrays([doc, ids], names=["doc", "ids"])
        give_back()  # the worker outlives the task

    return rows.mapInArrow(run, f"doc {kind}, ids array<int>")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc, ids, bytes)``: what ``decode(encode(docs))`` gives, in one worker
    process for each task instead of two."""
    rows, kind = _keyed(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder.of(ranks_path, pattern)
        for doc, ids in _encoded(coder, batches):
            yield pa.RecordBatch.from_arrays([doc, ids, coder.decode(ids).cast(pa.binary())], names=["doc", "ids", "bytes"])
        give_back()  # the worker outlives the task

    return rows.mapInArrow(run, f"doc {kind}, ids array<int>, bytes binary")


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Adds ``bytes`` to the rows of ``encode``."""
    kind = encoded.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder.of(ranks_path, pattern)
        for batch in batches:
            ids, rows = batch.column(1), 0
            if ids.null_count:
                ids = pa.array([x or [] for x in ids.to_pylist()], pa.list_(pa.int32()))
            while rows < batch.num_rows:  # a few rows at a time: the results are bytes
                step = min(500, batch.num_rows - rows)
                part = ids.slice(rows, step)
                part = pa.ListArray.from_arrays(pa.array(part.offsets.to_numpy() - part.offsets[0].as_py(), pa.int32()), part.flatten())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(rows, step), part, coder.decode(part).cast(pa.binary())], names=["doc", "ids", "bytes"])
                rows += step
        give_back()

    return encoded.select("doc", "ids").mapInArrow(run, f"doc {kind}, ids array<int>, bytes binary")


def digests(decoded: DataFrame) -> DataFrame:
    """``(doc, n_tokens, ids_sha256, decoded_sha256)`` of encoded and decoded rows."""
    return decoded.select(
        "doc",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )
