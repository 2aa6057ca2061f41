"""A Katz backoff model of words: Good-Turing discounted n-gram counts.

P(w | h) is the discounted count of (h, w) over that of h if the n-gram was seen,
and a(h) P(w | h') if not, h' being h without its first word, and so on down to
P(w), the discounted count of w over all; the mass that discounting frees there
goes to the unknown word. a(h) is what is left over in h over what the words not
seen after h have of the lower order, from the very sums of the stored counts, so
that every P(. | h) adds up to 1. Counts over ``GT`` aren't discounted; where
nothing is left over, one is added to the total. All n-grams are kept, unless
``least`` says from which count on those of order 3 and higher count as seen; how
many occur once follows from the totals then, with a ``least`` of 2.

The corpus is cut into chunks of documents. Each chunk turns its words into
numbers and adds up its own counts first; counts of words, then of windows of
``order`` words, are dealt out by a hash into buckets, and every bucket answers
each chunk for just the words and windows that the chunk has. A window goes by the
word before its last one, in which its contexts of all orders end: so a bucket
has whatever follows these contexts, adds up the counts of all orders from the
windows alone, and one exchange serves any order. What is shuffled are a chunk's
different windows. No task holds more than a bucket or a chunk. Contexts of over
``HOT_TOKENS`` (and over 1/``HOT`` of all tokens, so fewer than ``HOT``) are spread
by the word before them, or, where that makes one as large, by the one before
that, and at last by the word after. What follows them is counted in an exchange
of its own before, and their sums are added up over all buckets.

Words are told apart by a 64-bit hash. Defined results: a null text is an empty
one, whose only token is its end; a null id is a training row; repeated rows
count each; texts of any length are one chunk's; other columns are left alone;
without training tokens every probability is 1; an empty table gives an empty
result.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import file_system, give_back, shared_folder, slices, stored

CHUNK_BYTES, BUCKET_TOKENS, GT, HOT, HOT_TOKENS = 8_000_000, 2_000_000, 5, 2000, 4_000_000


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed bytes; whole numbers as narrow as they fit, all their
    first bytes before all their second ones, which compresses better."""
    import zstandard

    parts = []
    for a in arrays:
        if a.dtype.kind in "iub":
            a = a.astype(np.min_scalar_type(int(a.max()) if len(a) else 0))
        parts.append(a.dtype.str.encode().ljust(4) + len(a).to_bytes(8, "little") + np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(data: bytes) -> list[np.ndarray]:
    import zstandard

    raw, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    while at < len(raw):
        kind, n = np.dtype(raw[at : at + 4].decode().strip()), int.from_bytes(raw[at + 4 : at + 12], "little")
        octets = np.frombuffer(raw, np.uint8, n * kind.itemsize, at + 12)
        out.append(np.ascontiguousarray(octets.reshape(kind.itemsize, n).T).view(kind).reshape(n))
        at += 12 + n * kind.itemsize
    return out


def held_out(doc: int | None) -> bool:
    return doc is not None and zlib.crc32(str(doc).encode()) % 7 == 2


def _bucket(a: np.ndarray, b: np.ndarray | int, buckets: int) -> np.ndarray:
    mixed = (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (np.uint64(b) if isinstance(b, int) else b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    return ((mixed * np.uint64(0x165667B19E3779F9)) >> np.uint64(33)) % np.uint64(buckets)


def _parts(bucket: np.ndarray) -> tuple[np.ndarray, Iterator[tuple[int, int, int]]]:
    """An order by bucket that keeps places otherwise, and ``(bucket, from, to)`` in it."""
    order = np.argsort(bucket.astype(np.min_scalar_type(int(bucket.max()) if len(bucket) else 0)), kind="stable")
    by = bucket[order]
    cuts = np.flatnonzero(np.concatenate([[True], by[1:] != by[:-1], [True]])) if len(by) else np.zeros(1, dtype=np.int64)
    return order, ((int(by[lo]), lo, hi) for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))


def _unique(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different keys, a place of each, and for each key its place among them."""
    order = np.argsort(keys)
    by = keys[order]
    new = np.concatenate([[True], by[1:] != by[:-1]])[: len(by)]
    inverse = np.empty(len(keys), dtype=np.int32)
    inverse[order] = np.cumsum(new, dtype=np.int32) - 1
    return by[new], order[new], inverse


def _joined(columns: list[np.ndarray], size: int) -> np.ndarray:
    """A number for each row, in the order of the columns, whose values are below ``size``."""
    key, most = columns[0].astype(np.int64), size
    for c in columns[1:]:
        if most * size >= 1 << 62:
            different, _, ranks = _unique(key)
            key, most = ranks.astype(np.int64), len(different)
        key, most = key * size + c, most * size
    return key


def _runs(columns: list[np.ndarray]) -> np.ndarray:
    """Numbers the runs of equal rows."""
    new = np.zeros(len(columns[0]), dtype=bool)
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.cumsum(new, dtype=np.int32)


@dataclass(frozen=True)
class Discounts:
    """Factors for counts 1 to GT, and whether one is added to a total that no
    discount frees mass from."""

    factors: tuple[float, ...]

    @staticmethod
    def of(counts_of_counts: list[int]) -> Discounts:
        """``counts_of_counts[c - 1]``: how many have count c, for c up to GT + 1.
        Where Good-Turing gives no factor between 0 and 1, half a count is taken off."""
        n = [0, *counts_of_counts]
        out = []
        common = (GT + 1) * n[GT + 1] / n[1] if n[1] else 1.0
        for c in range(1, GT + 1):
            d = ((c + 1) * n[c + 1] / (c * n[c]) - common) / (1 - common) if n[c] and common < 1 else 0.0
            out.append(d if 0 < d <= 1 else (c - 0.5) / c)
        return Discounts(tuple(out))

    def of_counts(self, c: np.ndarray) -> np.ndarray:
        """Discounted counts."""
        table = np.array([0.0, *[k * d for k, d in enumerate(self.factors, 1)]])
        return np.where(c <= GT, table[np.minimum(c, GT).astype(np.int64)], c)

    def freed(self, having: np.ndarray) -> np.ndarray:
        """Mass, in counts, that is freed where ``having[:, c - 1]`` have count c."""
        return having @ np.array([k * (1 - d) for k, d in enumerate(self.factors, 1)])

    def sizes(self, total: np.ndarray, flag: np.ndarray) -> np.ndarray:
        """Totals of contexts, with what is added where nothing is left over: ``flag``
        has bit c - 1 if a count of c follows, and bit GT if one follows that isn't seen."""
        frees = sum(1 << (k - 1) for k, d in enumerate(self.factors, 1) if k * (1 - d) > 1e-9) | 1 << GT
        return total + ((flag.astype(np.int64) & frees) == 0)


@dataclass(frozen=True)
class Unigrams:
    total: int
    distinct: int
    discounts: Discounts
    unknown: float
    plus: int

    @staticmethod
    def of(total: int, distinct: int, counts_of_counts: list[int]) -> Unigrams:
        discounts = Discounts.of(counts_of_counts)
        freed = float(discounts.freed(np.array(counts_of_counts[:GT], dtype=np.float64)))
        plus = int(freed <= 0)
        return Unigrams(total, distinct, discounts, (freed or 1.0) / (total + plus), plus)

    def probability(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, self.discounts.of_counts(c) / max(self.total + self.plus, 1), self.unknown)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 1) / (self.total + 1 * (self.distinct + 1)))


def _write_chunks(folder: str) -> Callable:
    """Turns rows ``(doc, text)`` into chunks, in a file for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        from pyspark import TaskContext

        part, attempt, number, at = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId(), 0, 0
        system, inner = file_system(folder)
        system.create_dir(inner, recursive=True)
        out, rows = None, []
        docs: list = []
        texts: list[list[bytes]] = []
        size = 0

        def close_chunk() -> None:
            nonlocal out, number, at, docs, texts, size
            end = b""  # no word is empty
            words = dict.fromkeys(w for ws in texts for w in ws)
            words[end] = None
            hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), dtype=np.uint64, count=len(words))
            unique, place = np.unique(hashes, return_inverse=True)
            local = dict(zip(words, place.tolist(), strict=True))
            tokens = np.fromiter((local[w] for ws in texts for w in (*ws, end)), dtype=np.uint32)
            often = np.argsort(-np.bincount(tokens, minlength=len(unique)), kind="stable")  # frequent words get small places, which compress better
            local_rank = np.empty(len(unique), dtype=np.uint32)
            local_rank[often] = np.arange(len(unique), dtype=np.uint32)
            unique, tokens = unique[often], local_rank[tokens]
            data = pack(unique, tokens, np.array([len(ws) + 1 for ws in texts]), local_rank[[local[end]]], np.array([held_out(d) for d in docs]))
            if out is None:
                out = system.open_output_stream(f"{inner}/_part-{part:05d}-{attempt}", compression=None)
            out.write(data)
            rows.append((part << 24 | number, f"{folder}/part-{part:05d}", at, len(data), len(tokens), docs))
            at, number, docs, texts, size = at + len(data), number + 1, [], [], 0

        for batch in batches:
            for lo, hi in slices(batch.column(1), CHUNK_BYTES // 4):
                for doc, text in zip(*[batch.column(c).slice(lo, hi - lo).to_pylist() for c in (0, 1)], strict=True):
                    raw = (text or "").encode().lower()  # bytes: A-Z alone
                    docs.append(doc)
                    texts.append(raw.split())  # ASCII white space alone
                    size += len(raw)
                    if size >= CHUNK_BYTES:
                        close_chunk()
        if docs:
            close_chunk()
        if out is not None:
            out.close()
            system.move(f"{inner}/_part-{part:05d}-{attempt}", f"{inner}/part-{part:05d}")
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1]), *[pa.array(c, pa.int64()) for c in columns[2:5]], pa.array(columns[5], pa.list_(pa.int64()))], names=["chunk", "path", "at", "bytes", "n_tokens", "docs"])

    return run


class Chunk:
    """A chunk read again."""

    def __init__(self, path: str, at: int, size: int):
        system, inner = file_system(path)
        with system.open_input_file(inner) as f:
            f.seek(at)
            data = f.read(size)
        self.words, tokens, self.sizes, end, held = unpack(data)
        self.tokens = tokens.astype(np.int32)
        self.end = int(end[0])
        self.sizes = self.sizes.astype(np.int64)
        self.held = held.astype(bool)
        self.train = ~np.repeat(self.held, self.sizes)

    def answers(self, rows: list[dict], buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and counts of the words, from the answers of the word buckets."""
        ids, counts = np.zeros(len(self.words), dtype=np.int64), np.zeros(len(self.words), dtype=np.int64)
        data = {r["bucket"]: r["data"] for r in rows}
        order, parts = _parts(_bucket(self.words, 0, buckets))
        for bucket, lo, hi in parts:
            ids[order[lo:hi]], counts[order[lo:hi]] = unpack(data.pop(bucket))
        return ids, counts


@dataclass(frozen=True)
class Hot:
    """Contexts of an order that are spread: ``keys``, sorted, of the place of the
    context without its first word among those of the order below, and of that
    word's number; ``sums``: total, seen, how many words have which count after it
    and which one in the order below, and the sum of the higher ones of these."""

    keys: np.ndarray
    sums: np.ndarray


@dataclass(frozen=True)
class Stats:
    """What all tasks need: ``discounts`` for each order from 2 on, contexts that are
    ``hot`` for as many orders as have some; ``least``: the count from which on
    n-grams of order 3 and higher count as seen."""

    buckets: int
    hot_over: float
    least: int
    unigrams: Unigrams
    discounts: tuple[Discounts, ...] = ()
    hot: tuple[Hot, ...] = ()

    def least_at(self, order: int) -> int:
        return 1 if order < 3 else self.least


WORD_BITS = 41  # of a word's number, and one, in the keys of hot contexts


@dataclass
class Windows:
    """A chunk's different windows, by bucket, then by their words' numbers: ``back``,
    the words before the last one, the nearest first, as ranks, 0 for none;
    ``last``; ``n``, the training count; ``hot``, of how many orders from 2 on the
    context is spread, and ``places`` of these contexts; ``first``: a token of each;
    ``of_token``: each token's window; ``parts``: ``(bucket, from, to)``."""

    back: list[np.ndarray]
    last: np.ndarray
    n: np.ndarray
    hot: np.ndarray
    places: list[np.ndarray]
    first: np.ndarray
    of_token: np.ndarray
    parts: list[tuple[int, int, int]]


class Tokens:
    """A chunk's tokens as ranks, from 1 on, of their words' numbers; ``known``: by
    order, each token's count of the n-gram that ends there, if its context is hot."""

    def __init__(self, chunk: Chunk, words: list[dict], stats: Stats):
        self.chunk, self.stats = chunk, stats
        ids, counts = chunk.answers(words, stats.buckets)
        by = np.argsort(ids)
        rank = np.empty(len(ids), dtype=np.int32)
        rank[by] = np.arange(1, len(ids) + 1, dtype=np.int32)
        self.ids, self.counts = np.concatenate([[-1], ids[by]]), np.concatenate([[0], counts[by]])
        self.token, self.end = rank[chunk.tokens], rank[chunk.end]
        self.at = (np.arange(len(self.token)) - np.repeat(np.cumsum(chunk.sizes) - chunk.sizes, chunk.sizes)).astype(np.int32)
        self.known: dict[int, np.ndarray] = {}

    def _back(self, offset: int) -> np.ndarray:
        word = np.roll(self.token, offset)
        word[self.at < offset] = 0
        word[self.at == offset - 1] = self.end  # before a text stands an end
        return word

    def windows(self, order: int) -> Windows:
        columns = [*[self._back(k) for k in range(1, order)], self.token]
        _, first, inverse = _unique(_joined(columns, len(self.ids)))
        *back, last = [c[first] for c in columns]
        n = np.bincount(inverse[self.chunk.train], minlength=len(first))
        hot, places, place, numbers = np.zeros(len(first), dtype=np.int8), [], np.zeros(len(first), dtype=np.int64), [self.ids[w] for w in back]
        for k, level in enumerate(self.stats.hot[: order - 1]):
            key = (place << WORD_BITS) + numbers[k] + 1
            found = np.minimum(np.searchsorted(level.keys, key), len(level.keys) - 1)
            place = np.where((hot == k) & (level.keys[found] == key), found, -1)
            hot[place >= 0] = k + 1
            places.append(place)
        mixed = numbers[0].copy()
        for k in range(1, len(places) + 1):
            spread = np.flatnonzero(hot >= k)
            further = np.where(back[k][spread] > 0, numbers[k][spread], self.ids[last[spread]]) if k < order - 1 else self.ids[last[spread]]
            mixed[spread] = _bucket(mixed[spread], further, 1 << 31).astype(np.int64)
        by, parts = _parts(_bucket(mixed, 0, self.stats.buckets))
        rank = np.empty(len(by), dtype=np.int32)
        rank[by] = np.arange(len(by), dtype=np.int32)
        return Windows([w[by] for w in back], last[by], n[by], hot[by], [p[by] for p in places], first[by], rank[inverse], list(parts))

    def hot_windows(self, order: int) -> tuple[Windows, list[tuple[int, np.ndarray]]]:
        """Windows, and by bucket the places of those whose longest context is hot."""
        w = self.windows(order)
        return w, [(b, found) for b, lo, hi in w.parts if len(found := lo + np.flatnonzero(w.hot[lo:hi] == order - 1))]

    def answered(self, order: int, rows: list[dict]) -> None:
        """Keep the counts of n-grams after hot contexts."""
        w, parts = self.hot_windows(order)
        counts, data = np.zeros(len(w.last), dtype=np.int64), {r["bucket"]: r["data"] for r in rows}
        for bucket, here in parts:
            (counts[here],) = unpack(data.pop(bucket))
        self.known[order] = counts[w.of_token]

    def below(self, w: Windows) -> np.ndarray:
        """For windows after hot contexts the count in the longest order that another
        exchange has counted; 0 where that is the word alone."""
        out, order = np.zeros(len(w.last), dtype=np.int64), len(w.back) + 1
        for k, counts in self.known.items():
            here = np.minimum(w.hot + 1, order - 1) == k
            out[here] = counts[w.first[here]]
        return out

    def requests(self, order: int, only_hot: bool) -> Iterator[tuple[int, bytes]]:
        """``(bucket, data)``: the words of windows, the counts of those that are last
        in one, and windows of places of these."""
        if only_hot:
            w, parts = self.hot_windows(order)
        else:
            w = self.windows(order)
            parts = [(b, slice(lo, hi)) for b, lo, hi in w.parts]
        below, place = self.below(w), np.zeros(len(self.ids), dtype=np.int32)
        for bucket, here in parts:
            columns = [c[here] for c in (*w.back, w.last)]
            for c in columns:
                place[c] = 1
            used = np.flatnonzero(place)
            place[used] = np.arange(len(used))
            nearest, *others = [place[c] for c in columns]
            place[used] = 0
            ends = np.flatnonzero(np.bincount(others[-1], minlength=len(used)))
            yield bucket, pack(np.diff(self.ids[used] + 1, prepend=0), self.counts[used[ends]], np.diff(nearest, prepend=0), *others, w.n[here], w.hot[here], below[here])


def _word_requests(buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, path, at, size in _rows(batches):
            c = Chunk(path, at, size)
            counts = np.bincount(c.tokens[c.train], minlength=len(c.words))
            order, parts = _parts(_bucket(c.words, 0, buckets))
            yield from _dealt(number, ((b, pack(c.words[order[lo:hi]], counts[order[lo:hi]])) for b, lo, hi in parts))

    return run


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows one by one, so that one chunk's answers are held at a time."""
    for b in batches:
        for i in range(b.num_rows):
            yield tuple(c[i].as_py() for c in b.columns)
            give_back()


def _dealt(number: int, found: Iterator[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    """A row for each bucket that the chunk has something for."""
    while part := list(itertools.islice(found, 500)):
        yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in part], pa.int64()), pa.array([number] * len(part), pa.int64()), pa.array([d for _, d in part], pa.binary())], names=["bucket", "chunk", "data"])


ASKED = "bucket long, chunk long, data binary"
ANSWER = "bucket long, chunk long, data binary, stats array<double>"


def _answer(bucket: int, chunks: list, data: list, stats: list) -> pa.Table:
    return pa.table({"bucket": pa.array([bucket] * len(chunks), pa.int64()), "chunk": pa.array(chunks, pa.int64()), "data": pa.array(data, pa.binary()), "stats": pa.array(stats, pa.list_(pa.float64()))})


def _counts_of_counts(c: np.ndarray) -> list[float]:
    return np.bincount(np.minimum(c, GT + 2).astype(np.int64), minlength=GT + 3)[1 : GT + 2].astype(float).tolist()


def _add_words(buckets: int) -> Callable:
    """A bucket of words: adds up the chunks' counts, numbers the words and answers."""

    def run(table: pa.Table) -> pa.Table:
        bucket, chunks = table.column("bucket")[0].as_py(), table.column("chunk").to_pylist()
        parts = [unpack(d) for d in table.column("data").to_pylist()]
        unique, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        total = np.bincount(place, weights=np.concatenate([p[1] for p in parts]).astype(np.float64), minlength=len(unique)).astype(np.int64)
        ids = np.empty(len(unique), dtype=np.int64)  # the more frequent, the smaller
        ids[np.argsort(-total, kind="stable")] = np.arange(len(unique), dtype=np.int64) * buckets + bucket
        cuts = np.cumsum([0, *[len(p[0]) for p in parts]])
        data = [pack(ids[place[a:b]], total[place[a:b]]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        seen = total > 0
        stats = [float(total.sum()), float(seen.sum()), *_counts_of_counts(total)]
        return _answer(bucket, [*chunks, None], [*data, pack(unique[seen], ids[seen], total[seen])], [*[None] * len(data), stats])

    return run


def _tokens(row: tuple, stats: Stats) -> Tokens:
    """A chunk with the answers so far."""
    chunk, words, *orders = row
    t = Tokens(Chunk(*chunk), words, stats)
    for k, rows in enumerate(orders, 2):
        t.answered(k, rows if rows is not None else [])
    return t


def _requests(stats: Stats, order: int, only_hot: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, path, at, size, words, *orders in _rows(batches):
            yield from _dealt(number, _tokens(((path, at, size), words, *orders), stats).requests(order, only_hot))

    return run


class Bucket:
    """The different windows of a bucket, in order of their words: ``columns``, places
    in ``words``, the word before the last first; ``n``, ``hot`` and ``below`` of
    each, and ``of_part``, by request, its windows."""

    def __init__(self, data: list[bytes], order: int):
        parts = [unpack(d) for d in data]
        numbers = [np.cumsum(p[0].astype(np.int64)) for p in parts]
        self.words, place = np.unique(np.concatenate(numbers), return_inverse=True)  # one is added to each
        self.word_counts = np.zeros(len(self.words), dtype=np.int64)
        places = np.split(place.astype(np.int32), np.cumsum([len(x) for x in numbers])[:-1])
        for here, p in zip(places, parts, strict=True):
            self.word_counts[here[np.flatnonzero(np.bincount(p[1 + order], minlength=len(here)))]] = p[1]
        columns = [np.concatenate([here[np.cumsum(p[2], dtype=np.int64) if k == 0 else p[2 + k]] for here, p in zip(places, parts, strict=True)]) for k in range(order)]
        n, hot, below = (np.concatenate([p[k] for p in parts]) for k in (-3, -2, -1))
        cuts = np.cumsum([len(p[-1]) for p in parts])[:-1]
        del parts, numbers, places, place
        _, first, inverse = _unique(_joined(columns, len(self.words)))
        self.columns = [c[first] for c in columns]
        self.n = np.bincount(inverse, weights=n, minlength=len(first)).astype(np.int64)
        self.hot, self.below = hot[first].astype(np.int64), below[first].astype(np.int64)
        self.of_part = np.split(inverse, cuts)

    def exists(self, order: int) -> np.ndarray:
        """Whether so many words, the last one included, are there."""
        return self.words[self.columns[order - 2]] > 0


@dataclass
class Level:
    """An order in a bucket: ``context`` of each window; of each n-gram its context,
    count and the one in the order below; of each context its total, what of it is
    seen, and the flag for ``Discounts.sizes``."""

    context: np.ndarray
    local: np.ndarray
    count: np.ndarray
    of: np.ndarray
    counts: np.ndarray
    lower: np.ndarray
    total: np.ndarray
    seen: np.ndarray
    flag: np.ndarray


def _levels(b: Bucket, order: int, stats: Stats) -> list[Level]:
    """The orders from 2 on. Counts are the bucket's own after contexts that aren't
    hot, and in the highest order."""
    out: list[Level] = []
    for k in range(2, order + 1):
        context, local = _runs(b.columns[: k - 1]), b.exists(k) & (np.minimum(b.hot + 2, order) <= k)
        if k == order:
            first, gram = np.arange(len(b.n)), np.arange(len(b.n))
        else:
            _, first, gram = _unique(context * np.int64(len(b.words)) + b.columns[-1])
        counts = np.bincount(gram, weights=b.n, minlength=len(first)).astype(np.int64)
        lower = b.word_counts[b.columns[-1]] if k == 2 else np.where(out[-1].local, out[-1].count, b.below)
        some = local[first] & (counts > 0)
        of, lower, count, counts = context[first][some], lower[first][some], np.where(local, counts[gram], 0), counts[some]
        n = int(context[-1]) + 1
        total = np.bincount(of, weights=counts, minlength=n).astype(np.int64)
        found = counts >= stats.least_at(k)
        seen = np.bincount(of[found], weights=counts[found], minlength=n).astype(np.int64) if stats.least_at(k) > 1 else total
        flag = (total > seen).astype(np.uint8) << GT
        for c in range(stats.least_at(k), GT + 1):
            flag[of[counts == c]] |= np.uint8(1 << (c - 1))
        out.append(Level(context, local, count, of, counts, lower, total, seen, flag))
    return out


def _sums_after(level: Level, least: int, wanted: np.ndarray) -> np.ndarray:
    """``Hot.sums`` of the contexts that are wanted."""
    place, n = np.cumsum(wanted) - 1, int(wanted.sum())
    here = wanted[level.of] & (level.counts >= least)
    of, counts, lower = place[level.of[here]], level.counts[here], level.lower[here]
    having, below = (np.bincount(of * (GT + 2) + np.minimum(c, GT + 1), minlength=n * (GT + 2)).reshape(n, GT + 2)[:, 1 : GT + 1] for c in (counts, lower))
    high = np.bincount(of, weights=np.where(lower > GT, lower, 0), minlength=n)
    return np.column_stack([level.total[wanted], level.seen[wanted], having, below, high]).astype(np.int64)


N_SUMS = 3 + 2 * GT


def _add_windows(order: int, last: bool, stats: Stats) -> Callable:
    """A bucket of windows: adds up counts of all orders. Answers, unless it is the
    last exchange, with counts; then with the highest order in which a window is
    seen, its count, its context's total and flag, and for each higher order what
    backing off takes, once for windows with a context that follow each other."""

    def run(table: pa.Table) -> pa.Table:
        bucket, chunks = table.column("bucket")[0].as_py(), table.column("chunk").to_pylist()
        b = Bucket(table.column("data").to_pylist(), order)
        levels = _levels(b, order, stats)
        top, count, total, flag = (np.zeros(len(b.n), dtype=t) for t in (np.int8, np.int64, np.int64, np.uint8))
        needs, slots, sums = [], [], []
        for k, x in enumerate(levels, 2):
            found = x.count >= stats.least_at(k)
            top[found], count[found] = k, x.count[found]
            total[found], flag[found] = x.total[x.context[found]], x.flag[x.context[found]]
        for k, x in enumerate(levels, 2):
            needs.append(b.exists(k) & (b.hot + 2 <= k) & (top < k))
            wanted = np.zeros(len(x.total), dtype=bool)
            wanted[x.context[needs[-1]]] = last
            slots.append(np.cumsum(wanted, dtype=np.int32) - 1)
            rows = _sums_after(x, stats.least_at(k), wanted)
            if k > 2:
                below = levels[k - 3]
                of = below.context[np.searchsorted(x.context, np.flatnonzero(wanted))]
                rows = np.column_stack([rows, below.total[of], below.flag[of]])
            sums.append(rows)
        data = []
        for here in b.of_part:
            if not last:
                data.append(pack(levels[-1].count[here]))
                continue
            more = []
            for x, need, slot, rows in zip(levels, needs, slots, sums, strict=True):
                context, taken = x.context[here], np.flatnonzero(need[here])
                taken = context[taken][np.concatenate([[True], context[taken][1:] != context[taken][:-1]])[: len(taken)]]
                more += list(rows[slot[taken]].T)
            data.append(pack(top[here], count[here], total[here], flag[here], *more))
        x = levels[-1]
        spread = np.zeros(len(x.total), dtype=bool)
        spread[x.context[b.hot == order - 1]] = True
        at = np.searchsorted(x.context, np.flatnonzero(spread))
        often = np.flatnonzero((x.count > stats.hot_over) & (not last))
        ids = lambda c, rows: b.words[c[rows]] - 1
        hot = pack(*[ids(c, at) for c in b.columns[:-1]], *_sums_after(x, stats.least_at(order), spread).T, *[ids(c, often) for c in (b.columns[-1], *b.columns[:-1])])
        have = [h for x in levels for h in _counts_of_counts(x.counts)]
        return _answer(bucket, [*chunks, None], [*data, hot], [*[None] * len(data), have])

    return run


def _backoff(sums: np.ndarray, k: int, stats: Stats, lower_size: np.ndarray) -> np.ndarray:
    """a(h) of contexts of order k with these sums; 1 where the context isn't seen."""
    total, seen, having, below, high = sums[:, 0], sums[:, 1], sums[:, 2 : 2 + GT], sums[:, 2 + GT : 2 + 2 * GT], sums[:, 2 + 2 * GT]
    lower = stats.unigrams.discounts if k == 2 else stats.discounts[k - 3]
    covered = (high + below @ lower.of_counts(np.arange(1, GT + 1))) / lower_size
    left = total - seen + stats.discounts[k - 2].freed(having)
    plus = left <= 1e-9
    out = np.where(plus, 1.0, left) / np.maximum(total + plus, 1) / np.maximum(1 - covered, 1e-300)
    return np.where(total >= stats.least_at(k), out, 1.0)


def _hot_sizes(hot: Hot, discounts: Discounts) -> np.ndarray:
    total, left = hot.sums[:, 0], hot.sums[:, 0] - hot.sums[:, 1] + discounts.freed(hot.sums[:, 2 : 2 + GT])
    return total + (left <= 1e-9)


def _probabilities(t: Tokens, order: int, rows: list[dict]) -> np.ndarray:
    """Each token's probability."""
    stats, w = t.stats, t.windows(order)
    top, count, total, flag = (np.zeros(len(w.last), dtype=np.int64) for _ in range(4))
    needed: list[list] = [[] for _ in range(order + 1)]
    data = {r["bucket"]: r["data"] for r in rows}
    rows.clear()
    for bucket, lo, hi in w.parts:
        top[lo:hi], count[lo:hi], total[lo:hi], flag[lo:hi], *more = unpack(data.pop(bucket))
        for k in range(2, order + 1):
            columns, more = more[: N_SUMS + 2 * (k > 2)], more[N_SUMS + 2 * (k > 2) :]
            need = np.flatnonzero((w.back[k - 2][lo:hi] > 0) & (w.hot[lo:hi] + 2 <= k) & (top[lo:hi] < k))
            if len(need):
                context = _runs([c[lo:hi] for c in w.back[: k - 1]])[need]
                needed[k].append((lo + need, np.column_stack(columns).astype(np.int64)[_runs([context])]))
    first_size = np.full(len(w.last), max(stats.unigrams.total + stats.unigrams.plus, 1))
    p = stats.unigrams.probability(t.counts[w.last])
    hot_size = first_size.astype(np.float64)
    for k in range(2, order + 1):
        discounts = stats.discounts[k - 2]
        lower_size = hot_size.copy()
        if k - 2 < len(w.places):
            here = np.flatnonzero(w.places[k - 2] >= 0)
            place, hot = w.places[k - 2][here], stats.hot[k - 2]
            counts = t.known[k][w.first[here]] if k < order else np.where(top[here] == k, count[here], 0)
            hot_size[here] = _hot_sizes(hot, discounts)[place]
            p[here] = np.where(counts >= stats.least_at(k), discounts.of_counts(counts) / hot_size[here], p[here] * _backoff(hot.sums[place], k, stats, lower_size[here]))
        found = np.flatnonzero((top == k) & (w.hot + 2 <= k))
        p[found] = discounts.of_counts(count[found]) / discounts.sizes(total[found], flag[found])
        if needed[k]:
            here, sums = (np.concatenate(x) for x in zip(*needed[k], strict=True))
            size = lower_size[here]
            if k > 2:
                own = w.hot[here] + 2 < k
                size[own] = np.maximum(stats.discounts[k - 3].sizes(sums[own, -2], sums[own, -1]), 1)
            p[here] *= _backoff(sums, k, stats, size)
    return p[w.of_token]


def _score(stats: Stats, order: int) -> Callable:
    """Evaluates every token of a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, path, at, size, docs, words, *orders, rows in _rows(batches):
            t = _tokens(((path, at, size), words, *orders), stats)
            c, counts = t.chunk, t.counts[t.token]
            p = _probabilities(t, order, rows)
            starts = np.cumsum(c.sizes) - c.sizes
            add = lambda x, starts=starts: np.add.reduceat(x, starts)
            arrays = [pa.array(docs, pa.int64()), pa.array(c.held), pa.array(c.sizes), pa.array(add((counts > 0).astype(np.int64))), pa.array(np.full(len(c.sizes), stats.unigrams.total)), pa.array(add(stats.unigrams.base(counts))), pa.array(add(np.log10(p)))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def _counted(order: int, least: int) -> Callable:
    """A bucket's n-grams of an order as rows."""

    def run(table: pa.Table) -> pa.Table:
        b = Bucket(table.column("data").to_pylist(), order)
        rows = np.flatnonzero(b.exists(order) & (b.n >= least))
        context = np.stack([b.words[c[rows]] - 1 for c in reversed(b.columns[:-1])], axis=1)
        return pa.table({"bucket": pa.array([table.column("bucket")[0].as_py()] * len(rows), pa.int64()), "context": pa.array(list(context), pa.list_(pa.int64())), "word": b.words[b.columns[-1][rows]] - 1, "count": b.n[rows]})

    return run


@dataclass(frozen=True)
class Model:
    """The stored tables: ``words``, ``spread``, the answers about hot contexts for
    the orders from 2 on that have some, below ``order``, and ``grams``, all others;
    a row for each bucket and chunk and, without a chunk, one with the bucket's sums."""

    chunks: DataFrame
    words: DataFrame
    spread: tuple[DataFrame, ...]
    grams: DataFrame
    stats: Stats
    order: int

    def scores(self) -> DataFrame:
        """``(doc, held_out, n_tokens, n_known, train_tokens, base_score, score)``."""
        return _with_answers(self.chunks, ["docs"], self.words, (*self.spread, self.grams)).mapInArrow(_score(self.stats, self.order), "doc long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")

    def table(self, order: int) -> DataFrame:
        """The counts of an order as rows: ``(bucket, word, id, count)``, the hash, or
        from order 2 on, added up again from the chunks, ``(bucket, context, word,
        count)``, the numbers of the words."""
        if order > 1:
            asked = _with_answers(self.chunks, [], self.words, self.spread).mapInArrow(_requests(self.stats, order, False), ASKED)
            return asked.groupBy("bucket").applyInArrow(_counted(order, self.stats.least_at(order)), "bucket long, context array<long>, word long, count long")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for bucket, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    words, ids, total = unpack(data)
                    yield pa.RecordBatch.from_pydict({"bucket": np.full(len(ids), bucket), "word": words.astype(np.uint64).view(np.int64), "id": ids.astype(np.int64), "count": total.astype(np.int64)})

        return self.words.where("chunk is null").select("bucket", "data").mapInArrow(run, "bucket long, word long, id long, count long")


def _by_chunk(answers: DataFrame, name: str) -> DataFrame:
    return answers.where("chunk is not null").groupBy("chunk").agg(F.collect_list(F.struct("bucket", "data")).alias(name))


def _with_answers(chunks: DataFrame, more: list[str], words: DataFrame, grams: tuple[DataFrame, ...]) -> DataFrame:
    """Chunks with the answers to them: ``(chunk, path, at, bytes, more..., words, grams...)``."""
    rows = chunks.select("chunk", "path", "at", "bytes", *more).join(_by_chunk(words, "words"), "chunk")
    for k, table in enumerate(grams, 2):
        rows = rows.join(_by_chunk(table, f"grams_{k}"), "chunk", "left")
    return rows.select("chunk", "path", "at", "bytes", *more, "words", *[f"grams_{k}" for k in range(2, len(grams) + 2)])


def _sums(answers: DataFrame, n: int) -> list[float]:
    found = answers.where("chunk is null").agg(*[F.sum(F.get("stats", F.lit(i))) for i in range(n)]).first()
    return [x or 0.0 for x in found]


def train(docs: DataFrame, order: int = 3, id_col: str = "doc_id", text_col: str = "text", least: int = 1) -> Model:
    """Learn n-grams up to ``order``, 2 at least, from the rows of ``docs`` that
    aren't held out; all rows can be scored. ``least`` of 1 is the exact model; with
    2, n-grams of order 3 and higher that occur once count as not seen."""
    if order < 2:
        raise ValueError("an order of 2 at least")
    if least not in (1, 2):
        raise ValueError("least is 1 or 2")
    spark = docs.sparkSession
    rows = docs.select(docs[id_col].cast("long").alias("doc"), docs[text_col].alias("text"))
    chunks = stored(rows.mapInArrow(_write_chunks(shared_folder(spark, "word-chunks")), "chunk long, path string, at long, bytes long, n_tokens long, docs array<long>"), "chunks")
    n_chunks, n_tokens = chunks.agg(F.count("*"), F.sum("n_tokens")).first()
    buckets = max(1, (n_tokens or 0) // BUCKET_TOKENS)
    places = chunks.select("chunk", "path", "at", "bytes").repartition(max(1, n_chunks), "chunk")
    words = stored(places.mapInArrow(_word_requests(buckets), ASKED).groupBy("bucket").applyInArrow(_add_words(buckets), ANSWER), "words")
    total, distinct, *have = _sums(words, 2 + GT + 1)
    unigrams = Unigrams.of(int(total), int(distinct), [int(x) for x in have])
    stats, spread, have = Stats(buckets, max(total / HOT, HOT_TOKENS), least, unigrams), (), np.zeros((order - 1, GT + 1))
    found = [(w,) for w in _often(words, stats.hot_over)]
    for k in range(2, order + 1):
        last = k == order or not found
        if found:
            parents = {c: i for i, c in enumerate(hot_contexts)} if k > 2 else {(): 0}
            keyed = sorted(((parents[c[1:]] << WORD_BITS) + c[0] + 1, c) for c in found)
            hot_contexts = [c for _, c in keyed]
            stats = replace(stats, hot=(*stats.hot, Hot(np.array([x for x, _ in keyed]), np.zeros((len(keyed), N_SUMS), dtype=np.int64))))
        to = order if last else k
        asking = _with_answers(chunks, [], words, spread).mapInArrow(_requests(stats, to, not last), ASKED)
        table = stored(asking.groupBy("bucket").applyInArrow(_add_windows(to, last, stats), ANSWER), f"grams-{k}")
        have[: to - 1] += np.array(_sums(table, (to - 1) * (GT + 1))).reshape(to - 1, GT + 1)
        if found:
            sums, often = _spread_sums(table, k)
            at = [sums.get(c, np.zeros(N_SUMS, dtype=np.int64)) for c in hot_contexts]
            stats = replace(stats, hot=(*stats.hot[:-1], replace(stats.hot[-1], sums=np.stack(at))))
            found = often
        if last:
            break
        spread = (*spread, table)
    stats = replace(stats, discounts=tuple(Discounts.of([int(x) for x in h]) for h in have))
    return Model(chunks, words, spread, table, stats, order)


def _often(words: DataFrame, hot_over: float) -> list[int]:
    """The numbers of words over ``hot_over``, fewer than HOT."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0).to_pylist():
                _, ids, total = unpack(data)
                yield pa.RecordBatch.from_arrays([pa.array(ids[total > hot_over].astype(np.int64))], names=["id"])

    return [r[0] for r in words.where("chunk is null").select("data").mapInArrow(run, "id long").collect()]


def _spread_sums(table: DataFrame, order: int) -> tuple[dict[tuple, np.ndarray], list[tuple]]:
    """The sums of hot contexts over all buckets, and the n-grams that are hot contexts
    of the next order, both as the numbers of their words; fewer than HOT each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0).to_pylist():
                parts = [a.astype(np.int64) for a in unpack(data)]
                context, sums, often = np.column_stack(parts[: order - 1]), np.column_stack(parts[order - 1 : order - 1 + N_SUMS]), np.column_stack(parts[order - 1 + N_SUMS :])
                lists = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([*context[:, ::-1].tolist(), *often[:, ::-1].tolist()], lists), pa.array([*sums.tolist(), *[None] * len(often)], lists)], names=["ids", "sums"])

    rows = table.where("chunk is null").select("data").mapInArrow(run, "ids array<long>, sums array<long>")
    found = rows.groupBy("ids").agg(*[F.sum(F.get("sums", F.lit(i))) for i in range(N_SUMS)]).collect()
    sums = {tuple(r[0]): np.array(r[1:], dtype=np.int64) for r in found if r[1] is not None}
    return sums, [tuple(r[0]) for r in found if r[1] is None]
