"""Periodic runs of words, found by block convolution.

A run is a stretch of consecutive words with smallest period q and at least
``max(least, times * q)`` words that no neighbouring word extends. With ``times`` of 4
and B <= q < 2 B a run holds an aligned block of B words, and the same block again q
words later. So for each scale B = 1, 2, 4, ... blocks of B words are held against the
words that follow them: the sum of squared differences of their numbers is nought at
exactly the distances where a block occurs again. The sums of all blocks come from
number-theoretic transforms over primes whose product no sum reaches, so they are
exact. Each such distance seeds an extension to both sides, which gives the run.

A block takes part only if each of its words occurs again within the window. A block
and its next occurrence within a run of smaller period seed nothing: what they cover is
as long as both periods together, so the smaller one is the period of it all.

Spark deals out documents; a task works on slices of them, whose words stand one after
the other with a word of its own after each document, so no run crosses documents.

Defined results: words are runs of anything but ASCII white space, compared byte by
byte; a null text has none; runs of different periods may overlap, and each is given;
ids may be null and may repeat; other columns are left alone, whatever their names; an
empty table gives an empty result; a text is taken whole, in one task, whatever its length
(periods from 2^25 words on, in a text of over 2^27 words, would be an error).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, let, slices, words

#: Bytes of text to a slice; numbers that are transformed at once.
SLICE_BYTES, AT_ONCE = 6_000_000, 1 << 20
#: Primes below 2^31 that are one more than a multiple of 2^25 at least, and a generator of each.
PRIMES = ((2013265921, 31), (469762049, 3), (167772161, 3))
#: Words that extensions go in step before the others are left to longer strides.
IN_STEP = 16
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_RUNS = pa.list_(pa.struct([(name, pa.int64()) for name in ("start", "length", "period")]))


class Transform:
    """Cyclic convolution of rows of ``size`` numbers, a power of two, modulo a prime."""

    made: dict[tuple[int, int], Transform] = {}

    def __init__(self, size: int, prime: int, generator: int):
        if (prime - 1) % size:
            raise ValueError(f"blocks of {size // 2} words are too long")
        self.size, self.prime = size, prime
        root = pow(generator, (prime - 1) // size, prime)
        self.there, self.back = self._powers(root), self._powers(pow(root, -1, prime))
        self.share = pow(size, -1, prime)

    def _powers(self, root: int) -> np.ndarray:
        out = np.ones(max(1, self.size // 2), dtype=np.int64)
        n = 1
        while n < len(out):  # the second half is the first, times a power
            out[n : 2 * n] = out[:n] * pow(root, n, self.prime) % self.prime
            n *= 2
        return out

    @classmethod
    def of(cls, size: int, prime: int, generator: int) -> Transform:
        if (size, prime) not in cls.made:
            cls.made[size, prime] = cls(size, prime, generator)
        return cls.made[size, prime]

    def _run(self, rows: np.ndarray, powers: np.ndarray) -> np.ndarray:
        """The transform of each row. Sums of the halves give its even places and
        twisted differences the odd ones, step after step; results stay in order."""
        n, x = len(rows), rows.reshape(len(rows), self.size, 1)
        while x.shape[1] > 1:
            half, side = x.shape[1] // 2, x.shape[2]
            a, b = x[:, :half], x[:, half:]
            x = np.empty((n, half, 2 * side), dtype=np.int64)
            x[:, :, :side] = (a + b) % self.prime
            x[:, :, side:] = (a - b) * powers[::side][:half, None] % self.prime
        return x.reshape(n, self.size)

    def convolved(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        product = self._run(a, self.there) * self._run(b, self.there) % self.prime
        return self._run(product, self.back) * self.share % self.prime


def occurrences(words: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Where blocks of ``size`` words that begin at ``starts`` occur again, ``size``
    to ``2 * size - 1`` words later: block starts and distances. ``words`` has
    enough numbers after the last window, and none is negative."""
    most, primes, bound = size * int(words.max()) ** 2, [], 1
    for prime in PRIMES:  # as many as tell every sum from nought
        if bound <= most:
            primes.append(prime)
            bound *= prime[0]
    if bound <= most:
        raise ValueError("too many different words in one text")
    found = [(np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64))]
    rows = max(1, AT_ONCE // (2 * size))
    for lo in range(0, len(starts), rows):
        at = starts[lo : lo + rows]
        block = words[at[:, None] + np.arange(size)]
        window = words[at[:, None] + np.arange(size, 3 * size - 1)]
        none = np.ones((len(at), size), dtype=bool)
        for prime, generator in primes:
            a, b = np.zeros((2, len(at), 2 * size), dtype=np.int64)
            a[:, :size], b[:, : 2 * size - 1] = block[:, ::-1] % prime, window % prime
            product = Transform.of(2 * size, prime, generator).convolved(a, b)[:, size - 1 : 2 * size - 1]
            upto = np.cumsum(b * b % prime, axis=1)
            squares = upto[:, size - 1 : 2 * size - 1].copy()
            squares[:, 1:] -= upto[:, : size - 1]
            own = (a * a % prime).sum(axis=1, keepdims=True)
            none &= (own + squares - 2 * product) % prime == 0
        row, shift = np.nonzero(none)
        found.append((at[row], size + shift))
    return np.concatenate([x for x, _ in found]), np.concatenate([d for _, d in found])


def _stride(words: np.ndarray, at: int, d: int) -> int:
    """How many words from ``at`` on equal those ``d`` later."""
    n, size = 0, 64
    while True:
        later = words[at + n + d : at + n + d + size]
        differ = np.flatnonzero(words[at + n : at + n + len(later)] != later)
        if len(differ):
            return n + int(differ[0])
        n, size = n + size, size * 2


def _stride_back(words: np.ndarray, at: int, d: int) -> int:
    """How many words before ``at`` equal those ``d`` later."""
    n, size = 0, 64
    while True:
        lo = max(0, at - n - size)
        differ = np.flatnonzero(words[lo : at - n] != words[lo + d : at - n + d])
        if len(differ):
            return at - 1 - (lo + int(differ[-1]))
        n, size = at - lo, size * 2


def extended(words: np.ndarray, starts: np.ndarray, distances: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The stretches of a period around occurrences, each once: start, end and
    period. Every text has a word of its own before and after it."""
    order = np.lexsort((starts, distances))
    starts, d = starts[order], distances[order]
    # Blocks that follow each other at one distance are in one stretch.
    opens = np.append(True, (d[1:] != d[:-1]) | (starts[1:] != starts[:-1] + size))[: len(d)]
    left, right, d = starts[opens], starts[np.append(opens[1:], True)[: len(d)]] + size, d[opens]
    back, on = np.ones(len(left), dtype=bool), np.ones(len(left), dtype=bool)
    for _ in range(IN_STEP):
        back[back] = words[left[back] - 1] == words[left[back] - 1 + d[back]]
        left[back] -= 1
        on[on] = words[right[on]] == words[right[on] + d[on]]
        right[on] += 1
    done: tuple[int, int, int] | None = None
    for i in np.flatnonzero(back | on).tolist():
        period = int(d[i])
        if done is None or done[2] != period or not done[0] <= left[i] < done[1]:
            lo, hi = int(left[i]), int(right[i])
            done = (lo - (_stride_back(words, lo, period) if back[i] else 0), hi + (_stride(words, hi, period) if on[i] else 0), period)
        left[i], right[i] = done[0], done[1]
    order = np.lexsort((left, d))
    left, right, d = left[order], right[order], d[order]
    new = np.append(True, (left[1:] != left[:-1]) | (d[1:] != d[:-1]))[: len(d)]
    return left[new], right[new] + d[new], d[new]


def find_runs(words: np.ndarray, longest: int, least: int = 6, times: int = 4) -> np.ndarray:
    """The runs in numbered words, as rows of start, end and period.

    Numbers are positive; texts have at most ``longest`` words each, and before the
    first and after every one of them stands a number that occurs nowhere else."""
    if times < 3:
        raise ValueError("times is 3 at least")
    n = len(words)
    order = np.argsort(words, kind="stable")
    again = np.flatnonzero(words[order][1:] == words[order][:-1])
    gap = np.full(n, n + 1, dtype=np.int64)  # to the next place of the same word
    gap[order[again]] = order[again + 1] - order[again]
    reach = np.zeros(n, dtype=np.int64)  # the furthest end of a run that starts here or before
    runs, size = [np.empty((0, 3), dtype=np.int64)], 1
    while times * size <= longest:
        padded = np.append(words, np.zeros(3 * size, dtype=np.int64))
        blocks = n // size
        begin = np.arange(blocks, dtype=np.int64) * size
        wanted = (gap[: blocks * size].reshape(blocks, size).max(axis=1) < 2 * size) & (reach[begin] < begin + 3 * size - 1)
        block, distance = occurrences(padded, begin[wanted], size)
        new = reach[block] < block + size + distance  # else both lie in a run of smaller period
        start, end, period = extended(padded, block[new], distance[new], size)
        # A stretch that lies in a run of smaller period has that period.
        good = (end - start >= np.maximum(least, times * period)) & (reach[start] < end)
        runs.append(np.stack([start, end, period], axis=1)[good])
        np.maximum.at(reach, start[good], end[good])
        reach = np.maximum.accumulate(reach)
        size *= 2
    return np.concatenate(runs)


def _slice(texts: pa.Array, least: int, times: int) -> list[pa.Array]:
    """Words, runs, and the text of the words that no run repeats, of each text."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    parts, ends = split.flatten(), split.offsets.to_numpy() - split.offsets[0].as_py()
    real = pc.not_equal(parts, "").to_numpy(zero_copy_only=False)
    upto = np.concatenate([[0], np.cumsum(real)])[ends].astype(np.int64)  # words before each text
    found = parts.filter(pa.array(real))
    coded = found.dictionary_encode()
    number, count = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
    # A number of its own before the first text and after each.
    place = np.arange(len(number)) + np.repeat(np.arange(1, len(texts) + 1), np.diff(upto))
    marks = upto + np.arange(len(texts) + 1)
    words = np.empty(len(number) + len(texts) + 1, dtype=np.int64)
    words[place], words[marks] = number + 1, count + 1 + np.arange(len(marks))
    runs = find_runs(words, int(np.diff(upto).max(initial=0)), least, times)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 1], -1)
    kept = np.cumsum(edge)[place] == 0
    left = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(kept)])[upto].astype(np.int32)), found.filter(pa.array(kept)))
    text = np.searchsorted(marks, runs[:, 0], "right") - 1
    rows = pa.StructArray.from_arrays([pa.array(x) for x in (runs[:, 0] - marks[text] - 1, runs[:, 1] - runs[:, 0], runs[:, 2])], fields=list(_RUNS.value_type))
    listed = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(len(texts) + 1)).astype(np.int32)), rows)
    return [pa.array(np.diff(upto)), listed, pc.binary_join(left, " ")]


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6, times: int = 4) -> DataFrame:
    """``(doc, n_words, runs, collapsed)``: the runs of each text by start and
    period, and its words, a blank between them, without those that lie in a run
    after the run's first period."""
    rows = docs.select(docs[id_col].alias("doc"), docs[text_col].alias("text"))
    kind = rows.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch.column(1), SLICE_BYTES):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *_slice(batch.column(1).slice(lo, hi - lo), least, times)], names=["doc", "n_words", "runs", "collapsed"])
        give_back()  # the worker outlives the task

    return rows.mapInArrow(run, f"doc {kind}, n_words bigint, runs {RUNS}, collapsed string")


def with_planted_periods(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc, text)``: of a document whose id's CRC-32 h ends in 0, the n words from
    number a on repeat p words: with g = h div 10, a = g mod n and
    p = 1 + (n - a) div (3 + g mod 8). Other texts are as they are."""
    h = F.crc32(docs[id_col].cast("string"))
    g = F.floor(h / 10)

    def planted(ws: Column, n: Column) -> Column:
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        moved = let(F.struct(a.alias("a"), p.alias("p")), lambda x: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(ws, F.when(i < x["a"], i).otherwise(x["a"] + (i - x["a"]) % x["p"]).cast("int"))))
        return F.when(n > 0, F.array_join(moved, " ")).otherwise("")

    text = F.when(h % 10 == 0, let(words(docs[text_col]), lambda ws: planted(ws, F.size(ws)))).otherwise(docs[text_col])
    return docs.select(docs[id_col].alias("doc"), text.alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """The number of runs, the longest of them (ties: smallest start, then period),
    and digests of all runs and of the collapsed text."""
    best = F.array_sort("runs", lambda a, b: F.when(a["length"] != b["length"], F.signum(b["length"] - a["length"])).when(a["start"] != b["start"], F.signum(a["start"] - b["start"])).otherwise(F.signum(a["period"] - b["period"])).cast("int"))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    shown = found.select("doc", F.size("runs").cast("long").alias("n_runs"), F.get(best, F.lit(0)).alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    milli = F.expr("1000 * best.length div best.period")
    return shown.select("doc", "n_runs", "best.start", "best.length", "best.period", milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
