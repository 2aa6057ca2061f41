"""BPE by dynamic programming over prefixes.

For every prefix of a word there is one token that the prefix's encoding ends with.
It is a suffix of the prefix, it is compatible with the last token of the prefix
before it, and no other token is both. An automaton of all tokens gives the suffixes
at each byte; the compatible one is stored for the byte, and following the stored
tokens back from a word's end gives the word's ids.

Two tokens are compatible if merging never joins across them: of the parts that stand
at the border while the two are merged, none may form a pair that comes before the
merges that use the parts up. Each token has one way to be merged, and merges come
after those that make their parts; a tokenizer for which that doesn't hold is refused.
Answers for pairs are kept, ``PAIRS`` of them.

Spark deals out the documents. A task cuts texts into units that are encoded apart
from each other, and each different unit once; texts that spell an added token are
split at it. The tokenizers library splits units into words and puts none together.

Defined results: a null text is an empty one and has no ids; null ids, and ids that
aren't in the vocabulary, decode to nothing; bytes that aren't UTF-8 decode to U+FFFD;
other columns are left alone, whatever their names; repeated rows are encoded each; an
empty table gives an empty result. Words and texts may be of any length: time and
memory grow in proportion. Units remembered are bounded by ``UNITS``.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, slices
from .units import UnitCoder, concat, cut, odd, offsets_of

#: Units that a worker remembers; pairs whose answer it remembers; bytes of text and ids to a slice.
UNITS, PAIRS, SLICE_BYTES, SLICE_IDS = 700_000, 2_000_000, 8_000_000, 3_000_000
#: A merge that never comes.
NEVER = 1 << 40


def byte_names() -> dict[str, int]:
    """Byte-level vocabularies write each byte as one printable character: a
    printable one as itself, the others as the characters from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Merges:
    """How tokens are merged: the rank of each pair and what it makes."""

    def __init__(self, sizes: list[int], merges: list[tuple[int, int, int]]):
        """``merges`` are (left, right, token), first ones first; tokens of one
        byte have no merge."""
        self.rank = {(a, b): r for r, (a, b, _) in enumerate(merges)}
        made = {t: r for r, (_, _, t) in enumerate(merges)}
        parts = {t: (a, b) for a, b, t in merges}
        if len(made) < len(merges) or any(made.get(x, -1) >= r for r, (a, b, _) in enumerate(merges) for x in (a, b)):
            raise ValueError("a token is made by two merges, or a merge comes before those of its parts")
        # The parts that stand at a token's ends meanwhile, and the merge that uses each up.
        self.first: list[list[tuple[int, int]]] = [[] for _ in sizes]
        self.last: list[list[tuple[int, int]]] = [[] for _ in sizes]
        for side, ends in ((0, self.first), (1, self.last)):
            for token in range(len(sizes)):
                part, until = token, NEVER
                while True:
                    ends[token].append((part, until))
                    if part not in parts:
                        break
                    until, part = made[part], parts[part][side]
        self.known: dict[int, bool] = {}
        # Tokens that their own bytes give; others never come out of a merge.
        self.sound = [n == 1 for n in sizes]
        for a, b, t in merges:
            self.sound[t] = self.sound[a] and self.sound[b] and self._apart(a, b, self.rank[a, b])

    def _apart(self, a: int, b: int, most: int = NEVER) -> bool:
        rank = self.rank
        for x, x_until in self.last[a]:
            for y, y_until in self.first[b]:
                r = rank.get((x, y), NEVER)
                # Of equal merges the left one comes first.
                if r < most and r < x_until and r <= y_until:
                    return False
        return True

    def compatible(self, a: int, b: int) -> bool:
        """Whether ``a`` and ``b``, side by side, stay as they are."""
        key = a << 32 | b
        found = self.known.get(key)
        if found is None:
            if len(self.known) >= PAIRS:
                self.known.clear()
            found = self.known[key] = self._apart(a, b)
        return found


class PrefixCoder:
    """A tokenizer file's tables, and the units met so far."""

    made: dict[str, PrefixCoder] = {}

    def __init__(self, path: str):
        import ahocorasick
        from tokenizers import pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, splits = spec["model"], spec.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or splits.get("type") != "ByteLevel" or not splits.get("use_regex", True) or splits.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("not a byte-level BPE tokenizer without a normalizer and a prefix space")
        if model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
            raise ValueError("dropout, whole words and affixes aren't supported")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that take white space or want whole words aren't supported")
        byte_of, vocab = byte_names(), model["vocab"]
        plain = {i: bytes(byte_of[c] for c in t) for t, i in vocab.items() if all(c in byte_of for c in t)}
        # Tokens by number: the bytes first, then in order of their merges.
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["merges"]]
        names = [*byte_of, *dict.fromkeys(a + b for a, b in pairs)]
        number = {t: k for k, t in enumerate(names)}
        self.id_of = np.array([vocab[t] for t in names], dtype="<u4")
        texts = [plain[vocab[t]] for t in names]
        self.sizes = [len(t) for t in texts]
        self.merges = Merges(self.sizes, [(number[a], number[b], number[a + b]) for a, b in pairs])
        self.automaton = ahocorasick.Automaton()
        for k, t in enumerate(texts):
            if self.merges.sound[k]:
                self.automaton.add_word(t.decode("latin-1"), k)
        self.automaton.make_automaton()
        self.byte_of = str.maketrans({c: chr(b) for c, b in byte_of.items()})
        self.split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.at_added = re.compile("|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) or "(?!)")
        # What ids decode to; an added token's name is read like any other token's if it can be.
        for content, i in self.added.items():
            plain[i] = bytes(byte_of[c] for c in content) if all(c in byte_of for c in content) else content.encode()
        top = max(plain) + 1
        self.offsets = np.concatenate([[0], np.cumsum([len(plain.get(i, b"")) for i in range(top)]), [0]]).astype(np.int64)
        self.offsets[-1] = self.offsets[-2]  # the last is for ids that aren't in the table
        self.bytes = np.frombuffer(b"".join(plain.get(i, b"") for i in range(top)), dtype=np.uint8)
        self.words: dict[str, bytes] = {}
        (newline,) = np.frombuffer(self.word("\n"), dtype="<u4")
        self.units = UnitCoder(self.code, np.array([newline], dtype="<u4").tobytes(), UNITS)

    @classmethod
    def of(cls, path: str) -> PrefixCoder:
        if path not in cls.made:
            cls.made[path] = cls(path)
            give_back()
        return cls.made[path]

    def word(self, word: str) -> bytes:
        """The ids of one word, whose bytes are the characters of ``word``."""
        compatible, sizes = self.merges.compatible, self.sizes
        last = np.full(len(word) + 1, -1, dtype=np.int32) if len(word) > 10_000 else [-1] * (len(word) + 1)
        for end, token in self.automaton.iter(word):
            end += 1
            if last[end] < 0:
                begin = end - sizes[token]
                if begin == 0 or compatible(int(last[begin]), token):
                    last[end] = token
        out, at = [], len(word)
        while at:
            out.append(last[at])
            at -= sizes[out[-1]]
        return self.id_of[out[::-1]].tobytes()

    def text(self, text: str) -> bytes:
        """The ids of a text that spells no added token."""
        out = []
        for name, _ in self.split(text):
            found = self.words.get(name)
            if found is None:
                if len(self.words) >= UNITS // 4:
                    self.words.clear()
                found = self.word(name.translate(self.byte_of))
                if len(name) < 64:
                    self.words[name] = found
            out.append(found)
        return b"".join(out)

    def code(self, texts: pa.Array) -> pa.Array:
        """The ids of units, 4 little-endian bytes each."""
        return pa.array([self.text(t) for t in texts.to_pylist()], pa.large_binary())

    def whole(self, text: str) -> bytes:
        """The ids of a text, split at added tokens."""
        out, at = [], 0
        for m in self.at_added.finditer(text):
            out += [self.text(text[at : m.start()]), np.array([self.added[m[0]]], dtype="<u4").tobytes()]
            at = m.end()
        return b"".join([*out, self.text(text[at:])])

    def encode(self, texts: pa.Array) -> pa.ListArray:
        """A list of ids for each text."""
        texts = pc.fill_null(texts, "")
        whole = odd(texts, "|".join(re.escape(t) for t in self.added))
        ids, first = self.units.encode(texts.filter(pa.array(~whole)))
        sizes = np.diff(np.append(first, len(ids))) - 1
        keep = np.ones(len(ids), dtype=bool)
        keep[first] = False  # the newlines before the texts
        ids = ids[keep].astype(np.int32)
        if whole.any():
            others = pa.array([self.whole(t) for t in texts.filter(pa.array(whole)).to_pylist()], pa.large_binary())
            place = np.where(whole, len(sizes) + np.cumsum(whole) - 1, np.cumsum(~whole) - 1)
            both = concat(cut(ids, 4 * np.cumsum(sizes)), others).take(pa.array(place))
            offsets = offsets_of(both)
            ids = np.frombuffer(both.buffers()[2] or b"", dtype="<i4", count=int(offsets[-1]) // 4)
            sizes = np.diff(offsets) // 4
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(ids))

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """The text of each list of ids."""
        ends = ids.offsets.to_numpy() - ids.offsets[0].as_py()
        flat = pc.fill_null(ids.flatten(), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = np.where((flat >= 0) & (flat < len(self.offsets) - 2), flat, len(self.offsets) - 2)
        begin, size = self.offsets[flat], self.offsets[flat + 1] - self.offsets[flat]
        upto = np.concatenate([[0], np.cumsum(size)])
        data = self.bytes[np.arange(upto[-1]) + np.repeat(begin - upto[:-1], size)]
        found = cut(np.ascontiguousarray(data), upto[ends[1:]])
        try:
            return found.cast(pa.large_string()).cast(pa.string())
        except pa.ArrowInvalid:
            return pa.array([b.decode(errors="replace") for b in found.to_pylist()], pa.string())


def _lists(ids: pa.Array) -> Iterator[tuple[int, int, pa.ListArray]]:
    """Rows ``lo`` to ``hi`` and their lists, of a bounded number of ids; null lists as empty ones."""
    if ids.null_count:
        ids = pa.array([x or [] for x in ids.to_pylist()], pa.list_(pa.int32()))
    ends, lo = ids.offsets.to_numpy(), 0
    while lo < len(ids):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + SLICE_IDS, "right")) - 1)
        part = ids.slice(lo, hi - lo)
        yield lo, hi, pa.ListArray.from_arrays(pa.array(ends[lo : hi + 1] - ends[lo], pa.int32()), part.flatten())
        lo = hi


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    rows = docs.select(docs[id_col].alias("doc"), docs[text_col].alias("text"))
    return rows, rows.schema["doc"].dataType.simpleString()


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc, ids)``: the ids that the tokenizer file ``path`` gives each text."""
    rows, kind = _keyed(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = PrefixCoder.of(path)
        for batch in batches:
            for lo, hi in slices(batch.column(1), SLICE_BYTES):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), coder.encode(batch.column(1).slice(lo, hi - lo))], names=["doc", "ids"])
        give_back()  # the worker outlives the task

    return rows.mapInArrow(run, f"doc {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds ``decoded`` to the rows of ``encode``."""
    kind = encoded.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = PrefixCoder.of(path)
        for batch in batches:
            for lo, hi, ids in _lists(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), ids, coder.decode(ids)], names=["doc", "ids", "decoded"])
        give_back()

    return encoded.select("doc", "ids").mapInArrow(run, f"doc {kind}, ids array<int>, decoded string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``decode(encode(docs))`` in one worker process for each task instead of two."""
    rows, kind = _keyed(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = PrefixCoder.of(path)
        for batch in batches:
            for lo, hi in slices(batch.column(1), SLICE_BYTES):
                ids = coder.encode(batch.column(1).slice(lo, hi - lo))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), ids, coder.decode(ids)], names=["doc", "ids", "decoded"])
        give_back()

    return rows.mapInArrow(run, f"doc {kind}, ids array<int>, decoded string")


def digests(decoded: DataFrame) -> DataFrame:
    """``(doc, n_tokens, ids_sha256, decoded_sha256)`` of encoded and decoded rows."""
    return decoded.select("doc", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
