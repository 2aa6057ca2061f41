"""Texts cut into units that byte-level tokenizers encode apart from each other.

The pattern of these tokenizers never joins characters across a single blank or
newline, except a blank to what follows it. So texts without other white space
are cut at those with Arrow, and each different unit is encoded once: a unit's
newline stays with it, its blank is left out. Texts with other white space have
to be encoded whole.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space other than a single blank or newline between other characters; the
#: control characters and the spaces are those of Unicode.
ODD_SPACE = r"[\t\r\x0B\x0C\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]|[ \n][ \n]|^[ \n]|[ \n]$|^$"
#: Marks that are a token of their own after a letter.
MARKS = ".,;:!?"


def odd(texts: pa.Array, other: str = "") -> np.ndarray:
    """Which texts can't be cut into units: those with odd white space, or with
    what the regular expression ``other`` finds."""
    return pc.match_substring_regex(texts, f"{ODD_SPACE}|{other}" if other else ODD_SPACE).to_numpy(zero_copy_only=False)


def cut(data: np.ndarray | pa.Buffer, ends: np.ndarray) -> pa.LargeBinaryArray:
    """Values that stand one after the other in ``data`` and end at these bytes."""
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def offsets_of(values: pa.Array) -> np.ndarray:
    """Where an Arrow column's strings start in its data, and where the last one ends."""
    kind = np.int64 if values.type in (pa.large_binary(), pa.large_string()) else np.int32
    return np.frombuffer(values.buffers()[1], dtype=kind)[values.offset : values.offset + len(values) + 1]


def concat(*arrays: pa.Array) -> pa.Array:
    return pa.concat_arrays([a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a for a in arrays])


class UnitCoder:
    """Ids of the units met so far, 4 little-endian bytes each.

    ``code`` gives the ids of texts, ``newline`` those of a newline, one id; about
    the last ``most`` units that were wanted are remembered.
    """

    def __init__(self, code: Callable[[pa.Array], pa.Array], newline: bytes, most: int):
        self.code, self.newline, self.most = code, newline, most
        self.mark_ids = concat(pa.array([b""], pa.large_binary()), code(pa.array(list(MARKS))))
        self.mark_at = np.zeros(256, dtype=np.int64)
        self.mark_at[list(MARKS.encode())] = np.arange(1, len(MARKS) + 1)
        self.units, self.ids = pa.array([], pa.string()), pa.array([], pa.large_binary())

    def _of(self, units: pa.Array, learn: Callable[[pa.Array], pa.Array]) -> pa.Array:
        """Ids of different units: those remembered, and others as ``learn`` has them."""
        place = pc.index_in(units, value_set=self.units)
        if not place.null_count:
            return self.ids.take(place)
        new = place.is_null().to_numpy(zero_copy_only=False)
        at = place.fill_null(0).to_numpy().astype(np.int64)
        at[new] = len(self.ids) + np.arange(int(new.sum()))
        return concat(self.ids, learn(units.filter(pa.array(new)))).take(pa.array(at))

    def _learn(self, units: pa.Array) -> pa.Array:
        """Of units that differ in a last mark only, one is encoded."""
        marked = pc.match_substring_regex(units, rf"\pL[{MARKS}]$")
        stems = pc.if_else(marked, pc.utf8_slice_codeunits(units, 0, -1), units).dictionary_encode()
        ids = self._of(stems.dictionary, self._encoded).take(stems.indices)
        last = np.frombuffer(units.buffers()[2], dtype=np.uint8)[offsets_of(units)[1:] - 1]
        mark = np.where(marked.to_numpy(zero_copy_only=False), self.mark_at[last], 0)
        return pc.binary_join_element_wise(ids, self.mark_ids.take(pa.array(mark)), pa.scalar(b"", pa.large_binary()))

    def _encoded(self, units: pa.Array) -> pa.Array:
        opens = pc.starts_with(units, "\n")
        texts = pc.binary_join_element_wise(pc.if_else(opens, "", " "), pc.if_else(opens, pc.utf8_slice_codeunits(units, 1), units), "")
        none = pa.scalar(b"", pa.large_binary())
        return pc.binary_join_element_wise(pc.if_else(opens, pa.scalar(self.newline, pa.large_binary()), none), self.code(texts), none)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, a newline's before each text, and the places of
        these newlines."""
        if not len(texts):
            return np.empty(0, dtype="<u4"), np.empty(0, dtype=np.int64)
        marked = pc.binary_join_element_wise("", pc.replace_substring(texts, "\n", " \n"), "\n")
        units = pc.split_pattern(marked, " ")
        coded = units.flatten().dictionary_encode()
        different = coded.dictionary
        ids = self._of(different, self._learn)
        # What was wanted last comes first.
        others = pc.invert(pc.is_in(self.units, value_set=different))
        room = max(0, self.most - len(different))
        self.units = concat(different, self.units.filter(others).slice(0, room))
        self.ids = concat(ids, self.ids.filter(others).slice(0, room))
        found = ids.take(coded.indices)
        offsets = offsets_of(found)
        first = units.offsets.to_numpy()[:-1] - units.offsets[0].as_py()
        return np.frombuffer(found.buffers()[2], dtype="<u4", count=int(offsets[-1] - offsets[0]) // 4, offset=int(offsets[0])), (offsets[first] - offsets[0]) // 4
