"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has a bit for each bit position that more than half of the text's
shingle hashes have set. For radius r every bit position gets a random vector
m(i) of r+1 bits, and each of the 2^(r+1)-1 nonzero vectors v gives a mask: the
positions with <m(i), v> odd. Two fingerprints that differ in r positions or
fewer leave r equations in r+1 unknowns, so some nonzero v has <m(i), v> even at
every differing position: under that mask they are equal. No pair within the
radius is missed.

Equal fingerprints are one node, whatever their number. Fingerprints that are
equal under a mask form a bucket; buckets too large for one task are cut into
blocks, and every two blocks are compared as a unit of their own. A unit returns
a spanning forest of its links, never all pairs.

Defined results: a null text is an empty one; a text without words has
fingerprint zero and links like any other; repeated rows link with each other;
null ids take part, but are never the smallest of a component unless alone; texts
of any length are hashed whole, one at a time; other columns are left alone,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, stored

SHINGLE_SEED = 42


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """The hash of each shingle of a text, repeats included; none without words."""
    import xxhash

    ws = (text or "").encode().lower().split()  # bytes: A-Z alone, and ASCII white space alone
    shingles = map(b" ".join, zip(*[ws[k:] for k in range(width)], strict=False)) if len(ws) >= width else [b" ".join(ws)] * bool(ws)
    return np.fromiter((xxhash.xxh64_intdigest(s, SHINGLE_SEED) for s in shingles), dtype="<u8")


def fingerprint_of(hashes: np.ndarray) -> int:
    """The fingerprint of a text with these shingle hashes; zero for none."""
    octets = hashes.view(np.uint8).reshape(-1, 8)
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
    votes = np.concatenate([np.bincount(octets[:, k], minlength=256) @ bits for k in range(8)])
    return int(sum(1 << i for i in np.flatnonzero(2 * votes > len(hashes)).tolist()))


def fingerprint(text: str | None, width: int = 3) -> int:
    """The fingerprint of one text."""
    return fingerprint_of(shingle_hashes(text, width))


def _fingerprints(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = np.array([fingerprint(t, width) for t in batch.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(values)], names=["doc", "text_hash", "fp"])


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``(doc, text_hash, fp)``, ``fp`` being the fingerprint's 64 bits as a signed long."""
    rows = docs.select(docs[id_col].alias("doc"), docs[text_col].alias("text"), F.xxhash64(F.coalesce(docs[text_col], F.lit(""))).alias("text_hash"))
    kind = rows.schema["doc"].dataType.simpleString()
    return rows.mapInArrow(lambda it: _fingerprints(it, width), f"doc {kind}, text_hash long, fp long")


def masks(radius: int, seed: int = 7) -> list[int]:
    """The 2^(radius+1)-1 masks of 64 bits, as signed longs."""
    draw = random.Random(seed)
    m = [draw.randrange(1, 1 << (radius + 1)) for _ in range(64)]
    out = [sum(((m[i] & v).bit_count() & 1) << i for i in range(64)) for v in range(1, 1 << (radius + 1))]
    return [x - (1 << 64) if x >> 63 else x for x in out]


def forest(left: np.ndarray, right: np.ndarray, radius: int, rows: int = 512) -> np.ndarray:
    """Links of a spanning forest of the graph with an edge between each left and
    right fingerprint that differ in ``radius`` bits or fewer. All are compared,
    in numpy; only near ones of different trees take a step of Python."""
    nodes = np.unique(np.concatenate([left, right]))
    label = np.arange(len(nodes))
    a, b = np.searchsorted(nodes, left), np.searchsorted(nodes, right)
    links: list[np.ndarray] = []

    def root(i: int) -> int:
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    for k in range(0, len(a), rows):
        part = a[k : k + rows]
        near = np.bitwise_count(nodes[part][:, None] ^ nodes[b][None, :]) <= radius
        for i, hits in zip(part.tolist(), near, strict=True):
            found = b[np.flatnonzero(hits)]
            found = found[label[found] != label[i]]  # the others are in one tree for sure
            for j in found.tolist():
                x, y = root(i), root(j)
                if x != y:
                    label[max(x, y)] = min(x, y)
                    links.append(nodes[[i, j]])
    return np.array(links, dtype=np.int64).reshape(-1, 2)


def links(prints: DataFrame, radius: int = 3, most: int = 2000, seed: int = 7) -> DataFrame:
    """Links ``(a, b)`` that connect all fingerprints of ``fp`` (distinct values)
    within ``radius`` bits of each other, directly or through others."""
    tables = [F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks(radius, seed))]
    rows = prints.select("fp", F.inline(F.array(*tables)))
    sizes = rows.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    rows = rows.join(sizes.withColumn("blocks", F.ceil(F.col("n") / most).cast("int")), ["t", "key"])
    # Block i meets every block j: as the left side if i <= j, as the right side if i >= j.
    block = F.pmod(F.xxhash64("fp", F.lit(seed)), F.col("blocks")).cast("int")
    rows = rows.withColumn("i", block).select("t", "key", "fp", "i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"))
    rows = rows.select("t", "key", F.least("i", "j").alias("x"), F.greatest("i", "j").alias("y"), "fp", (F.col("i") <= F.col("j")).alias("is_left"), (F.col("i") >= F.col("j")).alias("is_right"))
    unit = ["t", "key", "x", "y"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by unit; one unit is held at a time."""

        def out(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            fp, is_left, is_right = (t.column(c).to_numpy() for c in ("fp", "is_left", "is_right"))
            found = forest(fp[is_left], fp[is_right], radius)
            return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

        held: list[pa.RecordBatch] = []
        last: tuple | None = None
        for batch in batches:
            keys = [batch.column(c).to_numpy() for c in unit]
            change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            edges = [0, *change.tolist(), batch.num_rows]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if lo == hi:
                    continue
                now = tuple(k[lo] for k in keys)
                if held and now != last:
                    yield out(held)
                    held = []
                last = now
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield out(held)

    return rows.repartition(*unit).sortWithinPartitions(*unit).mapInArrow(compare, "a long, b long")


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, width: int = 3) -> DataFrame:
    """``(doc, text_hash, fp, root, component)`` for each row: ``component`` is the
    smallest id that links reach from it, ``root`` a fingerprint that stands for
    the whole component."""
    rows = stored(with_fingerprints(docs, id_col, text_col, width), "fingerprints")
    least = stored(rows.groupBy("fp").agg(F.min("doc").alias("doc")), "distinct-fingerprints")
    found = connected_components(links(least.select("fp"), radius)).select(F.col("node").alias("fp"), F.col("component").alias("root"))
    named = least.join(found, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = named.groupBy("root").agg(F.min("doc").alias("component"))
    labels = stored(named.join(ids, "root").select("fp", "root", "component"), "fingerprint-labels")
    return rows.join(labels, "fp").select("doc", "text_hash", "fp", "root", "component")


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, width: int = 3) -> DataFrame:
    """One document of each component, the one of the smallest id, with every
    column of ``docs``. Of repeated rows one stays."""
    return first_rows(docs, components(docs, id_col, text_col, radius, width), id_col, text_col)


def first_rows(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that come first in their component: ``found`` has
    ``doc``, ``text_hash``, ``root`` and ``component`` of each row."""
    kept = stored(
        found.where(F.col("doc").eqNullSafe(F.col("component")))
        .groupBy("root", "doc", "text_hash")
        .agg(F.count("*").alias("n"))
        .groupBy("root")
        .agg(F.min(F.struct("doc", "text_hash", "n")).alias("k"))
        .select("k.*"),
        "kept-documents",
    )
    key = F.struct(docs[id_col].alias("doc"), F.xxhash64(F.coalesce(docs[text_col], F.lit(""))).alias("text_hash"))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), key.alias("_key"))

    def of(some: DataFrame) -> DataFrame:
        some = some.select(F.struct("doc", "text_hash").alias("_kept"))
        return rows.join(some, F.col("_key").eqNullSafe(F.col("_kept")), "left_semi")

    once, repeated = of(kept.where("n = 1")), of(kept.where("n > 1")).dropDuplicates(["_key"])
    return once.unionByName(repeated).select("_row.*")
