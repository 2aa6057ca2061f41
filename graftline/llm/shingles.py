"""Near-duplicates by the Jaccard similarity of word shingles.

Texts are linked if their sets of five-word shingles have a similarity of 0.8 or
more. The SimHash operator's covering search gives the first candidates: texts
whose five-word fingerprints differ in 3 bits or fewer. Pairs at 0.8 differ in up
to 10, more than covering masks can search, so texts that share a band of
min-hashes, 24 bands of 4 rows, are candidates as well. A pair at 0.8 is none
there with a chance of (1 - 0.8^4)^24 = 3e-6, one at 0.85 of 8e-8. Every
candidate is verified on the whole sets before it links.

Equal sets are one node, whatever their number. In a band's bucket all nodes meet
the one that has the most company in all its buckets, so a group of copies of one
text costs a pair for each. After that, buckets that still hold several components
are compared whole, in blocks of 1,000 nodes. No bucket is dropped or sampled.

Defined results: a text of fewer than five words has one shingle, a text without
words none, and such texts are equal; nulls and repeated rows are as in SimHash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, stored
from .simhash import fingerprint_of, first_rows, shingle_hashes
from .simhash import links as covering_links

BANDS, ROWS = 24, 4
_DRAW = np.random.default_rng(11)
_TIMES = _DRAW.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_MIX = _DRAW.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2)


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """The different hashes of a text's shingles, in order."""
    return np.unique(shingle_hashes(text, width))


def bands(hashes: np.ndarray) -> list[int]:
    """A signed 64-bit key for each band of min-hashes; none for an empty set."""
    import xxhash

    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(hashes), 4096):
        np.minimum(least, ((hashes[k : k + 4096, None] ^ _MIX) * _TIMES).min(axis=0), out=least)
    return np.array([xxhash.xxh64_intdigest(b.tobytes(), t) for t, b in enumerate(least.reshape(BANDS, ROWS))], dtype=np.uint64).view(np.int64).tolist()


def _signatures(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    import xxhash

    for batch in batches:
        nodes, sizes, prints, keys = [], [], [], []
        for text in batch.column(1).to_pylist():
            hashes = shingle_hashes(text, width)
            found = np.unique(hashes)
            nodes.append(xxhash.xxh64_intdigest(found.tobytes()))
            sizes.append(len(found))
            prints.append(fingerprint_of(hashes))
            keys.append(bands(found))
        node, fp = (pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (nodes, prints))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), node, pa.array(sizes, pa.int64()), fp, pa.array(keys, pa.list_(pa.int64()))], names=["doc", "text_hash", "node", "size", "fp", "bands"])


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(t, width).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], names=["node", "hashes"])


def _similar(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = batch.column(2), batch.column(3)
        keep = []
        for i in range(batch.num_rows):
            a, b = (np.frombuffer(c[i].as_buffer(), "<u8") for c in (x, y))
            both = len(np.intersect1d(a, b, assume_unique=True))
            keep.append(both >= least * (len(a) + len(b) - both) - 1e-9)
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(docs[id_col].alias("doc"), docs[text_col].alias("text"), F.xxhash64(F.coalesce(docs[text_col], F.lit(""))).alias("text_hash"))


def _sets_of(wanted: DataFrame, nodes: DataFrame, keyed: DataFrame, width: int) -> DataFrame:
    """``(node, hashes)`` for the nodes in ``wanted``."""
    wanted = wanted.distinct().join(nodes, "node").select("node", F.col("k").alias("_k"))
    rows = keyed.withColumn("_key", F.struct("doc", "text_hash")).join(wanted, F.col("_key").eqNullSafe(F.col("_k"))).select("node", "text").dropDuplicates(["node"])
    return stored(rows.mapInArrow(lambda it: _sets(it, width), "node long, hashes binary"), "candidate-sets")


def joined(nodes: np.ndarray, of: np.ndarray, sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Links of a spanning forest of similar nodes whose components ``of`` differ.
    Members of the largest component aren't compared among each other."""
    label = {c: c for c in of.tolist()}

    def root(c: int) -> int:
        while label[c] != c:
            label[c] = label[label[c]]
            c = label[c]
        return c

    values, n = np.unique(of, return_counts=True)
    size = np.array([len(x) for x in sets])
    hashes, member = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    order = np.argsort(hashes, kind="stable")
    hashes, member = hashes[order], member[order]
    found = []
    for i in np.flatnonzero(of != values[n.argmax()]).tolist():
        both = np.zeros(len(sets), dtype=np.int64)
        for k in range(0, len(sets[i]), 1000):
            lo, hi = (np.searchsorted(hashes, sets[i][k : k + 1000], side) for side in ("left", "right"))
            at = np.repeat(hi - np.cumsum(hi - lo), hi - lo) + np.arange((hi - lo).sum())
            both += np.bincount(member[at], minlength=len(sets))
        for j in np.flatnonzero(both >= least * (size[i] + size - both) - 1e-9).tolist():
            x, y = root(int(of[i])), root(int(of[j]))
            if x != y:
                label[max(x, y)] = min(x, y)
                found.append((int(nodes[i]), int(nodes[j])))
    return found


def _compare(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by unit; one unit is held at a time."""
    unit = ["key", "x", "y"]

    def out(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        sets = [np.frombuffer(x.as_buffer(), "<u8") for x in t.column("hashes")]
        found = np.array(joined(t.column("node").to_numpy(), t.column("of").to_numpy(), sets, least), dtype=np.int64).reshape(-1, 2)
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


def _near_sizes(least: float):
    """Sets of other sizes can't be as similar as ``least``."""
    return F.least("size_a", "size_b") >= least * F.greatest("size_a", "size_b") - 1e-9


def _fingerprint_pairs(nodes: DataFrame, radius: int) -> DataFrame:
    """Pairs of nodes that fingerprints connect, by one node for each fingerprint."""
    first = stored(nodes.groupBy("fp").agg(F.min(F.struct("node", "size")).alias("m")), "first-of-fingerprints")
    same = nodes.select("fp", F.struct("node", "size").alias("n")).join(first, "fp").select("n", "m")
    near = covering_links(first.select("fp"), radius)
    near = near.join(first.select(F.col("fp").alias("a"), F.col("m").alias("n")), "a").join(first.withColumnRenamed("fp", "b"), "b").select("n", "m")
    return same.union(near)


def links(nodes: DataFrame, keyed: DataFrame, least: float = 0.8, width: int = 5, most: int = 1000, radius: int = 3) -> DataFrame:
    """Links ``(a, b)`` that connect all nodes with a similarity of ``least`` or
    more, directly or through others. ``nodes``: ``(node, size, fp, bands, k)``."""
    rows = nodes.select("node", "size", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    rows = stored(rows.join(shared, "key"), "shared-buckets")
    company = rows.groupBy("node").agg(F.sum("n").alias("company"))
    middle = rows.join(company, "node").groupBy("key").agg(F.max(F.struct("company", "node", "size")).alias("m"))
    found = rows.join(middle, "key").select(F.struct("node", "size").alias("n"), F.struct("m.node", "m.size").alias("m")).union(_fingerprint_pairs(nodes, radius))
    pair = [F.least("n.node", "m.node").alias("a"), F.greatest("n.node", "m.node").alias("b"), F.col("n.size").alias("size_a"), F.col("m.size").alias("size_b")]
    pairs = stored(found.select(*pair).where("a <> b").where(_near_sizes(least)).select("a", "b").distinct(), "candidate-pairs")
    sets = _sets_of(pairs.select(F.explode(F.array("a", "b")).alias("node")), nodes, keyed, width)
    both = pairs.join(sets.withColumnsRenamed({"node": "a", "hashes": "x"}), "a").join(sets.withColumnsRenamed({"node": "b", "hashes": "y"}), "b")
    stars = stored(both.select("a", "b", "x", "y").mapInArrow(lambda it: _similar(it, least), "a long, b long"), "star-links")

    label = connected_components(stars).withColumnRenamed("component", "of")
    rows = rows.join(label, "node", "left").select("key", "node", F.coalesce("of", "node").alias("of"))
    open_ = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("of").alias("lo"), F.max("of").alias("hi")).where("lo <> hi and n > 2")  # a star settles two
    rows = stored(rows.join(open_.select("key", F.ceil(F.col("n") / most).cast("int").alias("blocks")), "key"), "open-buckets")
    if rows.isEmpty():
        return stars
    # Large buckets are cut into blocks, every two of which are a unit.
    rows = rows.withColumn("i", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("i", "j").alias("x"), F.greatest("i", "j").alias("y"), "node", "of")
    rows = rows.join(_sets_of(rows.select("node"), nodes, keyed, width), "node").select("key", "x", "y", "node", "of", "hashes")
    unit = ["key", "x", "y"]
    rest = rows.repartition(*unit).sortWithinPartitions(*unit).mapInArrow(lambda it: _compare(it, least), "a long, b long")
    return stars.union(stored(rest, "other-links"))


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8, width: int = 5) -> DataFrame:
    """``(doc, text_hash, root, component)`` for each row: ``component`` is the
    smallest id that links reach from it, ``root`` a node that stands for the
    whole component."""
    keyed = _keyed(docs, id_col, text_col)
    kind = keyed.schema["doc"].dataType.simpleString()
    rows = stored(keyed.mapInArrow(lambda it: _signatures(it, width), f"doc {kind}, text_hash long, node long, size long, fp long, bands array<long>"), "signatures")
    nodes = rows.groupBy("node").agg(F.min("doc").alias("doc"), F.first("size").alias("size"), F.min("fp").alias("fp"), F.first("bands").alias("bands"), F.min(F.struct("doc", "text_hash")).alias("k"))
    nodes = stored(nodes, "distinct-sets")
    found = connected_components(links(nodes, keyed, least, width)).select("node", F.col("component").alias("root"))
    named = nodes.select("node", "doc").join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = named.groupBy("root").agg(F.min("doc").alias("component"))
    labels = stored(named.join(ids, "root").select("node", "root", "component"), "set-labels")
    return rows.select("doc", "text_hash", "node").join(labels, "node").select("doc", "text_hash", "root", "component")


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8, width: int = 5) -> DataFrame:
    """One document of each component, the one of the smallest id, with every
    column of ``docs``. Of repeated rows one stays."""
    return first_rows(docs, components(docs, id_col, text_col, least, width), id_col, text_col)
