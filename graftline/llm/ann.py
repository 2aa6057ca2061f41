"""Embedding near-dedup on a robust-pruned flat graph.

Vectors go to the shards of their ``overlap`` nearest centroids. The driver fits a
bounded number of centroids on a bounded sample; where these give cells that are
too large, centroids of each cell are fitted in tasks, so shards don't grow with
the table. In each shard a graph is built: every vector is linked to its nearest
ones, and a link is pruned if a kept neighbour is nearer to its end by the factor
``alpha``. The adjacency lists that a vector gets in its shards are united. A
query starts at the medoids of a shard's parts, goes greedily to where the vectors
are nearest, and from there on expands every vector it meets within the range.
Pairs are verified by the cosine in double precision.

The recall is audited against brute force over all vectors: for a bounded sample
of them, and for as many probes, copies of sampled vectors that are turned away
from them within the range. Probes are built into the graphs and searched like
any vector, and so have links to miss, but they count for no one and join nothing.
As long as the recall is under the target, overlap and beam are doubled; a recall
under ``least_recall`` at the end is an error.

Equal vectors are one node, whatever their number. A shard that is too large is
cut into blocks with a graph each, and every two blocks of it meet in a unit of
their own. A unit returns counts, and a spanning forest of its links.

Defined results: rows whose vector or id is null, whose vector has a null or
non-finite component, or no component that isn't zero, link with nothing; vectors
of different length don't link; rows that repeat an id or a vector are vectors of
their own; other columns are left alone, whatever their names; an empty table
gives an empty result and has a recall of 1. Nodes are told apart by a 64-bit
hash of the vector.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, stored


@dataclass(frozen=True)
class Graph:
    """``shard_rows``: vectors to a centroid; ``max_centroids`` and ``sample_rows``
    bound what the driver, or the task of a cell, fits; ``block_rows``: vectors of a
    shard in one task; ``near`` and ``degree``: candidates and kept links of a
    vector; ``beam``: vectors that a search expands at least; ``parts`` of a unit
    whose medoids it starts from; ``slack``: how far beyond the range it expands;
    ``audit_rows``: vectors, and probes, held against brute force."""

    overlap: int = 4
    shard_rows: int = 700
    max_centroids: int = 1024
    sample_rows: int = 20_000
    block_rows: int = 1500
    near: int = 48
    degree: int = 24
    alpha: float = 1.2
    beam: int = 12
    parts: int = 32
    slack: float = 0.15
    audit_rows: int = 256
    target_recall: float = 0.99
    least_recall: float = 0.9
    seed: int = 11


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of one length as unit rows in double precision."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    rows = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def robust_graph(x: np.ndarray, graph: Graph) -> tuple[list[np.ndarray], int]:
    """Links of each row, and the medoid, from which every row can be reached."""
    n = len(x)
    medoid = int(np.argmax(x @ x.mean(axis=0)))
    out: list[set[int]] = [set() for _ in range(n)]
    near = min(graph.near, n - 1)
    for lo in range(0, n, 512) if near else ():
        sims = x[lo : lo + 512] @ x.T
        sims[np.arange(len(sims)), np.arange(lo, lo + len(sims))] = -2
        best = np.argpartition(-sims, near - 1, axis=1)[:, :near]
        for i, found in enumerate(best):
            found = found[np.argsort(-sims[i, found], kind="stable")]
            far = np.sqrt(np.maximum(0, 2 - 2 * sims[i, found]))
            between = np.sqrt(np.maximum(0, 2 - 2 * (x[found] @ x[found].T)))
            alive = np.ones(len(found), dtype=bool)
            for k in range(len(found)):
                if alive[k]:
                    out[lo + i].add(int(found[k]))
                    if len(out[lo + i]) == graph.degree:
                        break
                    alive[k + 1 :] &= graph.alpha * between[k, k + 1 :] > far[k + 1 :]
            out[lo + i].update(found[:4].tolist())
    for i in range(n):
        for j in list(out[i]):
            out[j].add(i)
    seen = np.zeros(n, dtype=bool)
    todo = [medoid]
    seen[medoid] = True
    while True:
        while todo:
            for j in out[todo.pop()]:
                if not seen[j]:
                    seen[j] = True
                    todo.append(j)
        if seen.all():
            return [np.array(sorted(s), dtype=np.int64) for s in out], medoid
        rest = np.flatnonzero(~seen)
        j = int(rest[np.argmax(x[rest] @ x[medoid])])
        out[medoid].add(j)
        out[j].add(medoid)
        seen[j] = True
        todo.append(j)


def medoids(x: np.ndarray, parts: int) -> list[int]:
    """The medoid of all rows, and those of the rows around ``parts`` spread ones."""
    spread = x[:: max(1, len(x) // parts)]
    label = (x @ spread.T).argmax(axis=1)
    middle = np.zeros_like(spread)
    np.add.at(middle, label, x)
    near = np.einsum("ij,ij->i", x, middle[label])
    order = np.lexsort((-near, label))
    first = order[np.concatenate([[True], label[order][1:] != label[order][:-1]])]
    return sorted({int(np.argmax(x @ x.mean(axis=0))), *first.tolist()})


def range_search(queries: np.ndarray, x: np.ndarray, links: list[np.ndarray], least: float, graph: Graph) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(query, row, cosine)`` of what all queries, in step, meet at ``least`` or
    more, starting at the medoids of ``x``."""
    n, q = len(x), len(queries)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in links])])
    flat = np.concatenate(links) if n else np.empty(0, dtype=np.int64)
    sims = np.full((q, n), -2.0, dtype=np.float64)
    open_ = np.zeros((q, n), dtype=bool)  # met, not yet expanded
    entries = medoids(x, graph.parts)
    sims[:, entries] = queries @ x[entries].T
    open_[:, entries] = True

    def expand(who: np.ndarray, at: np.ndarray) -> None:
        """Meet the neighbours of rows ``at``, for the queries ``who``."""
        open_[who, at] = False
        for lo in range(0, len(who), 20_000):
            w, a = who[lo : lo + 20_000], at[lo : lo + 20_000]
            count = starts[a + 1] - starts[a]
            w = np.repeat(w, count)
            to = flat[np.repeat(starts[a] - (np.cumsum(count) - count), count) + np.arange(len(w))]
            new = np.unique((w * n + to)[sims[w, to] < -1.5])
            w, to = new // n, new % n
            sims[w, to] = np.einsum("ij,ij->i", queries[w], x[to])
            open_[w, to] = True

    rows = np.arange(q)
    for step in range(4 * graph.beam):
        ahead = np.where(open_, sims, -3)
        at = ahead.argmax(axis=1)
        value = ahead[rows, at]
        # A search ends when what is open is worse than all of the last beam, but after some steps only.
        going = value > -2.5 if step < graph.beam else value >= sims.max(axis=1) - 0.05
        if not going.any():
            break
        expand(rows[going], at[going])
    while True:
        who, at = np.nonzero(open_ & (sims >= least - graph.slack))
        if not len(who):
            break
        expand(who, at)
    who, at = np.nonzero(sims >= least)
    return who, at, sims[who, at]


def k_means(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    c = x[np.random.default_rng(seed).choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(8):
        label = (x @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, label, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 0, total / np.where(norm > 0, norm, 1), c)
    return c


def fit_centroids(nodes: DataFrame, graph: Graph) -> dict[int, np.ndarray]:
    """Centroids for each vector length, fitted on a bounded sample of all rows."""
    sizes = {r[0]: r[1] for r in nodes.groupBy("dim").count().collect()}
    out = {}
    for dim, n in sizes.items():
        k = int(min(graph.max_centroids, max(1, n // graph.shard_rows)))
        rows = nodes.where(F.col("dim") == dim).orderBy(F.xxhash64("node", F.lit(graph.seed))).limit(graph.sample_rows).select("embedding").toArrow()
        out[dim] = k_means(matrix(rows.column(0)), k, graph.seed)
    return out


def _nearest(x: np.ndarray, c: np.ndarray, overlap: int) -> np.ndarray:
    """The places of the nearest centroids of each row, in order of places."""
    m = min(overlap, len(c))
    return np.sort(np.argpartition(-(x @ c.T), m - 1, axis=1)[:, :m], axis=1)


def _in_cells(nodes: DataFrame, centroids: dict[int, np.ndarray], overlap: int) -> DataFrame:
    """``(node, weight, embedding, shards)``, shards being the nearest centroids."""
    dims = sorted(centroids)
    base = {d: sum(len(centroids[e]) for e in dims if e < d) for d in dims}

    def run(batches):
        for batch in batches:
            dim = batch.column("dim").to_numpy()
            shards: list = [None] * len(dim)
            for d in np.unique(dim).tolist():
                at = np.flatnonzero(dim == d)
                best = _nearest(matrix(batch.column("embedding").take(pa.array(at))), centroids[d], overlap) + base[d]
                for i, row in zip(at.tolist(), best.tolist(), strict=True):
                    shards[i] = row
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("node", "weight", "embedding")], pa.array(shards, pa.list_(pa.int64()))], names=["node", "weight", "embedding", "shards"])

    return nodes.mapInArrow(run, "node long, weight long, embedding array<double>, shards array<long>")


def _split_cells(rows: DataFrame, graph: Graph, overlap: int) -> DataFrame:
    """``rows`` of ``_in_cells`` with shards of about ``shard_rows``: cells that are
    over twice as large as a centroid should make them get centroids of their own.
    A cell is fitted on a bounded sample, and its vectors are dealt out to many
    tasks that each get its centroids."""
    inner = max(1, overlap // 2)  # of a cell's own centroids, for each vector in it
    each = rows.select("*", F.explode("shards").alias("cell"))
    sizes = each.groupBy("cell").agg(F.count("*").alias("n")).withColumn("k", F.when(F.col("n") > 2 * overlap * graph.shard_rows, F.ceil(F.col("n") * inner / (overlap * graph.shard_rows))).otherwise(1).cast("int"))
    sizes = stored(sizes, "cell-sizes")
    if sizes.where("k > 1").isEmpty():
        return rows
    share = F.least(F.lit(1.0), F.col("k") * F.lit(32.0) / F.col("n"))  # of the cell's vectors, 32 to a centroid
    sample = each.join(sizes.where("k > 1"), "cell").where(F.shiftrightunsigned(F.xxhash64("node", F.lit(graph.seed)), 11) / F.lit(float(1 << 53)) < share)
    sample = sample.withColumn("groups", F.ceil(F.col("k") * 32 / graph.sample_rows)).withColumn("group", F.pmod(F.xxhash64("node", F.lit(graph.seed + 2)), F.col("groups")).cast("int"))

    def fit(table: pa.Table) -> pa.Table:
        """A cell's centroids; those of a very large cell are fitted in groups."""
        k = -(-table.column("k")[0].as_py() // table.column("groups")[0].as_py())
        c = k_means(matrix(table.column("embedding")), k, graph.seed)
        return pa.table({"cell": pa.array([table.column("cell")[0].as_py()] * len(c), pa.int64()), "centroid": pa.array(list(c), pa.list_(pa.float64()))})

    fitted = sample.select("cell", "k", "groups", "group", "embedding").groupBy("cell", "group").applyInArrow(fit, "cell long, centroid array<double>")
    fitted = stored(fitted.groupBy("cell").agg(F.collect_list("centroid").alias("centroids")), "cell-centroids")
    chunks = F.ceil(F.col("n") / 20_000).cast("int")
    dealt = each.join(sizes, "cell").withColumn("chunk", F.pmod(F.xxhash64("node"), chunks).cast("int")).select("cell", "chunk", "node", "weight", "embedding")
    offered = fitted.join(sizes, "cell").select("cell", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"), "centroids")

    def place(members: pa.Table, offers: pa.Table) -> pa.Table:
        cell = members.column("cell") if len(members) else pa.array([], pa.int64())
        if len(members) and len(offers):
            c = np.array(offers.column("centroids")[0].as_py(), dtype=np.float64)
            best = _nearest(matrix(members.column("embedding")), c, inner)
            found = [[(int(cell[0].as_py()) << 32) + j + 1 for j in row] for row in best.tolist()]
        else:
            found = [[x << 32] for x in cell.to_pylist()]
        return pa.table({"node": members.column("node"), "weight": members.column("weight"), "embedding": members.column("embedding"), "found": pa.array(found, pa.list_(pa.int64()))})

    placed = dealt.groupBy("cell", "chunk").cogroup(offered.groupBy("cell", "chunk")).applyInArrow(place, "node long, weight long, embedding array<double>, found array<long>")
    of = placed.groupBy("node").agg(F.array_sort(F.flatten(F.collect_list("found"))).alias("shards"))
    return rows.drop("shards").join(of, "node")


def _sharded(nodes: DataFrame, centroids: dict[int, np.ndarray], graph: Graph, overlap: int) -> DataFrame:
    """``(node, weight, embedding, shards, shard, blocks, i)``: a row for each shard of a node."""
    rows = _split_cells(stored(_in_cells(nodes, centroids, overlap), "cells"), graph, overlap)
    rows = rows.select("node", "weight", "embedding", "shards", F.explode("shards").alias("shard"))
    sizes = rows.groupBy("shard").agg(F.count("*").alias("n")).select("shard", F.ceil(F.col("n") / graph.block_rows).cast("int").alias("blocks"))
    return rows.join(sizes, "shard").withColumn("i", F.pmod(F.xxhash64("node", "shard"), F.col("blocks")).cast("int"))


def _found(rows: DataFrame, least: float, graph: Graph) -> DataFrame:
    """Counts ``(node, links)`` and links ``(a, b)`` of all units, in one table."""

    def build(table: pa.Table) -> pa.Table:
        links, _ = robust_graph(matrix(table.column("embedding")), graph)
        ids = table.column("node").to_numpy()
        return pa.table({"node": ids, "next": pa.array([ids[s] for s in links], pa.list_(pa.int64()))})

    def search(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        members, queries = table.filter(table.column("is_member")), table.filter(table.column("is_query"))
        nothing = {"node": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())}
        if not len(members) or not len(queries):
            return pa.table(nothing)
        shard = table.column("shard")[0].as_py()
        x, ids = matrix(members.column("embedding")), members.column("node").to_numpy()
        place = {v: k for k, v in enumerate(ids.tolist())}
        # United lists: what other shards have found counts where both ends are here.
        links = [np.array(sorted(place[v] for v in s if v in place), dtype=np.int64) for s in members.column("next").to_pylist()]
        links = _reachable(x, links)
        q_ids = queries.column("node").to_numpy()
        same = len(q_ids) == len(ids) and bool((q_ids == ids).all())
        who, at, _ = range_search(matrix(queries.column("embedding")), x, links, least, graph)
        if same:  # what one end has found, the other has
            both = np.unique(np.concatenate([who * len(ids) + at, at * len(ids) + who]))
            who, at = both // len(ids), both % len(ids)
        other = q_ids[who] != ids[at]
        who, at = who[other], at[other]
        a, b = _padded(queries.column("shards"))[who], _padded(members.column("shards"))[at]
        common = np.where((a[:, :, None] == b[:, None, :]) & (a[:, :, None] >= 0), a[:, :, None], np.iinfo(np.int64).max)
        here = common.min(axis=(1, 2), initial=np.iinfo(np.int64).max) == shard  # a pair counts in its first shard
        counts = np.bincount(who[here], weights=members.column("weight").to_numpy()[at[here]], minlength=len(q_ids)).astype(np.int64)
        some = np.flatnonzero(counts)
        real = (queries.column("weight").to_numpy()[who] > 0) & (members.column("weight").to_numpy()[at] > 0)
        edges = _forest(q_ids[who[real]], ids[at[real]])
        void = lambda n: pa.nulls(n, pa.int64())
        return pa.concat_tables(
            [
                pa.table({"node": q_ids[some], "links": counts[some], "a": void(len(some)), "b": void(len(some))}),
                pa.table({"node": void(len(edges)), "links": void(len(edges)), "a": edges[:, 0], "b": edges[:, 1]}),
            ]
        )

    lists = rows.select("shard", "i", "node", "embedding").groupBy("shard", "i").applyInArrow(build, "node long, next array<long>")
    union = stored(lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("next"))).alias("next")), "united-lists")
    rows = rows.join(union, "node").select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"))
    # A row is a member of block i for every j, and a query for every block.
    as_member = rows.select("shard", F.col("i").alias("x"), F.col("j").alias("y"), "node", "weight", "embedding", "shards", "next", F.lit(True).alias("is_member"), (F.col("i") == F.col("j")).alias("is_query"))
    as_query = rows.where("i <> j").select("shard", F.col("j").alias("x"), F.col("i").alias("y"), "node", "weight", "embedding", "shards", "next", F.lit(False).alias("is_member"), F.lit(True).alias("is_query"))
    return as_member.unionByName(as_query).groupBy("shard", "x", "y").applyInArrow(search, "node long, links long, a long, b long")


def _padded(lists) -> np.ndarray:
    lists = lists.to_pylist()
    width = max(map(len, lists), default=0)
    return np.array([[*s, *[-1] * (width - len(s))] for s in lists], dtype=np.int64).reshape(len(lists), width)


def _reachable(x: np.ndarray, links: list[np.ndarray]) -> list[np.ndarray]:
    """The links, and one more from the medoid to each part that it can't reach."""
    medoid = int(np.argmax(x @ x.mean(axis=0)))
    seen, todo, more = np.zeros(len(x), dtype=bool), [medoid], []
    seen[medoid] = True
    while True:
        while todo:
            new = links[todo.pop()]
            new = new[~seen[new]]
            seen[new] = True
            todo += new.tolist()
        rest = np.flatnonzero(~seen)
        if not len(rest):
            return [np.concatenate([s, np.array(more, dtype=np.int64)]) if i == medoid else s for i, s in enumerate(links)]
        j = int(rest[np.argmax(x[rest] @ x[medoid])])
        seen[j] = True
        more.append(j)
        todo.append(j)


def _forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A spanning forest of links."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = list(range(len(nodes)))
    kept = []

    def root(i: int) -> int:
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    for i, j in zip(flat[: len(a)].tolist(), flat[len(a) :].tolist(), strict=True):
        x, y = root(i), root(j)
        if x != y:
            label[max(x, y)] = min(x, y)
            kept.append((nodes[i], nodes[j]))
    return np.array(kept, dtype=np.int64).reshape(-1, 2)


def probes(nodes: DataFrame, least: float, graph: Graph) -> DataFrame:
    """Rows like those of ``nodes``, of no weight: sampled vectors that are turned
    away from themselves, as far as the range allows at most."""
    sample = nodes.orderBy(F.xxhash64("node", F.lit(graph.seed + 3))).limit(graph.audit_rows).select("embedding")

    def turn(batches):
        for batch in batches:
            out = []
            for k, v in enumerate(batch.column(0)):
                x = matrix(pa.array([v.as_py()], pa.list_(pa.float64())))[0]
                draw = np.random.default_rng([graph.seed, k, int(np.abs(x).sum() * 1e6)])
                away = draw.normal(size=len(x))
                away -= (away @ x) * x
                size = np.linalg.norm(away)
                cosine = draw.uniform(least + 0.02 * (1 - least), 1 - 0.02 * (1 - least))
                out.append((cosine * x + np.sqrt(1 - cosine**2) * away / size if size > 1e-9 else x).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.float64()))], names=["embedding"])

    turned = sample.repartition(1).mapInArrow(turn, "embedding array<double>")
    new = turned.select(F.xxhash64("embedding").alias("node"), F.lit(0).cast("long").alias("weight"), "embedding", F.size("embedding").alias("dim")).dropDuplicates(["node"])
    return stored(new.join(nodes.select("node"), "node", "left_anti"), "probes")


def audit(nodes: DataFrame, asked: DataFrame, counts: DataFrame, least: float, graph: Graph) -> float:
    """Links found of those that brute force finds, for the probes ``asked`` and a
    bounded sample of nodes, against all nodes."""
    sample = nodes.orderBy(F.xxhash64("node", F.lit(graph.seed + 1))).limit(graph.audit_rows).select("node", "dim", "embedding").unionByName(asked.select("node", "dim", "embedding")).toArrow()
    if not len(sample):
        return 1.0
    ids, dims = sample.column("node").to_numpy(), sample.column("dim").to_numpy()
    by_dim = {d: (ids[dims == d], matrix(sample.filter(pa.array(dims == d)).column("embedding"))) for d in np.unique(dims).tolist()}

    def run(batches):
        for batch in batches:
            dim, node, weight = (batch.column(c).to_numpy() for c in ("dim", "node", "weight"))
            for d, (who, x) in by_dim.items():
                at = np.flatnonzero(dim == d)
                if len(at):
                    near = (x @ matrix(batch.column("embedding").take(pa.array(at))).T >= least) & (who[:, None] != node[at][None, :])
                    yield pa.RecordBatch.from_arrays([pa.array(who), pa.array((near * weight[at]).sum(axis=1))], names=["node", "n"])

    true = nodes.mapInArrow(run, "node long, n long").groupBy("node").agg(F.sum("n").alias("n"))
    both = true.join(counts, "node", "left").agg(F.sum("n"), F.sum(F.least("n", F.coalesce("links", F.lit(0))))).first()
    return both[1] / both[0] if both[0] else 1.0


@dataclass(frozen=True)
class Links:
    """``rows``: ``(id, n_links, component)`` for each row; ``recall`` as audited."""

    rows: DataFrame
    recall: float
    overlap: int


def near_duplicates(vectors: DataFrame, least: float = 0.9, graph: Graph = Graph(), id_col: str = "vec_id", vector_col: str = "embedding") -> Links:
    """Link all vectors whose cosine is ``least`` or more."""
    v = F.col("embedding")
    rows = vectors.select(vectors[id_col].alias("id"), vectors[vector_col].cast("array<double>").alias("embedding"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.withColumn("good", F.coalesce(F.col("id").isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False)))
    rows = stored(rows.select("id", F.when(F.col("good"), F.transform(v, lambda x: x + 0.0)).alias("embedding")).withColumn("node", F.when(v.isNotNull(), F.xxhash64("embedding"))), "vectors")
    nodes = rows.where("node is not null").groupBy("node").agg(F.count("*").alias("weight"), F.min("id").alias("least_id"), F.first("embedding").alias("embedding"))
    nodes = stored(nodes.withColumn("dim", F.size("embedding")), "vector-nodes")
    asked = probes(nodes, least, graph)
    centroids = fit_centroids(nodes, graph)
    most = max(map(len, centroids.values()), default=1)
    overlap, searched = graph.overlap, nodes.drop("least_id").unionByName(asked)
    while True:
        found = stored(_found(_sharded(searched, centroids, graph, overlap), least, graph), "vector-links")
        counts = stored(found.where("node is not null").groupBy("node").agg(F.sum("links").alias("links")), "vector-counts")
        recall = audit(nodes, asked, counts, least, graph)
        if recall >= graph.target_recall or overlap >= most:
            break
        overlap, graph = 2 * overlap, replace(graph, beam=2 * graph.beam)
    if recall < graph.least_recall:
        raise RuntimeError(f"a recall of {recall:.3f} with all shards searched; a larger beam or degree is needed")
    parts = connected_components(found.where("a is not null").select("a", "b"))
    named = nodes.select("node", "weight", "least_id").join(parts, "node", "left").withColumn("root", F.coalesce("component", "node")).drop("component")
    ids = named.groupBy("root").agg(F.min("least_id").alias("component"))
    named = named.join(ids, "root").join(counts, "node", "left").select("node", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component")
    named = stored(named, "vector-components")
    joined = rows.select("id", "node").join(named, "node", "left")
    return Links(joined.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component")), recall, overlap)
