"""Helpers that several operators share: words, shared folders, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    Inside the lambdas of higher-order functions a column expression may be
    evaluated again for every element; a lambda variable is not.
    """
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text; a null text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors see.

    Where the setting is absent a folder under /tmp is made once per application
    and set as Spark's checkpoint folder, in local mode; on a cluster, whose
    machines wouldn't see each other's /tmp, that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        current = spark.sparkContext.getCheckpointDir()
        if not current:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
            spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
            current = spark.sparkContext.getCheckpointDir()
        base = current
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends there,
    and what later steps reuse is not computed twice."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_system(path: str):
    """A pyarrow file system and the path in it, for use inside tasks."""
    from pyarrow import fs

    if "://" not in path:
        path = "file://" + path.removeprefix("file:")
    scheme, rest = path.split("://", 1)
    names = {"s3a": "s3", "s3n": "s3", "gs": "gs", "abfs": "abfss"}  # Hadoop's names, and Arrow's
    return fs.FileSystem.from_uri(f"{names.get(scheme, scheme)}://{rest}")


def remove_folder(path: str) -> None:
    """Delete a folder that this library has made in the shared folder."""
    system, inner = file_system(path)
    system.delete_dir(inner)


def slices(column, size: int):
    """Ranges of rows of an Arrow column with about ``size`` bytes each, one row at least."""
    import numpy as np
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + size, "right")))
        yield lo, hi
        lo = hi


def give_back() -> None:
    """Return freed memory of this worker to the system, where libc can."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def connected_components(edges: DataFrame, max_rounds: int = 60, salts: int = 4) -> DataFrame:
    """The smallest node reachable from each node: ``(node, component)``.

    ``edges`` has columns ``a`` and ``b`` of one orderable type; direction,
    repeats and self-loops don't matter, rows with a null are ignored. Nodes
    without an edge to another node aren't returned. Alternates large-star and
    small-star steps, each a partial aggregate and a join on the node, until
    the edges no longer change. A node's rows meet its minimum under ``salts``
    keys, dealt by the other end, and on their own exchange, so a hub is spread
    over tasks and Spark may split it further. Every round is checkpointed, so a
    lost executor costs one round at most.

    An empty input gives an empty result.
    """
    shared_folder(edges.sparkSession, "unused")  # sets the checkpoint folder
    edges = (
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
        .checkpoint()
    )

    def with_least(rows: DataFrame, least: DataFrame) -> DataFrame:
        """``rows`` with the minimum ``m`` of their ``a``."""
        least = least.select("a", "m", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
        return rows.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(salts)).cast("int")).join(least, ["a", "salt"]).drop("salt")

    state = None
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = with_least(both.where("b > a"), least).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = with_least(large, least).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = small.union(least.select("a", F.col("m").alias("b"))).distinct().checkpoint()
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
