"""Streams of documents.

Operators of single documents are column functions and work on a stream as they
are. The schema of a stream grows with its batches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import values
from ..operators import schema


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """``json``, a document a line, of the files that come to a folder."""
    return spark.readStream.text(path).select(F.col("value").alias("json")).where("trim(json) <> ''")


def path_counts(rows: DataFrame, time_col: str, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Leaf rows by path and type in windows of event time."""
    return rows.withWatermark(time_col, late).groupBy(F.window(time_col, window), "path", "type").agg(F.count("*").alias("n"))


class RunningSchema:
    """The merged schema of all batches so far, as if they were one batch: batches
    follow each other, and documents of one are in the order of ``order_by``.

    What is kept of a batch are its stretches (see ``operators.schema``), as a file in
    ``folder``; a batch that comes again writes the same file again. So nothing is held
    between batches, a restarted query or another process goes on from the files, and
    the schema is the one that all documents in one batch would give."""

    def __init__(self, json_col: str, order_by: str, seen: Callable[[int, values.Node], None] | None = None, folder: str | None = None):
        self.json_col, self.order_by, self.seen, self.folder = json_col, order_by, seen, folder

    def _stored(self, spark: SparkSession) -> DataFrame | None:
        try:
            return spark.read.schema(f"g int, batch bigint, {schema.STRETCHES}").parquet(f"{self.folder}/batch-*")
        except AnalysisException:  # nothing is stored yet
            return None

    def nodes(self, spark: SparkSession) -> DataFrame | None:
        """``(path, kind, nullable, required)`` of the schema so far; None before any batch."""
        found = self._stored(spark)
        return found and schema.merged_stretches(found.withColumn("chunk", F.struct("batch", "chunk")).drop("batch")).drop("g")

    def node(self, spark: SparkSession) -> values.Node | None:
        found = self.nodes(spark)
        return found and schema.gathered(found)

    def update(self, batch: DataFrame, number: int) -> None:
        """For ``foreachBatch``."""
        found = schema.stretches(batch, self.json_col, self.order_by).withColumn("batch", F.lit(number).cast("long"))
        found.write.mode("overwrite").parquet(f"{self.folder}/batch-{number:012}")
        if self.seen and (node := self.node(batch.sparkSession)) is not None:
            self.seen(number, node)

    def start(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        """Stretches go to ``schema`` below the checkpoint, if no folder is set."""
        self.folder = self.folder or f"{checkpoint.rstrip('/')}/schema"
        return stream.writeStream.foreachBatch(self.update).option("checkpointLocation", checkpoint).start()
