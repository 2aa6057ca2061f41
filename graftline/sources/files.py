"""Documents from files and to files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import arrays


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """``(file, json)``: one document a file; text after it is ignored later on."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("json"))


def array_files(spark: SparkSession, path: str) -> DataFrame:
    """``(file, position, json)``: the items of a root array, one document each; a
    file may be large, see ``arrays``."""
    return arrays.array_items(spark, path)


def line_files(spark: SparkSession, path: str) -> DataFrame:
    """``(file, json)``: a document a line; empty lines are left out."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("json")).where("trim(json) <> ''")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, position, json)``: ``line_files`` with the lines' places in all files,
    in order of file and offset, however Spark packs files into tasks."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), F.col("value").alias("json"))
    # Rows of a block are one task's and come in order; blocks, few rows, are put in order.
    blocks = lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    before = F.sum("n").over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select("file", "block", "first", F.coalesce(before, F.lit(0)).alias("before"))
    return lines.join(blocks, ["file", "block"]).where("trim(json) <> ''").select("file", (F.col("row") - F.col("first") + F.col("before")).alias("position"), "json")


def rows_as_json(df: DataFrame, name: str = "json", keep: list[str] | None = None) -> DataFrame:
    """Every row as a document, null members included, beside the columns of ``keep``."""
    return df.select(*(keep or []), F.to_json(F.struct(*[df[c] for c in df.columns]), {"ignoreNullFields": "false"}).alias(name))


def from_list(spark: SparkSession, documents: list) -> DataFrame:
    """``(position, json)`` of documents in memory; what isn't a string is taken by its ``str``."""
    return spark.createDataFrame([(i, d if isinstance(d, str) else str(d)) for i, d in enumerate(documents)], "position long, json string")


def write_lines(df: DataFrame, path: str, json_col: str = "json", mode: str = "errorifexists") -> None:
    """A document a line."""
    df.select(F.col(json_col).alias("value")).write.mode(mode).text(path)
