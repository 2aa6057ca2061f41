"""A corpus pipeline: quality rules, near-dedup, mixing, BPE encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``. A stage's result is written as Parquet and
read again as the next one's ``docs``, so a lost executor costs one stage's work
at most.

What holds for every stage: a null text is an empty one, and texts of any length
are worked on whole; ids and sources may be null; an empty table gives an empty
one; repeated rows are said of each stage below; ties are settled by id and text,
so a rerun gives the same rows. Columns that ``documents`` hasn't go along with
their rows up to the last stage, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graftline.llm import bpe, mixing, quality, shingles
from graftline.llm.common import stored


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` for texts that a stage has changed."""
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without lines above the limits.

    Null and empty texts, texts of under ten words or with many repeated windows,
    and depleted ones go. Copies and repeated rows are judged alike and stay or go
    together; copies under ids of their own count in a line's documents, repeated
    rows once."""
    return _counted(quality.clean(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles are 0.8 or more alike.

    The one of the smallest id stays, a null id only where there is no other; of
    repeated rows one. Texts without words are alike."""
    return shingles.first_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: a row for each document and epoch, with the words taken.

    Documents without words are never taken. Null is the last of the sources.
    Repeated rows are documents of their own. A document that two epochs take has
    two rows of its id, as the columns are those of ``documents``."""
    return _counted(mixing.mixed_texts(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, source, ids, n_tokens, ids_sha256, decoded_sha256`` of each row,
    repeated ones as well; a null or empty text has no ids."""
    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    rows = docs.select(F.struct("doc_id", "source").alias("key"), "text")
    decoded = bpe.round_trip(rows, ranks, pattern, id_col="key")
    return decoded.select("doc.doc_id", "doc.source", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("mix", mix), ("encode", encode)]

#: XXH64 fingerprints and tokenizers are beyond SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
