"""The registered queries of this subpackage and the SQL that some can be held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, katz, lengths, mixing, periodic, prefix_bpe, prefix_trie, quality, simhash, token_files, urls, warc
from .common import shared_folder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents")).withColumnRenamed("doc", "doc_id")


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(mixing.mix_documents(_table(spark, sf_dir, "documents")))


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(_table(spark, sf_dir, "documents"))
    return found.select(F.col("doc").alias("doc_id"), simhash.hex_digits(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    return bpe.digests(bpe.round_trip(_table(spark, sf_dir, "documents"), ranks, pattern)).withColumnRenamed("doc", "doc_id")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(spark, _table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared_folder(spark, "unused")  # sets the checkpoint folder
    pages = _table(spark, sf_dir, "pages")
    return urls.judge(pages, urls.train(urls.labelled_by_rules(pages)))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return lengths.suffix_sums(lengths.histogram(lengths.encoded_lengths(_table(spark, sf_dir, "documents"), ranks, pattern)))


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    files = token_files.write(_table(spark, sf_dir, "documents"), shared_folder(spark, "ids"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return token_files.read(files).select(F.col("doc").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ann.near_duplicates(_table(spark, sf_dir, "embeddings"), least=0.9)
    return found.rows.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"), F.lit(found.recall).alias("recall"))


def op6_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.train(_table(spark, sf_dir, "documents"), order=3).scores().withColumnRenamed("doc", "doc_id")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic.with_planted_periods(_table(spark, sf_dir, "documents"))
    return periodic.digests(periodic.runs(docs, "doc")).withColumnRenamed("doc", "doc_id")


def op12_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = prefix_bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return prefix_bpe.digests(found).withColumnRenamed("doc", "doc_id")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = prefix_trie.with_shared_starts(prefix_trie.conversations(_table(spark, sf_dir, "conversations")))
    found = prefix_trie.trie(convs)
    return found.select(
        F.col("conv").alias("conv_id"), F.col("depth").cast("long").alias("depth"), F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), "ends_sha256"
    )


QUERIES = {
    "op11_periodic_runs": op11_periodic_runs,
    "op12_prefix_bpe": op12_prefix_bpe,
    "op13_prefix_trie": op13_prefix_trie,
    "op6_katz_scores": op6_katz_scores,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op1_token_files": op1_token_files,
    "op10_token_counts": op10_token_counts,
    "op5_url_filter": op5_url_filter,
    "op4_warc": op4_warc,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_simhash_dedup": op8_simhash_dedup,
    "op3_mix_sources": op3_mix_sources,
    "op9_quality_rules": op9_quality_rules,
}

ORACLES: dict[str, str] = {
    # Five hex digits of the digest are four base32 letters.
    "op4_warc": """
        with p as (select page_id, encode(coalesce(html, '')) as payload from pages),
        d as (select page_id, octet_length(payload) as n, sha1(payload) as h, min(page_id) over (partition by sha1(payload), octet_length(payload)) as first from p)
        select page_id, n::bigint as payload_bytes,
               list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   1 + ((('0x' || substr(h, 1 + 5 * (i // 4), 5))::bigint >> (15 - 5 * (i % 4))) & 31)::int, 1)), 'string_agg', '') as payload_digest,
               case when page_id > first then 'revisit' else 'response' end as record_type,
               case when page_id > first then first end as refers_to
        from d
    """,
}
